"""Text functions of records and documents as columns; Arrow functions only where a scan along the text is needed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    """Words in order, with repeats: runs of letters and digits of any script, lower-cased; null gives none."""
    return F.coalesce(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""), F.array().cast("array<string>"))


def words(c: Column) -> Column:
    """Distinct words of three or more characters."""
    return F.array_distinct(F.filter(tokens(c), lambda w: F.char_length(w) >= 3))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard overlap of two word sets; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


#: Code points of scripts.
SCRIPTS = {
    "latin": "\\x{41}-\\x{24F}\\x{1E00}-\\x{1EFF}",
    "greek": "\\x{370}-\\x{3FF}\\x{1F00}-\\x{1FFF}",
    "cyrillic": "\\x{400}-\\x{52F}\\x{1C80}-\\x{1C8F}\\x{2DE0}-\\x{2DFF}\\x{A640}-\\x{A69F}",
    "armenian": "\\x{530}-\\x{58F}",
    "hebrew": "\\x{590}-\\x{5FF}",
    "arabic": "\\x{600}-\\x{6FF}\\x{750}-\\x{77F}\\x{8A0}-\\x{8FF}",
    "devanagari": "\\x{900}-\\x{97F}",
    "thai": "\\x{E00}-\\x{E7F}",
    "georgian": "\\x{10A0}-\\x{10FF}",
    "hangul": "\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}\\x{AC00}-\\x{D7AF}",
    "kana": "\\x{3040}-\\x{30FF}",
    "han": "\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}",
}


def script(word: Column) -> Column:
    """The script of a word by its first letter; numbers and other scripts are 'other'."""
    out = None
    for name, points in SCRIPTS.items():
        hit = word.rlike(f"^\\P{{L}}*[{points}]") & word.rlike("\\p{L}")
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def entity_key(name: Column) -> Column:
    """A name without case, blanks, hyphens and underscores; the lower-cased name if that leaves nothing."""
    bare = F.regexp_replace(F.lower(name), r"[\s\-_]", "")
    return F.when(bare == "", F.lower(name)).otherwise(bare)


def name_tokens(name: Column) -> Column:
    """Parts of a name in camel, Pascal, acronym, snake, kebab or path form, lower-cased, in order, with repeats."""
    cut = F.regexp_replace(F.regexp_replace(name, r"(\p{Lu})(?=\p{Lu}\p{Ll})", "$1 "), r"([\p{Ll}\p{N}])(?=\p{Lu})", "$1 ")
    return F.filter(F.split(F.lower(cut), r"[\s_\-/.]+"), lambda w: w != "")


def slug(c: Column, empty: str = "workspace", most: int = 48) -> Column:
    """ASCII letters and digits, lower-cased, every other run a hyphen, none at the ends, at most 48 characters; `empty` if nothing is left."""
    ascii_low = F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    base = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(ascii_low, r"[^a-z0-9]+", "-"), r"^-+", ""), 1, most), r"-+$", "")
    return F.when(c.isNotNull(), F.when(base == "", F.lit(empty)).otherwise(base))


def parsed_time(c: Column) -> Column:
    """The UTC time a text names: RFC 3339, 'date time' or a date; null for all else."""
    bare = F.trim(c)
    zoned = F.when(bare.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.to_utc_timestamp(F.try_to_timestamp(bare), F.current_timezone()).cast("timestamp_ntz"))
    plain = F.when(bare.rlike(r"^\d{4}-\d\d-\d\d( \d\d:\d\d:\d\d)?$"), bare.try_cast("timestamp_ntz"))
    return F.coalesce(zoned, plain)


def estimated_tokens(c: Column) -> Column:
    return F.ceil(F.octet_length(c) / 4)


def same_path(a: Column, b: Column) -> Column:
    """Whether one path is a suffix of the other, by components."""
    pa, pb = F.concat(F.lit("/"), F.ltrim(a, F.lit("/"))), F.concat(F.lit("/"), F.ltrim(b, F.lit("/")))
    return pa.endswith(pb) | pb.endswith(pa)


def escaped(c: Column) -> Column:
    """HTML escaping of template output."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


#: The least similarity of each label.
QUALITY = [(0.85, "Excellent"), (0.70, "Very Good"), (0.55, "Good"), (0.40, "Moderate"), (0.30, "Fair")]


def quality(similarity: Column) -> Column:
    """The label of a similarity; Weak below all bounds, and for null."""
    label = F.lit("Weak")
    for least, name in reversed(QUALITY):
        label = F.when(similarity >= least, name).otherwise(label)
    return label


_SPACE = re.compile(r"\s")


def _windows(text: str, size: int, shared: int) -> list[str]:
    """Pieces of at most `size` characters: as long as possible if they can end before a blank in their second half, else cut at `size`."""
    if size <= 0:
        return [text]
    ending = re.compile(rf"(?s).{{{size // 2},{size - 1}}}(?=\s)")
    out, at = [], 0
    while len(text) - at > size:
        piece = ending.match(text, at)
        end = piece.end() if piece else at + size
        out.append(text[at:end].strip())
        blank = _SPACE.search(text, max(end - shared, at + 1), end)  # the next piece begins with a word of the shared part
        at = blank.end() if blank else end
    return [*out, text[at:].strip() if out else text]


def chunks(df: DataFrame, ident: str, text: str, size: int = 1000, shared: int = 200) -> DataFrame:
    """Windows of a text: id, n, chunk_id ('<id>', then '<id>#2' and on), chunk. Null gives none, an empty text one empty window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, n, str(i) if n == 0 else f"{i}#{n + 1}", w) for i, t in zip(pdf["id"], pdf["text"]) if t is not None for n, w in enumerate(_windows(t, size, shared))]
            yield pd.DataFrame(rows, columns=["id", "n", "chunk_id", "chunk"])

    return df.select(F.col(ident).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {dict(df.dtypes)[ident]}, n int, chunk_id string, chunk string")


_W = re.compile(r"[^\W_]+")


def best_passage(text: str, query: str, most: int) -> str | None:
    """The part of at most `most` characters with the most distinct query words; None if the text is that short.

    Only parts that begin with a query word compete; the first of the best is led into by up to an eighth. All parts are
    scored at once: a query word's place counts for those parts that begin after the word's last place before it and
    reach to its end, which is a range of beginnings, so the scores are sums over range ends.
    """
    if len(text) <= most:
        return None
    spans = np.array([m.span() for m in _W.finditer(text)], dtype=np.int64).reshape(-1, 2)
    if not len(spans):
        return text[:most] + "…"
    asked = {w.lower() for w in _W.findall(query)}
    places = [(k, w) for k, w in enumerate(text[x:y].lower() for x, y in spans) if w in asked]
    first = 0
    if places:
        at = np.array([k for k, _ in places], dtype=np.int64)
        begins, ends = spans[at, 0], spans[at, 1]
        last: dict[str, int] = {}
        after = np.zeros(len(at), dtype=np.int64)
        for n, (_, w) in enumerate(places):
            after[n] = last.get(w, -1) + 1
            last[w] = n
        opens = np.maximum(after, np.searchsorted(begins, ends - most, "left"))
        counts = np.zeros(len(at) + 1, dtype=np.int64)
        fits = opens <= np.arange(len(at))
        np.add.at(counts, opens[fits], 1)
        np.add.at(counts, np.nonzero(fits)[0] + 1, -1)
        scores = np.cumsum(counts)[:-1]
        if scores.max() > 0:
            first = int(np.searchsorted(spans[:, 0], begins[int(scores.argmax())] - most // 8, "left"))
    start = int(spans[first, 0])
    end = int(spans[max(first, int(np.searchsorted(spans[:, 1], start + most, "right")) - 1), 1])
    return ("…" if start else "") + text[start:end] + ("…" if end < spans[-1, 1] else "")


def passages(df: DataFrame, text: str, query: str, most: int = 800) -> DataFrame:
    """df with `passage`, what a search shows of the text; null where the text is shown whole or is null."""

    @F.pandas_udf("string")
    def run(t: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([None if a is None else best_passage(a, b or "", most) for a, b in zip(t, q)])

    return df.withColumn("passage", run(F.col(text), F.col(query)))


_PIECE = re.compile(r"[^\s,;]*\{[^{}]*\}[^\s,;]*|[^\s,;]+")


def paths_of(text: str) -> list[str]:
    """Paths that a text lists: split outside of braces, {a,b} expanded, a line number cut off; bare names follow the directory before them."""
    out: list[str] = []
    base = ""
    for piece in _PIECE.findall(text):
        m = re.fullmatch(r"(.*)\{([^{}]*)\}(.*)", piece)
        for p in [m[1] + x.strip() + m[3] for x in m[2].split(",")] if m else [piece]:
            p = re.sub(r":\d+(?:[-:]\d+)*$", "", p).strip("`'\"()")
            if "/" in p:
                base = p.rpartition("/")[0]
            elif "." in p and base:
                p = f"{base}/{p}"
            if re.search(r"\.\w{1,8}$", p) and p not in out:
                out.append(p)
    return out




def with_paths(df: DataFrame, text: str) -> DataFrame:
    """df with `paths`, the files a text names."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([paths_of(t) if t else [] for t in s])

    return df.withColumn("paths", run(F.col(text)))


def terms(c: Column) -> Column:
    """Words of three or more characters and runs of capitalised words as one name, lower-cased; words are not stemmed."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{Lu}[\p{L}\p{N}']*(?:[^\p{L}\p{N}']+\p{Lu}[\p{L}\p{N}']*)*)"), 1)
    names = F.filter(F.transform(runs, lambda r: F.lower(F.regexp_replace(r, r"[^\p{L}\p{N}']+", " "))), lambda r: F.char_length(r) > 2)
    return F.coalesce(F.array_distinct(F.concat(words(c), names)), F.array().cast("array<string>"))


def name_keys(c: Column, most: int = 3) -> Column:
    """Entity keys of all runs of up to `most` words: the keys under which a text would name an entity."""
    w = F.filter(F.transform(F.split(c, r"[^\p{L}\p{N}+#./\-_'’]+"), lambda x: F.regexp_replace(F.regexp_replace(x, r"^[.'’]+|[.'’]+$", ""), r"['’]s$", "")), lambda x: x != "")
    return F.array_distinct(F.transform(F.concat(*[_runs(w, k) for k in range(1, most + 1)]), entity_key))


def name_words(name: Column) -> Column:
    """Words of a name as `name_keys` needs them at most: between blanks, hyphens and underscores."""
    return F.size(F.filter(F.split(name, r"[\s\-_]+"), lambda x: x != ""))


def _runs(w: Column, k: int) -> Column:
    starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i, k), " "))


def update_text(title: Column, description: Column, details: Column) -> Column:
    """The text under which a record is embedded: title, description and details, a line each; null if it is shorter than ten characters."""
    whole = F.concat_ws("\n", title, description, F.array_join(details, "\n"))
    return F.when(F.char_length(F.trim(whole)) >= 10, whole)
