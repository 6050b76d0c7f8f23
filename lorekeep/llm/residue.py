"""Documents that are template residue or error pages instead of content.

Each document is read once where it lies. Code is set aside, and lines are cut into clauses ("units") whose wording
(numbers, identifiers and names masked) is hashed. A few general rules give trusted labels to wordings: what opens like
an error message or a notice about scripts, what calls itself filler, the usual Latin filler text. From there labels
spread over the whole collection:

* through near-duplicates: wordings get a SimHash over shingles of five words; partitioned tables give candidates, the
  Hamming distance and then the Jaccard similarity of the shingles verify them. Starting at the trusted wordings, round
  by round, exactly the connected components that hold a trusted wording are built; all others are never expanded;
* through company: a wording that stands in several documents, and mostly beside labelled ones, is labelled too;
* through words: pretended Latin is told by a lexicon learned from sentences without any function word, of which those
  with a word of the usual filler text are the trusted ones.

Unfilled placeholders are a matter of syntax; their label belongs to a place, not to a wording, and does not spread.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.sources.scratch import materialise, release

SHINGLE = 5
SIMILARITY = 0.8
#: Tables of a SimHash, one for each block of 16 bits; the bits by which a trusted wording's block may differ from the key
#: it looks up (so all pairs within 11 bits meet, and most within HAMMING, the widest distance that is verified). Only
#: the few trusted wordings look up many keys; each wording of the collection stands in four tables.
BLOCKS, RADIUS, HAMMING = 4, 2, 18
#: Documents a wording must stand in, and the share of its places that must lie beside labelled wordings, to be labelled
#: by its company; how far company reaches.
SUPPORT, COMPANY, REACH = 3, 0.5, 2
#: Sentences a word must stand in, and the share of them with a word of the usual filler text, to count as filler Latin;
#: the share of such words that makes a sentence filler.
SEEN, LATIN_SHARE, LATIN_WORDS = 5, 1 / 3, 0.75
FILLER, MESSAGE = 1, 2

# Syntax of unfilled placeholders.
_NAME = r"[A-Za-z_][\w.\-]*"
PLACEHOLDERS = [
    rf"\{{\{{\s*{_NAME}(?:\s*\|[^{{}}\n]*)?\s*\}}\}}",  # {{ name }}
    rf"(?<![\w$#{{])\{{(?:{_NAME}|\d+)\}}(?!\}})",  # {name} {0}
    rf"[$#]\{{\s*{_NAME}\s*\}}",  # ${NAME} #{name}
    r"\{%\s*\w+[^%\n]*%\}",  # {% block name %}
    r"<%=?\s*[^%\n]+%>",  # <%= name %>
    rf"%\({_NAME}\)[sdf]",  # %(name)s
    r"(?<![\w%])%[A-Z][A-Z0-9_]*%(?!\w)",  # %NAME%
    r"(?<!\w)__[A-Z][A-Z0-9_]*?__(?!\w)",  # __NAME__
    r"@@[A-Za-z][A-Za-z0-9_]*@@",  # @@NAME@@
    r"\[\[\s*[a-z][a-z0-9_]*\s*\]\]",  # [[name]]
    r"<<\s*[A-Za-z][A-Za-z0-9_ ]*\s*>>",  # <<name>>
    r"<(?:[A-Z][A-Z0-9]*(?:[_ ][A-Z0-9]+)+|[A-Z]{2,}|(?:your|insert|enter|add)\s[^<>\n]{1,40})>",  # <NAME> <your name>
    r"\[(?:INSERT|YOUR|ENTER|ADD|FILL IN)\s[^\[\]\n]{1,40}\](?!\()",  # [INSERT NAME HERE] [Your Name]
    r"\[(?:Insert|Your|Enter|Add|Fill in)\s[^\[\]\n]{1,40}\](?!\()",
    r"\[[^\[\]\n]{1,40}\s(?:goes here|here)\](?!\()",  # [name goes here]
    r"\[(?:TBD|TODO|TBA|TK|FIXME)\b[^\[\]\n]{0,40}\](?!\()",  # [TBD: name]
    r"(?<!\w)X{4,}(?!\w)",  # XXXX
    r"(?<!\w)_{5,}(?!\w)(?!\s*$)|(?<=\S[ \t])_{5,}(?!\w)",  # ____ (name), but no rule across the page
]
# Words of the usual Latin filler text that no living language shares.
LATIN = frozenset("lorem ipsum dolor amet consectetur consectetuer adipiscing eiusmod incididunt aliqua veniam nostrud exercitation ullamco aliquip consequat reprehenderit voluptate cillum fugiat excepteur occaecat cupidatat proident deserunt mollit".split())
# Function words of the languages at hand; a sentence with one is no pretended Latin.
FUNCTION = frozenset(
    "a an the this that these those of to in on at by for from with and or but not is are was were be been has have had it its as if we you he she they i my your our their no so than then there which who what when where how can could must may will would should "
    "der die das den dem des ein eine einen einem und oder nicht ist sind war auf mit von zu für im am bei wird werden sich es wir sie er nach aus als wenn "
    "le la les un une des et ou ne pas est sont était de du au aux dans sur pour par avec il elle nous vous que qui ce cette se "
    "el los las una unos y o no es son era del al en por con para se su sus que como lo".split()
)
# Clauses, in plain lower-cased words, that call themselves filler.
_COPY = r"(?:text|copy|content|value|paragraph)s?"
_FAKE = r"(?:filler|dummy|placeholder|sample|blind)"
FILLER_SEEDS = [
    rf"(?:this|here|it) is (?:just |only |some |a )*{_FAKE}(?: {_COPY})?",
    rf"(?:some |more |a |your |the |this )*{_FAKE} ?{_COPY}(?: goes| comes)?(?: here)?",
    rf"(?:your|some|insert|add|enter|type|put|write)(?: \w+){{0,2}} {_COPY}(?: goes| comes)? here",
    rf"replace this {_COPY} with your own.*",
    r"(?:blindtext|fülltext|platzhaltertext|texto de relleno|texte de remplissage|faux texte)\b.*",
]
# How error messages and notices about scripts, browsers and access open. Reason phrases are the standard's.
_JS = r"(?:javascript|js|scripts?|scripting|cookies)"
_PAGE = r"(?:page|address|url|site|website|file|resource|document|server|service)"
_REASON = r"(?:bad request|unauthorized|forbidden|not found|method not allowed|request timeout|gone|too many requests|internal server error|not implemented|bad gateway|service unavailable|gateway timeout)"
MESSAGE_SEEDS = [
    rf"(?:please |bitte |veuillez |por favor )?(?:enable|activate|allow|turn on|switch on|aktivieren sie|activez|activer|active|habilite) {_JS}\b",
    rf"you (?:need|have) to (?:enable|activate|allow|turn on) {_JS}\b|(?:[\w ]{{1,30}}, )?(?:turn|switch) {_JS} on\b",
    rf"{_JS} (?:is|are|has to be|have to be|must be) (?:\w+ )?(?:off|on|disabled|enabled|required|blocked|needed)\b",
    rf"(?:this|the|our) \w+ (?:needs|requires|cannot \w+ without|does not work without) {_JS}\b",
    r"noscript\b",
    r"your browser (?:is|does not|cannot)\b|checking your browser\b",
    r"(?:[\w ]{1,20}: )?(?:confirm|verify|prove|check)(?: that)? you are (?:human|not a robot)\b",
    r"(?:access|zugriff|accès|acceso) (?:is |was )?(?:denied|forbidden|verweigert|refusé|denegado)\W*$",
    r"you (?:have no|do not have|don't have|lack|need) permission\b|you are not (?:allowed|authorized)\b",
    r"(?:your|the|this) session (?:has |is )?(?:expired|timed out|ended)\b",
    rf"(?:{_PAGE}|seite|page|página) (?:not found|nicht gefunden|introuvable|no encontrada)\b",
    rf"(?:this|the|that) (?:requested )?{_PAGE}(?: \S+)? (?:(?:has )?moved|no longer exists|does not exist|doesn't exist|could not be found|was not found|is not (?:on|available)|is (?:temporarily )?(?:down|unavailable|offline))\b",
    r"we are (?:currently )?(?:down|offline|closed) for maintenance\b",
    r"we (?:could not|couldn't|cannot|can't) (?:load|open|show|reach) this\b",
    r"oops\b|something went wrong\b|an (?:unexpected )?error (?:has )?occurred\b",
    rf"http(?:/\d(?:\.\d)?)? [45]\d\d\b.{{0,40}}$|(?:error |status )?[45]\d\d {_REASON}\W*$|{_REASON}(?:: |\. |\W*$)",
    r"(?:error|erreur|fehler) [45]\d\d\b",
    r'\{\s*"error"\s*:',
    r"traceback(?: \(most recent call last\))?:|stack ?trace:|exception in thread\b|(?:fatal|uncaught|unhandled) (?:error|exception)\b",
]
_I = re.IGNORECASE
_HOLD = re.compile("|".join(PLACEHOLDERS), re.M)
_HINT = re.compile(r"[{}<>\[\]%@]|XXXX|_____|__[A-Z]")
_FILL = re.compile("|".join(f"(?:{p})" for p in FILLER_SEEDS))
_MSG = re.compile("|".join(f"(?:{p})" for p in MESSAGE_SEEDS), _I)
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?(?:^ {0,3}\1[^\n]*$|\Z)", re.M | re.S)
_INDENT = re.compile(r"^(?: {4}|\t)[^\n]*$", re.M)
_TICKS = re.compile(r"(`+)(?!`)[^\n]*?(?<!`)\1(?!`)")
_QUOTED = re.compile(r"“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|\"[^\"\n]*\"")
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_OPEN = re.compile(r"^[\s#>*+\-]*")
#: Words, ends of lines, of sentences and of clauses.
_TOKENS = re.compile(r"[^\W_]+(?:[_./\-'’][^\W_]+)*|\n|[.!?](?=[\s\"'”)\]]|\Z)|[。！？]|:(?=\s)")
_ENDS = frozenset(".!?。！？")
#: Words without which no rule of filler or of messages can hold; they spare the rules for most lines.
_FILL_HINTS = frozenset("filler dummy placeholder sample blind text copy content value paragraph texts values paragraphs blindtext fülltext platzhaltertext relleno remplissage faux".split())
_MSG_HINTS = frozenset(
    "javascript js script scripts scripting cookies noscript browser human robot denied forbidden verweigert refusé denegado permission allowed authorized session found gefunden introuvable encontrada page address url site website file resource document server service maintenance oops wrong "
    "load open show reach error occurred http https request unauthorized method timeout gone requests implemented gateway unavailable erreur fehler traceback trace stacktrace exception".split()
)


def _prose(text: str) -> str:
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = _HIDDEN.sub("", text)
    if "`" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "\n    " in text or "\t" in text or text.startswith("    "):
        text = _INDENT.sub("", text)
    return text


def has_placeholder(prose: str) -> bool:
    """An unfilled placeholder outside of backticks and quotation marks."""
    if not _HINT.search(prose):
        return False
    bare = _TICKS.sub(" ", prose)
    return any(not any(q.start() < m.start() and m.end() < q.end() for q in _QUOTED.finditer(bare)) for m in _HOLD.finditer(bare))


def opens_as_message(line: str) -> bool:
    """Whether a line opens like an error message or a notice; markup before it is ignored."""
    return _MSG.match(line, _OPEN.match(line).end()) is not None


def calls_itself_filler(words: list[str]) -> bool:
    """Whether the lower-cased words of a clause say that it is filler, or are one word over and over."""
    return (len(words) >= 3 and len(set(words)) == 1) or _FILL.fullmatch(" ".join(words)) is not None


_ZERO = 0x5851F42D4C957F2D
_LINE, _END, _CLAUSE = np.uint64(1), np.uint64(2), np.uint64(3)
# bits of a word: masked, function word, usual Latin, hint of filler, hint of a message, plain letters
_MASKED, _FUNC, _LAT, _HF, _HM, _LETTERS = 1, 2, 4, 8, 16, 32


class _Words:
    """Code and bits of each token; numbers, identifiers and names inside a line share a code."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def add(self, words: set[str]) -> None:
        from xxhash import xxh64_intdigest

        if len(self.known) > 500_000:
            self.known.clear()
        for w in words:
            if w == "\n":
                self.known[w] = int(_LINE), 0
            elif w in _ENDS:
                self.known[w] = int(_END), 0
            elif w == ":":
                self.known[w] = int(_CLAUSE), 0
            else:
                low = w.lower()
                masked = any(c.isdigit() for c in w) or "_" in w or "." in w or "/" in w or (w[1:] != low[1:] and w != w.upper())
                status = len(w) == 3 and w[0] in "45" and w.isdigit()
                bits = (_MASKED if masked else 0) | (_FUNC if low in FUNCTION else 0) | (_LAT if low in LATIN else 0) | (_HF if low in _FILL_HINTS else 0) | (_HM if low in _MSG_HINTS or status else 0) | (_LETTERS if w.isalpha() else 0)
                self.known[w] = (_ZERO if masked else max(4, xxh64_intdigest(low.encode("utf-8", "surrogatepass"))), bits)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        self.add({w for w in set(words) if w not in known})
        both = [known[w] if w in known else self.one(w) for w in words]
        return np.array([c for c, _ in both], dtype=np.uint64), np.array([b for _, b in both], dtype=np.int64)

    def one(self, w: str) -> tuple[int, int]:
        self.add({w})
        return self.known[w]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(codes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five codes; of all codes where there are fewer."""
    n = max(1, len(codes) - SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(SHINGLE, len(codes))):
            out = out * np.uint64(0x9E3779B97F4A7C15) + (codes[k : k + n] ^ (codes[k : k + n] >> np.uint64(31)))
    return _mix(out)


def _simhashes(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of texts whose word codes stand one after the other: the majority of each bit over their shingles."""
    starts = np.concatenate([[0], ends[:-1]])
    out = np.zeros(len(ends), dtype=np.uint64)
    long = np.nonzero(ends - starts > SHINGLE)[0]
    for i in np.nonzero((ends > starts) & (ends - starts <= SHINGLE))[0]:
        out[i] = _shingles(codes[starts[i] : ends[i]])[0]
    if not len(long):
        return out
    inside = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - SHINGLE + 1, -1)
    shingles = _shingles(codes)
    use = shingles[np.nonzero(np.cumsum(inside)[: len(shingles)])[0]]
    counts = ends[long] - starts[long] - SHINGLE + 1
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])
    found = np.zeros(len(long), dtype=np.uint64)
    for bit in range(0, 64, 8):
        bits = np.unpackbits(((use >> np.uint64(bit)) & np.uint64(255)).astype(np.uint8)[:, None], axis=1, bitorder="little")
        most = 2 * np.add.reduceat(bits, at, axis=0, dtype=np.int32) > counts[:, None]
        found |= np.packbits(most, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(bit)
    out[long] = found
    return out


#: Shingles below which a wording has no other within the similarity: n of n + 1 is less than 0.8 for n < 4.
_LEAST = 4


class _Units:
    """The units of some texts, one after the other: of each its text, line, words, code and labels."""

    def __init__(self, known: _Words, proses: list[str]) -> None:
        flat: list[str] = []
        ends = []
        for p in proses:
            flat += _TOKENS.findall(p)
            flat.append("\n")
            ends.append(len(flat))
        self.codes, self.bits = known.codes(flat)
        codes, bits = self.codes, self.bits
        stop = codes <= _CLAUSE
        text = np.searchsorted(np.array(ends, dtype=np.int64), np.arange(len(codes)), "right")
        newline = codes == _LINE
        line = np.cumsum(newline) - newline
        group = np.cumsum(stop) - stop  # tokens up to and with a stop are one unit
        word = np.nonzero(~stop)[0]
        _, first, counts = np.unique(group[word], return_index=True, return_counts=True)
        self.n = len(first)
        self.word, self.starts, self.sizes = word, first, counts
        # names: capitals inside a line that is not all capitals
        owner = np.repeat(np.arange(self.n), counts)
        begin = word[first]
        self.text, self.line = text[begin], line[begin]
        self.head = np.ones(self.n, dtype=bool)
        self.head[1:] = self.line[1:] != self.line[:-1]
        last = np.zeros(len(codes), dtype=bool)  # tokens that end a sentence at the end of a line
        last[:-1] = newline[1:] & (codes[:-1] == _END)
        closed = np.zeros(int(line[-1]) + 1 if len(line) else 0, dtype=bool)
        closed[line[last]] = True
        self.closed = closed[self.line] if self.n else np.zeros(0, dtype=bool)
        self.flat = flat
        wc = codes[word]
        spot = np.arange(len(word)) - np.repeat(first, counts)
        with np.errstate(over="ignore"):
            mixed = _mix(wc + _mix(spot.astype(np.uint64)))
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed, dtype=np.uint64)])
            ends_at = first + counts
            self.code = _mix(total[ends_at] - total[first] + counts.astype(np.uint64)) if self.n else np.zeros(0, dtype=np.uint64)
        wb = bits[word]
        self.any = np.zeros(self.n, dtype=np.int64)
        np.bitwise_or.at(self.any, owner, wb)
        self.plain = np.ones(self.n, dtype=bool)
        np.logical_and.at(self.plain, owner, (wb & _LETTERS) > 0)
        self.lat = np.bincount(owner, weights=(wb & _LAT) > 0, minlength=self.n).astype(np.int64)
        self.ends_at = ends_at

    def words(self, i: int) -> list[str]:
        return [self.flat[k].lower() for k in self.word[self.starts[i] : self.ends_at[i]]]

    def seeds(self, proses: list[str]) -> np.ndarray:
        """FILLER or MESSAGE for units that a rule labels, 0 for all others."""
        out = np.zeros(self.n, dtype=np.int8)
        same = np.zeros(self.n, dtype=bool)  # one word over and over
        wc = self.codes[self.word]
        if len(wc):
            differs = np.concatenate([[0], np.cumsum(wc[1:] != wc[:-1])])
            same = (self.sizes >= 3) & (differs[self.ends_at - 1] == differs[self.starts]) & (wc[self.starts] != np.uint64(_ZERO))
        for i in np.nonzero(same | ((self.any & _HF) > 0))[0]:
            if calls_itself_filler(self.words(i)):
                out[i] = FILLER
        out[(self.lat >= 2) & (self.lat >= LATIN_WORDS * self.sizes) & (self.sizes >= 4)] = FILLER
        lines: dict[int, list[str]] = {}
        hinted = np.unique(self.line[(self.any & _HM) > 0])  # the rules look no further than the line's first clauses
        heads = np.nonzero(self.head & np.isin(self.line, hinted))[0]
        if len(heads):
            before = np.cumsum([0, *[p.count("\n") + 1 for p in proses]])
            for i in heads:
                t = int(self.text[i])
                if t not in lines:
                    lines[t] = proses[t].split("\n")
                if opens_as_message(lines[t][self.line[i] - before[t]]):
                    out[i] = MESSAGE
        return out

    def latin(self) -> np.ndarray:
        """Sentences that could be pretended Latin: four words or more, all of letters, none a function word."""
        return self.plain & (self.sizes >= 4) & ((self.any & (_FUNC | _MASKED)) == 0)


_UNIT = pa.struct([("code", pa.int64()), ("sim", pa.int64()), ("size", pa.int32()), ("line", pa.int32()), ("seed", pa.int8()), ("head", pa.bool_()), ("closed", pa.bool_()), ("latin", pa.int8()), ("words", pa.list_(pa.int64()))])
_SCHEMA = "doc_id bigint, placeholder boolean, units array<struct<code: bigint, sim: bigint, size: int, line: int, seed: tinyint, head: boolean, closed: boolean, latin: tinyint, words: array<bigint>>>"


def read_documents(documents: DataFrame) -> DataFrame:
    """Placeholder label and units of every document: doc_id, placeholder, units. One pass, no shuffle; all rows stay.

    A unit: code (hash of its masked wording), sim (SimHash; null where too short for a near-duplicate), size (words),
    line, seed (trusted label or 0), head (first of its line), closed (its line ends as a sentence), latin (null: no
    candidate for pretended Latin; 1: with a word of the usual text) and, of candidates, words. Null and blank texts
    have no units.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            start = 0
            while start < batch.num_rows:  # a bounded amount of text at a time
                proses, first, chars = [], start, 0
                while start < batch.num_rows and chars < 2_000_000:
                    text = batch.column(1)[start].as_py()
                    proses.append(_prose(text) if text else "")
                    chars += len(proses[-1])
                    start += 1
                u = _Units(known, proses)
                wc = u.codes[u.word]
                sims = _simhashes(wc, u.ends_at) if u.n else np.zeros(0, dtype=np.uint64)
                latin = u.latin()
                counts = np.where(latin, u.sizes, 0)
                use = np.repeat(latin, u.sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(wc[use].view(np.int64)))
                fields = [
                    pa.array(u.code.view(np.int64)), pa.array(sims.view(np.int64), mask=u.sizes - SHINGLE + 1 < _LEAST), pa.array(u.sizes.astype(np.int32)), pa.array(u.line.astype(np.int32)),
                    pa.array(u.seeds(proses)), pa.array(u.head), pa.array(u.closed), pa.array((u.lat > 0).astype(np.int8), mask=~latin), lists,
                ]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(u.text, minlength=len(proses)))]).astype(np.int32)
                units = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, fields=list(_UNIT)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, start - first), pa.array([has_placeholder(p) for p in proses]), units], names=["doc_id", "placeholder", "units"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def _wording_shingles(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """code, shingles of the wordings in `wanted` (code, doc_id, at: the place of one unit of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            codes, out = [], []
            for text, places in zip(batch.column(0), batch.column(1)):
                u = _Units(known, [_prose(text.as_py())])
                wc = u.codes[u.word]
                for p in places.as_py():
                    if p < u.n:
                        codes.append(int(u.code[p].view(np.int64)))
                        out.append(np.unique(_shingles(wc[u.starts[p] : u.ends_at[p]])).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(codes, type=pa.int64()), pa.array(out, type=pa.list_(pa.int64()))], names=["code", "shingles"])

    places = wanted.groupBy("doc_id").agg(F.collect_set("at").alias("places"))  # units of one document
    picked = documents.where("text is not null").join(places, "doc_id").select("text", "places")
    return picked.mapInArrow(run, "code bigint, shingles array<bigint>").groupBy("code").agg(F.first("shingles").alias("shingles"))


def _block(k: int) -> Column:
    width = 64 // BLOCKS
    return F.shiftrightunsigned("sim", k * width).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _tables(wordings: DataFrame) -> DataFrame:
    """A row a table of each wording: t, key."""
    return wordings.select(*wordings.columns, F.inline(F.array(*[F.struct(F.lit(k).alias("t"), _block(k).alias("key")) for k in range(BLOCKS)])))


def _probes(wordings: DataFrame) -> DataFrame:
    """A row for each key that is at most RADIUS bits away from a wording's own, in each table: t, key."""
    flips = [sum(1 << b for b in bits) for r in range(RADIUS + 1) for bits in combinations(range(64 // BLOCKS), r)]
    around = F.array(*[F.lit(f).cast("bigint") for f in flips])

    def table(k: int) -> Column:
        return F.transform(around, lambda f: F.struct(F.lit(k).alias("t"), _block(k).bitwiseXOR(f).alias("key")))

    keys = F.flatten(F.array(*[table(k) for k in range(BLOCKS)]))
    return wordings.select(*wordings.columns, F.inline(keys))


def near_wordings(wordings: DataFrame, known: DataFrame, documents: DataFrame) -> DataFrame:
    """Wordings similar to known ones: code, kind. `wordings`: code, sim, shingled, doc_id, at; `known`: the same and kind.

    Only `known` decides which candidates there are: the keys it looks up are joined with the tables of all wordings long
    enough to have near-duplicates; candidates are cut by Hamming distance and by the number of shingles.
    """
    long = wordings.where("sim is not null")
    left = _tables(long.select("code", "sim", "shingled"))
    right = _probes(known.where("sim is not null").select(F.col("code").alias("near"), "sim", F.col("shingled").alias("most"), "kind")).withColumnRenamed("sim", "near_sim")
    ok = (F.col("code") != F.col("near")) & (F.bit_count(F.col("sim").bitwiseXOR(F.col("near_sim"))) <= HAMMING) & (F.least("shingled", "most") >= SIMILARITY * F.greatest("shingled", "most"))
    pairs = materialise(left.join(right, ["t", "key"]).where(ok).select("code", "near", "kind").distinct())
    ends = pairs.select("code").union(pairs.select("near")).distinct().join(long.select("code", "doc_id", "at"), "code")
    texts = materialise(_wording_shingles(documents, ends))
    shared = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(texts.select("code", F.col("shingles").alias("sa")), "code").join(texts.select(F.col("code").alias("near"), F.col("shingles").alias("sb")), "near")
    out = materialise(both.where(shared >= SIMILARITY * (F.size("sa") + F.size("sb") - shared)).select("code", "kind").distinct())
    release(pairs, texts)
    return out


def learned_latin(units: DataFrame) -> DataFrame:
    """Documents with sentences of pretended Latin: doc_id, at. `units`: doc_id, at, latin, words.

    Of sentences without a function word, a word counts as filler if it stands in SEEN of them or more and a third of
    those hold a word of the usual text; a sentence of which three quarters are such words is filler.
    """
    sentences = units.where("latin is not null").select("doc_id", "at", "latin", F.array_distinct("words").alias("words"))
    words = sentences.select("doc_id", "at", "latin", F.size("words").alias("size"), F.explode("words").alias("word"))
    lexicon = words.groupBy("word").agg(F.count("*").alias("n"), F.sum("latin").alias("seeded")).where((F.col("n") >= SEEN) & (F.col("seeded") >= LATIN_SHARE * F.col("n"))).select("word")
    hits = words.join(lexicon, "word").groupBy("doc_id", "at").agg(F.count("*").alias("hits"), F.first("size").alias("size"))
    return hits.where(F.col("hits") >= LATIN_WORDS * F.col("size")).select("doc_id", "at")


def _decisions(units: Column, label) -> tuple[Column, Column]:  # noqa: ANN001
    """Whether a document has a filler paragraph and whether it is an error page, by a label of each of its units.

    Filler: a line of which half the words are labelled, or two labelled units that follow each other. A page: some line
    opens with a labelled message, and all others do or are titles, menus and footers (do not end as a sentence).
    """
    # in order: words and labelled words of the line at hand, whether a line or a run sufficed
    step = F.aggregate(
        units,
        F.struct(F.lit(-1).alias("line"), F.lit(0).alias("words"), F.lit(0).alias("good"), F.lit(False).alias("before"), F.lit(False).alias("found")),
        lambda s, u: F.struct(
            u["line"].alias("line"),
            (F.when(s["line"] == u["line"], s["words"]).otherwise(F.lit(0)) + u["size"]).alias("words"),
            (F.when(s["line"] == u["line"], s["good"]).otherwise(F.lit(0)) + F.when(label(u) == FILLER, u["size"]).otherwise(F.lit(0))).alias("good"),
            (label(u) == FILLER).alias("before"),
            (s["found"] | (s["before"] & (label(u) == FILLER)) | ((s["line"] != u["line"]) & (s["good"] > 0) & (2 * s["good"] >= s["words"]))).alias("found"),
        ),
        lambda s: s["found"] | ((s["good"] > 0) & (2 * s["good"] >= s["words"])),
    )
    page = F.exists(units, lambda u: u["head"] & (label(u) == MESSAGE)) & F.forall(units, lambda u: ~u["head"] | (label(u) == MESSAGE) | ~u["closed"])
    return F.coalesce(step, F.lit(False)), F.coalesce(page, F.lit(False))


def labelled(documents: DataFrame) -> DataFrame:
    """Every document with its labels: doc_id, placeholder, filler, page, spread.

    `filler` and `page` hold where trusted labels or spread ones decide; `spread` says that trusted ones alone would not
    have sufficed. Null and blank texts have no label. Rows with a null doc_id keep what trusted labels alone say; rows
    that repeat a doc_id share the labels spread to any of them. Other columns are ignored. Empty in, empty out.
    """
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = materialise(read_documents(documents))
    units = read.where("doc_id is not null").select("doc_id", F.posexplode("units").alias("at", "u")).select("doc_id", "at", "u.*")
    wordings = materialise(
        units.groupBy("code").agg(F.max("seed").alias("seed"), F.min(F.struct("doc_id", "at")).alias("place"), F.first("sim").alias("sim"), F.first("size").alias("size"), F.count("*").alias("n")).select("code", "seed", "sim", (F.col("size") - (SHINGLE - 1)).alias("shingled"), "place.doc_id", "place.at", "n")
    )
    known = materialise(wordings.where("seed > 0").select("code", F.col("seed").cast("int").alias("kind")))
    fresh = known
    while not fresh.isEmpty():  # the components of trusted wordings, round by round
        around = near_wordings(wordings, wordings.drop("n", "seed").join(fresh, "code"), documents)
        fresh = materialise(around.groupBy("code").agg(F.max("kind").alias("kind")).join(known, "code", "left_anti"))
        known = materialise(known.unionByName(fresh))
    latin = materialise(learned_latin(units))
    marked = materialise(units.select("doc_id", "at", "code").join(known, "code").select("doc_id", "at", "kind").unionByName(latin.select("doc_id", "at", F.lit(FILLER).alias("kind"))))
    marks = F.map_from_entries(F.collect_set(F.struct("at", "kind")))

    def with_marks(m: DataFrame) -> DataFrame:
        of = m.groupBy("doc_id", "at").agg(F.max("kind").alias("kind")).groupBy("doc_id").agg(marks.alias("marks"))  # units of one document
        plain = F.transform("units", lambda u, i: F.struct(u["code"].alias("code"), u["line"].alias("line"), u["size"].alias("size"), u["seed"].alias("seed"), u["head"].alias("head"), u["closed"].alias("closed"), i.alias("at")))
        return read.select("doc_id", plain.alias("units")).join(of, "doc_id")

    near = with_marks(marked)
    beside = [F.element_at("marks", F.col("u.at") + k) for k in range(-REACH, REACH + 1) if k]
    company = near.select("doc_id", "marks", F.explode("units").alias("u")).where(F.element_at("marks", F.col("u.at")).isNull() & (F.col("u.size") > 0))
    company = company.select("doc_id", F.col("u.code").alias("code"), F.coalesce(*[b for pair in zip(beside[REACH - 1 :: -1], beside[REACH:]) for b in pair]).alias("kind")).where("kind is not null")
    counts = company.groupBy("code", "kind", "doc_id").count().groupBy("code", "kind").agg(F.count("*").alias("documents"), F.sum("count").alias("places")).where(F.col("documents") >= SUPPORT)
    joined = materialise(counts.join(wordings.select("code", "n"), "code").where(F.col("places") >= COMPANY * F.col("n")).groupBy("code").agg(F.max_by("kind", "places").alias("kind")))
    marked = marked.unionByName(units.select("doc_id", "at", "code").join(joined, "code").select("doc_id", "at", "kind"))
    filler, page = _decisions(F.col("units"), lambda u: F.coalesce(F.element_at("marks", u["at"]), F.lit(0)))
    spread = with_marks(marked).select("doc_id", filler.alias("f"), page.alias("p")).groupBy("doc_id").agg(F.bool_or("f").alias("f"), F.bool_or("p").alias("p")).where("f or p")
    filler, page = _decisions(F.col("units"), lambda u: u["seed"])
    own = read.select("doc_id", "placeholder", filler.alias("filler"), page.alias("page"))
    out = own.join(spread, "doc_id", "left").select("doc_id", "placeholder", (F.col("filler") | F.coalesce("f", F.lit(False))).alias("f"), (F.col("page") | F.coalesce("p", F.lit(False))).alias("p"), "filler", "page")
    return out.select("doc_id", "placeholder", F.col("f").alias("filler"), F.col("p").alias("page"), ((F.col("f") | F.col("p")) & ~(F.col("filler") | F.col("page"))).alias("spread"))
