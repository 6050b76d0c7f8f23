"""Redaction of credentials and personal data by ordered rules, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds and patterns, in the order in which they run; {} is the replacement's place.
RULES = [
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "{}"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "{}"),
    ("api_key", r"\b(?:sk-ant-[A-Za-z0-9_-]{20,}|sk-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}|xox[abps]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35})", "{}"),
    ("telegram_token", r"\b\d{8,10}:[A-Za-z0-9_-]{35}\b", "{}"),
    ("discord_token", r"\b[MNO][A-Za-z0-9_-]{23,27}\.[A-Za-z0-9_-]{6}\.[A-Za-z0-9_-]{27,40}", "{}"),
    ("bearer", r"(?i)(\bbearer\s+)[A-Za-z0-9._~+/=-]{16,}", "$1{}"),
    ("url_password", r"(?i)(\b[a-z][a-z0-9+.-]*://[^\s:/@]+:)[^\s@/]+(@)", "$1{}$2"),
    ("secret", r"(?i)(\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\s*[:=]\s*[\"']?)[^\s\"',;]{4,}", "$1{}"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "{}"),
    ("phone", r"(?:\+\d{1,3}[\s-]?\(?\d{1,4}\)?(?:[\s-]?\d{2,4}){2,4}|\b0[89]\d[\s-]?\d{3}[\s-]?\d{3,4}\b)", "{}"),
]
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_PRIVATE = rf"(?:10\.|127\.|169\.254\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|0\.0\.0\.0\b|255\.255\.255\.255\b)"
#: A public IPv4 address: four octets, outside of the private, local, unspecified, broadcast and shared ranges.
PUBLIC_IP = rf"\b(?!{_PRIVATE}){_OCTET}(?:\.{_OCTET}){{3}}\b"


def redacted(c: Column, extra: list[str] | None = None) -> Column:
    """The text with [REDACTED:kind] in place of what the rules find; null stays null."""
    for kind, pattern, place in RULES:
        c = F.regexp_replace(c, pattern, place.replace("{}", f"[REDACTED:{kind}]"))
    c = F.regexp_replace(c, PUBLIC_IP, "[REDACTED:ip]")
    for pattern in extra or []:
        c = F.regexp_replace(c, pattern, "[REDACTED:custom]")
    return c


def redaction_counts(c: Column) -> Column:
    """How many places of each kind a redacted text has: a map."""
    kinds = [k for k, _, _ in RULES] + ["ip", "custom"]
    counts = [F.size(F.regexp_extract_all(c, F.lit(rf"\[REDACTED:{k}\]"), 0)) for k in kinds]
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*counts)), lambda _, n: n > 0)


#: A string of JSON text, with the colon that makes it a key.
_STRING = r'"((?:[^"\\\\]|\\\\.)*)"(\s*:)?'


def redacted_json(c: Column, extra: list[str] | None = None) -> Column:
    """JSON text with every string value redacted, at any depth; keys, numbers and layout stay. Null and unreadable JSON give null.

    The text is cut into strings and what lies between them; strings that a colon follows are keys. A value is unescaped
    before the rules see it and escaped again after.
    """
    strings = F.regexp_extract_all(c, F.lit(_STRING), 0)
    between = F.split(c, _STRING, -1)

    def value(raw: Column) -> Column:
        held = F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v")
        shown = F.to_json(F.struct(redacted(held, extra).alias("v")))
        return F.when(redacted(held, extra) == held, raw).otherwise(F.regexp_replace(F.regexp_replace(shown, r'^\{"v":', ""), r"\}$", ""))

    out = F.transform(strings, lambda x: F.when(F.endswith(x, F.lit(":")), x).otherwise(value(x)))
    pieces = F.transform(F.arrays_zip(between.alias("gap"), out.alias("text")), lambda z: F.concat(F.coalesce(z["gap"], F.lit("")), F.coalesce(z["text"], F.lit(""))))
    return F.when(F.try_parse_json(c).isNotNull(), F.array_join(pieces, ""))
