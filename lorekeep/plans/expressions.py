"""A typed expression language, compiled to Spark columns; no row-wise Python.

The grammar is the public CEL subset that data blocks use: literals, lists, maps, member and index access, the
conditional, logic, comparison, `in`, arithmetic, calls, and the macros all, exists, map, filter, has. `/` and `%` are
integer operations on integers. What is unknown, mistyped or too large is refused when compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Static limits of an expression: characters, nodes, depth.
MAX_CHARS, MAX_NODES, MAX_DEPTH = 4096, 1000, 32


class ExpressionError(ValueError):
    """An expression that can't be compiled; the message names the place."""


@dataclass(frozen=True)
class Typed:
    """A column with its type: string, int, double, bool, timestamp, duration, null, list<T>, map, struct, dyn."""

    column: Column
    type: str
    fields: dict[str, str] | None = None


_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+u?)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<id>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/%!<>?:.,()\[\]{}]))""")


def _tokens(text: str) -> list[tuple[str, str, int]]:
    if len(text) > MAX_CHARS:
        raise ExpressionError(f"longer than {MAX_CHARS} characters")
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"unexpected {text[at:at + 10]!r} at {at}")
        out.append((m.lastgroup or "", m[m.lastgroup or 0], at))
        at = m.end()
    return [*out, ("end", "", len(text))]


_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "in": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5}


class _Parser:
    """Precedence climbing; nodes are tuples (kind, *parts)."""

    def __init__(self, text: str) -> None:
        self.items, self.at, self.nodes = _tokens(text), 0, 0

    def take(self, value: str | None = None) -> tuple[str, str, int]:
        item = self.items[self.at]
        if value is not None and item[1] != value:
            raise ExpressionError(f"expected {value!r} at {item[2]}, found {item[1]!r}")
        self.at += 1
        return item

    def peek(self) -> str:
        kind, value, _ = self.items[self.at]
        return value if kind in ("op", "end") or value == "in" else ""

    def node(self, *parts: object) -> tuple:
        self.nodes += 1
        if self.nodes > MAX_NODES:
            raise ExpressionError(f"more than {MAX_NODES} nodes")
        return parts

    def whole(self) -> tuple:
        out = self.ternary(0)
        if self.items[self.at][0] != "end":
            raise ExpressionError(f"unexpected {self.items[self.at][1]!r} at {self.items[self.at][2]}")
        return out

    def ternary(self, depth: int) -> tuple:
        if depth > MAX_DEPTH:
            raise ExpressionError(f"nested deeper than {MAX_DEPTH}")
        cond = self.binary(1, depth)
        if self.peek() != "?":
            return cond
        self.take("?")
        yes = self.ternary(depth + 1)
        self.take(":")
        return self.node("if", cond, yes, self.ternary(depth + 1))

    def binary(self, least: int, depth: int) -> tuple:
        left = self.unary(depth)
        while (op := self.peek()) and _BINARY.get(op, 0) >= least:
            self.take()
            left = self.node("binary", op, left, self.binary(_BINARY[op] + 1, depth))
        return left

    def unary(self, depth: int) -> tuple:
        if self.peek() in ("!", "-"):
            op = self.take()[1]
            return self.node("unary", op, self.unary(depth + 1))
        out = self.primary(depth)
        while self.peek() in (".", "["):
            if self.take()[1] == "[":
                out = self.node("index", out, self.ternary(depth + 1))
                self.take("]")
            else:
                name = self.take()[1]
                out = self.node("call", name, out, self.arguments(depth)) if self.peek() == "(" else self.node("member", out, name)
        return out

    def arguments(self, depth: int, close: str = ")") -> list[tuple]:
        self.take()
        out: list[tuple] = []
        while self.peek() != close:
            out.append(self.ternary(depth + 1))
            if self.peek() != close:
                self.take(",")
        self.take(close)
        return out

    def primary(self, depth: int) -> tuple:
        kind, value, at = self.items[self.at]
        if value == "(":
            self.take()
            out = self.ternary(depth + 1)
            self.take(")")
            return out
        if value == "[":
            return self.node("list", self.arguments(depth, "]"))
        if value == "{":
            self.take()
            pairs = []
            while self.peek() != "}":
                key = self.ternary(depth + 1)
                self.take(":")
                pairs.append((key, self.ternary(depth + 1)))
                if self.peek() != "}":
                    self.take(",")
            self.take("}")
            return self.node("map", pairs)
        self.take()
        if kind == "num":
            return self.node("literal", float(value) if "." in value else int(value.rstrip("u")))
        if kind == "str":
            return self.node("literal", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "id":
            if value in ("true", "false", "null"):
                return self.node("literal", {"true": True, "false": False, "null": None}[value])
            return self.node("call", value, None, self.arguments(depth)) if self.peek() == "(" else self.node("name", value)
        raise ExpressionError(f"unexpected {value!r} at {at}")


def _is_list(t: str) -> bool:
    return t.startswith("list<")


def _strftime(pattern: str) -> str:
    """A strftime pattern as the engine's own; what has no equivalent is refused."""
    known = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "f": "SSSSSS", "z": "xx", "b": "MMM", "B": "MMMM", "y": "yy", "j": "DDD", "I": "hh", "p": "a", "%": "%"}
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "%":
            i += 1
            if i >= len(pattern) or pattern[i] not in known:
                raise ExpressionError(f"no equivalent of %{pattern[i:i + 1]}")
            out += known[pattern[i]]
        else:
            out += f"'{c}'" if c.isalpha() else c
        i += 1
    return out


class _Compiler:
    def __init__(self, names: dict[str, Typed]) -> None:
        self.names = names

    def of(self, node: tuple) -> Typed:
        return getattr(self, "_" + node[0])(*node[1:])

    def _literal(self, v: object) -> Typed:
        kind = {bool: "bool", int: "int", float: "double", str: "string", type(None): "null"}[type(v)]
        return Typed(F.lit(v).cast("bigint") if kind == "int" else F.lit(v), kind)

    def _name(self, name: str) -> Typed:
        if name not in self.names:
            raise ExpressionError(f"unknown name {name}")
        return self.names[name]

    def _member(self, owner: tuple, name: str) -> Typed:
        o = self.of(owner)
        if o.type == "struct":
            if name not in (o.fields or {}):
                raise ExpressionError(f"no field {name}")
            return Typed(o.column.getField(name), o.fields[name])
        if o.type.startswith("map"):
            return Typed(F.element_at(o.column, name), o.type[4:-1] or "dyn")
        if o.type == "dyn":
            return Typed(F.try_variant_get(o.column, f"$.{name}", "variant"), "dyn")
        raise ExpressionError(f"{o.type} has no fields")

    def _index(self, owner: tuple, at: tuple) -> Typed:
        o, i = self.of(owner), self.of(at)
        if _is_list(o.type) and i.type == "int":
            return Typed(F.element_at(o.column, (i.column + 1).cast("int")), o.type[5:-1])
        if o.type.startswith("map") and i.type == "string":
            return Typed(F.element_at(o.column, i.column), o.type[4:-1] or "dyn")
        raise ExpressionError(f"{o.type} can't be indexed with {i.type}")

    def _list(self, items: list[tuple]) -> Typed:
        found = [self.of(x) for x in items]
        kinds = {x.type for x in found}
        if len(kinds) > 1:
            raise ExpressionError(f"a list of {sorted(kinds)}")
        return Typed(F.array(*[x.column for x in found]), f"list<{kinds.pop() if kinds else 'null'}>")

    def _map(self, pairs: list[tuple[tuple, tuple]]) -> Typed:
        found = [(self.of(k), self.of(v)) for k, v in pairs]
        kinds = {v.type for _, v in found}
        if any(k.type != "string" for k, _ in found) or len(kinds) > 1:
            raise ExpressionError("a map has text keys and values of one type")
        return Typed(F.create_map(*[x.column for p in found for x in p]), f"map<{kinds.pop() if kinds else 'null'}>")

    def _if(self, cond: tuple, yes: tuple, no: tuple) -> Typed:
        c, y, n = self.of(cond), self.of(yes), self.of(no)
        if c.type != "bool":
            raise ExpressionError("a condition must be bool")
        if y.type != n.type and "null" not in (y.type, n.type):
            raise ExpressionError(f"branches of {y.type} and {n.type}")
        return Typed(F.when(c.column, y.column).otherwise(n.column), y.type if y.type != "null" else n.type)

    def _unary(self, op: str, x: tuple) -> Typed:
        v = self.of(x)
        if op == "!" and v.type == "bool":
            return Typed(~v.column, "bool")
        if op == "-" and v.type in ("int", "double", "duration"):
            return Typed(-v.column, v.type)
        raise ExpressionError(f"{op}{v.type}")

    def _binary(self, op: str, left: tuple, right: tuple) -> Typed:
        a, b = self.of(left), self.of(right)
        x, y = a.column, b.column
        if op in ("&&", "||"):
            if (a.type, b.type) != ("bool", "bool"):
                raise ExpressionError(f"{a.type} {op} {b.type}")
            return Typed(x & y if op == "&&" else x | y, "bool")
        if op in ("==", "!="):
            if a.type != b.type and "null" not in (a.type, b.type):
                raise ExpressionError(f"{a.type} {op} {b.type}")
            same = x.eqNullSafe(y)
            return Typed(same if op == "==" else ~same, "bool")
        if op == "in":
            if _is_list(b.type):
                return Typed(F.array_contains(y, x), "bool")
            if b.type.startswith("map"):
                return Typed(F.map_contains_key(y, x), "bool")
            raise ExpressionError(f"in {b.type}")
        if op in ("<", "<=", ">", ">="):
            if a.type != b.type or a.type not in ("int", "double", "string", "timestamp", "duration", "bool"):
                raise ExpressionError(f"{a.type} {op} {b.type}")
            return Typed({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")
        if op == "+" and a.type == b.type == "string":
            return Typed(F.concat(x, y), "string")
        if op == "+" and _is_list(a.type) and a.type == b.type:
            return Typed(F.concat(x, y), a.type)
        if (a.type, b.type) in (("timestamp", "duration"), ("duration", "duration")) and op in "+-":
            return Typed(x + y if op == "+" else x - y, a.type)
        if op == "-" and a.type == b.type == "timestamp":
            return Typed(x - y, "duration")
        if a.type != b.type or a.type not in ("int", "double") or (op == "%" and a.type != "int"):
            raise ExpressionError(f"{a.type} {op} {b.type}")
        if op == "/":
            return Typed(F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("bigint")).otherwise((x - x % y) / y).cast("bigint") if a.type == "int" else x / y, a.type)
        return Typed({"+": x + y, "-": x - y, "*": x * y, "%": x % y}[op], a.type)

    def _call(self, name: str, owner: tuple | None, args: list[tuple]) -> Typed:
        if owner is None and name == "has":
            if len(args) != 1 or args[0][0] != "member":
                raise ExpressionError("has() takes a member")
            return Typed(self.of(args[0]).column.isNotNull(), "bool")
        if owner is not None and name in ("all", "exists", "map", "filter") and len(args) == 2 and args[0][0] == "name":
            return self._macro(name, owner, args[0][1], args[1])
        if owner is not None and owner[0] == "name" and owner[1] in ("lists", "time", "math") and owner[1] not in self.names:
            name, owner = f"{owner[1]}.{name}", None
        if name in ("time.parse", "time.format"):
            return self._time(name, args)
        given = [self.of(x) for x in ([owner] if owner else []) + args]
        for kinds, made in _FUNCTIONS.get(name, []):
            if len(kinds) == len(given) and all(k == "any" or g.type == k or (k == "list" and _is_list(g.type)) for k, g in zip(kinds, given)):
                return made(*given)
        raise ExpressionError(f"no function {name}({', '.join(g.type for g in given)})")

    def _time(self, name: str, args: list[tuple]) -> Typed:
        """Patterns and zones are literals; an offset in the text wins over the zone, text that does not fit is an error."""
        if len(args) not in (2, 3) or any(a[0] != "literal" or not isinstance(a[1], str) for a in args[1:]):
            raise ExpressionError(f"{name}(value, 'pattern'[, 'zone'])")
        value, pattern, zone = self.of(args[0]), _strftime(args[1][1]), args[2][1] if len(args) == 3 else None
        if value.type != ("string" if name == "time.parse" else "timestamp"):
            raise ExpressionError(f"{name} of {value.type}")
        if name == "time.format":
            at = value.column.cast("timestamp")
            return Typed(F.date_format(F.from_utc_timestamp(at, zone) if zone else at, pattern), "string")
        read = F.to_timestamp(value.column, pattern)
        return Typed(F.to_utc_timestamp(read, zone) if zone and "x" not in pattern else read, "timestamp")

    def _macro(self, name: str, owner: tuple, var: str, body: tuple) -> Typed:
        o = self.of(owner)
        if not _is_list(o.type):
            raise ExpressionError(f"{name} over {o.type}")
        inner = o.type[5:-1]
        kinds: list[str] = []

        def run(x: Column) -> Column:
            made = _Compiler(self.names | {var: Typed(x, inner, (o.fields if inner == "struct" else None))}).of(body)
            kinds.append(made.type)
            return made.column

        column = {"all": F.forall, "exists": F.exists, "map": F.transform, "filter": F.filter}[name](o.column, run)
        if name != "map" and kinds[-1] != "bool":
            raise ExpressionError(f"{name} needs a bool")
        return Typed(column, {"all": "bool", "exists": "bool", "map": f"list<{kinds[-1]}>", "filter": o.type}[name])


def checked_slice(xs: Column, low: Column, high: Column) -> Column:
    """Items low (from 0) to high (not included); out of bounds is an error."""
    fine = (low >= 0) & (low <= high) & (high <= F.size(xs))
    return F.when(fine, F.slice(xs, (low + 1).cast("int"), (high - low).cast("int"))).otherwise(F.raise_error(F.lit("slice out of range")))


def range_list(n: Column) -> Column:
    """0 to n - 1; n below 0 or above a million is an error."""
    fine = (n >= 0) & (n <= 1_000_000)
    some = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.when(fine, some).otherwise(F.raise_error(F.lit("range out of bounds")))


def list_sum(xs: Column, kind: str) -> Column:
    zero = {"int": F.lit(0).cast("bigint"), "double": F.lit(0.0), "duration": F.expr("INTERVAL '0' SECOND")}[kind]
    return F.aggregate(xs, zero.cast("interval day to second") if kind == "duration" else zero, lambda a, x: a + x)


def _sum(xs: Typed) -> Typed:
    inner = xs.type[5:-1]
    if inner not in ("int", "double", "duration"):
        raise ExpressionError(f"sum of {xs.type}")
    return Typed(list_sum(xs.column, inner), inner)


def _one(kind: str, f: Callable[..., Column]) -> Callable[..., Typed]:
    return lambda *xs: Typed(f(*[x.column for x in xs]), kind)


_S, _I, _D, _T = "string", "int", "double", "timestamp"
_FUNCTIONS: dict[str, list[tuple[list[str], Callable[..., Typed]]]] = {
    "size": [([_S], _one(_I, lambda s: F.char_length(s).cast("bigint"))), (["list"], _one(_I, lambda x: F.size(x).cast("bigint")))],
    "contains": [([_S, _S], _one("bool", lambda s, t: s.contains(t)))],
    "startsWith": [([_S, _S], _one("bool", lambda s, t: s.startswith(t)))],
    "endsWith": [([_S, _S], _one("bool", lambda s, t: s.endswith(t)))],
    "matches": [([_S, _S], _one("bool", lambda s, p: F.rlike(s, p)))],
    "lowerAscii": [([_S], _one(_S, F.lower))],
    "upperAscii": [([_S], _one(_S, F.upper))],
    "trim": [([_S], _one(_S, F.trim))],
    "replace": [([_S, _S, _S], _one(_S, F.replace))],
    "split": [([_S, _S], lambda s, d: Typed(F.split(s.column, F.concat(F.lit("\\Q"), d.column, F.lit("\\E"))), "list<string>"))],
    "join": [(["list", _S], _one(_S, lambda x, d: F.aggregate(x, F.lit(None).cast("string"), lambda a, y: F.when(a.isNull(), y).otherwise(F.concat(a, d, y)))))],
    "int": [([k], _one(_I, lambda x: x.cast("bigint"))) for k in (_S, _I, _D)] + [([_T], _one(_I, lambda x: F.unix_timestamp(x)))],
    "double": [([k], _one(_D, lambda x: x.cast("double"))) for k in (_S, _I, _D)],
    "string": [([k], _one(_S, lambda x: x.cast("string"))) for k in (_S, _I, _D, "bool")],
    "timestamp": [([_S], _one(_T, lambda x: F.to_timestamp(x)))],
    "getFullYear": [([_T], _one(_I, lambda x: F.year(x).cast("bigint")))],
    "getMonth": [([_T], _one(_I, lambda x: (F.month(x) - 1).cast("bigint")))],
    "getHours": [([_T], _one(_I, lambda x: F.hour(x).cast("bigint")))],
    "math.round": [([_D], _one(_D, lambda x: F.round(x)))],
    "math.greatest": [([k, k], _one(k, F.greatest)) for k in (_I, _D)],
    "math.least": [([k, k], _one(k, F.least)) for k in (_I, _D)],
    "lists.flatten": [(["list"], lambda x: Typed(F.flatten(x.column), x.type[5:-1]))],
    "lists.slice": [(["list", _I, _I], lambda x, a, b: Typed(checked_slice(x.column, a.column, b.column), x.type))],
    "lists.range": [([_I], _one("list<int>", range_list))],
    "lists.sum": [(["list"], _sum)],
    "lists.distinct": [(["list"], lambda x: Typed(F.array_distinct(x.column), x.type))],
}


def compile_expression(text: str, names: dict[str, Typed], wanted: str | None = None) -> Typed:
    """The column of an expression over `names`; refused unless it has the type `wanted`."""
    made = _Compiler(names).of(_Parser(text).whole())
    if wanted and made.type not in (wanted, "dyn"):
        raise ExpressionError(f"{wanted} wanted, found {made.type}")
    return made


_TYPES = {"string": "string", "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "double", "float": "double", "boolean": "bool", "timestamp": "timestamp", "timestamp_ntz": "timestamp", "variant": "dyn"}


def row_names(columns: list[tuple[str, str]], prefix: Column | None = None) -> dict[str, Typed]:
    """The names that a row of a DataFrame gives an expression, from its `dtypes`."""
    out = {}
    for name, kind in columns:
        c = prefix.getField(name) if prefix is not None else F.col(name)
        t = _TYPES.get(kind) or (f"list<{_TYPES.get(kind[6:-1], 'dyn')}>" if kind.startswith("array<") else "struct" if kind.startswith("struct") else None)
        if t:
            out[name] = Typed(c.cast("bigint") if t == "int" else c.cast("double") if t == "double" else c, t)
    return out


def template(text: str, names: dict[str, Typed]) -> Column:
    """A text with {{ expression }} slots; a template that is one slot keeps its type."""
    parts = re.split(r"\{\{(.*?)\}\}", text)
    if len(parts) == 3 and not parts[0] and not parts[2]:
        return compile_expression(parts[1], names).column
    made = [F.lit(p) if i % 2 == 0 else F.coalesce(compile_expression(p, names).column.cast("string"), F.lit("")) for i, p in enumerate(parts)]
    return F.concat(*made)


_PATH = re.compile(r"\.(\w+)|\[(\*|-?\d+(?:\s*,\s*-?\d+)*|-?\d*:-?\d*)\]|\.(\*)")


def json_path(column: Column, path: str) -> Column:
    """The part of JSON text that a path of names, indices (also from the end), slices, lists of indices and * selects.

    Nothing gives null, one value its JSON, many a JSON list. Descent (..), filters and steps are refused.
    """
    if not path.startswith("$"):
        raise ExpressionError("a path starts with $")
    at = 1
    value = F.array(F.try_parse_json(column))
    while at < len(path):
        m = _PATH.match(path, at)
        if not m:
            raise ExpressionError(f"unexpected {path[at:]!r}")
        at = m.end()
        step = m[1] or m[2] or m[3]
        if m[1]:
            value = _members(value, step)
            continue
        lists = F.transform(value, lambda v: F.try_variant_get(v, "$", "array<variant>"))
        value = F.flatten(F.transform(lists, _picker(step)))
        value = F.filter(value, lambda v: v.isNotNull())
    value = F.filter(value, lambda v: v.isNotNull())
    texts = F.transform(value, lambda v: F.to_json(v))
    whole = F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
    return F.when(F.size(value) == 0, F.lit(None)).when(F.size(value) == 1, texts[0]).otherwise(whole)


def _members(value: Column, step: str) -> Column:
    return F.filter(F.transform(value, lambda v: F.try_variant_get(v, f"$.{step}", "variant")), lambda v: v.isNotNull())


def _picker(step: str) -> Callable[[Column], Column]:
    def at(xs: Column, i: int) -> Column:
        return F.get(xs, F.lit(i)) if i >= 0 else F.get(xs, F.size(xs) + i)

    def pick(xs: Column) -> Column:
        none = F.array().cast("array<variant>")
        if step == "*":
            return F.coalesce(xs, none)
        if ":" in step:
            low, high = (s.strip() for s in step.split(":"))
            size = F.size(xs)
            a = F.lit(0) if not low else F.greatest(F.lit(0), F.lit(int(low)) if int(low) >= 0 else size + int(low))
            b = size if not high else F.least(size, F.lit(int(high))) if int(high) >= 0 else size + int(high)
            return F.coalesce(F.when(b > a, F.slice(xs, a + 1, F.greatest(F.lit(0), b - a))), none)
        return F.coalesce(F.array(*[at(xs, int(i)) for i in step.split(",")]), none)

    return pick
