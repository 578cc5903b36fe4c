"""The WHERE language: comparisons, IN, AND, OR and parentheses over one layer's columns.

Text becomes tokens, tokens a tree, the tree bound to a schema a Column. Logic has two values: a null
satisfies `!=` and nothing else, and comparing a string with a number (or the reverse) is false, for
`!=` true for nulls alone. Columns are written so that Parquet sees the comparison: no coalesce, and
no cast where a rewritten literal says the same.

IS [NOT] NULL and LIKE (case-sensitive, % and _) extend the language.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnfield.errors import Code, EngineError, WhereError
from cairnfield.functions.dates import OLE_EPOCH, ole_double

MAX_BYTES = 64 * 1024
#: Up to here doubles hold every integer.
EXACT = 1 << 53
OPERATORS = ("!=", "<=", ">=", "=", "<", ">")

_TOKEN = re.compile(
    r"""\s*(?:
      (?P<string>'(?:[^']|'')*')
    | (?P<number>[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)
    | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
    | (?P<op>!=|<=|>=|=|<|>)
    | (?P<mark>[(),])
    )""",
    re.VERBOSE | re.ASCII,
)


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: str | float


@dataclass(frozen=True)
class Within:
    field: str
    values: tuple[str | float, ...]


@dataclass(frozen=True)
class IsNull:
    field: str
    negated: bool


@dataclass(frozen=True)
class Like:
    field: str
    pattern: str


@dataclass(frozen=True)
class Both:
    """AND (every) or OR (not every) of its parts."""

    every: bool
    parts: tuple[Node, ...]


Node = Compare | Within | IsNull | Like | Both
_KEYWORDS = {"AND", "OR", "IN", "IS", "NOT", "NULL", "LIKE"}


def tokenize(text: str) -> list[tuple[str, str | float]]:
    """(kind, value): string, number, word, keyword, op or mark."""
    out: list[tuple[str, str | float]] = []
    at, end = 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise WhereError("unsupported where clause")
        kind = m.lastgroup or ""
        raw = m[kind]
        if kind == "string":
            out.append((kind, raw[1:-1].replace("''", "'")))
        elif kind == "number":
            value = float(raw)
            if not math.isfinite(value) or text[m.end() : m.end() + 1].isalnum() or text[m.end() : m.end() + 1] in ("_", "."):
                raise WhereError("unsupported where clause")
            out.append((kind, value))
        elif kind == "word" and raw.upper() in _KEYWORDS:
            out.append(("keyword", raw.upper()))
        else:
            out.append((kind, raw))
        at = m.end()
    return out


class _Parser:
    """AND binds tighter than OR."""

    def __init__(self, text: str):
        self._tokens, self._at = tokenize(text), 0

    def _peek(self) -> tuple[str, str | float]:
        return self._tokens[self._at] if self._at < len(self._tokens) else ("end", "")

    def _next(self, kind: str | None = None, value: str | None = None) -> str | float:
        found = self._peek()
        if kind and found[0] != kind or value is not None and found[1] != value or found[0] == "end":
            raise WhereError("unsupported where clause")
        self._at += 1
        return found[1]

    def _accept(self, kind: str, value: str) -> bool:
        if self._peek() == (kind, value):
            self._at += 1
            return True
        return False

    def whole(self) -> Node:
        node = self._chain(False)
        if self._peek()[0] != "end":
            raise WhereError("unsupported where clause")
        return node

    def _chain(self, every: bool) -> Node:
        below = self._primary if every else lambda: self._chain(True)
        parts = [below()]
        while self._accept("keyword", "AND" if every else "OR"):
            parts.append(below())
        return parts[0] if len(parts) == 1 else Both(every, tuple(parts))

    def _primary(self) -> Node:
        if self._accept("mark", "("):
            node = self._chain(False)
            self._next("mark", ")")
            return node
        field = str(self._next("word"))
        if self._accept("keyword", "IN"):
            self._next("mark", "(")
            values = [self._literal()]
            while self._accept("mark", ","):
                values.append(self._literal())
            self._next("mark", ")")
            return Within(field, tuple(values))
        if self._accept("keyword", "IS"):
            negated = self._accept("keyword", "NOT")
            self._next("keyword", "NULL")
            return IsNull(field, negated)
        if self._accept("keyword", "LIKE"):
            return Like(field, str(self._next("string")))
        return Compare(field, str(self._next("op")), self._literal())

    def _literal(self) -> str | float:
        kind = self._peek()[0]
        if kind not in ("string", "number"):
            raise WhereError("unsupported where clause")
        return self._next()


def parse(text: str) -> Node:
    if not text.strip():
        raise WhereError("empty where clause")
    if len(text.encode()) > MAX_BYTES:
        raise EngineError(Code.INVALID_REQUEST, "where clause is too long")
    return _Parser(text).whole()


def fields_of(node: Node) -> set[str]:
    if isinstance(node, Both):
        return set().union(*(fields_of(p) for p in node.parts))
    return {node.field}


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


class BoundWhere:
    """A tree bound to a schema: names are found whatever their ASCII case, the first of equal names wins."""

    def __init__(self, text: str, schema: T.StructType):
        self.node = parse(text)
        self._fields: dict[str, T.StructField] = {}
        for field in schema.fields:
            self._fields.setdefault(_ascii_lower(field.name), field)
        for name in fields_of(self.node):
            if _ascii_lower(name) not in self._fields:
                raise WhereError("unknown field in where clause")
        self.references = sorted({self._fields[_ascii_lower(n)].name for n in fields_of(self.node)})

    @property
    def single_comparison(self) -> bool:
        return isinstance(self.node, Compare)

    def column(self) -> Column:
        return self._column(self.node)

    def _column(self, node: Node) -> Column:
        if isinstance(node, Both):
            out = self._column(node.parts[0])
            for part in node.parts[1:]:
                out = out & self._column(part) if node.every else out | self._column(part)
            return out
        field = self._fields[_ascii_lower(node.field)]
        col = F.col(f"`{field.name}`")
        if isinstance(node, IsNull):
            return col.isNotNull() if node.negated else col.isNull()
        if isinstance(node, Like):
            return col.like(node.pattern.replace("\\", "\\\\")) if isinstance(field.dataType, T.StringType) else F.lit(False)
        if isinstance(node, Within):
            out = comparison(col, field.dataType, "=", node.values[0])
            for value in node.values[1:]:
                out = out | comparison(col, field.dataType, "=", value)
            return out
        return comparison(col, field.dataType, node.op, node.value)


def _ascii_lower(name: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name)


def _apply(left: Column, op: str, right: Column) -> Column:
    return {"=": left.__eq__, "<": left.__lt__, "<=": left.__le__, ">": left.__gt__, ">=": left.__ge__}[op](right) if op != "!=" else left != right


def _or_null(col: Column, found: Column, op: str) -> Column:
    return col.isNull() | found if op == "!=" else found


def comparison(col: Column, kind: T.DataType, op: str, value: str | float) -> Column:
    """One leaf as a Column that is true exactly where the leaf is."""
    nothing = col.isNull() if op == "!=" else F.lit(False)
    if isinstance(kind, T.StringType):
        return _or_null(col, _apply(col, op, F.lit(value)), op) if isinstance(value, str) else nothing
    if isinstance(value, str):
        return nothing
    if isinstance(kind, _INTEGRAL):
        return _or_null(col, _integral(col, kind, op, value), op)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        found = _apply(col, op, F.lit(float(value))) if isinstance(kind, T.DoubleType) else _apply(col.cast("double"), op, F.lit(float(value)))
        # Spark puts NaN above all numbers
        return _or_null(col, found & ~F.isnan(col) if op in (">", ">=") else found, op)
    if isinstance(kind, T.DecimalType):
        return _or_null(col, _apply(col.cast("double"), op, F.lit(float(value))), op)
    if isinstance(kind, _DATES):
        return _or_null(col, _dated(col, kind, op, value), op)
    if isinstance(kind, T.StructType) and "ts" in kind.names:  # date-time with offset: the offset does not count
        return _or_null(col, _dated(col["ts"], kind["ts"].dataType, op, value), op)
    if isinstance(kind, T.StructType) and "ole" in kind.names:
        return _or_null(col, comparison(col["ole"], kind["ole"].dataType, op, value), op)
    return nothing


_BOUNDS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def _integral(col: Column, kind: T.DataType, op: str, value: float) -> Column:
    """Compares as doubles do; literals are rounded to integers, so that the scan gets the comparison."""
    if abs(value) >= EXACT:
        return _apply(col.cast("double"), op, F.lit(value))
    if value != math.floor(value):
        if op in ("=", "!="):
            return F.lit(False) if op == "=" else col.isNotNull()
        op, value = (">=", math.floor(value) + 1) if op in (">", ">=") else ("<=", math.floor(value))
    limit = 1 << _BOUNDS[type(kind)]
    if not -limit <= value < limit:  # no value of the column gets there
        above = value > 0
        always = op == "!=" or (op in ("<", "<=") if above else op in (">", ">="))
        return col.isNotNull() if always else F.lit(False)
    return _apply(col, op, F.lit(int(value)).cast(kind))


def _dated(col: Column, kind: T.DataType, op: str, value: float) -> Column:
    """Days since the epoch of OLE dates; whole days become a date of the column's own type."""
    if value == math.floor(value) and abs(value) < 2_900_000 and OLE_EPOCH.toordinal() + value >= 1:
        day = OLE_EPOCH + dt.timedelta(days=int(value))
        if isinstance(kind, T.DateType):
            return _apply(col, op, F.lit(day))
        moment = dt.datetime(day.year, day.month, day.day)
        if isinstance(kind, T.TimestampNTZType):
            return _apply(col, op, F.lit(moment).cast("timestamp_ntz"))
        return _apply(col, op, F.lit(moment.replace(tzinfo=dt.timezone.utc)))
    return _apply(ole_double(col, kind), op, F.lit(value))


def evaluate(node: Node, row: dict[str, object], kinds: dict[str, str]) -> bool:
    """The same language over one Python row; kinds: numeric, string or other for each lower-case name. Tests hold Columns against it."""
    if isinstance(node, Both):
        found = [evaluate(p, row, kinds) for p in node.parts]
        return all(found) if node.every else any(found)
    name = _ascii_lower(node.field)
    held, kind = row[name], kinds[name]
    if isinstance(node, IsNull):
        return (held is None) != node.negated
    if isinstance(node, Like):
        pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in node.pattern)
        return kind == "string" and held is not None and re.fullmatch(pattern, str(held), re.DOTALL) is not None
    if isinstance(node, Within):
        return any(evaluate(Compare(node.field, "=", v), row, kinds) for v in node.values)
    if held is None:
        return node.op == "!="
    if kind == "other" or (kind == "string") != isinstance(node.value, str):
        return False
    a, b = (str(held).encode(), str(node.value).encode()) if kind == "string" else (float(held), float(node.value))  # type: ignore[arg-type]
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[node.op]
