"""From the dialect's trees to Spark SQL text over a schema, with the dialect's own rules where Spark's differ.

Stricter than wrap-around: integer overflow raises. A zero divisor of a float counts as positive.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import json_path
from brindle.functions.dialect import DialectError, Node, Unsupported, parse

_INT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOAT = (T.FloatType, T.DoubleType)
_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
LONG, DOUBLE, STRING, BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
#: Type names of casts.
_TYPES = {
    "int8": T.ByteType(), "tinyint": T.ByteType(), "int16": T.ShortType(), "smallint": T.ShortType(), "int": T.IntegerType(), "int32": T.IntegerType(), "integer": T.IntegerType(),
    "int64": LONG, "bigint": LONG, "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": LONG, "uint64": T.DecimalType(20, 0),
    "float": T.FloatType(), "float32": T.FloatType(), "real": T.FloatType(), "double": DOUBLE, "float64": DOUBLE, "string": STRING, "utf8": STRING, "largeutf8": STRING, "text": STRING,
    "varchar": STRING, "bool": BOOL, "boolean": BOOL, "binary": T.BinaryType(), "bytea": T.BinaryType(), "date": T.DateType(), "date32": T.DateType(), "timestamp": T.TimestampType(),
}


def data_type(name: str) -> T.DataType:
    base, _, size = name.lower().partition("(")
    if base in ("decimal", "numeric", "decimal128"):
        p, _, s = size.rstrip(")").partition(",")
        return T.DecimalType(int(p or 38), int(s or 10 if not p else s or 0))
    if base not in _TYPES:
        raise Unsupported(f"type {name!r} is not supported")
    return _TYPES[base]


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def resolve(name: str, names: list[str]) -> str:
    """The column meant: exactly so named, or the only one but for case."""
    if name in names:
        return name
    alike = [n for n in names if n.lower() == name.lower()]
    if len(alike) == 1:
        return alike[0]
    raise DialectError(f"No field named {name}." if not alike else f"field name {name} is ambiguous: {alike}")


def _kind(t: T.DataType) -> str:
    if isinstance(t, (*_INT, *_FLOAT, T.DecimalType)):
        return "number"
    if isinstance(t, _TIME):
        return "time"
    return type(t).__name__


def like_pattern(pattern: str) -> str:
    """The pattern with a backslash only where Spark takes one: before %, _ and itself."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            k += 1
            out += ("\\" if pattern[k] in "%_\\" else "") + pattern[k]
        else:
            out += "\\\\" if c == "\\" else c
        k += 1
    return out


class Emitter:
    def __init__(self, schema: T.StructType, strict: bool = True):
        self.schema, self.strict = schema, strict

    def __call__(self, node: Node) -> tuple[str, T.DataType]:
        return getattr(self, "_" + {"=": "compare", "<>": "compare", "<": "compare", "<=": "compare", ">": "compare", ">=": "compare", "+": "arithmetic", "-": "arithmetic", "*": "arithmetic", "/": "arithmetic", "%": "arithmetic", "||": "concat", "and": "logic", "or": "logic", "like": "like", "ilike": "like"}.get(node.op, "is" if node.op.startswith("is_") else node.op))(node)

    def _column(self, node: Node):
        name = resolve(str(node.value), self.schema.fieldNames())
        return quote(name), self.schema[name].dataType

    def _field(self, node: Node):
        text, t = self(node.args[0])
        if not isinstance(t, T.StructType):
            raise DialectError(f"{text} has no field {node.value!r}")
        name = resolve(str(node.value), t.fieldNames())
        return f"{text}.{quote(name)}", t[name].dataType

    def _index(self, node: Node):
        (a, t), (b, i) = map(self, node.args)
        if not isinstance(t, T.ArrayType) or not isinstance(i, _INT):
            raise DialectError(f"{a} can't be indexed by {b}")
        return f"try_element_at({a}, nullif(cast({b} AS int), 0))", t.elementType

    def _literal(self, node: Node):
        v = node.value
        if v is None:
            return "NULL", T.NullType()
        if isinstance(v, bool):
            return str(v).lower(), BOOL
        if isinstance(v, int):
            if v >= 2**64:
                raise DialectError(f"{v} is too large")
            return (f"{v}L", LONG) if v < 2**63 else (f"cast('{v}' AS decimal(20,0))", T.DecimalType(20, 0))
        if isinstance(v, float):
            return f"cast('{v!r}' AS double)", DOUBLE
        if isinstance(v, bytes):
            return f"X'{v.hex()}'", T.BinaryType()
        return text_literal(str(v)), STRING

    def _date(self, node: Node):
        return f"cast({text_literal(node.value)} AS date)", T.DateType()

    def _timestamp(self, node: Node):
        return f"cast({text_literal(node.value)} AS timestamp)", T.TimestampType()

    def _list(self, node: Node):
        parts = [self(a) for a in node.args]
        inner = next((t for _, t in parts if not isinstance(t, T.NullType)), T.NullType())
        return f"array({', '.join(x for x, _ in parts)})", T.ArrayType(inner)

    def _logic(self, node: Node):
        parts = [self(a) for a in node.args]
        for x, t in parts:
            if not isinstance(t, (T.BooleanType, T.NullType)):
                raise DialectError(f"{x} isn't a condition")
        return f"({parts[0][0]} {node.op.upper()} {parts[1][0]})", BOOL

    def _not(self, node: Node):
        text, t = self(node.args[0])
        if not isinstance(t, (T.BooleanType, T.NullType)):
            raise DialectError(f"{text} isn't a condition")
        return f"(NOT {text})", BOOL

    def _is(self, node: Node):
        text, _ = self(node.args[0])
        return f"({text} {node.op.replace('_', ' ').upper()})", BOOL

    def _pair(self, left: Node, right: Node) -> tuple[str, str]:
        """Both sides of a comparison, literals fitted to the other side's type."""
        (a, s), (b, t) = self(left), self(right)
        for one, other, node, flip in ((s, t, right, False), (t, s, left, True)):
            lit = node.op == "literal" or node.op == "negate" and node.args[0].op == "literal"
            text = a if flip else b
            if isinstance(one, _TIME) and isinstance(other, T.StringType) and lit:
                text = f"cast({text} AS {one.simpleString()})"
            elif isinstance(one, T.FloatType) and lit and _kind(other) == "number":
                text = f"cast({text} AS float)"
            elif isinstance(one, T.DecimalType) and lit and isinstance(other, T.DoubleType):
                raise DialectError("a decimal can't be compared with a float literal")
            elif isinstance(one, T.BinaryType) and isinstance(other, T.StringType) and lit:
                text = f"cast({text} AS binary)"
            else:
                continue
            return (text, b) if flip else (a, text)
        ks, kt = _kind(s), _kind(t)
        if ks != kt and "NullType" not in (ks, kt):
            raise DialectError(f"{a} and {b} can't be compared: {s.simpleString()} and {t.simpleString()}")
        return a, b

    def _compare(self, node: Node):
        a, b = self._pair(*node.args)
        return f"({a} {node.op} {b})", BOOL

    def _in(self, node: Node):
        value, *items = node.args
        a, _ = self(value)
        if not items:
            return f"(CASE WHEN {a} IS NULL THEN NULL ELSE false END)", BOOL
        texts = [self._pair(value, x)[1] for x in items]
        return f"({a} IN ({', '.join(texts)}))", BOOL

    def _between(self, node: Node):
        x, low, high = node.args
        a, lo = self._pair(x, low)
        _, hi = self._pair(x, high)
        body = f"({a} BETWEEN {lo} AND {hi})"
        open_ends = [t for t, n in ((lo, low), (hi, high)) if n.op != "literal" or n.value is None]
        if not open_ends:
            return body, BOOL
        return f"(CASE WHEN {' OR '.join(f'{t} IS NULL' for t in open_ends)} THEN NULL ELSE {body} END)", BOOL

    def _like(self, node: Node):
        (a, s), (b, t) = map(self, node.args)
        for x, k in ((a, s), (b, t)):
            if not isinstance(k, (T.StringType, T.NullType)):
                raise DialectError(f"{x} isn't text")
        right = node.args[1]
        if right.op == "literal" and isinstance(right.value, str):
            b = text_literal(like_pattern(right.value))
        return f"({a} {node.op.upper()} {b})", BOOL

    def _concat(self, node: Node):
        return "concat(" + ", ".join(x if isinstance(t, T.StringType) else f"cast({x} AS string)" for x, t in map(self, node.args)) + ")", STRING

    def _negate(self, node: Node):
        text, t = self(node.args[0])
        if _kind(t) not in ("number", "NullType", "DayTimeIntervalType"):
            raise DialectError(f"{text} has no negative")
        return (f"(- cast({text} AS bigint))", LONG) if isinstance(t, _INT) else (f"(- {text})", t)

    def _arithmetic(self, node: Node):
        (a, s), (b, t) = map(self, node.args)
        op = node.op
        spans = (T.DayTimeIntervalType,)
        if isinstance(s, _TIME) or isinstance(t, _TIME):
            if op == "-" and isinstance(s, T.DateType) and isinstance(t, T.DateType):
                return f"cast(datediff({a}, {b}) AS bigint)", LONG
            if op == "-" and type(s) is type(t):
                return f"({a} - {b})", T.DayTimeIntervalType()
            if op in "+-" and not isinstance(s, T.DateType) and isinstance(t, spans):
                return f"({a} {op} {b})", s
            raise Unsupported(f"{s.simpleString()} {op} {t.simpleString()} is not supported")
        if isinstance(s, spans) and isinstance(t, spans) and op in "+-":
            return f"({a} {op} {b})", s
        for x, k in ((a, s), (b, t)):
            if _kind(k) not in ("number", "NullType"):
                raise DialectError(f"{x} isn't a number")
        if isinstance(s, T.DecimalType) or isinstance(t, T.DecimalType):
            if not (isinstance(s, _FLOAT) or isinstance(t, _FLOAT)):
                return self._decimal(op, a, s, b, t)
        if isinstance(s, (*_INT, T.NullType)) and isinstance(t, (*_INT, T.NullType)):
            a, b = f"cast({a} AS bigint)", f"cast({b} AS bigint)"
            return f"({a} {'div' if op == '/' else op} {b})", LONG
        a, b = f"cast({a} AS double)", f"cast({b} AS double)"
        if op == "/":
            zero = f"CASE WHEN {a} > 0 AND NOT isnan({a}) THEN double('Infinity') WHEN {a} < 0 THEN double('-Infinity') WHEN {a} IS NOT NULL THEN double('NaN') END"
            return f"(CASE WHEN {b} = 0 THEN {zero} ELSE {a} / {b} END)", DOUBLE
        if op == "%":
            return f"(CASE WHEN {b} = 0 AND {a} IS NOT NULL THEN double('NaN') ELSE {a} % {b} END)", DOUBLE
        return f"({a} {op} {b})", DOUBLE

    def _decimal(self, op: str, a: str, s: T.DataType, b: str, t: T.DataType):
        as_decimal = lambda k: (k.precision, k.scale) if isinstance(k, T.DecimalType) else (20, 0)
        (p1, s1), (p2, s2) = as_decimal(s), as_decimal(t)
        if op in "+-":
            scale = max(s1, s2)
            kind = T.DecimalType(min(38, max(p1 - s1, p2 - s2) + scale + 1), scale)
        elif op == "*":
            kind = T.DecimalType(min(38, p1 + p2 + 1), min(38, s1 + s2))
        elif op == "/":
            scale = min(38, max(6, s1 + p2 + 1))
            kind = T.DecimalType(min(38, p1 - s1 + s2 + scale), scale)
        else:
            kind = T.DecimalType(min(38, min(p1 - s1, p2 - s2) + max(s1, s2)), max(s1, s2))
        a, b = (x if isinstance(k, T.DecimalType) else f"cast({x} AS decimal(20,0))" for x, k in ((a, s), (b, t)))
        return f"cast({a} {op} {b} AS {kind.simpleString()})", kind

    def _cast(self, node: Node):
        text, t = self(node.args[0])
        to = data_type(str(node.value))
        if isinstance(to, T.BooleanType) and _kind(t) == "number":
            return f"({text} <> 0)", BOOL
        return f"cast({text} AS {to.simpleString()})", to

    def _call(self, node: Node):
        name, args = str(node.value), node.args
        if name not in FUNCTIONS:
            if self.strict:
                raise Unsupported(f"function '{name}' is not supported in this dialect")
            return f"{name}({', '.join(self(a)[0] for a in args)})", STRING
        least, most, emit = FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise DialectError(f"{name} takes {least} to {most} arguments, not {len(args)}")
        return emit(self, args, name)


def _text(made: str, kind: T.DataType, types: tuple = (T.StringType,)):
    def emit(e: Emitter, args: list[Node], name: str):
        parts = [e(a) for a in args]
        for x, t in parts:
            if not isinstance(t, (*types, T.NullType)):
                raise DialectError(f"{name}: {x} isn't text")
        return made.format(*(x for x, _ in parts)), kind

    return emit


def _abs(e: Emitter, args, name):
    x, t = e(args[0])
    if _kind(t) not in ("number", "NullType"):
        raise DialectError(f"abs: {x} isn't a number")
    return (f"abs(cast({x} AS bigint))", LONG) if isinstance(t, _INT) else (f"abs({x})", t)


def _coalesce(e: Emitter, args, name):
    parts = [e(a) for a in args]
    types = [t for _, t in parts if not isinstance(t, T.NullType)]
    if any(_kind(t) != _kind(types[0]) for t in types):
        raise DialectError("coalesce takes values of one type")
    t = types[0] if types else T.NullType()
    wide = DOUBLE if any(isinstance(x, _FLOAT) for x in types) else LONG if types and all(isinstance(x, _INT) for x in types) and len({type(x) for x in types}) > 1 else t
    return f"coalesce({', '.join(x for x, _ in parts)})", wide


def _regexp(e: Emitter, args, name):
    a, _ = e(args[0])
    if args[1].op != "literal" or not isinstance(args[1].value, str):
        raise Unsupported(f"{name} takes a pattern in quotes")
    flags = args[2].value if len(args) > 2 else ""
    if flags not in ("", "i"):
        raise Unsupported(f"{name}: only the flag 'i' is supported")
    pattern = ("(?iu)" if flags else "") + "(?U)" + re.sub(r"\[:(\w+):\]", lambda m: rf"\p{{{m[1].capitalize()}}}" if m[1] != "word" else r"\w", args[1].value)
    return f"({a} RLIKE {text_literal(pattern)})", BOOL


def _array(kind: str):
    def emit(e: Emitter, args, name):
        (a, t), (b, s) = map(e, args)
        if not isinstance(t, (T.ArrayType, T.NullType)):
            raise DialectError(f"{name}: {a} isn't a list")
        if kind == "one":
            return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE coalesce(array_contains({a}, {b}), false) END)", BOOL
        if not isinstance(s, (T.ArrayType, T.NullType)):
            raise DialectError(f"{name}: {b} isn't a list")
        if args[1].op == "list" and not args[1].args:
            return ("true", BOOL) if kind == "all" else (f"(CASE WHEN {a} IS NULL THEN NULL ELSE false END)", BOOL)
        own = f"filter({b}, v -> v IS NOT NULL)"
        body = f"coalesce(arrays_overlap(filter({a}, v -> v IS NOT NULL), {own}), false)" if kind == "any" else f"size(array_except({b}, filter({a}, v -> v IS NOT NULL))) = 0"
        return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE {body} END)", BOOL

    return emit


def _json(e: Emitter, args, name):
    parts = [e(a) for a in args]
    keys = [a.value if a.op == "literal" else None for a in args[1:]]
    return json_path.sql(name, [x for x, _ in parts], keys), json_path.RESULT[name]


#: Name -> least and most arguments, and how to write it.
FUNCTIONS = {
    "lower": (1, 1, _text("lower({0})", STRING)), "upper": (1, 1, _text("upper({0})", STRING)),
    **{n: (1, 1, _text("cast(char_length({0}) AS bigint)", LONG)) for n in ("length", "char_length", "character_length")},
    "starts_with": (2, 2, _text("startswith({0}, {1})", BOOL)), "ends_with": (2, 2, _text("endswith({0}, {1})", BOOL)), "contains": (2, 2, _text("contains({0}, {1})", BOOL)),
    "abs": (1, 1, _abs), "coalesce": (1, 64, _coalesce),
    "is_null": (1, 1, lambda e, a, n: (f"({e(a[0])[0]} IS NULL)", BOOL)), "is_valid": (1, 1, lambda e, a, n: (f"({e(a[0])[0]} IS NOT NULL)", BOOL)),
    "invert": (1, 1, lambda e, a, n: e._not(Node("not", a))),
    "regexp_like": (2, 3, _regexp), "regexp_match": (2, 3, _regexp),
    **{n: (2, 2, _array("one")) for n in ("array_has", "array_contains", "list_has", "list_contains")},
    **{n: (2, 2, _array("any")) for n in ("array_has_any", "list_has_any")}, **{n: (2, 2, _array("all")) for n in ("array_has_all", "list_has_all")},
    **{n: (2, 2, _json) for n in ("json_get", "json_get_string", "json_get_int", "json_get_float", "json_get_bool", "json_extract", "json_exists", "json_array_length")},
    "json_array_contains": (3, 3, _json),
    "now": (0, 0, lambda e, a, n: ("current_timestamp()", T.TimestampType())), "current_timestamp": (0, 0, lambda e, a, n: ("current_timestamp()", T.TimestampType())),
    "current_date": (0, 0, lambda e, a, n: ("current_date()", T.DateType())),
    "_cast_list_f16": (1, 1, lambda e, a, n: (f"brindle_half({e(a[0])[0]})", T.ArrayType(T.FloatType()))),
}


def to_sql(text: str, schema: T.StructType, strict: bool = True) -> tuple[str, T.DataType]:
    """Spark SQL and type of an expression of the dialect."""
    return Emitter(schema, strict)(parse(text))


def column(text: str, schema: T.StructType, spark: SparkSession | None = None, strict: bool = True) -> Column:
    made, _ = to_sql(text, schema, strict)
    if "brindle_" in made:
        json_path.register(spark or SparkSession.getActiveSession())
    return F.expr(made)


def condition(text: str, schema: T.StructType, spark: SparkSession | None = None) -> Column:
    """A filter: rows stay where it is true, and go where it is false or null."""
    made, t = to_sql(text, schema)
    if not isinstance(t, (T.BooleanType, T.NullType)):
        raise DialectError(f"the filter {text!r} isn't a condition but {t.simpleString()}")
    if "brindle_" in made:
        json_path.register(spark or SparkSession.getActiveSession())
    return F.expr(made)
