"""Arrow types as Spark's, with what Spark lacks kept in field metadata."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import types as T

_PLAIN = [
    (pa.types.is_boolean, T.BooleanType()), (pa.types.is_int8, T.ByteType()), (pa.types.is_int16, T.ShortType()), (pa.types.is_int32, T.IntegerType()), (pa.types.is_int64, T.LongType()),
    (pa.types.is_uint8, T.ShortType()), (pa.types.is_uint16, T.IntegerType()), (pa.types.is_uint32, T.LongType()), (pa.types.is_uint64, T.DecimalType(20, 0)),
    (pa.types.is_float16, T.FloatType()), (pa.types.is_float32, T.FloatType()), (pa.types.is_float64, T.DoubleType()), (pa.types.is_date, T.DateType()), (pa.types.is_time, T.LongType()),
    (pa.types.is_null, T.StringType()),
]


def to_spark(t: pa.DataType) -> tuple[T.DataType, dict]:
    """The Spark type, and metadata where it is wider or plainer than the Arrow type."""
    for test, made in _PLAIN:
        if test(t):
            changed = pa.types.is_unsigned_integer(t) or pa.types.is_float16(t) or pa.types.is_time(t) or pa.types.is_null(t)
            return made, {"arrow": str(t)} if changed else {}
    if pa.types.is_string(t) or pa.types.is_large_string(t) or t in (pa.string_view(),):
        return T.StringType(), {}
    if pa.types.is_fixed_size_binary(t):
        return T.BinaryType(), {"arrow": str(t), "width": t.byte_width}
    if pa.types.is_binary(t) or pa.types.is_large_binary(t) or t in (pa.binary_view(),):
        return T.BinaryType(), {}
    if pa.types.is_timestamp(t):
        if t.tz and t.tz[0] in "+-":
            raise TypeError(f"a zone by offset is not supported: {t}")
        return (T.TimestampType() if t.tz else T.TimestampNTZType()), {"arrow": str(t)} if t.unit != "us" or t.tz not in (None, "UTC") else {}
    if pa.types.is_duration(t):
        return T.DayTimeIntervalType(), {"arrow": str(t)}
    if pa.types.is_decimal(t):
        if t.precision > 38:
            return T.StringType(), {"arrow": str(t)}
        return T.DecimalType(t.precision, t.scale), {}
    if pa.types.is_dictionary(t):
        return to_spark(t.value_type)
    if pa.types.is_struct(t):
        parts = [(f, *to_spark(f.type)) for f in t]
        return T.StructType([T.StructField(f.name, s, f.nullable, m) for f, s, m in parts]), {}
    if pa.types.is_map(t):
        return T.MapType(to_spark(t.key_type)[0], to_spark(t.item_type)[0]), {}
    if pa.types.is_fixed_size_list(t):
        return T.ArrayType(to_spark(t.value_type)[0]), {"dim": t.list_size}
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return T.ArrayType(to_spark(t.value_type)[0]), {}
    raise TypeError(f"type {t} is not supported")


def schema_to_spark(schema: pa.Schema) -> T.StructType:
    parts = [(f, *to_spark(f.type)) for f in schema]
    return T.StructType([T.StructField(f.name, s, f.nullable, m) for f, s, m in parts])


def vector(dim: int) -> tuple[T.DataType, dict]:
    """The type and metadata of float vectors of one length."""
    return T.ArrayType(T.FloatType()), {"dim": dim}


def from_pydantic(model) -> T.StructType:
    """The schema of a pydantic-style model class: annotated fields, Optional as nullable."""
    import datetime
    import types
    import typing

    plain = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), bytes: T.BinaryType(), datetime.date: T.DateType(), datetime.datetime: T.TimestampType()}

    def one(t) -> tuple[T.DataType, bool]:
        if t in plain:
            return plain[t], False
        origin, args = typing.get_origin(t), typing.get_args(t)
        if origin in (typing.Union, types.UnionType):
            inner = [a for a in args if a is not type(None)]
            return one(inner[0])[0], len(inner) < len(args)
        if origin in (list, tuple):
            return T.ArrayType(one(args[0])[0]), False
        if origin is dict:
            return T.MapType(one(args[0])[0], one(args[1])[0]), False
        if hasattr(t, "__annotations__"):
            return from_pydantic(t), False
        raise TypeError(f"{t} has no type here")

    fields = [(n, *one(t)) for n, t in typing.get_type_hints(model).items() if not n.startswith("_") and n not in ("model_config", "model_fields")]
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])
