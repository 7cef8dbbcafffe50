"""Language types and Spark types; literals."""

from __future__ import annotations

import datetime as dt
import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.lang.diagnostics import TRANSLATION, QueryError
from sluice.lang.lexer import TICKS

TIMESTAMP = T.TimestampNTZType()
INTERVAL = T.DayTimeIntervalType()
#: The language's type names.
SPARK: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "int64": T.LongType(), "real": T.DoubleType(),
    "double": T.DoubleType(), "decimal": T.DecimalType(38, 18), "string": T.StringType(), "datetime": TIMESTAMP, "date": TIMESTAMP,
    "timespan": INTERVAL, "time": INTERVAL, "guid": T.StringType(), "dynamic": T.VariantType(), "null": T.NullType(),
}


def spark_type(name: str) -> T.DataType:
    try:
        return SPARK[name.lower()]
    except KeyError:
        raise QueryError(TRANSLATION, f"unknown type {name!r}") from None


def language_type(t: T.DataType) -> str:
    for kind, name in (
        (T.BooleanType, "bool"), (T.ByteType, "int"), (T.ShortType, "int"), (T.IntegerType, "int"), (T.LongType, "long"), (T.FloatType, "real"),
        (T.DoubleType, "real"), (T.DecimalType, "decimal"), (T.StringType, "string"), (T.TimestampNTZType, "datetime"), (T.TimestampType, "datetime"),
        (T.DateType, "datetime"), (T.DayTimeIntervalType, "timespan"),
    ):
        if isinstance(t, kind):
            return name
    return "dynamic"


def is_integral(t) -> bool:
    return isinstance(t, T.IntegralType)


def is_numeric(t) -> bool:
    return isinstance(t, T.NumericType)


def is_time(t) -> bool:
    return isinstance(t, T.TimestampType | T.TimestampNTZType | T.DateType)


def is_span(t) -> bool:
    return isinstance(t, T.DayTimeIntervalType)


def is_variant(t) -> bool:
    return isinstance(t, T.VariantType)


def is_collection(t) -> bool:
    return isinstance(t, T.ArrayType | T.StructType | T.MapType)


def span(ticks: int) -> Column:
    """A timespan literal; a tick is 100 ns, what is below a microsecond is cut off."""
    return F.lit(dt.timedelta(microseconds=int(ticks) // 10 if ticks >= 0 else -(-int(ticks) // 10)))


def parse_span(text: str) -> int | None:
    """Ticks of 1d, 12.5h, [-][d.]hh:mm[:ss[.fffffff]] or a number of days."""
    text = text.strip()
    if m := re.fullmatch(r"(-?)(?:(\d+)\.)?(\d+):(\d+)(?::(\d+)(?:\.(\d{1,7}))?)?", text):
        sign, d, h, mi, s, f = m.groups()
        ticks = int(d or 0) * TICKS["d"] + int(h) * TICKS["h"] + int(mi) * TICKS["m"] + int(s or 0) * TICKS["s"] + int((f or "").ljust(7, "0") or 0)
        return -ticks if sign else ticks
    if m := re.fullmatch(r"(-?\d+(?:\.\d+)?)\s*([a-z]*)", text, re.I):
        unit = TICKS.get(m[2].lower() or "d")
        return None if unit is None else round(float(m[1]) * unit)
    return None


def parse_datetime(text: str) -> dt.datetime | None:
    text = text.strip().replace("T", " ").rstrip("Zz").strip()
    if m := re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})(?: (\d{1,2})(?::(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,9}))?)?)?)?([+-]\d{2}:?\d{2})?", text):
        y, mo, d, h, mi, s, f, zone = m.groups()
        try:
            out = dt.datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(s or 0), int((f or "0")[:6].ljust(6, "0")))
        except ValueError:
            return None
        if zone:
            minutes = int(zone[1:3]) * 60 + int(zone[-2:])
            out -= dt.timedelta(minutes=minutes if zone[0] == "+" else -minutes)
        return out
    if m := re.fullmatch(r"(\d{4})(?:-(\d{1,2}))?", text):
        return dt.datetime(int(m[1]), int(m[2] or 1), 1)
    for form in ("%m/%d/%Y", "%m/%d/%Y %H:%M:%S", "%m/%d/%Y %I:%M:%S %p", "%d %b %Y", "%a, %d %b %Y %H:%M:%S"):
        try:
            return dt.datetime.strptime(text, form)
        except ValueError:
            continue
    return None


def timestamp(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(" ")).cast(TIMESTAMP)


def _same_kind(values: list) -> type | None:
    kinds = {type(v) for v in values if v is not None}
    if kinds == {int, float}:
        return float
    return kinds.pop() if len(kinds) == 1 else None


def dynamic_json(raw: str) -> Any:
    """What a dynamic literal's text says; texts in it may stand in single quotes."""
    try:
        return json.loads(raw)
    except ValueError:
        quoted = re.sub(r"'((?:[^'\\]|\\.)*)'", lambda m: json.dumps(m[1]), raw)
        try:
            return json.loads(quoted)
        except ValueError:
            raise QueryError(TRANSLATION, f"dynamic({raw[:40]}) is not JSON") from None


def dynamic_literal(raw: str) -> tuple[Column, T.DataType]:
    """Arrays of one scalar type become arrays, all else a variant."""
    return dynamic_value(dynamic_json(raw))


def dynamic_value(value: Any) -> tuple[Column, T.DataType]:
    if isinstance(value, list) and value and (kind := _same_kind(value)) in (int, float, str, bool):
        spark = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType()}[kind]
        return F.array(*[F.lit(None if v is None else kind(v)).cast(spark) for v in value]), T.ArrayType(spark)
    return F.parse_json(F.lit(json.dumps(value))), T.VariantType()


def literal(kind: str, value: Any) -> tuple[Column, T.DataType]:
    """Column and Spark type of a literal; typed nulls are nulls of the type."""
    if kind == "null":
        return F.lit(None), T.NullType()
    spark = spark_type(kind)
    if value is None:
        return F.lit(None).cast(spark), spark
    if kind == "timespan":
        ticks = value if isinstance(value, int) else parse_span(value)
        if ticks is None:
            raise QueryError(TRANSLATION, f"timespan({value}) cannot be read")
        return span(ticks), INTERVAL
    if kind == "datetime":
        if value == "":
            return F.localtimestamp(), TIMESTAMP
        when = parse_datetime(value)
        if when is None:
            raise QueryError(TRANSLATION, f"datetime({value}) cannot be read")
        return timestamp(when), TIMESTAMP
    if kind == "dynamic":
        return dynamic_literal(value)
    if kind == "decimal":
        return F.lit(str(value)).cast(spark), spark
    if kind == "long" and not -(1 << 63) <= value < 1 << 63:
        return F.lit(float(value)), T.DoubleType()
    if kind in ("int", "long"):
        return F.lit(value).cast(spark), spark
    return F.lit(value), spark
