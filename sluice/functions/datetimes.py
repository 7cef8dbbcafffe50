"""Dates, times and timespans. Moments are kept without a time zone, in UTC."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.registry import function, raw
from sluice.lang.diagnostics import TRANSLATION, QueryError
from sluice.plans import types as K
from sluice.plans.expr import E, arithmetic, as_double, as_string, epoch_micros, from_epoch_micros, micros, micros_span

STRING, LONG, INT = T.StringType(), T.LongType(), T.IntegerType()


def moment(ctx, e: E) -> Column:
    t = ctx.type_of(e)
    if isinstance(t, T.TimestampNTZType):
        return e.column
    if isinstance(t, T.TimestampType | T.DateType):
        return e.column.cast("timestamp_ntz")
    if K.is_numeric(t):
        return from_epoch_micros((e.column.cast("double") * 1_000_000).cast("long"))
    text = as_string(ctx, e)
    return F.coalesce(text.try_cast("timestamp_ntz"), F.try_to_timestamp(text).cast("timestamp_ntz"))


def truncated(unit: str, c: Column) -> Column:
    if unit == "WEEK":  # weeks begin on Sunday
        day = F.date_trunc("DAY", c).cast("timestamp_ntz")
        return day - F.make_dt_interval(F.dayofweek(c) - 1)
    return F.date_trunc(unit, c).cast("timestamp_ntz")


def shifted(unit: str, c: Column, n: Column) -> Column:
    if unit == "HOUR":
        return c + F.make_dt_interval(F.lit(0), n.cast("int"))
    if unit in ("DAY", "WEEK"):
        return c + F.make_dt_interval((n * (7 if unit == "WEEK" else 1)).cast("int"))
    return c + F.make_ym_interval(F.lit(0), (n * (12 if unit == "YEAR" else 1)).cast("int"))


for _unit in ("day", "week", "month", "year", "hour"):

    @function(f"startof{_unit}", 1, 2)
    def _(ctx, args, unit=_unit.upper()):
        start = truncated(unit, moment(ctx, args[0]))
        return E(shifted(unit, start, args[1].column) if len(args) > 1 else start, K.TIMESTAMP)

    @function(f"endof{_unit}", 1, 2)
    def _(ctx, args, unit=_unit.upper()):
        start = truncated(unit, moment(ctx, args[0]))
        n = args[1].column if len(args) > 1 else F.lit(0)
        return E(shifted(unit, start, n + 1) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(0.000001).cast("decimal(18,6)")), K.TIMESTAMP)


for _names, _build in {
    "year getyear": F.year, "month getmonth monthofyear": F.month, "dayofmonth getday": F.dayofmonth, "dayofyear": F.dayofyear,
    "hour gethour hourofday": F.hour, "minute": F.minute, "second": F.second, "weekofyear week_of_year": F.weekofyear,
}.items():

    @function(_names, 1, kind="B")
    def _(ctx, args, build=_build):
        return E(build(moment(ctx, args[0])), INT)


@function("dayofweek", 1)
def _(ctx, args):
    return E(F.make_dt_interval(F.dayofweek(moment(ctx, args[0])) - 1), K.INTERVAL)


@function("now", 0, 1, kind="B")
def _(ctx, args):
    return arithmetic(ctx, "+", E(F.localtimestamp(), K.TIMESTAMP), args[0]) if args else E(F.localtimestamp(), K.TIMESTAMP)


@function("ago", 1)
def _(ctx, args):
    return arithmetic(ctx, "-", E(F.localtimestamp(), K.TIMESTAMP), args[0])


@function("todatetime datetime to_datetime", 1, kind="B")
def _(ctx, args):
    return E(moment(ctx, args[0]), K.TIMESTAMP, args[0].name)


#: Units of datetime_add, datetime_diff and datetime_part.
UNITS = {
    "year": "YEAR", "quarter": "QUARTER", "month": "MONTH", "week": "WEEK", "week_of_year": "WEEK", "weekofyear": "WEEK", "day": "DAY", "dayofyear": "DOY", "hour": "HOUR",
    "minute": "MINUTE", "second": "SECOND", "millisecond": "MILLISECOND", "microsecond": "MICROSECOND", "nanosecond": "NANOSECOND",
}


def _unit(e: E) -> str:
    unit = UNITS.get(str(e.constant).lower().rstrip("s") if str(e.constant).lower() not in UNITS else str(e.constant).lower())
    if unit is None:
        raise QueryError(TRANSLATION, f"unknown part {e.constant!r} of a date")
    return unit


@function("datetime_add dateadd", 3, kind="B")
def _(ctx, args):
    unit, n, when = _unit(args[0]), args[1].column.cast("long"), moment(ctx, args[2])
    if unit == "NANOSECOND":
        return E(F.timestamp_add("MICROSECOND", (n / 1000).cast("long"), when), K.TIMESTAMP)
    return E(F.timestamp_add(unit, n, when), K.TIMESTAMP)


@function("datetime_diff datediff", 3, kind="C")
def _(ctx, args):
    """Boundaries of the part that are crossed from the second moment to the first."""
    unit, a, b = _unit(args[0]), moment(ctx, args[1]), moment(ctx, args[2])
    if unit in ("YEAR", "QUARTER", "MONTH"):
        per = {"YEAR": 1, "QUARTER": 4, "MONTH": 12}[unit]
        number = lambda c: F.year(c) * per + {"YEAR": F.lit(0), "QUARTER": F.quarter(c), "MONTH": F.month(c)}[unit]
        return E((number(a) - number(b)).cast("long"), LONG)
    if unit == "NANOSECOND":
        return E(F.timestamp_diff("MICROSECOND", b, a) * 1000, LONG)
    if unit in ("MILLISECOND", "MICROSECOND"):
        per = 1000 if unit == "MILLISECOND" else 1
        us = lambda c: F.floor(epoch_micros(c, K.TIMESTAMP) / per)
        return E((us(a) - us(b)).cast("long"), LONG)
    seconds = {"WEEK": 604800, "DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}[unit] * 1_000_000
    shift = 3 * 86_400_000_000 if unit == "WEEK" else 0  # 1970-01-01 was a Thursday; boundaries lie before Sundays
    place = lambda c: F.floor((epoch_micros(c, K.TIMESTAMP) + F.lit(shift + (86_400_000_000 if unit == "WEEK" else 0))) / seconds)
    return E((place(a) - place(b)).cast("long"), LONG)


@function("datetime_part datepart", 2, kind="B")
def _(ctx, args):
    unit, when = _unit(args[0]), moment(ctx, args[1])
    if unit in ("MILLISECOND", "MICROSECOND", "NANOSECOND"):
        us = F.pmod(epoch_micros(when, K.TIMESTAMP), F.lit(1_000_000))
        return E({"MILLISECOND": F.floor(us / 1000), "MICROSECOND": us, "NANOSECOND": us * 1000}[unit].cast("int"), INT)
    return E(F.date_part(F.lit(unit), when).cast("int"), INT)


@function("make_datetime", 1, 7, kind="B")
def _(ctx, args):
    if len(args) == 1:
        return E(moment(ctx, args[0]), K.TIMESTAMP)
    parts = [a.column.cast("int") for a in args[:5]]
    parts += [F.lit(1)] * (3 - len(parts)) if len(parts) < 3 else []
    parts += [F.lit(0)] * (5 - len(parts))
    second = args[5].column.cast("decimal(16,6)") if len(args) > 5 else F.lit(0).cast("decimal(16,6)")
    return E(F.call_function("try_make_timestamp_ntz", *parts, second), K.TIMESTAMP)


@function("make_timespan", 2, 4, kind="B")
def _(ctx, args):
    parts = [a.column.cast("int") for a in args]
    day = parts.pop(0) if len(parts) == 4 else F.lit(0)
    hour, minute = parts[0], parts[1]
    second = args[-1].column.cast("decimal(18,6)") if len(args) > 2 else F.lit(0).cast("decimal(18,6)")
    return E(F.make_dt_interval(day, hour, minute, second), K.INTERVAL)


_SPAN = r"^\s*(-?)(?:(\d+)\.)?(\d+):(\d+)(?::(\d+)(?:\.(\d{1,7}))?)?\s*$"


@function("totimespan totime timespan time to_timespan", 1)
def _(ctx, args):
    (a,) = args
    t = ctx.type_of(a)
    if K.is_span(t):
        return a
    if K.is_numeric(t):
        return E(micros_span((a.column.cast("double") / 10).cast("long")), K.INTERVAL)
    if isinstance(a.constant, str):
        ticks = K.parse_span(a.constant)
        return E(K.span(ticks) if ticks is not None else F.lit(None).cast(K.INTERVAL), K.INTERVAL)
    text = as_string(ctx, a)
    part = lambda i: F.coalesce(F.regexp_extract(text, _SPAN, i).try_cast("long"), F.lit(0))
    us = part(2) * 86_400_000_000 + part(3) * 3_600_000_000 + part(4) * 60_000_000 + part(5) * 1_000_000 + F.coalesce(F.rpad(F.regexp_extract(text, _SPAN, 6), 6, "0").try_cast("long"), F.lit(0))
    clock = F.when(F.regexp_extract(text, _SPAN, 1) == "-", -us).otherwise(us)
    short = r"^\s*(-?\d+(?:\.\d+)?)\s*([a-z]*)\s*$"
    number, unit = F.regexp_extract(text, short, 1).try_cast("double"), F.regexp_extract(text, short, 2)
    per = F.when(unit.isin("", "d", "day", "days"), 86_400e6).when(unit.isin("h", "hour", "hours"), 3600e6).when(unit.isin("m", "min", "minute", "minutes"), 60e6)
    per = per.when(unit.isin("s", "sec", "second", "seconds"), 1e6).when(unit.isin("ms", "millisecond", "milliseconds"), 1e3).when(unit.isin("microsecond", "microseconds"), 1.0).when(unit.isin("tick", "ticks"), 0.1)
    us = F.when(text.rlike(_SPAN), clock).when(text.rlike(short), F.round(number * per).cast("long"))
    return E(F.when(us.isNotNull(), micros_span(us)), K.INTERVAL)


for _name, _us in {"seconds": 1_000_000, "milliseconds": 1000, "microseconds": 1}.items():

    @function(f"unixtime_{_name}_todatetime", 1, kind="B")
    def _(ctx, args, us=_us):
        return E(from_epoch_micros((as_double(ctx, args[0]) * us).cast("long") if not K.is_integral(ctx.type_of(args[0])) else args[0].column.cast("long") * us), K.TIMESTAMP)


@function("unixtime_nanoseconds_todatetime", 1)
def _(ctx, args):
    return E(from_epoch_micros(F.floor(args[0].column.cast("decimal(38,0)") / 1000).cast("long")), K.TIMESTAMP)


@function("datetime_local_to_utc", 2, kind="B")
def _(ctx, args):
    return E(F.to_utc_timestamp(moment(ctx, args[0]).cast("timestamp"), args[1].column).cast("timestamp_ntz"), K.TIMESTAMP)


@function("datetime_utc_to_local", 2, kind="B")
def _(ctx, args):
    return E(F.from_utc_timestamp(moment(ctx, args[0]).cast("timestamp"), args[1].column).cast("timestamp_ntz"), K.TIMESTAMP)


@raw("datetime_list_timezones", 0)
def _(ctx, call):
    import zoneinfo

    return E(F.array(*map(F.lit, sorted(zoneinfo.available_timezones()))), T.ArrayType(STRING))


def java_pattern(form: str) -> str:
    """A custom date format in Java's letters."""
    def one(m: re.Match) -> str:
        run = m[0]
        return {"f": "S", "F": "S", "t": "a"}.get(run[0], run[0]) * (1 if run[0] == "t" else len(run))

    out = re.sub(r"y+|M+|d+|H+|h+|m+|s+|f+|F+|t+|z+|[A-Za-z]", lambda m: one(m) if m[0][0] in "yMdHhmsfFt" else "'" + m[0] + "'", form)
    return re.sub(r"\[|\]|\{|\}|#", lambda m: f"'{m[0]}'", out)


@function("format_datetime", 2)
def _(ctx, args):
    return E(F.date_format(moment(ctx, args[0]), java_pattern(args[1].constant)), STRING)


@function("format_timespan", 2)
def _(ctx, args):
    us = F.abs(micros(args[0].column))
    values = {"d": F.floor(us / 86_400_000_000), "h": F.floor(us % 86_400_000_000 / 3_600_000_000), "H": F.floor(us % 86_400_000_000 / 3_600_000_000), "m": F.floor(us % 3_600_000_000 / 60_000_000), "s": F.floor(us % 60_000_000 / 1_000_000)}
    parts = []
    for run in re.findall(r"d+|[hH]+|m+|s+|[fF]+|.", args[1].constant):
        if run[0] in values:
            parts.append(F.lpad(values[run[0]].cast("long").cast("string"), max(len(run), 1), "0") if len(run) > 1 else values[run[0]].cast("long").cast("string"))
        elif run[0] in "fF":
            digits = F.lpad((us % 1_000_000).cast("long").cast("string"), 6, "0")
            parts.append(F.substring(F.concat(digits, F.lit("0")), 1, min(len(run), 7)))
        else:
            parts.append(F.lit(run))
    return E(F.concat(*parts), STRING)


def binned(ctx, value: E, step: E, base: E | None = None) -> E:
    """The greatest base + k * step that is not above the value."""
    t, ts = ctx.type_of(value), ctx.type_of(step)
    if K.is_variant(t) or isinstance(t, T.StringType):
        value = E(as_string(ctx, value).try_cast("timestamp_ntz"), K.TIMESTAMP) if K.is_span(ts) else E(as_double(ctx, value), T.DoubleType())
        t = value.type
    if K.is_time(t):
        us = epoch_micros(value.column, t)
        zero = F.lit(0) if base is None else epoch_micros(base.column, ctx.type_of(base))
        width = micros(step.column) if K.is_span(ts) else step.column.cast("long") * 86_400_000_000
        return E(from_epoch_micros(us - F.pmod(us - zero, width)), K.TIMESTAMP, value.name)
    if K.is_span(t):
        us, width = micros(value.column), micros(step.column)
        zero = F.lit(0) if base is None else micros(base.column)
        return E(micros_span(us - F.pmod(us - zero, width)), K.INTERVAL, value.name)
    zero = F.lit(0) if base is None else base.column
    if K.is_integral(t) and K.is_integral(ts):
        x = value.column
        return E(x - F.pmod(x - zero, step.column), t if base is None and type(t) is type(ts) else LONG, value.name)
    x, s = value.column.cast("double"), step.column.cast("double")
    return E(F.floor((x - zero) / s) * s + zero, T.DoubleType(), value.name)


@function("bin bin_auto", 1, 3)
def _(ctx, args):
    if len(args) == 1:
        return args[0]
    return binned(ctx, args[0], args[1])


@function("bin_at", 3)
def _(ctx, args):
    return binned(ctx, *args)


@function("floor", 1, 2, kind="B")
def _(ctx, args):
    return binned(ctx, *args) if len(args) == 2 else E(F.floor(as_double(ctx, args[0])), LONG)

