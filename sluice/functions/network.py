"""Addresses. IPv4 stays in the JVM as packed longs; IPv6 goes through Arrow batches."""

from __future__ import annotations

import ipaddress
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.registry import function
from sluice.plans.expr import E, as_array, as_string

STRING, LONG, BOOL = T.StringType(), T.LongType(), T.BooleanType()
FULL = 0xFFFFFFFF


def packed(text: Column) -> Column:
    """The address before any slash as a number, null where it is none."""
    parts = F.split(F.split_part(text, F.lit("/"), F.lit(1)), r"\.")
    octet = lambda k: F.get(parts, F.lit(k)).try_cast("long")
    valid = (F.size(parts) == 4) & F.split_part(text, F.lit("/"), F.lit(1)).rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    inside = octet(0).between(0, 255) & octet(1).between(0, 255) & octet(2).between(0, 255) & octet(3).between(0, 255)
    return F.when(valid & inside, octet(0) * 16777216 + octet(1) * 65536 + octet(2) * 256 + octet(3))


def prefix(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"/(\d{1,2})$", 1).try_cast("long"), F.lit(32).cast("long"))


def mask(bits: Column) -> Column:
    return F.when(bits <= 0, F.lit(0)).otherwise(F.lit(FULL).bitwiseAND(F.call_function("shiftleft", F.lit(FULL).cast("long"), (F.lit(32) - F.least(bits, F.lit(32))).cast("int")))).cast("long")


def dotted(n: Column) -> Column:
    return F.concat_ws(".", *[F.call_function("shiftright", n, F.lit(s)).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def _as_text(ctx, e: E) -> Column:
    return dotted(e.column.cast("long")) if isinstance(ctx.type_of(e), T.IntegralType) else as_string(ctx, e)


@function("parse_ipv4", 1)
def _(ctx, args):
    text = as_string(ctx, args[0])
    return E(packed(text).bitwiseAND(mask(prefix(text))), LONG)


@function("parse_ipv4_mask", 2)
def _(ctx, args):
    return E(packed(as_string(ctx, args[0])).bitwiseAND(mask(args[1].column.cast("long"))), LONG)


@function("format_ipv4", 1, 2)
def _(ctx, args):
    n = packed(_as_text(ctx, args[0]))
    return E(dotted(n.bitwiseAND(mask(args[1].column.cast("long"))) if len(args) > 1 else n), STRING)


@function("format_ipv4_mask", 1, 3)
def _(ctx, args):
    n = packed(_as_text(ctx, args[0]))
    bits = args[1].column.cast("long") if len(args) > 1 else F.lit(32).cast("long")
    return E(F.concat(dotted(n.bitwiseAND(mask(bits))), F.lit("/"), bits.cast("string")), STRING)


@function("ipv4_netmask_suffix", 1)
def _(ctx, args):
    text = as_string(ctx, args[0])
    return E(F.when(packed(text).isNotNull(), prefix(text)), LONG)


def _common(ctx, args) -> tuple[Column, Column]:
    a, b = as_string(ctx, args[0]), as_string(ctx, args[1])
    bits = F.least(prefix(a), prefix(b))
    if len(args) > 2:
        bits = F.least(bits, args[2].column.cast("long"))
    return packed(a).bitwiseAND(mask(bits)), packed(b).bitwiseAND(mask(bits))


@function("ipv4_compare", 2, 3)
def _(ctx, args):
    a, b = _common(ctx, args)
    return E(F.when(a < b, -1).when(a > b, 1).when(a == b, 0).cast("long"), LONG)


@function("ipv4_is_match", 2, 3)
def _(ctx, args):
    a, b = _common(ctx, args)
    return E(a == b, BOOL)


def in_range(ip: Column, net: Column) -> Column:
    m = mask(prefix(net))
    return packed(ip).bitwiseAND(m) == packed(net).bitwiseAND(m)


@function("ipv4_is_in_range", 2)
def _(ctx, args):
    return E(in_range(as_string(ctx, args[0]), as_string(ctx, args[1])), BOOL)


def _many(ctx, args) -> Column:
    if len(args) == 1 and not isinstance(ctx.type_of(args[0]), T.StringType):
        return as_array(ctx, args[0]).column.cast("array<string>")
    return F.array(*[as_string(ctx, a) for a in args])


@function("ipv4_is_in_any_range", 2, None)
def _(ctx, args):
    ip = as_string(ctx, args[0])
    return E(F.exists(_many(ctx, args[1:]), lambda net: in_range(ip, net)), BOOL)


@function("ipv4_is_private isipv4private", 1)
def _(ctx, args):
    ip = as_string(ctx, args[0])
    return E(in_range(ip, F.lit("10.0.0.0/8")) | in_range(ip, F.lit("172.16.0.0/12")) | in_range(ip, F.lit("192.168.0.0/16")), BOOL)


def _found(text: Column, addresses: Column, whole: bool) -> Column:
    quoted = lambda x: F.replace(x, F.lit("."), F.lit("\\."))
    return F.exists(addresses, lambda x: F.regexp_like(text, F.concat(F.lit(r"(?<![\d.])"), quoted(x), F.lit(r"(?![\d]|\.\d)" if whole else ""))))


@function("has_ipv4 has_any_ipv4", 2, None)
def _(ctx, args):
    return E(_found(as_string(ctx, args[0]), _many(ctx, args[1:]), True), BOOL)


@function("has_ipv4_prefix has_any_ipv4_prefix", 2, None)
def _(ctx, args):
    return E(_found(as_string(ctx, args[0]), _many(ctx, args[1:]), False), BOOL)


# ---- Arrow UDFs -----------------------------------------------------------------------------------------------------


def full(text: str) -> ipaddress.IPv6Address:
    a = ipaddress.ip_address(text.split("/")[0])
    return a if a.version == 6 else ipaddress.IPv6Address(f"::ffff:{a}")


def bits_of(text: str) -> int:
    if "/" not in text:
        return 128
    n = int(text.split("/")[1])
    return n + 96 if ipaddress.ip_address(text.split("/")[0]).version == 4 else n


def cut(a: ipaddress.IPv6Address, bits: int) -> int:
    return int(a) >> (128 - bits) << (128 - bits)


def compare(a: str, b: str, bits: int = 128) -> int:
    n = min(bits_of(a), bits_of(b), bits)
    x, y = cut(full(a), n), cut(full(b), n)
    return (x > y) - (x < y)


def _udf(names: str, work, least: int, most: int, result):
    @function(names, least, most, kind="U")
    def _(ctx, args):
        @F.pandas_udf(result)
        def run(*columns: pd.Series) -> pd.Series:
            out = []
            for row in zip(*columns, strict=True):
                try:
                    out.append(None if any(v is None for v in row) else work(*row))
                except ValueError:
                    out.append(None)
            return pd.Series(out, dtype=object)

        return E(run(*[as_string(ctx, a) for a in args]), result)


def groups(number: int) -> str:
    """All eight groups of four digits, of mapped addresses too."""
    return ":".join(f"{number >> 16 * k & 0xFFFF:04x}" for k in reversed(range(8)))


def masked(text: str, bits: str) -> str:
    """A mask counts the bits of the address as it is written, 32 or 128."""
    shift = 96 if ipaddress.ip_address(text.split("/")[0]).version == 4 else 0
    return groups(cut(full(text), max(0, min(bits_of(text), int(bits) + shift))))


_udf("parse_ipv6", lambda s: groups(cut(full(s), bits_of(s))), 1, 1, STRING)
_udf("parse_ipv6_mask", masked, 2, 2, STRING)
_udf("ipv6_compare", lambda a, b, n="128": compare(a, b, int(n)), 2, 3, LONG)
_udf("ipv6_is_match", lambda a, b, n="128": compare(a, b, int(n)) == 0, 2, 3, BOOL)
_udf("ipv6_is_in_range", lambda a, b: cut(full(a), bits_of(b)) == cut(full(b), bits_of(b)), 2, 2, BOOL)


@function("ipv6_is_in_any_range", 2, None, kind="U")
def _(ctx, args):
    @F.pandas_udf(BOOL)
    def run(ips: pd.Series, nets: pd.Series) -> pd.Series:
        out = []
        for ip, many in zip(ips, nets, strict=True):
            try:
                out.append(None if ip is None else any(cut(full(ip), bits_of(n)) == cut(full(n), bits_of(n)) for n in many))
            except ValueError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return E(run(as_string(ctx, args[0]), _many(ctx, args[1:])), BOOL)


@function("ipv4_range_to_cidr_list", 2, kind="U")
def _(ctx, args):
    @F.pandas_udf("string")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            try:
                out.append(json.dumps([str(n) for n in ipaddress.summarize_address_range(ipaddress.IPv4Address(x), ipaddress.IPv4Address(y))]))
            except (ValueError, TypeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return E(F.from_json(run(as_string(ctx, args[0]), as_string(ctx, args[1])), T.ArrayType(STRING)), T.ArrayType(STRING))

