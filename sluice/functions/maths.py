"""Numbers: elementary functions, bits, distributions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.registry import function, raw
from sluice.plans import types as K
from sluice.plans.expr import E, as_double, as_numeric

DOUBLE, LONG, BOOL = T.DoubleType(), T.LongType(), T.BooleanType()

for _names, _build in {
    "acos": F.acos, "asin": F.asin, "atan": F.atan, "cos": F.cos, "sin": F.sin, "tan": F.tan, "cot": F.cot, "degrees": F.degrees, "radians": F.radians,
    "exp": F.exp, "exp2": lambda x: F.pow(F.lit(2.0), x), "exp10": lambda x: F.pow(F.lit(10.0), x), "log2": F.log2, "log10": F.log10, "sqrt": F.sqrt,
    "ln": F.ln,
}.items():

    @function(_names, 1, kind="B")
    def _(ctx, args, build=_build):
        return E(build(as_double(ctx, args[0])), DOUBLE)


@function("log", 1, 2, kind="B")
def _(ctx, args):
    x = as_double(ctx, args[0])
    return E(F.ln(x) if len(args) == 1 else F.ln(x) / F.ln(as_double(ctx, args[1])), DOUBLE)


@function("atan2", 2, kind="B")
def _(ctx, args):
    return E(F.atan2(as_double(ctx, args[0]), as_double(ctx, args[1])), DOUBLE)


@function("pow", 2, kind="B")
def _(ctx, args):
    return E(F.pow(as_double(ctx, args[0]), as_double(ctx, args[1])), DOUBLE)


@function("pi", 0, kind="B")
def _(ctx, args):
    return E(F.pi(), DOUBLE)


@function("abs", 1, kind="B")
def _(ctx, args):
    n = as_numeric(ctx, args[0])
    return E(F.abs(n.column), n.type)


@function("sign", 1, kind="B")
def _(ctx, args):
    return E(F.signum(as_double(ctx, args[0])), DOUBLE)


@function("ceiling", 1, kind="B")
def _(ctx, args):
    return E(F.ceil(as_double(ctx, args[0])), LONG)


@function("round", 1, 2, kind="B")
def _(ctx, args):
    n = as_numeric(ctx, args[0])
    digits = int(args[1].constant) if len(args) > 1 else 0
    return E(F.round(n.column, digits), ctx.type_of(n) if not isinstance(ctx.type_of(n), T.DecimalType) else None)


@function("max_of", 2, None, kind="B")
def _(ctx, args):
    args = [as_numeric(ctx, a) if K.is_variant(ctx.type_of(a)) else a for a in args]
    return E(F.greatest(*[a.column for a in args]))


@function("min_of", 2, None, kind="B")
def _(ctx, args):
    args = [as_numeric(ctx, a) if K.is_variant(ctx.type_of(a)) else a for a in args]
    return E(F.least(*[a.column for a in args]))


@raw("rand", 0, 2, kind="B")
def _(ctx, call):
    from sluice.plans.expr import compile_expr

    if not call.args:
        return E(F.rand(), DOUBLE)
    n = compile_expr(ctx, call.args[0]).column
    return E(F.floor(F.rand() * n).cast("long"), LONG)


@function("isnan", 1, kind="B")
def _(ctx, args):
    return E(F.isnan(as_double(ctx, args[0])), BOOL)


@function("isinf", 1)
def _(ctx, args):
    return E(F.abs(as_double(ctx, args[0])) == F.lit(float("inf")), BOOL)


@function("isfinite", 1)
def _(ctx, args):
    x = as_double(ctx, args[0])
    return E(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), BOOL)


def _long(e: E):
    return e.column.cast("long")


for _names, _build in {
    "binary_and": lambda a, b: a.bitwiseAND(b), "binary_or": lambda a, b: a.bitwiseOR(b), "binary_xor": lambda a, b: a.bitwiseXOR(b),
    "binary_shift_left": lambda a, b: F.call_function("shiftleft", a, b.cast("int")), "binary_shift_right": lambda a, b: F.call_function("shiftright", a, b.cast("int")),
}.items():

    @function(_names, 2, kind="B")
    def _(ctx, args, build=_build):
        return E(build(_long(args[0]), _long(args[1])), LONG)


@function("binary_not", 1, kind="B")
def _(ctx, args):
    return E(F.bitwise_not(_long(args[0])), LONG)


@function("bitset_count_ones", 1, kind="B")
def _(ctx, args):
    return E(F.bit_count(_long(args[0])).cast("long"), LONG)


# ---- Arrow UDFs: no composition of built-ins exists ---------------------------------------------------------------


def vector_udf(names: str, count: int, scalar, result=DOUBLE):
    """Register a function of float columns; nulls give nulls."""

    @function(names, count, kind="U")
    def _(ctx, args):
        @F.pandas_udf(result)
        def run(*columns: pd.Series) -> pd.Series:
            values = [pd.to_numeric(c, errors="coerce").to_numpy(float) for c in columns]
            out = []
            for row in zip(*values, strict=True):
                try:
                    out.append(None if any(math.isnan(v) for v in row) else scalar(*row))
                except (ValueError, OverflowError, ZeroDivisionError):
                    out.append(None)
            return pd.Series(out, dtype=object).astype(float)

        return E(run(*[as_double(ctx, a) for a in args]), result)


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if not 0 <= x <= 1 or a <= 0 or b <= 0:
        raise ValueError
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a


def beta_inv(p: float, a: float, b: float) -> float:
    if not 0 <= p <= 1:
        raise ValueError
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if beta_cdf(mid, a, b) < p else (low, mid)
    return (low + high) / 2


def beta_pdf(x: float, a: float, b: float) -> float:
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) * x ** (a - 1) * (1 - x) ** (b - 1)


vector_udf("beta_cdf", 3, beta_cdf)
vector_udf("beta_inv", 3, beta_inv)
vector_udf("beta_pdf", 3, beta_pdf)
vector_udf("erf", 1, math.erf)
vector_udf("erfc", 1, math.erfc)
vector_udf("gamma", 1, math.gamma)
vector_udf("loggamma", 1, math.lgamma)


def welch(m1: float, v1: float, n1: float, m2: float, v2: float, n2: float) -> float:
    """Two-sided p-value of Welch's t-test from means, variances and counts."""
    s = v1 / n1 + v2 / n2
    t = (m1 - m2) / math.sqrt(s)
    freedom = s * s / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
    return beta_cdf(freedom / (freedom + t * t), freedom / 2, 0.5)


@function("welch_test", 2, 6, kind="U")
def _(ctx, args):
    if len(args) == 6:
        @F.pandas_udf(DOUBLE)
        def six(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series) -> pd.Series:
            return pd.Series([welch(*row) for row in zip(a, b, c, d, e, f, strict=True)])

        return E(six(*[as_double(ctx, a) for a in args]), DOUBLE)

    @F.pandas_udf(DOUBLE)
    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            a, b = np.asarray(a, float), np.asarray(b, float)
            out.append(welch(a.mean(), a.var(ddof=1), len(a), b.mean(), b.var(ddof=1), len(b)) if len(a) > 1 and len(b) > 1 else None)
        return pd.Series(out, dtype=float)

    from sluice.functions.series import numbers

    return E(two(numbers(ctx, args[0]), numbers(ctx, args[1])), DOUBLE)
