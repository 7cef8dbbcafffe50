"""Series: arrays of numbers, element by element in the JVM; signal processing in Arrow batches with numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.registry import function
from sluice.plans.expr import E, as_array, as_double, constants

DOUBLE = T.DoubleType()
SERIES = T.ArrayType(DOUBLE)


def numbers(ctx, e: E) -> Column:
    """An array of doubles."""
    a = as_array(ctx, e)
    kind = a.type.elementType
    return a.column if isinstance(kind, T.DoubleType) else F.transform(a.column, lambda x: as_double(ctx, E(x, kind)))


def is_series(ctx, e: E) -> bool:
    return isinstance(ctx.type_of(e), T.ArrayType | T.VariantType | T.StringType)


for _name, _build in {
    "abs": F.abs, "acos": F.acos, "asin": F.asin, "atan": F.atan, "ceiling": lambda x: F.ceil(x).cast("double"), "cos": F.cos, "exp": F.exp, "floor": lambda x: F.floor(x).cast("double"),
    "log": F.ln, "negate": lambda x: -x, "sign": F.signum, "sin": F.sin, "sqrt": F.sqrt, "tan": F.tan,
}.items():

    @function(f"series_{_name}", 1)
    def _(ctx, args, build=_build):
        return E(F.transform(numbers(ctx, args[0]), build), SERIES)


def paired(names: str, build, result=SERIES):
    """Of two series or a series and a number."""

    @function(names, 2)
    def _(ctx, args):
        first, second = (is_series(ctx, a) for a in args)
        if first and second:
            return E(F.zip_with(numbers(ctx, args[0]), numbers(ctx, args[1]), build), result)
        if first:
            y = as_double(ctx, args[1])
            return E(F.transform(numbers(ctx, args[0]), lambda x: build(x, y)), result)
        x = as_double(ctx, args[0])
        return E(F.transform(numbers(ctx, args[1]), lambda y: build(x, y)), result)


for _name, _build in {"add": lambda x, y: x + y, "subtract": lambda x, y: x - y, "multiply": lambda x, y: x * y, "divide": F.try_divide, "pow": F.pow}.items():
    paired(f"series_{_name}", _build)
for _name, _build in {
    "equals": lambda x, y: x == y, "not_equals": lambda x, y: x != y, "greater": lambda x, y: x > y, "greater_equals": lambda x, y: x >= y,
    "less": lambda x, y: x < y, "less_equals": lambda x, y: x <= y,
}.items():
    paired(f"series_{_name}", _build, T.ArrayType(T.BooleanType()))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


@function("series_sum", 1)
def _(ctx, args):
    return E(total(numbers(ctx, args[0])), DOUBLE)


@function("series_product", 1)
def _(ctx, args):
    return E(F.aggregate(numbers(ctx, args[0]), F.lit(1.0), lambda acc, x: acc * F.coalesce(x, F.lit(1.0))), DOUBLE)


@function("series_magnitude", 1)
def _(ctx, args):
    a = numbers(ctx, args[0])
    return E(F.sqrt(dot(a, a)), DOUBLE)


@function("series_dot_product", 2)
def _(ctx, args):
    first, second = (is_series(ctx, a) for a in args)
    if first and second:
        return E(dot(numbers(ctx, args[0]), numbers(ctx, args[1])), DOUBLE)
    series, number = (args[0], args[1]) if first else (args[1], args[0])
    return E(total(numbers(ctx, series)) * as_double(ctx, number), DOUBLE)


@function("series_cosine_similarity", 2, 4)
def _(ctx, args):
    a, b = numbers(ctx, args[0]), numbers(ctx, args[1])
    na = as_double(ctx, args[2]) if len(args) > 2 else F.sqrt(dot(a, a))
    nb = as_double(ctx, args[3]) if len(args) > 3 else F.sqrt(dot(b, b))
    return E(F.try_divide(dot(a, b), na * nb), DOUBLE)


@function("series_pearson_correlation", 2)
def _(ctx, args):
    a, b = numbers(ctx, args[0]), numbers(ctx, args[1])
    n = F.size(a).cast("double")
    sa, sb = total(a), total(b)
    upper = n * dot(a, b) - sa * sb
    return E(F.try_divide(upper, F.sqrt(n * dot(a, a) - sa * sa) * F.sqrt(n * dot(b, b) - sb * sb)), DOUBLE)


@function("series_fill_const", 2, 3)
def _(ctx, args):
    value = as_double(ctx, args[1])
    return E(F.transform(numbers(ctx, args[0]), lambda x: F.when(x.isNull() | F.isnan(x), value).otherwise(x)), SERIES)


def _stats(ctx, args) -> list[tuple[str, Column]]:
    a = numbers(ctx, args[0])
    known = F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))
    n = F.size(known).cast("double")
    low, high = F.array_min(known), F.array_max(known)
    mean = F.try_divide(total(known), n)
    spread = F.try_divide(total(F.transform(known, lambda x: (x - mean) * (x - mean))), n - 1)
    return [
        ("min", low), ("min_idx", (F.array_position(a, low) - 1).cast("long")), ("max", high), ("max_idx", (F.array_position(a, high) - 1).cast("long")), ("avg", mean),
        ("stdev", F.sqrt(spread)), ("variance", spread),
    ]


@function("series_stats", 1, 2)
def _(ctx, args):
    stats = _stats(ctx, args)
    name = args[0].name or "series"
    out = E(stats[0][1], DOUBLE)
    out.columns = [(f"series_stats_{name}_{k}", c) for k, c in stats]
    return out


@function("series_stats_dynamic", 1, 2)
def _(ctx, args):
    return E(F.to_variant_object(F.struct(*[c.alias(k) for k, c in _stats(ctx, args)])), T.VariantType())


# ---- numpy ----------------------------------------------------------------------------------------------------------


def _values(x) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in x], float)


def fill_forward(y: np.ndarray) -> np.ndarray:
    out, last = y.copy(), np.nan
    for k, v in enumerate(y):
        last = last if np.isnan(v) else v
        out[k] = last
    return out


def fill_linear(y: np.ndarray) -> np.ndarray:
    known = ~np.isnan(y)
    return np.interp(np.arange(len(y)), np.flatnonzero(known), y[known]) if known.any() else y


def series_udf(names: str, least: int, most: int, work, results: list[tuple[str, str]], columns: bool = True):
    """work(values, *constants) -> a tuple of arrays and numbers; several results are columns or a bag."""

    @function(names, least, most, kind="U")
    def _(ctx, args):
        fixed = [constants(a) if a.literal_list is not None or a.kind == "dynamic" else a.constant for a in args[1:]]
        ddl = ", ".join(f"`{n}` {t}" for n, t in results)

        @F.pandas_udf(ddl)
        def run(s: pd.Series) -> pd.DataFrame:
            out = [work(_values(x), *fixed) if x is not None else (None,) * len(results) for x in s]
            return pd.DataFrame({n: pd.Series([r[k] for r in out], dtype=object) for k, (n, _) in enumerate(results)})

        found = run(numbers(ctx, args[0]))
        if len(results) == 1:
            return E(found[results[0][0]])
        if not columns:
            return E(F.to_variant_object(found), T.VariantType())
        name = args[0].name or "series"
        out = E(found[results[0][0]])
        out.columns = [(f"{names.split()[0]}_{name}_{n}", found[n]) for n, _ in results]
        return out


_ARRAY = [("y", "array<double>")]
series_udf("series_fill_forward", 1, 2, lambda y, *_: (fill_forward(y),), _ARRAY)
series_udf("series_fill_backward", 1, 2, lambda y, *_: (fill_forward(y[::-1])[::-1],), _ARRAY)
series_udf("series_fill_linear", 1, 4, lambda y, *_: (fill_linear(y),), _ARRAY)


def fir(y: np.ndarray, weights, normalize=True, center=False):
    w = np.array(weights, float)
    if normalize is not False and w.sum():
        w = w / w.sum()
    full = np.convolve(y, w)
    start = (len(w) - 1) // 2 if center else 0
    return (full[start : start + len(y)],)


def iir(y: np.ndarray, ahead, back):
    b, a = np.array(ahead, float), np.array(back, float)
    out = np.zeros(len(y))
    for n in range(len(y)):
        v = sum(b[k] * y[n - k] for k in range(len(b)) if n >= k) - sum(a[k] * out[n - k] for k in range(1, len(a)) if n >= k)
        out[n] = v / a[0]
    return (out,)


series_udf("series_fir", 2, 4, fir, _ARRAY)
series_udf("series_iir", 3, 3, iir, _ARRAY)
series_udf("series_fft", 1, 2, lambda y, *_: (np.fft.fft(y).real, np.fft.fft(y).imag), [("real", "array<double>"), ("imag", "array<double>")])


@function("series_ifft", 1, 2, kind="U")
def _(ctx, args):
    @F.pandas_udf("`real` array<double>, `imag` array<double>")
    def run(re: pd.Series, im: pd.Series) -> pd.DataFrame:
        z = [np.fft.ifft(_values(a) + 1j * (_values(b) if b is not None and len(b) else np.zeros(len(a)))) for a, b in zip(re, im, strict=True)]
        return pd.DataFrame({"real": [list(v.real) for v in z], "imag": [list(v.imag) for v in z]})

    found = run(numbers(ctx, args[0]), numbers(ctx, args[1]) if len(args) > 1 else F.array().cast(SERIES))
    out = E(found["real"], SERIES)
    out.columns = [("series_ifft_real", found["real"]), ("series_ifft_imag", found["imag"])]
    return out


def fit_line(y: np.ndarray):
    y = fill_linear(y)
    x = np.arange(len(y))
    if len(y) < 2:
        return 0.0, 0.0, 0.0, 0.0, float(y[0]) if len(y) else None, list(y)
    slope, base = np.polyfit(x, y, 1)
    line = slope * x + base
    rest = y - line
    spread = y.var(ddof=1)
    r2 = 1 - (rest**2).sum() / ((y - y.mean()) ** 2).sum() if spread else 1.0
    return float(r2), float(slope), float(spread), float(rest.var(ddof=1)), float(base), line


_LINE = [("rsquare", "double"), ("slope", "double"), ("variance", "double"), ("rvariance", "double"), ("interception", "double"), ("line_fit", "array<double>")]
series_udf("series_fit_line", 1, 1, fit_line, _LINE)
series_udf("series_fit_line_dynamic", 1, 1, fit_line, _LINE, columns=False)


def fit_2lines(y: np.ndarray):
    y = fill_linear(y)
    best = None
    for k in range(2, len(y) - 1):
        left, right = fit_line(y[:k]), fit_line(y[k:])
        line = np.r_[np.asarray(left[5]), np.asarray(right[5])]
        error = ((y - line) ** 2).sum()
        if best is None or error < best[0]:
            best = (error, k, left, right, line)
    if best is None:
        one = fit_line(y)
        return one[0], 0, one[2], one[3], one[5], one[0], one[1], one[4], one[0], one[1], one[4]
    error, k, left, right, line = best
    whole = ((y - y.mean()) ** 2).sum()
    return float(1 - error / whole) if whole else 1.0, k, float(y.var(ddof=1)), float((y - line).var(ddof=1)), line, right[0], right[1], right[4], left[0], left[1], left[4]


_LINES = [
    ("rsquare", "double"), ("split_idx", "long"), ("variance", "double"), ("rvariance", "double"), ("line_fit", "array<double>"), ("right_rsquare", "double"), ("right_slope", "double"),
    ("right_interception", "double"), ("left_rsquare", "double"), ("left_slope", "double"), ("left_interception", "double"),
]
series_udf("series_fit_2lines", 1, 1, fit_2lines, _LINES)
series_udf("series_fit_2lines_dynamic", 1, 1, fit_2lines, _LINES, columns=False)


def fit_poly(y: np.ndarray, degree=1):
    y = fill_linear(y)
    x = np.arange(len(y))
    c = np.polyfit(x, y, int(degree))
    line = np.polyval(c, x)
    whole = ((y - y.mean()) ** 2).sum()
    return float(1 - ((y - line) ** 2).sum() / whole) if whole else 1.0, c[::-1], float(y.var(ddof=1)), float((y - line).var(ddof=1)), line


series_udf("series_fit_poly", 1, 2, fit_poly, [("rsquare", "double"), ("coefficients", "array<double>"), ("variance", "double"), ("rvariance", "double"), ("poly_fit", "array<double>")])


def period_of(y: np.ndarray) -> int:
    """The strongest period by autocorrelation, 0 without one."""
    y = fill_linear(y)
    z = y - y.mean()
    if len(z) < 4 or not z.any():
        return 0
    full = np.correlate(z, z, "full")[len(z) - 1 :]
    r = full / full[0]
    peaks = [k for k in range(2, len(r) - 1) if r[k] >= r[k - 1] and r[k] > r[k + 1] and k <= len(z) // 2]
    return max(peaks, key=lambda k: r[k]) if peaks and max(r[k] for k in peaks) > 0.2 else 0


def decompose(y: np.ndarray, seasonality=-1, trend="avg", keep=0):
    """Baseline, seasonal, trend, residual; the trend is fitted without the last `keep` points."""
    y = fill_linear(y)
    n = len(y)
    fitted = y[: n - int(keep or 0)] if keep else y
    period = period_of(fitted) if seasonality in (-1, None) else int(seasonality)
    x = np.arange(n)
    if trend == "linefit" and len(fitted) > 1:
        line = np.polyval(np.polyfit(np.arange(len(fitted)), fitted, 1), x)
    elif trend == "none":
        line = np.zeros(n)
    else:
        line = np.full(n, fitted.mean() if len(fitted) else 0.0)
    season = np.zeros(n)
    if period > 1:
        rest = fitted - line[: len(fitted)]
        means = np.array([rest[k::period].mean() if len(rest[k::period]) else 0.0 for k in range(period)])
        season = (means - means.mean())[x % period]
    base = line + season
    return base, season, line, y - base


def outlier_scores(y: np.ndarray, low=10.0, high=90.0) -> np.ndarray:
    """Distances beyond the range of two percentiles, in units of that range."""
    a, b = np.percentile(y, [low, high])
    width = (b - a) or 1e-9
    return np.where(y > b, (y - b) / width, np.where(y < a, (y - a) / width, 0.0))


def anomalies(y: np.ndarray, threshold=1.5, seasonality=-1, trend="avg", keep=0, *_):
    base, _, _, rest = decompose(y, seasonality, trend, keep)
    score = outlier_scores(rest)
    return np.where(score > threshold, 1.0, np.where(score < -threshold, -1.0, 0.0)), score, base


series_udf("series_decompose", 1, 5, lambda y, s=-1, t="avg", k=0, *_: decompose(y, s, t, k), [(n, "array<double>") for n in ("baseline", "seasonal", "trend", "residual")])
series_udf("series_decompose_anomalies", 1, 7, anomalies, [(n, "array<double>") for n in ("ad_flag", "ad_score", "baseline")])
series_udf("series_decompose_forecast", 2, 5, lambda y, points=0, s=-1, t="linefit", *_: (decompose(y, s, t, points)[0],), [("forecast", "array<double>")])
series_udf("series_outliers", 1, 5, lambda y, kind=None, ignore=None, low=10.0, high=90.0: (outlier_scores(y, float(low or 10), float(high or 90)),), _ARRAY)


def seasonal(y: np.ndarray, period=None):
    return (decompose(y, -1 if period is None else period)[1],)


series_udf("series_seasonal", 1, 2, seasonal, _ARRAY)


def periods(y: np.ndarray, low=None, high=None, count=1, *_):
    y = fill_linear(y)
    z = y - y.mean()
    if len(z) < 4 or not z.any():
        return [0.0], [0.0]
    full = np.correlate(z, z, "full")[len(z) - 1 :]
    r = full / full[0]
    peaks = [k for k in range(2, len(r) - 1) if r[k] >= r[k - 1] and r[k] > r[k + 1] and (low is None or k >= low) and (high is None or k <= high)]
    peaks.sort(key=lambda k: -r[k])
    chosen = peaks[: int(count or 1)] or [0]
    return [float(k) for k in chosen], [float(max(0.0, r[k])) if k else 0.0 for k in chosen]


def validate(y: np.ndarray, *candidates):
    flat = [float(c) for group in candidates for c in (group if isinstance(group, list) else [group])]
    y = fill_linear(y)
    z = y - y.mean()
    full = np.correlate(z, z, "full")[len(z) - 1 :]
    return flat, [float(max(0.0, full[int(c)] / full[0])) if 0 < c < len(z) and full[0] else 0.0 for c in flat]


_PERIODS = [("periods", "array<double>"), ("scores", "array<double>")]
series_udf("series_periods_detect", 1, 5, periods, _PERIODS)
series_udf("series_periods_validate", 2, 16, validate, _PERIODS)
