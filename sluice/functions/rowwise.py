"""Functions of the order of rows: windows over the last sort of the pipeline.

Inside mv-apply and partition the windows are split by the hidden keys. Without a sort the order is the rows' place in
the table, which is fixed for a file but not a guarantee.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.registry import raw
from sluice.plans.expr import E, as_numeric, compile_expr, q, truth

LONG = T.LongType()


def order_of(ctx) -> list[Column]:
    return list(ctx.order) if ctx.order else [F.monotonically_increasing_id().asc()]


def window(ctx, *more: Column):
    keys = [q(h) for h in ctx.hidden] + list(more)
    return Window.partitionBy(*keys).orderBy(*order_of(ctx)) if keys else Window.orderBy(*order_of(ctx))


def restarted(ctx, call, place: int) -> tuple:
    """Windows that begin anew where the argument at a place is true."""
    if len(call.args) <= place:
        return ()
    flag = truth(ctx, compile_expr(ctx, call.args[place]))
    return (F.sum(F.when(flag, 1).otherwise(0)).over(window(ctx).rowsBetween(Window.unboundedPreceding, 0)),)


def _staged(ctx, groups: tuple):
    """A window may not hold another: run counts become a column first."""
    if not groups:
        return ()
    name = f"__run{len(ctx.df.columns)}"
    ctx.df = ctx.df.withColumn(name, groups[0])
    ctx.carried = [*ctx.carried, name]
    return (q(name),)


@raw("row_number", 0, 2, kind="W")
def _(ctx, call):
    start = compile_expr(ctx, call.args[0]).column if call.args else F.lit(1)
    groups = _staged(ctx, restarted(ctx, call, 1))
    return E((F.row_number().over(window(ctx, *groups)) - 1 + start).cast("long"), LONG)


@raw("row_cumsum", 1, 2, kind="W")
def _(ctx, call):
    n = as_numeric(ctx, compile_expr(ctx, call.args[0]))
    groups = _staged(ctx, restarted(ctx, call, 1))
    return E(F.sum(n.column).over(window(ctx, *groups).rowsBetween(Window.unboundedPreceding, 0)))


def _ranked(names: str, dense: bool):
    @raw(names, 1, 2, kind="W")
    def _(ctx, call):
        """Rows of neighbouring equal values share a rank."""
        value = compile_expr(ctx, call.args[0]).column
        groups = _staged(ctx, restarted(ctx, call, 1))
        w = window(ctx, *groups)
        changed = F.coalesce((~value.eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
        first = F.row_number().over(w) == 1
        name = f"__rank{len(ctx.df.columns)}"
        ctx.df = ctx.df.withColumn(name, F.when(first, 1).otherwise(changed)).withColumn(name + "n", F.row_number().over(w))
        ctx.carried = [*ctx.carried, name, name + "n"]
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        return E((F.sum(q(name)).over(run) if dense else F.max(F.when(q(name) == 1, q(name + "n"))).over(run)).cast("long"), LONG)


_ranked("row_rank_dense", True)
_ranked("row_rank row_rank_min", False)


def _beside(name: str, build):
    @raw(name, 1, 3, kind="W")
    def _(ctx, call):
        value = compile_expr(ctx, call.args[0])
        n = int(compile_expr(ctx, call.args[1]).constant) if len(call.args) > 1 else 1
        out = build(value.column, n).over(window(ctx))
        if len(call.args) > 2:
            there = build(F.lit(True), n).over(window(ctx))
            out = F.when(there, out).otherwise(compile_expr(ctx, call.args[2]).column)
        return E(out, value.type)


_beside("prev", F.lag)
_beside("next", F.lead)


@raw("row_window_session", 3, 4, kind="W")
def _(ctx, call):
    """The first moment of the session of each row: a session ends with a gap or a length beyond the bounds."""
    when = compile_expr(ctx, call.args[0])
    most, gap = (compile_expr(ctx, a).column for a in call.args[1:3])
    w = window(ctx)
    before = F.lag(when.column).over(w)
    fresh = before.isNull() | (when.column - before > gap)
    if len(call.args) > 3:
        fresh = fresh | truth(ctx, compile_expr(ctx, call.args[3]))
    name = f"__session{len(ctx.df.columns)}"
    ctx.df = ctx.df.withColumn(name, fresh.cast("int"))
    ctx.df = ctx.df.withColumn(name, F.sum(q(name)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ctx.carried = [*ctx.carried, name]
    inner = window(ctx, q(name))
    first = F.first(when.column).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    # within a run without gaps, sessions of at most the given length
    part = F.floor(_seconds(when.column - first) / F.greatest(_seconds(most), F.lit(1e-6)))
    name2 = name + "p"
    ctx.df = ctx.df.withColumn(name2, part)
    ctx.carried = [*ctx.carried, name2]
    return E(F.first(when.column).over(window(ctx, q(name), q(name2)).rowsBetween(Window.unboundedPreceding, 0)), when.type)


def _seconds(span: Column) -> Column:
    from sluice.plans.expr import micros

    return micros(span).cast("double") / 1e6
