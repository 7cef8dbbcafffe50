"""Functions of the session and of stored data."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.registry import function, raw, unsupported
from sluice.lang.diagnostics import TRANSLATION, QueryError
from sluice.plans.expr import E, as_string, compile_expr

STRING, LONG, BOOL = T.StringType(), T.LongType(), T.BooleanType()


@function("current_database", 0, kind="M")
def _(ctx, args):
    return E(F.current_database(), STRING)


@function("current_cluster_endpoint", 0, kind="M")
def _(ctx, args):
    return E(F.lit(ctx.engine.spark.sparkContext.master), STRING)


@function("current_principal", 0, 1, kind="M")
def _(ctx, args):
    return E(F.current_user(), STRING)


@function("current_principal_details", 0, kind="M")
def _(ctx, args):
    return E(F.to_variant_object(F.struct(F.current_user().alias("UserPrincipalName"), F.current_user().alias("DisplayName"))), T.VariantType())


@function("current_principal_is_member_of", 1, None, kind="M")
def _(ctx, args):
    hit = F.lit(False)
    for a in args:
        hit = hit | (as_string(ctx, a) == F.current_user())
    return E(hit, BOOL)


@raw("column_names_of", 1, kind="M")
def _(ctx, call):
    return E(F.array(*map(F.lit, ctx.engine.table_of(ctx, call.args[0]).columns)), T.ArrayType(STRING))


@raw("estimate_data_size", 1, None)
def _(ctx, call):
    from sluice.lang import ast as A
    from sluice.plans.expr import q

    args = [compile_expr(ctx, a) for a in call.args if not isinstance(a, A.Star)] or [E(q(c)) for c in ctx.columns()]
    out = F.lit(0)
    for a in args:
        out = out + F.coalesce(F.octet_length(as_string(ctx, a)), F.lit(0))
    return E(out.cast("long"), LONG)


@raw("toscalar", 1, kind="M")
def _(ctx, call):
    """The first column of the first row, as a subquery of the plan."""
    from sluice.plans.expr import q

    table = ctx.engine.table_of(ctx, call.args[0])
    return E(table.limit(1).select(q(table.columns[0])).scalar(), table.schema[0].dataType)


def _metadata(name: str, field: str, t):
    @raw(name, 0, kind="M")
    def _(ctx, call):
        """Of the file that a row comes from; null where the rows come from no file."""
        try:
            found = ctx.df.select(F.col(f"_metadata.{field}").alias("x")).schema[0].dataType
        except Exception:  # noqa: BLE001  Spark has no gentler way to ask
            found = None
        return E(F.col(f"_metadata.{field}").cast(t) if found is not None else F.lit(None).cast(t), t)


_metadata("ingestion_time", "file_modification_time", T.TimestampNTZType())
_metadata("extent_id", "file_path", STRING)
_metadata("extent_tags", "file_path", STRING)


def _tables(names: str):
    for n in names.split():

        @raw(n, 1, kind="M")
        def _(ctx, call, n=n):
            raise QueryError(TRANSLATION, f"{n}() names a table and cannot stand in an expression")


_tables("cluster database external_table materialized_view stored_query_result table")
unsupported("current_cursor cursor_after cursor_before_or_at cursor_current")
