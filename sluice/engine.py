"""The engine: scripts in, lazy DataFrames out.

Text becomes tokens, then a syntax tree, then DataFrame operations; Catalyst's logical plan is the only intermediate form.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import sluice.operators  # noqa: F401  registers the operators
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.lang import ast as A
from sluice.lang.diagnostics import MISSING, SCOPE, TRANSLATION, Diagnostic, QueryError
from sluice.lang.parser import parse
from sluice.operators.core import apply, wildcard
from sluice.plans import types as K
from sluice.plans.expr import Context, E, Scope, compile_expr, quoted
from sluice.sources import readers, sinks


@dataclass
class Explanation:
    tree: str
    plan: str
    seconds: dict[str, float]
    diagnostics: list[Diagnostic] = field(default_factory=list)


class Engine:
    """Queries over the tables that it was given and those of the session's catalog."""

    def __init__(self, spark: SparkSession, compat: str = "language", **options):
        self.spark = spark
        self.options: dict[str, Any] = {"compat": compat, **options}
        self.tables: dict[str, DataFrame] = {}
        self.scalars: dict[str, Callable] = {}
        self.tabulars: dict[str, Callable] = {}
        self.plugins: dict[str, Callable] = {}
        self.groups: dict[str, list[str]] = {}
        self.graphs: dict[int, Any] = {}
        self.results: dict[str, DataFrame] = {}
        self.last_render: dict | None = None
        self.diagnostics: list[Diagnostic] = []

    # ---- registration -----------------------------------------------------------------------------------------

    def register_table(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df

    def register_scalar(self, name: str, function: Callable) -> None:
        """function(*columns) -> column."""
        self.scalars[name.lower()] = function

    def register_tabular(self, name: str, function: Callable) -> None:
        """function(df, *values) -> df, for invoke."""
        self.tabulars[name.lower()] = function

    def register_plugin(self, name: str, function: Callable) -> None:
        """function(df, *syntax trees) -> df, for evaluate."""
        self.plugins[name.lower()] = function

    def register_entity_group(self, name: str, tables: list[str]) -> None:
        self.groups[name.lower()] = tables

    def load_file(self, path: str | list[str], table: str, kind: str | None = None, schema: T.StructType | None = None, **options) -> DataFrame:
        """A table from one file or several of one kind; options go to the reader."""
        df = readers.read(self.spark, [path] if isinstance(path, str) else path, kind, schema, **options)
        self.register_table(table, df)
        return df

    def load_database(self, dsn: str, source: str, table: str | None = None, **options) -> DataFrame:
        """A table of a database, by DSN or JDBC address."""
        df = readers.jdbc(self.spark, dsn, source, **options)
        self.register_table(table or source, df)
        return df

    def load_folder(self, folder: str, names: list[str]) -> None:
        """Parquet tables of a folder by name."""
        for n in names:
            self.register_table(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))

    def analyze(self, table: str) -> None:
        """Statistics of a catalog table and its columns, for Spark's cost-based optimiser."""
        self.spark.sql(f"ANALYZE TABLE {quoted(table)} COMPUTE STATISTICS FOR ALL COLUMNS")

    def policy(self, name: str) -> None:
        """conservative: join order as written; aggressive: by cost, from the statistics that analyze() gathered."""
        if name not in ("conservative", "aggressive"):
            raise QueryError(TRANSLATION, f"unknown policy {name!r}")
        for key in ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled"):
            self.spark.conf.set(key, name == "aggressive")

    # ---- running ----------------------------------------------------------------------------------------------

    def query(self, text: str, params: dict[str, Any] | None = None) -> DataFrame:
        """The result of the script's last query; fork and facet leave all of theirs in `results`."""
        out = self.query_all(text, params)
        return out[-1]

    def query_arrow(self, text: str, params: dict[str, Any] | None = None):
        """The result as an Arrow table, which the driver must hold."""
        return self.query(text, params).toArrow()

    def query_all(self, text: str, params: dict[str, Any] | None = None) -> list[DataFrame]:
        self.diagnostics = []
        self.results = {}
        self.graphs = {}
        ctx = Context(self, Scope(), options=dict(self.options), diagnostics=self.diagnostics)
        out = self.script(ctx, parse(text), params or {})
        if not out:
            raise QueryError(TRANSLATION, "the script has no query")
        return [r if isinstance(r, DataFrame) else self.spark.range(1).select(r.column.alias(r.name or "Column1")) for r in out]

    def validate(self, text: str) -> list[Diagnostic]:
        """Parses and compiles; no job runs but for the few operators that must see data."""
        try:
            self.query_all(text)
        except QueryError as error:
            return [*self.diagnostics, error.diagnostic]
        return list(self.diagnostics)

    def explain(self, text: str, mode: str = "formatted") -> Explanation:
        began = time.perf_counter()
        tree = parse(text)
        parsed = time.perf_counter()
        df = self.query(text)
        compiled = time.perf_counter()
        jvm = self.spark._jvm
        plan = df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
        return Explanation("\n".join(map(repr, tree.statements)), plan, {"parse": parsed - began, "compile": compiled - parsed}, list(self.diagnostics))

    def write(self, text: str, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
        sinks.write(self.query(text), path, kind, mode)

    # ---- scripts ----------------------------------------------------------------------------------------------

    def script(self, ctx: Context, script: A.Script, params: dict[str, Any]) -> list[DataFrame | E]:
        out: list[DataFrame | E] = []
        for s in script.statements:
            if isinstance(s, A.Let):
                ctx.scope.bind(s.name, self.let_value(ctx, s.value))
            elif isinstance(s, A.SetOption):
                ctx.options[s.name.lower()] = s.value.value if isinstance(s.value, A.Literal) else s.value
            elif isinstance(s, A.Parameters):
                for name, kind, default in s.items:
                    ctx.scope.bind(name, self.parameter(ctx, name, kind, default, params))
            elif isinstance(s, A.Pipeline):
                out.append(self.pipeline_or_value(ctx, s))
        return out

    def parameter(self, ctx: Context, name: str, kind: str, default: A.Expr | None, params: dict[str, Any]) -> E:
        given = {k.lower(): v for k, v in params.items()}
        if name.lower() in given:
            column, t = K.literal(kind, given[name.lower()])
            return E(column, t, constant=given[name.lower()], kind=kind)
        if default is None:
            raise QueryError(SCOPE, f"parameter {name!r} has no value")
        return compile_expr(ctx.with_(df=None), default)

    def let_value(self, ctx: Context, value):
        if isinstance(value, A.Lambda):
            return value
        return self.pipeline_or_value(ctx, value)

    def pipeline_or_value(self, ctx: Context, p: A.Pipeline) -> DataFrame | E:
        """A pipeline without operators may be a scalar."""
        if p.ops or p.source is None:
            return self.pipeline(ctx, p)
        if self.names_table(ctx, p.source):
            return self.table_of(ctx, p.source)
        return compile_expr(ctx.with_(df=None), p.source)

    def names_table(self, ctx: Context, e: A.Expr) -> bool:
        if isinstance(e, A.Datatable | A.Sub | A.Pattern):
            return True
        if isinstance(e, A.Name):
            return self.is_table(ctx, e.name)
        if isinstance(e, A.Member):
            return not isinstance(ctx.scope.find(_dotted(e).split(".")[0]), E) and self.lookup(_dotted(e)) is not None
        if isinstance(e, A.Call):
            name = e.name.lower()
            if name in ("materialize", "union", "table", "cluster", "database", "external_table", "materialized_view", "stored_query_result", "view", "totable") or name in self.tabulars:
                return True
            bound = ctx.scope.find(e.name)
            return isinstance(bound, A.Lambda) and self.is_tabular(ctx, bound)
        return False

    def is_tabular(self, ctx: Context, f: A.Lambda) -> bool:
        last = f.body.statements[-1] if f.body.statements else None
        if not isinstance(last, A.Pipeline):
            return False
        if last.ops or last.source is None:
            return True
        inner = {s.name.lower() for s in f.body.statements if isinstance(s, A.Let)} | {n.lower() for n, k, _ in f.params if k == "table"}
        return isinstance(last.source, A.Name) and last.source.name.lower() in inner or self.names_table(ctx, last.source)

    def pipeline(self, ctx: Context, p: A.Pipeline) -> DataFrame:
        here = ctx.with_(df=None, order=None, hidden=[], carried=[], sides=None, aggregates=False)
        if p.source is not None:
            here = here.with_(df=self.table_of(here, p.source))
            if (g := self.graphs.get(id(here.df))) is not None:
                self.graphs[id(here.df)] = g
        for op in p.ops:
            here = apply(here, op)
        gone = [c for c in (*here.hidden, *here.carried) if c in here.df.columns]
        return here.df.drop(*gone) if gone else here.df

    def scope_with(self, ctx: Context, names: dict[str, Any]) -> Context:
        scope = Scope(ctx.scope)
        for n, v in names.items():
            scope.bind(n, v)
        return ctx.with_(scope=scope)

    # ---- tables -----------------------------------------------------------------------------------------------

    def lookup(self, name: str) -> DataFrame | None:
        low = {n.lower(): df for n, df in self.tables.items()}
        if name.lower() in low:
            return low[name.lower()]
        try:
            return self.spark.table(name) if self.spark.catalog.tableExists(name) else None
        except Exception:  # noqa: BLE001  a name that the catalog cannot parse is no table
            return None

    def is_table(self, ctx: Context, name: str) -> bool:
        bound = ctx.scope.find(name)
        return isinstance(bound, DataFrame) or bound is None and self.lookup(name) is not None

    def table_of(self, ctx: Context, e: A.Expr) -> DataFrame:
        if isinstance(e, A.Sub):
            return self.pipeline(ctx, e.pipeline)
        if isinstance(e, A.Name):
            bound = ctx.scope.find(e.name)
            if isinstance(bound, DataFrame):
                return bound
            if isinstance(bound, A.Lambda) and not bound.params:
                return self.call_lambda(ctx, bound, [])
            if (df := self.lookup(e.name)) is not None:
                return df
            raise QueryError(MISSING, f"no table {e.name!r}")
        if isinstance(e, A.Literal) and e.kind == "string":
            return self.table_of(ctx, A.Name(e.value))
        if isinstance(e, A.Pattern):
            found = self.matching_tables(ctx, e.text)
            if not found:
                raise QueryError(MISSING, f"no table is called {e.text!r}")
            from sluice.operators.combine import reconciled
            from sluice.operators.core import union_all

            return union_all(reconciled([df for _, df in found]))
        if isinstance(e, A.Star):
            return self.table_of(ctx, A.Pattern("*"))
        if isinstance(e, A.Datatable):
            return self.datatable(ctx, e)
        if isinstance(e, A.Member):
            name = _dotted(e)
            for n in (name, name.replace(".", "_"), name.rsplit(".", 1)[-1]):
                if (df := self.lookup(n)) is not None:
                    return df
            raise QueryError(MISSING, f"no table {name!r}")
        if isinstance(e, A.Call):
            return self.table_call(ctx, e)
        raise QueryError(TRANSLATION, "a table is needed here")

    def table_call(self, ctx: Context, e: A.Call) -> DataFrame:
        name = e.name.lower()
        bound = ctx.scope.find(e.name)
        if isinstance(bound, A.Lambda):
            return self.call_lambda(ctx, bound, e.args)
        if name == "materialize":
            # lazy and shared: Spark reuses what it can, and caches only what persist() names
            return self.table_of(ctx, e.args[0]).persist() if ctx.options.get("materialize_cache") else self.table_of(ctx, e.args[0])
        if name in ("totable", "view"):
            return self.table_of(ctx, e.args[0])
        if name == "toscalar":
            return self.table_of(ctx, e.args[0]).limit(1)
        if name == "union":
            from sluice.operators.core import OPERATORS

            tables = [a for a in e.args if not isinstance(a, A.Named)]
            return OPERATORS["union"](ctx.with_(df=None), A.Op("union", {"tables": tables}, {})).df
        if name in ("table", "external_table", "materialized_view", "stored_query_result"):
            found = compile_expr(ctx.with_(df=None), e.args[0]).constant if not isinstance(e.args[0], A.Name) else e.args[0].name
            return self.table_of(ctx, A.Name(found))
        if name in self.tabulars:
            return self.call_table(ctx, e.name, e.args[1:], self.table_of(ctx, e.args[0]))
        raise QueryError(MISSING, f"no table function {e.name!r}")

    def matching_tables(self, ctx: Context, pattern: str) -> list[tuple[str, DataFrame]]:
        names = dict(self.tables)
        for t in self.spark.catalog.listTables():
            names.setdefault(t.name, None)
        rx = wildcard(pattern)
        return [(n, df if df is not None else self.spark.table(n)) for n, df in sorted(names.items()) if rx.fullmatch(n)]

    def entity_group(self, ctx: Context, e: A.Name) -> list[A.Expr]:
        if e.name.lower() not in self.groups:
            raise QueryError(MISSING, f"no entity group {e.name!r}")
        return [A.Name(n) for n in self.groups[e.name.lower()]]

    def datatable(self, ctx: Context, e: A.Datatable) -> DataFrame:
        """Inline rows of declared types, as one literal relation."""
        width = len(e.schema)
        if width == 0 or len(e.values) % width:
            raise QueryError(TRANSLATION, "the values of a datatable do not fill its rows")
        here = ctx.with_(df=None)
        types = [K.spark_type(t) for _, t in e.schema]
        if not e.values:
            return self.spark.createDataFrame([], T.StructType([T.StructField(n, t) for (n, _), t in zip(e.schema, types, strict=True)]))
        rows = []
        for at in range(0, len(e.values), width):
            cells = []
            for (n, _), t, v in zip(e.schema, types, e.values[at : at + width], strict=True):
                found = compile_expr(here, v)
                from sluice.plans.expr import as_variant

                c = (as_variant(here, found) if not isinstance(found.type, T.StringType) else found.column.cast("variant")) if isinstance(t, T.VariantType) else found.column.try_cast(t) if isinstance(found.type, T.StringType) else found.column.cast(t)
                cells.append(c.alias(n))
            rows.append(F.struct(*cells))
        return self.spark.range(1).select(F.inline(F.array(*rows)))

    # ---- functions --------------------------------------------------------------------------------------------

    def bound_arguments(self, ctx: Context, f: A.Lambda, args: list[A.Expr]) -> Scope:
        scope = Scope(ctx.scope)
        named = {a.names[0].lower(): a.value for a in args if isinstance(a, A.Named)}
        plain = [a for a in args if not isinstance(a, A.Named)]
        for k, (name, kind, default) in enumerate(f.params):
            value = named.get(name.lower(), plain[k] if k < len(plain) else default)
            if value is None:
                raise QueryError(SCOPE, f"argument {name!r} is missing")
            if kind == "table":
                scope.bind(name, self.table_of(ctx, value))
            else:
                e = compile_expr(ctx, value)
                spark = K.spark_type(kind)
                if not isinstance(spark, T.VariantType) and e.constant is None and e.type is not None and type(e.type) is not type(spark):
                    e = E(e.column.try_cast(spark), spark, e.name)
                scope.bind(name, e)
        return scope

    def call_lambda(self, ctx: Context, f: A.Lambda, args: list[A.Expr]) -> DataFrame:
        here = ctx.with_(scope=self.bound_arguments(ctx, f, args), df=None)
        out = self.script(here, f.body, {})
        if not out or not isinstance(out[-1], DataFrame):
            raise QueryError(TRANSLATION, "the function gives no table")
        return out[-1]

    def call_scalar(self, ctx: Context, f: A.Lambda, e: A.Call) -> E:
        here = ctx.with_(scope=self.bound_arguments(ctx, f, e.args))
        result = None
        for s in f.body.statements:
            if isinstance(s, A.Let):
                here.scope.bind(s.name, s.value if isinstance(s.value, A.Lambda) else compile_expr(here, s.value.source) if not s.value.ops else self.pipeline(here, s.value))
            elif isinstance(s, A.Pipeline):
                if s.ops:
                    raise QueryError(TRANSLATION, f"{e.name} gives a table and stands where a value is needed")
                result = compile_expr(here, s.source)
        if result is None:
            raise QueryError(TRANSLATION, f"{e.name} has no result")
        return E(result.column, result.type)

    def call_table(self, ctx: Context, name: str, args: list[A.Expr], df: DataFrame) -> DataFrame:
        bound = ctx.scope.find(name)
        if isinstance(bound, A.Lambda):
            scope = Scope(ctx.scope)
            scope.bind("__piped", df)
            return self.call_lambda(ctx.with_(scope=scope), bound, [A.Name("__piped"), *args])
        function = self.tabulars.get(name.lower())
        if function is None:
            raise QueryError(MISSING, f"no function {name!r}")
        here = ctx.with_(df=None)
        return function(df, *[compile_expr(here, a).constant for a in args])


def _dotted(e: A.Expr) -> str:
    if isinstance(e, A.Member):
        return f"{_dotted(e.object)}.{e.name}"
    if isinstance(e, A.Name):
        return e.name
    if isinstance(e, A.Call) and e.args and isinstance(e.args[-1], A.Literal):
        return str(e.args[-1].value)
    return ""

