"""Readers: files of several formats, inline rows, Arrow tables, JDBC."""

from __future__ import annotations

from pathlib import PurePosixPath
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import feather
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from sluice.lang.diagnostics import MISSING, PARAMETER, QueryError

#: Formats by their file endings.
FORMATS = {".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".parquet": "parquet", ".orc": "orc", ".txt": "txt", ".arrow": "arrow", ".feather": "arrow"}


def format_of(uri: str) -> str:
    path = PurePosixPath(uri.split("?")[0].rstrip("/"))
    for suffix in reversed(path.suffixes):
        if suffix.lower() in FORMATS:
            return FORMATS[suffix.lower()]
    raise QueryError(PARAMETER, f"the format of {uri!r} is not known")


def read(spark: SparkSession, uris: list[str], kind: str | None = None, schema: T.StructType | None = None, header: bool = True, **options) -> DataFrame:
    """A table from files. With a schema nothing is inferred, so no file is read before the query runs. Options are those of
    Spark's reader (multiLine for quoted line breaks in CSV, samplingRatio for inference)."""
    kind = (kind or format_of(uris[0])).lower()
    try:
        reader = (spark.read if schema is None else spark.read.schema(_without_variants(schema))).options(**options)
        if kind in ("csv", "tsv", "psv"):
            reader = reader.options(header=header, sep={"csv": ",", "tsv": "\t", "psv": "|"}[kind])
            return _variants((reader if schema is not None else reader.option("inferSchema", True)).csv(uris), schema)
        if kind in ("json", "multijson"):
            return _variants(reader.option("multiLine", True).json(uris), schema)
        if kind in ("jsonl", "ndjson"):
            return _variants(reader.json(uris), schema)
        if kind == "parquet":
            df = spark.read.parquet(*uris)
            return df if schema is None else df.select(*[df[f.name].cast(f.dataType) for f in schema.fields])
        if kind == "orc":
            return reader.orc(uris)
        if kind in ("txt", "raw"):
            df = spark.read.text(uris)
            return df.withColumnRenamed("value", schema.fields[0].name) if schema is not None else df
        if kind == "arrow":
            return _arrow_files(spark, uris)
    except QueryError:
        raise
    except Exception as error:
        raise QueryError(MISSING, f"cannot read {uris[0]!r}: {str(error).splitlines()[0][:200]}") from error
    raise QueryError(PARAMETER, f"unknown format {kind!r}")


def _arrow_files(spark: SparkSession, uris: list[str]) -> DataFrame:
    """Arrow IPC files, each read by one task; the first one's schema holds for all."""

    def schema_of(batches):
        for batch in batches:
            for content in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([feather.read_table(pa.BufferReader(content.as_buffer())).schema.serialize().to_pybytes()])], names=["schema"])

    first = spark.read.format("binaryFile").load(uris[0]).select("content").limit(1).mapInArrow(schema_of, "schema binary").first()
    if first is None:
        raise QueryError(MISSING, f"no file {uris[0]!r}")
    schema = pa.ipc.read_schema(pa.BufferReader(bytes(first[0])))

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                yield from feather.read_table(pa.BufferReader(content.as_buffer())).select(schema.names).cast(schema).to_batches()

    return spark.read.format("binaryFile").load(uris).select("content").mapInArrow(run, from_arrow_schema(schema))


#: JDBC's names of the databases that a DSN may name.
DATABASES = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "mariadb": "mariadb", "sqlserver": "sqlserver", "sqlite": "sqlite", "duckdb": "duckdb"}


def jdbc_target(dsn: str) -> tuple[str, dict[str, str]]:
    """The JDBC address and options of a DSN such as postgres://user:password@host:5432/base or sqlite:/data/file.db."""
    if dsn.startswith("jdbc:"):
        return dsn, {}
    scheme, _, rest = dsn.partition(":")
    if scheme.lower() not in DATABASES:
        raise QueryError(PARAMETER, f"no database is known for {scheme!r}")
    name = DATABASES[scheme.lower()]
    if not rest.startswith("//") or name in ("sqlite", "duckdb"):
        return f"jdbc:{name}:{rest.removeprefix('//')}", {}
    parts = urlsplit(dsn)
    options = {k: unquote(v) for k, v in (("user", parts.username), ("password", parts.password)) if v is not None}
    where = f"{parts.hostname}:{parts.port}" if parts.port else f"{parts.hostname}"
    base = parts.path.lstrip("/")
    query = f"?{parts.query}" if parts.query else ""
    return (f"jdbc:sqlserver://{where};databaseName={base}" if name == "sqlserver" else f"jdbc:{name}://{where}/{base}{query}"), options


def _without_variants(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.VariantType | T.DayTimeIntervalType) else f.dataType) for f in schema.fields])


def _variants(df: DataFrame, schema: T.StructType | None) -> DataFrame:
    from pyspark.sql import functions as F

    if schema is None:
        return df
    return df.select(*[F.try_parse_json(f.name).alias(f.name) if isinstance(f.dataType, T.VariantType) else df[f.name] for f in schema.fields])


def jdbc(spark: SparkSession, dsn: str, table: str, **options) -> DataFrame:
    """A table of a database, by DSN or JDBC address, whose driver is on the class path. Filters and columns are pushed to
    it; partitionColumn, lowerBound, upperBound and numPartitions split the reading."""
    url, known = jdbc_target(dsn)
    return spark.read.format("jdbc").options(url=url, dbtable=table, **{**known, **options}).load()


def arrow(spark: SparkSession, table) -> DataFrame:
    return spark.createDataFrame(table)
