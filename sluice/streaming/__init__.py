"""Pipelines over streams: the same operators compile over a streaming DataFrame.

A summarize by bin(ts, step) of a stream needs a watermark so that its groups can be closed; `open_stream` sets it on the
time column. Operators that need the whole table (sort, row order) are refused by Spark's own analysis.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sluice.engine import Engine


def open_stream(spark: SparkSession, path: str, schema: T.StructType, time: str | None = None, late: str = "10 minutes", kind: str = "parquet", **options) -> DataFrame:
    """A folder as a stream; a TIMESTAMP_NTZ time column becomes TIMESTAMP, which watermarks need."""
    df = spark.readStream.format(kind).schema(schema).options(**options).load(path)
    if time is None:
        return df
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling(df: DataFrame, time: str, width: str, aggregates: list, by: tuple[str, ...] = ()) -> DataFrame:
    return _windowed(df, F.window(time, width), aggregates, by)


def sliding(df: DataFrame, time: str, width: str, slide: str, aggregates: list, by: tuple[str, ...] = ()) -> DataFrame:
    return _windowed(df, F.window(time, width, slide), aggregates, by)


def sessions(df: DataFrame, time: str, gap: str, aggregates: list, by: tuple[str, ...] = ()) -> DataFrame:
    return _windowed(df, F.session_window(time, gap), aggregates, by)


def _windowed(df: DataFrame, window, aggregates: list, by: tuple[str, ...]) -> DataFrame:
    grouped = df.groupBy(window.alias("w"), *by).agg(*aggregates)
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in grouped.columns if c != "w"])


def distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows not seen before within the watermark; the state is bounded by it."""
    return df.dropDuplicatesWithinWatermark(columns)


def run(engine: Engine, text: str, streams: dict[str, DataFrame], sink: str, checkpoint: str, mode: str = "append", kind: str = "parquet", **trigger) -> StreamingQuery:
    """Start a pipeline over named streams into a folder (or the memory table `sink`)."""
    for name, df in streams.items():
        engine.register_table(name, df)
    writer = engine.query(text).writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(**(trigger or {"availableNow": True}))
    return writer.format("memory").queryName(sink).start() if kind == "memory" else writer.format(kind).option("path", sink).start()
