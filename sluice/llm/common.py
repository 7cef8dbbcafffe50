"""Shared helpers: durable intermediate tables and streaming over Arrow batches."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIRS: list[tuple[object, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the session names none: the context's checkpoint folder, else in
    local mode a temporary one, and on a cluster the warehouse, as its machines do not share their temporary folders."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if (base := spark.sparkContext.getCheckpointDir()) is not None:
        return str(base).rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/sluice-scratch"
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
    return str(spark.sparkContext.getCheckpointDir()).rstrip("/")


def _drop(sc, path: str) -> None:
    try:
        if sc._jsc is None:
            return
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is scratch space
        return


def durable(df: DataFrame, name: str = "part", codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, gives exact sizes.

    The tables go when the interpreter ends. Shuffle files of what came before are given up.
    """
    return durable_parts([df], name, codec)


def durable_parts(parts: Iterable[DataFrame], name: str = "part", codec: str = "snappy") -> DataFrame:
    """One such table of several frames of one schema, written one after another; at least one."""
    path = ""
    for df in parts:
        spark = df.sparkSession
        path = path or f"{shared_dir(spark)}/sluice-{name}-{uuid.uuid4().hex}"
        df.write.mode("append").option("parquet.compression.codec.zstd.level", "1").parquet(path, compression=codec)
    if not _DIRS:
        atexit.register(lambda: [_drop(sc, p) for sc, p in _DIRS])
    _DIRS.append((spark.sparkContext, path))
    # plans that are no longer needed go now, and Spark deletes their shuffle files
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


#: Ids (8 bytes each) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def few(ids: DataFrame) -> DataFrame:
    """A durable table of ids, to be broadcast where its counted rows allow it."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def release(df: DataFrame) -> None:
    """Delete the files of a durable() table that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/sluice-" in path:
            _drop(spark.sparkContext, path)


def text_of(df: DataFrame, column: str = "text"):
    """The text column with null read as the empty string."""
    return F.coalesce(F.col(column), F.lit(""))


def rows(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns, a slice at a time so that few Python objects live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


class Collector:
    """Gathers result rows and hands out Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 4096, most_bytes: int = 8 << 20):
        self.schema, self.most, self.most_bytes = schema, most, most_bytes
        self.columns: list[list] = [[] for _ in schema]
        self.bytes = 0

    def add(self, *values, weight: int = 0) -> Iterator[pa.RecordBatch]:
        for column, value in zip(self.columns, values, strict=True):
            column.append(value)
        self.bytes += weight
        if len(self.columns[0]) >= self.most or self.bytes >= self.most_bytes:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.columns[0]:
            arrays = [pa.array(c, type=f.type) for c, f in zip(self.columns, self.schema, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=self.schema)
        self.columns, self.bytes = [[] for _ in self.schema], 0
