"""Fitting a byte convolutional network on a bounded sample of labelled texts and scoring whole tables with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.bytecnn import ByteConvNet
from sluice.llm.common import Collector, rows

#: Bounds of the sample: texts of each class (as expected by their hash), of which all windows count, and windows at all;
#: beyond that (very long texts, very many rows with one id) those with the least hash are taken.
#: Beyond FULL_CLASSES classes, the texts of each are fewer, at least one, so that the whole sample stays as large.
PER_CLASS = 1000
MOST_WINDOWS = 60_000
FULL_CLASSES = 64
#: Windows that go through the network at once.
BATCH_WINDOWS = 256


def remainder(column, modulus: int):
    """crc32 of the id as text, mod the modulus; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(modulus)


def share(column):
    """A fixed number in [0, 1) for each id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(17), F.col(column)), 11) / F.lit(float(1 << 53))


def class_shares(labelled: DataFrame, label: str, per_class: int) -> dict:
    """The share of each class's rows to take. One counting pass; its result has a row for each class."""
    counts = labelled.groupBy(label).count().collect()
    texts = max(1.0, per_class * min(1.0, FULL_CLASSES / max(1, len(counts))))
    return {r[label]: min(1.0, texts / r["count"]) for r in sorted(counts, key=lambda r: r[label])}


def sampled(labelled: DataFrame, label: str, shares: dict, id_column: str = "doc_id") -> DataFrame:
    """The rows whose fixed number is below their class's share."""
    kind = labelled.schema[label].dataType
    limits = F.create_map(*[c for value, part in shares.items() for c in (F.lit(value).cast(kind), F.lit(part))])
    return labelled.where(share(id_column) < F.coalesce(limits[F.col(label)], F.lit(0.0)))


def fit(texts: DataFrame, label: str, classes: list, steps: int, most_windows: int = MOST_WINDOWS, **shape) -> ByteConvNet:
    """texts: the sample, with columns doc_id, text and the label. Only its windows come to the driver, most_windows at
    most. Each text weighs the same in its class, and each class the same."""
    net = ByteConvNet(len(classes), **shape)
    number = {value: k for k, value in enumerate(classes)}
    schema = pa.schema([("doc_id", pa.int64()), ("class", pa.int32()), ("at", pa.int64()), ("window", pa.binary())])

    def cut(batches) -> Iterator[pa.RecordBatch]:
        out = Collector(schema)
        for key, value, text in rows(batches, "doc_id", "label", "text"):
            for at, w in enumerate(net.windows((text or "").encode())):
                yield from out.add(key, number[value], at, w.tobytes(), weight=net.window)
        yield from out.flush()

    found = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"), "text").mapInArrow(cut, "doc_id long, class int, at long, window binary")
    order = [F.xxhash64("doc_id", "at", "window"), F.col("doc_id"), F.col("at"), F.col("class"), F.col("window")]
    taken = found.orderBy(*order).limit(most_windows).toArrow()
    if taken.num_rows:
        x = np.frombuffer(b"".join(taken.column("window").to_pylist()), np.uint8).reshape(-1, net.window)
        y = taken.column("class").to_numpy()
        # a missing id is an id like any other
        key = taken.column("doc_id").fill_null(-(1 << 63)).to_numpy()
        _, text_of, windows = np.unique(np.stack([key, y]), axis=1, return_inverse=True, return_counts=True)
        weight = 1 / windows[text_of.ravel()]
        for k in range(len(classes)):
            weight[y == k] /= max(weight[y == k].sum(), 1e-9)
        net.fit(x, y, weight, steps=steps)
    return net


def class_logs(net: ByteConvNet, texts: list[bytes]) -> np.ndarray:
    """Mean log-probability of each class over the windows of each text; windows of many texts go together."""
    sums = np.zeros((len(texts), net.classes))
    counts = np.zeros(len(texts))
    pending, owners, held = [], [], 0

    def flush() -> None:
        nonlocal held
        if held:
            z = net.logits(net.pool(np.concatenate(pending) if len(pending) > 1 else pending[0]))
            z = z - z.max(1, keepdims=True)
            logs = z - np.log(np.exp(z).sum(1, keepdims=True))
            own = np.repeat([k for k, _ in owners], [n for _, n in owners])
            for c in range(net.classes):
                sums[:, c] += np.bincount(own, logs[:, c], len(texts))
            counts[:] += np.bincount(own, minlength=len(texts))
            pending.clear()
            owners.clear()
            held = 0

    for k, data in enumerate(texts):
        w = net.windows(data)
        for at in range(0, len(w), BATCH_WINDOWS):
            part = w[at : at + BATCH_WINDOWS]
            pending.append(part)
            owners.append((k, len(part)))
            held += len(part)
            if held >= BATCH_WINDOWS:
                flush()
    flush()
    return sums / np.maximum(counts, 1)[:, None]


def score(docs: DataFrame, columns: list[tuple[str, str, pa.DataType]], of, keep=("doc_id",)) -> DataFrame:
    """Apply of(texts) -> lists for the columns to the text of every row; keeps the named columns besides."""
    kept = docs.select(*keep) if "text" in keep else docs.select(*keep, F.col("text").alias("__text"))
    where = kept.columns.index("text" if "text" in keep else "__text")
    fields = [f for f in kept.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{n}` {t}" for n, t, _ in columns])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                values = of(part.column(where).to_pylist())
                arrays = [part.column(i) for i in range(len(fields))] + [pa.array(v, type=t) for v, (_, _, t) in zip(values, columns, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields] + [n for n, _, _ in columns])

    return kept.mapInArrow(run, schema)
