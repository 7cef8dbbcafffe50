"""Document quality by a byte convolutional network over overlapping chunks that cover the whole document.

Learned filters are max-pooled over each chunk; the chunks' log odds are averaged over the document and, with the share
of good documents among the labels added, give one probability. Defined results: null texts are scored as empty ones;
without labels of both classes every score is the share of label 1 (0.5 without any); repeated rows are each answered;
repeated label rows count once, the lower label winning; an empty table gives an empty table; further columns of either
table are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import textmodel

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, steps: int = 700):
    """(log prior odds, network) learned from the labelled rows outside the held-out fold."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (textmodel.remainder("doc_id", FOLDS) != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    prior = math.log((good + 0.5) / (bad + 0.5))
    if not good or not bad:
        return prior, None
    shares = {k: min(1.0, per_class / n) for k, n in counts.items()}
    # at most a few thousand ids, by the bound of the sample
    sample = F.broadcast(textmodel.sampled(known, "quality", shares))
    texts = docs.select("doc_id", "text").join(sample, "doc_id")
    return prior, textmodel.fit(texts, "quality", [0, 1], steps)


def scorer(prior: float, net):
    def of(texts: list) -> tuple[list]:
        if net is None:
            return ([1 / (1 + math.exp(-prior))] * len(texts),)
        logs = textmodel.class_logs(net, [(t or "").encode() for t in texts])
        return ([float(v) for v in 1 / (1 + np.exp(-np.clip(logs[:, 1] - logs[:, 0] + prior, -60, 60)))],)

    return of


def predict(docs: DataFrame, model, keep=("doc_id",), names=("score", "predicted")) -> DataFrame:
    """Adds the score and the prediction, under the given names, to the kept columns of docs."""
    out = textmodel.score(docs, [(names[0], "double", pa.float64())], scorer(*model), keep)
    return out.withColumn(names[1], (F.col(names[0]) >= THRESHOLD).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    out = predict(docs.select("doc_id", "text"), fit(docs, labels, **settings))
    return out.select("doc_id", (textmodel.remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
