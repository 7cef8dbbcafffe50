"""Language identification by a byte convolutional network over batched windows of fixed length.

Filters of two widths, max pooling and softmax are trained in numpy on labelled texts (see textmodel for the sample's
bounds); every value of lang is a class, however many. A text's language has the highest mean log-probability over all its windows; ties go to the smaller language
name. Defined results: null texts and texts without a letter are `und` with score 0; without any labelled row all are
`und`; repeated rows are each answered; an empty table gives an empty table; further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import textmodel

FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"


def fit(docs: DataFrame, per_class: int = textmodel.PER_CLASS, steps: int = 400):
    """(languages, network) learned from text and non-null lang of the rows outside the held-out fold."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (textmodel.remainder("doc_id", FOLDS) != HELD_OUT))
    shares = textmodel.class_shares(labelled, "lang", per_class)
    classes = list(shares)
    if not classes:
        return [], None
    return classes, textmodel.fit(textmodel.sampled(labelled, "lang", shares), "lang", classes, steps)


def predictor(classes: list, net):
    """A function from texts to their languages and scores."""

    def of(texts: list) -> tuple[list, list]:
        if net is None:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        logs = textmodel.class_logs(net, [(t or "").encode() for t in texts])
        best = logs.argmax(1)
        p = np.exp(logs - logs.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True)).max(1)
        lettered = [t is not None and any(map(str.isalpha, t)) for t in texts]
        return [classes[k] if ok else UNDETERMINED for k, ok in zip(best, lettered, strict=True)], [float(v) if ok else 0.0 for v, ok in zip(p, lettered, strict=True)]

    return of


def predict(docs: DataFrame, model, keep=("doc_id",), names=("lang_pred", "score")) -> DataFrame:
    """Adds the prediction and its score, under the given names, to the kept columns of docs."""
    return textmodel.score(docs, [(names[0], "string", pa.string()), (names[1], "double", pa.float64())], predictor(*model), keep)


def identify(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    out = predict(docs.select("doc_id", "text"), fit(docs, **settings))
    return out.select("doc_id", (textmodel.remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
