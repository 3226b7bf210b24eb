"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerline.llm.words import SPACE, distinct_in_rows, grams, slices, text_bytes, words_of

BITS = 20                    # hashed features: 2**20
SAMPLE_ROWS = 16_384         # labelled texts that the fit reads at most
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.1

#: Bytes between words: ASCII that is neither letter nor digit.
_BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
assert _BETWEEN[SPACE].all()


def _buckets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers of words, pairs, triples, and pairs over one and two words; with row ranges."""
    words = words_of(column, _BETWEEN)
    hashes = words.hashes(fold=True)
    kinds = [(1, 1), (2, 1), (3, 1), (2, 2), (2, 3)]
    shift = np.uint64(64 - BITS)
    return [((h >> shift).astype(np.int64), first)
            for h, first in (grams(hashes, words.first, n, step) for n, step in kinds)]


def _rows(first: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def _features(column: pa.Array) -> list[np.ndarray]:
    """Distinct features of each text."""
    kinds, n = _buckets(column), len(column)
    values = np.concatenate([v for v, _ in kinds])
    rows = np.concatenate([_rows(first) for _, first in kinds])
    order = np.argsort(rows, kind="stable")
    values, first = distinct_in_rows(
        values[order].astype(np.uint64) << np.uint64(64 - BITS), np.searchsorted(rows[order], np.arange(n + 1)))
    values = (values >> np.uint64(64 - BITS)).astype(np.int64)
    return [values[a:b] for a, b in zip(first, first[1:])]


class Ftrl:
    """FTRL-proximal with a rate per coordinate; L1 keeps most weights at zero, the bias is free."""

    def __init__(self, size: int = 1 << BITS):
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)
        self.size = size

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(np.asarray(at) == self.size, 0.0, L1)
        shrunk = z - np.sign(z) * l1
        return np.where(np.abs(z) <= l1, 0.0, -shrunk / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, self.size)
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


@dataclass(frozen=True)
class Model:
    """Buckets with a weight other than zero, their weights, and the bias; None if nothing was learned."""
    buckets: np.ndarray
    weights: np.ndarray
    bias: float | None


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id",
        label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """The weights learned from labelled texts.

    Labels are 0 or 1; rows with a null id, text or label teach nothing, an id with both
    labels counts as 1. At most ``sample_rows`` ids, the lowest by hash, are read: that
    bounds the list that is broadcast to the texts and the one task that learns. Features
    are taken in the partitions of the texts. Without labelled rows the model is empty.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
        .filter("id is not null and label in (0, 1)")
        .groupBy("id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    taught = (
        docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
        .filter("text is not null").join(F.broadcast(known), "id").select("id", "text", "label")
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                packed = [f.astype("<i4").tobytes() for f in _features(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(packed, pa.binary())],
                    names=["id", "label", "features"])

    def learn(table: pa.Table) -> pa.Table:
        labels_ = table["label"].to_numpy()
        texts = []                                         # views, no copies: the sample is held once
        for chunk in table["features"].chunks:
            data, ends = text_bytes(chunk)
            texts += [data[a:b].view("<i4") for a, b in zip(ends, ends[1:])]
        model, order = Ftrl(), np.lexsort((np.array([len(t) for t in texts]), table["id"].to_pandas()))
        for epoch in range(EPOCHS):
            for i in np.random.default_rng(epoch).permutation(order):
                model.learn(texts[i], labels_[i])
        w = model.weights(np.arange(model.size + 1))
        at = np.union1d(np.flatnonzero(w), [model.size])
        texts.clear()
        pa.default_memory_pool().release_unused()
        return pa.table({"bucket": pa.array(at, pa.int64()), "weight": pa.array(w[at], pa.float64())})

    kind = taught.schema["id"].dataType.simpleString()
    rows = (
        taught.mapInArrow(features, f"id {kind}, label int, features binary")
        .groupBy().applyInArrow(learn, "bucket bigint, weight double").collect()
    )
    weights = {r["bucket"]: r["weight"] for r in rows}
    bias = weights.pop(1 << BITS, None)
    return Model(np.array(sorted(weights), np.int64), np.array([weights[b] for b in sorted(weights)]), bias)


def score(spark: SparkSession, docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with a column ``into``: the probability that the label is 1.

    Each whole text is scored where it lies. A null or empty text gets the score of the
    bias alone, every text 0 if the model is empty. Rows and other columns stay as they
    are, but for a column named ``into``, which is replaced.
    """
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop(into)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        weights = np.zeros(1 << BITS)
        weights[model.buckets] = model.weights
        for batch in batches:
            for part in slices(batch, text):
                logits = np.zeros(part.num_rows)
                if model.bias is not None:
                    pairs = []
                    for values, first in _buckets(part.column(part.schema.get_field_index(text))):
                        hit = np.flatnonzero(weights[values])
                        pairs.append(np.stack([np.searchsorted(first, hit, "right") - 1, values[hit]]))
                    rows, values = np.unique(np.concatenate(pairs, axis=1), axis=1)
                    logits = model.bias + np.bincount(rows, weights[values], part.num_rows)
                    found = 1.0 / (1.0 + np.exp(-np.clip(logits, -35, 35)))
                else:
                    found = logits
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found)], names=[*part.schema.names, into])

    return docs.mapInArrow(apply, StructType([*docs.schema, StructField(into, DoubleType())]))


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``: the folds of the labelled queries."""
    return F.crc32(F.col(id_col).cast("string")) % divisor
