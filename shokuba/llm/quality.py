"""Quality scores by hashed word n-gram logistic regression, trained with FTRL updates."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shokuba.llm.common import stage, text_or_empty
from shokuba.llm.language import fold

DIMENSIONS = 1 << 18
_FEW = 200_000  # words whose hashes a task keeps


@dataclass
class Ftrl:
    """FTRL-proximal parameters; passes are rounds over the sample, between which the shards' states are averaged."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.5
    l2: float = 1.0
    passes: int = 3
    shards: int = 6


_hashes: dict[bytes, int] = {}


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's word unigrams, bigrams and word shapes, and their weights: square roots of counts, of length 1.

    Bucket 0 is the bias. A word's shape is its case and the marks in it, so unseen words still say something.
    """
    words = text.encode("utf-8", "surrogatepass").split()
    if len(_hashes) > _FEW:
        _hashes.clear()
    for w in set(words).difference(_hashes):
        marks = bytes(sorted({c for c in w if c < 128 and not chr(c).isalnum()}))
        shape = (b"A" if w.upper() == w and w.lower() != w else b"a") + marks
        _hashes[w] = zlib.crc32(w) | zlib.crc32(b"\x00" + shape) << 32
    if not words:
        return np.zeros(1, np.int64), np.ones(1, np.float32)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    word, shape = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    pair = (word[:-1] * np.uint64(0x9E3779B1) ^ word[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
    shapes = (shape[:-1] * np.uint64(0x9E3779B1) ^ shape[1:]) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)
    every = np.concatenate((word, shape, pair, shapes)) % np.uint64(DIMENSIONS - 1) + np.uint64(1)
    at, n = np.unique(every.astype(np.int64), return_counts=True)
    x = np.sqrt(n).astype(np.float32)
    x *= 4 / np.sqrt((x * x).sum())
    return np.concatenate(([0], at)), np.concatenate((np.ones(1, np.float32), x))


class Model:
    """State (z, n) of every bucket and the weights that follow from it."""

    def __init__(self, params: Ftrl):
        self.params, self.z, self.n = params, np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)

    def weights(self, at) -> np.ndarray:
        p, z = self.params, self.z[at]
        shrunk = np.sign(z) * p.l1 - z
        return np.where(np.abs(z) <= p.l1, 0.0, shrunk / ((p.beta + np.sqrt(self.n[at])) / p.alpha + p.l2))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights(at) @ x, -35, 35))))

    def update(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.params.alpha * w
        self.n[at] = n + g * g


def _learner(params: Ftrl, now):
    def learn(rows):
        own = Model(params)
        own.z, own.n = now.value[0].copy(), now.value[1].copy()
        for i in np.argsort(rows.column("turn").to_numpy(), kind="stable").tolist():
            own.update(*features(rows.column("text")[i].as_py()), rows.column("quality")[i].as_py())
        at = np.flatnonzero((own.z != 0) | (own.n != 0))
        return pa.table({"at": at, "z": own.z[at], "n": own.n[at]})

    return learn


def train(labelled: DataFrame, params: Ftrl = Ftrl(), sample: int = 24_000) -> Model:
    """Fit on rows (doc_id, text, quality), of which a hash of doc_id takes about `sample`; texts are read whole.

    Each round every shard of the sample updates its own copy of the state with its rows in hash order, and Spark
    averages the copies by bucket; at most DIMENSIONS rows come back to the driver.
    """
    rows = labelled.count()
    model = Model(params)
    if not rows:
        return model
    take = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / rows)) + 1
    spark = labelled.sparkSession
    picked = labelled.filter(take).select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(params.shards)).cast("int").alias("shard"), text_or_empty().alias("text"), F.xxhash64("doc_id", F.lit(2)).alias("turn"), F.col("quality").cast("int").alias("quality"))
    picked = stage(picked.repartition(params.shards, "shard"), "sample")

    for _ in range(params.passes):
        learn = _learner(params, spark.sparkContext.broadcast((model.z, model.n)))
        state = picked.groupBy("shard").applyInArrow(learn, "at long, z double, n double")
        shards = picked.select("shard").distinct().count()
        mean = state.groupBy("at").agg((F.sum("z") / shards).alias("z"), (F.sum("n") / shards).alias("n")).toPandas()
        model.z[mean["at"].to_numpy()], model.n[mean["at"].to_numpy()] = mean["z"].to_numpy(), mean["n"].to_numpy()
    return model


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of `docs`.

    Learns labels.quality from documents whose crc32(doc_id) mod 5 is not 0; a score sees the text only, the whole of
    it, and null counts as empty. A doc_id labelled twice counts with its larger label; null labels are left out.
    Without labels every score is 0.5. A null doc_id is not held out.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = docs.filter(fold(5) != 0).select("doc_id", "text")
    model = train(texts.join(known, "doc_id"), **options)
    weights = docs.sparkSession.sparkContext.broadcast(model.weights(slice(None)))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = weights.value
        return pd.Series([1 / (1 + np.exp(-np.clip(w[at] @ x, -35, 35))) for at, x in map(features, texts)], dtype="float64")

    out = docs.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), score(text_or_empty()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
