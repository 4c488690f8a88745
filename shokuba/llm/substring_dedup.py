"""Repeated passages by a compacted de Bruijn graph over word k-mers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shokuba.llm.common import join_by_heavy, stage, text_or_empty

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_EDGES = "doc_id long, text_hash long, n_words long, full_sha256 string, edges array<struct<node:long,h1:long,h2:long,start:int,n:int>>"
_WINDOWS = "doc_id long, text_hash long, start int, h1 long, h2 long"


def words_of(text: str) -> list[bytes]:
    """What lies between ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split()


class Spans:
    """Hashes of any stretch of a word sequence: two polynomials over the words' XXH64, so 128 bits."""

    def __init__(self, words: list[bytes]):
        digest = xxhash.xxh64_intdigest
        code = np.fromiter((digest(w, 0) for w in words), np.uint64, len(words))
        self.n, self.sums, self.powers = len(words), [], []
        for base in _BASES:
            power = np.ones(len(words) + 1, np.uint64)
            np.multiply.accumulate(np.concatenate((power[:1], np.full(len(words), base, np.uint64))), out=power)
            self.powers.append(power)
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), np.cumsum(code * power[:-1], dtype=np.uint64))))
            code = (code ^ code >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)

    def hashes(self, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
        """Of the stretches [start, stop): shifted to the common place n, so equal stretches are equal anywhere."""
        h = (self.sums[which][stop] - self.sums[which][start]) * self.powers[which][self.n - start]
        return h * self._unshift(which)

    def _unshift(self, which: int) -> np.uint64:
        """The inverse of base ** n modulo 2 ** 64."""
        return np.uint64(pow(pow(int(_BASES[which]), self.n, 1 << 64), -1, 1 << 64))


def edges_of(spans: Spans, window: int, k: int) -> tuple[np.ndarray, ...]:
    """The sampled graph of one text: node, h1, h2, first window and number of windows of each edge.

    Of the k-mers inside a window the one with the least mixed hash is its node. Windows in a row with the same node
    form an edge, which spans all their words. Equal windows have equal nodes at equal places, whatever surrounds them.
    """
    n = spans.n - window + 1
    starts = np.arange(spans.n - k + 1)
    mixed = spans.hashes(starts, starts + k, 0)
    mixed = (mixed ^ mixed >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    mixed ^= mixed >> np.uint64(29)
    inside = window - k + 1
    pick = np.empty(n, np.int64)
    for at in range(0, n, 1 << 15):  # bounds the memory of argmin
        stop = min(n, at + (1 << 15))
        pick[at:stop] = np.lib.stride_tricks.sliding_window_view(mixed[at : stop + inside - 1], inside).argmin(axis=1) + np.arange(at, stop)
    first = np.flatnonzero(np.concatenate(([True], pick[1:] != pick[:-1])))
    stop = np.concatenate((first[1:], [n]))
    ends = stop - 1 + window
    # how far the node lies behind the first window belongs to an edge's identity
    h1 = spans.hashes(first, ends, 0) + (stop - first).astype(np.uint64)
    return mixed[pick[first]].view(np.int64), h1.view(np.int64), spans.hashes(first, ends, 1).view(np.int64), first, stop - first


def kept_digest(words: list[bytes], removed: np.ndarray) -> str:
    return hashlib.sha256(b" ".join([w for w, gone in zip(words, removed.tolist()) if not gone])).hexdigest()


def _sample_edges(docs: DataFrame, window: int, k: int) -> DataFrame:
    def run(batches):
        schema = pa.schema([
            ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("full_sha256", pa.string()),
            ("edges", pa.list_(pa.struct([("node", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))),
        ])
        for b in batches:
            counts, shas, sizes, parts = [], [], [0], []
            for text in b.column(2).to_pylist():
                words = words_of(text)
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) >= window:
                    parts.append(edges_of(Spans(words), window, k))
                sizes.append(sizes[-1] + (len(parts[-1][0]) if len(words) >= window else 0))
            cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            edges = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], fields=list(schema.field("edges").type.value_type))
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), edges).cast(schema.field("edges").type)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), lists], schema=schema)

    return docs.mapInArrow(run, _EDGES)


def _open_windows(docs: DataFrame, window: int) -> DataFrame:
    """Hash and place of each window that `docs` (doc_id, text_hash, text, runs) still has to decide."""

    def run(batches):
        for b in batches:
            for doc_id, text_hash, text, runs in zip(*(c.to_pylist() for c in b.columns)):
                spans = Spans(words_of(text))
                at = np.unique(np.concatenate([np.arange(r["start"], r["start"] + r["n"]) for r in runs]))
                h1, h2 = (spans.hashes(at, at + window, i).view(np.int64) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(at), pa.int64()), pa.array([text_hash] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(h1), pa.array(h2)], ["doc_id", "text_hash", "start", "h1", "h2"])

    return docs.select("doc_id", "text_hash", "text", "runs").mapInArrow(run, _WINDOWS)


def _cut(docs: DataFrame, window: int) -> DataFrame:
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text, runs in zip(*(c.to_pylist() for c in b.columns)):
                words = words_of(text)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, [r["start"] for r in runs], 1)
                np.add.at(edge, [r["start"] + r["n"] - 1 + window for r in runs], -1)
                removed = np.cumsum(edge)[:-1] > 0
                kept = b" ".join([w for w, gone in zip(words, removed.tolist()) if not gone])
                rows.append((doc_id, len(words), int(removed.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return docs.select("doc_id", "text", "runs").mapInArrow(run, out)


def remove_repeats(docs: DataFrame, window: int = 35, k: int = 8, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the text left): one row per row of `docs`.

    A word goes if it lies in a window of `window` words whose sequence also starts anywhere else, in the same text
    or another one; windows are judged on the input. Texts shorter than a window keep everything; null counts as
    empty. Rows that repeat doc_id and text are each other's copies. Words are joined by one space in what is kept.

    The texts' k-mers are edges of a de Bruijn graph, of which minimizers are sampled as nodes. A path between nodes
    whose whole span repeats is nonbranching and compacts to one decided edge, found by one aggregation. Only where
    a node's occurrences continue in different ways, the windows of one edge of each kind are compared one by one,
    at their source coordinates; 128 bits verify every stretch. Groups are counted before they are shuffled, and
    heavy nodes are broadcast, so no node's occurrences meet in one task.
    """
    key = ["doc_id", "text_hash"]
    source = docs.select("doc_id", text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    rows = stage(_sample_edges(source, window, k), "edges")
    edges = rows.select(*key, F.explode("edges").alias("e")).select(*key, "e.*")

    place = F.struct("doc_id", "text_hash", "start", "n")
    kinds = stage(edges.groupBy("node", "h1", "h2").agg(F.count("*").alias("times"), F.min(place).alias("place")), "kinds")
    nodes = kinds.groupBy("node").agg(F.sum("times").alias("total"), F.count("*").alias("kinds"), F.max("times").alias("most")).filter("total > 1")
    nodes = stage(nodes, "nodes")
    # a whole edge that repeats is decided; of a branching node, one edge of each kind must be opened
    repeated = stage(kinds.filter("times > 1").select("node", "h1", "h2", "times"), "repeated")
    whole = join_by_heavy(edges, repeated, ["node", "h1", "h2"], "times").select(*key, "start", "n")
    branching = nodes.filter("kinds > 1").select("node", "kinds")
    opened = stage(join_by_heavy(kinds, branching, ["node"], "kinds").select("node", "times", "place"), "branching")
    runs = opened.groupBy("place.doc_id", "place.text_hash").agg(F.collect_list(F.struct("place.start", "place.n")).alias("runs"))
    same = [source["doc_id"].eqNullSafe(F.col("r.doc_id")), source["text_hash"] == F.col("r.text_hash")]
    to_open = source.join(runs.alias("r"), same).select(source["doc_id"], source["text_hash"], "text", "runs").dropDuplicates(key)
    windows = stage(_open_windows(to_open, window), "windows")
    shared = windows.groupBy("h1", "h2").agg(F.count("*").alias("times")).filter("times > 1")
    found = join_by_heavy(windows, stage(shared, "shared"), ["h1", "h2"], "times").select(*key, "start", F.lit(1).alias("n"))

    spans = stage(whole.unionByName(found), "spans").groupBy(*key).agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    same = [source["doc_id"].eqNullSafe(F.col("r.doc_id")), source["text_hash"] == F.col("r.text_hash")]
    cut = _cut(source.join(spans.alias("r"), same).select(source["doc_id"], "text", "runs"), window)
    same = [rows["doc_id"].eqNullSafe(F.col("r.doc_id")), rows["text_hash"] == F.col("r.text_hash")]
    untouched = rows.join(spans.select(*key).alias("r"), same, "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("full_sha256").alias("kept_sha256"))
    if not keep_text:
        return cut.drop("kept").unionByName(untouched)
    same = [source["doc_id"].eqNullSafe(F.col("r.doc_id")), source["text_hash"] == F.col("r.text_hash")]
    rest = source.join(spans.select(*key).alias("r"), same, "left_anti")
    return cut.unionByName(_cut(rest.withColumn("runs", F.expr("cast(array() as array<struct<start:int,n:int>>)")), window))
