"""Benchmark passages in documents: CGK embedding, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shokuba.llm.common import text_or_empty, union_all

_KEEP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_HIT = "doc_id long, item_id long, start_word long, item_words long, edits long"


def words_of(text: str) -> list[bytes]:
    """Lower-case words; ASCII punctuation counts as white space."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()


@dataclass
class Bands:
    """How windows are compared. similarity: 1 - edits / item words that still counts. samples: positions of an
    embedding that make a key. walks: independent random walks. agree: share of positions in which the embeddings of
    a pair at the similarity are expected to agree; with it, `recall` sets how many keys are drawn."""

    similarity: float = 0.8
    samples: int = 3
    walks: int = 7
    agree: float = 0.475
    recall: float = 0.99
    segment: int = 64
    ratio: float = 1.25

    @property
    def keys(self) -> int:
        return self.walks * ceil(log(1 - self.recall) / log(1 - self.agree**self.samples) / self.walks)

    def edits(self, n: int) -> int:
        return int((1 - self.similarity) * n + 1e-9)


class ItemIndex:
    """LSH tables over one block of items, by classes of item length."""

    def __init__(self, items: list[tuple[int, str]], bands: Bands, seed: int = 7):
        self.bands, self.vocab, self.items = bands, {}, []
        self.whole: list[tuple[int, np.ndarray]] = []  # of each segment: its first word in the item, and the whole item
        for item_id, text in items:
            w = np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in words_of(text or "")], np.int32)
            for at in range(0, len(w), bands.segment):
                at = at if len(w) - at >= bands.segment // 4 or not at else len(w) - bands.segment // 4
                self.items.append((item_id, w[at : at + bands.segment]))
                self.whole.append((at, w))
        grams = [self._grams(x) for _, x in self.items if len(x) > 2]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        rng = np.random.default_rng(seed)
        self.classes, lo = [], 1
        longest = max((len(x) for _, x in self.items), default=0)
        while lo <= longest:
            hi = max(lo, int(lo * bands.ratio))
            if own := [k for k, (_, x) in enumerate(self.items) if lo <= len(x) <= hi]:
                self.classes.append(self._class(own, lo, hi, rng))
            lo = hi + 1
        self.least = min((c[5] for c in self.classes), default=1)

    def _grams(self, x: np.ndarray) -> np.ndarray:
        """Codes of the trigrams of x."""
        v, x = len(self.vocab) + 1, x.astype(np.int64)
        return (x[:-2] * v + x[1:-1]) * v + x[2:]

    def _known_grams(self, x: np.ndarray) -> np.ndarray:
        """Where in x a trigram of any item starts."""
        hit = np.zeros(len(x), bool)
        if len(x) > 2 and len(self.grams):
            at = np.flatnonzero((x[:-2] > 0) & (x[1:-1] > 0) & (x[2:] > 0))
            v, y = len(self.vocab) + 1, x.astype(np.int64)
            code = (y[at] * v + y[at + 1]) * v + y[at + 2]
            hit[at] = self.grams[np.minimum(np.searchsorted(self.grams, code), len(self.grams) - 1)] == code
        return hit

    def _class(self, own: list[int], lo: int, hi: int, rng) -> tuple:
        steps = max(2 * lo, self.bands.samples)
        walks = rng.integers(0, 2, (self.bands.walks, steps, 256), dtype=np.uint8)
        per = self.bands.keys // self.bands.walks
        picks = [[np.sort(rng.choice(steps, self.bands.samples, replace=False)) for _ in range(per)] for _ in range(self.bands.walks)]
        padded = np.zeros((len(own), max(hi, steps) + 2), np.int32)
        for i, k in enumerate(own):
            padded[i, : len(self.items[k][1])] = self.items[k][1]
        flat, starts = padded.ravel(), np.arange(len(own)) * padded.shape[1]
        keys, tables = self.sketch(flat, starts, walks, picks), []
        for row in keys:
            order = np.argsort(row, kind="stable")
            tables.append((row[order], np.array(own)[order]))
        shared = max(0, min(n - 2 - 3 * self.bands.edits(n) for n in {len(self.items[k][1]) for k in own}))
        return lo, hi, walks, picks, tables, shared

    @staticmethod
    def sketch(x: np.ndarray, starts: np.ndarray, walks: np.ndarray, picks: list) -> list[np.ndarray]:
        """Keys of the windows of x at `starts`. A walk (CGK) writes the word under it, then moves on one word or not
        as the random bit of this step and word says; two windows walk with the same bits."""
        need = {int(p) for own in picks for pick in own for p in pick}
        at = np.tile(starts.astype(np.int64), (len(walks), 1))
        table = np.arange(len(walks))[:, None] << 8
        seen: dict[int, np.ndarray] = {}
        for j in range(max(need) + 1):
            word = x[at]
            if j in need:
                seen[j] = word.astype(np.uint64)
            at += walks[:, j].ravel()[table + (word & 255)]
        out = []
        for i, own in enumerate(picks):
            for pick in own:
                key = np.zeros(len(starts), np.uint64)
                for p in pick.tolist():
                    key = (key ^ seen[p][i]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                out.append(key)
        return out

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, first word of the window, words of the item, edits): at most one row per item."""
        words = words_of(text)
        n = len(words)
        x = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int32, n)
        grams = self._known_grams(x)
        total = int(grams.sum())
        if total < self.least:
            return []
        known, common = np.concatenate(([0], np.cumsum(x > 0))), np.concatenate(([0], np.cumsum(grams)))
        pad = None
        found: dict[int, tuple[int, int, int, int]] = {}
        for lo, hi, walks, picks, tables, shared in self.classes:
            if total < shared:
                continue
            k = self.bands.edits(hi)
            # An edit spoils at most three trigrams, so a match holds at least `shared` of the items' trigrams.
            # An item within k edits leaves at most k words of its first lo - k outside the items' vocabulary.
            front = max(1, lo - k)
            if n < front:
                continue
            starts = np.flatnonzero((known[front:] - known[:-front] >= front - k) & (x[: n - front + 1] > 0))
            starts = starts[common[np.minimum(starts + hi + k, n)] - common[starts] >= shared]
            if not len(starts):
                continue
            if pad is None:
                pad = np.concatenate((x, np.zeros(max(c[1] for c in self.classes) * 2 + 8, np.int32)))
            pairs = set()
            for key, (table, owner) in zip(self.sketch(pad, starts, walks, picks), tables):
                a, b = np.searchsorted(table, key, "left"), np.searchsorted(table, key, "right")
                for s in np.flatnonzero(b > a).tolist():
                    pairs.update(zip(repeat(int(starts[s])), owner[a[s] : b[s]].tolist()))
            met = np.zeros(len(self.vocab) + 1, bool)
            for s, item in sorted(pairs):
                item_id, own = self.items[item]
                fits = self.bands.edits(len(own))
                region = x[max(0, s - fits) : s + len(own) + fits]
                met[region] = True
                met[0] = False
                held = np.count_nonzero(met[own])
                met[region] = False
                if held < len(own) - fits:  # each word of the item that isn't there costs an edit
                    continue
                if item_id in found and not found[item_id][3]:
                    continue
                at, want = self.whole[item]
                most = self.bands.edits(len(want))
                if len(want) > len(own) and best_edits(own, region) > fits:
                    continue  # of the segments of an item within the similarity, one at least is within it too
                s = max(0, s - at)
                edits = best_edits(want, x[max(0, s - most) : s + len(want) + most])
                if edits <= most and (item_id not in found or edits < found[item_id][3]):
                    found[item_id] = (item_id, s, len(want), edits)
        return list(found.values())


def best_edits(want: np.ndarray, region: np.ndarray) -> int:
    """Least edit distance, in words, between `want` and any stretch of `region` (0 in it equals nothing)."""
    row = np.zeros(len(region) + 1, np.int32)
    steps = np.arange(len(region) + 1, dtype=np.int32)
    for w in want.tolist():
        new = np.empty_like(row)
        new[0] = row[0] + 1
        new[1:] = np.minimum(row[:-1] + (region != w), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def _indexes(docs: DataFrame, benchmark: DataFrame, bands: Bands, block_chars: int):
    """Broadcast indexes of the benchmark, block by block, so the driver holds one block at a time."""
    items = benchmark.select("item_id", text_or_empty().alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        yield docs.sparkSession.sparkContext.broadcast(ItemIndex([tuple(r) for r in own], bands))


def find_leaks(docs: DataFrame, benchmark: DataFrame, bands: Bands = Bands(), block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, item_id, start_word, item_words, edits: one row per row of `docs` and benchmark item found in it.

    An item is found where a stretch of the document lies within the similarity of it, counted in word edits. Items
    longer than `segment` words are searched by their segments, one of which at least lies within the similarity where
    the item does, and the whole item is verified at a segment's place. Windows at every word of the whole text are
    considered. Those that can't match are left out first: too few of their words or word trigrams occur in any item.
    Items or texts that are null or without words match nothing; rows that repeat an item_id are one item, of which the
    best match counts. The benchmark is the query set: it comes to the tasks in blocks of about `block_chars`
    characters, with one pass over the documents for each block.
    """
    def search(index) -> DataFrame:
        def run(batches):
            for b in batches:
                rows = [(d, *hit) for d, t in zip(b.column(0).to_pylist(), b.column(1)) for hit in index.value.search(t.as_py())]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [f.split()[0] for f in _HIT.split(", ")])

        return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, _HIT)

    return union_all([search(index) for index in _indexes(docs, benchmark, bands, block_chars)])


def drop_leaks(docs: DataFrame, benchmark: DataFrame, bands: Bands = Bands(), block_chars: int = 4_000_000) -> DataFrame:
    """The rows of `docs` in whose text no benchmark item is found, with their columns; each row is judged by its own text
    where it lies, so nothing is joined or shuffled, and repeated or null doc_ids don't matter."""
    def free_of(index):
        @F.arrow_udf("boolean")
        def clean(texts: pa.Array) -> pa.Array:
            return pa.array((not index.value.search(x.as_py()) for x in texts), pa.bool_())

        return clean

    for index in _indexes(docs, benchmark, bands, block_chars):
        docs = docs.filter(free_of(index)(text_or_empty()))
    return docs
