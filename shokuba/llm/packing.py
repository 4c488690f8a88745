"""Order-preserving packing of documents into fixed-length sequences by dynamic programming."""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from shokuba.llm.common import text_or_empty
from shokuba.llm.tokens import WordEncoder

SENTENCE_CUT, FREE_CUT = 2.0, 16.0  # penalties, in tokens of padding, for a cut inside a document
_FREE_STEP = 16  # where no boundary follows for long, cuts are offered at this step
_CHUNK = 64  # sequences that are planned together

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@functools.cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)  # one for each worker


def boundaries(ends: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted cut positions and their penalties: document ends (0), sentence ends, and free cuts in long gaps."""
    at = np.union1d(ends, sentences)
    cost = np.where(np.isin(at, ends), 0.0, SENTENCE_CUT)
    gaps = np.diff(at, prepend=0)
    long = np.flatnonzero(gaps > 2 * _FREE_STEP)
    if len(long):
        many = (gaps[long] - 1) // _FREE_STEP
        nth = np.arange(1, many.sum() + 1) - np.repeat(np.cumsum(many) - many, many)
        free = np.repeat(at[long] - gaps[long], many) + nth * _FREE_STEP
        at, cost = np.concatenate((at, free)), np.concatenate((cost, np.full(len(free), FREE_CUT)))
        order = np.argsort(at, kind="stable")
        at, cost = at[order], cost[order]
    return at, cost


def plan_cuts(at: np.ndarray, cost: np.ndarray, capacity: int, last: bool) -> list[int]:
    """Ends of the windows from 0, each at most `capacity` long, with the least padding and cut penalties.

    Less than `capacity` is left over after the last of them: at no cost if more will follow, else at that of its
    own windows (tail_cuts).

    f(j) = cost(j) + min over i of f(i) + capacity - (at(j) - at(i)). f(i) + at(i) decides, so the i within reach
    stay in a queue whose values rise, and each boundary enters and leaves it once.
    """
    at, cost, n = [0, *at.tolist()], [0.0, *cost.tolist()], len(at) + 1
    key, back, queue, head, tail = [0.0] * n, [0] * n, [0] * n, 0, 1  # key: f(i) + at(i)
    for j in range(1, n):
        reach = at[j] - capacity
        i = queue[head]
        while at[i] < reach:
            head += 1
            i = queue[head]
        back[j] = i
        key[j] = new = key[i] + capacity + cost[j]
        while tail > head and key[queue[tail - 1]] >= new:
            tail -= 1
        queue[tail] = j
        tail += 1
    left = [i for i in range(n) if at[-1] - at[i] < capacity]
    j = min(left, key=lambda i: (key[i] - at[i] + (tail_cost(at[-1] - at[i], capacity) if last else 0.0), -i))
    cuts = []
    while j:
        cuts.append(at[j])
        j = back[j]
    return cuts[::-1]


def tail_cost(length: int, capacity: int) -> float:
    """Padding of a last stretch in one window, or the cuts that make it windows of powers of two, if these cost less."""
    return min(capacity - length, FREE_CUT * (length.bit_count() - 1)) if length else 0.0


def tail_cuts(length: int, capacity: int) -> list[int]:
    """Ends of the windows of a last stretch, as tail_cost decides."""
    if not length:
        return []
    if capacity - length <= FREE_CUT * (length.bit_count() - 1):
        return [length]
    return np.cumsum([1 << i for i in range(length.bit_length() - 1, -1, -1) if length >> i & 1]).tolist()


class Packer:
    """Packs a stream of documents in its order; holds little more than one chunk of tokens at a time."""

    def __init__(self, capacity: int, ends: np.ndarray, first: int):
        self.capacity, self.sequence, self.end_ids = capacity, first, ends
        self.parts: list[tuple] = []  # (doc_id, start in document, ids from there, tokens of the document)
        self.size = 0

    def add(self, doc_id, ids: np.ndarray) -> list[tuple]:
        self.parts.append((doc_id, 0, ids, len(ids)))
        self.size += len(ids)
        return self.flush(False) if self.size >= _CHUNK * self.capacity else []

    def flush(self, last: bool) -> list[tuple]:
        if not self.size:
            return []
        ids = np.concatenate([p[2] for p in self.parts])
        ends = np.cumsum([len(p[2]) for p in self.parts])
        is_end = np.isin(ids, self.end_ids)
        is_end[:-1] &= ~is_end[1:]
        cuts = plan_cuts(*boundaries(ends, np.flatnonzero(is_end) + 1), self.capacity, last)
        if last:
            done = cuts[-1] if cuts else 0
            cuts += [done + x for x in tail_cuts(len(ids) - done, self.capacity)]
        stops, starts, out, begin = ends.tolist(), [0, *ends[:-1].tolist()], [], 0
        for cut in cuts:
            k = bisect_right(stops, begin)
            at = begin
            while at < cut:
                doc_id, skip, _, total = self.parts[k]
                stop = min(cut, stops[k])
                out.append((doc_id, skip + at - starts[k], stop - at, zlib.crc32(ids[at:stop].astype("<u4").tobytes()), total, self.sequence, at - begin))
                at, k = stop, k + 1
            self.sequence, begin = self.sequence + 1, cut
        k = bisect_right(stops, begin)
        rest = [(d, skip + max(0, begin - starts[i]), x[max(0, begin - starts[i]) :], n) for i, (d, skip, x, n) in enumerate(self.parts[k:], k)]
        self.parts, self.size = rest, len(ids) - begin
        return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all documents in sequences of at most `capacity` tokens: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.

    A document is its token ids, then `end_id`; null and empty texts are the end id alone. Every id lies in exactly
    one piece. Each partition packs what it reads, in the table's own order, without any shuffle; its last stretch
    is cut into powers of two, which need no padding, where that is cheaper. sequence_id holds the partition in its
    upper bits. Rows are packed one by one, so repeated doc_ids and null ones are kept apart by their pieces only.
    """

    def run(batches):
        encoder = _encoder(tokenizer)
        packer = Packer(capacity, encoder.sentence_ends(), TaskContext.get().partitionId() << 32)
        schema = pa.schema([(f.split()[0], pa.int64()) for f in _PIECE.split(", ")])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)

        end = np.uint32(end_id).tobytes()
        for b in batches:
            out = []
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder.encode_many((x.as_py() for x in b.column(1)), end)):
                out += packer.add(doc_id, ids)
            if out:
                yield batch(out)
        if out := packer.flush(True):
            yield batch(out)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, _PIECE)
