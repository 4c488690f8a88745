"""Near duplicates by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import comb, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shokuba.llm.common import components, join_by_heavy, stage, text_or_empty

SEED = 42  # of XXH64
_LANES = np.uint64(0x0101010101010101)
_RUN = 255  # hashes whose bits add up in a byte
_SLAB = _RUN * 32  # hashes that are counted at once
_PART = 512  # hashes that are mixed at once
#: Odd multipliers of further hashes, from a linear congruential rule.
_STEP, _MIX = 0x5851F42D4C957F2D, 0x9E3779B97F4A7C15


def bit_counts(h: np.ndarray) -> np.ndarray:
    """For each row of hashes, how many have each of the 64 bits: bits of equal place in their byte add up in byte lanes."""
    rows, n = h.shape
    run = min(_RUN, n)
    if pad := -n % run:
        h = np.concatenate((h, np.zeros((rows, pad), np.uint64)), axis=1)
    out = np.empty((rows, 8, 8), np.int64)
    for k in range(8):
        lanes = (h >> np.uint64(k) & _LANES).reshape(rows, -1, run).sum(axis=2, dtype=np.uint64)
        out[:, :, k] = lanes.view(np.uint8).reshape(rows, -1, 8).sum(axis=1, dtype=np.int64)
    return out.reshape(rows, 64)


def mixes(h: np.ndarray, size: int) -> np.ndarray:
    """The hashes and size - 1 rows of mixes of them."""
    odd = np.array([(_MIX + 2 * w * _STEP) % 2**64 | 1 for w in range(size)], np.uint64)[:, None]
    m = (h ^ h >> np.uint64(32)) * odd
    m ^= m >> np.uint64(29)
    m *= np.uint64(0xBF58476D1CE4E5B9)
    m ^= m >> np.uint64(32)
    m[0] = h
    return m


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of one text, in order.

    A-Z are lower-cased, words are what lies between ASCII white space, shingles count as often as they occur. With
    fewer words than `shingle` the whole sequence is the one shingle; without words there is none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, n = b" ".join(words), len(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if n > shingle:
        starts, ends = starts[: n - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[i:j], SEED) for i, j in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def band_hashes(h: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """For each band of the MinHashes of the shingle hashes h one hash of all, and the low bytes of all; 0 without shingles."""
    if not len(h):
        return np.zeros(bands, np.int64), np.zeros(bands, np.int64)
    least = np.min([mixes(h[at : at + _PART], bands * rows).min(axis=1) for at in range(0, len(h), _PART)], axis=0)
    least = (least ^ least >> np.uint64(31)).reshape(bands, rows)
    odd = np.array([(_STEP * (2 * r + 1)) % 2**64 | 1 for r in range(rows)], np.uint64)
    low = (least >> np.uint64(5) & np.uint64(255)) << np.arange(0, 8 * rows, 8, dtype=np.uint64)
    return (least * odd).sum(axis=1, dtype=np.uint64).view(np.int64), low.sum(axis=1, dtype=np.uint64).view(np.int64)


def simhash(text: str, shingle: int = 4) -> int:
    """Signed 64-bit fingerprint of one text: a bit is set if it is in over half of the shingles' hashes; 0 without words."""
    h = shingle_hashes(text, shingle)
    if not len(h):
        return 0
    ones = sum(bit_counts(h[None, at : at + _SLAB])[0] for at in range(0, len(h), _SLAB))
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, *more: Column) -> DataFrame:
    """doc_id, fp and the columns `more` for every row of `docs`; null text counts as empty."""

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array((simhash(x.as_py(), shingle) for x in texts), pa.int64())

    return docs.select("doc_id", fp(text_or_empty()).alias("fp"), *more)


_LONGS = pa.list_(pa.int64())


def _set_hash(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view(np.int64))


def band_rows(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, the hash fp of the set of shingles, keys (a hash for each of `bands` bands of `rows` MinHashes) and low
    (their low bytes) for every row of `docs`."""

    @F.arrow_udf("struct<fp: long, keys: array<long>, low: array<long>>")
    def hashes(texts: pa.Array) -> pa.Array:
        fp, keys, low = [], [], []
        for x in texts:
            h = np.unique(shingle_hashes(x.as_py(), shingle))
            found = band_hashes(h, bands, rows)
            fp.append(_set_hash(h))
            keys.append(found[0])
            low.append(found[1])
        return pa.StructArray.from_arrays([pa.array(fp, pa.int64()), pa.array(keys, _LONGS), pa.array(low, _LONGS)], ["fp", "keys", "low"])

    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), hashes(text_or_empty()).alias("s")).select("doc_id", "text_hash", "s.fp", "s.keys", "s.low")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """fp as in band_rows, and the set of shingle hashes s, for every row of `docs`."""

    @F.arrow_udf("struct<fp: long, s: array<long>>")
    def sets(texts: pa.Array) -> pa.Array:
        found = [np.unique(shingle_hashes(x.as_py(), shingle)) for x in texts]
        return pa.StructArray.from_arrays([pa.array(map(_set_hash, found), pa.int64()), pa.array([h.view(np.int64) for h in found], _LONGS)], ["fp", "s"])

    # not deterministic, or a join's filter on fp would compute it a second time
    return docs.select(sets.asNondeterministic()(text_or_empty()).alias("s")).select("s.fp", "s.s")


def block_masks(n: int, bits: int) -> list[int]:
    """Masks of which every two fingerprints within `bits` differing bits agree on at least one.

    64 bits are cut into k blocks, and each mask joins k - bits of them: of k blocks at most `bits` differ. More
    blocks make more entries but fewer chance pairs; k gives the least of both for n fingerprints. Any k is exact.
    """
    def cost(k: int) -> float:
        return comb(k, bits) * (n + n * n / 2 ** (1 + 64 * (k - bits) / k))

    k = min(range(bits + 1, bits + 7), key=cost)
    edge = [round(64 * i / k) for i in range(k + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(k)]
    masks = [sum(block[i] for i in c) for c in combinations(range(k), k - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def link_fingerprints(nodes: DataFrame, n: int, bits: int = 4) -> DataFrame:
    """Components of distinct fingerprints `nodes` (fp) that link at `bits` or fewer differing bits: fp, component_fp.

    Fingerprints without any link are left out. Pairs share a block by the pigeonhole principle, so none is lost.
    """
    entries = [F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(block_masks(n, bits))]

    def near(pairs: DataFrame) -> DataFrame:
        return pairs.filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits)

    def tools(fps: DataFrame) -> tuple:
        return near, None  # a fingerprint is its own sketch

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count((a[:, None, 0] ^ b[None, :, 0]).view(np.uint64)) <= bits

    return _link(nodes.select("fp", F.explode(F.array(*entries)).alias("e")), tools, close)


def link_sets(nodes: DataFrame, docs: DataFrame, shingle: int, similarity: float, bands: int, rows: int) -> DataFrame:
    """Components of distinct shingle sets `nodes` (fp, least, keys, low) that link at a Jaccard similarity of
    `similarity` or more: fp, component_fp.

    Candidates agree on a band. Those whose MinHashes agree in three standard deviations less than the similarity means
    go first, which loses one link in 700 at the similarity; the sets of shingles, from the texts, decide all others.
    """
    size = bands * rows
    least = int(size * similarity - 3 * sqrt(size * similarity * (1 - similarity)))
    seven, high = sum(0x7F << 8 * i for i in range(rows)), sum(0x80 << 8 * i for i in range(rows))

    def equal_bytes(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        return rows - F.bit_count((z.bitwiseAND(F.lit(seven)) + F.lit(seven)).bitwiseOR(z).bitwiseAND(F.lit(high)))

    def tools(fps: DataFrame) -> tuple:
        """The sets of all texts that share a band are made once: one shuffle and one pass over the texts."""
        met = stage(nodes.join(fps, "fp", "left_semi").select("fp", "least", "low"), "met")
        ids = stage(met.select(F.col("least").alias("id")).distinct(), "ids")
        texts = docs.select("doc_id", "text").join(ids.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")  # alike at every size
        sets = shingle_sets(texts, shingle).groupBy("fp").agg(F.first("s").alias("s"))  # equal for a fp
        drawn = stage(met.select("fp", "low").join(sets, "fp"), "sets")
        return lambda pairs: near(pairs, drawn), drawn

    def near(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        agree = F.aggregate(F.zip_with("a", "b", equal_bytes), F.lit(0), lambda t, x: t + x)
        likely = pairs.join(sets.select(F.col("fp").alias("u"), F.col("low").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("low").alias("b")), "v")
        likely = stage(likely.filter(agree >= least).select("u", "v"), "likely")
        right = likely.groupBy(F.col("v").alias("fp")).agg(F.count("*").alias("n")).join(sets, "fp").select(F.col("fp").alias("v"), "n", F.col("s").alias("b"))
        both = join_by_heavy(likely, right, ["v"], "n").join(sets.select(F.col("fp").alias("u"), F.col("s").alias("a")), "u")
        common = F.size(F.array_intersect("a", "b"))
        return stage(both.filter(common / (F.size("a") + F.size("b") - common) >= similarity).select("u", "v"), "near")

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = (np.ascontiguousarray(x).view(np.uint8).reshape(len(x), bands, 8)[:, :, :rows].reshape(len(x), size) for x in (a, b))
        return np.stack([(x == b).sum(axis=1) for x in a]) >= least

    def holds(a: np.ndarray, b: np.ndarray) -> bool:
        if min(len(a), len(b)) < similarity * max(len(a), len(b)):
            return False
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common >= similarity * (len(a) + len(b) - common)

    return _link(nodes.select("fp", F.posexplode("keys").alias("m", "key")).select("fp", F.struct("m", "key").alias("e")), tools, close, holds)


def _link(entries: DataFrame, tools: Callable[[DataFrame], tuple[Callable[[DataFrame], DataFrame], DataFrame | None]], close: Callable, holds: Callable | None = None, rounds: int = 2, spare: int = 64, cell: int = 128) -> DataFrame:
    """Components of the links among fingerprints that share a block: fp, component_fp.

    tools is called with the fingerprints (fp) that share a block and gives near, which keeps the pairs (u, v) that link,
    and a table of them with low and s (arrays of longs; without a table low is the fingerprint). close says of two arrays of low which pairs may link, and
    holds of two s whether they do.

    Every pair that shares a block is decided or lies within one component already. First all members of a bucket are
    held against its most central one, whose buckets hold most members in all: the original of a family of copies.
    While what is left of the buckets outside their largest components makes more than `spare` pairs a member, up to
    `rounds` times, members are held against the most central one outside the largest component. Then the members
    outside the largest component are held against the whole bucket in cells of about `cell` times `cell` members, so a
    bucket of any size is spread over tasks and only links become rows. Members that agree on a block and yet form no
    components cost their square / `cell` in rows of this last step; no other step has a square.
    """
    keys = entries.select("fp", "e.m", "e.key")
    buckets = stage(keys.groupBy("m", "key").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    shared = stage(join_by_heavy(keys, buckets, ["m", "key"], "n").select("m", "key", "fp", "n"), "blocks")
    score = stage(shared.groupBy("fp").agg(F.sum("n").alias("score"), F.count("*").alias("held")), "scores")
    near, drawn = tools(score.select("fp"))
    members = stage(shared.select("m", "key", "fp", F.sum("n").over(Window.partitionBy("fp")).alias("score")), "members")  # as many rows a fp as masks
    hubs = members.groupBy("m", "key").agg(F.max_by("fp", F.struct("score", "fp")).alias("v"), F.count("*").alias("n"))
    pairs = join_by_heavy(members, stage(hubs, "hubs"), ["m", "key"], "n").select(F.col("fp").alias("u"), "v").filter("u <> v").distinct()
    links = stage(near(pairs).select("u", "v"), "star")
    for turn in range(rounds + 1):
        part = components(links, "parts").withColumnRenamed("node", "fp")
        part = stage(score.join(part, "fp", "left").select("fp", F.coalesce("component", "fp").alias("part"), "held"), "part")
        members = stage(join_by_heavy(members.select("m", "key", "fp", "score"), part, ["fp"], "held").select("m", "key", "fp", "score", "part"), "members")
        parts = members.groupBy("m", "key", "part").agg(F.count("*").alias("size"))
        mixed = parts.groupBy("m", "key").agg(F.max_by("part", F.struct("size", "part")).alias("main"), F.count("*").alias("parts"), F.sum("size").alias("n"), F.max("size").alias("most"))
        mixed = stage(mixed.filter("parts > 1").select("m", "key", "main", "n", "most"), "mixed")
        left, total = mixed.agg(F.sum(F.expr("(n - most) * n")), F.sum("n")).first()
        members = stage(join_by_heavy(members, mixed, ["m", "key"], "n"), "members")
        if turn == rounds or not total or left <= spare * total:
            break
        outer = members.filter("part <> main").groupBy("m", "key").agg(F.max_by(F.struct("fp", "part"), F.struct("score", "fp")).alias("hub"), F.first("n").alias("n"))  # one n for a bucket
        pairs = join_by_heavy(members.drop("n"), stage(outer, "hubs"), ["m", "key"], "n").filter("part <> hub.part").select(F.col("fp").alias("u"), F.col("hub.fp").alias("v")).distinct()
        links = stage(links.union(near(pairs).select("u", "v")), "star")
    if total:
        links = links.union(_cell_links(members, drawn, close, holds, cell))
    return components(links, "links").select(F.col("node").alias("fp"), F.col("component").alias("component_fp"))


def _cell_links(members: DataFrame, drawn: DataFrame | None, close: Callable, holds: Callable | None, cell: int) -> DataFrame:
    """u, v: the links, between different parts, of a member outside its bucket's largest part and any member of the bucket."""
    wide, high = F.ceil(F.col("n") / cell), F.ceil((F.col("n") - F.col("most")) / cell)
    rows = members.select("m", "key", "fp", "part", (F.col("part") != F.col("main")).alias("outer"), wide.alias("wide"), high.alias("high"), F.xxhash64("fp").alias("at"))
    upto = [F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1) for c in ("wide", "high")]
    places = [
        rows.filter("outer").select("m", "key", F.pmod("at", "high").alias("row"), F.explode(upto[0]).alias("column"), F.lit(True).alias("outer"), "fp", "part"),
        rows.select("m", "key", F.explode(upto[1]).alias("row"), F.pmod("at", "wide").alias("column"), F.lit(False).alias("outer"), "fp", "part"),
    ]
    dealt = stage(places[0].unionByName(places[1]), "dealt")
    if drawn is None:
        dealt = dealt.withColumns({"low": F.array("fp"), "s": F.expr("cast(array() as array<bigint>)")})
    else:
        often = drawn.join(dealt.groupBy("fp").agg(F.count("*").alias("held")), "fp")
        dealt = join_by_heavy(dealt, often, ["fp"], "held")
    member = F.struct("fp", "part", "low", "s")
    cells = dealt.groupBy("m", "key", "row", "column").agg(F.collect_list(F.when(F.col("outer"), member)).alias("o"), F.collect_list(F.when(~F.col("outer"), member)).alias("a"))

    def fields(x: pa.StructArray) -> tuple:
        fp, part, low, s = (x.field(k) for k in ("fp", "part", "low", "s"))
        return fp.to_numpy(), part.to_numpy(), low.flatten().to_numpy().reshape(len(fp), -1), s.offsets.to_numpy(), s.values.to_numpy()

    def run(batches):
        for batch in batches:
            for outer, every in zip(batch.column(0), batch.column(1)):
                (fp, part, low, at, s), (fp2, part2, low2, at2, s2) = fields(outer.values), fields(every.values)
                pairs = zip(*(x.tolist() for x in np.nonzero(close(low, low2) & (part[:, None] != part2[None, :]))))
                if holds:
                    pairs = ((i, j) for i, j in pairs if holds(s[at[i] : at[i + 1]], s2[at2[j] : at2[j + 1]]))
                if found := [(int(fp[i]), int(fp2[j])) for i, j in pairs]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["u", "v"])

    return stage(cells.filter("size(o) > 0 and size(a) > 0").select("o", "a").mapInArrow(run, "u long, v long").distinct(), "near")


def near_duplicates(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fp, component_id: one row per row of `docs`; component_id is the smallest doc_id reachable by links.

    Fingerprints link at `bits` or fewer differing bits, and a document without words (fingerprint 0) links like any
    other. Null text counts as empty; a null doc_id is never the smallest unless a component holds no other. Only
    doc_id and text are read.
    """
    return _classes(*_fingerprint_links(docs, shingle, bits)).select("doc_id", "fp", "component_id")


def _fingerprint_links(docs: DataFrame, shingle: int, bits: int, *more: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each row's fingerprint (and the columns `more`), the distinct ones, and the components of those that link."""
    rows = stage(fingerprints(docs, shingle, *more), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    return rows, nodes, link_fingerprints(nodes.select("fp"), nodes.count(), bits)


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 7) -> DataFrame:
    """As near_duplicates, for sets of shingles: two link if the Jaccard similarity of their sets is `similarity` or more.

    Candidates agree on all MinHashes of a band, which a pair at similarity s does with 1 - (1 - s^rows)^bands whatever
    the number of texts: 0.991 at 0.8 and over 0.999 at 0.85. Their sets decide, so no pair below links.
    """
    return _similar(docs, shingle, similarity, bands, rows).select("doc_id", "fp", "component_id")


def _similar(docs: DataFrame, shingle: int, similarity: float, bands: int = 20, rows: int = 7) -> DataFrame:
    texts = stage(band_rows(docs, shingle, bands, rows), "bands")
    every = [F.first(c).alias(c) for c in ("keys", "low")]  # equal for a fp
    nodes = stage(texts.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *every), "nodes")
    linked = link_sets(nodes, docs, shingle, similarity, bands, rows)
    return _classes(texts.select("doc_id", "text_hash", "fp"), nodes.select("fp", "least", "n"), linked)


def _classes(rows: DataFrame, nodes: DataFrame, linked: DataFrame) -> DataFrame:
    classes = nodes.join(linked, "fp", "left").withColumn("component_fp", F.coalesce("component_fp", "fp"))
    least = classes.groupBy("component_fp").agg(F.min("least").alias("component_id"))
    classes = stage(classes.join(least, "component_fp").select("fp", "component_fp", "component_id", "n"), "classes")
    return join_by_heavy(rows, classes, ["fp"], "n").drop("n")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each class of similar documents, with all its columns: that with the smallest doc_id.

    Of rows with this doc_id and different texts the one with the smallest hash of its text stays; rows that repeat both
    are all kept (exact deduplication goes before). A null doc_id stays only where a class has no other.
    """
    return _drop_others(docs, _similar(docs, shingle, similarity))


def drop_near_fingerprints(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """As drop_near_duplicates, for the classes of near_duplicates: SimHash fingerprints that link at `bits` or fewer bits."""
    rows, nodes, linked = _fingerprint_links(docs, shingle, bits, F.xxhash64(text_or_empty()).alias("text_hash"))
    return _drop_others(docs, _classes(rows, nodes, linked))


def _drop_others(docs: DataFrame, classes: DataFrame) -> DataFrame:
    rows = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = rows.groupBy("component_fp").agg(F.min_by(F.struct("doc_id", "text_hash"), "text_hash").alias("k"))
    kept = stage(kept.select(F.col("k.doc_id").alias("_kept"), F.col("k.text_hash").alias("_hash")), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.xxhash64(text_or_empty()) == F.col("_hash"))
    return docs.join(kept.hint("merge"), same, "left_semi")  # alike at every size
