"""Many k-means models at once: one for each group and number of clusters, all fitted by the same aggregations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shokuba.operators.stats import held_ranges, percentiles_in_ranges
from shokuba.sources.scratch import written

_SEED_ROWS = 256  # rows of a group among which first centres are chosen
_MODEL_CELLS = 1_000_000  # numbers in models that are fitted together
_ROWS, _BLOCK = 100_000, 4096  # rows that a task takes apart by group at once; vectors in a block


def joint_components(df: DataFrame, by: Sequence[str], flags: Sequence[str], n: int = 4, prefix: str = "pc") -> DataFrame:
    """`df` with the first `n` principal components of the flags within each group, as columns pc0, pc1, …

    The products of all flags are summed in one aggregation for all groups; a matrix as wide as the flags is taken apart
    for each group. A component's largest weight is positive, the first one on ties. Flags that are null count as 0.
    """
    n, keep = min(n, len(flags)), df.columns
    row = _numbers(df.join(_components(df, by, flags, n), list(by)), [], flags, n)
    return row.select(*keep, *[F.col("_x")[i].alias(f"{prefix}{i}") for i in range(n)])


def _flags(flags: Sequence[str]) -> dict[str, Column]:
    return {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in flags}


def _components(df: DataFrame, by: Sequence[str], flags: Sequence[str], n: int) -> DataFrame:
    """by, _w: the means of the flags, then their weights in each component."""
    pairs, x = [(a, b) for i, a in enumerate(flags) for b in flags[i:]], _flags(flags)
    sums = df.groupBy(*by).agg(F.count("*").alias("n"), F.array(*[F.sum(x[f]) for f in flags]).alias("s"), F.array(*[F.sum(x[a] * x[b]) for a, b in pairs]).alias("p"))
    return _weights(sums, by, flags, n)


def _weights(sums: DataFrame, by: Sequence[str], flags: Sequence[str], n: int) -> DataFrame:
    """by, _w of the sums: n rows, s of each flag, p of the products of each two."""
    n = min(n, len(flags))

    @F.pandas_udf("array<array<double>>")
    def weights(n_rows: pd.Series, s: pd.Series, p: pd.Series) -> pd.Series:
        out = []
        for rows, sums, products in zip(n_rows, s, p):
            m = np.zeros((len(flags), len(flags)))
            m[np.triu_indices(len(flags))] = products
            m = (m + np.triu(m, 1).T) / rows - np.outer(sums, sums) / rows**2
            values, vectors = np.linalg.eigh(np.round(m, 12))
            top = vectors[:, np.argsort(-values, kind="stable")[:n]].T
            out.append([(v * (1 if v[np.abs(v).round(9).argmax()] >= 0 else -1)).tolist() for v in top])
        return pd.Series(out)

    means = F.transform("s", lambda v: v / F.col("n"))
    return sums.select(*by, F.concat(means, F.flatten(weights("n", "s", "p"))).alias("_w"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    """Arrays of one length as rows; null is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), np.ascontiguousarray(x).ravel())


def _numbers_of(x: np.ndarray, f: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """The features `x`, null, NaN and infinite values as 0, then the first `n` components of the flags `f`; w: means and weights of
    each row, or one for all."""
    k, parts = f.shape[1], [np.where(np.isfinite(x), x, 0.0)] if x.shape[1] else []
    for i in range(n):
        pc = np.zeros(len(f))
        for j in range(k):
            pc += w[:, k * (i + 1) + j] * (np.nan_to_num(f[:, j]) - w[:, j])
        parts.append(pc[:, None])
    return np.hstack(parts)


def _numbers(df: DataFrame, features: Sequence[str], flags: Sequence[str], n: int) -> DataFrame:
    """`df` with an array _x: the features, null, NaN and infinite values as 0, then the components of the flags by _w."""

    @F.arrow_udf("array<double>")
    def numbers(x: pa.Array, f: pa.Array, w: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        return _vectors(_numbers_of(*(_matrix(c, len(x)) for c in (x, f, w)), n))

    def array(columns: Sequence[str]) -> Column:
        return F.array(*[F.col(c).cast("double") for c in columns]).cast("array<double>")

    return df.withColumn("_x", numbers(array(features), array(flags), F.col("_w") if flags else array([])))


class Points:
    """Vectors of groups, packed: a row of `blocks` has the group _g, a number _n of vectors that a task met together, their
    numbers _x one after the other, and _k, how many rows each stands for. So a pass over them hands bytes to Python, not rows."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks

    def filter(self, condition: Column) -> Points:
        return Points(self.blocks.filter(condition))

    def count(self) -> int:
        return self.blocks.agg(F.sum("_n")).first()[0] or 0

    def mapped(self, f: Callable, schema: str, *more: str) -> DataFrame:
        """What `f` yields of (group, vectors, rows that each stands for, `more` columns) of each block."""
        return self.blocks.select("_g", "_n", "_x", "_k", *more).mapInArrow(lambda batches: f(_opened(batches)), schema)


_PACKED = "_g long, _n long, _x binary, _k binary"


def _blocks(found: list) -> pa.RecordBatch:
    """Blocks of (group, vectors, rows that each stands for)."""
    g, x, k = zip(*found)
    values = [pa.array(g, pa.int64()), pa.array([len(v) for v in x], pa.int64()), *(pa.array([np.ascontiguousarray(v).tobytes() for v in c], pa.binary()) for c in (x, k))]
    return pa.RecordBatch.from_arrays(values, names=["_g", "_n", "_x", "_k"])


def _opened(batches):
    for b in batches:
        g, n, x, k, *more = b.columns
        for i in range(b.num_rows):
            rows = n[i].as_py()
            yield g[i].as_py(), np.frombuffer(x[i].as_buffer()).reshape(rows, -1), np.frombuffer(k[i].as_buffer()), *(m[i].as_py() for m in more)


def _packed(df: DataFrame, columns: Sequence[str]) -> Points:
    """The columns of `df` as numbers, null as NaN, by group _g; a row stands for _rows rows."""

    def answer(waiting):
        g, k, *x = (c.to_numpy() for c in pa.Table.from_batches(waiting).columns)
        x = np.column_stack(x)
        parts = [(group, mine[i : i + _BLOCK]) for group, mine in _split(g) for i in range(0, len(mine), _BLOCK)]
        return _blocks([(group, x[mine], k[mine]) for group, mine in parts])

    def run(batches):
        waiting, size = [], 0
        for b in batches:
            waiting, size = [*waiting, b], size + b.num_rows
            if size >= _ROWS:
                yield answer(waiting)
                waiting, size = [], 0
        if size:
            yield answer(waiting)

    numbers = [F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)]
    return Points(df.select("_g", F.col("_rows").cast("double").alias("_rows"), *numbers).mapInArrow(run, _PACKED))


def _packed_weights(points: Points, flags: Sequence[str], width: int, n: int) -> DataFrame:
    """_g, _w of vectors of `width` features and then the flags."""
    upper = np.triu_indices(len(flags))

    def run(blocks):
        found: dict = {}
        for g, x, k in blocks:
            f = np.nan_to_num(x[:, width:])
            whole = f * k[:, None]
            found[g] = found.get(g, 0) + np.concatenate(([k.sum()], whole.sum(0), (whole.T @ f)[upper]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([v.tolist() for v in found.values()], pa.list_(pa.float64()))], names=["_g", "v"])

    each = 1 + len(flags)
    sums = points.mapped(run, "_g long, v array<double>").groupBy("_g").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(each + len(upper[0]))]).alias("v"))
    return _weights(sums.select("_g", F.col("v")[0].alias("n"), F.slice("v", 2, len(flags)).alias("s"), F.slice("v", each + 1, len(upper[0])).alias("p")), ["_g"], flags, n)


def _ranges_of(x: np.ndarray) -> np.ndarray:
    """Numbers of ranges in the order of the values: their first 20 bits."""
    b = (x + 0.0).view(np.int64)
    return (b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))) >> 44


def _summed(keys: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys and the sums of `k` of each."""
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, k, len(keys))


def _counts(names: Sequence[str], rows: list) -> pa.RecordBatch:
    """Rows of (group, number of a column, …, values, counts), where the last two are arrays."""
    size = [len(r[-1]) for r in rows]
    columns = [np.repeat(np.array([r[i] for r in rows], np.int64), size) for i in (0, 1)]
    columns += [np.concatenate([r[i] for r in rows]) for i in range(2, len(names))]
    columns[-1] = columns[-1].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(names))


def _scales(points: Points, n: int, width: int, some: Sequence[str]) -> DataFrame:
    """_g, _s: medians of all numbers of a group's vectors, then their interquartile ranges (1 where that is 0), for all groups
    at once: rows are counted by ranges of values first, then values in those ranges that hold a quartile."""

    def ranges(blocks):
        found: dict = {}
        for g, x, k, *w in blocks:
            x = _numbers_of(x[:, :width], x[:, width:], np.array(w), n)
            for f in range(x.shape[1]):
                keys, sums = _summed(_ranges_of(np.ascontiguousarray(x[:, f])), k)
                old = found.get((g, f))
                found[g, f] = (keys, sums) if old is None else _summed(np.concatenate((old[0], keys)), np.concatenate((old[1], sums)))
        if found:
            yield _counts(["_g", "_f", "_range", "_k"], [(*at, *v) for at, v in found.items()])

    def values(blocks):
        waiting, size = [], 0
        for g, x, k, held, *w in blocks:
            x = _numbers_of(x[:, :width], x[:, width:], np.array(w), n)
            for f, wanted in held:  # the entries of a map
                z = np.ascontiguousarray(x[:, f])
                mine = np.isin(_ranges_of(z), wanted)
                z, sums = _summed(z[mine] + 0.0, k[mine])
                waiting, size = [*waiting, (g, f, _ranges_of(z), z, sums)], size + len(z)
            if size >= _ROWS:
                yield _counts(["_g", "_f", "_range", "_z", "_k"], waiting)
                waiting, size = [], 0
        if size:
            yield _counts(["_g", "_f", "_range", "_z", "_k"], waiting)

    by, quarters = ["_g", "_f"], (0.25, 0.5, 0.75)
    held = held_ranges(points.mapped(ranges, "_g long, _f long, _range long, _k long", *some), by, quarters)
    wanted = held.groupBy(*by).agg(F.collect_list("_range").alias("_r")).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_f", "_r"))).alias("_held"))
    near = Points(points.blocks.join(written(wanted), "_g")).mapped(values, "_g long, _f long, _range long, _z double, _k long", "_held", *some)
    q = percentiles_in_ranges(written(near), held, by, "_z", quarters)
    q = q.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_f", "q"))).alias("_q"))  # one entry for each number
    width_of = lambda e: F.when(e["q"][2] > e["q"][0], e["q"][2] - e["q"][0]).otherwise(1.0)
    return q.select("_g", F.concat(F.transform("_q", lambda e: e["q"][1]), F.transform("_q", width_of)).alias("_s"))


def _scaled_of(x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Vectors less their medians, over their ranges; s: these of each row, or one for all."""
    return (x - s[:, : x.shape[1]]) / s[:, x.shape[1] :]


def _scaled(df: DataFrame) -> DataFrame:
    """`df` with an array _v: the numbers of _x less their medians, over their ranges, as _s says."""

    @F.arrow_udf("array<double>")
    def scaled(x: pa.Array, s: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        return _vectors(_scaled_of(_matrix(x, len(x)), _matrix(s, len(x))))

    return df.withColumn("_v", scaled("_x", "_s"))


def _first_centres(points: DataFrame, sizes: DataFrame, key: str, ks: Sequence[int], seed: int, vectors: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """_g, models: for each k the first centres, chosen among the rows of a group with the smallest hashes of `key`: first
    the one nearest to their mean, then always the one farthest from those chosen. `vectors` adds _v to these rows. sizes: _g, and
    _size, the rows of a group, as `points` has too."""
    hashed = F.xxhash64(F.col(key), F.lit(seed))
    order = [hashed, F.col(key)]
    # hashes below a bound that about four times as many rows pass are put in order; all of them, should a group have too few
    near = written(points.filter(hashed.cast("double") <= F.least(F.lit(1.0), F.lit(4.0 * _SEED_ROWS) / F.col("_size")) * 2.0**64 - 2.0**63))
    met = sizes.join(near.groupBy("_g").agg(F.count("*").alias("_near")), "_g", "left")
    if not met.filter(F.coalesce("_near", F.lit(0)) < F.least(F.lit(_SEED_ROWS), F.col("_size"))).isEmpty():
        near = points
    some = near.withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(*order))).filter(F.col("_r") <= _SEED_ROWS)
    rows = vectors(some).groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_r", "_v"))).alias("_rows"))
    most = max(ks)

    @F.pandas_udf("array<array<double>>")
    def spread(rows: pd.Series) -> pd.Series:
        out = []
        for group in rows:
            x = np.array([r["_v"] for r in group], float)
            picked = [int(((x - x.mean(0)) ** 2).sum(1).round(9).argmin())]
            near = ((x - x[picked[0]]) ** 2).sum(1)
            while len(picked) < most:
                picked.append(int(near.round(9).argmax()))
                near = np.minimum(near, ((x - x[picked[-1]]) ** 2).sum(1))
            out.append(x[picked].tolist())
        return pd.Series(out)

    chosen = rows.select("_g", spread("_rows").alias("_c"))
    return chosen.select("_g", F.array(*[F.struct(F.lit(k).alias("k"), F.slice("_c", 1, k).alias("centres")) for k in ks]).alias("models"))


Models = dict[int, dict[int, np.ndarray]]


def _split(g: np.ndarray):
    """(group, its rows) of each group among `g`."""
    order = np.argsort(g, kind="stable")
    stops = np.flatnonzero(np.diff(g[order], append=-1))
    for rows in np.split(order, stops[:-1] + 1) if len(g) else ():
        yield int(g[rows[0]]), rows


def _assigned(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centre of each row, the first one on ties."""
    d = np.stack([((x - c) ** 2).sum(1) for c in centres], 1)
    c = d.argmin(1)
    return c, d[np.arange(len(x)), c]


def _members(x: np.ndarray, q: np.ndarray, models: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each k which rows (columns) each centre has by `_assigned`, from one product with all centres; rows for which that
    product can't tell the nearest centres apart are asked exactly. q: squared lengths of the rows."""
    every = np.concatenate(list(models.values()))
    size = (every * every).sum(1)
    d = np.column_stack((size, -2 * every)) @ np.column_stack((np.ones(len(x)), x)).T
    slack = 1e-12 * (q + size.max())
    out, at = {}, 0
    for k, centres in models.items():
        mine, at = d[at : at + len(centres)], at + len(centres)
        held = mine <= mine.min(0) + slack
        if len(close := np.flatnonzero(held.sum(0, dtype=np.int32) != 1)):
            held[:, close] = False
            held[_assigned(x[close], centres)[0], close] = True
        out[k] = held
    return out


def _nearest(x: np.ndarray, q: np.ndarray, models: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """For each k the numbers that `_assigned` finds."""
    return {k: held.argmax(0) for k, held in _members(x, q, models).items()}


def _cluster_sums(points: Points, models: Models) -> dict:
    """(group, k, c) -> rows, sum of squared lengths, sum of vectors. Each task adds up what it reads and sends one row for each
    group, k and centre that it met; Spark adds these up."""

    def run(blocks):
        found: dict = {}
        for g, x, n in blocks:
            q = (x * x).sum(1)
            whole = np.column_stack((np.ones(len(x)), q, x)) * n[:, None]
            new = np.concatenate(list(_members(x, q, models[g]).values())).astype(float) @ whole  # a row for each centre of each k
            found[g] = found[g] + new if g in found else new
        rows = []
        for g, sums in found.items():
            names = [(k, j) for k, centres in models[g].items() for j in range(len(centres))]
            rows += [(g, k, j, s.tolist()) for (k, j), s in zip(names, sums) if s[0]]
        if rows:
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in list(zip(*rows))[:3]), pa.array([r[3] for r in rows], pa.list_(pa.float64()))], names=["_g", "k", "c", "s"])

    width = 2 + next(iter(next(iter(models.values())).values())).shape[1]
    sums = points.mapped(run, "_g long, k long, c long, s array<double>").groupBy("_g", "k", "c").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
    return {(r["_g"], r["k"], r["c"]): np.array(r["s"]) for r in sums.collect()}  # as many as centres


def _silhouettes(points: Points, models: Models) -> dict:
    """(group, k) -> mean silhouette: (b - a) / max(a, b) of each row, where a and b are mean squared distances to its own
    cluster and to the nearest other one, from each cluster's count and sums, without pairs of rows. Rows alone in their
    cluster count 0, and so does a model with one cluster left."""
    stats: dict = {}
    for (g, k, c), s in _cluster_sums(points, models).items():
        stats.setdefault((g, k), {})[c] = s

    def run(blocks):
        found: dict = {}
        for g, x, w in blocks:
            q = (x * x).sum(1)
            for k, c in _nearest(x, q, models[g]).items():
                here = stats[g, k]
                names = sorted(here)
                n, mean_q, y = (np.array([here[c][0] for c in names]), np.array([here[c][1] / here[c][0] for c in names]), np.array([here[c][2:] / here[c][0] for c in names]))
                own = np.searchsorted(names, c)
                d = np.maximum(q[:, None] + mean_q - 2 * x @ y.T, 0)
                rows = np.arange(len(x))
                a = d[rows, own] * n[own] / np.maximum(n[own] - 1, 1)
                d[rows, own] = np.inf
                b = d.min(1)
                most = np.maximum(a, b)
                s = np.where((n[own] > 1) & np.isfinite(b) & (most > 0), (b - a) / np.where(np.isfinite(most) & (most > 0), most, 1), 0.0)
                found[g, k] = found.get((g, k), 0) + np.array([w.sum(), (s * w).sum()])
        if found:
            groups, numbers = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(numbers, pa.int64()), *(pa.array([v[i] for v in found.values()], pa.float64()) for i in (0, 1))], names=["_g", "k", "n", "s"])

    out = points.mapped(run, "_g long, k long, n double, s double").groupBy("_g", "k").agg((F.sum("s") / F.sum("n")).alias("s"))
    return {(r["_g"], r["k"]): r["s"] for r in out.collect()}  # as many as models


def _fit(points: Points, first: DataFrame, ks: Sequence[int], least: float, fallback: int, rounds: int) -> dict[int, tuple[int, float, np.ndarray]]:
    """k, silhouette and centres of each group among `points`, whose models are of bounded size together."""
    models: Models = {r["_g"]: {m["k"]: np.array(m["centres"], float) for m in r["models"]} for r in first.collect()}
    moving = models
    for _ in range(rounds):
        if not moving:
            break
        steps = dict.fromkeys(moving, 0.0)
        for (g, k, c), s in _cluster_sums(points.filter(F.col("_g").isin(*moving)) if len(moving) < len(models) else points, moving).items():
            new = s[2:] / s[0]
            steps[g] = max(steps[g], ((new - models[g][k][c]) ** 2).sum())
            models[g][k][c] = new
        moving = {g: models[g] for g, step in steps.items() if step > 1e-9}
    scores = _silhouettes(points, models) if models else {}
    best: dict = {}
    for g in models:
        k = max(ks, key=lambda k: (round(scores[g, k], 9), -k))
        s = scores[g, k]
        k = k if s >= least else fallback
        best[g] = (k, s, models[g][k])
    return best


def _placed(rows: DataFrame, best: dict[int, tuple[int, float, np.ndarray]], features: Sequence[str], flags: Sequence[str], n: int, scales: dict, weights: dict) -> DataFrame:
    """`rows` with cluster, k, silhouette and distance. scales, weights: _s and _w of each group."""
    width = len(features)

    @F.arrow_udf("struct<cluster: int, k: int, silhouette: double, distance: double>")
    def place(g: pa.Array, *columns: pa.Array) -> pa.Array:
        x, out = np.column_stack([c.to_numpy(zero_copy_only=False) for c in columns]), np.zeros((len(g), 4))
        for group, mine in _split(g.to_numpy(zero_copy_only=False)):
            k, s, centres = best[group]
            v = _numbers_of(x[mine, :width], x[mine, width:], weights.get(group), n)
            c, d = _assigned(_scaled_of(v, scales[group]), centres)
            out[mine] = np.stack([c, np.full(len(c), k), np.full(len(c), s), np.sqrt(d)], 1)
        c, k, s, d = out.T
        return pa.StructArray.from_arrays([pa.array(c.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(s.copy()), pa.array(d.copy())], names=["cluster", "k", "silhouette", "distance"])

    return rows.withColumn("_p", place("_g", *[F.col(c).cast("double") for c in [*features, *flags]])).select("*", "_p.*").drop("_p")


def group_clusters(df: DataFrame, by: Sequence[str], key: str, features: Sequence[str], flags: Sequence[str] = (), ks: Sequence[int] = (3, 4, 5, 6, 7), components: int = 4, least: float = 0.1, fallback: int = 4, few: int = 100, rounds: int = 20, seed: int = 42) -> DataFrame:
    """`df` with cluster, k, silhouette and distance: a k-means model of its own for each group of `by`.

    A group's features are its numbers and the first components of its flags, robustly scaled inside the group. Of `ks`
    the k with the best silhouette (squared distances) is taken, the smaller one on ties, or `fallback` if none reaches
    `least`. Groups of fewer than `few` rows are one cluster (k and silhouette null, distance 0). Null keys of `by` are
    a group. `key` must tell a group's rows apart; rows that repeat it and all values fall into one cluster.

    All models of all groups are fitted together: a round assigns each row to a centre for each k and adds up the
    vectors by group, k and centre, so the number of jobs depends on the rounds only. A group is done when none of its
    centres moves; a centre without rows stays. Equal rows of a group are counted first and stand for each other, so
    rounds work on what is different; no row is shuffled in a round, so a group may hold any share of the rows.
    Models are groups x sum(ks) x features numbers. They go to the tasks, and so groups whose models are over a million
    numbers together are dealt into parts that are fitted one after the other, with the same result.
    """
    names = {c: f"_by{i}" for i, c in enumerate(by)}
    # one text per group, so that nulls are a group too; what is not null begins with =
    rows = written(df.withColumns({n: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c, n in names.items()}))  # `df` is worked out once
    keys, n = list(names.values()), min(components, len(flags))
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("_size")).withColumn("_g", F.monotonically_increasing_id()))
    large = sizes.filter(F.col("_size") >= few)
    members = rows.join(large, keys)
    # from here on rounds and percentiles read vectors packed by group, and what belongs to a group is joined to its blocks
    cells = members.groupBy("_g", *dict.fromkeys([*features, *flags])).agg(F.count("*").alias("_rows"))
    raw, width, some = Points(written(_packed(cells, [*features, *flags]).blocks)), len(features), ["_w"] if flags else []
    weights = written(_packed_weights(raw, flags, width, n)) if flags else None

    def weighed(x: DataFrame) -> DataFrame:
        return x if weights is None else x.join(weights, "_g")

    raw = Points(weighed(raw.blocks))
    scales = written(_scales(raw, n, width, some))

    def scaled(blocks):
        waiting, size = [], 0
        for g, x, k, s, *w in blocks:
            waiting, size = [*waiting, (g, _scaled_of(_numbers_of(x[:, :width], x[:, width:], np.array(w), n), np.array([s])), k)], size + len(x)
            if size >= _ROWS:
                yield _blocks(waiting)
                waiting, size = [], 0
        if size:
            yield _blocks(waiting)

    points = Points(written(Points(raw.blocks.join(scales, "_g")).mapped(scaled, _PACKED, "_s", *some)))

    def vectors(x: DataFrame) -> DataFrame:
        return _scaled(_numbers(weighed(x.join(scales, "_g")), features, flags, n))

    first = written(_first_centres(members, large.select("_g", "_size"), key, sorted({*ks, fallback}), seed, vectors))
    dealt = -(-first.count() * sum({*ks, fallback}) * (len(features) + n) // _MODEL_CELLS) or 1
    shown, done = ["cluster", "k", "silhouette", "distance"], []
    for i in range(dealt):
        part = F.pmod(F.xxhash64("_g"), F.lit(dealt)) == i if dealt > 1 else F.lit(True)
        best = _fit(points.filter(part), first.filter(part), ks, least, fallback, rounds)
        kept = [{} if t is None else {r["_g"]: np.array([r[c]]) for r in t.filter(part).collect()} for t, c in ((scales, "_s"), (weights, "_w"))]  # fewer numbers than the models
        done.append(_placed(members.filter(part), best, features, flags, n, *kept).select(*df.columns, *shown))
    small = rows.join(sizes.filter(F.col("_size") < few).select(*keys), keys)
    small = small.withColumns({"cluster": F.lit(0), "k": F.lit(None).cast("int"), "silhouette": F.lit(None).cast("double"), "distance": F.lit(0.0)}).select(*df.columns, *shown)
    return reduce(DataFrame.unionByName, [*done, small])
