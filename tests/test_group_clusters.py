"""Joint k-means against single fits in numpy."""

import numpy as np
from pyspark.sql import functions as F

from shokuba.operators.group_clusters import group_clusters, joint_components


def blobs(seed, n, k, spread=0.2):
    r = np.random.default_rng(seed)
    middles = r.normal(size=(k, 2)) * 6
    at = r.integers(0, k, n)
    return middles[at] + r.normal(size=(n, 2)) * spread, r.integers(0, 2, (n, 3))


def single(x, flags, ids, hashes, ks=(3, 4, 5), fallback=4, least=0.1, rounds=20):
    """One group's model, step by step as documented."""
    centred = flags - flags.mean(0)
    values, vectors = np.linalg.eigh(np.round((flags.T @ flags) / len(flags) - np.outer(flags.mean(0), flags.mean(0)), 12))
    top = vectors[:, np.argsort(-values, kind="stable")[:2]].T
    top = np.array([v * (1 if v[np.abs(v).round(9).argmax()] >= 0 else -1) for v in top])
    raw = np.hstack([x, centred @ top.T])
    q1, q2, q3 = np.percentile(raw, [25, 50, 75], axis=0)
    v = (raw - q2) / np.where(q3 > q1, q3 - q1, 1)
    some = v[np.lexsort((ids, hashes))[:256]]
    picked = [int(((some - some.mean(0)) ** 2).sum(1).round(9).argmin())]
    while len(picked) < max(ks):
        picked.append(int(np.min([((some - some[p]) ** 2).sum(1) for p in picked], 0).round(9).argmax()))
    best = {}
    for k in sorted({*ks, fallback}):
        c = some[picked[:k]].copy()
        for _ in range(rounds):
            near = ((v[:, None] - c) ** 2).sum(2).argmin(1)
            new = np.array([v[near == j].mean(0) if (near == j).any() else c[j] for j in range(k)])
            step, c = ((new - c) ** 2).sum(1).max(), new
            if step <= 1e-9:
                break
        d = ((v[:, None] - c) ** 2).sum(2)
        near = d.argmin(1)
        pair = ((v[:, None] - v) ** 2).sum(2)
        s = []
        for i, own in enumerate(near):
            n = (near == own).sum()
            others = [pair[i, near == j].mean() for j in set(near) - {own}]
            if n == 1 or not others:
                s.append(0.0)
                continue
            a, b = pair[i, near == own].sum() / (n - 1), min(others)
            s.append((b - a) / max(a, b))
        best[k] = (np.mean(s), near, np.sqrt(d.min(1)))
    top_k = max(ks, key=lambda k: (round(best[k][0], 9), -k))
    k = top_k if best[top_k][0] >= least else fallback
    return k, best[top_k][0], best[k][1], best[k][2]


def test_models_of_all_groups_equal_single_fits(spark):
    rows, groups = [], {"a": (1, 300, 3), "b": (2, 180, 5), None: (3, 120, 4), "few": (4, 30, 3)}
    for g, (seed, n, k) in groups.items():
        x, flags = blobs(seed, n, k)
        rows += [(g, 1000 * seed + i, float(p[0]), float(p[1]), *map(bool, f)) for i, (p, f) in enumerate(zip(x, flags))]
    df = spark.createDataFrame(rows, "g string, id long, x double, y double, f0 boolean, f1 boolean, f2 boolean").repartition(4)
    got = group_clusters(df, ["g"], "id", ["x", "y"], ["f0", "f1", "f2"], ks=(3, 4, 5), components=2).collect()
    hashes = {r["id"]: r["h"] for r in df.select("id", F.xxhash64(F.col("id"), F.lit(42)).alias("h")).collect()}
    assert len(got) == len(rows)
    for g in groups:
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["id"])
        if g == "few":
            assert all((r["cluster"], r["k"], r["distance"]) == (0, None, 0.0) for r in mine)
            continue
        table = [r for r in sorted(rows, key=lambda r: r[1]) if r[0] == g]
        ids = np.array([r[1] for r in table])
        k, s, cluster, distance = single(np.array([r[2:4] for r in table]), np.array([r[4:] for r in table], float), ids, np.array([hashes[i] for i in ids]))
        assert {r["k"] for r in mine} == {k} and abs(mine[0]["silhouette"] - s) < 1e-6
        assert [r["cluster"] for r in mine] == cluster.tolist()
        assert np.allclose([r["distance"] for r in mine], distance)


def test_odd_groups(spark):
    same = [("s", i, 1.0, None) for i in range(150)] + [("n", i, float("nan"), 2.0) for i in range(120)]
    df = spark.createDataFrame(same, "g string, id long, x double, y double")
    got = group_clusters(df, ["g"], "id", ["x", "y"]).collect()
    assert {(r["g"], r["cluster"], r["distance"]) for r in got} == {("s", 0, 0.0), ("n", 0, 0.0)} and len(got) == 270
    assert group_clusters(df.limit(0), ["g"], "id", ["x"]).count() == 0


def test_components_of_constant_flags_are_zero(spark):
    df = spark.createDataFrame([("g", True, None), ("g", True, None)], "g string, a boolean, b boolean")
    assert {(r["pc0"], r["pc1"]) for r in joint_components(df, ["g"], ["a", "b"], 2).collect()} == {(0.0, 0.0)}


def test_rows_are_worked_out_once_and_equal_ones_stand_for_each_other(spark, monkeypatch):
    from shokuba.operators import group_clusters as G

    made, sizes, sums = spark.sparkContext.accumulator(0), [], G._cluster_sums

    def make(i):
        made.add(1)
        return float(i % 40 // 8 * 10 + i % 8)

    def counted(points, models):
        sizes.append(points.count())
        return sums(points, models)

    monkeypatch.setattr(G, "_cluster_sums", counted)
    df = spark.range(400, numPartitions=2).select("id", F.lit("g").alias("g"), F.udf(make, "double")("id").alias("x"))
    got = G.group_clusters(df, ["g"], "id", ["x"], ks=(5,)).collect()
    assert made.value == 400 and set(sizes) == {40}
    assert len(got) == 400 and len({(r["x"] // 10, r["cluster"]) for r in got}) == 5


def test_nearest_equals_exact_distances_on_ties():
    from shokuba.operators.group_clusters import _assigned, _nearest

    r = np.random.default_rng(5)
    x = r.integers(-3, 4, (500, 2)) + 1e8  # many rows lie between two centres; lengths hide their distances
    models = {k: r.integers(-3, 4, (k, 2)) + 1e8 + 0.5 for k in (3, 5)}
    got = _nearest(x, (x * x).sum(1), models)
    assert all((got[k] == _assigned(x, c)[0]).all() for k, c in models.items())


def test_rounds_read_blocks_and_quartiles_few_values(spark, monkeypatch):
    """Python gets blocks of vectors, not rows, and of many different values only those near a quartile are put in order."""
    from shokuba.operators import group_clusters as G

    ordered, blocks, found, sums = [], [], G.percentiles_in_ranges, G._cluster_sums
    monkeypatch.setattr(G, "percentiles_in_ranges", lambda some, *a: ordered.append(some.count()) or found(some, *a))
    monkeypatch.setattr(G, "_cluster_sums", lambda points, models: blocks.append((points.blocks.count(), points.count())) or sums(points, models))
    df = spark.range(9000, numPartitions=2).select("id", F.concat(F.lit("g"), F.col("id") % 2).alias("g"), (F.col("id") % 5 * 1e4 + F.col("id") * 0.37 - 3000).alias("x"), (F.col("id") % 2 == 0).alias("f"))
    got = G.group_clusters(df, ["g"], "id", ["x"], ["f"], ks=(5,), components=1).collect()
    assert len(got) == 9000 and {r["k"] for r in got} == {5}
    assert max(ordered) < 900 and blocks[0][1] == 9000 and max(b for b, _ in blocks) <= 16


def test_scales_are_exact_quartiles_of_weighted_rows(spark):
    from shokuba.operators import group_clusters as G

    r = np.random.default_rng(8)
    x, k = np.concatenate([r.normal(size=300) * 1e-3, -r.integers(0, 4, 200) * 1e6, [0.0, -0.0, np.nan, np.inf]]), r.integers(1, 4, 504)
    df = spark.createDataFrame([(g, float(v) * (1 + g), int(n)) for g in (0, 1) for v, n in zip(x, k)], "_g long, x double, _rows long").repartition(3)
    got = {row["_g"]: row["_s"] for row in G._scales(G._packed(df, ["x"]), 0, 1, []).collect()}
    for g in (0, 1):
        low, middle, high = np.percentile(np.repeat(np.where(np.isfinite(x), x * (1 + g), 0), k), [25, 50, 75])
        assert np.allclose(got[g], [middle, high - low], rtol=1e-12)


def test_each_row_has_one_centre_however_large():
    from shokuba.operators.group_clusters import _members

    x = np.array([[1e200, -1e200], [1e308, 1e308], [0.0, 0.0], [3.0, 4.0]])
    with np.errstate(all="ignore"):
        held = _members(x, (x * x).sum(1), {2: np.array([[1e200, 1e200], [3.0, 4.0]])})[2]
    assert (held.sum(0) == 1).all() and held[:, 3].tolist() == [False, True]


def test_first_centres_do_not_depend_on_the_bound_of_hashes(spark, monkeypatch):
    """A group that has too few rows below the bound is put in order as a whole."""
    from shokuba.operators import group_clusters as G

    df = spark.range(3000, numPartitions=3).select(F.lit(0).cast("long").alias("_g"), F.lit(3000).cast("long").alias("_size"), "id", F.array(F.col("id") % 97 * 1.5, F.col("id") % 31 * 2.0).alias("_v"))
    got = [G._first_centres(df, spark.createDataFrame([(0, size)], "_g long, _size long"), "id", [3], 42, lambda x: x).collect() for size in (3000,)]
    low = df.withColumn("_size", F.lit(300_000).cast("long"))
    got.append(G._first_centres(low, spark.createDataFrame([(0, 3000)], "_g long, _size long"), "id", [3], 42, lambda x: x).collect())
    assert got[0] == got[1] and len(got[0][0]["models"][0]["centres"]) == 3
