"""Flows between places: edges, nodes, matrices, distances, and graph measures by DataFrame rounds."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shokuba.operators.core import cross, known, mode, outer_counts
from shokuba.operators.stats import percentiles
from shokuba.sources.scratch import cut_lineage


def flow_edges(people: DataFrame, areas: DataFrame, person: str, origin: str, destination: str) -> DataFrame:
    """One row per person and desired place other than their own; repeated wishes count."""
    out = people.join(areas, person)
    return out.filter(F.col(origin) != F.col(destination))


def aggregate_flow(edges: DataFrame, ends: Sequence[str], unknown: str = "unknown") -> DataFrame:
    """Per pair of places: flow, mean age, modal gender."""
    return cross(edges, ends, [F.avg("age").alias("avg_age"), F.coalesce(mode("gender"), F.lit(unknown)).alias("gender_mode")]).withColumnRenamed("count", "flow_count")


def flow_nodes(edges: DataFrame, person: str, origin: str, destination: str) -> DataFrame:
    """Per place: inflow, outflow, net flow and the people at either end."""
    # a person's edges first become one row for each pair of places, then one for each place; no row is held twice
    pairs = edges.groupBy(person, origin, destination).agg(F.count("*").alias("n"))
    end = lambda place, i, o: F.struct(F.col(place).alias("location"), F.col(i).alias("i") if i else F.lit(0).cast("long").alias("i"), F.col(o).alias("o") if o else F.lit(0).cast("long").alias("o"))
    both = pairs.select(person, F.explode(F.array(end(destination, "n", None), end(origin, None, "n"))).alias("e")).select(person, "e.*")
    once = both.groupBy(person, "location").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    out = once.groupBy("location").agg(F.sum("i").alias("inflow"), F.sum("o").alias("outflow"), F.count(person).alias("applicant_count"))
    return out.withColumn("net_flow", F.col("inflow") - F.col("outflow"))


def node_class(nodes: DataFrame) -> DataFrame:
    """hub above 0.7 of all flow inward, source below 0.3, balanced from 0.45 to 0.55, else leaning."""
    ratio = F.try_divide(F.col("inflow").cast("double"), F.col("inflow") + F.col("outflow"))
    kind = F.when(ratio > 0.7, "hub").when(ratio < 0.3, "source").when(ratio.between(0.45, 0.55), "balanced").when(ratio > 0.55, "leaning in").otherwise("leaning out")
    return nodes.withColumn("in_ratio", ratio).withColumn("node_class", kind)


def flow_balance(edges: DataFrame, origin: str, destination: str, count: str) -> DataFrame:
    """Per place: inflow, outflow, net flow and the inward share of all flow."""
    i = edges.groupBy(F.col(destination).alias("place")).agg(F.sum(count).alias("inflow"))
    o = edges.groupBy(F.col(origin).alias("place")).agg(F.sum(count).alias("outflow"))
    out = outer_counts(i, o, ["place"]).withColumn("net_flow", F.col("inflow") - F.col("outflow"))
    return out.withColumn("in_share", F.try_divide(F.col("inflow").cast("double"), F.col("inflow") + F.col("outflow")))


def realistic(edges: DataFrame, origin: str, destination: str, adjacent: DataFrame, drawn: DataFrame | None = None) -> DataFrame:
    """Edges within one region or between regions that `adjacent` (src, dst) lists in either direction, or that `drawn`
    (src, dst) lists in this one. Both are dimension tables; the edges may be counts, so that few rows meet them."""
    near = adjacent.select("src", "dst").union(adjacent.select("dst", "src"))
    if drawn is not None:
        near = near.union(drawn.select("src", "dst"))
    same = edges.filter(F.col(origin) == F.col(destination))
    other = edges.filter(F.col(origin) != F.col(destination))
    return same.unionByName(other.join(near.distinct(), (F.col(origin) == F.col("src")) & (F.col(destination) == F.col("dst")), "left_semi"))


def within_steps(adjacent: DataFrame, steps: int) -> DataFrame:
    """src, dst, steps: places that are reached over at most `steps` borders, with the fewest; a place itself is left out.

    adjacent (src, dst) is a dimension table and counts in either direction; a round joins it once.
    """
    both = adjacent.select("src", "dst").union(adjacent.select("dst", "src")).distinct().filter("src <> dst")
    out = both.withColumn("steps", F.lit(1))
    for i in range(2, steps + 1):
        further = out.filter(F.col("steps") == i - 1).join(both.toDF("dst", "_next"), "dst").select("src", F.col("_next").alias("dst"), F.lit(i).alias("steps"))
        out = out.union(further.filter("src <> dst")).groupBy("src", "dst").agg(F.min("steps").alias("steps"))
    return out


def neighbour_ranks(table: DataFrame, place: str, value: str, near: DataFrame) -> DataFrame:
    """Each place (one row in `table`) among its neighbours in near (src, dst): how many have a value, their mean, how far
    it lies off that mean, and its rank with them, equal values sharing one. Without neighbours rank 1, mean null."""
    other = table.select(F.col(place).alias("dst"), F.col(value).alias("_other"))
    of_place = near.join(other, "dst").select(F.col("src").alias(place), "_other")
    out = table.select(place, value).join(of_place, place, "left").groupBy(place, value)
    out = out.agg(F.count("_other").alias("neighbours"), F.avg("_other").alias("neighbour_mean"), (F.count_if(F.col("_other") > F.col(value)) + 1).alias("rank"))
    return out.withColumn("deviation", F.col(value) - F.col("neighbour_mean"))


def hub_scores(edges: DataFrame, origin: str, destination: str) -> DataFrame:
    """Hub score of a place: distinct sources x distinct destinations."""
    i = edges.groupBy(F.col(destination).alias("place")).agg(F.countDistinct(origin).alias("in_degree"))
    o = edges.groupBy(F.col(origin).alias("place")).agg(F.countDistinct(destination).alias("out_degree"))
    return outer_counts(i, o, ["place"]).withColumn("hub_score", F.col("in_degree") * F.col("out_degree"))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in km; null if a coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * radius)


def mobility_type(km: Column, same_region: Column) -> Column:
    """same below 0.001 km, near below 30, middle below 80, far beyond; another region is always far, null distance too."""
    return F.when(~same_region | km.isNull(), "far").when(km < 0.001, "same").when(km < 30, "near").when(km < 80, "middle").otherwise("far")


def distance_profile(trips: DataFrame, by: Sequence[str], km: str = "distance_km", measures: Sequence[Column] = ()) -> DataFrame:
    """Per group: count, mean, median, quartiles, range and sample deviation of distances, modal distance in tens of km,
    and further measures. Null keys are left out."""
    out = known(trips, by).groupBy(*by).agg(
        F.count("*").alias("count"), F.avg(km).alias("avg_km"), F.min(km).alias("min_km"), F.max(km).alias("max_km"),
        F.stddev_samp(km).alias("std_km"), mode(F.floor(F.col(km) / 10) * 10).alias("mode_km"), *measures,
    ).join(percentiles(trips, by, km, (0.25, 0.5, 0.75), "_q"), list(by), "left")
    return out.select("*", F.col("_q")[0].alias("q25_km"), F.col("_q")[1].alias("median_km"), F.col("_q")[2].alias("q75_km")).drop("_q")


def with_coordinates(df: DataFrame, places: DataFrame, on: Sequence[str], centres: DataFrame | None = None, region: str | None = None) -> DataFrame:
    """lat and lng from a table of places, else from the centres of their regions; both are dimension tables."""
    out = df.join(places.select(*on, F.col("lat").alias("_lat"), F.col("lng").alias("_lng")), list(on), "left")
    if centres is None:
        return out.withColumnsRenamed({"_lat": "lat", "_lng": "lng"})
    out = out.join(centres.select(region, F.col("lat").alias("_clat"), F.col("lng").alias("_clng")), region, "left")
    return out.withColumn("lat", F.coalesce("_lat", "_clat")).withColumn("lng", F.coalesce("_lng", "_clng")).drop("_lat", "_lng", "_clat", "_clng")


def within_radius(points: DataFrame, lat: float, lng: float, km: float) -> DataFrame:
    """Points at most `km` from a centre; a box on lat and lng prunes the scan before distances are taken."""
    from math import cos, radians

    dlat, dlng = km / 111.0, km / max(1e-9, 111.0 * cos(radians(lat)))
    box = points.filter(F.col("lat").between(lat - dlat, lat + dlat) & F.col("lng").between(lng - dlng, lng + dlng))
    return box.withColumn("distance_km", haversine(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))).filter(F.col("distance_km") <= km)


def point_in_polygon(points: DataFrame, polygons: DataFrame, cell: float = 0.1) -> DataFrame:
    """Points with the name of each polygon (name, ring: array<struct<lat,lng>>) that holds them, by ray casting.

    A polygon covers the grid cells of its bounding box; points meet it by cell, so the join is an equality.
    """
    lats, lngs = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lng"])
    box = polygons.select("name", "ring", F.array_min(lats).alias("x0"), F.array_max(lats).alias("x1"), F.array_min(lngs).alias("y0"), F.array_max(lngs).alias("y1"))
    step = lambda c: F.floor(F.col(c) / cell)
    box = box.withColumn("cx", F.explode(F.sequence(step("x0"), step("x1")))).withColumn("cy", F.explode(F.sequence(step("y0"), step("y1"))))
    near = points.withColumn("cx", step("lat")).withColumn("cy", step("lng")).join(box, ["cx", "cy"])
    n = F.size("ring")

    def crosses(i: Column) -> Column:
        a, b = F.element_at("ring", i), F.element_at("ring", i % n + 1)
        straddles = (a["lng"] > F.col("lng")) != (b["lng"] > F.col("lng"))
        return F.when(straddles, F.col("lat") < (b["lat"] - a["lat"]) * (F.col("lng") - a["lng"]) / (b["lng"] - a["lng"]) + a["lat"]).otherwise(False)

    inside = F.size(F.filter(F.sequence(F.lit(1), n), crosses)) % 2 == 1
    return near.filter(inside).drop("cx", "cy", "ring", "x0", "x1", "y0", "y1")


def spread_score(areas: DataFrame, person: str) -> DataFrame:
    """How widely a person's desired places lie: 50 x deviation of the coordinates + 0.3 x largest distance (degrees x
    111 km), at most 100, with bands at 70, 40 and 10. A person has at most as many places as there are municipalities."""
    points = F.array_sort(F.collect_set(F.struct("lat", "lng")))
    one = areas.filter("lat is not null and lng is not null").groupBy(person).agg(points.alias("p"), F.stddev_pop("lat").alias("a"), F.stddev_pop("lng").alias("b"))
    apart = F.array_max(F.flatten(F.transform("p", lambda x: F.transform("p", lambda y: F.sqrt(F.pow(x["lat"] - y["lat"], 2) + F.pow(x["lng"] - y["lng"], 2)) * 111))))
    score = F.least(F.lit(100.0), (F.col("a") + F.col("b")) / 2 * 50 + apart * 0.3)
    band = F.when(score >= 70, "A").when(score >= 40, "B").when(score >= 10, "C").otherwise("D")
    return one.select(person, F.size("p").alias("places"), score.alias("spread_score"), band.alias("spread_band"))


def degree_centrality(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """In-, out- and total degree of each node over n - 1 (edges are distinct pairs)."""
    n = F.lit(max(1, nodes.count() - 1)).cast("double")
    i = edges.groupBy(F.col(dst).alias("node")).agg(F.count("*").alias("i"))
    o = edges.groupBy(F.col(src).alias("node")).agg(F.count("*").alias("o"))
    out = nodes.select("node").join(i, "node", "left").join(o, "node", "left").fillna(0)
    return out.select("node", ((F.col("i") + F.col("o")) / n).alias("degree"), (F.col("i") / n).alias("in_degree"), (F.col("o") / n).alias("out_degree"))


def page_rank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """Weighted PageRank (src, dst, weight): node, pagerank. The mass of nodes without way out is spread over all.

    Every round is a join and a sum; the table of ranks is cut off its lineage each round and the sum of changes
    is the only number that comes to the driver.
    """
    n = nodes.count()
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    steps = cut_lineage(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("p")))
    dangling = cut_lineage(nodes.select("node").join(out.select(F.col("src").alias("node")), "node", "left_anti"))
    ranks = nodes.select("node", F.lit(1.0 / max(1, n)).alias("rank"))
    for _ in range(rounds):
        lost = ranks.join(dangling, "node", "left_semi").agg(F.sum("rank")).first()[0] or 0.0
        got = steps.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("p") * F.col("rank")).alias("got"))
        new = ranks.join(got, F.col("node") == F.col("dst"), "left").select("node", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("new"), "rank")
        new = cut_lineage(new)
        moved = new.agg(F.sum(F.abs(F.col("new") - F.col("rank")))).first()[0] or 0.0
        ranks = new.select("node", F.col("new").alias("rank"))
        if moved < n * tol:
            break
    return ranks.select("node", F.col("rank").alias("pagerank"))


def eigenvector_centrality(edges: DataFrame, nodes: DataFrame, rounds: int = 1000, tol: float = 1e-6) -> DataFrame:
    """Weighted eigenvector centrality by power iteration (in-edges); 0 for all if it doesn't settle in `rounds`."""
    n = nodes.count()
    x = cut_lineage(nodes.select("node", F.lit(1.0 / max(1, n)).alias("x")))
    for _ in range(rounds):
        got = edges.join(x, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("weight") * F.col("x")).alias("got"))
        new = cut_lineage(x.join(got, F.col("node") == F.col("dst"), "left").select("node", "x", (F.col("x") + F.coalesce("got", F.lit(0.0))).alias("new")))
        norm = (new.agg(F.sqrt(F.sum(F.col("new") * F.col("new")))).first()[0] or 0.0) or 1.0
        new = new.select("node", "x", (F.col("new") / norm).alias("new"))
        moved = new.agg(F.sum(F.abs(F.col("new") - F.col("x")))).first()[0] or 0.0
        x = cut_lineage(new.select("node", F.col("new").alias("x")))
        if moved < n * tol:
            return x.withColumnRenamed("x", "eigenvector")
    return nodes.select("node", F.lit(0.0).alias("eigenvector"))


def shortest_paths(edges: DataFrame, pivots: DataFrame, rounds: int = 1000) -> DataFrame:
    """Distances (weight as length) from each pivot (node): pivot, node, dist. A round follows the edges from the nodes
    that the round before has brought nearer, until there are none; rows are at most pivots x nodes."""
    dist = cut_lineage(pivots.select(F.col("node").alias("pivot"), "node", F.lit(0.0).alias("dist"), F.lit(True).alias("fresh")))
    for _ in range(rounds):
        step = dist.filter("fresh").join(edges, F.col("node") == F.col("src")).select("pivot", F.col("dst").alias("node"), (F.col("dist") + F.col("weight")).alias("new"))
        both = dist.select("pivot", "node", "dist", F.lit(None).cast("double").alias("new")).unionByName(step.select("pivot", "node", F.lit(None).cast("double").alias("dist"), "new"))
        both = both.groupBy("pivot", "node").agg(F.min("dist").alias("dist"), F.min("new").alias("new"))
        dist = cut_lineage(both.select("pivot", "node", F.least("dist", "new").alias("dist"), F.coalesce(F.col("new") < F.col("dist"), F.col("dist").isNull()).alias("fresh")))
        if dist.filter("fresh").isEmpty():
            break
    return dist.drop("fresh")


#: Rows (pivot, node) that one block of pivots may make.
PIVOT_CELLS = 5_000_000


def pivot_blocks(pivots: DataFrame, nodes: int, cells: int | None = None) -> list[DataFrame]:
    """The pivots dealt by hash into blocks of about `cells` / `nodes` each, so that the distances held at once don't grow
    with the square of the graph. Each block must have one pivot; a node in each other's reach makes `nodes` rows of it."""
    kept = cut_lineage(pivots.select("node"))
    blocks = max(1, -(-kept.count() * nodes // (cells or PIVOT_CELLS)))
    if blocks == 1:
        return [kept]
    dealt = cut_lineage(kept.withColumn("_b", F.pmod(F.xxhash64("node"), F.lit(blocks))))
    return [dealt.filter(F.col("_b") == b).drop("_b") for b in range(blocks)]


def sample_pivots(nodes: DataFrame, error: float = 0.01, risk: float = 0.01, seed: int = 0) -> DataFrame:
    """So many nodes, by hash, that betweenness from them as sources is within `error` x n / (n - 1) of the whole for all
    nodes at once, but with probability `risk`: ln(2 n / risk) / (2 error^2) by Hoeffding's inequality, whatever the
    graph; all nodes where that is not fewer. Distances from a pivot lie in [0, n - 2] dependencies, which it rests on."""
    n = nodes.count()
    k = math.ceil(math.log(2 * max(n, 1) / risk) / (2 * error**2))
    return nodes.select("node") if k >= n else nodes.select("node").orderBy(F.xxhash64(F.col("node"), F.lit(seed)), "node").limit(k)


def closeness_centrality(edges: DataFrame, nodes: DataFrame, cells: int | None = None) -> DataFrame:
    """Closeness over distances to a node, scaled by the share of nodes that reach it: node, closeness. Exact; the
    distances of one block of nodes are held at a time, of which a row for each node stays."""
    n = nodes.count()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    value = F.when((F.col("total") > 0) & (n > 1), (F.col("r") - 1) / F.col("total") * ((F.col("r") - 1) / max(1, n - 1))).otherwise(0.0)
    done = []
    for block in pivot_blocks(nodes, n, cells):
        d = shortest_paths(back, block).groupBy(F.col("pivot").alias("node")).agg(F.count("*").alias("r"), F.sum("dist").alias("total"))
        done.append(cut_lineage(d.select("node", value.alias("closeness"))))
    return reduce(DataFrame.unionByName, done)


def betweenness_centrality(edges: DataFrame, nodes: DataFrame, pivots: DataFrame | None = None, cells: int | None = None) -> DataFrame:
    """Betweenness with weight as length: node, betweenness, over all pairs, or from the given pivots (sample_pivots), scaled
    up. Pivots are taken block by block, and only their sum for each node is carried on."""
    n = nodes.count()
    if n < 3:
        return nodes.select("node", F.lit(0.0).alias("betweenness"))
    chosen = nodes if pivots is None else pivots
    k, total = chosen.count(), None
    for block in pivot_blocks(chosen, n, cells):
        part = _dependencies(edges, block, n)
        total = cut_lineage(part if total is None else total.unionByName(part).groupBy("node").agg(F.sum("b").alias("b")))
    scale = n / k / ((n - 1) * (n - 2))
    return nodes.select("node").join(total, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def _dependencies(edges: DataFrame, pivots: DataFrame, n: int) -> DataFrame:
    """node, b: shares of the shortest paths from the pivots that pass a node, summed.

    The shortest-path graph of every pivot is found first. Paths are then counted along it round by round outward,
    and dependencies are summed from the far end inward; a round handles the nodes that are done for all pivots at once.
    """
    d = shortest_paths(edges, pivots)
    a, b = d.alias("a"), d.alias("b")
    arcs = edges.join(a, F.col("src") == F.col("a.node")).join(b, (F.col("dst") == F.col("b.node")) & (F.col("a.pivot") == F.col("b.pivot")))
    arcs = cut_lineage(arcs.filter(F.abs(F.col("a.dist") + F.col("weight") - F.col("b.dist")) <= 1e-9 * (1 + F.col("b.dist"))).select(F.col("a.pivot").alias("pivot"), "src", "dst").distinct())
    paths = d.select("pivot", "node", F.when(F.col("pivot") == F.col("node"), 1.0).otherwise(0.0).alias("sigma"))
    # numbers of paths: repeat sigma(v) = sum of sigma of predecessors until it stands
    before = None
    for _ in range(n):
        got = arcs.join(paths, (arcs["pivot"] == paths["pivot"]) & (F.col("src") == F.col("node"))).groupBy(arcs["pivot"], "dst").agg(F.sum("sigma").alias("got"))
        g = got.select(F.col("pivot").alias("p2"), "dst", "got")
        paths = cut_lineage(paths.join(g, (F.col("pivot") == F.col("p2")) & (F.col("node") == F.col("dst")), "left").select("pivot", "node", F.when(F.col("pivot") == F.col("node"), 1.0).otherwise(F.coalesce("got", F.lit(0.0))).alias("sigma")))
        now = paths.agg(F.sum("sigma")).first()[0]
        if now == before:
            break
        before = now
    part = paths.select("pivot", "node", "sigma", F.lit(0.0).alias("delta"))
    before = None
    for _ in range(n):
        far = part.select(F.col("pivot").alias("p2"), F.col("node").alias("far"), F.col("sigma").alias("s2"), F.col("delta").alias("d2"))
        near = part.select(F.col("pivot").alias("p1"), F.col("node").alias("near"), F.col("sigma").alias("s1"))
        got = arcs.join(far, (F.col("pivot") == F.col("p2")) & (F.col("dst") == F.col("far"))).join(near, (F.col("pivot") == F.col("p1")) & (F.col("src") == F.col("near")))
        got = got.groupBy(F.col("pivot").alias("p3"), F.col("src").alias("n3")).agg(F.sum(F.col("s1") / F.col("s2") * (1 + F.col("d2"))).alias("got"))
        part = cut_lineage(part.join(got, (F.col("pivot") == F.col("p3")) & (F.col("node") == F.col("n3")), "left").select("pivot", "node", "sigma", F.coalesce("got", F.lit(0.0)).alias("delta")))
        now = part.agg(F.sum("delta")).first()[0]
        if now == before:
            break
        before = now
    return part.filter("pivot <> node").groupBy("node").agg(F.sum("delta").alias("b"))


def hub_ranking(edges: DataFrame, nodes: DataFrame, n: int = 20, pivots: DataFrame | None = None) -> DataFrame:
    """The first `n` nodes by 0.15 x (degree, in, out, eigenvector, PageRank) + 0.25 x betweenness (from `pivots` if given)."""
    out = degree_centrality(edges, nodes)
    for table in (page_rank(edges, nodes), eigenvector_centrality(edges, nodes), betweenness_centrality(edges, nodes, pivots)):
        out = out.join(table, "node")
    score = sum(F.col(c) * 0.15 for c in ("degree", "in_degree", "out_degree", "eigenvector", "pagerank")) + F.col("betweenness") * 0.25
    return out.withColumn("hub_score", score).orderBy(F.desc("hub_score"), "node").limit(n)
