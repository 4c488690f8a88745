"""Registered queries on the 47 prefectures and their neighbours, clusters of places by ratios, tokens of any text."""

from __future__ import annotations

from pyspark.sql import functions as F

from shokuba.functions import neighbours as N
from shokuba.functions import people as person
from shokuba.operators import clusters as C
from shokuba.operators import core
from shokuba.operators import flows as G
from shokuba.plans.frames import places, table
from shokuba.plans.queries import query, rounded


def _values(rows) -> str:
    return ", ".join(str(r) for r in rows)


#: Moves between prefectures: those of an order's customer and of a line's supplier, dealt out over the 47.
_MOVES = f"""WITH moves AS (SELECT {person.PREFECTURES}[CAST(1 + o_custkey % 47 AS INTEGER)] AS home, {person.PREFECTURES}[CAST(1 + l_suppkey % 47 AS INTEGER)] AS wish, count(*) AS flow FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
borders(src, dst) AS (VALUES {_values(N.pairs(N.BORDERS))}), catchments(src, dst) AS (VALUES {_values(N.pairs(N.CATCHMENTS))}),
real AS (SELECT * FROM moves WHERE home = wish OR (home, wish) IN (SELECT (src, dst) FROM borders) OR (home, wish) IN (SELECT (src, dst) FROM catchments))"""


def _moves(spark, d):
    o, l = table(spark, d, "orders").select("o_orderkey", "o_custkey"), table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    name = lambda c: F.element_at(F.array(*map(F.lit, person.PREFECTURES)), (F.col(c) % 47 + 1).cast("int"))
    m = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(name("o_custkey").alias("home"), name("l_suppkey").alias("wish"))
    return core.cross(m, ["home", "wish"]).withColumnRenamed("count", "flow")


def _real(spark, d):
    return G.realistic(_moves(spark, d), "home", "wish", N.borders(spark), N.catchments(spark))


@query(_MOVES + """ SELECT home, wish, flow, round(flow * 100.0 / sum(flow) OVER (PARTITION BY wish), 6) AS share_pct FROM real""", base=False)
def prj11_prefecture_flow(spark, d):
    """Flows that are likely: within a prefecture, from a neighbour, or from where a large centre draws people."""
    return rounded(core.with_share(_real(spark, d), "flow", ["wish"]))


@query(_MOVES + """ SELECT wish, home, flow, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY wish ORDER BY flow DESC, home) AS r FROM real WHERE home <> wish) WHERE r <= 5""", base=False)
def agg52_prefecture_sources(spark, d):
    """The five largest likely sources of each prefecture, taken after the filter."""
    return core.top_n(_real(spark, d).filter("home <> wish"), ["wish"], [F.desc("flow"), F.asc("home")], 5, "rank")


@query(_MOVES + """, inward AS (SELECT wish AS prefecture, CAST(sum(flow) AS BIGINT) AS inflow FROM moves WHERE home <> wish GROUP BY 1),
near AS (SELECT src, dst FROM borders UNION SELECT a.src, b.dst FROM borders a JOIN borders b ON a.dst = b.src WHERE a.src <> b.dst)
SELECT i.prefecture, i.inflow, count(o.inflow) AS neighbours, round(avg(o.inflow), 6) AS neighbour_mean, count(*) FILTER (o.inflow > i.inflow) + 1 AS rank, round(i.inflow - avg(o.inflow), 6) AS deviation
FROM inward i LEFT JOIN near ON src = i.prefecture LEFT JOIN inward o ON o.prefecture = dst GROUP BY 1, 2""", base=False)
def agg52_neighbour_ranks(spark, d):
    """Inflow of each prefecture beside that of all it reaches over one border or two."""
    inward = _moves(spark, d).filter("home <> wish").groupBy(F.col("wish").alias("prefecture")).agg(F.sum("flow").alias("inflow"))
    return rounded(G.neighbour_ranks(inward, "prefecture", "inflow", G.within_steps(N.borders(spark), 2)))


#: Kinds of facilities with a share of their own; others count for none.
KINDS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL")
RATIOS = ("regular_ratio", "part_ratio", "care_ratio", "hospital_ratio", "beauty_ratio", "pharmacy_ratio", "dental_ratio")


def _ratios(spark, d):
    l, p, s = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_type"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    a = l.select("l_partkey", "l_suppkey", "l_returnflag", F.col("l_extendedprice").alias("salary")).filter("salary between 50000 and 2000000")
    a = a.join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(places(spark, d), F.col("s_nationkey") == F.col("nation_key"))
    shares = dict(zip(RATIOS, [F.col("l_returnflag") == "R", F.col("l_returnflag") == "N", *[F.col("p_type") == k for k in KINDS]]))
    return C.place_ratios(a, "municipality", "salary", shares)


@query(""" SELECT municipality, count(*) AS job_count, round(avg(l_extendedprice), 4) AS avg_salary, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END), 4) AS regular_ratio, round(avg(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0 END), 4) AS part_ratio, """
+ ", ".join(f"round(avg(CASE WHEN p_type = '{k}' THEN 1.0 ELSE 0 END), 4) AS {n}" for k, n in zip(KINDS, RATIOS[2:]))
+ " FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = nation_key WHERE l_extendedprice BETWEEN 50000 AND 2000000 GROUP BY 1 HAVING count(*) >= 10")
def clu06_place_ratios(spark, d):
    return rounded(_ratios(spark, d), 4)


@query()
def clu06_ratio_clusters(spark, d):
    """Places by nine numbers of their adverts, three to six clusters, with a label from the centres."""
    names = ["job_count", "avg_salary", *RATIOS]
    grouped = C.assign_clusters(_ratios(spark, d), names, ks=(3, 4, 5, 6), scaling="standard", few=10)
    labels = C.ratio_labels(grouped, names, "care_ratio").select("cluster", "size", "label")
    return grouped.join(labels, "cluster").select("municipality", F.col("cluster").cast("int").alias("cluster"), "size", "label")


@query()
def fun09_tokens(spark, d):
    """Per document: number of parts and of different ones, and the longest (of equals the smallest)."""
    t = table(spark, d, "documents").select("doc_id", person.tokens(F.col("text")).alias("t"))
    longest = F.array_min(F.transform("t", lambda x: F.struct((-F.length(x)).alias("n"), x.alias("s"))))["s"]
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), longest.alias("longest"))
