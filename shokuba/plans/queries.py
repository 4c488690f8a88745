"""Registered queries: each applies operators to the driver's tables and comes with its SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shokuba.functions import people as person
from shokuba.functions import postings as advert
from shokuba.operators import applicants as A
from shokuba.operators import clusters as C
from shokuba.operators import core
from shokuba.operators import flows as G
from shokuba.operators import postings as P
from shokuba.operators import quality as V
from shokuba.operators import stats as S
from shokuba.operators import textmining as T
from shokuba.plans.frames import FLAGS, SQL, adverts, areas, people, places, table, wishes
from shokuba.sources.scratch import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Register a query under its function's name; base: its SQL starts with the frames."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (SQL if base else "") + sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so both engines give one value."""
    return df.select(*[F.round(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


WANT = ["want_prefecture", "want_municipality"]
HOME = ["prefecture", "municipality"]


@query("""SELECT prefecture, municipality, coalesce(demand_count, 0) AS demand_count, coalesce(supply_count, 0) AS supply_count,
    round(coalesce(demand_count, 0) / CAST(coalesce(supply_count, 0) + 1 AS DOUBLE), 6) AS demand_supply_ratio, coalesce(demand_count, 0) - coalesce(supply_count, 0) AS gap
    FROM (SELECT want_prefecture AS prefecture, want_municipality AS municipality, count(*) AS demand_count FROM areas GROUP BY ALL)
    FULL JOIN (SELECT prefecture, municipality, count(*) AS supply_count FROM people GROUP BY ALL) USING (prefecture, municipality)""")
def agg21_demand_supply_gap(spark, d):
    want = areas(spark, d).select(F.col("want_prefecture").alias("prefecture"), F.col("want_municipality").alias("municipality"))
    return rounded(A.demand_supply_gap(want, people(spark, d), HOME))


@query("""SELECT prefecture, municipality, count(*) AS count, round(avg(age), 6) AS avg_age, count(*) FILTER (gender = 'M') AS male, count(*) FILTER (gender = 'F') AS female,
    round(count(*) FILTER (gender = 'F') / CAST(count(gender) AS DOUBLE), 6) AS female_ratio,
    (SELECT age_group FROM people q WHERE q.municipality = p.municipality AND q.prefecture = p.prefecture GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_age_group,
    round(avg(qualification_count), 6) AS avg_qualifications FROM people p GROUP BY prefecture, municipality""")
def agg01_map_metrics(spark, d):
    return rounded(A.map_metrics(people(spark, d)))


@query("""SELECT age_group, gender, has_license, count(*) AS count, round(avg(age), 6) AS avg_age, round(avg(qualification_count), 6) AS avg_qualifications,
    round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct FROM people WHERE gender IS NOT NULL GROUP BY 1, 2, 3""")
def agg07_persona_summary(spark, d):
    return rounded(A.persona(people(spark, d), ["age_group", "gender", "has_license"], [F.avg("qualification_count").alias("avg_qualifications")], within=()))


@query("""SELECT age_group, gender, count(*) AS count, round(avg(age), 6) AS avg_age,
    (SELECT municipality FROM people q WHERE q.age_group = p.age_group AND q.gender = p.gender GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_residence
    FROM people p WHERE gender IS NOT NULL GROUP BY age_group, gender""")
def agg08_persona_residence(spark, d):
    return rounded(A.persona(people(spark, d), ["age_group", "gender"], [core.mode("municipality").alias("top_residence")]))


@query("""SELECT want_municipality, age_group, gender, count(*) AS count, round(avg(age), 6) AS avg_age, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY want_municipality), 6) AS share_pct
    FROM (SELECT DISTINCT person_id, want_municipality, age_group, gender, age FROM wishes) WHERE gender IS NOT NULL GROUP BY 1, 2, 3""")
def agg09_persona_by_municipality(spark, d):
    return rounded(A.persona(wishes(spark, d).select("person_id", "want_municipality", "age_group", "gender", "age"), ["age_group", "gender"], within=["want_municipality"], person="person_id", place=["want_municipality"]))


@query("""SELECT municipality, want_municipality, count(*) AS flow_count, round(avg(age), 6) AS avg_age,
    coalesce(CASE WHEN count(*) FILTER (gender = 'F') >= count(*) FILTER (gender = 'M') AND count(gender) > 0 THEN 'F' WHEN count(gender) > 0 THEN 'M' END, 'unknown') AS gender_mode
    FROM wishes WHERE municipality <> want_municipality GROUP BY 1, 2""")
def agg10_aggregated_flow(spark, d):
    edges = G.flow_edges(people(spark, d), areas(spark, d), "person_id", "municipality", "want_municipality")
    return rounded(G.aggregate_flow(edges, ["municipality", "want_municipality"]))


@query("""SELECT want_prefecture, want_municipality, count(*) AS supply_count, round(avg(age), 6) AS avg_age, CAST(sum(CASE WHEN has_license THEN 1 ELSE 0 END) AS BIGINT) AS license_count,
    round(avg(qualification_count), 6) AS avg_qualifications FROM wishes GROUP BY 1, 2""")
def agg11_supply_density(spark, d):
    return rounded(A.supply_density(wishes(spark, d), WANT))


@query("SELECT want_municipality, age_group, coalesce(gender, 'unknown') AS gender, count(*) AS count FROM wishes GROUP BY ALL HAVING count(*) >= 5")
def agg13_age_gender_cross(spark, d):
    return core.cross(wishes(spark, d).fillna("unknown", ["gender"]), ["want_municipality", "age_group", "gender"], min_count=5)


def _urgent(spark, d):
    """Wishes with the points of their priority, 5 for the most urgent."""
    return wishes(spark, d).withColumn("urgency_score", 6 - F.substring("urgency", 1, 1).cast("int"))


@query("""SELECT urgency, employment, count(*) AS count, round(avg(age), 6) AS avg_age, round(avg(6 - CAST(urgency[1] AS INTEGER)), 6) AS avg_urgency_score FROM wishes GROUP BY 1, 2""")
def agg19_urgency_by_employment(spark, d):
    return rounded(A.urgency_profile(_urgent(spark, d), ["urgency", "employment"]))


@query("""SELECT want_municipality, urgency, age_group, count(*) AS count, round(avg(age), 6) AS avg_age, round(avg(6 - CAST(urgency[1] AS INTEGER)), 6) AS avg_urgency_score FROM wishes GROUP BY 1, 2, 3""")
def agg20_urgency_by_municipality(spark, d):
    return rounded(A.urgency_profile(_urgent(spark, d), ["want_municipality", "urgency", "age_group"]))


@query("""SELECT municipality, age_group, gender, has_license, count(*) AS count, round(1.0 / count(*), 6) AS rarity_score,
    CASE WHEN count(*) <= 1 THEN 'S' WHEN count(*) <= 2 THEN 'A' WHEN count(*) <= 5 THEN 'B' WHEN count(*) <= 20 THEN 'C' ELSE 'D' END AS rarity_rank
    FROM people WHERE gender IS NOT NULL GROUP BY 1, 2, 3, 4""")
def agg22_rarity(spark, d):
    return rounded(A.rarity(people(spark, d), ["municipality", "age_group", "gender", "has_license"]))


@query("""SELECT municipality, count(*) AS total, round(count(*) FILTER (gender = 'F') / CAST(count(*) AS DOUBLE), 6) AS female_ratio, round(1 - count(*) FILTER (gender = 'F') / CAST(count(*) AS DOUBLE), 6) AS male_ratio,
    round(avg(CASE WHEN has_license THEN 1.0 ELSE 0 END), 6) AS license_rate, round(avg(qualification_count), 6) AS avg_qualifications,
    (SELECT age_group FROM people q WHERE q.municipality = p.municipality GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_age,
    (SELECT round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) FROM people q WHERE q.municipality = p.municipality GROUP BY age_group ORDER BY count(*) DESC, age_group LIMIT 1) AS top_age_share,
    (SELECT employment FROM people q WHERE q.municipality = p.municipality GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_employment,
    (SELECT round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) FROM people q WHERE q.municipality = p.municipality GROUP BY employment ORDER BY count(*) DESC, employment LIMIT 1) AS top_employment_share
    FROM people p GROUP BY municipality""")
def agg23_competition(spark, d):
    return rounded(A.competition(people(spark, d), ["municipality"]))


@query("""SELECT municipality, employment, count(DISTINCT person_id) AS count, any_value(total) AS total, round(count(DISTINCT person_id) * 100.0 / any_value(total), 2) AS retention_rate
    FROM people JOIN (SELECT municipality, count(DISTINCT person_id) AS total FROM people GROUP BY 1) USING (municipality) GROUP BY 1, 2""")
def agg28_retention(spark, d):
    return A.retention(people(spark, d), "employment", ["municipality"])


@query("""SELECT place1, place2, count(*) AS count FROM (SELECT a.person_id, a.want_municipality AS place1, b.want_municipality AS place2
    FROM one a JOIN one b ON a.person_id = b.person_id AND a.want_municipality < b.want_municipality JOIN fit ON fit.person_id = a.person_id) GROUP BY 1, 2""".replace("FROM one a", "FROM (SELECT DISTINCT person_id, want_municipality FROM areas) a").replace("JOIN one b", "JOIN (SELECT DISTINCT person_id, want_municipality FROM areas) b").replace("JOIN fit ON", "JOIN (SELECT person_id FROM areas GROUP BY 1 HAVING count(DISTINCT want_municipality) BETWEEN 2 AND 19 AND count(DISTINCT want_prefecture) < 6) fit ON"))
def agg30_desired_pairs(spark, d):
    return core.cross(A.area_pairs(areas(spark, d), "person_id", "want_municipality", "want_prefecture", 20, 6), ["place1", "place2"])


@query("""SELECT want_municipality, employment, age_group, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY want_municipality), 6) AS share_pct FROM wishes GROUP BY 1, 2, 3""")
def agg32_workstyle_shares(spark, d):
    return rounded(core.cross(wishes(spark, d), ["want_municipality", "employment", "age_group"], within=["want_municipality"]))


@query("""SELECT prefecture, CAST(sum(count) AS BIGINT) AS count, round(sum(avg_age * count) / sum(count), 6) AS avg_age, round(sum(q * count) / sum(count), 6) AS avg_qualifications
    FROM (SELECT prefecture, municipality, count(*) AS count, avg(age) AS avg_age, avg(qualification_count) AS q FROM people GROUP BY 1, 2) GROUP BY 1""")
def agg34_prefecture_roll_up(spark, d):
    return rounded(A.roll_up(A.map_metrics(people(spark, d)), ["prefecture"], "count", ["avg_age", "avg_qualifications"]))


@query("""SELECT municipality, count, round(qualified, 6) AS qualified, round(urgent, 6) AS urgent, round(s, 6) AS density_score,
    CASE WHEN s >= 50 THEN 'S' WHEN s >= 30 THEN 'A' WHEN s >= 15 THEN 'B' WHEN s >= 5 THEN 'C' ELSE 'D' END AS density_rank
    FROM (SELECT *, count * 0.4 + qualified * 30 + urgent * 20 AS s FROM (SELECT municipality, count(*) AS count, avg(CASE WHEN qualification_count > 0 THEN 1.0 ELSE 0 END) AS qualified, avg(CASE WHEN urgent THEN 1.0 ELSE 0 END) AS urgent FROM people GROUP BY 1))""")
def agg35_older_density(spark, d):
    return rounded(A.older_density(people(spark, d), ["municipality"]))


@query("""SELECT municipality, CAST(sum(n) AS BIGINT) AS total, count(*) AS segments, arg_min(segment, (-n, segment)) AS dominant, round(max(n / t), 6) AS dominant_share, round(1 - sum((n / t) * (n / t)), 6) AS diversity,
    round(coalesce(sum(n / t) FILTER (segment IN ('20sF', '30sF')), 0), 6) AS young_female, round(coalesce(sum(n / t) FILTER (segment IN ('40sF', '50sF')), 0), 6) AS middle_female
    FROM (SELECT municipality, segment, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY municipality) AS DOUBLE) AS t FROM (SELECT municipality, age_group || coalesce(gender, '?') AS segment FROM people) GROUP BY 1, 2) GROUP BY 1""")
def agg37_diversity(spark, d):
    df = people(spark, d).withColumn("segment", F.concat("age_group", F.coalesce("gender", F.lit("?"))))
    return rounded(A.diversity(df, ["municipality"], "segment", {"young_female": ["20sF", "30sF"], "middle_female": ["40sF", "50sF"]}))


@query("""SELECT employment, count(*) AS count, round(avg(age), 6) AS avg_age, round(avg(CASE WHEN gender = 'F' THEN 1.0 WHEN gender = 'M' THEN 0.0 END), 6) AS female_share, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct,
    (SELECT string_agg(municipality, ';' ORDER BY r) FROM (SELECT municipality, row_number() OVER (ORDER BY count(*) DESC, municipality) AS r FROM people q WHERE q.employment = p.employment GROUP BY 1) WHERE r <= 3) AS top_residences
    FROM people p GROUP BY employment""")
def agg38_segment_profile(spark, d):
    return rounded(A.segment_profile(people(spark, d), "employment", "municipality"))


@query("""SELECT prefecture, count(*) FILTER (urgency = '1-URGENT') AS "1-URGENT", count(*) FILTER (urgency = '2-HIGH') AS "2-HIGH", count(*) FILTER (urgency = '5-LOW') AS "5-LOW" FROM wishes GROUP BY 1""")
def agg39_pivot(spark, d):
    return core.pivot_counts(wishes(spark, d), ["prefecture"], "urgency", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("""SELECT prefecture, want_prefecture, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY prefecture), 6) AS share_pct FROM wishes GROUP BY 1, 2""")
def agg41_region_matrix(spark, d):
    return rounded(core.cross(wishes(spark, d), ["prefecture", "want_prefecture"], within=["prefecture"]))


@query("""SELECT a, b, round(r, 5) AS r FROM (SELECT 'age' AS a, 'qualification_count' AS b, corr(age, qualification_count) AS r FROM people UNION ALL SELECT 'age', 'person_id', corr(age, person_id) FROM people UNION ALL SELECT 'qualification_count', 'person_id', corr(qualification_count, person_id) FROM people)""")
def agg45_correlations(spark, d):
    return rounded(S.correlations(people(spark, d), ["age", "qualification_count", "person_id"]), 5)


@query("""SELECT CASE WHEN prefecture IS NULL THEN 'nation' WHEN municipality IS NULL THEN 'prefecture' ELSE 'municipality' END AS scope, prefecture, municipality, count(*) AS count, round(avg(age), 6) AS avg_age,
    count(*) FILTER (gender = 'F') AS female FROM people GROUP BY GROUPING SETS ((), (prefecture), (prefecture, municipality))""")
def agg46_totals_by_scope(spark, d):
    levels = {"nation": [], "prefecture": ["prefecture"], "municipality": HOME}
    return rounded(core.scopes(people(spark, d), levels, [F.count("*").alias("count"), F.avg("age").alias("avg_age"), F.count_if(F.col("gender") == "F").alias("female")]))


@query("""SELECT age_group, gender, count(*) AS count, round(avg(age), 6) AS avg_age, round(count(*) * 100.0 / (SELECT count(*) FROM people WHERE gender IS NOT NULL), 6) AS share_pct, row_number() OVER (ORDER BY count(*) DESC, age_group, gender) AS rank
    FROM people WHERE gender IS NOT NULL GROUP BY 1, 2 ORDER BY rank LIMIT 5""")
def agg47_market_share_top(spark, d):
    return rounded(core.ranked(A.persona(people(spark, d), ["age_group", "gender"], within=()), [F.desc("count"), F.asc("age_group"), F.asc("gender")], 5))


@query("""SELECT place, CAST(coalesce(inflow, 0) AS BIGINT) AS inflow, CAST(coalesce(outflow, 0) AS BIGINT) AS outflow, CAST(coalesce(inflow, 0) - coalesce(outflow, 0) AS BIGINT) AS net_flow,
    round(coalesce(inflow, 0) / CAST(coalesce(inflow, 0) + coalesce(outflow, 0) AS DOUBLE), 6) AS in_share
    FROM (SELECT want_municipality AS place, count(*) AS inflow FROM wishes WHERE municipality <> want_municipality GROUP BY 1) FULL JOIN (SELECT municipality AS place, count(*) AS outflow FROM wishes WHERE municipality <> want_municipality GROUP BY 1) USING (place)""")
def agg58_flow_balance(spark, d):
    edges = G.flow_edges(people(spark, d), areas(spark, d), "person_id", "municipality", "want_municipality")
    return rounded(G.flow_balance(G.aggregate_flow(edges, ["municipality", "want_municipality"]), "municipality", "want_municipality", "flow_count"))


@query("""SELECT municipality, openings, seekers, round(a, 6) AS opening_share, round(b, 6) AS seeker_share, CASE WHEN a > 0 THEN round(b / a, 6) ELSE 0 END AS competition_ratio
    FROM (SELECT *, openings / CAST(sum(openings) OVER () AS DOUBLE) AS a, seekers / CAST(sum(seekers) OVER () AS DOUBLE) AS b FROM (SELECT municipality, coalesce(openings, 0) AS openings, coalesce(seekers, 0) AS seekers
    FROM (SELECT municipality, count(*) AS openings FROM adverts GROUP BY 1) FULL JOIN (SELECT municipality, count(*) AS seekers FROM people GROUP BY 1) USING (municipality)))""")
def agg60_openings_competition(spark, d):
    o = adverts(spark, d).groupBy("municipality").agg(F.count("*").alias("openings"))
    s = people(spark, d).groupBy("municipality").agg(F.count("*").alias("seekers"))
    return rounded(A.local_competition(o, s, ["municipality"]))


@query("""SELECT place, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree, coalesce(in_degree, 0) * coalesce(out_degree, 0) AS hub_score
    FROM (SELECT want_municipality AS place, count(DISTINCT municipality) AS in_degree FROM wishes GROUP BY 1) FULL JOIN (SELECT municipality AS place, count(DISTINCT want_municipality) AS out_degree FROM wishes GROUP BY 1) USING (place)""")
def agg63_hub_scores(spark, d):
    return G.hub_scores(wishes(spark, d), "municipality", "want_municipality")


@query("""SELECT potential, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct FROM (SELECT CASE WHEN s > 75 THEN 'high' WHEN s >= 60 THEN 'middle' ELSE 'low' END AS potential FROM
    (SELECT 50 + CASE WHEN age < 30 THEN 10 WHEN age < 50 THEN 5 ELSE 0 END + least(qualification_count * 5, 20) + CASE WHEN has_license THEN 10 ELSE 0 END + CASE WHEN coalesce(n, 0) BETWEEN 2 AND 5 THEN 10 ELSE 0 END AS s
    FROM people LEFT JOIN (SELECT person_id, count(DISTINCT want_municipality) AS n FROM areas GROUP BY 1) USING (person_id))) GROUP BY 1""")
def agg64_application_potential(spark, d):
    n = areas(spark, d).groupBy("person_id").agg(F.countDistinct("want_municipality").alias("area_count"))
    return rounded(A.application_potential(people(spark, d).join(n, "person_id", "left").fillna(0, ["area_count"])))


@query("""SELECT municipality, string_agg(employment, ';' ORDER BY r) AS top_items FROM (SELECT municipality, employment, row_number() OVER (PARTITION BY municipality ORDER BY count(*) DESC, employment) AS r FROM people GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1""")
def agg05_top_three(spark, d):
    return A.top_items(people(spark, d), ["municipality"], "employment")


@query("""SELECT variable, value, count(*) AS count FROM (SELECT 'gender' AS variable, gender AS value FROM people UNION ALL SELECT 'age_group', age_group FROM people UNION ALL SELECT 'prefecture', prefecture FROM people) WHERE value IS NOT NULL GROUP BY 1, 2""")
def agg78_descriptive(spark, d):
    return core.cross(core.melt(people(spark, d), [], ["gender", "age_group", "prefecture"]), ["variable", "value"])


@query("""SELECT location, CAST(sum(i) AS BIGINT) AS inflow, CAST(sum(o) AS BIGINT) AS outflow, count(DISTINCT person_id) AS applicant_count, CAST(sum(i) - sum(o) AS BIGINT) AS net_flow, round(sum(i) / CAST(sum(i) + sum(o) AS DOUBLE), 6) AS in_ratio,
    CASE WHEN sum(i) / CAST(sum(i) + sum(o) AS DOUBLE) > 0.7 THEN 'hub' WHEN sum(i) / CAST(sum(i) + sum(o) AS DOUBLE) < 0.3 THEN 'source' WHEN sum(i) / CAST(sum(i) + sum(o) AS DOUBLE) BETWEEN 0.45 AND 0.55 THEN 'balanced'
    WHEN sum(i) / CAST(sum(i) + sum(o) AS DOUBLE) > 0.55 THEN 'leaning in' ELSE 'leaning out' END AS node_class
    FROM (SELECT want_municipality AS location, 1 AS i, 0 AS o, person_id FROM wishes WHERE municipality <> want_municipality UNION ALL SELECT municipality, 0, 1, person_id FROM wishes WHERE municipality <> want_municipality) GROUP BY 1""")
def grf02_flow_nodes(spark, d):
    edges = wishes(spark, d).filter("municipality <> want_municipality")
    return rounded(G.node_class(G.flow_nodes(edges, "person_id", "municipality", "want_municipality")))


def _graph(spark, d):
    """Flow graph of municipalities, one edge per ordered pair of at least a given flow."""
    edges = G.flow_edges(people(spark, d), areas(spark, d), "person_id", "municipality", "want_municipality")
    flow = edges.groupBy(F.col("municipality").alias("src"), F.col("want_municipality").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    return G.cut_lineage(flow), places(spark, d).select(F.col("municipality").alias("node"))


@query("""SELECT node, round((coalesce(i, 0) + coalesce(o, 0)) / 24.0, 6) AS degree, round(coalesce(i, 0) / 24.0, 6) AS in_degree, round(coalesce(o, 0) / 24.0, 6) AS out_degree FROM (SELECT municipality AS node FROM places)
    LEFT JOIN (SELECT want_municipality AS node, count(DISTINCT municipality) AS i FROM wishes WHERE municipality <> want_municipality GROUP BY 1) USING (node)
    LEFT JOIN (SELECT municipality AS node, count(DISTINCT want_municipality) AS o FROM wishes WHERE municipality <> want_municipality GROUP BY 1) USING (node)""")
def grf04_degree_centrality(spark, d):
    return rounded(G.degree_centrality(*_graph(spark, d)))


@query()
def grf05_page_rank(spark, d):
    return rounded(G.page_rank(*_graph(spark, d)))


@query()
def grf07_closeness(spark, d):
    return rounded(G.closeness_centrality(*_graph(spark, d)))


@query()
def grf09_hub_ranking(spark, d):
    return rounded(G.hub_ranking(*_graph(spark, d)))


@query("""SELECT prefecture, age_group, employment, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct FROM people GROUP BY 1, 2, 3""")
def crx01_three_way_cross(spark, d):
    return rounded(core.cross(people(spark, d), ["prefecture", "age_group", "employment"], within=()))


@query("""SELECT person_id, age, municipality FROM people WHERE prefecture = 'ASIA' AND age_group IN ('20s', '30s') AND municipality LIKE 'NATION_1%'""")
def prj05_facets(spark, d):
    return core.facets(people(spark, d), {"prefecture": "ASIA", "age_group": ["20s", "30s"], "municipality": "NATION_1*", "gender": "all"}).select("person_id", "age", "municipality")


@query("SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderpriority IS NOT NULL", base=False)
def prj06_distinct_values(spark, d):
    return core.distinct_values(table(spark, d, "orders"), "o_orderpriority")


@query("""SELECT municipality, want_municipality, count(*) AS count FROM wishes WHERE municipality <> want_municipality AND (prefecture = want_prefecture OR (prefecture, want_prefecture) IN (('ASIA', 'EUROPE'), ('EUROPE', 'ASIA'))) GROUP BY 1, 2""")
def prj11_realistic_flow(spark, d):
    near = spark.createDataFrame([("ASIA", "EUROPE")], "src string, dst string")
    edges = G.flow_edges(people(spark, d), areas(spark, d), "person_id", "municipality", "want_municipality")
    return core.cross(G.realistic(edges, "prefecture", "want_prefecture", near), ["municipality", "want_municipality"])


@query("SELECT count(*) AS rows FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)", base=False)
def joi12_orphans(spark, d):
    return V.orphans(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey").agg(F.count("*").alias("rows"))


def _coordinates(spark, d):
    n = F.substring("municipality", 8, 2).cast("double")
    return places(spark, d).select("prefecture", "municipality", (20 + n).alias("lat"), (122 + n * 1.2).alias("lng"))


_COORDINATES = "coords AS (SELECT prefecture, municipality, 20 + CAST(substr(municipality, 8, 2) AS DOUBLE) AS lat, 122 + CAST(substr(municipality, 8, 2) AS DOUBLE) * 1.2 AS lng FROM places)"
_KM = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2), 1.0)))"


def _trips(spark, d):
    c = _coordinates(spark, d)
    out = wishes(spark, d).join(c.select("municipality", F.col("lat").alias("lat1"), F.col("lng").alias("lng1")), "municipality")
    out = out.join(c.select(F.col("municipality").alias("want_municipality"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2")), "want_municipality")
    return out.withColumn("distance_km", F.round(G.haversine(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2")), 3))


_TRIPS = f", {_COORDINATES}, trips AS (SELECT w.*, round({_KM}, 3) AS distance_km FROM wishes w JOIN coords a ON w.municipality = a.municipality JOIN coords b ON w.want_municipality = b.municipality)"


@query(_TRIPS + """SELECT municipality, count(*) AS count, round(avg(distance_km), 4) AS avg_km, min(distance_km) AS min_km, max(distance_km) AS max_km, round(stddev_samp(distance_km), 4) AS std_km,
    round(quantile_cont(distance_km, 0.25), 4) AS q25_km, round(quantile_cont(distance_km, 0.5), 4) AS median_km, round(quantile_cont(distance_km, 0.75), 4) AS q75_km,
    (SELECT CAST(floor(distance_km / 10) * 10 AS BIGINT) FROM trips q WHERE q.municipality = t.municipality GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode_km FROM trips t GROUP BY municipality""")
def agg26_residence_flow(spark, d):
    return rounded(G.distance_profile(_trips(spark, d), ["municipality"]), 4)


@query(_TRIPS + """SELECT bucket, kind, count(*) AS count FROM (SELECT CASE WHEN distance_km < 100 THEN '<100' WHEN distance_km < 500 THEN '100-500' WHEN distance_km < 1000 THEN '500-1000' ELSE '1000+' END AS bucket,
    CASE WHEN prefecture <> want_prefecture THEN 'far' WHEN distance_km < 0.001 THEN 'same' WHEN distance_km < 30 THEN 'near' WHEN distance_km < 80 THEN 'middle' ELSE 'far' END AS kind FROM trips) GROUP BY 1, 2""")
def agg43_distance_buckets(spark, d):
    t = _trips(spark, d).withColumn("bucket", core.bands("distance_km", (100, 500, 1000), ("<100", "100-500", "500-1000", "1000+")))
    return core.cross(t.withColumn("kind", G.mobility_type(F.col("distance_km"), F.col("prefecture") == F.col("want_prefecture"))), ["bucket", "kind"])


@query(f", {_COORDINATES} SELECT facility, job_type, round(d, 3) AS distance_km FROM (SELECT facility, job_type, {_KM.replace('b.', 'c.').replace('a.lat', '25.0').replace('a.lng', '128.0')} AS d FROM adverts JOIN coords c USING (municipality)) WHERE d <= 400")
def prj10_radius(spark, d):
    points = adverts(spark, d).join(_coordinates(spark, d).drop("prefecture"), "municipality")
    return G.within_radius(points, 25.0, 128.0, 400.0).select("facility", "job_type", F.round("distance_km", 3).alias("distance_km"))


@query(f", {_COORDINATES} SELECT name, count(*) AS count FROM (SELECT CASE WHEN lat > 22.5 AND lat < 30.5 AND lng > 124.4 AND lng < 134.9 THEN 'south' WHEN lat > 32.5 AND lat < 41.5 AND lng > 136.4 AND lng < 147.9 THEN 'north' END AS name FROM adverts JOIN coords USING (municipality)) WHERE name IS NOT NULL GROUP BY 1")
def joi15_point_in_polygon(spark, d):
    box = lambda a, b, c, e: [(a, c), (a, e), (b, e), (b, c)]
    shapes = spark.createDataFrame([("south", box(22.5, 30.5, 124.4, 134.9)), ("north", box(32.5, 41.5, 136.4, 147.9))], "name string, ring array<struct<lat:double,lng:double>>")
    points = adverts(spark, d).join(_coordinates(spark, d).drop("prefecture"), "municipality")
    return core.cross(G.point_in_polygon(points, shapes, 1.0), ["name"])


@query("""SELECT CASE WHEN g1 = 1 THEN 'nation' ELSE 'prefecture' END AS scope, prefecture, job_type, count, round(count * 100.0 / sum(count) OVER (PARTITION BY g1, prefecture), 6) AS share_pct, CAST(sum(count) OVER (PARTITION BY g1, prefecture) AS BIGINT) AS total
    FROM (SELECT prefecture, job_type, grouping(prefecture) AS g1, count(*) AS count FROM adverts GROUP BY GROUPING SETS ((job_type), (prefecture, job_type)))""")
def pos02_level_shares(spark, d):
    return rounded(P.level_shares(adverts(spark, d), ["job_type"], {"nation": [], "prefecture": ["prefecture"]}, 10))


_TAGS = "list_filter([CASE WHEN has_bulk THEN 'bulk' END, CASE WHEN has_discount THEN 'discount' END, CASE WHEN has_open THEN 'open' END, CASE WHEN has_tax THEN 'tax' END], lambda x: x IS NOT NULL)"


def _tagged(spark, d):
    return adverts(spark, d).withColumn("tags", F.array_compact(F.array(*[F.when(F.col(f), F.lit(f[4:])) for f in sorted(FLAGS)])))


@query(f"""SELECT prefecture, tag, count(*) AS count, any_value(total) AS total, round(count(*) * 100.0 / any_value(total), 6) AS share_pct
    FROM (SELECT prefecture, unnest({_TAGS}) AS tag FROM adverts) JOIN (SELECT prefecture, count(*) AS total FROM adverts GROUP BY 1) USING (prefecture) GROUP BY 1, 2""")
def pos03_tag_frequency(spark, d):
    return rounded(P.tag_frequency(_tagged(spark, d), "tags", ["prefecture"]))


@query(f"""SELECT prefecture, combination, count FROM (SELECT prefecture, combination, count(*) AS count, row_number() OVER (PARTITION BY prefecture ORDER BY count(*) DESC, combination) AS r
    FROM (SELECT prefecture, array_to_string({_TAGS}, '+') AS combination, len({_TAGS}) AS n FROM adverts) WHERE n >= 2 GROUP BY 1, 2) WHERE r <= 5""")
def pos04_tag_combinations(spark, d):
    return P.tag_combinations(_tagged(spark, d), "tags", ["prefecture"], top=5)


@query("""SELECT job_type, flag, count, total, round(count * 100.0 / total, 6) AS share_pct FROM (SELECT job_type, 'has_bulk' AS flag, count(*) FILTER (has_bulk) AS count, count(*) AS total FROM adverts GROUP BY 1
    UNION ALL SELECT job_type, 'has_discount', count(*) FILTER (has_discount), count(*) FROM adverts GROUP BY 1 UNION ALL SELECT job_type, 'has_tax', count(*) FILTER (has_tax), count(*) FROM adverts GROUP BY 1 UNION ALL SELECT job_type, 'has_open', count(*) FILTER (has_open), count(*) FROM adverts GROUP BY 1)""")
def pos05_flag_frequency(spark, d):
    return rounded(P.flag_frequency(adverts(spark, d), FLAGS, ["job_type"]))


@query("""SELECT CASE WHEN grouping(prefecture) = 1 THEN 'employment' ELSE 'prefecture' END AS scope, job_type, employment, prefecture, count(*) AS n, CAST(trunc(avg(salary)) AS BIGINT) AS mean_low, CAST(trunc(median(salary)) AS BIGINT) AS median_low,
    CAST(trunc(avg(salary_high)) AS BIGINT) AS mean_high, CAST(trunc(median(salary_high)) AS BIGINT) AS median_high FROM adverts GROUP BY GROUPING SETS ((job_type, employment), (job_type, prefecture)) HAVING count(*) >= 3""")
def pos20_salary_stats(spark, d):
    return P.salary_stats(adverts(spark, d), "salary", "salary_high", {"employment": ["job_type", "employment"], "prefecture": ["job_type", "prefecture"]})


@query("""SELECT employment, band, count(*) AS count, round(median(salary), 4) AS median_value, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY employment), 4) AS share_pct
    FROM (SELECT *, CASE WHEN salary < 20000 THEN '<20000' WHEN salary < 40000 THEN '20000+' WHEN salary < 60000 THEN '40000+' ELSE '60000+' END AS band FROM adverts) GROUP BY 1, 2""")
def pos13_salary_bands(spark, d):
    return rounded(P.salary_bands(adverts(spark, d), "salary", (20000, 40000, 60000), ["employment"]), 4)


@query(""", levels AS (SELECT 'nation' AS scope, CAST(NULL AS VARCHAR) AS prefecture, CAST(NULL AS VARCHAR) AS employment, salary, salary_high FROM adverts
    UNION ALL SELECT 'prefecture', prefecture, NULL, salary, salary_high FROM adverts UNION ALL SELECT 'employment', NULL, employment, salary, salary_high FROM adverts),
    q AS (SELECT scope, prefecture, employment, count(*) AS n, avg(salary) AS mean, quantile_cont(salary, 0.25) AS p25, quantile_cont(salary, 0.5) AS median, quantile_cont(salary, 0.75) AS p75, quantile_cont(salary, 0.9) AS p90,
        count(*) FILTER (salary_high > 0) * 100.0 / count(*) AS range_pct, quantile_cont(salary_high - salary, 0.5) FILTER (salary_high > 0) AS range_median FROM levels GROUP BY ALL HAVING count(*) >= 10),
    kept AS (SELECT l.*, row_number() OVER (PARTITION BY l.scope, l.prefecture, l.employment ORDER BY salary) AS i FROM levels l JOIN q
        ON l.scope = q.scope AND l.prefecture IS NOT DISTINCT FROM q.prefecture AND l.employment IS NOT DISTINCT FROM q.employment AND salary BETWEEN p25 - 1.5 * (p75 - p25) AND p75 + 1.5 * (p75 - p25)),
    t AS (SELECT scope, prefecture, employment, stddev_samp(salary) AS std, 2 * sum(i * salary) / (count(*) * sum(salary)) - (count(*) + 1) / CAST(count(*) AS DOUBLE) AS gini FROM kept GROUP BY ALL HAVING count(*) >= 10)
    SELECT q.scope, q.prefecture, q.employment, n, round(mean, 4) AS mean, round(p25, 4) AS p25, round(median, 4) AS median, round(p75, 4) AS p75, round(p90, 4) AS p90, round(std, 4) AS std, round(gini, 4) AS gini,
        round(range_pct, 4) AS range_pct, round(range_median, 4) AS range_median
    FROM q JOIN t ON q.scope = t.scope AND q.prefecture IS NOT DISTINCT FROM t.prefecture AND q.employment IS NOT DISTINCT FROM t.employment""")
def pos14_salary_distribution(spark, d):
    levels = {"nation": [], "prefecture": ["prefecture"], "employment": ["employment"]}
    return rounded(S.distribution(adverts(spark, d), levels, "salary", "salary_high"), 4)


@query("""SELECT job_type, CAST(sum(c) AS BIGINT) AS total, count(*) AS units, round(sum(CASE WHEN r <= 1 THEN p ELSE 0 END), 6) AS top1_share, round(sum(CASE WHEN r <= 5 THEN p ELSE 0 END), 6) AS top5_share, round(sum(CASE WHEN r <= 10 THEN p ELSE 0 END), 6) AS top10_share,
    round(sum(CASE WHEN r <= 20 THEN p ELSE 0 END), 6) AS top20_share, round(sum(p * p), 6) AS hhi, CASE WHEN count(*) FILTER (c >= 2) >= 10 THEN round(abs(regr_slope(ln(c), ln(r)) FILTER (c >= 2)), 6) END AS zipf
    FROM (SELECT job_type, c, c / CAST(sum(c) OVER (PARTITION BY job_type) AS DOUBLE) AS p, row_number() OVER (PARTITION BY job_type ORDER BY c DESC, facility) AS r FROM (SELECT job_type, facility, count(*) AS c FROM adverts GROUP BY 1, 2)) GROUP BY 1""")
def pos15_concentration(spark, d):
    return rounded(S.concentration(adverts(spark, d), ["job_type"], "facility"))


@query("""SELECT municipality, CAST(sum(c) AS BIGINT) AS total, round(-sum(p * log2(p)), 6) AS entropy, round(log2(count(*)), 6) AS max_entropy, arg_min(employment, (-c, employment)) AS dominant,
    '{' || string_agg('"' || employment || '":' || c, ',' ORDER BY employment) || '}' AS distribution, round(-sum(p * log2(p)) / log2(count(*)), 6) AS evenness
    FROM (SELECT municipality, employment, c, c / CAST(sum(c) OVER (PARTITION BY municipality) AS DOUBLE) AS p FROM (SELECT municipality, employment, count(*) AS c FROM adverts GROUP BY 1, 2)) GROUP BY 1""")
def pos16_employment_entropy(spark, d):
    return rounded(S.entropy(adverts(spark, d), ["municipality"], "employment"))


@query("""SELECT 1 AS depth, job_type, CAST(NULL AS VARCHAR) AS title, count(*) AS count FROM adverts GROUP BY job_type UNION ALL SELECT 2, job_type, title, count(*) FROM adverts GROUP BY job_type, title""")
def pos19_hierarchy(spark, d):
    return P.hierarchy_counts(adverts(spark, d), ["job_type", "title"])


@query("""SELECT job_type, prefecture, count(*) AS n, round(avg(salary), 4) AS mean, round(any_value(m), 4) AS national_mean, round(avg(salary) - any_value(m), 4) AS gap FROM adverts JOIN (SELECT job_type, avg(salary) AS m FROM adverts GROUP BY 1) USING (job_type) GROUP BY 1, 2""")
def win05_gap_to_national(spark, d):
    return rounded(P.gap_to_national(adverts(spark, d), ["job_type"], "salary", "prefecture"), 4)


@query("""SELECT job_type, grade, count(*) AS count FROM (SELECT job_type, CASE WHEN salary >= q3 THEN 'A' WHEN salary >= q2 THEN 'B' WHEN salary >= q1 THEN 'C' ELSE 'D' END AS grade FROM adverts JOIN
    (SELECT job_type, quantile_cont(salary, 0.25) AS q1, quantile_cont(salary, 0.5) AS q2, quantile_cont(salary, 0.75) AS q3 FROM adverts GROUP BY 1) USING (job_type)) GROUP BY 1, 2""")
def pos17_grades(spark, d):
    return core.cross(P.grade_by_quartile(adverts(spark, d), "salary", ["job_type"]), ["job_type", "grade"])


_CELLS = """, cells AS (SELECT gender AS a, age_group AS b, count(*) AS o FROM people WHERE gender IS NOT NULL GROUP BY 1, 2), g AS (SELECT ra, cb, coalesce(o, 0) AS o, (SELECT sum(o) FROM cells) AS n FROM (SELECT a, sum(o) AS ra FROM cells GROUP BY 1) x CROSS JOIN (SELECT b, sum(o) AS cb FROM cells GROUP BY 1) y LEFT JOIN cells USING (a, b))"""


@query(_CELLS + """ SELECT CAST(max(n) AS BIGINT) AS n, (SELECT (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) FROM cells) AS dof, round(sum(pow(o - ra * cb / CAST(n AS DOUBLE), 2) / (ra * cb / CAST(n AS DOUBLE))), 5) AS chi_square,
    round(sqrt(sum(pow(o - ra * cb / CAST(n AS DOUBLE), 2) / (ra * cb / CAST(n AS DOUBLE))) / max(n) / (SELECT least(count(DISTINCT a), count(DISTINCT b)) - 1 FROM cells)), 5) AS cramers_v FROM g""")
def sta01_chi_square(spark, d):
    return rounded(S.chi_square(people(spark, d), "gender", "age_group"), 5)


@query(""", p AS (SELECT job_type AS g, count(*) AS n, avg(salary) AS m, var_pop(salary) AS v FROM adverts GROUP BY 1), s AS (SELECT sum(n) AS n, count(*) AS k, sum(n * v) AS w, sum(n * m * m) - sum(n) * pow(sum(n * m) / sum(n), 2) AS b FROM p)
    SELECT CAST(n AS BIGINT) AS n, k AS groups, round((b / (k - 1)) / (w / (n - k)), 4) AS f_statistic, round(b / (b + w), 6) AS eta_squared FROM s""")
def sta02_anova(spark, d):
    out = S.anova(adverts(spark, d), "job_type", "salary")
    return out.select("n", "groups", F.round("f_statistic", 4).alias("f_statistic"), F.round("eta_squared", 6).alias("eta_squared"))


@query("""SELECT municipality, n, round(CASE WHEN n >= 10 THEN 2 * s / (n * t) - (n + 1) / CAST(n AS DOUBLE) END, 6) AS gini FROM (SELECT municipality, count(*) AS n, sum(i * salary) AS s, sum(salary) AS t
    FROM (SELECT municipality, salary, row_number() OVER (PARTITION BY municipality ORDER BY salary) AS i FROM adverts) GROUP BY 1)""")
def sta03_gini(spark, d):
    return rounded(S.gini(adverts(spark, d), ["municipality"], "salary"))


@query("""SELECT job_type, count(*) AS n, round(avg(salary), 4) AS mean FROM adverts JOIN (SELECT job_type, quantile_cont(salary, 0.25) AS a, quantile_cont(salary, 0.75) AS b FROM adverts GROUP BY 1) USING (job_type)
    WHERE salary BETWEEN a - 0.5 * (b - a) AND b + 0.5 * (b - a) GROUP BY 1""")
def sta07_iqr_trim(spark, d):
    return rounded(S.trim_outliers(adverts(spark, d), ["job_type"], "salary", 0.5).groupBy("job_type").agg(F.count("*").alias("n"), F.avg("salary").alias("mean")), 4)


@query("""SELECT 'gender' AS "column", round(avg(CASE WHEN gender IS NULL THEN 0.0 ELSE 1 END), 6) AS completeness, CAST(NULL AS DOUBLE) AS validity FROM people UNION ALL SELECT 'age', round(avg(CASE WHEN age IS NULL THEN 0.0 ELSE 1 END), 6), round(avg(CASE WHEN age BETWEEN 20 AND 60 THEN 1.0 ELSE 0 END), 6) FROM people""")
def sta08_completeness(spark, d):
    return rounded(S.completeness(people(spark, d), ["gender", "age"], {"age": (20, 60)}))


_WORDS = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS token FROM documents), tokens AS (SELECT doc_id, token FROM w WHERE length(token) >= 2)"""


_PAIRS = r"""WITH l AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS a FROM documents), w AS (SELECT doc_id, lang, source, unnest(a) AS token, generate_subscripts(a, 1) AS position FROM l),
    one AS (SELECT * FROM w WHERE length(token) >= 2), tokens AS (SELECT doc_id, lang, source, token FROM one UNION ALL SELECT doc_id, lang, source, token || ' ' || next FROM (SELECT *, lead(token) OVER (PARTITION BY doc_id ORDER BY position) AS next FROM one) WHERE next IS NOT NULL)"""


@query(_PAIRS + """, tf AS (SELECT doc_id, token, count(*) AS tf FROM tokens GROUP BY 1, 2), n AS (SELECT count(DISTINCT doc_id) AS n FROM tokens),
    df AS (SELECT token, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY 1), top AS (SELECT token, df, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM df, n WHERE df >= least(5, greatest(2, floor(n / 100))) AND df <= n * 0.95 ORDER BY cf DESC, token LIMIT 3000),
    x AS (SELECT doc_id, token, (1 + ln(tf)) * idf AS w FROM tf JOIN top USING (token)), norm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1)
    SELECT token, df, round(score, 5) AS score FROM (SELECT token, count(*) AS df, avg(w / norm) AS score FROM x JOIN norm USING (doc_id) GROUP BY 1) ORDER BY round(score, 9) DESC, token LIMIT 50""", base=False)
def txt03_tf_idf(spark, d):
    return rounded(T.tf_idf_of_texts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", r"[a-zà-ÿ]+"), 5)


@query(_PAIRS + """, n AS (SELECT count(DISTINCT doc_id) AS n FROM tokens), known AS (SELECT token FROM one GROUP BY 1 ORDER BY count(*) DESC, token LIMIT 1000)
    SELECT token, tf, df, round(tf * (ln(n / CAST(df AS DOUBLE)) + 1), 4) AS score FROM (SELECT token, count(*) AS tf, count(DISTINCT doc_id) AS df FROM one WHERE token NOT IN (SELECT token FROM known) GROUP BY 1), n ORDER BY tf * (ln(n / CAST(df AS DOUBLE)) + 1) DESC, token LIMIT 50""", base=False)
def txt04_extra_keywords(spark, d):
    tokens = T.tokenise(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", r"[a-zà-ÿ]+")
    known = tokens.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(1000)
    return rounded(T.extra_keywords(tokens, "doc_id", known), 4)


@query(_PAIRS + """, d AS (SELECT DISTINCT lang, source, doc_id, token FROM one WHERE lang IS NOT NULL AND source IS NOT NULL), r AS (SELECT lang, source, count(DISTINCT doc_id) AS n FROM d GROUP BY 1, 2), a AS (SELECT lang, count(DISTINCT doc_id) AS n_all FROM d GROUP BY 1)
    SELECT lang, source, token, df, round(lift, 4) AS lift FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY lift DESC, df DESC, token) AS k FROM (SELECT lang, source, token, df, df_all, (df / CAST(n AS DOUBLE)) / (df_all / CAST(n_all AS DOUBLE)) AS lift FROM (SELECT lang, source, token, count(*) AS df FROM d GROUP BY 1, 2, 3)
    JOIN (SELECT lang, token, count(DISTINCT doc_id) AS df_all FROM d GROUP BY 1, 2) USING (lang, token) JOIN r USING (lang, source) JOIN a USING (lang)) WHERE df >= 3 AND (lift >= 1.5 OR df = df_all)) WHERE k <= 50""", base=False)
def txt05_regional_keywords(spark, d):
    docs = core.known(table(spark, d, "documents").select("doc_id", "lang", "source", "text"), ["lang", "source"])
    return rounded(T.regional_keywords(T.tokenise(docs, ["doc_id", "lang", "source"], "text", r"[a-zà-ÿ]+"), "doc_id", ["lang"], "source"), 4)


@query("""SELECT flag_a, flag_b, "both", round("both" / n, 6) AS support, round(ca * cb / n, 4) AS expected, round("both" / (ca * cb / n), 6) AS lift, round((n * "both" - ca * cb) / sqrt(ca * cb * (n - ca) * (n - cb)), 6) AS phi FROM (
    SELECT 'has_bulk' AS flag_a, 'has_discount' AS flag_b, count(*) FILTER (has_bulk AND has_discount) AS "both", CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (has_bulk) AS DOUBLE) AS ca, CAST(count(*) FILTER (has_discount) AS DOUBLE) AS cb FROM adverts
    """ + " ".join(f"UNION ALL SELECT '{a}', '{b}', count(*) FILTER ({a} AND {b}), count(*), count(*) FILTER ({a}), count(*) FILTER ({b}) FROM adverts" for i, a in enumerate(FLAGS) for b in FLAGS[i + 1 :] if (a, b) != FLAGS[:2]) + ")")
def txt06_flag_association(spark, d):
    out = T.flag_association(adverts(spark, d), FLAGS, support=0.0, high=0.0)
    return rounded(out.withColumn("expected", F.round("expected", 4)))


@query(_WORDS + """, word AS (SELECT DISTINCT doc_id, token FROM tokens), n AS (SELECT count(DISTINCT doc_id) AS n FROM tokens), df AS (SELECT token, count(*) AS df FROM word GROUP BY 1 HAVING count(*) >= 5),
    k AS (SELECT doc_id, token, df FROM word JOIN df USING (token)),
    p AS (SELECT a.token AS word_a, b.token AS word_b, a.df AS da, b.df AS db, count(*) AS pair_count FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.token < b.token GROUP BY 1, 2, 3, 4 HAVING count(*) >= 5)
    SELECT word_a, word_b, pair_count, round(npmi, 5) AS npmi FROM (SELECT *, log2(pair_count * n / CAST(da * db AS DOUBLE)) / -log2(pair_count / CAST(n AS DOUBLE)) AS npmi FROM p, n WHERE pair_count < n) WHERE npmi >= 0.15 ORDER BY npmi DESC, pair_count DESC, word_a, word_b LIMIT 100""", base=False)
def txt07_npmi(spark, d):
    return rounded(T.npmi_of_texts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", r"[a-zà-ÿ]+"), 5)


@query()
def txt08_association_rules(spark, d):
    items = _tagged(spark, d).select("tags")
    return rounded(T.association_rules(items, "tags", 0.01, 0.1, 0.5))


@query("""SELECT "column", count(*) AS rows, count(*) FILTER (v IS NULL) AS nulls, round(count(*) FILTER (v IS NULL) / CAST(count(*) AS DOUBLE), 6) AS null_rate,
    CASE WHEN count(*) FILTER (v IS NULL) = 0 THEN 'complete' WHEN count(*) FILTER (v IS NULL) < 0.1 * count(*) THEN 'good' WHEN count(*) FILTER (v IS NULL) < 0.3 * count(*) THEN 'fair' WHEN count(*) FILTER (v IS NULL) < 0.7 * count(*) THEN 'poor' ELSE 'bad' END AS status
    FROM (SELECT 'gender' AS "column", gender AS v FROM people UNION ALL SELECT 'age_group', age_group FROM people UNION ALL SELECT 'employment', employment FROM people) GROUP BY 1""")
def val01_null_report(spark, d):
    return rounded(V.null_report(people(spark, d).select("gender", "age_group", "employment")))


@query("""SELECT "column", CAST(sum(n) AS BIGINT) AS valid, count(*) AS "values", min(n) AS min_group, max(n) AS max_group, CASE WHEN min(n) >= 30 THEN 'HIGH' WHEN min(n) >= 10 THEN 'MEDIUM' WHEN min(n) >= 3 THEN 'LOW' ELSE 'CRITICAL' END AS reliability, min(n) < 30 AS warning
    FROM (SELECT 'gender' AS "column", gender AS v, count(*) AS n FROM people WHERE gender IS NOT NULL GROUP BY 2 UNION ALL SELECT 'municipality', municipality, count(*) FROM people GROUP BY 2) GROUP BY 1""")
def val02_sample_report(spark, d):
    return V.sample_report(people(spark, d), ["gender", "municipality"])


@query("""SELECT (SELECT count(DISTINCT municipality) FROM people WHERE gender IS NOT NULL) * 6 AS cells, CAST(sum(n) AS BIGINT) AS valid, count(*) AS filled, (SELECT count(DISTINCT municipality) FROM people WHERE gender IS NOT NULL) * 6 - count(*) AS empty_cells, count(*) FILTER (n < 5) AS small_cells,
    count(*) FILTER (n < 5) / CAST((SELECT count(DISTINCT municipality) FROM people WHERE gender IS NOT NULL) * 6 AS DOUBLE) < 0.3 AS reliable FROM (SELECT municipality, age_group, count(*) AS n FROM people WHERE gender IS NOT NULL GROUP BY 1, 2)""")
def val03_cross_reliability(spark, d):
    return V.cross_reliability(people(spark, d).filter("gender is not null"), "municipality", "age_group")


@query("""SELECT kind AS sample_class, count(*) AS rows, round(avg(n), 6) AS avg_count FROM (SELECT n, CASE WHEN n >= 100 THEN 'SUFFICIENT' WHEN n >= 30 THEN 'MODERATE' WHEN n >= 10 THEN 'SMALL' ELSE 'VERY_SMALL' END AS kind FROM (SELECT municipality, age_group, count(*) AS n FROM people GROUP BY 1, 2)) GROUP BY 1""")
def val16_quality_summary(spark, d):
    return rounded(V.quality_summary(V.quality_flags(core.cross(people(spark, d), HOME[1:] + ["age_group"]), "count"), "sample_class", "count"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1", base=False)
def val13_duplicate_keys(spark, d):
    return V.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT 'l_discount' AS "column", count(*) FILTER (l_discount < 0) AS negatives, count(*) FILTER (l_discount IS NULL) AS nulls, 0 AS infinite, count(*) FILTER (abs(l_discount - (SELECT avg(l_discount) FROM lineitem)) > 1.5 * (SELECT stddev_samp(l_discount) FROM lineitem)) AS outliers FROM lineitem
    UNION ALL SELECT 'l_quantity', count(*) FILTER (l_quantity < 0), count(*) FILTER (l_quantity IS NULL), 0, count(*) FILTER (abs(l_quantity - (SELECT avg(l_quantity) FROM lineitem)) > 1.5 * (SELECT stddev_samp(l_quantity) FROM lineitem)) FROM lineitem""", base=False)
def val14_numeric_integrity(spark, d):
    return V.numeric_integrity(table(spark, d, "lineitem"), ["l_discount", "l_quantity"], 1.5)


@query("""SELECT 'ids are unique' AS "check", count(*) = count(DISTINCT person_id) AS passed FROM people UNION ALL SELECT 'ages in range', min(age) >= 0 AND max(age) <= 120 FROM people UNION ALL SELECT 'genders known', count(gender) = count(*) FROM people""")
def val07_load_checks(spark, d):
    return V.load_checks(people(spark, d), {"ids are unique": F.count("*") == F.countDistinct("person_id"), "ages in range": (F.min("age") >= 0) & (F.max("age") <= 120), "genders known": F.count("gender") == F.count("*")})


@query("""SELECT municipality, age_group, count, r AS rank FROM (SELECT municipality, age_group, count(*) AS count, row_number() OVER (PARTITION BY municipality ORDER BY count(*) DESC, age_group) AS r FROM people GROUP BY 1, 2) WHERE r <= 3""")
def win01_top_n(spark, d):
    return core.top_n(core.cross(people(spark, d), ["municipality", "age_group"]), ["municipality"], [F.desc("count"), F.asc("age_group")], 3, "rank")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1""", base=False)
def set04_latest(spark, d):
    return core.latest(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("""SELECT doc_id, CAST(coalesce(richness, 0) AS INTEGER) AS richness, marks FROM (SELECT doc_id, CAST(length(text) >= 50 AS INTEGER) + CAST(length(text) >= 200 AS INTEGER) + CAST(n_chars >= 50 AS INTEGER) + CAST(n_chars >= 200 AS INTEGER) AS richness,
    CAST(2 * (len(regexp_extract_all(text, 'the')) - len(regexp_extract_all(text, '[ao]the'))) + 3 * (len(regexp_extract_all(text, 'und')) - len(regexp_extract_all(text, '[ao]und'))) AS INTEGER) AS marks FROM documents)""", base=False)
def fun43_signals(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", advert.richness([F.length("text"), F.col("n_chars")]).alias("richness"), advert.signal_score(F.col("text"), {"the": 2, "und": 3}, "ao").alias("marks"))


@query("""SELECT o_orderkey, round(greatest(1.0, p - days / 60.0), 2) AS urgency, days > 90 AS stale
    FROM (SELECT o_orderkey, 6 - CAST(o_orderpriority[1] AS INTEGER) AS p, datediff('day', CAST(o_orderdate AS DATE), DATE '1996-01-01') AS days FROM orders)""", base=False)
def fun17_start_urgency(spark, d):
    ref = F.to_date(F.lit("1996-01-01"))
    o = table(spark, d, "orders").withColumn("wished", F.to_date("o_orderdate"))
    points = 6 - F.substring("o_orderpriority", 1, 1).cast("int")
    return o.select("o_orderkey", person.start_urgency(points, F.col("wished"), ref).alias("urgency"), person.stale(F.col("wished"), ref).alias("stale"))


@query()
def clu01_clusters(spark, d):
    e = table(spark, d, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"x{i}" for i in range(width)]
    return C.assign_clusters(e.select("vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)]), names, scaling="standard").select("vec_id", F.col("cluster").cast("int").alias("cluster"))


#: Row types of the integrated table that are groupings of one table: place columns are common, these are the categories.
WANTED = {
    "AGE_GENDER": ["age_group", "gender"], "PERSONA_MUNI": ["age_group", "gender", "license"], "WORKSTYLE_DISTRIBUTION": ["employment"],
    "WORKSTYLE_AGE": ["employment", "age_group"], "WORKSTYLE_GENDER": ["employment", "gender"], "WORKSTYLE_AGE_GENDER": ["employment", "age_group", "gender"],
    "WORKSTYLE_QUALIFICATION": ["employment", "qualifications"], "URGENCY": ["urgency"], "URGENCY_AGE": ["urgency", "age_group"],
    "URGENCY_EMPLOYMENT": ["urgency", "employment"], "URGENCY_GENDER": ["urgency", "gender"], "MOBILITY_PATTERN": ["home_prefecture", "age_group", "gender"], "RESIDENCE_FLOW": ["home_prefecture", "home_municipality"],
}
RESIDENT = {
    "AGE_GENDER_RESIDENCE": ["age_group", "gender"], "PERSONA": ["age_group", "gender", "license"], "CAREER_CROSS": ["employment", "age_group"],
    "EMPLOYMENT_AGE_GENDER": ["employment", "age_group", "gender"], "QUALIFICATION_DETAIL": ["qualifications"], "QUALIFICATION_PERSONA": ["qualifications", "age_group", "gender"],
}


def _row_types(df, kinds):
    """All groupings in one pass, as row_type, place, category1..3 and measures; each with its share of the place."""
    out = core.scopes(df, {k: [*HOME, *c] for k, c in kinds.items()}, [F.count("*").alias("count"), F.avg("age").alias("avg_age"), F.avg("qualification_count").alias("avg_qualifications")], "row_type")
    for i in range(3):
        picked = F.coalesce(*[F.when(F.col("row_type") == k, F.col(c[i])) for k, c in kinds.items() if len(c) > i], F.lit(None).cast("string"))
        out = out.withColumn(f"category{i + 1}", picked)
    return core.with_share(out.select("row_type", *HOME, "category1", "category2", "category3", "count", "avg_age", "avg_qualifications"), "count", ["row_type", *HOME])


def _labelled(df):
    return df.fillna("unknown", ["gender"]).withColumn("license", F.col("has_license").cast("string")).withColumn("qualifications", F.col("qualification_count").cast("string"))


def _rows_sql(table: str, kinds: dict, place: str) -> str:
    parts = []
    for k, c in kinds.items():
        cats = [*c, *["NULL"] * (3 - len(c))]
        parts.append(f"""SELECT '{k}' AS row_type, prefecture, municipality, CAST({cats[0]} AS VARCHAR) AS category1, CAST({cats[1]} AS VARCHAR) AS category2, CAST({cats[2]} AS VARCHAR) AS category3, count(*) AS count,
            round(avg(age), 6) AS avg_age, round(avg(qualification_count), 6) AS avg_qualifications, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY prefecture, municipality), 6) AS share_pct FROM {table} GROUP BY prefecture, municipality, {', '.join(c)}""")
    return " UNION ALL ".join(parts)


@query(""", home AS (SELECT want_prefecture AS prefecture, want_municipality AS municipality, prefecture AS home_prefecture, municipality AS home_municipality, age, age_group, coalesce(gender, 'unknown') AS gender, employment, urgency, qualification_count,
    CAST(has_license AS VARCHAR) AS license, CAST(qualification_count AS VARCHAR) AS qualifications FROM wishes) """ + _rows_sql("home", WANTED, "want"))
def int01_integrated_wanted(spark, d):
    home = _labelled(wishes(spark, d)).withColumnsRenamed({"prefecture": "home_prefecture", "municipality": "home_municipality"})
    return rounded(_row_types(home.withColumnsRenamed({"want_prefecture": "prefecture", "want_municipality": "municipality"}), WANTED))


@query(""", residents AS (SELECT prefecture, municipality, age, age_group, coalesce(gender, 'unknown') AS gender, employment, qualification_count, CAST(has_license AS VARCHAR) AS license, CAST(qualification_count AS VARCHAR) AS qualifications FROM people) """ + _rows_sql("residents", RESIDENT, "home"))
def int01_integrated_resident(spark, d):
    return rounded(_row_types(_labelled(people(spark, d)), RESIDENT))


#: Whole numbers that some row types lack; in the long table all measures are doubles.
WHOLE = ("count", "demand_count", "supply_count", "gap", "inflow", "outflow", "net_flow", "male", "female", "total")

#: Row types that count people by how many places they want and how far these lie.
MOBILE = {"WORKSTYLE_DESIRED_AREA_COUNT": ["employment", "area_band"], "WORKSTYLE_MOBILITY": ["employment", "mobility"]}


def _typed(name: str, sql: str, *cats: str) -> str:
    """A part of the integrated table: the rows of a query under a row type, its categories renamed."""
    renamed = "".join(f", {c} AS category{i + 1}" for i, c in enumerate(cats))
    return f"SELECT '{name}' AS row_type, * {f'EXCLUDE ({', '.join(cats)})' if cats else ''}{renamed} FROM ({sql})"


def _placed(name: str) -> str:
    """A query by municipality with the prefecture; a municipality has one."""
    return f"SELECT q.*, prefecture FROM ({ORACLE_SQL[name]}) q JOIN (SELECT prefecture, municipality FROM places) USING (municipality)"


_INTEGRATED = """, home AS (SELECT want_prefecture AS prefecture, want_municipality AS municipality, prefecture AS home_prefecture, municipality AS home_municipality, age, age_group, coalesce(gender, 'unknown') AS gender, employment, urgency, qualification_count,
    CAST(has_license AS VARCHAR) AS license, CAST(qualification_count AS VARCHAR) AS qualifications FROM wishes),
    residents AS (SELECT prefecture, municipality, age, age_group, coalesce(gender, 'unknown') AS gender, employment, qualification_count, CAST(has_license AS VARCHAR) AS license, CAST(qualification_count AS VARCHAR) AS qualifications FROM people),
    wanted AS (SELECT person_id, count(DISTINCT want_municipality) AS n, count(DISTINCT want_municipality) FILTER (want_prefecture <> prefecture) AS outside FROM wishes GROUP BY 1),
    mobile AS (SELECT people.*, CASE WHEN n < 2 THEN '1' WHEN n < 4 THEN '2-3' WHEN n < 10 THEN '4-9' ELSE '10+' END AS area_band,
    CASE WHEN outside / CAST(n AS DOUBLE) >= 0.8 THEN 'A' WHEN outside / CAST(n AS DOUBLE) >= 0.5 THEN 'B' WHEN outside > 0 THEN 'C' ELSE 'D' END AS mobility FROM people JOIN wanted USING (person_id)) """ + f"SELECT * REPLACE ({', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in WHOLE)}) FROM (" + " UNION ALL BY NAME ".join([
    f"SELECT * FROM ({_rows_sql('home', WANTED, 'want')})", f"SELECT * FROM ({_rows_sql('residents', RESIDENT, 'home')})", f"SELECT * FROM ({_rows_sql('mobile', MOBILE, 'home')})",
    _typed("SUMMARY", ORACLE_SQL["agg01_map_metrics"]), _typed("GAP", ORACLE_SQL["agg21_demand_supply_gap"]), _typed("COMPETITION", _placed("agg23_competition")),
    _typed("RARITY", """SELECT prefecture, municipality, age_group, gender, count(*) AS count, round(1.0 / count(*), 6) AS rarity_score, CASE WHEN count(*) <= 1 THEN 'S' WHEN count(*) <= 2 THEN 'A' WHEN count(*) <= 5 THEN 'B' WHEN count(*) <= 20 THEN 'C' ELSE 'D' END AS rarity_rank FROM people WHERE gender IS NOT NULL GROUP BY 1, 2, 3, 4""", "age_group", "gender"),
    _typed("FLOW", f"SELECT * EXCLUDE (place), place AS municipality FROM ({ORACLE_SQL['agg58_flow_balance']})"),
    _typed("DESIRED_AREA_PATTERN", f"SELECT place1 AS municipality, place2, count FROM ({ORACLE_SQL['agg30_desired_pairs']})", "place2"),
    _typed("RETENTION", _placed("agg28_retention"), "employment"),
]) + ")"


@query(_INTEGRATED)
def int01_integrated(spark, d):
    """The integrated long table: row_type, place, categories, measures. Wishes are joined once and read by every part."""
    p, w = people(spark, d), cut_lineage(wishes(spark, d))
    named = lambda df, t, *cats: df.select(F.lit(t).alias("row_type"), "*").withColumnsRenamed({c: f"category{i + 1}" for i, c in enumerate(cats)})
    home = w.withColumnsRenamed({"prefecture": "home_prefecture", "municipality": "home_municipality"}).withColumnsRenamed({"want_prefecture": "prefecture", "want_municipality": "municipality"})
    pairs = A.area_pairs(w, "person_id", "want_municipality", "want_prefecture", 20, 6)
    flow = G.flow_balance(G.aggregate_flow(w.filter("municipality <> want_municipality"), ["municipality", "want_municipality"]), "municipality", "want_municipality", "flow_count")
    wanted = w.groupBy("person_id").agg(F.countDistinct("want_municipality").alias("n"), F.countDistinct(F.when(F.col("want_prefecture") != F.col("prefecture"), F.col("want_municipality"))).alias("outside"))
    mobile = p.join(wanted, "person_id").withColumns({"area_band": core.bands("n", (2, 4, 10), ("1", "2-3", "4-9", "10+")), "mobility": person.mobility_rank(person.mobility_score(F.col("outside"), F.col("n")))})
    return rounded(core.union_tables(
        _row_types(_labelled(home), WANTED),
        _row_types(_labelled(p), RESIDENT),
        _row_types(mobile, MOBILE),
        named(A.map_metrics(p), "SUMMARY"),
        named(A.demand_supply_gap(home, p, HOME), "GAP"),
        named(A.competition(p, HOME), "COMPETITION"),
        named(A.rarity(p, [*HOME, "age_group", "gender"]), "RARITY", "age_group", "gender"),
        named(flow.withColumnRenamed("place", "municipality"), "FLOW"),
        named(core.cross(pairs, ["place1", "place2"]).withColumnsRenamed({"place1": "municipality"}), "DESIRED_AREA_PATTERN", "place2"),
        named(A.retention(p, "employment", HOME), "RETENTION", "employment"),
    ).withColumns({c: F.col(c).cast("double") for c in WHOLE}))
