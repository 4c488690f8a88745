"""Registered queries behind dashboards, checks and merges; they add to those of plans.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shokuba.functions import people as person
from shokuba.operators import applicants as A
from shokuba.operators import clusters as C
from shokuba.operators import core
from shokuba.operators import flows as G
from shokuba.operators import postings as P
from shokuba.operators import quality as V
from shokuba.operators import stats as S
from shokuba.operators import textmining as T
from shokuba.plans.frames import FLAGS, adverts, areas, people, places, table, wishes
from shokuba.plans.queries import _COORDINATES, _TRIPS, _WORDS, HOME, _coordinates, _trips, query, rounded
from shokuba.sources import writers


@query("SELECT prefecture, count(*) AS count, count(DISTINCT municipality) AS municipalities, round(avg(age), 6) AS avg_age FROM people GROUP BY 1")
def agg03_prefecture_master(spark, d):
    return rounded(core.cross(people(spark, d), ["prefecture"], [F.countDistinct("municipality").alias("municipalities"), F.avg("age").alias("avg_age")]))


@query("SELECT municipality, age_group, gender, count(*) AS count FROM people WHERE gender IS NOT NULL GROUP BY 1, 2, 3")
def agg14_age_gender_residence(spark, d):
    return core.cross(people(spark, d), ["municipality", "age_group", "gender"])


@query("""SELECT want_municipality, urgency, count(*) AS count, round(avg(CASE WHEN has_license THEN 1.0 ELSE 0 END), 6) AS license_rate FROM (SELECT DISTINCT person_id, want_municipality, urgency, has_license FROM wishes) GROUP BY 1, 2""")
def agg06_item_by_municipality(spark, d):
    w = wishes(spark, d).select("person_id", "want_municipality", "urgency", "has_license").distinct()
    return rounded(core.cross(w, ["want_municipality", "urgency"], [F.avg(F.col("has_license").cast("double")).alias("license_rate")]))


@query("""SELECT municipality, count(*) AS total, 'residence' AS source FROM people GROUP BY 1 UNION ALL SELECT want_municipality, count(*), 'desired' FROM areas WHERE want_municipality NOT IN (SELECT municipality FROM people) GROUP BY 1""")
def agg24_competition_fallback(spark, d):
    home = people(spark, d).groupBy("municipality").agg(F.count("*").alias("total")).withColumn("source", F.lit("residence"))
    want = areas(spark, d).groupBy(F.col("want_municipality").alias("municipality")).agg(F.count("*").alias("total")).withColumn("source", F.lit("desired"))
    return A.add_missing_places(home, want, ["municipality"])


@query("""SELECT employment, CAST(sum(h) AS BIGINT) AS holders, string_agg(prefecture, ';' ORDER BY r1) FILTER (r1 <= 3) AS top_regions, string_agg(prefecture, ';' ORDER BY r2) FILTER (r2 <= 3) AS rare_regions FROM (
    SELECT employment, prefecture, h, row_number() OVER (PARTITION BY employment ORDER BY h DESC, prefecture) AS r1, row_number() OVER (PARTITION BY employment ORDER BY h / CAST(n AS DOUBLE), prefecture) AS r2
    FROM (SELECT employment, prefecture, count(DISTINCT person_id) AS h FROM people GROUP BY 1, 2) JOIN (SELECT prefecture, count(DISTINCT person_id) AS n FROM people GROUP BY 1) USING (prefecture)) GROUP BY 1""")
def agg36_penetration(spark, d):
    return A.penetration_extremes(people(spark, d), "employment", "prefecture", "person_id")


@query(f", {_COORDINATES} SELECT municipality, age_group, lat, lng, count(*) AS count FROM people JOIN coords USING (prefecture, municipality) GROUP BY ALL")
def agg40_persona_map(spark, d):
    counts = core.cross(people(spark, d), [*HOME, "age_group"])
    return G.with_coordinates(counts, _coordinates(spark, d), HOME).select("municipality", "age_group", "lat", "lng", "count")


@query(_TRIPS + """SELECT age_group, count(*) FILTER (municipality = want_municipality) AS same_place, count(*) FILTER (municipality <> want_municipality AND prefecture = want_prefecture) AS same_region, count(*) FILTER (prefecture <> want_prefecture) AS other,
    round(avg(distance_km), 4) AS avg_km, round(median(distance_km), 4) AS median_km FROM trips GROUP BY 1""")
def agg42_mobility_mix(spark, d):
    same, region = F.col("municipality") == F.col("want_municipality"), F.col("prefecture") == F.col("want_prefecture")
    out = _trips(spark, d).groupBy("age_group").agg(F.count_if(same).alias("same_place"), F.count_if(~same & region).alias("same_region"), F.count_if(~region).alias("other"), F.avg("distance_km").alias("avg_km"))
    median = S.percentiles(_trips(spark, d), ["age_group"], "distance_km", (0.5,)).select("age_group", F.col("q")[0].alias("median_km"))
    return rounded(out.join(median, "age_group"), 4)


@query("""SELECT prefecture, count(*) AS count, round(count(*) FILTER (gender = 'F') * 100.0 / count(*), 6) AS female_pct, round(count(*) FILTER (employment = 'BUILDING') * 100.0 / count(*), 6) AS building_pct, round(count(*) FILTER (age < 40) * 100.0 / count(*), 6) AS young_pct FROM people GROUP BY 1""")
def agg44_prefecture_percentages(spark, d):
    n = F.count("*")
    return rounded(core.cross(people(spark, d), ["prefecture"], [core.share(F.count_if(c), n).alias(a) for a, c in (("female_pct", F.col("gender") == "F"), ("building_pct", F.col("employment") == "BUILDING"), ("young_pct", F.col("age") < 40))]))


@query("""SELECT kind, CAST(coalesce(count, 0) AS BIGINT) AS count FROM (SELECT unnest(['A', 'B', 'C', 'X']) AS kind) LEFT JOIN (SELECT CASE WHEN prefecture <> want_prefecture THEN 'A' WHEN municipality <> want_municipality THEN 'B' ELSE 'C' END AS kind, count(*) AS count FROM wishes GROUP BY 1) USING (kind)""")
def agg50_mobility_types(spark, d):
    """All types of a fixed list, those without rows as 0."""
    kind = F.when(F.col("prefecture") != F.col("want_prefecture"), "A").when(F.col("municipality") != F.col("want_municipality"), "B").otherwise("C")
    kinds = spark.createDataFrame([("A",), ("B",), ("C",), ("X",)], "kind string")
    return kinds.join(core.cross(wishes(spark, d).withColumn("kind", kind), ["kind"]), "kind", "left").fillna(0, ["count"])


@query("""SELECT want_municipality, municipality, flow, r AS rank FROM (SELECT want_municipality, municipality, count(*) AS flow, row_number() OVER (PARTITION BY want_municipality ORDER BY count(*) DESC, municipality) AS r FROM wishes WHERE municipality <> want_municipality GROUP BY 1, 2) WHERE r <= 5""")
def agg52_flow_sources(spark, d):
    edges = core.cross(wishes(spark, d).filter("municipality <> want_municipality"), ["want_municipality", "municipality"]).withColumnRenamed("count", "flow")
    return core.top_n(edges, ["want_municipality"], [F.desc("flow"), F.asc("municipality")], 5, "rank")


@query("""SELECT employment, age_group, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY employment), 6) AS row_pct, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY age_group), 6) AS column_pct FROM people GROUP BY 1, 2""")
def agg53_workstyle_cross(spark, d):
    out = core.cross(people(spark, d), ["employment", "age_group"])
    return rounded(core.with_share(core.with_share(out, "count", ["employment"], "row_pct"), "count", ["age_group"], "column_pct"))


@query(_TRIPS + """SELECT employment, round(sum(avg_km * n) / sum(n), 3) AS avg_km, CAST(sum(n) AS BIGINT) AS count FROM (SELECT employment, municipality, avg(distance_km) AS avg_km, count(*) AS n FROM trips GROUP BY 1, 2) GROUP BY 1""")
def agg55_weighted_distance(spark, d):
    part = core.cross(_trips(spark, d), ["employment", "municipality"], [F.avg("distance_km").alias("avg_km")])
    return rounded(part.groupBy("employment").agg(core.weighted_mean("avg_km", "count").alias("avg_km"), F.sum("count").alias("count")), 3)


@query("""SELECT scope, prefecture, municipality, openings, rank FROM (SELECT CASE WHEN grouping(municipality) = 1 THEN 'prefecture' ELSE 'municipality' END AS scope, prefecture, municipality, count(*) AS openings,
    row_number() OVER (PARTITION BY grouping(municipality) ORDER BY count(*) DESC, prefecture, municipality) AS rank FROM adverts GROUP BY GROUPING SETS ((prefecture), (prefecture, municipality))) WHERE rank <= 10""")
def agg66_rankings(spark, d):
    out = core.scopes(adverts(spark, d), {"prefecture": ["prefecture"], "municipality": HOME}, [F.count("*").alias("openings")])
    return core.top_n(out, ["scope"], [F.desc("openings"), F.asc("prefecture"), F.asc("municipality")], 10, "rank")


@query("""SELECT place, CAST(sum(i) AS BIGINT) AS inflow, CAST(sum(l) AS BIGINT) AS local_count, round(sum(l) * 100.0 / sum(i), 6) AS local_pct FROM (SELECT want_municipality AS place, 1 AS i, CASE WHEN municipality = want_municipality THEN 1 ELSE 0 END AS l FROM wishes) GROUP BY 1""")
def agg69_talent_flow(spark, d):
    w = wishes(spark, d).groupBy(F.col("want_municipality").alias("place")).agg(F.count("*").alias("inflow"), F.count_if(F.col("municipality") == F.col("want_municipality")).alias("local_count"))
    return rounded(w.withColumn("local_pct", core.share(F.col("local_count"), F.col("inflow"))))


@query("""SELECT prefecture, round(avg(CASE WHEN has_license THEN 1.0 ELSE 0 END), 6) AS license_rate, count(*) FILTER (qualification_count = 0) AS none, count(*) FILTER (qualification_count BETWEEN 1 AND 2) AS some, count(*) FILTER (qualification_count > 2) AS many FROM people GROUP BY 1""")
def agg67_supply_panel(spark, d):
    q = F.col("qualification_count")
    out = people(spark, d).groupBy("prefecture").agg(F.avg(F.col("has_license").cast("double")).alias("license_rate"), F.count_if(q == 0).alias("none"), F.count_if(q.between(1, 2)).alias("some"), F.count_if(q > 2).alias("many"))
    return rounded(out)


@query(f", {_COORDINATES} SELECT municipality, want_municipality, a.lat AS from_lat, a.lng AS from_lng, b.lat AS to_lat, b.lng AS to_lng, flow FROM (SELECT municipality, want_municipality, count(*) AS flow FROM wishes WHERE municipality <> want_municipality GROUP BY 1, 2) JOIN coords a USING (municipality) JOIN coords b ON b.municipality = want_municipality ORDER BY flow DESC, municipality, want_municipality LIMIT 100")
def joi14_flow_lines(spark, d):
    c = _coordinates(spark, d)
    flow = core.cross(wishes(spark, d).filter("municipality <> want_municipality"), ["municipality", "want_municipality"]).withColumnRenamed("count", "flow")
    top = flow.orderBy(F.desc("flow"), "municipality", "want_municipality").limit(100)
    top = top.join(c.select("municipality", F.col("lat").alias("from_lat"), F.col("lng").alias("from_lng")), "municipality")
    return top.join(c.select(F.col("municipality").alias("want_municipality"), F.col("lat").alias("to_lat"), F.col("lng").alias("to_lng")), "want_municipality")


@query("""SELECT p_brand AS k, found, expected, round(found / CAST(expected AS DOUBLE), 6) AS rate, greatest(expected - found, 0) AS missing, found < expected * 0.02 AS short
    FROM (SELECT p_brand, count(*) AS expected FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) JOIN (SELECT p_brand, count(*) AS found FROM part GROUP BY 1) USING (p_brand)""", base=False)
def joi20_coverage(spark, d):
    part, line = table(spark, d, "part"), table(spark, d, "lineitem")
    want = line.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("k")).agg(F.count("*").alias("expected"))
    return rounded(P.coverage(part.withColumnRenamed("p_brand", "k"), want, "k", 0.02))


@query("""SELECT age_group, round(any_value(q) * 1000 / count(*), 6) AS rarity, count(*) AS count FROM people JOIN (SELECT age_group, avg(qualification_count) AS q FROM people GROUP BY 1) USING (age_group) GROUP BY age_group""")
def joi16_persona_rarity(spark, d):
    p = people(spark, d)
    quals = p.groupBy("age_group").agg(F.avg("qualification_count").alias("q"))
    out = core.cross(p, ["age_group"]).join(quals, "age_group")
    return rounded(out.select("age_group", (F.col("q") * 1000 / F.col("count")).alias("rarity"), "count"))


@query("""SELECT CASE WHEN grouping(municipality) = 0 THEN 'municipality' WHEN grouping(prefecture) = 0 THEN 'prefecture' ELSE 'nation' END AS scope, job_type, prefecture, municipality, count(*) AS n, round(avg(salary), 4) AS mean, round(stddev_pop(salary), 4) AS spread
    FROM adverts GROUP BY GROUPING SETS ((job_type), (job_type, prefecture), (job_type, prefecture, municipality)) HAVING count(*) >= 3""")
def pos18_scored_scopes(spark, d):
    levels = {"nation": ["job_type"], "prefecture": ["job_type", "prefecture"], "municipality": ["job_type", *HOME]}
    return rounded(core.suppress(core.scopes(adverts(spark, d), levels, [F.count("*").alias("n"), F.avg("salary").alias("mean"), F.stddev_pop("salary").alias("spread")]), "n", 3), 4)


@query("""SELECT prefecture, count(*) AS n, round(avg(salary), 4) AS mean, round(median(salary), 4) AS median, (SELECT CAST(round(salary / 10000) * 10000 AS BIGINT) FROM adverts b WHERE b.prefecture = a.prefecture GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode FROM adverts a GROUP BY prefecture""")
def pos21_salary_summary(spark, d):
    a = adverts(spark, d).withColumn("tens", (F.round(F.col("salary") / 10000) * 10000).cast("long"))
    median = S.percentiles(a, ["prefecture"], "salary", (0.5,)).select("prefecture", F.col("q")[0].alias("median"))
    return rounded(a.groupBy("prefecture").agg(F.count("*").alias("n"), F.avg("salary").alias("mean"), core.mode("tens").alias("mode")).join(median, "prefecture"), 4)


@query("""SELECT CASE WHEN grouping(prefecture) = 1 THEN 'nation' ELSE 'prefecture' END AS scope, prefecture, axis, category, count(*) AS count, CAST(sum(count(*)) OVER (PARTITION BY grouping(prefecture), prefecture, axis) AS BIGINT) AS total, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY grouping(prefecture), prefecture, axis), 6) AS share_pct
    FROM (SELECT prefecture, 'employment' AS axis, employment AS category FROM adverts UNION ALL SELECT prefecture, 'job_type', job_type FROM adverts) GROUP BY GROUPING SETS ((axis, category), (prefecture, axis, category))""")
def pos01_axis_shares(spark, d):
    return rounded(P.axis_shares(adverts(spark, d), ["employment", "job_type"], {"nation": [], "prefecture": ["prefecture"]}, 1))


@query("""SELECT k, n FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1) WHERE n >= 600""", base=False)
def grp02_suppression(spark, d):
    return core.suppress(table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n")), "n", 600)


@query("SELECT c_custkey AS person_id, c_name, CAST(NULL AS DOUBLE) AS s_acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier", base=False)
def set01_union_by_name(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("person_id"), "c_name")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("c_name"), "s_acctbal")
    return core.union_tables(c, s, columns=["person_id", "c_name", "s_acctbal"])


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)", base=False)
def set03_difference(spark, d):
    used = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return core.difference(table(spark, d, "part").select("p_partkey"), used, ["p_partkey"])


@query("""SELECT job_type, flag, count(*) AS count FROM (SELECT job_type, unnest(list_filter([CASE WHEN has_bulk THEN 'has_bulk' END, CASE WHEN has_tax THEN 'has_tax' END], lambda x: x IS NOT NULL)) AS flag FROM adverts) GROUP BY 1, 2""")
def piv03_melt_flags(spark, d):
    long = core.melt(adverts(spark, d), ["job_type"], ["has_bulk", "has_tax"], "flag", "on").filter("on")
    return core.cross(long, ["job_type", "flag"])


@query("""SELECT event_type, user_id, count(*) AS n, min(ts) AS first_ts, max_by(value, (ts, event_id)) AS last_value FROM events GROUP BY 1, 2""".replace("max_by", "arg_max"), base=False)
def win06_first_last(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query("""SELECT domain, token, count(*) AS count, count(*) >= 3 AS promote FROM (SELECT 'brand' AS domain, p_brand AS token FROM part) WHERE token NOT IN ('Brand#1', 'Brand#2') GROUP BY 1, 2""", base=False)
def snk08_unmatched_tokens(spark, d):
    tokens = table(spark, d, "part").select(F.lit("brand").alias("domain"), F.col("p_brand").alias("token"))
    known = spark.createDataFrame([("brand", "Brand#1"), ("brand", "Brand#2")], "domain string, token string")
    return writers.unmatched_tokens(tokens, known)


@query("""SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END DESC, o_orderkey) AS r FROM orders) WHERE r = 1""", base=False)
def snk07_merge_last_wins(spark, d):
    o = table(spark, d, "orders")
    return writers.merge_last_wins([o.filter("o_orderstatus <> 'O'"), o.filter("o_orderstatus = 'O'")], ["o_custkey", "o_orderpriority"], ["o_orderkey"]).select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT p_type, count(*) AS rows, 'v1' AS version FROM part GROUP BY 1", base=False)
def snk09_run_metadata(spark, d):
    return writers.run_metadata(table(spark, d, "part"), "p_type", "v1")


@query("""SELECT count, cell_quality, count(*) AS cells FROM (SELECT count(*) AS count, CASE WHEN count(*) >= 30 THEN 'SUFFICIENT' WHEN count(*) >= 5 THEN 'MARGINAL' ELSE 'INSUFFICIENT' END AS cell_quality FROM people GROUP BY municipality, age_group) GROUP BY 1, 2""")
def val06_cell_flags(spark, d):
    cells = V.cell_flags(core.cross(people(spark, d), ["municipality", "age_group"]), "count")
    return cells.groupBy("count", "cell_quality").agg(F.count("*").alias("cells"))


@query("""SELECT count(*) AS rows, count(*) FILTER (abs(a.gap - b.net) > 0.01) AS violations FROM (SELECT municipality, coalesce(w, 0) - coalesce(p, 0) AS gap FROM (SELECT want_municipality AS municipality, count(*) AS w FROM areas GROUP BY 1) FULL JOIN (SELECT municipality, count(*) AS p FROM people GROUP BY 1) USING (municipality)) a
    JOIN (SELECT municipality, sum(n) AS net FROM (SELECT want_municipality AS municipality, 1 AS n FROM areas UNION ALL SELECT municipality, -1 FROM people) GROUP BY 1) b USING (municipality)""")
def val15_gap_identity(spark, d):
    want = areas(spark, d).select(F.col("want_prefecture").alias("prefecture"), F.col("want_municipality").alias("municipality"))
    signed = want.select("municipality", F.lit(1).alias("n")).unionByName(people(spark, d).select("municipality", F.lit(-1).alias("n")))
    gap = A.demand_supply_gap(want, people(spark, d), HOME).join(signed.groupBy("municipality").agg(F.sum("n").alias("net")), "municipality")
    return V.identity_check(gap, F.col("gap"), F.col("net"))


@query("""SELECT 's_acctbal' AS "column", count(*) FILTER (s_acctbal NOT BETWEEN 0 AND 5000) AS bad FROM supplier UNION ALL SELECT 's_name', count(s_name) FROM supplier""", base=False)
def val12_ranges(spark, d):
    return V.out_of_range(table(spark, d, "supplier"), {"s_acctbal": (0, 5000), "s_name": (0, 1)})


@query("""SELECT *, abs(total_a - total_b) <= 0.01 AS agrees FROM (SELECT round(CAST(sum(l_quantity) AS DOUBLE), 2) AS total_a FROM lineitem), (SELECT round(CAST(sum(q) AS DOUBLE), 2) AS total_b FROM (SELECT sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey))""", base=False)
def val13_reconcile(spark, d):
    """Quantities of all line items against their sums by customer."""
    l, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    by = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("l_quantity").alias("l_quantity"))
    return rounded(V.reconcile(l, by, "l_quantity").withColumns({c: F.col(c).cast("double") for c in ("total_a", "total_b")}), 2)


_REPORTED = {"orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"), "events": ("event_id", "user_id", "event_type", "value"), "documents": ("doc_id", "text", "lang", "source")}
_NULLS = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, count(*) AS rows, count(*) - count({c}) AS nulls FROM {t}" for t, columns in _REPORTED.items() for c in columns)


@query(f"""SELECT t AS "table", c AS "column", rows, nulls, round(nulls / CAST(rows AS DOUBLE), 6) AS null_rate, CASE WHEN nulls = 0 THEN 'complete' WHEN nulls < 0.1 * rows THEN 'good' WHEN nulls < 0.3 * rows THEN 'fair' WHEN nulls < 0.7 * rows THEN 'poor' ELSE 'bad' END AS status FROM ({_NULLS})""", base=False)
def val10_overall_report(spark, d):
    return rounded(V.overall_report({t: table(spark, d, t).select(*columns) for t, columns in _REPORTED.items()}))


@query("""SELECT p.prefecture, coalesce(n, 0) AS demand_count, coalesce(s, 0) AS supply_count, coalesce(n, 0) - coalesce(s, 0) AS gap, '' AS municipality FROM (SELECT DISTINCT prefecture FROM places) p LEFT JOIN (SELECT want_prefecture AS prefecture, count(*) AS n FROM areas GROUP BY 1) USING (prefecture) LEFT JOIN (SELECT prefecture, count(*) AS s FROM people GROUP BY 1) USING (prefecture)""")
def val09_repairs(spark, d):
    want = areas(spark, d).groupBy(F.col("want_prefecture").alias("prefecture")).agg(F.count("*").alias("demand_count"))
    live = people(spark, d).groupBy("prefecture").agg(F.count("*").alias("supply_count"))
    a = core.outer_counts(want, live, ["prefecture"]).withColumn("municipality", F.lit(None).cast("string"))
    every = V.add_missing(a, places(spark, d).select("prefecture").distinct(), "prefecture").fillna(0, ["demand_count", "supply_count"])
    return V.repair(every)


@query(_WORDS + """, c AS (SELECT lang, token, count(DISTINCT doc_id) AS score FROM tokens JOIN documents USING (doc_id) GROUP BY 1, 2), h AS (SELECT *, count(*) OVER (PARTITION BY token) AS held, sum(score) OVER (PARTITION BY token) AS s FROM c)
    SELECT lang, layer, count(*) AS terms FROM (SELECT lang, CASE WHEN held > 0.5 * (SELECT count(DISTINCT lang) FROM c) THEN 'universal' WHEN held = 1 OR score >= 2.0 * (s - score) / (held - 1) THEN 'specific' ELSE 'common' END AS layer FROM h) GROUP BY 1, 2""", base=False)
def txt05_keyword_layers(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    tokens = T.tokenise(docs, ["doc_id", "lang"], "text", r"[a-zà-ÿ]+")
    scores = tokens.groupBy("lang", "token").agg(F.countDistinct("doc_id").alias("score"))
    return T.keyword_layers(scores, "lang").groupBy("lang", "layer").agg(F.count("*").alias("terms"))


@query(_WORDS + " SELECT token, count(*) AS count, count(DISTINCT doc_id) AS documents FROM tokens GROUP BY 1", base=False)
def txt01_token_counts(spark, d):
    tokens = T.tokenise(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", r"[a-zà-ÿ]+")
    return core.cross(tokens, ["token"], [F.countDistinct("doc_id").alias("documents")])


@query(f""", {_COORDINATES} SELECT person_id, coalesce(c.lat, k.lat, r.lat) AS lat, coalesce(c.lng, k.lng, r.lng) AS lng FROM people LEFT JOIN (SELECT * FROM coords WHERE lat < 30) c USING (municipality) LEFT JOIN (SELECT * FROM coords WHERE lat < 38) k USING (municipality)
    LEFT JOIN (SELECT prefecture, round(avg(lat), 6) AS lat, round(avg(lng), 6) AS lng FROM coords GROUP BY 1) r ON r.prefecture = people.prefecture""")
def joi04_lookup(spark, d):
    """Coordinates of a residence: its municipality's, else those of a cache, else the centre of its prefecture."""
    c = _coordinates(spark, d)
    centres = rounded(c.groupBy("prefecture").agg(F.avg("lat").alias("lat"), F.avg("lng").alias("lng")))
    first = G.with_coordinates(people(spark, d).select("person_id", *HOME), c.filter("lat < 30"), HOME).withColumnsRenamed({"lat": "lat1", "lng": "lng1"})
    out = G.with_coordinates(first, c.filter("lat < 38"), HOME, centres, "prefecture")
    return out.select("person_id", F.coalesce("lat1", "lat").alias("lat"), F.coalesce("lng1", "lng").alias("lng"))


@query("""SELECT urgency_rank, mobility_rank, count(*) AS count FROM (SELECT CASE WHEN s <= 2 THEN 'D' WHEN s <= 4 THEN 'C' WHEN s <= 6 THEN 'B' ELSE 'A' END AS urgency_rank, CASE WHEN m >= 0.8 THEN 'A' WHEN m >= 0.5 THEN 'B' WHEN m > 0 THEN 'C' ELSE 'D' END AS mobility_rank FROM (
    SELECT CASE WHEN n >= 10 THEN 3 WHEN n >= 5 THEN 2 WHEN n >= 2 THEN 1 ELSE 0 END + CASE WHEN q >= 3 THEN 2 WHEN q >= 1 THEN 1 ELSE 0 END + CASE WHEN l THEN 2 ELSE 0 END + CASE WHEN e IN ('BUILDING') THEN 2 ELSE 1 END AS s, o / CAST(n AS DOUBLE) AS m
    FROM (SELECT person_id, count(*) AS n, any_value(qualification_count) AS q, any_value(has_license) AS l, any_value(employment) AS e, count(*) FILTER (prefecture <> want_prefecture) AS o FROM wishes GROUP BY 1))) GROUP BY 1, 2""")
def fun51_urgency_mobility(spark, d):
    w = wishes(spark, d).groupBy("person_id").agg(F.count("*").alias("n"), F.max("qualification_count").alias("q"), F.max("has_license").alias("l"), F.max("employment").alias("e"), F.count_if(F.col("prefecture") != F.col("want_prefecture")).alias("o"))
    urgency = person.urgency_rank(person.urgency_score(F.col("n"), F.col("q"), F.col("l"), F.col("e"), ["BUILDING"]))
    return core.cross(w.select(urgency.alias("urgency_rank"), person.mobility_rank(person.mobility_score(F.col("o"), F.col("n"))).alias("mobility_rank")), ["urgency_rank", "mobility_rank"])


@query()
def srt04_sample(spark, d):
    """A repeatable sample of 100 documents of each language (a sampling operator: the limit is the feature)."""
    return core.sample_per_group(table(spark, d, "documents").select("doc_id", "lang"), ["lang"], "doc_id", 100)


@query()
def clu03_cluster_profile(spark, d):
    a = adverts(spark, d).groupBy("facility", "prefecture").agg(F.avg("salary").alias("salary"), *[F.avg(F.col(f).cast("double")).alias(f) for f in FLAGS])
    grouped = C.assign_clusters(C.fill_median(a, ["salary"], ["prefecture"]), ["salary"], list(FLAGS), ks=(3, 4), fallback=3, few=50)
    profile = C.cluster_profile(grouped, "salary", "prefecture", list(FLAGS), list(FLAGS)).join(C.cluster_labels(grouped, ["salary", *FLAGS]), "cluster")
    return rounded(profile.withColumn("cluster", F.col("cluster").cast("int")))


@query("""SELECT CASE WHEN grouping(prefecture) = 1 THEN 'nation' ELSE 'prefecture' END AS scope, prefecture, round(avg(age), 6) AS avg_age, round(avg(qualification_count), 6) AS avg_qualifications, round(avg(CASE WHEN gender = 'F' THEN 1.0 WHEN gender = 'M' THEN 0.0 END), 6) AS female, count(*) FILTER (age_group = '20s') AS "20s", count(*) FILTER (age_group = '60s') AS "60s" FROM people GROUP BY GROUPING SETS ((), (prefecture))""")
def agg62_region_comparison(spark, d):
    measures = [F.avg("age").alias("avg_age"), F.avg("qualification_count").alias("avg_qualifications"), F.avg((F.col("gender") == "F").cast("double")).alias("female"), *[F.count_if(F.col("age_group") == a).alias(a) for a in ("20s", "60s")]]
    return rounded(core.scopes(people(spark, d), {"nation": [], "prefecture": ["prefecture"]}, measures))


@query("""SELECT municipality, round(avg(demand - supply), 6) AS gap, CASE WHEN avg(demand - supply) > 0 THEN 'shortage' ELSE 'surplus' END AS kind, row_number() OVER (ORDER BY abs(avg(demand - supply)) DESC, municipality) AS rank FROM (
    SELECT municipality, count(*) AS supply FROM people GROUP BY 1) JOIN (SELECT want_municipality AS municipality, count(*) AS demand FROM areas GROUP BY 1) USING (municipality) GROUP BY 1 ORDER BY rank LIMIT 10""")
def agg61_gap_ranking(spark, d):
    want = areas(spark, d).select(F.col("want_municipality").alias("municipality"))
    gap = A.demand_supply_gap(want, people(spark, d), ["municipality"]).select("municipality", F.col("gap").cast("double").alias("gap"), F.when(F.col("gap") > 0, "shortage").otherwise("surplus").alias("kind"))
    return core.ranked(gap, [F.desc(F.abs("gap")), F.asc("municipality")], 10)


@query("SELECT gini FROM (SELECT 1) JOIN (SELECT round(2 * sum(i * c_acctbal) / (count(*) * sum(c_acctbal)) - (count(*) + 1) / CAST(count(*) AS DOUBLE), 6) AS gini FROM (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal) AS i FROM customer WHERE c_acctbal > 0)) ON true", base=False)
def sta03_gini_balance(spark, d):
    return rounded(S.gini(table(spark, d, "customer").filter("c_acctbal > 0"), [], "c_acctbal").select("gini"))


@query()
def sta01_tests(spark, d):
    """Independence of several pairs of columns with p-values and effects."""
    p = people(spark, d)
    pairs = [("gender", "age_group"), ("gender", "has_license"), ("employment", "age_group"), ("prefecture", "has_license")]
    out = core.union_tables(*[S.chi_square_test(p, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "*") for a, b in pairs])
    return rounded(out)


@query()
def sta02_tests(spark, d):
    a = adverts(spark, d)
    return rounded(core.union_tables(*[S.anova_test(a, g, "salary").select(F.lit(g).alias("group"), "*") for g in ("job_type", "employment", "prefecture")]))


@query(f", {_COORDINATES}, w AS (SELECT person_id, lat, lng FROM areas JOIN coords ON municipality = want_municipality), u AS (SELECT DISTINCT * FROM w), far AS (SELECT a.person_id, max(sqrt(pow(a.lat - b.lat, 2) + pow(a.lng - b.lng, 2)) * 111) AS m FROM u a JOIN u b USING (person_id) GROUP BY 1)" + """
    SELECT person_id, places, round(s, 4) AS spread_score, CASE WHEN s >= 70 THEN 'A' WHEN s >= 40 THEN 'B' WHEN s >= 10 THEN 'C' ELSE 'D' END AS spread_band
    FROM (SELECT person_id, (SELECT count(*) FROM u WHERE u.person_id = w.person_id) AS places, least(100.0, (stddev_pop(lat) + stddev_pop(lng)) / 2 * 50 + any_value(m) * 0.3) AS s FROM w JOIN far USING (person_id) GROUP BY 1)""")
def fun50_spread_score(spark, d):
    c = _coordinates(spark, d).select(F.col("municipality").alias("want_municipality"), "lat", "lng")
    return rounded(G.spread_score(areas(spark, d).join(c, "want_municipality"), "person_id"), 4)


@query()
def val04_table_quality(spark, d):
    return rounded(V.table_quality(people(spark, d), ["gender", "age_group", "municipality"], [("gender", "age_group"), ("municipality", "age_group")]))


@query("SELECT round(avg(n), 6) AS avg_score, max(n) AS max_score, arg_max(municipality, (n, municipality)) AS max_level FROM (SELECT municipality, count(*) AS n FROM people GROUP BY 1)")
def val17_difficulty_summary(spark, d):
    return rounded(V.difficulty_summary(core.cross(people(spark, d), ["municipality"]), "count", "municipality"))
