"""Operators and column functions on small tables with known results."""

import math

import pytest
from pyspark.sql import functions as F

from shokuba.functions import people as P
from shokuba.functions import postings as J
from shokuba.operators import applicants as A
from shokuba.operators import clusters as C
from shokuba.operators import core, quality, stats
from shokuba.operators import flows as G
from shokuba.operators import postings as PO
from shokuba.sources import readers, writers


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_age_gender_and_region(spark):
    rows = [("４９歳　女性",), ("18歳 男性",), (None,), ("不明",)]
    assert values(spark, rows, "s string", *P.age_gender(F.col("s"))) == [(49, "女性"), (18, "男性"), (None, None), (None, None)]
    rows = [("京都府京都市上京区",), ("東京都府中市",), ("北海道",), ("府中市",), (None,)]
    assert values(spark, rows, "s string", *P.region(F.col("s"))) == [("京都府", "京都市上京区"), ("東京都", "府中市"), ("北海道", None), (None, None), (None, None)]
    assert len(P.PREFECTURES) == 47


def test_desired_areas_repeat_and_cap(spark):
    rows = [("奈良県奈良市,京都府木津川市,奈良県奈良市,どこか",), (None,), (",".join(["奈良県奈良市"] * 60),)]
    got = values(spark, rows, "s string", F.size(P.desired_areas(F.col("s"))))
    assert got == [(3,), (0,), (50,)]


def test_qualifications_and_career(spark):
    rows = [("介護福祉士,自動車運転免許,なし",), ("介護福祉士看護師",), ("看護師(取得予定)",), (None,)]
    got = values(spark, rows, "s string", P.qualifications(F.col("s"), ["介護福祉士", "看護師"]))
    assert got == [(["介護福祉士", "自動車運転免許"],), (["介護福祉士", "看護師"],), ([],), ([],)]
    rows = [("○○科(高等学校)(2016年3月卒業)、△△科(大学)(2020年3月卒業)",), ("1890年",), (None,)]
    assert values(spark, rows, "s string", P.graduation_year(F.col("s"))) == [(2020,), (None,), (None,)]


def test_urgency_and_mobility(spark):
    got = values(spark, [(0, 0, False, "x"), (10, 3, True, "now"), (None, 0, False, "x")], "a int, q int, l boolean, s string", P.urgency_score(F.col("a"), F.col("q"), F.col("l"), F.col("s"), ["now"]))
    assert got == [(1,), (9,), (1,)]
    got = values(spark, [(0, 0), (1, 2), (4, 5)], "o int, n int", P.mobility_rank(P.mobility_score(F.col("o"), F.col("n"))))
    assert got == [("D",), ("B",), ("A",)]


def test_posting_texts(spark):
    rows = [("月給 210,000円",), ("月給２５万円",), ("応相談",), (None,)]
    assert values(spark, rows, "s string", J.base_salary(F.col("s"))) == [(210000,), (250000,), (None,), (None,)]
    rows = [("9:00～18:00",), ("17:00~翌9:00",), ("17:00〜9:00 夜勤なし",)]
    got = values(spark, rows, "s string", J.working_hours(F.col("s")))
    assert [(g[0].starts, g[0].ends, g[0].night) for g in got] == [([9], [18], False), ([17], [33], True), ([17], [33], False)]
    assert values(spark, [("年間休日120日",), ("休日",)], "s string", J.annual_holidays(F.col("s"))) == [(120,), (None,)]
    assert values(spark, [("不安定 安定 安定",)], "s string", J.signal_score(F.col("s"), {"安定": 2})) == [(4,)]
    long = "x" * 60
    got = values(spark, [(f"法定事項\n短い\n{long}",)], "s string", J.original_share(F.col("s"), "法定"))
    assert math.isclose(got[0][0], 60 / 66)
    assert math.isclose(values(spark, [("abab",)], "s string", J.char_entropy(F.col("s")))[0][0], 1.0)
    assert values(spark, [(1, 1), (0, 2)], "a int, b int", J.best_of({"x": F.col("a"), "y": F.col("b")})) == [("x",), ("y",)]


def test_tier_label_first_best_wins(spark):
    scores = {"A": {"new": F.col("a"), "old": F.col("b")}, "B": {"day": F.col("b"), "night": F.col("a")}}
    got = values(spark, [(2, 1), (1, 2), (1, 1)], "a int, b int", J.tier_label(scores, [("fresh", {"A": "new", "B": "night"})], 0.8))
    assert got == [("fresh",), ("old×day",), ("new×day",)]


def test_gap_zero_supply_and_null_places(spark):
    d = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "p string")
    s = spark.createDataFrame([("a",), ("c",)], "p string")
    got = {r.p: (r.demand_count, r.supply_count, r.demand_supply_ratio, r.gap) for r in A.demand_supply_gap(d, s, ["p"], 0).collect()}
    assert got == {"a": (2, 1, 2.0, 1), "b": (1, 0, 0.0, 1), "c": (0, 1, 0.0, -1)}


def test_flow_invariants(spark):
    e = spark.createDataFrame([(1, "a", "b"), (1, "a", "b"), (2, "b", "c")], "person_id int, o string, d string")
    nodes = G.flow_nodes(e, "person_id", "o", "d").collect()
    assert sum(n.inflow for n in nodes) == sum(n.outflow for n in nodes) == 3 and sum(n.net_flow for n in nodes) == 0


def test_graph_measures(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    assert all(math.isclose(r.pagerank, 1 / 3, abs_tol=1e-6) for r in G.page_rank(edges, nodes).collect())
    assert {r.node: r.betweenness for r in G.betweenness_centrality(edges, nodes).collect()} == {"a": 0.5, "b": 0.5, "c": 0.5}
    assert all(math.isclose(r.closeness, 2 / 3) for r in G.closeness_centrality(edges, nodes).collect())
    path = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0)], "src string, dst string, weight double")
    assert {r.node: r.betweenness for r in G.betweenness_centrality(path, nodes).collect()} == {"a": 0.0, "b": 0.5, "c": 0.0}


def test_yates_and_p_values(spark):
    df = spark.createDataFrame([("x", "u")] * 10 + [("x", "v")] * 20 + [("y", "u")] * 30 + [("y", "v")] * 10, "a string, b string")
    r = stats.chi_square(df, "a", "b").first()
    want = sum((abs(o - e) - 0.5) ** 2 / e for o, e in ((10, 30 * 40 / 70), (20, 30 * 30 / 70), (30, 40 * 40 / 70), (10, 40 * 30 / 70)))
    assert r.dof == 1 and math.isclose(r.chi_square, want)
    assert math.isclose(stats.chi_square_p(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(stats.anova_p(4.0, 2, 10), 1.8**-5, rel_tol=1e-9)
    assert math.isclose(stats.chi_square_p(r.chi_square, 1), math.erfc(math.sqrt(r.chi_square / 2)), rel_tol=1e-9)


def test_gini_with_ties_and_few(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [1, 1, 2, 2, 2, 3, 5, 8, 8, 9]] + [("b", 1.0)], "g string, v double")
    got = {r.g: r.gini for r in stats.gini(df, ["g"], "v").collect()}
    x = sorted([1, 1, 2, 2, 2, 3, 5, 8, 8, 9])
    assert math.isclose(got["a"], 2 * sum((i + 1) * v for i, v in enumerate(x)) / (10 * sum(x)) - 11 / 10) and got["b"] is None


def test_suppression_shares_and_bands(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [(None,)], "g string")
    assert [(r.g, r["count"], round(r.share_pct, 4)) for r in core.cross(df, ["g"], min_count=5, within=()).collect()] == [("a", 5, 55.5556)]
    assert values(spark, [(29,), (30,), (70,), (None,)], "a int", P.age_decade("a")) == [("20s",), ("30s",), ("70+",), (None,)]


def test_quality_checks(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    assert [r.k for r in quality.orphans(child, spark.createDataFrame([(1,)], "k int"), "k").collect()] == [2]
    bad = quality.out_of_range(spark.createDataFrame([("35.0",), ("99",), ("x",), (None,)], "lat string"), {"lat": (20, 46)}).first()
    assert bad.bad == 2
    assert quality.null_report(spark.createDataFrame([], "a int")).first().rows == 0
    assert quality.repair(spark.createDataFrame([(3, 1, None)], "demand_count int, supply_count int, municipality string")).first() == (3, 1, "", 2)


def test_clusters_few_rows_and_labels(spark):
    df = spark.createDataFrame([(float(i % 2) * 10 + i * 1e-3, float(i)) for i in range(120)], "x double, y double")
    assert C.assign_clusters(df.limit(5), ["x"]).select("cluster").distinct().collect() == [(0,)]
    out = C.assign_clusters(df, ["x"], ks=(2, 3), fallback=2)
    assert out.select("cluster").distinct().count() == 2
    assert C.cluster_labels(out, ["x", "y"]).count() == 2


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "classified_nurse_20250101.csv").write_text('﻿a,b\n1,"x\ny"\n', encoding="utf-8")
    (tmp_path / "classified_nurse_20250201.csv").write_text('a,b\n2,\n', encoding="utf-8")
    (tmp_path / "classified_sample_20260101.csv").write_text("a,b\n9,z\n", encoding="utf-8")
    one = readers.read_csv(spark, str(tmp_path / "classified_nurse_20250101.csv"), multiline=True)
    assert [tuple(r) for r in one.collect()] == [("1", "x\ny")]
    got = readers.latest_snapshots(spark, str(tmp_path / "classified_*.csv"))
    assert [(r.key, r.snapshot, r.a) for r in got.collect()] == [("nurse", "20250201", "2")]
    folder = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    writers.replace_by_key(df, folder, "k")
    writers.replace_by_key(spark.createDataFrame([("b", 3)], "k string, v int"), folder, "k")
    assert sorted((r.k, r.v) for r in spark.read.parquet(folder).collect()) == [("a", 1), ("b", 3)]
    merged = writers.merge_last_wins([df, spark.createDataFrame([("b", 9)], "k string, v int")], ["k"], ["v"])
    assert sorted((r.k, r.v) for r in merged.collect()) == [("a", 1), ("b", 9)]
    words = readers.synonym_table(spark.createDataFrame([("q", "A", "x|y")], "domain string, canonical string, synonyms string"), spark.createDataFrame([("q", "B", "y")], "domain string, canonical string, synonyms string"))
    assert {r.token: r.canonical for r in words.collect()} == {"A": "A", "x": "A", "y": "B", "B": "B"}
    assert readers.query(spark, "select k from t where v > :least", {"least": 1}, t=df).collect() == [("b",)]


def test_geocodes_keep_best(spark, tmp_path):
    (tmp_path / "g.txt").write_bytes('京都府京都市,"a","35.0","135.0","3","8"\n京都府京都市,"b","36.0","136.0","5","8"\n東京都,"c","1","2","0","1"\n'.encode("iso-2022-jp"))
    got = readers.read_geocodes(spark, str(tmp_path / "g.txt")).collect()
    assert [(r.address, r.lat, r.confidence) for r in got] == [("京都府京都市", 36.0, 5)]


def test_coverage_and_combinations(spark):
    found = spark.createDataFrame([("a",)] * 9, "k string")
    got = PO.coverage(found, spark.createDataFrame([("a", 10), ("b", 2)], "k string, expected int"), "k").collect()
    assert {r.k: (r.found, r.missing, r.short) for r in got} == {"a": (9, 1, True), "b": (0, 2, True)}
    tags = spark.createDataFrame([("p", ["b", "a"]), ("p", ["a", "b", "a"]), ("p", ["a"]), ("p", None)], "g string, t array<string>")
    assert [(r.combination, r["count"]) for r in PO.tag_combinations(tags, "t", ["g"]).collect()] == [("a+b", 2)]


def test_pairs_of_one_person_are_bounded(spark):
    rows = [(1, "x", "r"), (1, "y", "r"), (1, "x", "r"), (2, "x", "r")]
    got = A.area_pairs(spark.createDataFrame(rows, "p int, place string, region string"), "p", "place", "region").collect()
    assert [(r.p, r.place1, r.place2) for r in got] == [(1, "x", "y")]


def test_unknown_encoding_is_refused(spark):
    with pytest.raises(ValueError):
        readers.read_csv(spark, "x.csv", encoding="latin-9")


def test_advert_dictionaries(spark):
    rows = [("未経験歓迎、駅から徒歩3分。賞与あり",), ("完全週休二日制 4週8休",), (None,)]
    got = values(spark, rows, "s string", J.advert_tags(F.col("s")), J.benefit_score(F.col("s")), J.holiday_pattern(F.col("s")))
    assert got[0] == (["未経験可", "駅近"], 1, "その他")
    assert got[1] == (["4週8休以上", "完全週休2日"], 0, "完全週休2日") and got[2] == ([], 0, None)
    rows = [("夜勤専従",), ("日勤のみ",), ("日勤のみ(夜勤あり)9:00-18:00",), ("9:00〜18:00",), ("9:00〜18:00 13:00〜22:00",), ("",), ("夜勤あり\n日勤のみ可",), ("日勤のみ可\n夜勤あり",), ("日勤のみ 夜勤なし",)]
    assert [v[0] for v in values(spark, rows, "s string", J.shift_type(F.col("s")))] == ["夜勤専従", "日勤のみ", "固定時間", "固定時間", "シフト制", "不明", "不明", "不明", "日勤のみ"]
    assert values(spark, [(9, 18), (None, 22), (3, 10)], "a int, b int", *J.hour_bands(F.col("a"), F.col("b"))) == [("午前(9-11時)", "夕方(17-19時)"), ("不明", "深夜(21時以降)"), ("不明", "不明")]
    got = values(spark, [("若手 学生",), ("シニア",), ("なし",)], "s string", J.age_signals(F.col("s"), {"20代": ["若手", "学生"], "60代": ["シニア"]}))
    assert [(g[0].primary, g[0].all) for g in got] == [("20代", ["20代"]), ("60代", ["60代"]), (None, [])]


def test_percentiles_of_large_and_small_groups(spark):
    rows = [("a", float(i * 7 % 1000)) for i in range(1000)] + [("b", 1.0), ("b", 2.0), ("c", 5.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: [round(x, 9) for x in r.q] for r in stats.percentiles(df, ["g"], "v", (0.0, 0.25, 0.5, 1.0)).collect()}
    assert got == {"a": [0.0, 249.75, 499.5, 999.0], "b": [1.0, 1.25, 1.5, 2.0], "c": [5.0] * 4}
    assert stats.percentiles(df.filter("false"), ["g"], "v", (0.5,)).count() == 0


def test_axis_shares_add_up_by_axis(spark):
    df = spark.createDataFrame([("x", "u")] * 6 + [("y", None)] * 4, "a string, b string")
    got = {(r.axis, r.category): (r["count"], r.total, r.share_pct) for r in PO.axis_shares(df, ["a", "b"], {"nation": []}).collect()}
    assert got == {("a", "x"): (6, 10, 60.0), ("a", "y"): (4, 10, 40.0), ("b", "u"): (6, 6, 100.0)}


def test_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("p", "b"), ("p", "a")], "place string, kind string")
    assert A.diversity(df, ["place"], "kind").first().dominant == "a"
    assert stats.entropy(df, ["place"], "kind").first().dominant == "a"


def test_pair_npmi_against_plain_counts(spark):
    import random
    from collections import Counter
    from itertools import combinations

    from shokuba.operators.textmining import pair_npmi, with_bigrams

    rng = random.Random(3)
    rows = [(g, d, w) for g in "xy" for d in range(60) for w in rng.choices("abcdefghijklmnop", weights=range(1, 17), k=8)]
    got = {(r.g, r.word_a, r.word_b): (r.pair_count, round(r.npmi, 9)) for r in pair_npmi(spark.createDataFrame(rows, "g string, d int, token string"), "d", ["g"], least=0.05).collect()}
    want = {}
    for g in "xy":
        held = {d: sorted({w for a, b, w in rows if (a, b) == (g, d)}) for d in range(60)}
        df = Counter(w for ws in held.values() for w in ws)
        pairs = Counter(p for ws in held.values() for p in combinations(ws, 2))
        for (a, b), c in pairs.items():
            if min(df[a], df[b]) >= 5 and c >= 5:
                npmi = math.log2(c * 60 / (df[a] * df[b])) / -math.log2(c / 60) if c < 60 else 1.0
                if npmi >= 0.05:
                    want[g, a, b] = (c, round(npmi, 9))
    assert got == want
    tokens = spark.createDataFrame([(1, 0, "a"), (1, 2, "b"), (1, 3, "c"), (2, 0, "z")], "d int, position int, token string")
    assert sorted(r.token for r in with_bigrams(tokens, ["d"]).collect()) == ["a", "a b", "b", "b c", "c", "z"]
