"""Neighbours of places, clusters by ratios, and texts in compatibility composition."""

import random
import re
import sys
import unicodedata

from pyspark.sql import functions as F

from shokuba.functions import neighbours as N
from shokuba.functions import people as person
from shokuba.operators import clusters as C
from shokuba.operators import flows as G


def test_borders_are_mutual():
    pairs = set(N.pairs(N.BORDERS))
    assert list(N.BORDERS) == sorted(person.PREFECTURES, key=person.PREFECTURES.index) and pairs == {(b, a) for a, b in pairs}
    assert {x for p in N.pairs(N.CATCHMENTS) for x in p} <= set(person.PREFECTURES)


def test_drawn_counts_one_way(spark):
    edges = spark.createDataFrame([("a", "a", 1), ("a", "b", 2), ("b", "a", 3), ("c", "a", 4), ("a", "c", 5), (None, "a", 6)], "o string, d string, n int")
    near, drawn = spark.createDataFrame([("a", "b")], "src string, dst string"), spark.createDataFrame([("c", "a")], "src string, dst string")
    assert sorted(r.n for r in G.realistic(edges, "o", "d", near, drawn).collect()) == [1, 2, 3, 4]
    assert sorted(r.n for r in G.realistic(edges, "o", "d", near).collect()) == [1, 2, 3]


def test_steps_match_a_plain_search(spark):
    near = {k: set(v.split()) for k, v in N.BORDERS.items()}
    for steps in (1, 3):
        want = set()
        for start in near:
            seen, front = {start}, {start}
            for i in range(1, steps + 1):
                front = {y for x in front for y in near[x]} - seen
                seen |= front
                want |= {(start, y, i) for y in front}
        assert {tuple(r) for r in G.within_steps(N.borders(spark), steps).collect()} == want


def test_neighbour_ranks(spark):
    t = spark.createDataFrame([("a", 5), ("b", 5), ("c", 9), ("d", 1)], "place string, v int")
    near = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), ("c", "a"), ("a", "x")], "src string, dst string")
    got = {r.place: (r.neighbours, r.neighbour_mean, r["rank"], r.deviation) for r in G.neighbour_ranks(t, "place", "v", near).collect()}
    assert got == {"a": (2, 7.0, 2, -2.0), "b": (1, 5.0, 1, 0.0), "c": (1, 5.0, 1, 4.0), "d": (0, None, 1, None)}


def test_ratios_and_labels(spark):
    a = spark.createDataFrame([("x", 10.0, True)] * 6 + [("x", 20.0, None)] * 6 + [("y", 10.0, False)] * 3 + [(None, 1.0, True)] * 20, "p string, pay double, care boolean")
    assert [tuple(r) for r in C.place_ratios(a, "p", "pay", {"care": F.col("care")}).collect()] == [("x", 12, 15.0, 0.5)]
    df = spark.createDataFrame([(0, 100.0, 10.0, 0.5), (1, 10.0, 12.0, 0.1), (2, 55.0, 11.0, 0.3)], "cluster int, job_count double, avg_salary double, care double")
    got = {r.cluster: r.label for r in C.ratio_labels(df, ["job_count", "avg_salary", "care"], "care").collect()}
    assert got == {0: "大都市圏・低給与・介護中心", 1: "地方・高給与", 2: "標準型"}


def test_nfkc_of_all_characters(spark):
    rows = [(i, chr(i)) for i in range(1, sys.maxunicode + 1) if not 0xD800 <= i <= 0xDFFF and unicodedata.category(chr(i)) != "Cn"]
    rng = random.Random(1)
    signs = "かがｶﾞﾊﾟ①㍿ Ạ̊̊́éé가각각ﬁ　Ａ゙゚①ͅẛ"
    rows += [(-i, "".join(rng.choices(signs, k=rng.randint(0, 12)))) for i in range(1, 3000)]
    got = spark.createDataFrame(rows, "i int, s string").repartition(4).filter(~person.nfkc(F.col("s")).eqNullSafe(F.lit("\0"))).select("i", person.nfkc(F.col("s")).alias("n")).collect()
    want = {i: unicodedata.normalize("NFKC", s) for i, s in rows}
    assert {r.i: r.n for r in got} == want


def test_tokens(spark):
    texts = ["看護師、介護士／ 保育士", "ＡＢＣ，ｶﾞｲﾄﾞ|x/ /y", "", None, " 　 ", "a·b‧c∙d", "、、", "one", "a , b\n", "x" + " " * 50000 + "y,z"]

    def plain(s):
        t = unicodedata.normalize("NFKC", s or "")
        return [x.strip() for x in re.split(r"[、，,|／/・·‧∙]+", t) if x.strip()]

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", person.tokens(F.col("t")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: plain(t) for i, t in enumerate(texts)}
