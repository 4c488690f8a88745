"""What keeps a task's memory and the work on repeated rows from growing with a table."""

import pytest
from pyspark.sql import functions as F

from shokuba.operators import core
from shokuba.operators import postings as P
from shokuba.operators import stats as S


def test_rows_are_dealt_into_parts_of_bounded_size(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert core.dealt(df, 1000, "k", most=100).rdd.getNumPartitions() == 10
    assert core.dealt(df, 300, "k", most=100) is df  # the session's 4 parts are enough


def test_counted_rows_give_the_shares_of_all_rows(spark):
    df = spark.createDataFrame([("p", "x", True), ("p", "x", True), ("p", "y", False), ("q", "y", None)], "place string, kind string, flag boolean")
    few = core.counted(df, "place", "kind", "flag")
    assert few.count() == 3

    def rows(x):
        return sorted(map(str, x.select(*sorted(x.columns)).collect()))

    assert rows(P.flag_frequency(few, ["flag"], ["place"], "count")) == rows(P.flag_frequency(df, ["flag"], ["place"]))
    assert rows(P.axis_shares(few, ["kind"], {"place": ["place"]}, 1, "count")) == rows(P.axis_shares(df, ["kind"], {"place": ["place"]}, 1))


def test_weighted_percentiles_are_those_of_all_rows(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 1.0, 4.0, 9.0, 9.0)] + [("b", 2.0)], "g string, v double")
    few = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    want = {r["g"]: r["q"] for r in S.percentiles(df, ["g"], "v", (0.25, 0.5, 0.9)).collect()}
    assert {r["g"]: r["q"] for r in S.percentiles(few, ["g"], "v", (0.25, 0.5, 0.9), weight="n").collect()} == want
    assert want["a"][1] == 2.5


@pytest.mark.parametrize("weight", [None, "n"])
def test_narrowed_percentiles_are_those_of_all_rows(spark, weight):
    """Wide and narrow values, equal ones, signs, zeros, infinite ones and NaN, nulls, groups of one row."""
    inf, nan = float("inf"), float("nan")
    values = {"a": [1e9 + i % 7 for i in range(50)], "b": [-3.5, -1e-300, 0.0, -0.0, 2.0, 1e300, None], "c": [4.0], "d": [-inf, 1.0, inf, inf, nan, nan], "e": [float(2**i) for i in range(-30, 30)], "f": [None]}
    df = spark.createDataFrame([(g, v, i % 3 + 1) for g, vs in values.items() for i, v in enumerate(vs)] + [(None, 1.0, 1)], "g string, v double, n long").repartition(3)
    points = (0.0, 0.25, 0.5, 0.9, 1.0)
    want = sorted(map(str, S.percentiles(df, ["g"], "v", points, weight=weight).collect()))
    assert sorted(map(str, S.narrowed_percentiles(df, ["g"], "v", points, weight=weight).collect())) == want and len(want) == 5
    assert str(S.narrowed_percentiles(df, [], "v", points, weight=weight).collect()) == str(S.percentiles(df, [], "v", points, weight=weight).collect())


def test_medians_put_few_rows_in_order(spark, monkeypatch):
    """Salary tables order only the values near a median, and write rows without grouping them."""
    df = spark.range(8000).select(F.lit("x").alias("job"), (F.col("id") % 2).cast("string").alias("place"), (1000 + F.col("id") * 3.5).alias("low"), (2000 + F.col("id") * 4.5).alias("high"))
    seen, places = [], S.places
    monkeypatch.setattr(S, "places", lambda d, *a, **b: seen.append(d.count()) or places(d, *a, **b))
    got = P.salary_stats(df, "low", "high", {"job": ["job"], "place": ["job", "place"]}).collect()
    assert [(r["n"], r["mean_low"], r["median_low"], r["mean_high"], r["median_high"]) for r in got if r["scope"] == "job"] == [(8000, 14998, 14998, 19997, 19997)]
    assert len(seen) == 4 and max(seen) < 200
