"""Segments by k-means, with profiles and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, RobustScaler, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shokuba.operators.core import cross, mode, with_share
from shokuba.operators.stats import percentiles
from shokuba.sources.scratch import cut_lineage


def fill_median(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Nulls become the median of their group, else of all rows, else 0."""
    out = df
    for c in columns:
        every, group = percentiles(df, [], c, (0.5,)).select(F.col("q")[0].alias(f"_a_{c}")), percentiles(df, by, c, (0.5,)).select(*by, F.col("q")[0].alias(f"_g_{c}"))
        out = out.join(group, list(by), "left").join(F.broadcast(every), F.lit(True), "left")  # every is one row
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), f"_g_{c}", f"_a_{c}", F.lit(0.0)) for c in columns}).drop(*[f"_{x}_{c}" for c in columns for x in "ag"])


def assign_clusters(df: DataFrame, features: Sequence[str], flags: Sequence[str] = (), ks: Sequence[int] = (3, 4, 5, 6, 7), components: int = 4, scaling: str = "robust", least: float = 0.1, fallback: int = 4, few: int = 100, seed: int = 42) -> DataFrame:
    """`df` with a column cluster: k-means over scaled features and the first components of the flags.

    k is that of `ks` with the best silhouette, or `fallback` if none reaches `least`; fewer than `few` rows are one
    cluster. Features must have no nulls (fill_median). The models are fitted and applied by Spark ML.
    """
    if df.count() < few:
        return df.withColumn("cluster", F.lit(0))
    drop = ["_x", "_s", "_v"]
    out = VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)
    scaler = RobustScaler(inputCol="_x", outputCol="_s", withCentering=True) if scaling == "robust" else StandardScaler(inputCol="_x", outputCol="_s", withMean=True)
    out = scaler.fit(out).transform(out)
    parts = ["_s"]
    if flags:
        out = VectorAssembler(inputCols=list(flags), outputCol="_f").transform(out)
        out = PCA(k=min(components, len(flags)), inputCol="_f", outputCol="_p").fit(out).transform(out)
        parts, drop = [*parts, "_p"], [*drop, "_f", "_p"]
    out = cut_lineage(VectorAssembler(inputCols=parts, outputCol="_v").transform(out))  # every fit reads it
    judge = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster")
    models = {k: KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(out) for k in dict.fromkeys([*ks, fallback])}
    scores = {k: judge.evaluate(models[k].transform(out)) if models[k].summary.k > 1 else -1.0 for k in ks}
    best = max(ks, key=lambda k: (scores[k], -k))
    return models[best if scores[best] >= least else fallback].transform(out).drop(*drop)


def cluster_profile(df: DataFrame, value: str, kind: str, features: Sequence[str], flags: Sequence[str] = (), top: int = 5) -> DataFrame:
    """Per cluster: size, share, mean and median of a value, dominant kind, feature means as JSON, and as JSON the `top`
    flags with the highest rates."""
    out = df.groupBy("cluster").agg(
        F.count("*").alias("count"), F.avg(value).alias("avg_value"), mode(kind).alias("dominant"),
        F.to_json(F.struct(*[F.avg(f).alias(f) for f in features])).alias("means"),
        F.array(*[F.struct(F.avg(F.col(f).cast("double")).alias("rate"), F.lit(f).alias("flag")) for f in flags]).alias("top_flags"),
    )
    median = percentiles(df, ["cluster"], value, (0.5,)).select("cluster", F.col("q")[0].alias("median_value"))
    out = out.join(median, "cluster", "left")
    out = out.withColumn("top_flags", F.to_json(F.slice(F.sort_array("top_flags", False), 1, top))) if flags else out.drop("top_flags")
    return with_share(out, "count", [])


def cluster_labels(df: DataFrame, features: Sequence[str], top: int = 3) -> DataFrame:
    """Name of each cluster from the features whose mean lies farthest from that of all rows, in deviations of all
    rows; equal names get a number."""
    total = df.agg(*[f(c).alias(f"{n}{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    part = df.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in features]).join(F.broadcast(total), F.lit(True))  # one row
    z = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"m{c}"), F.col(f"s{c}")), F.lit(0.0)) for c in features}
    far = F.slice(F.sort_array(F.array(*[F.struct(F.abs(v).alias("far"), F.concat(F.when(v >= 0, "high ").otherwise("low "), F.lit(c)).alias("name")) for c, v in z.items()]), False), 1, top)
    named = part.select("cluster", F.array_join(F.transform(far, lambda x: x["name"]), ", ").alias("name"))
    n = F.row_number().over(Window.partitionBy("name").orderBy("cluster"))
    return named.withColumn("_n", n).select("cluster", F.when(F.col("_n") > 1, F.concat("name", F.lit(" "), F.col("_n").cast("string"))).otherwise(F.col("name")).alias("label"))


def region_heat(df: DataFrame, region: str) -> DataFrame:
    """Share of each cluster in each region, its share of all rows, and the difference."""
    cells = cross(df, [region, "cluster"], within=[region])
    total = cross(df, ["cluster"], within=()).select("cluster", F.col("share_pct").alias("national_pct"))
    return cells.join(total, "cluster").withColumn("deviation", F.col("share_pct") - F.col("national_pct"))


def segment_names(df: DataFrame, age: str, areas: str) -> DataFrame:
    """Per cluster: size, share, mean age and area count, and a name by both."""
    out = with_share(df.groupBy("cluster").agg(F.count("*").alias("count"), F.avg(age).alias("avg_age"), F.avg(areas).alias("avg_areas")), "count", [])
    young = F.when(F.col("avg_age") < 30, "young").when(F.col("avg_age") < 45, "middle").when(F.col("avg_age") < 60, "older").otherwise("senior")
    wide = F.when(F.col("avg_areas") >= 10, "wide").when(F.col("avg_areas") >= 4, "several").otherwise("local")
    return out.withColumn("name", F.concat_ws(" ", young, wide)).withColumn("cluster", F.col("cluster").cast("int"))


def place_ratios(adverts: DataFrame, place: str, pay: str, shares: dict[str, Column], least: int = 10) -> DataFrame:
    """Per place with at least `least` adverts: their number, mean pay, and the share of adverts for which each condition
    of `shares` holds (a null counts as not)."""
    rates = [F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in shares.items()]
    out = adverts.filter(F.col(place).isNotNull()).groupBy(place).agg(F.count("*").alias("job_count"), F.avg(pay).alias("avg_salary"), *rates)
    return out.filter(F.col("job_count") >= least)


def ratio_labels(df: DataFrame, features: Sequence[str], lead: str) -> DataFrame:
    """Per cluster of places: size, centre, and a label against the mean of all centres: many or few adverts (beyond 1.5
    and 0.5 of it), high or low pay (1.05, 0.95), much of the share `lead` (1.2); else the standard kind."""
    centres = df.groupBy("cluster").agg(F.count("*").alias("size"), *[F.avg(f).alias(f) for f in features])
    judged = list(dict.fromkeys(["job_count", "avg_salary", lead]))
    whole = centres.agg(*[F.avg(f).alias(f"_{f}") for f in judged])
    out = centres.join(F.broadcast(whole), F.lit(True))  # one row

    def beyond(name: str, high: float, low: float | None, above: str, below: str = "") -> Column:
        label = F.when(F.col(name) > F.col(f"_{name}") * high, above)
        return label if low is None else label.when(F.col(name) < F.col(f"_{name}") * low, below)

    # The labels.
    parts = F.concat_ws("・", beyond("job_count", 1.5, 0.5, "大都市圏", "地方"), beyond("avg_salary", 1.05, 0.95, "高給与", "低給与"), beyond(lead, 1.2, None, "介護中心"))
    return out.withColumn("label", F.coalesce(F.nullif(parts, F.lit("")), F.lit("標準型"))).drop(*[f"_{f}" for f in judged])
