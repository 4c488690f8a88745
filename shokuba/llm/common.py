"""Helpers that several text operators share: scratch tables, heavy keys, connected components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and normalisation rules, as a class for Java's and DuckDB's regular expressions.
SPACE = r"[\x20\x09-\x0D]"

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this application under spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing (local tests) a temporary folder of this machine takes its place; a cluster
    without the setting is refused, because its executors would write where the driver can't read.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(spark, "_shokuba_scratch", None) or tempfile.mkdtemp(prefix="spark-")
        spark._shokuba_scratch = base
    return f"{base.rstrip('/')}/shokuba-{sc.applicationId}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet in the scratch folder and read it back.

    This cuts the lineage: a lost executor costs its running tasks, and what is staged is never computed again.
    Shuffle files of the write are removed when it ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables; results that were not yet written can't be read afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def join_by_heavy(left: DataFrame, right: DataFrame, on: list[str], weight: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """Join `left` to `right`, whose rows are unique by `on` and say in `weight` how many rows of `left` they meet.

    Keys that hold more than 1/share of all rows are fewer than `share`, whatever the data, so they are broadcast;
    all others meet by shuffle. No key can then fill a task. how: inner or left. `left` is read twice: stage it.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    heavy = F.broadcast(right.filter(F.col(weight) > total / share))
    light = right.filter(F.col(weight) <= total / share)
    return left.join(heavy, on, "inner").unionByName(left.join(heavy.select(*on), on, "left_anti").join(light, on, how))


def components(edges: DataFrame, name: str = "links", rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (u, v: long): columns node, component (the smallest node reached).

    Alternating large-star and small-star steps; every step is two shuffles over the remaining links, keeps one row
    per node and hub, and is staged, so the plan never grows. Loops and repeated links are ignored.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            hub = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            return both.join(hub, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        hub = down.groupBy("u").agg(F.min("v").alias("m"))
        rest = down.join(hub, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return rest.union(hub.select("u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame) -> tuple:
        row = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    now = stage(edges.select("u", "v").filter("u <> v").distinct(), name)
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        now = stage(star(star(now, True), False), name)
        if (new := mark(now)) == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    hubs = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(hubs)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
