"""The driver's tables in the shape of the operators: people, areas they want, adverts; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shokuba.functions.people import age_decade
from shokuba.operators.core import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation_key, prefecture, municipality: 25 rows of a fixed dimension."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("nation_key"), F.col("r_name").alias("prefecture"), F.col("n_name").alias("municipality"))


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").join(places(spark, sf_dir), F.col("c_nationkey") == F.col("nation_key"))
    c = c.select(
        k.alias("person_id"), (18 + k % 60).cast("int").alias("age"),
        F.when(k % 7 == 0, None).when(k % 2 == 0, "F").otherwise("M").alias("gender"),
        "prefecture", "municipality", F.col("c_mktsegment").alias("employment"), (k % 4).cast("int").alias("qualification_count"),
        (F.col("c_acctbal") > 5000).alias("has_license"), (F.col("c_acctbal") < 1000).alias("urgent"),
    )
    return c.withColumn("age_group", age_decade("age"))


def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: the place of its supplier is wanted by the order's customer."""
    o, l, s = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "supplier"))
    out = l.select("l_orderkey", "l_suppkey").join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    out = out.join(o.select("o_orderkey", "o_custkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey")).join(places(spark, sf_dir), F.col("s_nationkey") == F.col("nation_key"))
    return out.select(F.col("o_custkey").alias("person_id"), F.col("prefecture").alias("want_prefecture"), F.col("municipality").alias("want_municipality"), F.col("o_orderpriority").alias("urgency"))


def wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").count()  # from the files' footers
    return dealt(areas(spark, sf_dir), rows, "person_id").join(people(spark, sf_dir), "person_id")


def adverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p, s = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    out = l.join(p.select("p_partkey", "p_type", "p_name", "p_size", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    out = out.join(places(spark, sf_dir), F.col("s_nationkey") == F.col("nation_key"))
    return out.select(
        F.col("p_type").alias("job_type"), F.col("p_name").alias("title"), F.col("l_suppkey").alias("facility"), F.col("l_returnflag").alias("employment"), "prefecture", "municipality",
        F.col("l_extendedprice").alias("salary"), (F.col("l_extendedprice") + F.col("p_size") * 100).alias("salary_high"),
        (F.col("l_quantity") > 25).alias("has_bulk"), (F.col("l_discount") > 0.05).alias("has_discount"), (F.col("l_tax") > 0.04).alias("has_tax"), (F.col("l_linestatus") == "O").alias("has_open"),
    )


FLAGS = ("has_bulk", "has_discount", "has_tax", "has_open")

_AGE = "CASE WHEN age < 30 THEN '20s' WHEN age < 40 THEN '30s' WHEN age < 50 THEN '40s' WHEN age < 60 THEN '50s' WHEN age < 70 THEN '60s' ELSE '70+' END"
SQL = f"""WITH places AS (SELECT n_nationkey AS nation_key, r_name AS prefecture, n_name AS municipality FROM nation JOIN region ON n_regionkey = r_regionkey),
people AS (SELECT *, {_AGE} AS age_group FROM (SELECT c_custkey AS person_id, CAST(18 + c_custkey % 60 AS INTEGER) AS age,
    CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, prefecture, municipality, c_mktsegment AS employment,
    CAST(c_custkey % 4 AS INTEGER) AS qualification_count, c_acctbal > 5000 AS has_license, c_acctbal < 1000 AS urgent
    FROM customer JOIN places ON c_nationkey = nation_key)),
areas AS (SELECT o_custkey AS person_id, prefecture AS want_prefecture, municipality AS want_municipality, o_orderpriority AS urgency
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN places ON s_nationkey = nation_key),
wishes AS (SELECT areas.*, people.* EXCLUDE (person_id) FROM areas JOIN people USING (person_id)),
adverts AS (SELECT p_type AS job_type, p_name AS title, l_suppkey AS facility, l_returnflag AS employment, prefecture, municipality, l_extendedprice AS salary,
    l_extendedprice + p_size * 100 AS salary_high, l_quantity > 25 AS has_bulk, l_discount > 0.05 AS has_discount, l_tax > 0.04 AS has_tax, l_linestatus = 'O' AS has_open
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN places ON s_nationkey = nation_key)
"""
