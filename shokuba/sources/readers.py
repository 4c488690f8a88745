"""Scans of the input files, each with its own schema and options."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shokuba.functions.people import blank_to_null
from shokuba.operators.core import latest

ENCODINGS = ("UTF-8", "Shift_JIS", "windows-31j", "EUC-JP", "ISO-2022-JP")

APPLICANTS = T.StructType([T.StructField(c, T.StringType()) for c in (
    "page card_index age_gender location desired_area desired_workstyle desired_start career employment_status desired_job qualifications member_id status".split()
)])


def _allow(spark: SparkSession, encoding: str) -> None:
    """Spark reads other encodings than UTF and Latin-1 only under this setting, which then stays on in the session."""
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding {encoding}; known are {ENCODINGS}")
    if encoding != "UTF-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_csv(spark: SparkSession, path, schema: T.StructType | None = None, encoding: str = "UTF-8", multiline: bool = False, parts: int | None = None) -> DataFrame:
    """CSV with a header and '' as null. multiline: line breaks inside quotes (such a file is read by one task each).

    Gzip files are read the same way; they can't be split, so `parts` spreads their rows. A byte-order mark is dropped.
    """
    _allow(spark, encoding)
    reader = spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"').option("multiLine", multiline)
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns})
    df = df.select(*[blank_to_null(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])
    return df.repartition(parts) if parts else df


def read_postings(spark: SparkSession, path, names: Mapping[str, str] | None = None, parsed: Mapping[str, Column] | None = None, **options) -> DataFrame:
    """Adverts: texts with line breaks, rows without any value dropped, headers renamed by `names`, and columns that are
    parsed from them (functions.postings) added."""
    return rename(read_csv(spark, path, multiline=True, **options).dropna(how="all"), names or {}).withColumns(dict(parsed or {}))


def rename(df: DataFrame, names: Mapping[str, str], keep: bool = False) -> DataFrame:
    """Headers to canonical names; keep: as further columns."""
    found = {a: b for a, b in names.items() if a in df.columns}
    return df.withColumns({b: F.col(f"`{a}`") for a, b in found.items()}) if keep else df.withColumnsRenamed(found)


def latest_snapshots(spark: SparkSession, path, pattern: str = r"classified_(.+)_([0-9]{8})\.csv(?:\.gz)?$", skip: str = "sample", **options) -> DataFrame:
    """Rows of the newest file of each key, as key, snapshot and the file's columns; names that hold `skip` are ignored."""
    df = read_csv(spark, path, **options)
    name = F.col("_metadata.file_name")
    reader = spark.read.option("header", True).option("encoding", options.get("encoding", "UTF-8")).option("multiLine", options.get("multiline", False)).option("quote", '"').option("escape", '"')
    raw = reader.csv(path).withColumn("_file", name).filter(~F.contains(F.lower("_file"), F.lit(skip)))
    raw = raw.withColumn("key", F.regexp_extract("_file", pattern, 1)).withColumn("snapshot", F.regexp_extract("_file", pattern, 2)).filter("key <> ''")
    newest = raw.groupBy("key").agg(F.max("snapshot").alias("snapshot"))
    return raw.join(newest, ["key", "snapshot"]).select("key", "snapshot", *[f"`{c}`" for c in df.columns])


def query(spark: SparkSession, sql: str, args: Mapping | None = None, **tables: DataFrame) -> DataFrame:
    """A SQL query with named parameters (:name) over registered tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=dict(args or {}))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8, **properties: str) -> DataFrame:
    """A database table; with a numeric column and its bounds it is read by `parts` tasks."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **properties)
    if column and bounds:
        reader = reader.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def read_coordinates(spark: SparkSession, csv_path, json_path=None) -> DataFrame:
    """prefecture, municipality, lat, lng from a CSV; places it lacks come from a JSON table (key, lat, lng)."""
    schema = "prefecture string, municipality string, latitude double, longitude double"
    df = spark.read.option("header", True).schema(schema).csv(csv_path).withColumnsRenamed({"latitude": "lat", "longitude": "lng"})
    if json_path is None:
        return df
    from shokuba.functions.people import region

    more = spark.read.schema("key string, lat double, lng double").json(json_path)
    pref, muni = region(F.col("key"))
    more = more.select(pref.alias("prefecture"), muni.alias("municipality"), "lat", "lng")
    return df.unionByName(more.join(df, ["prefecture", "municipality"], "left_anti"))


def read_indicators(spark: SparkSession, paths: Sequence[str], base: DataFrame, key: str = "prefecture") -> DataFrame:
    """`base` with the columns of one CSV per indicator, by left joins on the key."""
    tables = [latest(t, [key], [F.asc_nulls_last(f"`{c}`") for c in t.columns]) for t in (read_csv(spark, p) for p in paths)]
    return reduce(lambda a, b: a.join(b, key, "left"), tables, base)


def read_geocodes(spark: SparkSession, path, encoding: str = "ISO-2022-JP") -> DataFrame:
    """address, lat, lng, confidence, level: the most confident result above 0 of each address. A line is the address and
    five quoted fields at its end."""
    _allow(spark, encoding)
    pattern = r'^(.*?),"([^"]*)","([^"]*)","([^"]*)","([^"]*)","([^"]*)"\s*$'
    lines = spark.read.option("encoding", encoding).option("header", False).option("sep", "\x00").option("quote", "\x00").csv(path, schema="line string")
    f = [F.regexp_extract("line", pattern, i) for i in range(1, 7)]
    rows = lines.select(f[0].alias("address"), f[2].try_cast("double").alias("lat"), f[3].try_cast("double").alias("lng"), f[4].try_cast("int").alias("confidence"), f[5].try_cast("int").alias("level"))
    return latest(rows.filter("confidence > 0 and address <> ''"), ["address"], [F.desc("confidence"), F.desc("level"), F.asc("lat"), F.asc("lng")])


def synonym_table(base: DataFrame, overlay: DataFrame | None = None) -> DataFrame:
    """(domain, token, canonical and what else the tables have, as display, family, national) from tables of domain,
    canonical, synonyms (parted by a bar); the overlay wins."""
    tables = [base.withColumn("_p", F.lit(1))] + ([overlay.withColumn("_p", F.lit(0))] if overlay is not None else [])
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    tokens = F.concat(F.array("canonical"), F.coalesce(F.split("synonyms", r"\|"), F.array().cast("array<string>")))
    more = [c for c in every.columns if c not in ("domain", "canonical", "synonyms", "_p")]
    rows = every.select("domain", "canonical", "_p", *more, F.explode(tokens).alias("token")).withColumn("token", F.trim("token")).filter("token <> ''")
    return latest(rows, ["domain", "token"], [F.asc("_p"), F.asc("canonical")]).drop("_p")


def read_openings(spark: SparkSession, path, names: DataFrame) -> DataFrame:
    """Openings per place and job type: rows without municipality (totals) and unmapped names are dropped.

    names: source_job_type, job_type.
    """
    df = read_csv(spark, path).filter("municipality is not null").withColumn("job_count", F.regexp_replace("job_count", ",", "").try_cast("bigint"))
    return df.withColumnRenamed("job_type", "source_job_type").join(names, "source_job_type")


def flag_columns(df: DataFrame, prefix: str = "has_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]
