"""Sinks: tables, exports, replacement by key, merges of snapshots, logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shokuba.operators.core import top_n, union_tables
from shokuba.operators.quality import orphans


def write_tables(tables: Mapping[str, DataFrame], folder: str, form: str = "parquet", by: Sequence[str] = ()) -> None:
    """One directory per table; form parquet, csv (with header, each file beginning with a byte-order mark) or json."""
    for name, df in tables.items():
        if form == "csv":
            first = df.columns[0]
            df = df.withColumnRenamed(first, f"\ufeff{first}")
        writer = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
        (writer.option("header", True) if form == "csv" else writer).format(form).save(f"{folder}/{name}")


def save_tables(tables: Mapping[str, DataFrame], by: str | None = None) -> None:
    """Catalog tables, partitioned by a column if given."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format("parquet")
        (writer.partitionBy(by) if by else writer).saveAsTable(name)


def migrate(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], parents: Sequence[tuple[str, str, str, str]] = ()) -> DataFrame:
    """Catalog tables from frames (read_csv), and what was found: table, check, rows.

    keys: of each table the columns that should be unique; its first row in the order of all columns stays. parents:
    (table, column, parent table, parent column); rows without a parent are counted and kept.
    """
    found = []
    for name, df in tables.items():
        own = list(keys.get(name, ()))
        if own:
            kept = top_n(df, own, [F.asc_nulls_last(f"`{c}`") for c in df.columns], 1)
            found.append(df.agg(F.count("*").alias("n")).join(kept.agg(F.count("*").alias("k")), F.lit(True)).select(F.lit(name).alias("table"), F.lit("duplicate keys").alias("check"), (F.col("n") - F.col("k")).alias("rows")))
            df = kept
        df.write.mode("overwrite").format("parquet").saveAsTable(name)
    for name, column, parent, parent_column in parents:
        lost = orphans(tables[name], tables[parent], column, parent_column).agg(F.count("*").alias("rows"))
        found.append(lost.select(F.lit(name).alias("table"), F.lit(f"orphans of {parent}").alias("check"), "rows"))
    return union_tables(*found)


def promote(tokens: DataFrame, table: str) -> None:
    """Appends the tokens that unmatched_tokens found frequent enough to an overlay table, as their own canonical name."""
    fit = tokens.filter("promote").select("domain", F.col("token").alias("canonical"), F.lit(None).cast("string").alias("synonyms"))
    fit.write.mode("append").format("parquet").saveAsTable(table)


def replace_by_key(df: DataFrame, folder: str, key: str) -> None:
    """Replaces the partitions of the keys in `df` and leaves all others; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(folder)


def merge_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both, missing columns null."""
    return old.unionByName(new, allowMissingColumns=True)


def merge_last_wins(tables: Sequence[DataFrame], keys: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """One row per key: that of the last table that has it; `tie` orders rows within a table."""
    every = None
    for i, df in enumerate(tables):
        df = df.withColumn("_source", F.lit(i))
        every = df if every is None else every.unionByName(df, allowMissingColumns=True)
    return top_n(every, keys, [F.desc("_source"), *[F.asc(c) for c in tie]], 1).drop("_source")


def unmatched_tokens(tokens: DataFrame, dictionary: DataFrame, least: int = 3) -> DataFrame:
    """Tokens (domain, token) that the dictionary lacks, with counts, and whether they are frequent enough for it."""
    lost = tokens.join(dictionary, ["domain", "token"], "left_anti")
    return lost.groupBy("domain", "token").agg(F.count("*").alias("count")).withColumn("promote", F.col("count") >= least)


def run_metadata(df: DataFrame, key: str, version: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("rows")).withColumn("version", F.lit(version))
