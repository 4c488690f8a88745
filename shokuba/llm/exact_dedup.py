"""Exact duplicates by a tree of merged digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shokuba.llm.common import SPACE, join_by_heavy, stage, text_or_empty


def _norm() -> Column:
    return F.regexp_replace(text_or_empty(), SPACE + "+", " ")


def digest_runs(docs: DataFrame, runs: int = 64) -> DataFrame:
    """One narrow row per document: its run, a 64-bit digest to sort by, and what verifies it (SHA-256 and length)."""
    return (
        docs.select(F.col("doc_id"), _norm().alias("norm"))
        .select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.length("norm").cast("long").alias("norm_chars"))
        .withColumn("digest", F.xxhash64("text_sha256", "norm_chars"))
        .withColumn("row", F.monotonically_increasing_id())
        .withColumn("run", F.spark_partition_id() % runs)
    )


def merge_runs(level: DataFrame, fan_in: int) -> DataFrame:
    """One round: `fan_in` runs become one. Entries with equal digest, SHA-256 and length merge to their smallest row.

    Each side sends what is left of its run after merging at home (the partial aggregate), so a group of any size
    arrives as one entry per run.
    """
    return (
        level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        .groupBy("run", "digest", "text_sha256", "norm_chars")
        .agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))
    )


def exact_duplicates(docs: DataFrame, runs: int = 64, fan_in: int = 8) -> DataFrame:
    """doc_id, row, keep_id, group_size, kept, text_sha256: one row per row of `docs`.

    Texts are equal when they are identical after each stretch of white space has become one space; null counts as
    empty. The row with the smallest doc_id of a group stays; among rows that repeat this doc_id, the first as read.
    A null doc_id comes last: it stays only in a group that has no other. An empty table gives an empty result, and
    no column but doc_id and text is read.

    Partitions form runs of (digest, verified by SHA-256 and length) with smallest identifier and count; `fan_in`
    runs are merged in each round until one is left. Only groups of two rows or more travel back to their rows.
    """
    rows = stage(digest_runs(docs, runs), "digests")
    entry = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    level = rows.groupBy("run", "digest", "text_sha256", "norm_chars").agg(F.min(entry).alias("keep"), F.count("*").alias("group_size"))
    while runs > 1:
        level, runs = merge_runs(level, fan_in), -(-runs // fan_in)
    groups = stage(level.filter("group_size > 1").select("digest", "text_sha256", "norm_chars", "keep", "group_size"), "groups")
    out = join_by_heavy(rows, groups, ["digest", "text_sha256", "norm_chars"], "group_size", "left")
    return out.select(
        "doc_id",
        "row",
        F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep").isNull() | (F.col("keep.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; as `exact_duplicates` decides.

    Row numbers follow the scan, which another job may split anew, so rows are matched by doc_id and text, in one join;
    keys that many rows repeat are broadcast. Only if rows repeat both doc_id and text, these are read once more and
    their first one is picked.
    """
    key, columns = ["doc_id", "text_sha256"], docs.columns
    found = exact_duplicates(docs, **options).groupBy(*key).agg(F.bool_or("kept").alias("stays"), F.count("*").alias("n"))
    found = stage(found.filter("not stays or n > 1").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_text"), "stays", "n"), "lost")
    total, repeats = found.agg(F.sum("n"), F.count_if("stays")).first()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.sha2(_norm(), 256).alias("_sha"))

    def same(keys: DataFrame) -> Column:
        return rows["_doc"].eqNullSafe(keys["_id"]) & (rows["_sha"] == keys["_text"])

    often, seldom = F.col("n") > (total or 0) / 1000, F.col("n") <= (total or 0) / 1000  # fewer than 1000 keys are often
    out = rows
    if total and (heavy := found.filter(often)).count():
        out = out.join(F.broadcast(heavy), same(heavy), "left_anti")
    light = found.filter(seldom).hint("merge")  # alike at every size
    out = out.join(light, same(light), "left_anti").select("_row")
    if repeats:
        again = stage(found.filter("stays").select("_id", "_text"), "repeated")
        first = rows.withColumn("_at", F.monotonically_increasing_id()).join(again, same(again), "left_semi")
        out = out.union(first.groupBy("_doc", "_sha").agg(F.min_by("_row", "_at").alias("_row")).select("_row"))
    return out.select("_row.*")
