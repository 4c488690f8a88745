"""Checks of tables: nulls, sample sizes, keys, references, identities, and one score over all."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shokuba.functions.people import sample_class
from shokuba.operators.core import melt


def null_report(df: DataFrame) -> DataFrame:
    """column, rows, nulls, null_rate, status per column, in one pass."""
    n = F.count("*")
    cells = [F.struct(F.lit(c).alias("column"), n.alias("rows"), F.count_if(F.col(f"`{c}`").isNull()).alias("nulls")) for c in df.columns]
    out = df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("x")).select("x.*")
    rate = F.try_divide(F.col("nulls").cast("double"), F.col("rows"))
    status = F.when(F.col("nulls") == 0, "complete").when(rate < 0.1, "good").when(rate < 0.3, "fair").when(rate < 0.7, "poor").otherwise("bad")
    return out.withColumn("null_rate", rate).withColumn("status", status)


def sample_report(df: DataFrame, columns: Sequence[str], least: int = 30) -> DataFrame:
    """Per column: valid rows, distinct values, smallest and largest group, reliability; two groupings, no driver loop."""
    long = melt(df, [], columns, "column", "value").filter("value is not null")
    sizes = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    out = sizes.groupBy("column").agg(F.sum("n").alias("valid"), F.count("*").alias("values"), F.min("n").alias("min_group"), F.max("n").alias("max_group"))
    level = F.when(F.col("min_group") >= least, "HIGH").when(F.col("min_group") >= 10, "MEDIUM").when(F.col("min_group") >= 3, "LOW").otherwise("CRITICAL")
    return out.withColumn("reliability", level).withColumn("warning", F.col("min_group") < least)


def cross_reliability(df: DataFrame, a: str, b: str, small: int = 5) -> DataFrame:
    """One row for a cross table: cells, cells with rows, empty and small ones, and whether under 30 % are small."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).count()
    out = cells.agg(F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"), F.count("*").alias("filled"), F.count_if(F.col("count") < small).alias("small_cells"), F.sum("count").alias("valid"))
    total = F.col("ka") * F.col("kb")
    return out.select(total.alias("cells"), "valid", "filled", (total - F.col("filled")).alias("empty_cells"), "small_cells", (F.try_divide(F.col("small_cells").cast("double"), total) < 0.3).alias("reliable"))


def quality_score(rows: Column, reliable: Column, columns: Column, crosses_ok: Column, crosses: Column) -> Column:
    """10-40 points for rows, up to 30 for reliable columns, up to 30 for reliable crosses."""
    size = F.when(rows >= 1000, 40).when(rows >= 100, 30).when(rows >= 30, 20).otherwise(10)
    return size + 30 * F.coalesce(F.try_divide(reliable.cast("double"), columns), F.lit(0.0)) + 30 * F.coalesce(F.try_divide(crosses_ok.cast("double"), crosses), F.lit(0.0))


def quality_flags(df: DataFrame, count: str) -> DataFrame:
    """Sample class of each aggregate row and a warning for rows that carry little."""
    kind = sample_class(F.col(count))
    return df.withColumn("sample_class", kind).withColumn("warning", kind.isin("SMALL", "VERY_SMALL"))


def cell_flags(df: DataFrame, count: str) -> DataFrame:
    """Quality of cross cells: 30 and more, 5 and more, fewer, none."""
    return df.withColumn("cell_quality", F.when(F.col(count) >= 30, "SUFFICIENT").when(F.col(count) >= 5, "MARGINAL").when(F.col(count) > 0, "INSUFFICIENT").otherwise("NO_DATA"))


def quality_summary(df: DataFrame, kind: str, count: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("rows"), F.avg(count).alias("avg_count"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, nulls counting as equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Child rows whose key is not null and has no parent."""
    p = parent.select(F.col(parent_key or key).alias("_p")).distinct()
    return child.filter(F.col(key).isNotNull()).join(p, F.col(key) == F.col("_p"), "left_anti")


def load_checks(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check, passed for boolean aggregate expressions, in one pass."""
    cells = [F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def numeric_integrity(df: DataFrame, columns: Sequence[str], reach: float = 5.0) -> DataFrame:
    """Per column: negatives, nulls, infinities, and values beyond `reach` sample deviations of the mean."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    wide = df.select(*columns).join(F.broadcast(stats), F.lit(True))  # one row
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.count_if(F.col(c) < 0).alias("negatives"), F.count_if(F.col(c).isNull()).alias("nulls"),
            F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias("infinite"),
            F.count_if(F.abs(F.col(c) - F.col(f"m_{c}")) > F.col(f"s_{c}") * reach).alias("outliers"),
        ) for c in columns
    ]
    return wide.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def identity_check(df: DataFrame, left: Column, right: Column, tolerance: float = 0.01) -> DataFrame:
    """rows, violations of left = right."""
    return df.agg(F.count("*").alias("rows"), F.count_if(F.abs(left - right) > tolerance).alias("violations"))


def reconcile(a: DataFrame, b: DataFrame, column: str, tolerance: float = 0.01) -> DataFrame:
    """Totals of a column in two tables and whether they agree."""
    x = a.agg(F.sum(column).alias("total_a")).join(b.agg(F.sum(column).alias("total_b")), F.lit(True))  # one row each
    return x.withColumn("agrees", F.abs(F.col("total_a") - F.col("total_b")) <= tolerance)


def out_of_range(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """column, bad: values outside the given range, or not a number where text is given."""
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNotNull() & ~F.coalesce(F.col(c).try_cast("double").between(*r), F.lit(False))).alias("bad")) for c, r in ranges.items()]
    return df.agg(F.array(*cells).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def repair(df: DataFrame, demand: str = "demand_count", supply: str = "supply_count", municipality: str = "municipality") -> DataFrame:
    """gap recomputed as demand - supply, null municipality to ''."""
    return df.withColumn("gap", F.col(demand) - F.col(supply)).fillna("", [municipality] if municipality in df.columns else [])


def add_missing(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Rows for each key of the dimension that `df` lacks, other columns null."""
    return df.unionByName(dimension.select(key).join(df.select(key), key, "left_anti"), allowMissingColumns=True)


def overall_report(tables: dict[str, DataFrame]) -> DataFrame:
    """null_report of several tables in one."""
    return reduce(DataFrame.unionByName, [null_report(t).select(F.lit(n).alias("table"), "*") for n, t in tables.items()])


def table_quality(df: DataFrame, columns: Sequence[str], crosses: Sequence[tuple[str, str]], least: float = 60.0) -> DataFrame:
    """One row: rows, reliable columns and crosses, score (0-100), status, and whether the table passes the gate."""
    single = sample_report(df, columns).agg(F.count_if(F.col("reliability").isin("HIGH", "MEDIUM")).alias("reliable_columns"))
    pairs = reduce(DataFrame.unionByName, [cross_reliability(df, a, b) for a, b in crosses]).agg(F.count_if("reliable").alias("reliable_crosses"))
    one = df.agg(F.count("*").alias("rows")).join(single, F.lit(True)).join(pairs, F.lit(True))  # one row each
    score = quality_score(F.col("rows"), F.col("reliable_columns"), F.lit(len(columns)), F.col("reliable_crosses"), F.lit(len(crosses)))
    status = F.when(score >= 80, "EXCELLENT").when(score >= 60, "GOOD").when(score >= 40, "ACCEPTABLE").otherwise("POOR")
    return one.withColumn("score", score).withColumn("status", status).withColumn("passed", score >= least)


def difficulty_summary(df: DataFrame, score: str, level: str) -> DataFrame:
    """Average score, and score and level of the hardest row."""
    return df.agg(F.avg(score).alias("avg_score"), F.max(score).alias("max_score"), F.max_by(level, F.struct(score, level)).alias("max_level"))
