"""Moves that most tables are made of: grouped counts, shares, top rows, grouping sets, bands, suppression.

All functions take DataFrames and column names and return DataFrames. Rows whose grouping key is null are left out
where the docstring says so; ties are always broken by an explicit order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_SHORT, _KEPT = 200, 100_000  # characters of texts, and texts, that a task keeps


class Kept(dict):
    """What a function says of short texts, kept in the task for the next time, as adverts say the same again and again."""

    def __init__(self, f: Callable):
        self.f = f

    def __missing__(self, text: str):
        out = self.f(text)
        if len(text) <= _SHORT:
            if len(self) >= _KEPT:
                self.clear()
            self[text] = out
        return out


def known(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in which none of `keys` is null."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])) if keys else df


def dealt(df: DataFrame, rows: int, *keys: str, most: int = 1_500_000) -> DataFrame:
    """`df` of about `rows` rows dealt out by `keys` into parts of about `most` rows, where the session's number of parts
    would make them larger. What is then grouped or joined by these keys stays in its part, so a task holds no more
    however many rows there are."""
    parts = -(-rows // most)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def mode(column: str | Column) -> Column:
    """Most frequent value; of equally frequent ones the smallest."""
    return F.mode(column, True)


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """part / whole x scale; null where the whole is 0 or null."""
    return F.when(whole != 0, part.cast("double") * F.lit(scale) / whole.cast("double"))


def weighted_mean(value: str, weight: str) -> Column:
    """Mean of `value` weighted by `weight`, over rows that have the value; null where the weights sum to 0."""
    w = F.when(F.col(value).isNotNull(), F.col(weight).cast("double"))
    return F.try_divide(F.sum(F.col(value).cast("double") * w), F.sum(w))


def cross(df: DataFrame, dims: Sequence[str], measures: Sequence[Column] = (), min_count: int = 0, within: Sequence[str] | None = None) -> DataFrame:
    """Counts over any dimensions: dims, count, measures, and with `within` the share of each row in that group.

    Null keys are left out; groups of fewer than `min_count` rows are suppressed, after the shares were taken.
    within=() is the share of all rows.
    """
    out = known(df, dims).groupBy(*dims).agg(F.count("*").alias("count"), *measures)
    if within is not None:
        out = with_share(out, "count", within)
    return out.filter(F.col("count") >= min_count) if min_count else out


def counted(df: DataFrame, *columns: str) -> DataFrame:
    """The different rows of the columns with their `count`: work on texts that repeat is done once for each."""
    return df.groupBy(*columns).agg(F.count("*").alias("count"))


def with_share(df: DataFrame, value: str, within: Sequence[str], name: str = "share_pct", scale: float = 100.0) -> DataFrame:
    """`value` as a share of its sum over `within` (row %, column % or, with none, share of all)."""
    if within:
        return df.withColumn(name, share(F.col(value), F.sum(value).over(Window.partitionBy(*within)), scale))
    whole = F.broadcast(df.agg(F.sum(value).alias("_whole")))  # one row
    return df.join(whole, F.lit(True)).withColumn(name, share(F.col(value), F.col("_whole"), scale)).drop("_whole")


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first `n` rows of each group; order must break every tie. rank: name of a column for the position."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def ranked(df: DataFrame, order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first `n` rows of the whole table with their position; only these `n` rows meet in one task."""
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def scopes(df: DataFrame, levels: dict[str, Sequence[str]], measures: Sequence[Column], label: str = "scope") -> DataFrame:
    """The same aggregates at several levels in one pass (grouping sets); columns a level leaves out are null.

    levels: name of the level and its columns, e.g. {"nation": [], "prefecture": ["pref"]}. Rows with a null in any of
    the columns are left out.
    """
    if len({frozenset(cols) for cols in levels.values()}) < len(levels):
        raise ValueError("two levels have the same columns")
    every = list(dict.fromkeys(c for cols in levels.values() for c in cols))
    out = known(df, every).groupingSets([[F.col(c) for c in cols] for cols in levels.values()], *[F.col(c) for c in every]).agg(F.grouping_id().alias("_set"), *measures)
    name = F.lit(None).cast("string")
    for level, cols in levels.items():
        bits = sum(1 << (len(every) - 1 - i) for i, c in enumerate(every) if c not in cols)
        name = F.when(F.col("_set") == bits, F.lit(level)).otherwise(name)
    return out.withColumn(label, name).drop("_set")


def bands(column: str | Column, edges: Sequence[float], labels: Sequence[str], right: bool = False) -> Column:
    """Label of the band of a value: labels[i] from edges[i-1] on (right: beyond it) and below edges[i]; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels))):
        out = F.when(c <= edge if right else c < edge, F.lit(label)).otherwise(out)
    return F.when(c.isNotNull(), out)


def suppress(df: DataFrame, count: str, least: int) -> DataFrame:
    """Rows whose group has at least `least` members."""
    return df.filter(F.col(count) >= least)


def melt(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """One row per key and column; values are cast to text where their types differ."""
    kinds = {t for c, t in df.dtypes if c in columns}
    picked = df.select(*keys, *[F.col(c).cast("string").alias(c) if len(kinds) > 1 else F.col(c) for c in columns])
    return picked.unpivot(list(keys), list(columns), name, value)


def pivot_counts(df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Cross table with one column per value (the values are given, so no pass is needed to find them); 0 where empty."""
    return known(df, rows).groupBy(*rows).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in `order`, which must break every tie."""
    return top_n(df, keys, order, 1)


def outer_counts(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join of two tables of counts, in which missing numbers are 0."""
    out = left.join(right, list(on), "full")
    return out.fillna(0, [c for c, t in out.dtypes if c not in on and t in ("bigint", "int", "double")])


def ordered_by(df: DataFrame, column: str, order: Sequence[str], last: int = 999) -> DataFrame:
    """Rows in a fixed order of categories (at most some hundreds), unknown ones last, then by the category."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(o) for o in order]), F.col(column)), F.lit(0)), F.lit(last))
    return df.orderBy(place, column)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Values of a column, not null, in order."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def facets(df: DataFrame, wanted: dict[str, str | Sequence[str] | None], everything: str = "all") -> DataFrame:
    """Rows that match every given facet; None and `everything` mean no filter, a list means any of it, `x*` a prefix."""
    for column, value in wanted.items():
        if value is None or value == everything:
            continue
        if not isinstance(value, str):
            df = df.filter(F.col(column).isin(list(value)))
        elif value.endswith("*"):
            df = df.filter(F.col(column).startswith(value[:-1]))
        else:
            df = df.filter(F.col(column) == value)
    return df


def union_tables(*frames: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Union by name with missing columns null; columns fixes the order and drops the rest, and those that no frame has
    are null texts."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return out.select(*[F.col(f"`{c}`") if c in out.columns else F.lit(None).cast("string").alias(c) for c in columns]) if columns else out


def difference(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of `left` whose key is not in `right`."""
    return left.join(right.select(*on), list(on), "left_anti")


def sample_per_group(df: DataFrame, by: Sequence[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """At most `n` rows of each group, the same ones in each run: those with the smallest hash of `key`."""
    return top_n(df, by, [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)], n)


def join_chain(tables: dict[str, DataFrame], links: Sequence[tuple[str, str]]) -> DataFrame:
    """Named tables joined one after the other: links are pairs ("orders.o_custkey", "customer.c_custkey"), each of which
    brings in the table of its right side."""
    out = tables[links[0][0].split(".")[0]]
    for left, right in links:
        name, key = right.split(".")
        out = out.join(tables[name], F.col(left.split(".")[1]) == F.col(key))
    return out
