"""Statistics over whole tables by sums: independence, variance, inequality, concentration."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shokuba.operators.core import cross, known, scopes, share
from shokuba.sources.scratch import cut_lineage, written


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function, by series or continued fraction."""
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def _beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_i(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + num * d), 1 + num / c
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi_square_p(stat: float, dof: int) -> float:
    return _gamma_q(dof / 2, stat / 2) if dof > 0 else 1.0


def anova_p(f: float, between: int, within: int) -> float:
    return _beta_i(within / 2, between / 2, within / (within + between * f)) if between > 0 and within > 0 else 1.0


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Independence of two columns, one row: n, dof, chi_square, cramers_v. 2 x 2 tables get Yates' correction."""
    cells = known(df, [a, b]).groupBy(a, b).agg(F.count("*").alias("o"))
    size = cells.agg(F.sum("o").cast("double").alias("n"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"))
    met = cells.withColumns({"ra": F.sum("o").over(Window.partitionBy(a)).cast("double"), "cb": F.sum("o").over(Window.partitionBy(b)).cast("double")})
    met = met.join(F.broadcast(size), F.lit(True))  # one row
    # the sum of (o - e)^2 / e over all cells is that of o^2 / e over the filled ones, less n; so no grid is needed
    e = F.col("ra") * F.col("cb") / F.col("n")
    out = met.agg(F.max("n").alias("n"), F.max("ka").alias("ka"), F.max("kb").alias("kb"), F.sum(F.col("o") * F.col("o") / e).alias("s"), F.max("o").alias("o"), F.max_by("ra", "o").alias("r"), F.max_by("cb", "o").alias("c"))
    # of a 2 x 2 table every cell lies equally far from what is expected
    gap = F.abs(F.col("o") - F.col("r") * F.col("c") / F.col("n"))
    gap = F.greatest(F.lit(0.0), gap - F.least(F.lit(0.5), gap))
    yates = gap * gap * F.col("n") * F.col("n") * F.col("n") / (F.col("r") * (F.col("n") - F.col("r")) * F.col("c") * (F.col("n") - F.col("c")))
    chi = F.when((F.col("ka") == 2) & (F.col("kb") == 2), yates).otherwise(F.greatest(F.lit(0.0), F.col("s") - F.col("n")))
    out = out.select(F.col("n").cast("long").alias("n"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("dof"), chi.alias("chi_square"), (F.least("ka", "kb") - 1).alias("k"))
    return out.select("n", "dof", "chi_square", F.sqrt(F.try_divide(F.col("chi_square"), F.col("n") * F.col("k"))).alias("cramers_v"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way analysis of variance, one row: n, groups, f_statistic, eta_squared."""
    parts = known(df, [group, value]).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    within = F.sum(F.col("n") * F.col("v"))
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * grand * grand
    out = parts.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), between.alias("b"), within.alias("w"))
    f = F.try_divide(F.col("b") / (F.col("groups") - 1), F.col("w") / (F.col("n") - F.col("groups")))
    return out.select("n", "groups", f.alias("f_statistic"), F.try_divide(F.col("b"), F.col("b") + F.col("w")).alias("eta_squared"))


def _p_value(f, *columns: str) -> Column:
    @F.pandas_udf("double")
    def p(*cols: pd.Series) -> pd.Series:
        return pd.Series([f(*row) if None not in row and row[0] == row[0] else None for row in zip(*cols)], dtype="float64")

    return p(*columns)


def chi_square_test(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    """chi_square with p_value, significant, and the effect's name by Cramer's V (0.1, 0.3, 0.5)."""
    out = chi_square(df, a, b).withColumn("p_value", _p_value(lambda x, k: chi_square_p(x, int(k)), "chi_square", "dof"))
    v = F.col("cramers_v")
    effect = F.when(v >= 0.5, "large").when(v >= 0.3, "medium").when(v >= 0.1, "small").otherwise("negligible")
    return out.withColumn("effect", effect).withColumn("significant", F.col("p_value") < alpha)


def anova_test(df: DataFrame, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """anova with p_value, significant, and the effect's name by eta squared (0.01, 0.06, 0.14)."""
    out = anova(df, group, value).withColumn("p_value", _p_value(lambda f, k, n: anova_p(f, int(k) - 1, int(n) - int(k)), "f_statistic", "groups", "n"))
    e = F.col("eta_squared")
    effect = F.when(e >= 0.14, "large").when(e >= 0.06, "medium").when(e >= 0.01, "small").otherwise("negligible")
    return out.withColumn("effect", effect).withColumn("significant", F.col("p_value") < alpha)


def places(df: DataFrame, by: Sequence[str], value: str, slices: int = 64, weight: str | None = None) -> DataFrame:
    """Per group and distinct value: k, how many rows have it, and before, how many have a smaller one; nulls are left out.
    weight: a column that says how many rows each row of `df` stands for.

    Each group is cut at approximate quantiles into about `slices` ranges, which are sorted apart; the ranges' totals give
    what lies before each. So the counts are exact and no group, however large, is sorted in one task.
    """
    cells = known(df, [*by, value]).groupBy(*by, value).agg((F.sum(weight) if weight else F.count("*")).alias("k"))
    cuts = cells.groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit(i / slices) for i in range(1, slices)]), 10 * slices).alias("_cuts"))
    met = cells.join(cuts, list(by)) if by else cells.join(F.broadcast(cuts), F.lit(True))  # one row
    met = met.withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = met.groupBy(*by, "_slice").agg(F.sum("k").alias("_sum"))
    upto = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # at most `slices` rows a group
    totals = totals.select(*by, "_slice", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumn("_upto", F.sum("k").over(inside) - F.col("k"))
    return met.join(totals, [*by, "_slice"]).select(*by, value, "k", (F.col("_before") + F.col("_upto")).alias("before"))


def percentiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float], name: str = "q", weight: str | None = None) -> DataFrame:
    """Per group the exact percentiles at `points`, linearly interpolated, as an array; groups of any size (places)."""
    return percentiles_of(places(df, by, value, weight=weight), by, value, points, name)


def percentiles_of(cells: DataFrame, by: Sequence[str], value: str, points: Sequence[float], name: str = "q") -> DataFrame:
    """The same from a table that `places` has made."""
    n = cells.groupBy(*by).agg(F.sum("k").alias("_n"))
    return _at_points(cells.join(n, list(by)) if by else cells.join(F.broadcast(n), F.lit(True)), by, value, points, name)  # one row


def _at_points(met: DataFrame, by: Sequence[str], value: str, points: Sequence[float], name: str) -> DataFrame:
    """percentiles from those rows of `places` that the points lie in, with _n, the rows of their group."""
    x, first, last = F.col(value).cast("double"), F.col("before"), F.col("before") + F.col("k") - 1
    out = []
    for i, p in enumerate(points):
        at = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.floor(at), F.ceil(at)
        out += [F.max(F.when((first <= low) & (low <= last), x)).alias(f"_l{i}"), F.max(F.when((first <= high) & (high <= last), x)).alias(f"_h{i}"), F.max(at - low).alias(f"_f{i}")]
    parts = [F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * F.col(f"_f{i}") for i in range(len(points))]
    return met.groupBy(*by).agg(*out).select(*by, F.array(*parts).alias(name))


_STEPS = 128  # ranges of values between a number and its double


def _range(value: str | Column) -> Column:
    """Number of the range that a value lies in: larger values never lie in lower ranges, and NaN is the largest value."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    size = F.when(F.abs(x) == float("inf"), 1_000_000).otherwise(F.floor((F.log2(F.abs(x)) + 1075) * _STEPS) + 1)
    return F.when(F.isnan(x), 2_000_000).when(x > 0, size).when(x < 0, -size).otherwise(0).cast("long")


def narrowed_percentiles(df: DataFrame, by: Sequence[str], value: str, points: Sequence[float], name: str = "q", weight: str | None = None) -> DataFrame:
    """The same as `percentiles`, for a table that is cheap to read twice. The first pass counts rows by fixed ranges of the
    value; the second counts values in those ranges only in which the points lie, so of a large table few rows are shuffled."""
    rows = known(df, [*by, value]).select(*by, value, _range(value).alias("_range"), (F.col(weight) if weight else F.lit(1).cast("long")).alias("_k"))
    ranges = held_ranges(rows, by, points)
    some = rows.join(ranges.select(*by, "_range"), [*by, "_range"], "left_semi")
    return percentiles_in_ranges(some, ranges, by, value, points, name)


def held_ranges(rows: DataFrame, by: Sequence[str], points: Sequence[float]) -> DataFrame:
    """by, _range, _from, _n: the ranges of each group that hold the percentiles at `points`, how many rows lie before, and the
    group's rows. `rows` has by, _range and _k, the number of rows that a row stands for."""
    ranges = written(rows.groupBy(*by, "_range").agg(F.sum("_k").alias("_k")))
    upto = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # ranges are few
    ranges = ranges.withColumns({"_from": F.coalesce(F.sum("_k").over(upto), F.lit(0)), "_n": F.sum("_k").over(Window.partitionBy(*by))})
    first, last, n = F.col("_from"), F.col("_from") + F.col("_k") - 1, F.col("_n") - 1
    held = [(first <= F.ceil(n * F.lit(float(p)))) & (last >= F.floor(n * F.lit(float(p)))) for p in points]
    return written(ranges.filter(reduce(lambda a, b: a | b, held)).select(*by, "_range", "_from", "_n"))  # a row or two for each group and point


def percentiles_in_ranges(some: DataFrame, ranges: DataFrame, by: Sequence[str], value: str, points: Sequence[float], name: str = "q") -> DataFrame:
    """The percentiles from the rows (by, _range, value, _k) in held_ranges alone."""
    cells = places(some, [*by, "_range"], value, weight="_k").join(ranges, [*by, "_range"])
    return _at_points(cells.withColumn("before", F.col("before") + F.col("_from")), by, value, points, name)


def gini(df: DataFrame, by: Sequence[str], value: str, least: int = 10) -> DataFrame:
    """Gini coefficient per group; null for fewer than `least` values."""
    cells = places(df, by, value)  # equal values share their places
    x, k = F.col(value).cast("double"), F.col("k")
    shared = k * F.col("before") + k * (k + 1) / 2.0
    out = cells.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(x * shared).alias("s"), F.sum(x * k).alias("t"))
    g = F.when((F.col("n") >= least) & (F.col("t") != 0), 2 * F.col("s") / (F.col("n") * F.col("t")) - (F.col("n") + 1) / F.col("n"))
    return out.select(*by, "n", g.alias("gini"))


def concentration(df: DataFrame, by: Sequence[str], unit: str) -> DataFrame:
    """Of each group: rows, units, shares of the largest 1, 5, 10 and 20, HHI, and the Zipf exponent over units with
    two rows or more (null for fewer than ten of these)."""
    counts = cross(df, [*by, unit])
    r = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("count"), F.asc(unit)))
    t = F.sum("count").over(Window.partitionBy(*by))
    one = counts.select(*by, "count", r.alias("r"), t.alias("t"))
    p = F.col("count") / F.col("t")
    tops = [F.sum(F.when(F.col("r") <= n, p).otherwise(0.0)).alias(f"top{n}_share") for n in (1, 5, 10, 20)]
    slope = F.regr_slope(F.when(F.col("count") >= 2, F.ln("count")), F.when(F.col("count") >= 2, F.ln("r")))
    return one.groupBy(*by).agg(F.sum("count").alias("total"), F.count("*").alias("units"), *tops, F.sum(p * p).alias("hhi"), F.when(F.count_if(F.col("count") >= 2) >= 10, F.abs(slope)).alias("zipf"))


def entropy(df: DataFrame, by: Sequence[str], kind: str) -> DataFrame:
    """Shannon entropy (bits) of the kinds in each group, its maximum, evenness, dominant kind, distribution as JSON."""
    parts = cross(df, [*by, kind], within=by).withColumn("p", F.col("share_pct") / 100)
    out = parts.groupBy(*by).agg(
        F.sum("count").alias("total"),
        F.sum(-F.col("p") * F.log2("p")).alias("entropy"),
        F.log2(F.count("*")).alias("max_entropy"),
        F.min_by(kind, F.struct(-F.col("count"), kind)).alias("dominant"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "count"))))).alias("distribution"),
    )
    return out.withColumn("evenness", F.when(F.col("max_entropy") > 0, F.col("entropy") / F.col("max_entropy")))


def iqr_bounds(df: DataFrame, by: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles (linear interpolation) of each group and the bounds `reach` interquartile ranges beyond them."""
    q = percentiles(df, by, value, (0.25, 0.75))
    lo, hi = F.col("q")[0], F.col("q")[1]
    return q.select(*by, lo.alias("q25"), hi.alias("q75"), (lo - reach * (hi - lo)).alias("low"), (hi + reach * (hi - lo)).alias("high"))


def trim_outliers(df: DataFrame, by: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Rows within the bounds of their group; bounds are one row per group."""
    return df.join(iqr_bounds(df, by, value, reach).select(*by, "low", "high"), list(by)).filter(F.col(value).between(F.col("low"), F.col("high"))).drop("low", "high")


def distribution(df: DataFrame, levels: dict[str, Sequence[str]], value: str, high: str | None = None, least: int = 10, reach: float = 1.5) -> DataFrame:
    """At each level: n, mean, quartiles, median and 90th percentile of all rows; std (of a sample) and gini of the rows
    within `reach` interquartile ranges of the quartiles. Groups of fewer than `least` rows, before or after, are left out.
    high: a column for the upper end; range_pct is the share of rows where it is above 0, range_median the median width.

    Values are counted once for all levels, and each level's counts are put in order once; percentiles, bounds, deviation
    and Gini all come from them.
    """
    every = list(dict.fromkeys(c for cols in levels.values() for c in cols))
    rows = known(df, [*every, value])
    both = base = written(rows.groupBy(*every, value, *([high] if high else [])).agg(F.count("*").alias("_rows")))  # `df` is worked out once
    wide = None
    if high:
        base = cut_lineage(both.groupBy(*every, value).agg(F.sum("_rows").alias("_rows")))
        apart = both.filter(F.col(high) > 0).withColumn("_width", F.col(high).cast("double") - F.col(value))
        wide = cut_lineage(apart.groupBy(*every, "_width").agg(F.sum("_rows").alias("_rows")))

    def joined(a: DataFrame, b: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
        return a.join(b, list(cols), how) if cols else a.join(F.broadcast(b), F.lit(True), how)  # one row

    out, x = [], F.col(value).cast("double")
    for level, cols in levels.items():
        cells = cut_lineage(places(base, cols, value, weight="_rows"))
        one = cells.groupBy(*cols).agg(F.sum("k").alias("n"), (F.sum(x * F.col("k")) / F.sum("k")).alias("mean")).filter(F.col("n") >= least)
        q = percentiles_of(cells, cols, value, (0.25, 0.5, 0.75, 0.9), "_q")
        one = joined(one, q, cols).select(*cols, "n", "mean", *[F.col("_q")[i].alias(c) for i, c in enumerate(("p25", "median", "p75", "p90"))])
        width = reach * (F.col("p75") - F.col("p25"))
        kept = joined(cells, one.select(*cols, (F.col("p25") - width).alias("_low"), (F.col("p75") + width).alias("_high"), F.col("median").alias("_m")), cols)
        k, d = F.col("k"), x - F.col("_m")  # sums around the median keep their digits
        shared = k * F.col("before") + k * (k + 1) / 2.0
        sums = kept.filter(x.between(F.col("_low"), F.col("_high"))).groupBy(*cols).agg(
            F.sum("k").alias("_n"), F.sum(d * k).alias("_d"), F.sum(d * d * k).alias("_dd"), F.sum(x * k).alias("_t"), F.sum(x * shared).alias("_s"), F.min("before").alias("_b")
        )
        n = F.col("_n")
        gini = 2 * (F.col("_s") - F.col("_b") * F.col("_t")) / (n * F.col("_t")) - (n + 1) / n
        sums = sums.filter(n >= least).select(*cols, F.sqrt(F.greatest((F.col("_dd") - F.col("_d") * F.col("_d") / n) / (n - 1), F.lit(0.0))).alias("std"), F.when(F.col("_t") != 0, gini).alias("gini"))
        one = joined(one, sums, cols)
        if wide is not None:
            ranges = places(wide, cols, "_width", weight="_rows")
            median = joined(percentiles_of(ranges, cols, "_width", (0.5,), "_w"), ranges.groupBy(*cols).agg(F.sum("k").alias("_k")), cols)
            one = joined(one, median, cols, "left").withColumns({"range_pct": F.coalesce(F.col("_k") * 100.0 / F.col("n"), F.lit(0.0)), "range_median": F.col("_w")[0]}).drop("_w", "_k")
        out.append(one.select(F.lit(level).alias("scope"), *[F.col(c) if c in cols else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in every], *one.columns[len(cols) :]))
    return reduce(DataFrame.unionByName, out)


def with_percentiles(table: DataFrame, df: DataFrame, levels: dict[str, Sequence[str]], value: str, points: Sequence[float], name: str = "q", weight: str | None = None) -> DataFrame:
    """`table`, made by core.scopes from `df`, with the percentiles of a value at each level as an array; `df` is read twice for
    each level."""
    every = list(dict.fromkeys(c for cols in levels.values() for c in cols))
    parts = []
    for level, cols in levels.items():
        q = narrowed_percentiles(known(df, every), cols, value, points, name, weight)
        parts.append(q.select(F.lit(level).alias("_scope"), *[(F.col(c) if c in cols else F.lit(None).cast(df.schema[c].dataType)).alias(f"_k_{c}") for c in every], name))
    same = [F.col("scope") == F.col("_scope"), *[F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in every]]
    return table.join(reduce(DataFrame.unionByName, parts), same, "left").drop("_scope", *[f"_k_{c}" for c in every])


def completeness(df: DataFrame, columns: Sequence[str], valid: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Share of values present per column, and of those within the given range: column, completeness, validity."""
    valid = valid or {}
    picked = [F.struct(F.lit(c).alias("column"), F.avg(F.col(c).isNotNull().cast("double")).alias("completeness"), (F.avg(F.col(c).between(*valid[c]).cast("double")) if c in valid else F.lit(None).cast("double")).alias("validity")) for c in columns]
    return df.agg(F.array(*picked).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each pair of columns, in one pass."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.agg(F.array(*pairs).alias("p")).select(F.explode("p").alias("x")).select("x.*")


def rate(part: Column, whole: Column) -> Column:
    return share(part, whole, 1.0)
