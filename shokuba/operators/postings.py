"""Segment tables over job adverts: shares, bands and statistics at several levels at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shokuba.functions import experience
from shokuba.functions import postings as advert
from shokuba.functions.classes import AXES, KINDS
from shokuba.operators import rules
from shokuba.operators.core import bands, cross, known, scopes, share, suppress, top_n
from shokuba.operators.stats import percentiles, with_percentiles
from shokuba.sources.scratch import written


def level_shares(df: DataFrame, dims: Sequence[str], levels: dict[str, Sequence[str]], least: int = 5, within: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Share of each combination of `dims` at each level (grouping sets), for levels' groups of at least `least` rows.

    within: those of `dims` that part a group further, so shares add up to 100 for each of their values. weight: a column
    that says how many rows each row of `df` stands for."""
    every = list(dict.fromkeys(c for cols in levels.values() for c in cols))
    out = scopes(df, {n: [*cols, *dims] for n, cols in levels.items()}, [(F.sum(weight) if weight else F.count("*")).alias("count")])
    out = out.withColumn("total", F.sum("count").over(Window.partitionBy("scope", *every, *within)))
    return out.filter(F.col("total") >= least).withColumn("share_pct", share(F.col("count"), F.col("total")))


def axis_shares(df: DataFrame, axes: Sequence[str], levels: dict[str, Sequence[str]], least: int = 5, weight: str | None = None) -> DataFrame:
    """level_shares of several category columns at once, as axis and category; the shares of an axis add up to 100."""
    keys = list(dict.fromkeys(c for cols in levels.values() for c in cols))
    more = [weight] if weight else []
    picked = df.select(*keys, *more, *[F.col(a).cast("string").alias(a) for a in axes])
    return level_shares(picked.unpivot([*keys, *more], list(axes), "axis", "category").filter("category is not null"), ["axis", "category"], levels, least, ["axis"], weight)


def tag_frequency(df: DataFrame, tags: str, by: Sequence[str]) -> DataFrame:
    """Postings per tag and group, each posting once per tag, and their share of the group's postings (not of tags)."""
    total = known(df, by).groupBy(*by).agg(F.count("*").alias("total"))
    hits = known(df, by).select(*by, F.explode(F.array_distinct(tags)).alias("tag")).groupBy(*by, "tag").agg(F.count("*").alias("count"))
    return hits.join(total, list(by)).withColumn("share_pct", share(F.col("count"), F.col("total")))


def feature_frequency(df: DataFrame, by: Sequence[str], features: str = "features") -> DataFrame:
    """count, share and total of each group and feature found in it; `features` names each of a row's features once."""
    sizes = known(df, by).groupBy(*by).agg(F.count("*").alias("total"))
    hits = known(df, by).select(*by, F.explode_outer(features).alias("feature")).filter("feature is not null").groupBy(*by, "feature").agg(F.count("*").alias("count"))
    return hits.join(sizes, list(by)).withColumn("share", F.col("count") / F.col("total"))


def tag_combinations(df: DataFrame, tags: str, by: Sequence[str], most: int = 5, top: int = 30) -> DataFrame:
    """The `top` sets of tags per group: sorted, at least two, the first `most` of them."""
    sets = F.array_join(F.slice(F.array_sort(F.array_distinct(tags)), 1, most), "+")
    rows = known(df, by).filter(F.size(F.array_distinct(tags)) >= 2).withColumn("combination", sets)
    return top_n(cross(rows, [*by, "combination"]), by, [F.desc("count"), F.asc("combination")], top)


def flag_frequency(df: DataFrame, flags: Sequence[str], by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Rows that have each flag, per group, with their share; one pass, one row per group and flag. weight: a column that
    says how many rows each row stands for."""
    n = F.col(weight) if weight else F.lit(1).cast("long")
    one = known(df, by).groupBy(*by).agg(F.sum(n).alias("total"), *[F.sum(F.when(F.col(f), n).otherwise(0)).alias(f) for f in flags])
    out = one.unpivot([*by, "total"], list(flags), "flag", "count")
    return out.withColumn("share_pct", share(F.col("count"), F.col("total")))


def salary_stats(df: DataFrame, low: str, high: str, levels: dict[str, Sequence[str]], least: int = 3, means: Sequence[str] = ()) -> DataFrame:
    """At each level: count, mean and median of the lower and upper end, cut to whole units, and the means of further
    columns (days off, benefits); groups of `least` or more."""
    every = list(dict.fromkeys(c for cols in levels.values() for c in cols))
    # `df` is worked out once, and its rows are written as they come; all levels' sums are added up from those of the finest groups
    rows = written(known(df, [*every, low]).select(*dict.fromkeys([*every, low, high, *means])))
    sums = [f(c).alias(f"_{n}_{c}") for c in dict.fromkeys([low, high, *means]) for n, f in (("sum", F.sum), ("n", F.count))]
    base = rows.groupBy(*every).agg(F.count("*").alias("_rows"), *sums)

    def mean(c: str) -> Column:
        return F.sum(f"_sum_{c}") / F.sum(f"_n_{c}")

    ends = [mean(c).cast("long").alias(f"mean_{n}") for n, c in (("low", low), ("high", high))]
    out = scopes(base, levels, [F.sum("_rows").alias("n"), *ends, *[mean(c).alias(f"mean_{c}") for c in means]])
    for name, column in (("median_low", low), ("median_high", high)):
        out = with_percentiles(out, rows, levels, column, (0.5,), "_q").withColumn(name, F.col("_q")[0].cast("long")).drop("_q")
    return suppress(out, "n", least)


def salary_bands(df: DataFrame, value: str, edges: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Counts, shares and medians by band of a value; a band is named by its lower edge."""
    labels = [f"<{edges[0]:g}", *[f"{e:g}+" for e in edges]]
    out = df.withColumn("band", bands(value, edges, labels))
    median = percentiles(out, [*by, "band"], value, (0.5,)).select(*by, "band", F.col("q")[0].alias("median_value"))
    return cross(out, [*by, "band"], within=by).join(median, [*by, "band"], "left")


# Edges and names of pay bands by kind of pay; the last edge is the end of the last band.
PAY_BANDS = {
    "月給": ((0, 200000, 250000, 280000, 300000, 350000, 9999999), ("~20万", "20-25万", "25-28万", "28-30万", "30-35万", "35万+")),
    "時給": ((0, 1200, 1400, 1600, 1800, 2000, 99999), ("~1200円", "1200-1400円", "1400-1600円", "1600-1800円", "1800-2000円", "2000円+")),
}


def pay_by_shift(df: DataFrame, by: Sequence[str], kind: str, pay: str, shift: str, region: str, place: str, least: int = 10, few: int = 2) -> DataFrame:
    """Per `by`, kind of pay, region (and its places of `least` adverts or more), band of pay and shift type: count, median pay
    cut to a whole number, and total, the adverts of the region or place. Kinds of pay of fewer than `least` adverts in a
    group of `by`, and cells of fewer than `few`, are left out. Pay outside the bands and an unknown shift are `不明`.

    Region and place are two levels of one table, and the medians of both come from counts in order (stats.places).
    """
    band = F.lit("不明")
    for name, (edges, labels) in PAY_BANDS.items():
        for low, high, label in zip(edges, edges[1:], labels):
            band = F.when((F.col(kind) == name) & (F.col(pay) >= low) & (F.col(pay) < high), label).otherwise(band)
    named = F.when(F.length(F.trim(F.col(shift))) > 0, F.col(shift)).otherwise("不明")
    rows = known(df.filter(F.col(kind).isin(*PAY_BANDS)), [*by, region, pay]).select(*by, kind, region, place, pay, band.alias("band"), named.alias("shift"))
    # equal rows are counted first, so what follows moves counts, however many rows a kind of pay or a region has
    rows = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("_rows")))
    enough = rows.groupBy(*by, kind).agg(F.sum("_rows").alias("_n")).filter(F.col("_n") >= least).select(*by, kind)
    rows = rows.join(enough, [*by, kind])
    keys = [*by, kind, region, place]
    both = rows.withColumn(place, F.lit("")).unionByName(rows.filter(F.col(place).isNotNull()))  # "" is the region as a whole
    total = both.groupBy(*keys).agg(F.sum("_rows").alias("total")).filter((F.col(place) == "") | (F.col("total") >= least))
    cells = both.groupBy(*keys, "band", "shift").agg(F.sum("_rows").alias("count")).filter(F.col("count") >= few)
    median = percentiles(both, [*keys, "band", "shift"], pay, (0.5,), weight="_rows").select(*keys, "band", "shift", F.col("q")[0].cast("long").alias("median"))
    out = cells.join(total, keys).join(median, [*keys, "band", "shift"])
    return out.withColumn(place, F.when(F.col(place) != "", F.col(place)))


def grade_by_quartile(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """A-D by the quartile of a value (pay, or the composite of a text's quality) within its group, best first; quartiles
    are one row per group."""
    q = percentiles(df, by, value, (0.25, 0.5, 0.75), "_q")
    v = F.col(value)
    grade = F.when(v >= F.col("_q")[2], "A").when(v >= F.col("_q")[1], "B").when(v >= F.col("_q")[0], "C").when(v.isNotNull(), "D")
    return df.join(q, list(by), "left").withColumn("grade", grade).drop("_q")


def gap_to_national(df: DataFrame, by: Sequence[str], value: str, region: str) -> DataFrame:
    """Mean of a value per group and region, the mean over all regions, and the difference."""
    return (
        known(df, [*by, region]).groupBy(*by, region).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
        .join(known(df, [*by, region]).groupBy(*by).agg(F.avg(value).alias("national_mean")), list(by))
        .withColumn("gap", F.col("mean") - F.col("national_mean"))
    )


def hierarchy_counts(df: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Counts at each depth of a hierarchy of columns (rollup without the grand total); depth is the number of columns."""
    out = scopes(df, {str(i): levels[:i] for i in range(1, len(levels) + 1)}, [F.count("*").alias("count")], "depth")
    return out.withColumn("depth", F.col("depth").cast("int"))


def plausible(salary_min: Column, salary_max: Column, holidays: Column) -> Column:
    """Monthly pay of 50,000 or more, at most 2,000,000, holidays at most 365; missing upper values pass."""
    return (salary_min >= 50_000) & (salary_max.isNull() | (salary_max <= 2_000_000)) & (holidays.isNull() | (holidays <= 365))


def coverage(found: DataFrame, expected: DataFrame, key: str, least: float = 0.95) -> DataFrame:
    """Rows found per key against the expected number: rate, missing and whether it falls short."""
    n = found.groupBy(key).agg(F.count("*").alias("found"))
    out = expected.join(n, key, "left").fillna(0, ["found"])
    return out.withColumn("rate", share(F.col("found"), F.col("expected"), 1.0)).withColumn("missing", F.greatest(F.col("expected") - F.col("found"), F.lit(0))).withColumn("short", F.coalesce(F.col("rate") < least, F.lit(False)))


def match_addresses(df: DataFrame, geocodes: DataFrame, address: Column, shortened: Column) -> DataFrame:
    """Coordinates by the whole normalised address, else by the shortened one; geocodes has one row per address."""
    g = geocodes.select("address", "lat", "lng")
    out = df.withColumns({"_k1": address, "_k2": shortened})
    out = out.join(g.select(F.col("address").alias("_k1"), F.col("lat").alias("_lat1"), F.col("lng").alias("_lng1")), "_k1", "left")
    out = out.join(g.select(F.col("address").alias("_k2"), F.col("lat").alias("_lat2"), F.col("lng").alias("_lng2")), "_k2", "left")
    return out.withColumns({"lat": F.coalesce("_lat1", "_lat2"), "lng": F.coalesce("_lng1", "_lng2")}).drop("_k1", "_k2", "_lat1", "_lng1", "_lat2", "_lng2")


def grouped_elements(df: DataFrame, element: str, alias: DataFrame, groups: DataFrame) -> DataFrame:
    """Elements with the columns of their group; alias (element, whole) first makes cut forms whole. Both are dimension
    tables; elements without a group are left out."""
    out = df.join(alias.select(F.col("element").alias(element), "whole"), element, "left").withColumn(element, F.coalesce("whole", element)).drop("whole")
    return out.join(groups.withColumnRenamed("element", element), element)


#: Least information score of each grade.
GRADES = ((0.20, "A"), (0.14, "B"), (0.10, "C"))


def scored_scopes(df: DataFrame, levels: dict[str, Sequence[str]], measures: Sequence[Column], score: str, job: str, least: int = 3) -> DataFrame:
    """Measures at each level (the first one is the nation's) for groups of at least `least` rows, with the grade of
    `score` and its gap to the nation's of the same job."""
    out = suppress(scopes(df, levels, measures), "n", least)
    grade = F.lit("D")
    for edge, name in reversed(GRADES):
        grade = F.when(F.col(score) >= edge, F.lit(name)).otherwise(grade)
    nation = out.filter(F.col("scope") == next(iter(levels))).select(job, F.col(score).alias("_nation"))
    return out.join(nation, job, "left").withColumn("grade", grade).withColumn("gap", F.col(score) - F.col("_nation")).drop("_nation")


#: Fields of an advert whose texts are read together.
TEXT_FIELDS = (
    "headline", "job_description", "requirements", "benefits", "salary_detail", "working_hours", "holidays", "education_training", "selection_process", "staff_composition", "special_holidays",
    "welcome_requirements",
)


def enrich_postings(df: DataFrame) -> DataFrame:
    """Raw adverts with the columns that their classes read. Fields that `df` lacks count as null, and a column that it
    has already under the name of a result is replaced, but for employment_type, which is kept where it is known.

    all_text, tags, benefit flags (has_*) and benefits_score, employment_type, required_experience_years, age_limit,
    annual_holidays, bonus_count, content_richness_score, primary_task and tone, age_decade_primary, gender_signal,
    lifecycle_primary, exp_qual_segment, wh_shift_type, wh_overtime, holiday_pattern.
    """
    def field(name: str) -> Column:
        return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")

    def told(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) if name in out.columns else F.lit("")

    texts = [field(c) for c in TEXT_FIELDS]
    # each text is read in one pass for all patterns that are asked of it
    scans = {"all_text": rules.Scan(advert.advert_patterns()), "_work": rules.Scan(advert.content_patterns())}
    out = rules.with_scans(df.withColumns({"all_text": F.concat_ws(" ", *texts), "_work": field("job_description")}), scans)
    said, done = (scans[c].held(F.col(f"_hits_{c}")) for c in scans)
    out = out.withColumn("tags", F.array_join(advert.advert_tags(F.col("all_text"), said), ","))
    flags = advert.benefit_flags(F.col("all_text"), said)
    out = out.withColumns({n: c.cast("int") for n, c in flags.items()})
    hours, days = field("working_hours"), field("holidays")
    named = F.coalesce(advert.employment_type(field("employment_type")), advert.employment_type(field("employment_text")), advert.employment_in_salary(field("salary_detail")), F.lit(""))
    # structs are taken apart in a projection of their own, so that each is worked out once
    out = out.withColumns({
        "_content": F.array(advert.content(F.col("_work"), done)), "_ages": F.array(advert.decades(F.col("all_text"), said)), "_people": F.array(advert.gender_and_stage(F.col("all_text"), said)),
    }).drop("_work", *[f"_hits_{c}" for c in scans])
    return out.withColumns({
        "benefits_score": sum((F.col(n) for n in flags), F.lit(0)),
        "employment_type": named,
        "required_experience_years": F.coalesce(advert.required_years(field("requirements")), F.lit(0)),
        "age_limit": advert.age_limit(field("requirements")),
        "annual_holidays": advert.annual_holidays(days),
        "bonus_count": advert.bonus_months(F.concat_ws(" ", field("benefits"), field("salary_detail"))),
        "content_richness_score": experience.content_richness({c: F.col(c) for c in df.columns}),
        "primary_task": F.col("_content")[0]["primary"], "tone": F.col("_content")[0]["tone"],
        "age_decade_primary": F.col("_ages")[0]["primary"],
        "gender_signal": F.col("_people")[0]["signal"], "lifecycle_primary": F.col("_people")[0]["primary"],
        "exp_qual_segment": experience.experience_segment(field("requirements"), field("welcome_requirements"), field("job_description"), field("education_training"), field("headline"), told("tags"), field("service_type")),
        "wh_shift_type": advert.shift_type(hours), "wh_overtime": advert.overtime(hours), "holiday_pattern": advert.holiday_pattern(days),
    }).drop("_content", "_ages", "_people")


def classify_postings(df: DataFrame, axes: rules.Axes = AXES, kinds: Sequence[rules.Kind] = KINDS, least: float = 0.8) -> DataFrame:
    """Raw adverts enriched and classified, in one job without a shuffle: all columns of `enrich_postings` and of
    `rules.classify`."""
    return rules.classify(enrich_postings(df), axes, kinds, least)
