"""Aggregates over people and the places they want to work in.

People have an id, age, gender, residence (prefecture, municipality) and attributes; areas have a person id and a
place. Column names are arguments with defaults, so any tables of that shape do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shokuba.operators.core import cross, known, mode, outer_counts, share, top_n, with_share

PLACE = ("prefecture", "municipality")


def explode_areas(people: DataFrame, areas: str = "areas", keep: Sequence[str] = ("person_id",)) -> DataFrame:
    """One row per person and desired area; people without any are left out."""
    return people.select(*keep, F.explode(areas).alias("a")).select(*keep, "a.*")


def map_metrics(people: DataFrame, by: Sequence[str] = PLACE) -> DataFrame:
    """Per place: count, mean age, men, women, share of women among known genders, modal age group, mean counts."""
    return known(people, by).groupBy(*by).agg(
        F.count("*").alias("count"),
        F.avg("age").alias("avg_age"),
        F.count_if(F.col("gender") == "M").alias("male"),
        F.count_if(F.col("gender") == "F").alias("female"),
        share(F.count_if(F.col("gender") == "F"), F.count_if(F.col("gender").isin("M", "F")), 1.0).alias("female_ratio"),
        mode("age_group").alias("top_age_group"),
        F.avg("qualification_count").alias("avg_qualifications"),
    )


def top_share(df: DataFrame, by: Sequence[str], column: str, name: str = "top") -> DataFrame:
    """Per group the most frequent value (smallest on ties) and its share of the rows that have a value."""
    counts = with_share(cross(df, [*by, column]), "count", by, "share", 1.0)
    best = top_n(counts, by, [F.desc("count"), F.asc(column)], 1)
    return best.select(*by, F.col(column).alias(name), F.col("share").alias(f"{name}_share"))


def persona(df: DataFrame, dims: Sequence[str], measures: Sequence[Column] = (), within: Sequence[str] | None = None, person: str | None = None, place: Sequence[str] = ()) -> DataFrame:
    """People by any dimensions, with mean age and measures. person: count each person once per `place` and dims."""
    if person:
        df = df.dropDuplicates([person, *place])
    return cross(df, [*place, *dims], [F.avg("age").alias("avg_age"), *measures], within=within)


def supply_density(areas: DataFrame, by: Sequence[str]) -> DataFrame:
    """Demand for each place by the people who want it: count, mean age, licence holders, mean qualifications."""
    return known(areas, by).groupBy(*by).agg(
        F.count("*").alias("supply_count"),
        F.avg("age").alias("avg_age"),
        F.sum(F.col("has_license").cast("long")).alias("license_count"),
        F.avg("qualification_count").alias("avg_qualifications"),
    )


def demand_supply_gap(demand: DataFrame, supply: DataFrame, on: Sequence[str], smoothing: int = 1) -> DataFrame:
    """demand (rows that want a place) against supply (rows that live there): counts, ratio, gap.

    ratio = demand / (supply + smoothing); with smoothing 0 it is 0 where there is no supply. Null places are left out.
    """
    d = known(demand, on).groupBy(*on).agg(F.count("*").alias("demand_count"))
    s = known(supply, on).groupBy(*on).agg(F.count("*").alias("supply_count"))
    out = outer_counts(d, s, on)
    base = F.col("supply_count") + smoothing
    ratio = F.when(base != 0, F.col("demand_count").cast("double") / base).otherwise(0.0)
    return out.withColumn("demand_supply_ratio", ratio).withColumn("gap", F.col("demand_count") - F.col("supply_count"))


#: Least rarity score (1 / count) of each rank.
RARITY = ((1.0, "S"), (0.5, "A"), (0.2, "B"), (0.05, "C"))


def rarity(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """How rare a combination is: count, 1 / count and its rank."""
    out = cross(df, dims).withColumn("rarity_score", 1.0 / F.col("count"))
    rank = F.lit("D")
    for least, name in reversed(RARITY):
        rank = F.when(F.col("rarity_score") >= least, F.lit(name)).otherwise(rank)
    return out.withColumn("rarity_rank", rank)


def competition(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Profile of each place: total, modal age group and employment with shares, women, licences, mean qualifications."""
    totals = known(df, by).groupBy(*by).agg(
        F.count("*").alias("total"),
        share(F.count_if(F.col("gender") == "F"), F.count("*"), 1.0).alias("female_ratio"),
        F.avg(F.col("has_license").cast("double")).alias("license_rate"),
        F.avg("qualification_count").alias("avg_qualifications"),
    )
    return (
        totals.withColumn("male_ratio", 1 - F.col("female_ratio"))
        .join(top_share(df, by, "age_group", "top_age"), list(by), "left")
        .join(top_share(df, by, "employment", "top_employment"), list(by), "left")
    )


def add_missing_places(table: DataFrame, fallback: DataFrame, by: Sequence[str]) -> DataFrame:
    """`table` and those rows of `fallback` whose place it lacks."""
    return table.unionByName(fallback.join(table.select(*by), list(by), "left_anti"), allowMissingColumns=True)


def retention(df: DataFrame, item: str, by: Sequence[str] = PLACE, person: str = "person_id") -> DataFrame:
    """Holders of an item per place, each person once, and their share of the people there in percent."""
    total = known(df, by).groupBy(*by).agg(F.countDistinct(person).alias("total"))
    held = known(df, [*by, item]).groupBy(*by, item).agg(F.countDistinct(person).alias("count"))
    return held.join(total, list(by)).withColumn("retention_rate", F.round(share(F.col("count"), F.col("total")), 2))


def area_pairs(areas: DataFrame, person: str, place: str, region: str, most: int = 100, regions: int = 15, keep: Sequence[str] = ()) -> DataFrame:
    """Unordered pairs of distinct places that one person wants; people with 1, `most` or more places, or `regions` or
    more regions, are left out, which bounds the pairs of one person."""
    one = areas.select(person, place, region, *keep).dropDuplicates([person, place])
    fit = one.groupBy(person, region).agg(F.count("*").alias("n")).groupBy(person).agg(F.sum("n").alias("n"), F.count(region).alias("r")).filter((F.col("n") >= 2) & (F.col("n") < most) & (F.col("r") < regions)).select(person)
    # those left have fewer than `most` places each, so these are one row and become pairs where it lies
    one = one.join(fit, person, "left_semi").filter(F.col(place).isNotNull())
    own = one.groupBy(person).agg(F.collect_list(F.struct(F.col(place).alias("place"), *keep)).alias("_all"))
    a = own.select(person, "_all", F.explode("_all").alias("_a"))
    pairs = a.select(person, "_a", F.explode(F.filter("_all", lambda b: b["place"] > F.col("_a.place"))).alias("_b"))
    return pairs.select(person, F.col("_a.place").alias("place1"), *[F.col(f"_a.{k}").alias(k) for k in keep], F.col("_b.place").alias("place2"))


def older_density(people: DataFrame, by: Sequence[str]) -> DataFrame:
    """Density score 0.4 n + 30 x share qualified + 20 x share urgent, and its rank from 50, 30, 15 and 5 on."""
    out = known(people, by).groupBy(*by).agg(
        F.count("*").alias("count"),
        F.avg((F.col("qualification_count") > 0).cast("double")).alias("qualified"),
        F.avg(F.col("urgent").cast("double")).alias("urgent"),
    )
    score = F.col("count") * 0.4 + F.col("qualified") * 30 + F.col("urgent") * 20
    rank = F.when(score >= 50, "S").when(score >= 30, "A").when(score >= 15, "B").when(score >= 5, "C").otherwise("D")
    return out.withColumn("density_score", score).withColumn("density_rank", rank)


def diversity(df: DataFrame, by: Sequence[str], segment: str, shares: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Per place: dominant segment (the smallest on ties) and its share, number of segments, 1 - HHI of the shares, and
    the joint share of the segments named in `shares`."""
    parts = with_share(cross(df, [*by, segment]), "count", by, "p", 1.0)
    return parts.groupBy(*by).agg(
        F.sum("count").alias("total"),
        F.count("*").alias("segments"),
        F.min_by(segment, F.struct(-F.col("count"), segment)).alias("dominant"),
        F.max("p").alias("dominant_share"),
        (1 - F.sum(F.col("p") * F.col("p"))).alias("diversity"),
        *[F.sum(F.when(F.col(segment).isin(list(names)), F.col("p")).otherwise(0.0)).alias(n) for n, names in (shares or {}).items()],
    )


def urgency_profile(df: DataFrame, dims: Sequence[str], score: str = "urgency_score") -> DataFrame:
    """Counts, mean age and mean score by urgency and further dimensions."""
    return cross(df, dims, [F.avg("age").alias("avg_age"), F.avg(score).alias("avg_urgency_score")])


def application_potential(people: DataFrame) -> DataFrame:
    """People by potential band with shares. Score: 50, by age +10 under 30, +5 under 50, 5 a qualification (20 at
    most), 10 for a licence, 10 for two to five desired areas."""
    age = F.when(F.col("age") < 30, 10).when(F.col("age") < 50, 5).otherwise(0)
    score = 50 + age + F.least(F.col("qualification_count") * 5, F.lit(20)) + F.when(F.col("has_license"), 10).otherwise(0) + F.when(F.col("area_count").between(2, 5), 10).otherwise(0)
    band = F.when(score > 75, "high").when(score >= 60, "middle").otherwise("low")
    return cross(people.withColumn("potential", band), ["potential"], within=())


def roll_up(places: DataFrame, by: Sequence[str], count: str, means: Sequence[str]) -> DataFrame:
    """Summaries of places summed to larger ones; means are weighted by the count."""
    total = F.sum(F.col(count).cast("double"))
    return places.groupBy(*by).agg(F.sum(count).alias(count), *[F.try_divide(F.sum(F.col(m) * F.col(count)), total).alias(m) for m in means])


def segment_profile(df: DataFrame, segment: str, residence: str, top: int = 3) -> DataFrame:
    """Per segment: size, share, mean age, share of women, and its most frequent residences in order."""
    base = cross(df, [segment], [F.avg("age").alias("avg_age"), F.avg((F.col("gender") == "F").cast("double")).alias("female_share")], within=())
    best = top_n(cross(df, [segment, residence]), [segment], [F.desc("count"), F.asc(residence)], top, "place")
    names = best.groupBy(segment).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", residence))), lambda x: x[residence]), ";").alias("top_residences"))
    return base.join(names, segment)


def top_items(df: DataFrame, by: Sequence[str], item: str, n: int = 3, sep: str = ";") -> DataFrame:
    """The `n` most frequent items of each group as one text, most frequent first."""
    best = top_n(cross(df, [*by, item]), by, [F.desc("count"), F.asc(item)], n, "_place")
    return best.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", item))), lambda x: x[item]), sep).alias("top_items"))


def penetration_extremes(df: DataFrame, item: str, region: str, person: str, n: int = 3) -> DataFrame:
    """Per item: holders, the regions with most holders, and the regions where the smallest share of people holds it."""
    people = df.groupBy(region).agg(F.countDistinct(person).alias("people"))
    held = known(df, [item, region]).groupBy(item, region).agg(F.countDistinct(person).alias("holders")).join(people, region)
    held = held.withColumn("rate", share(F.col("holders"), F.col("people"), 1.0))
    most = top_items_by(held, item, region, [F.desc("holders"), F.asc(region)], n, "top_regions")
    least = top_items_by(held, item, region, [F.asc("rate"), F.asc(region)], n, "rare_regions")
    return held.groupBy(item).agg(F.sum("holders").alias("holders")).join(most, item).join(least, item)


def top_items_by(df: DataFrame, by: str, item: str, order: Sequence[Column], n: int, name: str) -> DataFrame:
    best = top_n(df, [by], order, n, "_place")
    return best.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_place", item))), lambda x: x[item]), ";").alias(name))


def local_competition(openings: DataFrame, seekers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of openings and of seekers in each place, and seekers' share over openings' share (0 without openings)."""
    out = outer_counts(openings, seekers, by)
    out = with_share(with_share(out, "openings", [], "opening_share", 1.0), "seekers", [], "seeker_share", 1.0)
    return out.withColumn("competition_ratio", F.when(F.col("opening_share") > 0, F.col("seeker_share") / F.col("opening_share")).otherwise(0.0))
