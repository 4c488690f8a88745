"""URL rules and a Bloom filter cascade; DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shokuba.llm.common import stage, union_all

#: Domain rules of the query: verdict, then host and path prefix.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
#: Hosts that are listed where no blocklist is passed: a label of several words joined by hyphens, as in names that are
#: made for search engines.
LISTED = r"(^|\.)[a-z0-9]+(-[a-z0-9]+)+(\.|$)"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty if it is null or has no `://`."""
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule and verdict of the longest rule that fits, else null. A rule fits its host and all subdomains where the
    path starts with the rule's. The rules are a parameter of at most some hundreds; equal lengths go by text."""
    rule = verdict = None
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, prefix = text.split("/", 1)
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{prefix}")
        rule = F.when(fits, F.lit(text)).otherwise(rule if rule is not None else F.lit(None).cast("string"))
        verdict = F.when(fits, F.lit(what)).otherwise(verdict if verdict is not None else F.lit(None).cast("string"))
    return rule, verdict


class Level:
    """One Bloom filter of the cascade: a one-row table with an array of 64-bit words, read as a scalar subquery."""

    def __init__(self, keys: DataFrame, n: int, number: int, rate: float):
        self.number, self.hashes = number, max(2, round(-log2(rate)))
        self.words = max(1, ceil(n * self.hashes / log(2) / 64))
        places = F.explode(F.array(*[self._place(F.col("key"), i) for i in range(self.hashes)]))
        bits = keys.select(places.alias("p")).groupBy(F.expr("cast(p div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
        every = keys.sparkSession.range(self.words).select(F.col("id").cast("int").alias("w"))
        row = every.join(bits, "w", "left").agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("a"))
        self.table = stage(row.select(F.col("a.bits").alias("bits")), f"bloom{number}")

    def _place(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.number * 64 + i)), F.lit(self.words * 64))

    def holds(self, key: Column) -> Column:
        bits = self.table.scalar()
        got = [F.getbit(F.element_at(bits, (self._place(key, i) / 64).cast("int") + 1), (self._place(key, i) % 64).cast("int")) == 1 for i in range(self.hashes)]
        return reduce(lambda a, b: a & b, got)


class Cascade:
    """Exact membership for every key of a universe, from Bloom filters alone.

    Level 1 holds the listed keys, level 2 the other keys of the universe that pass level 1, level 3 the listed keys
    that pass level 2, and so on until none is left. A key is listed if the first level that it does not pass is an
    even one. Level 1 lets so few others pass that level 2 is no larger than it, and further levels shrink by `rate`.
    """

    def __init__(self, universe: DataFrame, listed: DataFrame, rate: float = 0.03):
        self.levels: list[Level] = []
        inside, outside = stage(listed, "listed"), stage(universe.join(listed, "key", "left_anti"), "others")
        n, others = inside.count(), outside.count()
        first = min(rate, n / max(1, others))
        while n:
            level = Level(inside, n, len(self.levels) + 1, rate if self.levels else first)
            self.levels.append(level)
            inside, outside = stage(outside.filter(level.holds(F.col("key"))), "passed"), inside
            n = inside.count()

    def listed(self, key: Column) -> Column:
        """True if `key`, a key of the universe, is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            answer = F.when(~level.holds(key), F.lit(level.number % 2 == 0)).otherwise(answer)
        return answer


def parts_for(listed: int, others: int, max_bits: int) -> int:
    """In how many parts the keys are cut so that the filters of a part have about `max_bits` bits at most: the larger of
    the first two levels takes -log2(rate) / ln 2 bits a key, twice over for both."""
    rate = min(0.03, listed / max(1, others))
    return max(1, ceil(2 * listed * -log2(rate) / log(2) / max_bits)) if listed and rate < 1 else 1


def judge_pages(pages: DataFrame, listed: DataFrame | None = None, rules=RULES, max_bits: int = 1 << 27) -> DataFrame:
    """page_id, host, path, rule, verdict: one row per row of `pages`.

    The longest fitting rule decides; without one, a listed host is blocked and any other is allowed. listed: a table
    of hosts (key); by default the pages' hosts that match LISTED. Hosts are tested in a Bloom cascade over all hosts of
    `pages`, so the answer is exact and no row is joined. Where the filters would exceed `max_bits`, which bounds what is
    sent to the tasks, hosts are cut into parts by a hash; each part has its own cascade and reads its own rows. Null
    urls and those without `://` have an empty host and path, which no rule fits, and are allowed.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    universe = stage(rows.select(F.col("host").alias("key")).distinct(), "hosts")
    if listed is None:
        listed = universe.filter(F.col("key").rlike(LISTED))
    listed = stage(listed.select("key").distinct().join(universe, "key", "left_semi"), "listed")
    n = listed.count()
    parts = parts_for(n, universe.count() - n, max_bits)

    def own(df: DataFrame, key: str, part: int) -> DataFrame:
        return df.filter(F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts)) == part) if parts > 1 else df

    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = []
    for part in range(parts):
        cascade = Cascade(own(universe, "key", part), own(listed, "key", part))
        default = F.when(cascade.listed(F.col("host")), F.lit("block")).otherwise("allow")
        judged.append(own(rows, "host", part).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, default).alias("verdict")))
    return union_all(judged)
