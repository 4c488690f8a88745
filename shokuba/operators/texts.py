"""Six questions to an advert's text: how much is template, what sets it apart, its tone, what it tells, whom it speaks to."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shokuba.operators.core import Kept, scopes, suppress
from shokuba.operators.postings import GRADES
from shokuba.operators.rules import plain_pattern
from shokuba.sources.scratch import written

Terms = Sequence[tuple[str, int]]

_NEGATIONS = "不非未無"
_UNKNOWN = "不明"
_BLANKS = " \t\r　"


@dataclass(frozen=True)
class Lexicon:
    """Weighted terms of the six questions; a term counts each time it occurs, but not right after a negation.

    template: texts that make a line template; legal: pattern of a line from which on all is template.
    difference: terms by category, sought in what is not template. tones, values: terms by name. told: weight and terms of
    what an advert should tell. people: for each kind of reader the terms of its groups.
    """

    template: Sequence[str]
    legal: str
    difference: Mapping[str, Terms]
    tones: Mapping[str, Terms]
    told: Mapping[str, tuple[int, Terms]]
    people: Mapping[str, Mapping[str, Terms]]
    values: Mapping[str, Terms]
    negations: str = _NEGATIONS
    marks: Mapping[str, str] = field(default_factory=dict)  # patterns that add two points each to a tone

    def everything(self) -> list[Terms]:
        return [*self.tones.values(), *(t for _, t in self.told.values()), *(t for g in self.people.values() for t in g.values()), *self.values.values()]


def _overlaps_itself(term: str) -> bool:
    return any(term.startswith(term[i:]) for i in range(1, len(term)))


def _add_up(row: np.ndarray, lines: Mapping[str, int], listed: Mapping[str, list[tuple[int, int]]]) -> None:
    for line, n in lines.items():
        for i, k in listed[line]:
            row[i] += k * n


def _arrays(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())


class Occurrences:
    """How often terms occur in a text, from one pass that lists them all; counted from the left without overlap."""

    def __init__(self, groups: Iterable[Terms], negations: str):
        terms = {t for g in groups for t, _ in g}
        self.negations = negations
        self.alone = {t for t in terms if _overlaps_itself(t)}  # a pass over every place would count these twice
        self.words = sorted(terms - self.alone)

    @property
    def apart(self) -> bool:
        """Whether no term goes over the end of a line."""
        return not any("\n" in x for x in (*self.words, self.negations))

    def lister(self) -> Callable[[str], list[tuple[int, int]]]:
        """A function of a text: which of `words` begin in it, not right after a negation, and how often; where several begin
        at a place, the longest."""
        if not self.words:
            return lambda text: []
        place = {w: i for i, w in enumerate(self.words)}
        lead = f"(?<![{''.join(map(re.escape, self.negations))}])" if self.negations else ""
        pattern = re.compile(f"{lead}(?=({'|'.join(map(re.escape, sorted(place, key=len, reverse=True)))}))")
        return lambda text: list(Counter(place[w] for w in pattern.findall(text)).items())

    def counts(self, text: Column) -> Column:
        """array<int>: how often `lister` finds each of `words`."""
        listed, apart, width = self.lister(), self.apart, len(self.words)

        @F.arrow_udf("array<int>")
        def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = Kept(listed)
            for batch in texts:
                out = np.zeros((len(batch), width), np.int32)
                for row, t in zip(out, batch):
                    t = t.as_py() or ""
                    _add_up(row, Counter(t.split("\n") if apart else [t]), known)
                yield _arrays(out)

        return count(text)

    def _count(self, term: str, counts: Column, text: Column) -> Column:
        """Occurrences of a term; a longer one that begins with it stands for both."""
        if term in self.alone:
            return self._alone(term, text)
        return reduce(lambda a, b: a + b, [F.coalesce(F.get(counts, F.lit(i)), F.lit(0)) for i, w in enumerate(self.words) if w.startswith(term)])

    def points(self, terms: Terms, counts: Column, text: Column) -> Column:
        """Sum of weights over all occurrences."""
        return reduce(lambda a, b: a + b, [self._count(t, counts, text) * w for t, w in terms], F.lit(0))

    def kinds(self, terms: Terms, counts: Column, text: Column) -> Column:
        """How many different terms occur."""
        return reduce(lambda a, b: a + b, [(self._count(t, counts, text) > 0).cast("int") for t, _ in terms], F.lit(0))

    def _alone(self, term: str, text: Column) -> Column:
        # an occurrence behind a negation is passed over as a whole, as any other one is
        passed = f"(?<=[{self.negations}])\\Q{term}\\E|" if self.negations else ""
        met = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{passed}(\\Q{term}\\E)"), 1)
        return F.size(F.filter(met, lambda x: x != ""))


def split_template(text: Column, template: Sequence[str], legal: str) -> Column:
    """struct<original,template>: the lines of a text, blanks around them cut and empty ones left out, in two texts. A line is
    template if it holds one of the texts, or lies at or behind the first line that matches `legal`."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(_BLANKS))), lambda x: x != "")
    texts = "|".join(f"\\Q{t}\\E" for t in template)
    start = F.array_position(F.transform(lines, lambda x: x.rlike(f"(?U){legal}")), F.lit(True)).cast("int")
    # nothing of the whole text is asked for inside the functions of a line, so the work is in proportion to the lines
    head = F.when(start > 0, F.slice(lines, F.lit(1), F.greatest(start - 1, F.lit(0)))).otherwise(lines)
    tail = F.when(start > 0, F.slice(lines, F.greatest(start, F.lit(1)), F.size(lines))).otherwise(F.array().cast("array<string>"))
    held = lambda x: x.rlike(texts) if texts else F.lit(False)
    return F.struct(
        F.array_join(F.filter(head, lambda x: ~held(x)), "\n").alias("original"),
        F.array_join(F.concat(F.filter(head, held), tail), "\n").alias("template"),
    )


def _asked_by_line(text: Column, template: Sequence[str], legal: str, whole: Occurrences, own: Occurrences) -> Column:
    """struct<whole,own,n>: counts of the whole text and of the original part of split_template, and the length of the
    template part. Each line is judged once in a task while it is kept; terms don't go over its end."""
    begins, list_whole, list_own, widths = re.compile(legal), whole.lister(), own.lister(), (len(whole.words), len(own.words))

    def judge(line: str) -> tuple[int, bool, bool]:
        x = line.strip(_BLANKS)
        return len(x), bool(begins.search(x)), any(t in x for t in template)

    @F.arrow_udf("struct<whole: array<int>, own: array<int>, n: int>")
    def ask(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judged, listed, listed_own = Kept(judge), Kept(list_whole), Kept(lambda line: list_own(line.strip(_BLANKS)))
        for batch in texts:
            out, sizes = [np.zeros((len(batch), w), np.int32) for w in widths], np.zeros(len(batch), np.int32)
            for r, t in enumerate(batch):
                lines = (t.as_py() or "").split("\n")
                _add_up(out[0][r], Counter(lines), listed)
                mine, after, size, n = [], False, 0, 0
                for line in lines:
                    length, legal_line, held = judged[line]
                    if length:
                        after = after or legal_line
                        if after or held:
                            size, n = size + length, n + 1
                        else:
                            mine.append(line)
                _add_up(out[1][r], Counter(mine), listed_own)
                sizes[r] = size + max(0, n - 1)
            yield pa.StructArray.from_arrays([*map(_arrays, out), pa.array(sizes)], names=["whole", "own", "n"])

    return ask(text)


def _top(scores: Mapping[str, Column], n: int = 1) -> Column:
    """The `n` names with the highest scores, first ones on ties, `不明` in place of those without points."""
    rows = F.sort_array(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, s) in enumerate(scores.items())]), False)
    return F.transform(F.slice(rows, 1, n), lambda r: F.when(r["s"] > 0, r["k"]).otherwise(_UNKNOWN))


def ask_texts(df: DataFrame, text: str, lexicon: Lexicon) -> DataFrame:
    """`df` with the answers for each text; rows whose text is null or empty are left out.

    template_ratio, diff_<category> and diff_total, tone_<name> and tone (the strongest), told_<category> (share of its
    terms that occur) and info (their weighted mean), people_<kind> (the group with most points), value_<name> and
    values (the three highest). Lines are judged one by one, and one that repeats once, if no term goes over the end of a
    line; otherwise what the original part and the whole text hold is listed by one pass each.
    """
    whole, own = Occurrences(lexicon.everything(), lexicon.negations), Occurrences(lexicon.difference.values(), lexicon.negations)
    out = df.filter(F.length(text) > 0)
    if whole.apart and own.apart and not own.alone and plain_pattern(lexicon.legal):
        out = out.withColumn("_asked", _asked_by_line(F.col(text), lexicon.template, lexicon.legal, whole, own))
        out = out.withColumns({"_whole_counts": F.col("_asked.whole"), "_own_counts": F.col("_asked.own"), "_n": F.col("_asked.n"), "_own": F.lit(None).cast("string")}).drop("_asked")
    else:
        out = out.withColumn("_parts", F.array(split_template(F.col(text), lexicon.template, lexicon.legal)))
        out = out.withColumns({"_own": F.col("_parts")[0]["original"], "_n": F.length(F.col("_parts")[0]["template"])}).drop("_parts")
        out = out.withColumns({"_whole_counts": whole.counts(F.col(text)), "_own_counts": own.counts(F.col("_own"))})
    found, full = F.col("_whole_counts"), F.col(text)
    points = {f"diff_{n}": own.points(t, F.col("_own_counts"), F.col("_own")) for n, t in lexicon.difference.items()}
    extra = {n: 2 * F.regexp_count(full, F.lit(p)) for n, p in lexicon.marks.items()}
    points |= {f"tone_{n}": whole.points(t, found, full) + extra.get(n, F.lit(0)) for n, t in lexicon.tones.items()}
    points |= {f"told_{n}": F.least(F.lit(1.0), whole.kinds(t, found, full) / float(max(1, len(t)))) for n, (_, t) in lexicon.told.items()}
    points |= {f"people_{n}": _top({g: whole.points(t, found, full) for g, t in groups.items()})[0] for n, groups in lexicon.people.items()}
    points |= {f"value_{n}": whole.points(t, found, full) for n, t in lexicon.values.items()}
    out = out.withColumn("template_ratio", F.col("_n") / F.length(text)).withColumns(points)
    weight = float(sum(w for w, _ in lexicon.told.values())) or 1.0
    return out.withColumns({
        "diff_total": sum((F.col(f"diff_{n}") for n in lexicon.difference), F.lit(0)),
        "tone": _top({n: F.col(f"tone_{n}") for n in lexicon.tones})[0],
        "info": sum((F.col(f"told_{n}") * float(w) for n, (w, _) in lexicon.told.items()), F.lit(0.0)) / weight,
        "values": _top({n: F.col(f"value_{n}") for n in lexicon.values}, 3),
    }).drop("_own", "_n", "_whole_counts", "_own_counts")


def text_scopes(asked: DataFrame, levels: Mapping[str, Sequence[str]], job: Sequence[str], kinds: Sequence[str], least: int = 3) -> DataFrame:
    """At each level (the first is the nation's, by `job`), for groups of `least` texts or more: n, means and deviations of
    template_ratio, diff_total and info, the grade of the mean info, its gap to the nation's, and for each column of
    `kinds` the most frequent answer (first by name on ties) with its share; `不明` counts for no answer."""
    numbers = ["template_ratio", "diff_total", "info"]
    measures = [F.count("*").alias("n"), *[f(c).alias(f"{c}_{n}") for c in numbers for n, f in (("mean", F.avg), ("std", F.stddev_pop))]]
    every = list(dict.fromkeys(c for cols in levels.values() for c in cols))
    asked = written(asked.select(*every, *numbers, *kinds))  # read twice, and its texts are much work
    out = suppress(scopes(asked, dict(levels), measures), "n", least)
    keys = ["scope", *every]
    # answers are few, so their counts are small tables; one row for each level and group remains
    tall = asked.select(*every, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("answer")) for k in kinds])).alias("a")).select(*every, "a.*")
    counts = scopes(tall.filter(F.col("answer") != _UNKNOWN), {n: [*cols, "kind", "answer"] for n, cols in levels.items()}, [F.count("*").alias("c")])
    first = counts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy(F.desc("c"), "answer"))).filter("_r = 1")
    modes = first.groupBy(*keys).agg(*[f(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{n}") for k in kinds for n, c, f in (("mode", "answer", F.max), ("count", "c", F.max))])
    renamed = modes.select(*[F.col(k).alias(f"_{k}") for k in keys], *modes.columns[len(keys) :])
    out = out.join(renamed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys])
    for k in kinds:
        out = out.withColumns({f"{k}_mode": F.coalesce(f"{k}_mode", F.lit(_UNKNOWN)), f"{k}_pct": F.coalesce(F.col(f"{k}_count") * 100.0 / F.col("n"), F.lit(0.0))}).drop(f"{k}_count")
    grade = F.lit("D")
    for edge, name in reversed(GRADES):
        grade = F.when(F.col("info_mean") >= edge, F.lit(name)).otherwise(grade)
    nation = out.filter(F.col("scope") == next(iter(levels))).select(*job, F.col("info_mean").alias("_nation"))
    return out.join(nation, list(job), "left").withColumn("grade", grade).withColumn("gap", F.col("info_mean") - F.col("_nation")).drop("_nation")
