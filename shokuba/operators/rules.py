"""Rules over adverts as data: many patterns found in one scan of a field, scores from tables of points, patterns of winners.

Every rule compiles to a Spark column and, from the same table, to SQL.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shokuba.operators.core import Kept

_MOST = 64  # different texts of a part of a pattern that are written out
_FEW = 16  # patterns of a scan up to which a text isn't worth moving
_REACH = 64  # most characters of a match that goes over the end of a sentence
#: What Java's (?U)\s matches, and what its dot does not.
_SPACE, _BREAKS = "\t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", "\n\r\x85\u2028\u2029"


# -- one scan for many patterns


def _texts(items: Iterable) -> list[str] | None:
    """All texts that a parsed part of a pattern can match; None if they are too many or not a finite set."""
    out = [""]
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            here: list[str] | None = [chr(arg)]
        elif name == "IN" and all(str(x) == "LITERAL" for x, _ in arg):
            here = [chr(c) for _, c in arg]
        elif name == "SUBPATTERN":
            here = _texts(arg[3])
        elif name == "BRANCH":
            parts = [_texts(b) for b in arg[1]]
            here = None if None in parts else [t for p in parts for t in p]
        elif name == "MAX_REPEAT" and arg[1] == 1:
            inner = _texts(arg[2])
            here = inner and (inner if arg[0] else ["", *inner])
        else:
            here = None
        if not here or len(out) * len(here) > _MOST:
            return None
        out = [a + b for a, b in product(out, here)]
    return out


def required_texts(pattern: str) -> tuple[set[str], bool] | None:
    """Texts of which every match of `pattern` holds one, and whether holding one is enough; None if there are none."""

    def best(items: list) -> set[str] | None:
        found, at = [], 0
        while at < len(items):
            stop, texts = at, None
            while stop < len(items) and (longer := _texts(items[at : stop + 1])):
                stop, texts = stop + 1, longer
            if texts and all(texts):
                found.append(set(texts))
            if stop > at:
                at = stop
                continue
            (op, arg), at = items[at], at + 1
            name, inner = str(op), None
            if name == "SUBPATTERN":
                inner = best(list(arg[3]))
            elif name == "BRANCH":
                parts = [best(list(b)) for b in arg[1]]
                inner = None if None in parts else set().union(*parts)
            elif name == "MAX_REPEAT" and arg[0] > 0:
                inner = best(list(arg[2]))
            if inner:
                found.append(inner)
        return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=None)

    items = list(_parser.parse(pattern))
    if (whole := _texts(items)) and all(whole):
        return set(whole), True
    keys = best(items)
    return (keys, False) if keys else None


def plain_pattern(pattern: str, marks: str = "\n") -> bool:
    """Whether a pattern is made of characters, ranges of them, groups, choices and repeats alone, which Java and Python read
    alike, and can match none of `marks`; so it occurs in a text if it does in what lies between marks."""

    def plain(items: Iterable) -> bool:
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                good = chr(arg) not in marks
            elif name == "IN":
                good = all(str(x) == "LITERAL" and chr(c) not in marks or str(x) == "RANGE" and not any(c[0] <= ord(m) <= c[1] for m in marks) for x, c in arg)
            elif name == "SUBPATTERN":
                good = not arg[1] and not arg[2] and plain(arg[3])
            elif name == "BRANCH":
                good = all(map(plain, arg[1]))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                good = plain(arg[2])
            else:
                good = False
            if not good:
                return False
        return True

    parsed = _parser.parse(pattern)
    return parsed.state.flags & ~32 == 0 and plain(parsed)


def _translated(items: Iterable, atoms: list[str]) -> str | None:
    """A parsed pattern as Python writes what Java means by it, its characters and sets of them added to `atoms`; None if
    it has more than characters, sets, groups, choices and repeats."""
    out = []
    for op, arg in items:
        name = str(op)
        if name in ("LITERAL", "ANY", "IN"):
            parts = []
            for x, c in arg if name == "IN" else [(op, arg)]:
                part = {"LITERAL": lambda c: re.escape(chr(c)), "RANGE": lambda c: "-".join(re.escape(chr(x)) for x in c), "ANY": lambda c: f"^{_BREAKS}",
                        "CATEGORY": lambda c: {"CATEGORY_DIGIT": r"\d", "CATEGORY_SPACE": _SPACE}.get(str(c))}.get(str(x), lambda c: None)(c)
                if part is None:
                    return None
                parts.append(part)
            atoms.append(f"[{''.join(parts)}]")
            out.append(atoms[-1])
            continue
        plain = name in ("BRANCH", "MAX_REPEAT", "MIN_REPEAT") or name == "SUBPATTERN" and not arg[1] and not arg[2]
        inner = [_translated(x, atoms) for x in (arg[1] if name == "BRANCH" else [arg[-1]])] if plain else [None]
        if None in inner:
            return None
        out.append(f"(?:{'|'.join(inner)})")
        if name.endswith("REPEAT"):
            out.append(f"{{{arg[0]},{'' if arg[1] is _parser.MAXREPEAT else arg[1]}}}" + "?" * (name == "MIN_REPEAT"))
    return "".join(out)


def _starts(items: list) -> set[str]:
    """Texts with one of which every match of a parsed pattern begins; an empty one if they are not known."""
    texts: list[str] = []
    for stop in range(1, len(items) + 1):
        if (here := _texts(items[:stop])) is None:
            break
        texts = here if all(here) else texts
    if texts or not items:
        return set(texts) or {""}
    name, arg = str(items[0][0]), items[0][1]
    inner = {"SUBPATTERN": lambda: [arg[3]], "BRANCH": lambda: arg[1]}.get(name, list)()
    return set().union(*(_starts(list(b)) for b in inner)) or {""}


def _by_first(words: Iterable[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for w in words:
        out.setdefault(w[0], []).append(w)
    return out


@dataclass(frozen=True)
class Tried:
    """A pattern that is more than texts: its group, the texts it needs, the most characters of a match that may go over
    the end of a sentence (0: none does, -1: too many to tell) and the texts it begins with."""

    group: int
    needs: frozenset | None
    pattern: re.Pattern
    reach: int
    starts: frozenset


def tried_by_sentence(pattern: str, group: int, needs: set[str] | None, end: str) -> Tried | None:
    """A pattern that is sought in each sentence, and over the ends of sentences only as far as it reaches; None if Java and
    Python may read it in different ways."""
    parsed, atoms = _parser.parse(pattern), []
    text = None if parsed.state.flags & ~32 else _translated(parsed, atoms)
    if text is None:
        return None
    over = any(re.fullmatch(a, end) for a in atoms)
    reach = parsed.getwidth()[1] if over else 0
    starts = _starts(list(parsed)) if over else ()
    apart = needs is not None and not any(end in w for w in needs)  # so each of them lies in a sentence
    return Tried(group, frozenset(needs) if apart else None, re.compile(text), reach if reach <= _REACH else -1, frozenset(starts))


class Sentences:
    """The groups that occur in a text, from what occurs in its sentences, each of which is judged once while it is kept.

    A match within a sentence is found there. One that goes over its end begins in its last characters, with a text that
    the pattern begins with; only behind such a text the pattern is tried on the seam: as many characters of both sides as
    a match may have. A pattern whose matches may be of any length is tried on the whole text, if a text it needs occurs.
    """

    def __init__(self, exact: Mapping[str, Iterable[int]], tried: Sequence[Tried], end: str):
        self.exact, self.tried, self.end = exact, tried, end
        self.needing: dict[str, list[int]] = {}
        for i, t in enumerate(tried):
            for w in t.needs or ():
                self.needing.setdefault(w, []).append(i)
        self.always = [i for i, t in enumerate(tried) if t.needs is None]
        self.words = _by_first({*exact, *self.needing})
        self.reach = max((t.reach for t in tried), default=0)
        begins = {i: t.starts for i, t in enumerate(tried) if t.reach > 0}
        self.anywhere = [i for i, ws in begins.items() if any(not w or w[0] == end for w in ws)]
        self.opening: dict[str, list[int]] = {}
        for i, ws in begins.items():
            for w in ws if i not in self.anywhere else ():
                self.opening.setdefault(w, []).append(i)
        self.starts = _by_first(self.opening)
        self.known = Kept(self._judge)

    def _judge(self, s: str) -> tuple[frozenset, list[int]]:
        """Groups that occur in a sentence, and patterns that may begin in it and go over its end, or are for the whole text."""
        found = {w for at, c in enumerate(s) for w in self.words.get(c, ()) if s.startswith(w, at)}
        hits = {g for w in found for g in self.exact.get(w, ())}
        needed = {i for w in found for i in self.needing.get(w, ())}.union(self.always)
        for i in needed:
            if self.tried[i].group not in hits and self.tried[i].pattern.search(s):
                hits.add(self.tried[i].group)
        opened = {i for i in needed if self.tried[i].reach < 0}.union(self.anywhere)
        for at in range(max(0, len(s) - self.reach), len(s)):
            for w in self.starts.get(s[at], ()):
                if s.startswith(w, at) or w.startswith(s[at:]):
                    opened.update(self.opening[w])
        return frozenset(hits), [i for i in opened if self.tried[i].group not in hits]

    def __call__(self, text: str | None) -> list[int]:
        if text is None:
            return []
        pieces = text.split(self.end)
        judged = {p: self.known[p] for p in set(pieces)}
        hits = set().union(*(h for h, _ in judged.values()))
        opened = {p: left for p, (_, o) in judged.items() if o and (left := [i for i in o if self.tried[i].group not in hits])}
        whole = {i for left in opened.values() for i in left if self.tried[i].reach < 0} if opened else ()
        hits.update(self.tried[i].group for i in whole if self.tried[i].pattern.search(text))
        opened = {p: [i for i in left if i not in whole] for p, left in opened.items()} if whole else opened
        for at, p in enumerate(pieces[:-1], 1) if opened else ():
            if left := opened.get(p):
                stop, size = at, 0
                while stop < len(pieces) and size < self.reach:
                    size, stop = size + len(pieces[stop]) + 1, stop + 1
                seam = p[-self.reach :] + self.end + self.end.join(pieces[at:stop])[: self.reach]
                hits.update(t.group for t in map(self.tried.__getitem__, left) if t.group not in hits and t.pattern.search(seam))
        return sorted(hits)


def _quote(c: str) -> str:
    return rf"\x{{{ord(c):X}}}"


def scan_pattern(words: Iterable[str]) -> str:
    """A pattern whose first group, at every place of a text, is the longest of `words` that begins there.

    The words are a tree of characters; many branches are told apart by halving their range.
    """
    tree: dict = {}
    for w in words:
        node = tree
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def branches(chars: list[str], node: dict) -> str:
        if len(chars) <= 4:
            return "(?:" + "|".join(_quote(c) + pattern(node[c]) for c in chars) + ")"
        half = len(chars) // 2
        sides = ((f"(?=[{_quote(part[0])}-{_quote(part[-1])}])" + branches(part, node)) for part in (chars[:half], chars[half:]))
        return "(?:" + "|".join(sides) + ")"

    def pattern(node: dict) -> str:
        chars = sorted(c for c in node if c)
        if not chars:
            return ""
        return branches(chars, node) + ("?" if "" in node else "")

    return f"(?=({pattern(tree)}))"


class Scan:
    """All patterns of one field, compiled into one pass over its text; many are sought by sentences (Sentences) if they can be.

    `groups` names sets of patterns; a group occurs if one of its patterns does. Each pattern has texts it can't do
    without. The pass collects those that occur, overlapping ones too. A pattern that is nothing but such texts is
    decided by them; the others of a group are tried as one, and only where one of their texts occurs. A pattern
    without such a text is tried everywhere.
    """

    def __init__(self, groups: Mapping[str, Sequence[str]]):
        self.names = list(groups)
        self.place = {n: i for i, n in enumerate(self.names)}
        exact: dict[str, set[int]] = {}
        parts: list[tuple[str, int, set[str] | None]] = []  # every pattern that is tried
        self.tried: list[tuple[int, set[str] | None, str]] = []  # group, texts it needs, pattern
        for i, patterns in enumerate(groups.values()):
            rest, needs = [], set()
            for p in patterns:
                keys = required_texts(p)
                if keys and keys[1]:
                    for w in keys[0]:
                        exact.setdefault(w, set()).add(i)
                else:
                    rest.append(f"(?:{p})")
                    parts.append((p, i, keys and keys[0]))
                    needs = None if needs is None or not keys else needs | keys[0]
            if rest:
                self.tried.append((i, needs, "|".join(rest)))
        self.words = sorted(set(exact).union(*(n for _, n, _ in self.tried if n)))
        # where one text begins with another, the pass reports the longer one
        self.below = {w: [x for x in self.words if w.startswith(x)] for w in self.words}
        self.exact = {w: sorted(set().union(*(exact.get(x, ()) for x in self.below[w]))) for w in self.words}
        self.exact = {w: g for w, g in self.exact.items() if g}
        self.marks = [m for m in "。\n " if not any(m in w for w in self.words)]
        #: how the scan goes by sentences; None for few patterns, or if one of them can't be tried so
        self.sentences: tuple[dict, list[Tried], str] | None = None
        if sum(map(len, groups.values())) > _FEW:
            for end in (m for m in "。\n" if not any(m in w for w in exact)):
                tried = [tried_by_sentence(*p, end) for p in parts]
                if None not in tried:
                    self.sentences = ({w: sorted(g) for w, g in exact.items()}, tried, end)
                    break

    def found(self, text: Column) -> Column:
        """array<string> of the texts that occur; where one begins with another, the longer stands for both.

        None of them goes over a mark that none holds, so what lies between marks is read once where it repeats.
        """
        if not self.words:
            return F.array().cast("array<string>")
        text = F.coalesce(text, F.lit(""))
        if self.marks:
            text = F.array_join(F.array_distinct(F.split(text, f"[{''.join(self.marks)}]")), self.marks[0])
        return F.array_distinct(F.regexp_extract_all(text, F.lit(scan_pattern(self.words)), 1))

    def hits(self, found: Column, text: Column) -> Column:
        """array<int> of the places of the groups that occur in `text`, whose pass gave `found`; null has none."""
        parts = []
        if self.exact:
            groups = F.map_from_arrays(F.array(*map(F.lit, self.exact)), F.array(*[F.array(*map(F.lit, g)) for g in self.exact.values()]))
            parts.append(F.flatten(F.transform(found, lambda w: F.coalesce(groups[w], F.array().cast("array<int>")))))
        tried = []
        for i, needs, pattern in self.tried:
            hit = text.rlike(f"(?U){pattern}")
            if needs is not None:
                hit = F.arrays_overlap(found, F.array(*map(F.lit, sorted(x for x in self.words if any(w in needs for w in self.below[x]))))) & hit
            tried.append(F.when(hit, i))
        if tried:
            parts.append(F.array_compact(F.array(*tried)))
        return F.array_distinct(F.flatten(F.array(*parts))) if parts else F.array().cast("array<int>")

    def held(self, hits: Column) -> Callable[[Column, str], Column]:
        """Whether the text of `hits` holds a group, as a function of the text (which it leaves alone) and the group's name."""
        return lambda text, name: F.array_contains(hits, self.place[name])

    def count(self, names: Iterable[str], hits: Column) -> Column:
        """How many of the named groups are among `hits`."""
        return F.size(F.array_intersect(hits, F.array(*[F.lit(self.place[n]) for n in dict.fromkeys(names)])))


def hits_by_sentence(columns: Sequence[str], scans: Sequence[Scan]) -> Column:
    """struct of the `hits` of each column's scan, in one pass over all of them."""

    def judges() -> list[Sentences]:
        return [Sentences(*x) for x in parts]

    parts, kinds = [s.sentences for s in scans], pa.list_(pa.int32())
    names = [f"h{i}" for i in range(len(columns))]

    @F.arrow_udf(f"struct<{', '.join(f'{n}: array<int>' for n in names)}>")
    def judge(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        every = judges()
        for batch in batches:
            yield pa.StructArray.from_arrays([pa.array([f(t.as_py()) for t in texts], kinds) for f, texts in zip(every, batch)], names=names)

    @F.arrow_udf("struct<h0: array<int>>")
    def judge_one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        (f,) = judges()
        for texts in batches:
            yield pa.StructArray.from_arrays([pa.array([f(t.as_py()) for t in texts], kinds)], names=names)

    return (judge_one if len(columns) == 1 else judge)(*columns)


def counts_by_sentence(column: str, scan: Scan, wanted: Sequence[Sequence[str]]) -> Column:
    """array<int>: for each list of names how many of its groups occur in the column, from one pass; null has none."""
    parts, member = scan.sentences, np.zeros((len(scan.names), len(wanted)), np.int32)
    for i, names in enumerate(wanted):
        member[[scan.place[n] for n in names], i] = 1

    @F.arrow_udf("array<int>")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = Sentences(*parts)
        for texts in batches:
            out = np.zeros((len(texts), len(wanted)), np.int32)
            for i, t in enumerate(texts):
                out[i] = member[judge(t.as_py())].sum(axis=0)
            yield pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * len(wanted), out.ravel())

    return count(column)


def with_scans(df: DataFrame, scans: Mapping[str, Scan], prefix: str = "_hits_") -> DataFrame:
    """`df` with the hits of each scanned column; each text is read once however many patterns ask for it."""
    apart = [c for c, s in scans.items() if s.sentences]
    native = {c: s for c, s in scans.items() if not s.sentences}
    if apart:
        df = df.withColumn("_scanned", hits_by_sentence(apart, [scans[c] for c in apart]))
        df = df.withColumns({f"{prefix}{c}": F.col("_scanned")[f"h{i}"] for i, c in enumerate(apart)}).drop("_scanned")
    found = df.withColumns({f"_found_{c}": s.found(F.col(c)) for c, s in native.items()}) if native else df
    return found.withColumns({f"{prefix}{c}": s.hits(F.col(f"_found_{c}"), F.col(c)) for c, s in native.items()}).drop(*[f"_found_{c}" for c in native]) if native else found


@dataclass(frozen=True)
class Feature:
    """A named feature: found if any of its patterns occurs in any of its fields."""

    name: str
    fields: Sequence[str]
    patterns: Sequence[str]


def read_features(table: DataFrame) -> list[Feature]:
    """Features from a table of rules (name, field, pattern; one row each), as wide as a dictionary, in name order."""
    out: dict[str, tuple[dict, dict]] = {}
    for r in table.select("name", "field", "pattern").orderBy("name", "field", "pattern").collect():
        fields, patterns = out.setdefault(r["name"], ({}, {}))
        fields[r["field"]] = patterns[r["pattern"]] = None
    return [Feature(n, tuple(f), tuple(p)) for n, (f, p) in out.items()]


def text_features(df: DataFrame, features: Sequence[Feature], into: str = "features") -> DataFrame:
    """`df` with array<string> `into`: names of the features found, in the order given. Null fields hold none."""
    fields = dict.fromkeys(c for f in features for c in f.fields)
    scans = {c: Scan({f.name: f.patterns for f in features if c in f.fields}) for c in fields}
    place = {f.name: i for i, f in enumerate(features)}
    scanned = with_scans(df, scans)

    def renumbered(c: str) -> Column:
        return F.transform(f"_hits_{c}", lambda i: F.get(F.array(*[F.lit(place[n]) for n in scans[c].names]), i))

    every = F.array_sort(F.array_distinct(F.flatten(F.array(*map(renumbered, scans)))))
    names = F.transform(every, lambda i: F.get(F.array(*[F.lit(f.name) for f in features]), i))
    return scanned.withColumn(into, names).drop(*[f"_hits_{c}" for c in scans])


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def features_sql(features: Sequence[Feature]) -> str:
    """The same as text_features, as a DuckDB expression."""
    cases = (f"CASE WHEN {' OR '.join(f'coalesce(regexp_matches({c}, {_text(p)}), false)' for c in f.fields for p in f.patterns)} THEN {_text(f.name)} END" for f in features)
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


# -- scores


@dataclass(frozen=True)
class Spark:
    """What a measure reads when it becomes a column."""

    columns: frozenset
    counts: Mapping[tuple, str]  # column that holds how many of these patterns occur

    def column(self, name: str) -> Column:
        return F.col(name) if name in self.columns else F.lit(None)

    def count(self, patterns: Iterable[str]) -> Column:
        return F.col(self.counts[tuple(patterns)])


class Measure:
    """A number of an advert. Counts are never null; a plain number may be."""

    def column(self, at: Spark) -> Column:
        raise NotImplementedError

    def sql(self) -> str:
        raise NotImplementedError

    def patterns(self) -> Iterable[str]:
        return ()

    def parts_of(self, kind: type) -> list[Measure]:
        """Measures of a kind that this one is made of, itself included."""
        return [self] if isinstance(self, kind) else []


def _add(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


@dataclass(frozen=True)
class Tags(Measure):
    """How many of the names are in the tags."""

    names: Sequence[str]

    def column(self, at: Spark) -> Column:
        return _add(F.coalesce(F.contains(at.column("tags").cast("string"), F.lit(n)), F.lit(False)).cast("int") for n in self.names)

    def sql(self) -> str:
        return "(" + " + ".join(f"CAST(coalesce(contains(tags, {_text(n)}), false) AS INTEGER)" for n in self.names) + ")"


@dataclass(frozen=True)
class TagCount(Measure):
    """Number of tags between commas; no tags count as one."""

    def column(self, at: Spark) -> Column:
        return F.size(F.split(F.coalesce(at.column("tags").cast("string"), F.lit("")), ","))

    def sql(self) -> str:
        return "len(string_split(coalesce(tags, ''), ','))"


@dataclass(frozen=True)
class Texts(Measure):
    """How many of the patterns occur in the whole text."""

    found: Sequence[str]

    def column(self, at: Spark) -> Column:
        return at.count(self.found)

    def sql(self) -> str:
        return "(" + " + ".join(f"CAST(coalesce(regexp_matches(all_text, {_text(p)}), false) AS INTEGER)" for p in self.found) + ")"

    def patterns(self) -> Iterable[str]:
        return self.found


@dataclass(frozen=True)
class Number(Measure):
    name: str
    default: float | None = None

    def column(self, at: Spark) -> Column:
        c = at.column(self.name).try_cast("double")
        return c if self.default is None else F.coalesce(c, F.lit(float(self.default)))

    def sql(self) -> str:
        return f"TRY_CAST({self.name} AS DOUBLE)" if self.default is None else f"coalesce(TRY_CAST({self.name} AS DOUBLE), {self.default})"


@dataclass(frozen=True)
class Length(Measure):
    name: str

    def column(self, at: Spark) -> Column:
        return F.coalesce(F.length(at.column(self.name).cast("string")), F.lit(0))

    def sql(self) -> str:
        return f"coalesce(length({self.name}), 0)"


@dataclass(frozen=True)
class Is(Measure):
    name: str
    values: Sequence[str]

    def column(self, at: Spark) -> Column:
        return F.coalesce(at.column(self.name).cast("string").isin(*self.values), F.lit(False)).cast("int")

    def sql(self) -> str:
        return f"CAST(coalesce({self.name} IN ({', '.join(map(_text, self.values))}), false) AS INTEGER)"


@dataclass(frozen=True)
class Holds(Measure):
    """Whether a column holds one of the words."""

    name: str
    words: Sequence[str]

    def column(self, at: Spark) -> Column:
        c = at.column(self.name).cast("string")
        return reduce(lambda a, b: a | b, [F.coalesce(F.contains(c, F.lit(w)), F.lit(False)) for w in self.words]).cast("int")

    def sql(self) -> str:
        return "CAST((" + " OR ".join(f"coalesce(contains({self.name}, {_text(w)}), false)" for w in self.words) + ") AS INTEGER)"


@dataclass(frozen=True)
class Between(Measure):
    """Whether a measure lies between two numbers, both included; null lies nowhere."""

    of: Measure
    low: float
    high: float

    def column(self, at: Spark) -> Column:
        return F.coalesce(self.of.column(at).between(self.low, self.high), F.lit(False)).cast("int")

    def sql(self) -> str:
        return f"CAST(coalesce({self.of.sql()} BETWEEN {self.low} AND {self.high}, false) AS INTEGER)"

    def patterns(self) -> Iterable[str]:
        return self.of.patterns()

    def parts_of(self, kind: type) -> list[Measure]:
        return [*super().parts_of(kind), *self.of.parts_of(kind)]


@dataclass(frozen=True)
class Total(Measure):
    parts: Sequence[Measure]

    def column(self, at: Spark) -> Column:
        return _add(p.column(at) for p in self.parts)

    def sql(self) -> str:
        return "(" + " + ".join(p.sql() for p in self.parts) + ")"

    def patterns(self) -> Iterable[str]:
        return (x for p in self.parts for x in p.patterns())

    def parts_of(self, kind: type) -> list[Measure]:
        return [*super().parts_of(kind), *(x for p in self.parts for x in p.parts_of(kind))]


@dataclass(frozen=True)
class Points:
    """Points of a measure: `per` of it, of `most` of it at most; or those of the first step that it reaches, else none."""

    of: Measure
    per: float = 1
    most: float | None = None
    steps: Sequence[tuple[float, float]] = ()

    def column(self, at: Spark) -> Column:
        x = self.of.column(at)
        if self.steps:
            out = F.lit(0)
            for least, points in reversed(self.steps):
                out = F.when(x >= least, points).otherwise(out)
            return out
        return (x if self.most is None else F.least(x, F.lit(self.most))) * self.per

    def sql(self) -> str:
        x = self.of.sql()
        if self.steps:
            return "(CASE " + " ".join(f"WHEN {x} >= {least} THEN {points}" for least, points in self.steps) + " ELSE 0 END)"
        return f"({x if self.most is None else f'least({x}, {self.most})'} * {self.per})"


@dataclass(frozen=True)
class Score:
    """Sum of points from `base` on, `most` at most; -99 where `never` is not zero."""

    label: str
    points: Sequence[Points]
    base: float = 0
    most: float | None = None
    never: Measure | None = None

    def column(self, at: Spark) -> Column:
        x = _add([F.lit(self.base), *(p.column(at) for p in self.points)])
        x = x if self.most is None else F.least(x, F.lit(self.most))
        return (x if self.never is None else F.when(self.never.column(at) > 0, -99).otherwise(x)).cast("int")

    def sql(self) -> str:
        x = " + ".join([str(self.base), *(p.sql() for p in self.points)])
        x = x if self.most is None else f"least({x}, {self.most})"
        return f"CAST({x if self.never is None else f'CASE WHEN {self.never.sql()} > 0 THEN -99 ELSE {x} END'} AS INTEGER)"

    def patterns(self) -> Iterable[str]:
        return (x for p in self.points for x in p.of.patterns())


@dataclass(frozen=True)
class Kind:
    """A pattern of winners: for some axes the scores that may have won, and texts that weigh half a condition."""

    name: str
    winners: Mapping[str, Sequence[str]]
    labels: tuple[str, str, str]
    texts: Sequence[str] = ()


Axes = Mapping[str, Mapping[str, Score]]


def score_columns(df: DataFrame, axes: Axes, kinds: Sequence[Kind] = ()) -> DataFrame:
    """`df` with a column for each score. The text in all_text is scanned once for all patterns of scores and kinds."""
    every = [s for scores in axes.values() for s in scores.values()]
    scan = Scan({p: [p] for p in [*(p for s in every for p in s.patterns()), *(p for k in kinds for p in k.texts)]})
    wanted = [m.found for s in every for p in s.points for m in p.of.parts_of(Texts)] + [m.found for s in every if s.never for m in s.never.parts_of(Texts)] + [k.texts for k in kinds if k.texts]
    counts = {w: f"_count_{i}" for i, w in enumerate(dict.fromkeys(map(tuple, wanted)))}
    at = Spark(frozenset(df.columns), counts)
    # counts are columns of their own, since points with steps read them several times
    if scan.sentences:
        scanned = df.withColumn("_hits_all_text", counts_by_sentence("all_text", scan, list(counts)))
        scanned = scanned.withColumns({n: F.coalesce(F.get("_hits_all_text", F.lit(i)), F.lit(0)) for i, n in enumerate(counts.values())})
    else:
        scanned = with_scans(df, {"all_text": scan}).withColumns({n: scan.count(w, F.col("_hits_all_text")) for w, n in counts.items()})
    extra = {"_texts": F.array_compact(F.array(*[F.when(at.count(k.texts) > 0, k.name) for k in kinds if k.texts]).cast("array<string>"))} if kinds else {}
    return scanned.withColumns({n: s.column(at) for scores in axes.values() for n, s in scores.items()} | extra).drop("_hits_all_text", *counts.values())


def classify(df: DataFrame, axes: Axes, kinds: Sequence[Kind], least: float = 0.8) -> DataFrame:
    """`df` (all_text, tags and the columns the tables name) with its classes.

    Of each axis the highest score wins, the first one on ties: columns axis_<axis> and combined. The kind that
    meets most of its conditions, the first one on ties, is taken from `least` of them on: kind, label, label_short,
    label_proposal, match. Without one the names are put together from the winners and match is 0. Scores stay.
    """
    scored = score_columns(df, axes, kinds)
    winner = {a: F.array_max(F.array(*[F.struct(F.col(n).alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, n in enumerate(scores)]))["n"] for a, scores in axes.items()}
    won = scored.withColumns({f"axis_{a}": w for a, w in winner.items()})

    # a score's name says its axis, so the winners among a kind's scores are the conditions it meets
    table = F.array(*[F.struct(F.array(*[F.lit(x) for v in k.winners.values() for x in v]).alias("w"), F.lit(k.name).alias("name"), F.lit(len(k.winners) + 0.5 * bool(k.texts)).alias("n")) for k in kinds])
    winners = F.array(*[F.col(f"axis_{a}") for a in axes])

    def fit(k: Column) -> Column:
        return (F.size(F.array_intersect(winners, k["w"])) + F.when(F.array_contains("_texts", k["name"]), 0.5).otherwise(0.0)) / k["n"]

    best = F.array_max(F.transform(table, lambda k, i: F.struct(fit(k).alias("fit"), (-i).alias("i"))))
    names = F.array(*[F.struct(F.lit(k.name).alias("kind"), *[F.lit(x).alias(n) for n, x in zip(("label", "label_short", "label_proposal"), k.labels)]) for k in kinds])
    found = won.withColumn("_best", best)
    taken, chosen = F.col("_best.fit") >= least, F.get(names, -F.col("_best.i"))
    label = {a: reduce(lambda o, nv: F.when(F.col(f"axis_{a}") == nv[0], nv[1].label).otherwise(o), scores.items(), F.lit("")) for a, scores in axes.items()}
    made = fallback_names({a: F.col(f"axis_{a}") for a in axes}, label, lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    out = {n: F.when(taken, chosen[n]).otherwise(made[n]) for n in ("kind", "label", "label_short", "label_proposal")}
    out |= {"match": F.when(taken, F.round("_best.fit", 2)).otherwise(0.0), "combined": F.concat_ws("+", *[F.col(f"axis_{a}") for a in axes])}
    return found.withColumns(out).drop("_best", "_texts")


def fallback_names(won: Mapping, label: Mapping, join: Callable) -> dict:
    """Names of an advert that fits no kind, put together by `join` from strings and the winners' values."""
    a, b, c, d, e = (label[x] for x in "ABCDE")
    return {
        "kind": join("AUTO_", won["A"], "_", won["B"], "_", won["C"]),
        "label": join(b, "で", a, "の方が、", c, "な働き方で", d, "を実現できるポジション"),
        "label_short": join(a, " × ", b, " × ", c),
        "label_proposal": join(d, "を重視する", b, "の", a, "向け求人（採用姿勢:", e, "）"),
    }


def scores_sql(axes: Axes, source: str, keep: str) -> str:
    """DuckDB SELECT of `keep` and all scores over `source`."""
    return f"SELECT {keep}, " + ", ".join(f"{s.sql()} AS {n}" for scores in axes.values() for n, s in scores.items()) + f" FROM {source}"


def classes_sql(axes: Axes, kinds: Sequence[Kind], source: str, keep: str, least: float = 0.8) -> str:
    """The same as `classify`, without the scores, as a DuckDB query over `source`."""
    texts = {k.name: " OR ".join(f"coalesce(regexp_matches(all_text, {_text(p)}), false)" for p in k.texts) for k in kinds if k.texts}
    scored = scores_sql(axes, source, ", ".join([keep, *(f"({t}) AS texts_{n}" for n, t in texts.items())]))

    def winner(scores: Mapping[str, Score]) -> str:
        top = f"greatest({', '.join(scores)})"
        return "CASE " + " ".join(f"WHEN {n} = {top} THEN '{n}'" for n in scores) + " END"

    def fit(k: Kind) -> str:
        met = " + ".join(f"CAST(axis_{a} IN ({', '.join(map(_text, v))}) AS DOUBLE)" for a, v in k.winners.items())
        return f"({met} + CASE WHEN texts_{k.name} THEN 0.5 ELSE 0 END) / {len(k.winners) + 0.5}" if k.texts else f"({met}) / {len(k.winners)}"

    label = {a: f"CASE axis_{a} " + " ".join(f"WHEN '{n}' THEN {_text(s.label)}" for n, s in scores.items()) + " END" for a, scores in axes.items()}
    quoted = fallback_names({a: (f"axis_{a}",) for a in axes}, {a: (x,) for a, x in label.items()}, lambda *parts: " || ".join(_text(p) if isinstance(p, str) else f"({p[0]})" for p in parts))
    names = {n: f"CASE place {' '.join(f'WHEN {i + 1} THEN {_text(x)}' for i, x in enumerate(v))} END" for n, v in zip(("kind", "label", "label_short", "label_proposal"), zip(*[(k.name, *k.labels) for k in kinds]))}
    return f"""WITH scored AS ({scored}),
        won AS (SELECT *, {", ".join(f"{winner(s)} AS axis_{a}" for a, s in axes.items())} FROM scored),
        fits AS (SELECT *, [{", ".join(map(fit, kinds))}] AS fits FROM won),
        best AS (SELECT *, list_max(fits) AS top, list_position(fits, list_max(fits)) AS place FROM fits)
        SELECT {keep}, {", ".join(f"axis_{a}" for a in axes)}, {" || '+' || ".join(f"axis_{a}" for a in axes)} AS combined,
               {", ".join(f"CASE WHEN top >= {least} THEN {names[n]} ELSE {quoted[n]} END AS {n}" for n in names)}, CASE WHEN top >= {least} THEN round(top, 2) ELSE 0 END AS match
        FROM best"""
