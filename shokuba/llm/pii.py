"""Personal data by base patterns and gradient-boosted candidates; DataFrame functions only.

Offsets come from marks: a pattern's matches are wrapped in MARK, the text is split at it, and the lengths of the parts
add up to code-point positions. Patterns of the contract are written so that Java's engine neither recurses nor tries
a stretch of characters twice; the comments say why they find the same spans.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shokuba.llm.common import stage, text_or_empty, union_all

KINDS = ("email", "ip", "card", "phone")
MARK, STOP = "\x01", "\x02"  # where a text has them they count as \x03, which no pattern accepts either

_LOCAL = rf"A-Za-z0-9._%+{STOP}-"
#: STOP stands before each dot that no label follows, so a domain's dots are those of its class. A match starts where
#: the characters before '@' start, or where the last match ended.
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@(?=[A-Za-z0-9-]++\.)[A-Za-z0-9.-]++"
_BAD_DOT = r"\.(?![A-Za-z0-9-])"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_OCTETS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)(?:\.|$)){4}$"
#: Chains of digits with single separators are maximal, so both their ends show in the characters around them.
_CHAIN_ENDS = r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9])|(?<=[0-9])(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: High recall: runs of digits and their separators, and addresses with written-out signs.
_LOOSE_NUMBER = r"(?<![0-9])\+?[0-9](?:[().\x20-]{0,3}[0-9])++"
_LOOSE_EMAIL = r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++\x20?(?:@|\(at\)|\[at\])\x20?[a-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[a-z0-9-]++)++"
#: Runs of letters and digits as keys and passwords are.
_LOOSE_SECRET = r"(?<![A-Za-z0-9])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_+/=-]{12,}+"
#: Words that announce a span just before it.
_CUE = r"(?i)(token|key|secret|passw|pwd|auth|tel|phone|fon|mobil|call|mail|contact|card|konto|account)[a-z]{0,12}[\x20:=.\"'\u00bb(-]{0,6}$"
_NEAR = 30  # characters before a candidate in which a cue may stand

_SPAN = "array<struct<start:bigint,end:bigint,s:string>>"
FEATURES = ("chars", "digits", "plus", "at", "dots", "hyphens", "blanks", "brackets", "groups", "longest", "letter_before", "letter_after", "line_start", "line_end", "first_digit", "letters", "upper", "hex", "changes", "cue", "quoted")


def _marked(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, f"{MARK}$0{MARK}")


def _spans(marked: Column) -> Column:
    """Marked stretches with code-point start and end: array<struct<start,end,s>>."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("inside"), F.expr(f"cast(array() as {_SPAN})").alias("out"))

    def step(acc: Column, part: Column) -> Column:
        clean = F.translate(part, STOP, "")
        end = acc["at"] + F.length(clean).cast("long")
        span = F.struct(acc["at"].alias("start"), end.alias("end"), clean.alias("s"))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.split(marked, MARK, -1), start, step, lambda acc: acc["out"])


def _none() -> Column:
    return F.expr(f"cast(array() as {_SPAN})")


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum holds: from the right, each second digit doubles, less 9 where it exceeds 9."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("i"), F.lit(0).alias("sum")),
        lambda acc, c: F.struct((acc["i"] + 1).alias("i"), (acc["sum"] + F.when(acc["i"] % 2 == 0, F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))).otherwise(
            (F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)) * 2 / 10).cast("int") + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)) * 2 % 10)).alias("sum")),
        lambda acc: acc["sum"],
    )
    return total % 10 == 0


def _length_between(digits: Column, low: int, high: int) -> Column:
    n = F.length(digits)
    return (n >= low) & (n <= high)


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind the spans of its pattern, leftmost and non-overlapping, without those that fail its test."""
    dotted = F.regexp_replace(text, _BAD_DOT, f"{STOP}$0")
    found = {
        "email": F.when(F.contains(text, F.lit("@")), _spans(_marked(dotted, _EMAIL))).otherwise(_none()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), _spans(_marked(text, _IP))).otherwise(_none()),
        "card": F.when(text.rlike(r"[0-9][\x20-]?[0-9]"), _spans(F.regexp_replace(text, _CHAIN_ENDS, MARK))).otherwise(_none()),
        "phone": F.when(F.contains(text, F.lit("+")), _spans(_marked(text, _PHONE))).otherwise(_none()),
    }
    tests = {
        "email": None,
        "ip": lambda x: x["s"].rlike(_OCTETS),
        "card": lambda x: F.when(_length_between(_digits(x["s"]), 12, 19), _luhn(_digits(x["s"]))).otherwise(False),
        "phone": lambda x: _length_between(_digits(x["s"]), 9, 15),
    }
    return {k: F.filter(found[k], tests[k]) if tests[k] else found[k] for k in KINDS}


def _clean(column: str = "text") -> Column:
    return F.translate(text_or_empty(column), MARK + STOP, "\x03\x03")


def _candidates(text: Column) -> Column:
    """Spans that may be personal data or secrets, overlapping ones too."""
    numbers = F.filter(F.when(text.rlike("[0-9]{2}"), _spans(_marked(text, _LOOSE_NUMBER))).otherwise(_none()), lambda x: F.length(_digits(x["s"])) >= 6)
    emails = F.when(text.rlike(r"(?i)@|\(at\)|\[at\]"), _spans(_marked(text, _LOOSE_EMAIL))).otherwise(_none())
    secrets = F.when(text.rlike("[0-9]"), _spans(_marked(text, _LOOSE_SECRET))).otherwise(_none())
    return F.concat(numbers, emails, secrets)


def _features(x: Column, text: Column) -> Column:
    """Format and context of a candidate; nothing that a base pattern tests (check sum, number range) is in it."""
    s = x["s"]
    before = F.when(x["start"] > 0, F.substring(text, x["start"].cast("int"), F.lit(1))).otherwise("\n")
    after = F.substring(text, (x["end"] + 1).cast("int"), F.lit(1))
    near = F.substring(text, F.greatest(x["start"] - _NEAR, F.lit(0)).cast("int") + 1, F.least(x["start"], F.lit(_NEAR)).cast("int"))

    def count(pattern: str) -> Column:
        return F.regexp_count(s, F.lit(pattern)).cast("double")

    values = (
        F.length(s).cast("double"), count("[0-9]"), s.startswith("+").cast("double"), count("@"), count(r"\."), count("-"), count(r"\x20"), count(r"[()\[\]]"),
        count("[0-9]+"), F.array_max(F.transform(F.split(s, "[^0-9]+"), lambda p: F.length(p))).cast("double"),
        before.rlike(r"[\p{L}0-9]").cast("double"), after.rlike(r"[\p{L}0-9]").cast("double"), before.rlike(r"[\n]").cast("double"), (F.length(after) == 0).cast("double"),
        F.coalesce(F.regexp_extract(s, "[0-9]", 0).try_cast("double"), F.lit(-1.0)),
        count("[A-Za-z]"), count("[A-Z]"), F.try_divide(count("[0-9A-Fa-f]"), F.length(s).cast("double")), count("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
        near.rlike(_CUE).cast("double"), before.rlike("[\"'=:]").cast("double"),
    )
    return F.struct(*[v.alias(n) for n, v in zip(FEATURES, values)])


def _tree(node, x: Column) -> Column:
    """A trained tree as nested conditions over the fields of x."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(x[FEATURES[split.featureIndex()]] <= float(split.threshold()), _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


def _rewritten(kind: str, spans: Column) -> Column:
    """The spans of a kind, and again as they look when they are hidden or shortened; places are those of the text."""
    def like(form) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), form(x["s"]).alias("s")))

    forms = {
        "email": [lambda s: F.replace(F.replace(s, F.lit("@"), F.lit(" (at) ")), F.lit("."), F.lit(" (dot) ")), lambda s: F.replace(s, F.lit("@"), F.lit("[at]"))],
        "ip": [],
        "card": [lambda s: F.regexp_replace(_digits(s), r"([0-9]{4})(?=[0-9])", "$1."), lambda s: F.regexp_replace(_digits(s), r"([0-9]{4})(?=[0-9])", "$1  ")],
        "phone": [lambda s: F.replace(s, F.lit("+"), F.lit("")), lambda s: F.translate(F.replace(s, F.lit("+"), F.lit("00")), "()", "")],
    }
    return F.concat(spans, *map(like, forms[kind]))


def _made(docs: DataFrame) -> DataFrame:
    """doc_id, t, x, label: made-up spans in the texts of two documents of three: keys of 16 to 47 characters and hidden
    addresses are positive; years, dates, times, prices and long fractions are negative."""
    h = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("key")), 256)
    pick = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20))
    part = lambda at, n: F.lpad(F.pmod(F.xxhash64("doc_id", F.lit(at)), F.lit(10**n)).cast("string"), n, "0")
    key = F.substring(h, F.lit(1), (16 + pick % 32).cast("int"))
    key = F.when(pick % 3 == 0, F.translate(key, "abcdef", "QxTmZk")).otherwise(key)
    word = lambda i: F.element_at(F.array(*[F.lit(w) for w in ("anna", "info", "j.smith", "sales", "lee", "mail", "shop", "example", "north")]), (F.pmod(F.xxhash64("doc_id", F.lit(i)), F.lit(9)) + 1).cast("int"))
    kinds = (
        (1.0, ("token = \"", "api_key: ", "secret=", "password: ", ""), [key]),
        (1.0, ("mail: ", "write to ", "contact ", ""), [F.concat(word(1), F.lit(" (at) "), word(2), F.lit(" (dot) com")), F.concat(word(1), F.lit("[at]"), word(2), F.lit(".org"))]),
        (0.0, ("in ", "of ", "(", ""), [F.concat(F.lit("19"), part(4, 2), F.lit("-20"), part(5, 2)), F.concat(F.lit("20"), part(4, 2), F.lit("-0"), part(5, 1), F.lit("-1"), part(6, 1)), F.concat(F.lit("1"), part(4, 1), F.lit(".30 - 1"), part(5, 1), F.lit(".45"))]),
        (0.0, ("about ", "= ", "at ", ""), [F.concat(F.lit("0."), part(4, 7)), F.concat(part(4, 3), F.lit("."), part(5, 3), F.lit("."), part(6, 3)), part(4, 7), F.concat(F.lit("version-"), part(4, 2), F.lit("-final-release"))]),
    )
    rows = []
    for i, (label, cues, forms) in enumerate(kinds):
        cue = F.element_at(F.array(*[F.lit(c) for c in cues]), (pick % len(cues) + 1).cast("int"))
        span = F.element_at(F.array(*forms), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(len(forms))) + 1).cast("int"))
        head = F.concat(F.substring("t", 1, 200), F.lit(" "), cue)
        start = F.length(head).cast("long")
        x = F.struct(start.alias("start"), (start + F.length(span)).alias("end"), span.alias("s"))
        rows.append(docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(6)) == i).select("doc_id", F.concat(head, span, F.lit(" "), F.substring("t", 201, 200)).alias("t"), x.alias("x"), F.lit(label).alias("label")))
    return union_all(rows)


class SpanModel:
    """Boosted trees as a column expression, and the score from which a candidate is redacted."""

    def __init__(self, trees: list, weights: list[float], threshold: float):
        self.trees, self.weights, self.threshold = trees, weights, threshold

    def score(self, x: Column) -> Column:
        margin = reduce(lambda a, b: a + b, [_tree(t, x) * w for t, w in zip(self.trees, self.weights)])
        return 1 / (1 + F.exp(-2 * margin))

    def accepts(self, x: Column) -> Column:
        return self.score(x) >= self.threshold


def train(docs: DataFrame, sample: int = 8_000, precision: float = 0.95, trees: int = 12, depth: int = 4) -> SpanModel | None:
    """Fit on the candidates of about `sample` documents, chosen by a hash of doc_id and read whole.

    Positive are the base spans that passed their test, the same spans rewritten as people hide or shorten them (written-out
    signs, no plus, dots between groups) in their own context, and made-up keys and addresses put into the texts. Negative
    are all candidates that overlap no base span and follow no cue, and made-up years, dates and amounts; candidates after
    a cue are left unlabelled. Two thirds of the
    documents train the trees; on the rest the threshold is set: the least score, in steps of 0.01 from 0.5, from which
    candidates are positive with at least `precision`. None if there is nothing to learn or no score is good enough.
    """
    rows = docs.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    picked = docs.filter(part < int((1 << 20) * min(1.0, sample / max(1, rows))) + 1).select("doc_id", _clean().alias("t"))
    spans = base_spans(F.col("t"))
    found = stage(picked.select("doc_id", "t", *[c.alias(k) for k, c in spans.items()]), "known")
    t = F.col("t")
    other = F.filter(_candidates(t), lambda x: ~F.exists(F.concat(*KINDS), lambda y: _overlaps(x, y)))
    negative = found.select("doc_id", "t", F.explode(other).alias("x"), F.lit(0.0).alias("label"))
    positive = [found.select("doc_id", "t", F.explode(_rewritten(k, F.col(k))).alias("x"), F.lit(1.0).alias("label")) for k in KINDS]
    data = union_all([negative, *positive, _made(found.select("doc_id", "t"))]).select("doc_id", _features(F.col("x"), t).alias("f"), "label").filter("label = 1 or f.cue = 0")
    data = stage(data.select((F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("test"), "label", "f.*"), "candidates")
    seen = {(r["test"], r["label"]): r["count"] for r in data.groupBy("test", "label").count().collect()}
    if len(seen) < 4:
        return None
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="v")
    fitted = GBTClassifier(featuresCol="v", labelCol="label", maxIter=trees, maxDepth=depth, seed=1).fit(vectors.transform(data.filter("not test")))
    model = SpanModel([t._call_java("rootNode") for t in fitted.trees], list(fitted.treeWeights), 2.0)
    step = F.floor(model.score(F.struct(*FEATURES)) * 100).cast("int")
    counts = data.filter("test").groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("label").alias("good")).orderBy(F.desc("step")).collect()
    n = good = 0
    for r in counts:
        n, good = n + r["n"], good + r["good"]
        if r["step"] >= 50 and good >= precision * n:
            model.threshold = r["step"] / 100
    return model if model.threshold <= 1 else None


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def find_personal_data(docs: DataFrame, model: SpanModel | None = None, fit: bool = True) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per row of `docs`.

    The counts and base_sha256 are those of the base spans. spans has these and what the model adds: candidates that
    it accepts and that overlap no base span, as kind `other`; it is sorted by start, then kind. Null text counts as
    empty; without spans the digest is that of the empty string. One pass without shuffle. A text's \\x01 and \\x02 count
    as another control character; the time for a text grows with its length and with the square of its matches only
    in copying their list.
    """
    if fit and model is None:
        model = train(docs.select("doc_id", "text"))
    found = docs.select("doc_id", _clean().alias("t"))
    found = found.select("doc_id", "t", *[c.alias(k) for k, c in base_spans(F.col("t")).items()])
    if model:
        scored = F.transform(_candidates(F.col("t")), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"), _features(x, F.col("t")).alias("f")))
        chosen = F.filter(scored, lambda x: model.accepts(x["f"]))
        every = F.concat(*KINDS)
        other = F.filter(chosen, lambda x: ~F.exists(every, lambda y: _overlaps(x, y)))
        other = F.array_distinct(F.transform(other, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["s"].alias("s"))))
    else:
        other = _none()

    def ranked(kind: str, spans: Column, rank: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    def joined(*spans: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(F.concat(*spans)), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = [ranked(k, F.col(k), i) for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(*base), 256).alias("base_sha256"),
        joined(*base, ranked("other", other, len(KINDS))).alias("spans"),
    )


def redact(docs: DataFrame, **options) -> DataFrame:
    """`docs` with the characters of all spans in text replaced by `*`; the spans are found in the same pass."""
    spans = find_personal_data(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text"), fit=False, **options)
    pairs = F.transform(F.split("spans", ","), lambda s: F.struct(F.get(F.split(s, ":"), 1).try_cast("int").alias("start"), F.get(F.split(s, ":"), 2).try_cast("int").alias("end")))
    hidden = F.aggregate(pairs, F.col("doc_id.text"), lambda t, x: F.overlay(t, F.repeat(F.lit("*"), x["end"] - x["start"]), x["start"] + 1, x["end"] - x["start"]))
    out = F.when(F.col("spans") == "", F.col("doc_id.text")).otherwise(hidden)
    return spans.withColumn("_text", out).select("doc_id.*", "_text").withColumn("text", F.col("_text")).drop("_text")
