"""Terms, associations and clusters of words and flags."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shokuba.operators.core import Kept, top_n
from shokuba.sources.scratch import cut_lineage, written


def tokenise(df: DataFrame, key: Sequence[str], text: str, pattern: str, least: int = 2, stop: Sequence[str] = (), synonyms: DataFrame | None = None) -> DataFrame:
    """One row per token: key, position, token. Tokens are matches of `pattern`, lower-cased, at least `least` long and
    not in `stop`; synonyms (token, canonical) is a dimension table that renames them."""
    out = df.select(*key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)).alias("position", "token"))
    if synonyms is not None:
        out = out.join(synonyms, "token", "left").withColumn("token", F.coalesce("canonical", "token")).drop("canonical")
    out = out.filter(F.length("token") >= least)
    return out.filter(~F.col("token").isin(*stop)) if stop else out


_COUNTS = 200_000  # words that a task adds up before it sends them

#: Runs of a script that are words, in the order in which they are taken; and marks that alone are no word.
SCRIPT_RUNS = [("katakana", r"[ァ-ヶー]{2,}"), ("kanji", r"[一-龥]{2,6}"), ("mixed", r"[一-龥]+[ァ-ヶー]+|[ァ-ヶー]+[一-龥]+")]
NOISE = r"^[ー\-─━┈┉┄・…。、！？\s　]+$"


def script_tokens(df: DataFrame, key: Sequence[str], text: str, synonyms: Mapping[str, str] | None = None, stop: Sequence[str] = (), least: int = 2) -> DataFrame:
    """Words of a text without blanks between them: key, position, kind, token.

    All katakana runs come first, then kanji runs of two to six characters (a longer run is cut from the left), then
    mixed runs of both scripts, which may hold words of the first two once more. A synonym takes the place of a word
    before it is judged: words shorter than `least` go, of katakana and kanji those in `stop`, and runs of marks only.
    A null text has none. Synonyms are a dictionary, small enough to be a literal; a table is joined by `tokenise`.
    """
    runs = [F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), 0), lambda t: F.struct(t.alias("token"))) for _, p in SCRIPT_RUNS]
    named = [F.transform(r, _named(kind)) for (kind, _), r in zip(SCRIPT_RUNS, runs)]
    out = df.select(*key, F.posexplode(F.concat(*named)).alias("position", "t")).select(*key, "position", "t.kind", "t.token")
    if synonyms:
        table = F.create_map(*[F.lit(x) for kv in synonyms.items() for x in kv])
        out = out.withColumn("token", F.coalesce(table[F.col("token")], "token"))
    return _judged(out, stop, least)


def script_token_counts(df: DataFrame, by: Sequence[str], doc: str, text: str, synonyms: Mapping[str, str] | None = None, stop: Sequence[str] = (), least: int = 2) -> DataFrame:
    """by, kind, token, count, docs: how often script_tokens finds each word, and in how many different documents.

    A task adds up what it reads, so no row for each word is made. What lies between marks is cut once where it repeats
    while it is kept, as no word goes over a mark. Documents whose key repeats are counted by their keys.
    """
    again = written(df.groupBy(doc).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select(doc, F.lit(True).alias("_again")))
    rows = df.select(*by, doc, F.coalesce(text, F.lit("")).alias("_text")).join(again, doc, "left").select(*by, doc, "_again", "_text")
    runs, renamed, types = [(kind, re.compile(p)) for kind, p in SCRIPT_RUNS], dict(synonyms or {}), [df.select(c).schema[0] for c in (*by, doc)]
    shown = T.StructType([*types[:-1], *(T.StructField(n, T.StringType()) for n in ("kind", "token")), *(T.StructField(n, T.LongType()) for n in ("count", "docs")), types[-1]])

    def cut(part: str) -> list[tuple[tuple[str, str], int]]:
        return list(Counter((kind, renamed.get(t, t)) for kind, p in runs for t in p.findall(part)).items())

    def run(batches):
        known, found, schema = Kept(cut), {}, None

        def flush():
            columns = list(zip(*((*k[:-1], *v, k[-1]) for k, v in found.items())))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema)], names=shown.names)

        for b in batches:
            kinds = [f.type for f in b.schema]
            schema = [*kinds[: len(by)], pa.string(), pa.string(), pa.int64(), pa.int64(), kinds[len(by)]]
            for *group, key, repeats, t in zip(*(c.to_pylist() for c in b.columns)):
                met: dict = {}
                for part, n in Counter(t.replace("\n", "。").replace(" ", "。").split("。")).items():
                    for word, k in known[part]:
                        met[word] = met.get(word, 0) + n * k
                for word, n in met.items():
                    at = found.setdefault((*group, *word, key if repeats else None), [0, 0])
                    at[0] += n
                    at[1] += not repeats and key is not None
                if len(found) > _COUNTS:
                    yield flush()
        if found:
            yield flush()

    parts = rows.mapInArrow(run, shown)
    out = parts.groupBy(*by, "kind", "token").agg(F.sum("count").alias("count"), (F.sum("docs") + F.countDistinct(doc)).alias("docs"))
    return _judged(out, stop, least)


def _judged(words: DataFrame, stop: Sequence[str], least: int) -> DataFrame:
    out = words.filter((F.length("token") >= least) & ~(F.col("token").rlike(NOISE) & (F.col("kind") != "kanji")))
    return out.filter((F.col("kind") == "mixed") | ~F.col("token").isin(*stop)) if stop else out


def _named(kind: str):
    return lambda t: F.struct(F.lit(kind).alias("kind"), t["token"].alias("token"))


def with_bigrams(tokens: DataFrame, key: Sequence[str]) -> DataFrame:
    """The tokens and each two of a document that follow each other, as one term; key names the document."""
    after = F.lead("token").over(Window.partitionBy(*key).orderBy("position"))
    pairs = tokens.withColumn("_after", after).filter("_after is not null").withColumn("token", F.concat_ws(" ", "token", "_after")).drop("_after")
    return tokens.unionByName(pairs)


def tf_idf(tokens: DataFrame, doc: str, group: Sequence[str] = (), min_df: int | None = None, max_df: float = 0.95, terms: int = 3000, top: int = 50) -> DataFrame:
    """Per group the `top` terms by mean weight over the documents that hold them: token, df, score.

    Weights: (1 + ln tf) x (ln((1 + n) / (1 + df)) + 1), of length 1 in each document; only the `terms` most frequent
    terms with document frequency from min_df to max_df x n count. min_df is a hundredth of the documents, 2 at least and
    5 at most, if not given.
    """
    tf = cut_lineage(tokens.groupBy(*group, doc, "token").agg(F.count("*").alias("tf")))  # read three times
    n = tf.groupBy(*group).agg(F.countDistinct(doc).alias("n"))
    df = tf.groupBy(*group, "token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    df = df.join(n, list(group)) if group else df.crossJoin(F.broadcast(n))  # n is one row
    least = F.lit(min_df) if min_df is not None else F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.col("n") / 100)))
    df = df.filter((F.col("df") >= least) & (F.col("df") <= F.col("n") * max_df))
    df = top_n(df, group, [F.desc("cf"), F.asc("token")], terms).withColumn("idf", F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    w = tf.join(df, [*group, "token"]).withColumn("w", (1 + F.ln("tf")) * F.col("idf"))
    norm = w.groupBy(*group, doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scored = w.join(norm, [*group, doc]).groupBy(*group, "token").agg(F.count("*").alias("df"), F.avg(F.col("w") / F.col("norm")).alias("score"))
    order = [F.desc(F.round("score", 9)), F.asc("token")]  # sums of equal weights differ in their last digits
    return top_n(scored, group, order, top) if group else scored.orderBy(*order).limit(top)


def _words(text: str, pattern: str, least: int) -> Column:
    return F.coalesce(F.filter(F.regexp_extract_all(F.lower(text), F.lit(pattern), 0), lambda w: F.length(w) >= least), F.array().cast("array<string>"))


def tf_idf_of_texts(docs: DataFrame, doc: str, text: str, pattern: str, least: int = 2, min_df: int | None = None, max_df: float = 0.95, terms: int = 3000, top: int = 50, buckets: int = 2**18) -> DataFrame:
    """tf_idf of the words of texts, as `tokenise` finds them, and of each two that follow each other (with_bigrams).

    Terms are counted where the text lies, not for each document first. The words alone give a frequency that the `terms`
    most frequent ones reach, and pairs are counted by a hash in `buckets` numbers: a pair can only be among them if its
    bucket reaches it. So only such pairs are counted one by one, and only the chosen terms by document. The result is the
    same for any number of buckets. If a document has several rows, their words are gathered first.
    """
    rows = docs.select(doc, _words(text, pattern, least).alias("w")).filter(F.size("w") > 0)
    if not docs.groupBy(doc).count().filter("count > 1").isEmpty():
        rows = rows.groupBy(doc).agg(F.flatten(F.collect_list("w")).alias("w"))
    n = cut_lineage(rows.agg(F.count(doc).alias("n")))  # one row
    size = F.size("w")
    pairs = F.zip_with(F.slice("w", F.lit(1), size - 1), F.slice("w", F.lit(2), size), lambda a, b: F.concat_ws(" ", a, b))

    def counted(found: DataFrame) -> DataFrame:
        """token, df, cf of arrays `t` of one document each."""
        once, every = found.select(F.explode(F.array_distinct("t")).alias("token"), F.lit(1).alias("d")), found.select(F.explode("t").alias("token"), F.lit(0).alias("d"))
        return once.union(every).groupBy("token").agg(F.sum("d").alias("df"), F.count_if(F.col("d") == 0).alias("cf"))

    few = F.lit(min_df) if min_df is not None else F.least(F.lit(5), F.greatest(F.lit(2), F.floor(F.col("n") / 100)))

    def fit(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(n), F.lit(True)).filter((F.col("df") >= few) & (F.col("df") <= F.col("n") * max_df))  # one row

    order = [F.desc("cf"), F.asc("token")]
    words = cut_lineage(fit(counted(rows.select(F.col("w").alias("t")))).orderBy(*order).limit(terms))
    low = words.agg(F.when(F.count("*") == terms, F.min("cf")).alias("low")).select(F.coalesce("low", F.lit(0)).alias("low"))
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets))
    each = rows.select(doc, F.explode(pairs).alias("token"))
    full = each.groupBy(bucket.alias("b")).agg(F.count("*").alias("c")).join(F.broadcast(low), F.lit(True)).filter(F.col("c") >= F.col("low"))  # one row
    full = cut_lineage(full.select("b"))  # `buckets` rows at most
    some = each.withColumn("b", bucket).join(F.broadcast(full), "b").groupBy(doc, "token").agg(F.count("*").alias("tf"))
    both = words.unionByName(fit(some.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))).select(*words.columns)).orderBy(*order).limit(terms)
    chosen = cut_lineage(both.select("token", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))
    tf = rows.select(doc, F.explode(F.concat("w", pairs)).alias("token")).join(F.broadcast(chosen), "token").filter(F.col(doc).isNotNull())  # `terms` rows
    w = tf.groupBy(doc, "token").agg(F.count("*").alias("tf"), F.first("idf").alias("idf")).withColumn("w", (1 + F.ln("tf")) * F.col("idf"))  # one idf for a token
    own = w.groupBy(doc).agg(F.collect_list(F.struct("token", "w")).alias("t"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))  # `terms` at most
    scored = own.select("norm", F.explode("t").alias("t")).groupBy("t.token").agg(F.count("*").alias("df"), F.avg(F.col("t.w") / F.col("norm")).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), F.asc("token")).limit(top)


def extra_keywords(tokens: DataFrame, doc: str, vocabulary: DataFrame, group: Sequence[str] = (), top: int = 50) -> DataFrame:
    """Per group the `top` terms outside of `vocabulary` (group, token) by tf x (ln(n / df) + 1): token, tf, df, score."""
    n = tokens.groupBy(*group).agg(F.countDistinct(doc).alias("n"))
    own = tokens.join(vocabulary.select(*group, "token").distinct(), [*group, "token"], "left_anti")
    df = own.groupBy(*group, "token").agg(F.count("*").alias("tf"), F.countDistinct(doc).alias("df"))
    df = df.join(n, list(group)) if group else df.join(F.broadcast(n), F.lit(True))  # one row
    df = df.withColumn("score", F.col("tf") * (F.ln(F.col("n") / F.col("df")) + 1)).drop("n")
    return top_n(df, group, [F.desc("score"), F.asc("token")], top) if group else df.orderBy(F.desc("score"), "token").limit(top)


def regional_keywords(tokens: DataFrame, doc: str, group: Sequence[str], region: str, ratio: float = 1.5, least: int = 3, top: int = 50) -> DataFrame:
    """Per group and region the `top` terms whose share of the region's documents is at least `ratio` times that of all
    regions, or that no other region has, in `least` or more documents: token, df, lift."""
    one = written(tokens.select(*group, region, doc, "token").distinct())  # read four times; texts are cut once
    keys = [*group, "token"]
    docs = one.select(*group, region, doc).distinct()
    n_region = docs.groupBy(*group, region).agg(F.count(doc).alias("n"))
    n_all = docs.groupBy(*group).agg(F.countDistinct(doc).alias("n_all"))
    df = one.groupBy(*keys, region).agg(F.count("*").alias("df"))
    df = df.join(one.groupBy(*keys).agg(F.countDistinct(doc).alias("df_all")), keys).join(n_region, [*group, region]).join(n_all, list(group))
    lift = (F.col("df") / F.col("n")) / (F.col("df_all") / F.col("n_all"))
    kept = df.filter(F.col("df") >= least).withColumn("lift", lift).filter((F.col("lift") >= ratio) | (F.col("df") == F.col("df_all")))
    return top_n(kept.select(*group, region, "token", "df", "lift"), [*group, region], [F.desc("lift"), F.desc("df"), F.asc("token")], top)


def keyword_layers(scores: DataFrame, group: str, ratio: float = 2.0, most: float = 0.5) -> DataFrame:
    """Terms by layer: universal (in more than `most` of the groups), specific (score at least `ratio` times the mean of
    the other groups that hold it, or held by one group only), else common."""
    total = scores.select(group).distinct().count()
    w = Window.partitionBy("token")
    held, sums = F.count("*").over(w), F.sum("score").over(w)
    others = F.when(held > 1, (sums - F.col("score")) / (held - 1))
    layer = F.when(held > total * most, "universal").when(others.isNull() | (F.col("score") >= others * ratio), "specific").otherwise("common")
    return scores.withColumn("held_by", held).withColumn("layer", layer)


def flag_association(df: DataFrame, flags: Sequence[str], support: float = 0.05, high: float = 1.5, low: float = 0.67) -> DataFrame:
    """Pairs of boolean columns in one pass: count, support, expected count, lift, phi; pairs near independence are left out."""
    sums = [F.count_if(F.col(a) & F.col(b)).alias(f"{a}|{b}") for i, a in enumerate(flags) for b in flags[i + 1 :]]
    one = df.agg(F.count("*").cast("double").alias("n"), *[F.count_if(F.col(f)).alias(f) for f in flags], *sums)
    pairs = [F.struct(F.lit(a).alias("flag_a"), F.lit(b).alias("flag_b"), F.col(a).cast("double").alias("ca"), F.col(b).cast("double").alias("cb"), F.col(f"{a}|{b}").alias("both")) for i, a in enumerate(flags) for b in flags[i + 1 :]]
    out = one.select("n", F.explode(F.array(*pairs)).alias("p")).select("n", "p.*")
    expected = F.col("ca") * F.col("cb") / F.col("n")
    spread = F.sqrt(F.col("ca") * F.col("cb") * (F.col("n") - F.col("ca")) * (F.col("n") - F.col("cb")))
    out = out.select("flag_a", "flag_b", "both", (F.col("both") / F.col("n")).alias("support"), expected.alias("expected"), F.try_divide(F.col("both").cast("double"), expected).alias("lift"), F.try_divide(F.col("n") * F.col("both") - F.col("ca") * F.col("cb"), spread).alias("phi"))
    return out.filter((F.col("support") >= support) & ((F.col("lift") > high) | (F.col("lift") < low)))


def job_scopes(df: DataFrame, job: str, region: str, doc: str, top: int = 10) -> DataFrame:
    """`df` once for its job in the whole nation and once for its region, if this is one of the job's `top` regions by
    documents: column scope is `nation` or the region. Rows without a job are left out, those without a region are the nation's only."""
    known = df.filter(F.col(job).isNotNull())
    sizes = known.filter(F.col(region).isNotNull()).groupBy(job, region).agg(F.countDistinct(doc).alias("_n"))
    best = top_n(sizes, [job], [F.desc("_n"), F.asc(region)], top).select(job, region)
    best = F.broadcast(best)  # `top` rows a job; else the texts would be shuffled
    return known.withColumn("scope", F.lit("nation")).unionByName(known.join(best, [job, region], "left_semi").withColumn("scope", F.col(region).cast("string")))


_ORDER = ("npmi", "pair_count", "word_a", "word_b")


def _npmi(pair_count: Column, da: Column, db: Column, n: Column) -> Column:
    p = pair_count / n
    return F.when(p < 1, F.log2(pair_count * n / (da * db)) / -F.log2(p)).otherwise(1.0)


def _both(word: DataFrame, group: Sequence[str], doc: str, more: Sequence[str] = ()) -> DataFrame:
    """Pairs of words of one document, the smaller id first: group, doc, ia, ib, da, db, n and for each of `more` two columns."""
    shared = [*group, doc]
    a = word.select(*shared, F.col("id").alias("ia"), F.col("df").alias("da"), "n", *[F.col(c).alias(f"{c}_a") for c in more])
    b = word.select(*shared, F.col("id").alias("ib"), F.col("df").alias("db"), *[F.col(c).alias(f"{c}_b") for c in more])
    return a.join(b, shared).filter(F.col("ia") < F.col("ib"))


_LANES, _SIGNS = 8, 4  # numbers of 64 bits in a word's mask; smallest hashes of its documents


def _sketches(word: DataFrame, group: Sequence[str], doc: str) -> DataFrame:
    """group, id, df, n, _m0, _m1, …: the bits that the hashes of a word's documents set, whatever their number; and _sign, the
    smallest of their hashes by each of some seeds, which words share the likelier the more of their documents they share."""
    at = F.pmod(F.xxhash64(doc, F.lit(3)), F.lit(64 * _LANES))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    masks = [F.coalesce(F.bit_or(F.when(F.floor(at / 64) == i, bit)), F.lit(0).cast("long")).alias(f"_m{i}") for i in range(_LANES)]
    return word.groupBy(*group, "id", "df", "n").agg(*masks, F.array(*[F.min(F.xxhash64(doc, F.lit(10 + i))) for i in range(_SIGNS)]).alias("_sign"))


def _may_share(a: str, b: str) -> Column:
    """The most documents of word a that can be b's too: a bit of a that b lacks stands for one or more that are not."""
    return F.col(f"d{a}") - sum(F.bit_count(F.col(f"_m{i}_{a}").bitwiseAND(F.bitwise_not(F.col(f"_m{i}_{b}")))) for i in range(_LANES))


def _shared(met: DataFrame, word: DataFrame, group: Sequence[str], doc: str, by: Sequence[str]) -> DataFrame:
    """by and pair_count of pairs of words: the documents of the rarer word that hold the other one too."""
    rarer = F.col("da") <= F.col("db")
    met = met.withColumns({"_a": F.when(rarer, F.col("ia")).otherwise(F.col("ib")), "_b": F.when(rarer, F.col("ib")).otherwise(F.col("ia"))})
    held = met.join(word.select(*group, doc, F.col("id").alias("_a")), [*group, "_a"]).join(word.select(*group, doc, F.col("id").alias("_b")), [*group, doc, "_b"])
    return held.groupBy(*by).agg(F.count("*").alias("pair_count"))


def _always_together(df: DataFrame, group: Sequence[str], top: int) -> DataFrame:
    """The best `top` pairs, by _ORDER, of words that occur in the same documents: group, word_a, word_b, pair_count, npmi.

    Words of one class share `same`, 128 bits of all their documents. A class gives pairs of its first top + 1 words only,
    since of its pairs the first `top` lie among these; and the best `top` classes hold the best `top` pairs.
    """
    by = [*group, "df", "same"]
    kept = top_n(df.filter("same is not null"), by, [F.asc("token")], top + 1)
    classes = kept.groupBy(*by).agg(F.array_sort(F.collect_list("token")).alias("w"), F.first("n").alias("n")).filter(F.size("w") > 1)  # one n for a group
    classes = classes.withColumn("npmi", _npmi(F.col("df"), F.col("df"), F.col("df"), F.col("n")))
    best = [F.desc("npmi"), F.desc("df"), F.asc(F.col("w")[0])]
    classes = top_n(classes, group, best, top) if group else classes.orderBy(*best).limit(top)
    pairs = classes.select(*group, "df", "npmi", "w", F.posexplode("w").alias("i", "word_a"))
    pairs = pairs.select(*group, "word_a", F.explode(F.slice("w", F.col("i") + 2, F.size("w"))).alias("word_b"), F.col("df").alias("pair_count"), "npmi")
    order = [F.desc(c) if c in _ORDER[:2] else F.asc(c) for c in _ORDER]
    return top_n(pairs, group, order, top) if group else pairs.orderBy(*order).limit(top)


def pair_npmi(tokens: DataFrame, doc: str, group: Sequence[str] = (), min_word: int = 3, min_pair: int = 5, least: float = 0.15, top: int = 100, sample: int = 32) -> DataFrame:
    """Per group the `top` word pairs by normalised pointwise mutual information (NPMI) of sharing a document; ties by
    pair_count, then by the words. Words in fewer than min_word documents go first, and those in fewer than min_pair.
    `tokens` has a row for each token (doc, token) or, as arrays, for each document.
    """
    held = tokens.withColumn("token", F.explode("token")) if dict(tokens.dtypes)["token"].startswith("array") else tokens
    return _pair_npmi(held.groupBy(*group, doc).agg(F.collect_set("token").alias("tokens")), doc, list(group), max(min_word, min_pair), min_pair, least, top, sample)


def npmi_of_texts(docs: DataFrame, doc: str, text: str, pattern: str, group: Sequence[str] = (), min_word: int = 3, min_pair: int = 5, least: float = 0.15, top: int = 100, sample: int = 32) -> DataFrame:
    """pair_npmi of the tokens of texts, as `tokenise` finds them. A text is a row, and its words are made different where it
    lies; only if a document has several rows its words are gathered."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(pattern), 0), lambda w: F.length(w) >= 2))
    sets = docs.select(*group, doc, F.coalesce(words, F.array().cast("array<string>")).alias("tokens")).filter(F.size("tokens") > 0)
    if not docs.groupBy(*group, doc).count().filter("count > 1").isEmpty():
        sets = sets.groupBy(*group, doc).agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    return _pair_npmi(sets, doc, list(group), max(min_word, min_pair), min_pair, least, top, sample)


def _pair_npmi(sets: DataFrame, doc: str, group: list[str], min_df: int, min_pair: int, least: float, top: int, sample: int) -> DataFrame:
    """pair_npmi of the sets of different tokens of documents (group, doc, tokens).

    No document pairs all its words. Words that occur in the same documents have an NPMI of 1, the highest, and are found
    from counts and hashes of their documents alone; a group with `top` such pairs is done. In the others, pairs of up to
    `sample` words whose documents have the same smallest hash are ranked by what their masks say, and the best of them
    are counted. If a group has `top` such pairs, the last one's NPMI t is reached by the whole result too. Two words reach
    t if they share (da db n^(t-1))^(1/(1+t)) documents
    or more. Their first common one, in the order of the documents' number of words, is then so early in both words'
    lists that as many can follow. So candidates meet in these documents only; there, masks of all their documents leave
    out pairs that can't share enough, before they are sent anywhere. What is shared is counted for the candidates that
    are left. The result is the same for any `sample`.
    """
    known = sets.filter(F.col(doc).isNotNull())
    n = cut_lineage(known.groupBy(*group).agg(F.count("*").alias("n")))
    one = [F.bit_xor(F.xxhash64(doc, F.lit(seed))).alias(f"_x{seed}") for seed in (1, 2)]
    df = sets.select(*group, doc, F.explode("tokens").alias("token")).groupBy(*group, "token").agg(F.count("*").alias("df"), F.count(doc).alias("_known"), *one).filter(F.col("df") >= min_df)
    df = df.join(F.broadcast(n), group) if group else df.join(F.broadcast(n), F.lit(True))  # a row for each group
    same = F.when(F.col("_known") == F.col("df"), F.struct("_x1", "_x2"))
    df = written(df.select(*group, "token", F.xxhash64("token").alias("id"), "df", "n", same.alias("same")))
    order = [F.desc(c) if c in _ORDER[:2] else F.asc(c) for c in _ORDER]
    certain = cut_lineage(_always_together(df, group, top))
    done = certain.groupBy(*group).agg(F.count("*").alias("k")).filter(F.col("k") >= top)
    if not group:
        if not done.isEmpty():
            return certain.select("word_a", "word_b", "pair_count", "npmi").orderBy(*order)
        left, words = n, df
        rows = known
    else:
        full = cut_lineage(done.select(*group))
        left = cut_lineage(n.join(F.broadcast(full), group, "left_anti"))
        if left.isEmpty():
            return certain.select(*group, "word_a", "word_b", "pair_count", "npmi")
        words = df.join(F.broadcast(left.select(*group)), group, "left_semi")  # groups are few
        rows = known.join(F.broadcast(left.select(*group)), group, "left_semi")
    rows = rows.select(*group, doc, F.size("tokens").alias("words"), F.explode("tokens").alias("token"))
    rows = rows.select(*group, doc, "words", F.xxhash64("token").alias("id"))
    word = written(rows.join(words.select(*group, "id", "df", "n"), [*group, "id"]).select(*group, "id", doc, "words", "df", "n"))

    # a floor for NPMI from pairs of words that are likely to share documents
    counted, lanes = [*group, "ia", "ib", "da", "db", "n"], [f"_m{i}" for i in range(_LANES)]
    sketches = written(_sketches(word, group, doc))
    alike = sketches.select(*group, "id", "df", "n", *lanes, F.posexplode("_sign").alias("_i", "_sign"))
    alike = top_n(alike, [*group, "_i", "_sign"], [F.asc("df"), F.asc("id")], sample)
    both = F.least(_may_share("a", "b"), _may_share("b", "a"))
    likely = _both(alike, [*group, "_i"], "_sign", lanes).withColumn("_npmi", _npmi(both, F.col("da"), F.col("db"), F.col("n"))).filter(both >= min_pair)
    best = [F.desc("_npmi"), F.desc(both), F.asc("ia"), F.asc("ib")]
    likely = top_n(likely, group, best, 4 * top * _SIGNS) if group else likely.orderBy(*best).limit(4 * top * _SIGNS)  # a pair may be there for each sign
    rough = _shared(cut_lineage(likely.select(*counted).distinct()), word, group, doc, counted).filter(F.col("pair_count") >= min_pair)
    rough = rough.select(*group, "ia", "ib", _npmi(F.col("pair_count"), F.col("da"), F.col("db"), F.col("n")).alias("npmi")).filter(F.col("npmi") >= least)
    if group:
        last = top_n(rough, group, [F.desc("npmi"), F.asc("ia"), F.asc("ib")], top, "_r").filter(F.col("_r") == top).select(*group, F.col("npmi").alias("_t"))
        bound = left.select(*group).join(last, group, "left")
    else:
        bound = rough.orderBy(F.desc("npmi")).limit(top).agg(F.count("*").alias("k"), F.min("npmi").alias("m")).select(F.when(F.col("k") == top, F.col("m")).alias("_t"))
    bound = cut_lineage(bound.withColumn("_t", F.least(F.greatest(F.coalesce("_t", F.lit(least)), F.lit(least)) * (1 - 1e-9), F.lit(1.0))))
    word = word.join(F.broadcast(bound), group) if group else word.join(F.broadcast(bound), F.lit(True))  # a row for each group

    def need(a: Column, b: Column) -> Column:
        """The fewest documents that words of a and b documents share, lowered by more than its rounding."""
        share = F.pow(a.cast("double") * b * F.pow(F.col("n").cast("double"), F.col("_t") - 1), 1 / (1 + F.col("_t")))
        return F.greatest(F.ceil(share * (1 - 1e-9)), F.lit(min_pair))

    # the rarest partner that a word can have asks for the fewest documents
    d, n_ = F.col("df"), F.col("n").cast("double")
    fewest = F.greatest(F.ceil(n_ * F.pow(d / n_, 1 / F.col("_t")) * (1 - 1e-9)), F.lit(min_pair))
    word_first = word.withColumn("_first", d - fewest + 1).filter("_first > 0")
    # the first documents of a word, in two steps, so that no word's documents are sorted in one task
    rank = [F.asc("words"), F.asc(F.xxhash64(doc)), F.asc(doc)]
    salted = word_first.withColumn("_s", F.pmod(F.xxhash64(doc), F.ceil(d / 50_000)))
    salted = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "id", "_s").orderBy(*rank))).filter("_r <= _first")
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "id").orderBy(*rank))).filter("_r <= _first")
    first = first.join(sketches.select(*group, "id", *lanes), [*group, "id"])
    met = _both(first, group, doc, ["_r", "_t", *lanes]).withColumnRenamed("_t_a", "_t")
    reach = F.greatest("da", "db") <= n_ * F.pow(F.least("da", "db") / n_, F.col("_t")) * (1 + 1e-9)
    least_both = need(F.col("da"), F.col("db"))
    late = (F.col("da") - F.col("_r_a") + 1 >= least_both) & (F.col("db") - F.col("_r_b") + 1 >= least_both)
    shared = (_may_share("a", "b") >= least_both) & (_may_share("b", "a") >= least_both)
    met = written(met.filter(reach & late & shared).select(*counted, "_t").distinct())
    pairs = _shared(met, word, group, doc, [*counted, "_t"]).filter(F.col("pair_count") >= min_pair)
    pairs = pairs.withColumn("npmi", _npmi(F.col("pair_count"), F.col("da"), F.col("db"), F.col("n"))).filter(F.col("npmi") >= F.greatest(F.col("_t"), F.lit(least)))
    names = words.select(*group, "id", "token")
    pairs = pairs.join(names.select(*group, F.col("id").alias("ia"), F.col("token").alias("ta")), [*group, "ia"])
    pairs = pairs.join(names.select(*group, F.col("id").alias("ib"), F.col("token").alias("tb")), [*group, "ib"])
    pairs = pairs.select(*group, F.least("ta", "tb").alias("word_a"), F.greatest("ta", "tb").alias("word_b"), "pair_count", "npmi")
    if not group:
        return pairs.orderBy(*order).limit(top)
    return top_n(pairs, group, order, top).unionByName(certain.join(F.broadcast(full), group, "left_semi").select(*group, "word_a", "word_b", "pair_count", "npmi"))


def association_rules(df: DataFrame, items: str, support: float = 0.01, confidence: float = 0.3, lift: float = 1.2) -> DataFrame:
    """Rules between the items of array column `items` by FP-growth."""
    from pyspark.ml.fpm import FPGrowth

    model = FPGrowth(itemsCol=items, minSupport=support, minConfidence=confidence).fit(df.select(F.array_distinct(items).alias(items)))
    return model.associationRules.filter(F.col("lift") > lift)
