"""Word pairs by NPMI, bounded before they are made, against all pairs."""

import math
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from shokuba.operators.textmining import job_scopes, pair_npmi


def brute(docs, min_pair, least, top):
    n, df, both = len(docs), Counter(), Counter()
    for words in docs.values():
        df.update(words)
        both.update(combinations(sorted(words), 2))
    out = []
    for (a, b), k in both.items():
        if k >= min_pair and min(df[a], df[b]) >= max(3, min_pair):
            npmi = 1.0 if k == n else math.log2(k * n / (df[a] * df[b])) / -math.log2(k / n)
            if npmi >= least:
                out.append((-round(npmi, 9), -k, a, b))
    return sorted(out)[:top]


@pytest.mark.parametrize(("sample", "top"), [(1, 7), (2, 30), (5, 100), (50, 10_000)])
def test_scopes_match_all_pairs(spark, sample, top):
    r = random.Random(sample)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows, docs = [], {}
    for d in range(160):
        job, region = r.choice(["x", "y"]), r.choice(["p", "q", "r", None])
        text = set(r.choices(words, weights, k=r.randint(1, 12)))
        if d % 9 == 0:
            text |= {"same", "pair", "of", "copies"}
        if d % 4 == 0:
            text |= {"often", "together"}
        for scope in {"nation", region} - {None}:
            docs.setdefault((job, scope), {})[d] = text
        rows += [(d, job, region, w) for w in text for _ in range(r.randint(1, 2))]
    sizes = {k: len(v) for k, v in docs.items()}
    keep = {j: sorted((s for jj, s in docs if jj == j and s != "nation"), key=lambda s: (-sizes[j, s], s))[:2] for j in "xy"}
    docs = {k: v for k, v in docs.items() if k[1] == "nation" or k[1] in keep[k[0]]}
    df = spark.createDataFrame(rows, "doc long, job string, region string, token string").repartition(3)
    scoped = job_scopes(df, "job", "region", "doc", top=2).drop("region")
    got = pair_npmi(scoped, "doc", ["job", "scope"], least=0.15, top=top, sample=sample).collect()
    for key, group in docs.items():
        mine = sorted((-round(x.npmi, 9), -x.pair_count, x.word_a, x.word_b) for x in got if (x.job, x.scope) == key)
        assert mine == brute(group, 5, 0.15, top), key
    assert {(x.job, x.scope) for x in got} <= set(docs)


def test_without_groups_and_empty(spark):
    df = spark.createDataFrame([(d, w) for d in range(9) for w in ("a", "b", "c")] + [(d, "z") for d in range(9, 20)], "doc long, token string")
    got = [tuple(x)[:3] for x in pair_npmi(df, "doc", top=2, sample=1).collect()]
    assert got == [("a", "b", 9), ("a", "c", 9)]
    assert pair_npmi(df.limit(0), "doc").count() == 0


def test_words_always_together_need_no_pairs_of_documents(spark, monkeypatch):
    """A group whose best pairs are words of the same documents is done from counts; rows of one document count once."""
    from shokuba.operators import textmining as T

    texts = [(d, f"Aa bb cc x{d} y") for d in range(6)] + [(9, "aa bb"), (9, "cc bb"), (None, "y aa")]
    df = spark.createDataFrame(texts, "doc long, text string")
    want = [tuple(x) for x in pair_npmi(T.tokenise(df, ["doc"], "text", "[a-z]+"), "doc", top=1).collect()]
    monkeypatch.setattr(T, "_both", None)  # pairs within documents
    got = [tuple(x) for x in T.npmi_of_texts(df, "doc", "text", "[a-z]+", top=1).collect()]
    assert got == want and got[0][:3] == ("bb", "cc", 7)


@pytest.mark.parametrize("buckets", [1, 64])
def test_tf_idf_of_texts_counts_few_terms(spark, buckets):
    """The same as from tokens, with ties at the last term, null documents and empty texts; the tokens' table is not made."""
    from shokuba.operators import textmining as T

    r = random.Random(2)
    texts = [(d, " ".join(r.choices([f"w{chr(97 + i)}" for i in range(20)], [1 / (i + 1) for i in range(20)], k=30))) for d in range(36)]
    df = spark.createDataFrame([*texts, (None, "wa wb"), (50, ""), (51, None)], "doc long, text string")
    tokens = T.with_bigrams(T.tokenise(df, ["doc"], "text", "[a-z]+"), ["doc"])
    for terms in (15, 40, 3000):
        want = [(x.token, x.df, round(x.score, 9)) for x in T.tf_idf(tokens, "doc", terms=terms).collect()]
        got = T.tf_idf_of_texts(df, "doc", "text", "[a-z]+", terms=terms, buckets=buckets)
        assert [(x.token, x.df, round(x.score, 9)) for x in got.collect()] == want
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_few_pairs_are_candidates(spark, monkeypatch):
    """Words that share most of their documents give the floor, and pairs that can't reach it are not written."""
    from shokuba.operators import textmining as T

    r = random.Random(7)
    docs = {d: set() for d in range(200)}
    for i in range(60):
        *both, a, b = r.sample(range(200), 12)
        for d in both:
            docs[d] |= {f"a{i}", f"b{i}"}
        docs[a].add(f"a{i}")
        docs[b].add(f"b{i}")
    for i in range(300):
        for d in r.sample(range(200), 12):
            docs[d].add(f"x{i}")
    sizes, write = [], T.written

    def counted(df):
        out = write(df)
        sizes.extend([out.count()] if {"ia", "_t"} <= set(out.columns) else [])
        return out

    monkeypatch.setattr(T, "written", counted)
    df = spark.createDataFrame([("g", d, sorted(w)) for d, w in docs.items()], "g string, doc long, token array<string>")
    got = pair_npmi(df, "doc", ["g"], top=40, sample=4).collect()
    assert sorted((-round(x.npmi, 9), -x.pair_count, x.word_a, x.word_b) for x in got) == brute(docs, 5, 0.15, 40)
    assert len(sizes) == 1 and sizes[0] <= 100


def test_a_word_s_masks_never_lose_a_pair(spark):
    from shokuba.operators import textmining as T

    r = random.Random(3)
    held = {w: set(r.sample(range(900), r.choice([5, 40, 700]))) for w in range(12)}
    word = spark.createDataFrame([("g", w, d, len(x), 900) for w, x in held.items() for d in x], "g string, id long, doc long, df long, n long")
    both = T._both(T._sketches(word, ["g"], "doc").withColumn("one", F.lit(1)), ["g"], "one", [f"_m{i}" for i in range(8)])
    rows = both.select("ia", "ib", T._may_share("a", "b").alias("k"), T._may_share("b", "a").alias("l")).collect()
    assert len(rows) == 66 and all(min(x.k, x.l) >= len(held[x.ia] & held[x.ib]) for x in rows)
    assert any(x.k < len(held[x.ia]) for x in rows)


def test_scopes_do_not_shuffle_texts(spark):
    df = spark.createDataFrame([(d, "x", f"r{d % 3}", "text") for d in range(30)], "doc long, job string, region string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = job_scopes(df, "job", "region", "doc", top=2)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
