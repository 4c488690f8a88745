"""Six questions to a text against a plain version."""

import random
import re

from pyspark.sql import functions as F

from shokuba.operators.texts import Lexicon, ask_texts, split_template

LEXICON = Lexicon(
    template=["定型", "a.b"], legal="個人情報|雇用期間", difference={"x": [("強み", 2), ("強", 1)], "y": [("々々", 3)]},
    tones={"casual": [("ね", 1)], "formal": [("ます", 2), ("ください", 1)]}, told={"pay": (3, [("月給", 2), ("賞与", 2)]), "time": (1, [("休憩", 1), ("休", 1), ("実働", 1)])},
    people={"age": {"young": [("若手", 3)], "old": [("シニア", 3), ("経験", 1)]}}, values={"a": [("成長", 1)], "b": [("安定", 1)], "c": [("経験", 2)], "d": [("々々", 1)]}, marks={"casual": "[♪☆]"},
)


def plain_count(text, term):
    n = at = 0
    while (at := text.find(term, at)) >= 0:
        n += not (at and text[at - 1] in "不非未無")
        at += len(term)
    return n


def plain_split(text):
    own, template, legal = [], [], False
    for line in text.split("\n"):
        line = line.strip(" \t\r　")
        if line:
            legal = legal or bool(re.search(LEXICON.legal, line))
            (template if legal or any(t in line for t in LEXICON.template) else own).append(line)
    return "\n".join(own), "\n".join(template)


def plain(text):
    own, template = plain_split(text)
    points = lambda terms, t: sum(plain_count(t, x) * w for x, w in terms)
    best = lambda scores, n=1: [k if v > 0 else "不明" for k, v in sorted(scores.items(), key=lambda kv: -kv[1])[:n]]
    tones = {k: points(t, text) for k, t in LEXICON.tones.items()}
    tones["casual"] += 2 * len(re.findall("[♪☆]", text))
    told = {k: (w, sum(plain_count(text, x) > 0 for x, _ in t) / len(t)) for k, (w, t) in LEXICON.told.items()}
    return {
        "template_ratio": len(template) / len(text), "diff_x": points(LEXICON.difference["x"], own), "diff_y": points(LEXICON.difference["y"], own), "tone": best(tones)[0], "tone_casual": tones["casual"],
        "info": sum(w * c for w, c in told.values()) / 4, "people_age": best({g: points(t, text) for g, t in LEXICON.people["age"].items()})[0], "values": best({k: points(t, text) for k, t in LEXICON.values.items()}, 3),
    }


def test_answers_match_plain(spark):
    r = random.Random(1)
    bits = ["定型", "a.b", "axb", "個人情報", "強み", "強", "々", "々々", "ね", "ます", "ください", "月給", "賞与", "休憩", "休", "実働", "若手", "シニア", "経験", "成長", "安定", "♪", "未", "無", "不", "\n", "\n", " ", "　\n", "文"]
    texts = ["".join(r.choices(bits, k=r.randint(1, 40))) for _ in range(300)] + ["個人情報", "々々々々々", "未経験", "\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None])], "id long, body string")
    got = {x["id"]: x for x in ask_texts(df, "body", LEXICON).collect()}
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        want = plain(t)
        for k, v in want.items():
            assert abs(got[i][k] - v) < 1e-9 if isinstance(v, float) else got[i][k] == v, (t, k)


def test_split_is_linear_in_lines(spark):
    text = "\n".join(f"行{i} 強み" for i in range(20_000))
    df = spark.createDataFrame([(text + "\n個人情報\nあと",)], "body string").select(split_template(F.col("body"), LEXICON.template, LEXICON.legal).alias("s"))
    s = df.first()["s"]
    assert s["original"] == text and s["template"] == "個人情報\nあと"


def test_script_tokens_match_plain(spark):
    from shokuba.operators.textmining import NOISE, SCRIPT_RUNS, script_tokens

    r = random.Random(2)
    texts = ["".join(r.choices("アイウー漢字語彙の、abc ・", k=r.randint(0, 40))) for _ in range(200)] + ["ーー", "訪問看護師募集中です", "電子カルテ導入", "漢" * 15, None]
    synonyms, stop = {"アイ": "愛", "漢字": "文字", "ーー": "線です"}, ["語彙", "アア"]
    want = []
    for i, t in enumerate(texts):
        for kind, p in SCRIPT_RUNS:
            for m in re.finditer(p, t or ""):
                w = synonyms.get(m.group(), m.group())
                if len(w) >= 2 and not (kind != "mixed" and w in stop) and not (kind != "kanji" and re.search(NOISE, w)):
                    want.append((i, kind, w))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, body string")
    got = script_tokens(df, ["id"], "body", synonyms, stop).orderBy("id", "position").collect()
    assert [(x.id, x.kind, x.token) for x in got] == want


def test_text_scopes_asks_each_text_once(spark):
    from pyspark.sql import functions as F

    from shokuba.operators.texts import text_scopes

    asked = spark.sparkContext.accumulator(0)

    def ask(i):
        asked.add(1)
        return float(i)

    df = spark.range(12, numPartitions=2).select(F.lit("a").alias("job"), F.col("id").alias("diff_total"), F.lit("calm").alias("tone"), F.lit(0.5).alias("info"), F.udf(ask, "double")("id").alias("template_ratio"))
    got = text_scopes(df, {"nation": ["job"]}, ["job"], ["tone"]).collect()
    assert [(r.n, r.template_ratio_mean, r.tone_mode, r.tone_pct) for r in got] == [(12, 5.5, "calm", 100.0)]
    assert asked.value == 12


def test_lines_that_repeat_are_judged_once(monkeypatch):
    from shokuba.operators import core
    from shokuba.operators import texts as T

    judged = []
    kept = core.Kept(lambda line: judged.append(line) or [(0, 1)])
    row = [0]
    for _ in range(3):
        T._add_up(row, {"a": 2, "b": 1, "x" * 300: 1}, kept)
    assert row == [12] and judged == ["a", "b", *["x" * 300] * 3]
    monkeypatch.setattr(core, "_KEPT", 2)
    assert kept["c"] and set(kept) == {"c"}  # what is kept stays bounded


def test_answers_by_line_match_those_of_whole_texts(spark, monkeypatch):
    from dataclasses import replace

    from shokuba.operators import texts as T

    r = random.Random(3)
    lexicon = replace(LEXICON, difference={"x": [("強み", 2), ("強", 1)]})
    bits = ["定型", "個人情報", "強み", "強", "ます", "休憩", "経験", "未", "\n", "\n", " ", "　\n", "\r\n", "文", "𠮷", "々々"]
    df = spark.createDataFrame([(i, "".join(r.choices(bits, k=r.randint(1, 60)))) for i in range(200)], "id long, body string")
    rows = lambda: sorted(map(str, ask_texts(df, "body", lexicon).collect()))
    calls, ask = [], T._asked_by_line
    monkeypatch.setattr(T, "_asked_by_line", lambda *a: calls.append(1) or ask(*a))
    by_line = rows()
    assert calls
    monkeypatch.setattr(T, "plain_pattern", lambda p: False)
    assert rows() == by_line and len(calls) == 1


def test_script_token_counts_match_rows_of_words(spark):
    from shokuba.operators.textmining import script_token_counts, script_tokens

    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([i, i, 7, None]), r.choice([None, "".join(r.choices("アイウー漢字語彙。、ab \n", k=r.randint(0, 60)))])) for i in range(200)]
    df = spark.createDataFrame(rows, "job string, id long, body string").repartition(3)
    synonyms, stop = {"アイ": "愛", "漢字": "文字", "ーー": "線です"}, ["語彙", "アア"]
    want = script_tokens(df, ["job", "id"], "body", synonyms, stop).groupBy("job", "kind", "token").agg(F.count("*").alias("count"), F.countDistinct("id").alias("docs"))
    got = script_token_counts(df, ["job"], "id", "body", synonyms, stop)
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # no row for each word
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
