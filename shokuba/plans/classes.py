"""Features, scores and classes of adverts, over texts that are made of all words of `documents`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shokuba.functions.classes import AXES, KINDS
from shokuba.functions.dictionaries import AGE_DECADES, BENEFITS, CONTENT, GENDER_SIGNALS, LIFE_STAGES, TAG_PATTERNS, TAG_SYNONYMS, TAGS, TONES
from shokuba.operators import rules
from shokuba.operators import textmining as T
from shokuba.operators.group_clusters import group_clusters
from shokuba.operators.postings import PAY_BANDS, classify_postings, feature_frequency, pay_by_shift
from shokuba.operators.texts import Lexicon, ask_texts, text_scopes
from shokuba.plans.frames import table
from shokuba.plans.queries import query, rounded

#: What a word of a document says in an advert.
PHRASES = [
    "未経験の方も一からお教えします", "イチから学べます", "しっかりサポートします", "資格をお持ちの方", "介護福祉士は必須です", "資格があれば応募できます", "経験が浅くても大丈夫", "即戦力の方", "管理職経験のある方", "実務経験3年以上",
    "ブランクのある方も歓迎", "現場復帰を応援", "新卒歓迎", "第二新卒も可", "20代が活躍", "若手が多い職場", "髪型は自由", "平均年齢は34歳", "40代も活躍", "家庭と両立できます",
    "経験を活かせる", "50代も歓迎", "シニア歓迎", "定年後の再雇用制度あり", "年齢は問いません", "幅広い年齢の仲間", "キャリアアップ", "昇進の機会", "リーダー候補", "ワークライフバランス",
    "残業ほぼなし", "在宅勤務も可", "フレックスタイム制", "主婦の方", "扶養内で働けます", "育休の実績", "ママさん歓迎", "Wワーク可", "短時間のパート", "退職金制度",
    "永年勤続表彰", "創業30年", "正社員登用制度", "想定年収450万円", "年収500万も", "高給与", "インセンティブあり", "お祝い金10万円", "上場企業", "全国20の事業所",
    "理念に共感", "地域に密着", "やりがいのある仕事", "アットホーム", "風通しの良い職場", "チームワーク", "先輩がフォロー", "直行直帰", "電子カルテ導入", "駅から徒歩5分",
    "研修が充実", "eラーニング", "資格取得支援制度", "福利厚生が充実", "面接1回", "複数名募集", "増員のため", "面接2回", "書類選考", "スタッフの声",
    "身体介護と入浴介助", "バイタル測定", "電話対応", "リハビリ", "シフト作成", "厨房での配膳", "健康診断の補助", "急募", "一緒に働きませんか", "ご応募お待ちします",
    "社会保険完備", "賞与年2回", "通勤手当", "制服貸与", "託児所あり", "日勤のみ", "夜勤専従", "3交替", "女性が活躍", "力仕事",
]
_TAGS = [
    "未経験可", "無資格可", "資格不問", "学歴不問", "新卒可", "ブランク可", "復職支援", "40代活躍", "50代活躍", "60代活躍", "年齢不問", "主夫・主婦OK", "フリーターOK", "副業OK", "WワークOK", "日勤のみ可",
    "残業ほぼなし", "4週8休以上", "即日勤務OK", "退職金あり", "資格取得支援", "研修制度あり", "育児支援あり", "家庭都合休OK", "年間休日120日以上", "オープン3年以内",
]
_FIELDS = ["headline", "job_description", "requirements", "benefits", "salary_detail", "working_hours", "education_training", "selection_process", "staff_composition"]
_QUALIFIED = ["未経験＋無資格", "未経験＋有資格", "経験者＋有資格", "経験者・資格必須", "不明"]
_DECADES = ["20代", "30代", "40代", "50代", "60代", "不明"]
_STAGES = ["育児期", "復職期", "キャリア形成期", "結婚・出産期"]
_JOBS = ["正職員", "パート・バイト", "契約職員"]


def advert_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One advert per document: each word is a phrase, the i-th of them in field i modulo their number; tags from words of
    seven letters; numbers from doc_id and n_chars."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    phrases, tags = F.array(*[F.lit(p) for p in PHRASES]), F.array(*[F.lit(t) for t in _TAGS])

    def code(w: Column) -> Column:
        return F.ascii(w) * 5 + F.length(w) * 11

    def pick(values: list, by: Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (by % len(values)).cast("int"))

    def every(k: int) -> Column:
        return F.array_join(F.filter("said", lambda p, at: at % len(_FIELDS) == k), "。")

    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", words.alias("words"))
    d = d.withColumn("said", F.transform("words", lambda w: F.get(phrases, code(w) % len(PHRASES))))
    n, i = F.col("n_chars"), F.col("doc_id")
    return d.select(
        "doc_id", F.coalesce("lang", F.lit("none")).alias("job_type"), F.coalesce("source", F.lit("none")).alias("prefecture"),
        *[every(k).alias(f) for k, f in enumerate(_FIELDS)],
        F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("words", lambda w: F.length(w) == 7), lambda w: F.get(tags, code(w) % len(_TAGS))))), ",").alias("tags"),
        (n % 5).alias("required_experience_years"), F.when(i % 3 > 0, 25 + n % 45).alias("age_limit"), (200000 + n % 40 * 5000).alias("salary_min"), (260000 + n % 50 * 5000).alias("salary_max"),
        (n % 6).alias("bonus_count"), F.when(i % 4 > 0, 100 + n % 30).alias("annual_holidays"), (i % 12).alias("content_richness_score"), (n % 25).alias("benefits_score"),
        pick(_JOBS, i).alias("employment_type"), pick(_QUALIFIED, n).alias("exp_qual_segment"), pick(_DECADES, i + n).alias("age_decade_primary"), pick(_STAGES, n).alias("lifecycle_primary"),
        pick(["残業なし", "残業あり"], n).alias("wh_overtime"), pick(["日勤のみ", "シフト制", "固定時間"], n).alias("wh_shift_type"), pick(["総合病院", "訪問看護"], i).alias("service_type"),
        *[(i % k).cast("int").alias(f) for k, f in ((2, "has_退職金"), (3, "has_賞与"), (5, "has_社会保険完備"))],
    ).withColumn("all_text", F.concat_ws(" ", *_FIELDS))


def _listed(values: list) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _pick(values: list, by: str) -> str:
    return f"{_listed(values)}[CAST(({by}) % {len(values)} AS INTEGER) + 1]"


_CODE = "(unicode(w) * 5 + length(w) * 11)"
TEXTS = rf"""split AS (SELECT doc_id, lang, source, n_chars, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
said AS (SELECT *, list_transform(words, lambda w: {_listed(PHRASES)}[CAST({_CODE} % {len(PHRASES)} AS INTEGER) + 1]) AS said FROM split),
fields AS (SELECT doc_id, coalesce(lang, 'none') AS job_type, coalesce(source, 'none') AS prefecture,
    {", ".join(f"coalesce(array_to_string(list_filter(said, lambda p, i: (i - 1) % {len(_FIELDS)} = {k}), '。'), '') AS {f}" for k, f in enumerate(_FIELDS))},
    coalesce(array_to_string(list_sort(list_distinct(list_transform(list_filter(words, lambda w: length(w) = 7), lambda w: {_listed(_TAGS)}[CAST({_CODE} % {len(_TAGS)} AS INTEGER) + 1]))), ','), '') AS tags,
    n_chars % 5 AS required_experience_years, CASE WHEN doc_id % 3 > 0 THEN 25 + n_chars % 45 END AS age_limit, 200000 + n_chars % 40 * 5000 AS salary_min, 260000 + n_chars % 50 * 5000 AS salary_max,
    n_chars % 6 AS bonus_count, CASE WHEN doc_id % 4 > 0 THEN 100 + n_chars % 30 END AS annual_holidays, doc_id % 12 AS content_richness_score, n_chars % 25 AS benefits_score,
    {_pick(_JOBS, "doc_id")} AS employment_type, {_pick(_QUALIFIED, "n_chars")} AS exp_qual_segment, {_pick(_DECADES, "doc_id + n_chars")} AS age_decade_primary, {_pick(_STAGES, "n_chars")} AS lifecycle_primary,
    {_pick(["残業なし", "残業あり"], "n_chars")} AS wh_overtime, {_pick(["日勤のみ", "シフト制", "固定時間"], "n_chars")} AS wh_shift_type, {_pick(["総合病院", "訪問看護"], "doc_id")} AS service_type,
    doc_id % 2 AS has_退職金, doc_id % 3 AS has_賞与, doc_id % 5 AS has_社会保険完備 FROM said),
texts AS MATERIALIZED (SELECT *, concat_ws(' ', {", ".join(_FIELDS)}) AS all_text FROM fields)"""


def _features() -> list[rules.Feature]:
    """All dictionaries of advert texts as features, each in the fields where it is written."""
    wide, work = ["headline", "job_description", "requirements", "benefits"], ["headline", "job_description", "staff_composition"]
    quote = {t: [*(TAG_SYNONYMS.get(t, [])), t] for t in TAGS}
    out = [rules.Feature(f"tag_{t}", wide, [*words, *([TAG_PATTERNS[t]] if t in TAG_PATTERNS else [])]) for t, words in quote.items()]
    out += [rules.Feature(n, ["benefits", "salary_detail", "education_training"], [p]) for n, p in BENEFITS.items()]
    for kind, groups, fields in (("age", AGE_DECADES, wide), ("stage", LIFE_STAGES, wide), ("work", CONTENT, work), ("tone", TONES, [*work, "selection_process"]), ("gender", GENDER_SIGNALS, wide)):
        out += [rules.Feature(f"{kind}_{n}", fields, list(patterns)) for n, patterns in groups.items()]
    return out


FEATURES = _features()


@query(f"WITH {TEXTS} SELECT doc_id, array_to_string({rules.features_sql(FEATURES)}, ',') AS features FROM texts", base=False)
def fun42_text_features(spark, d):
    """Names of all features of each advert, in the dictionary's order."""
    return rules.text_features(advert_texts(spark, d), FEATURES).select("doc_id", F.array_join("features", ",").alias("features"))


@query(f"""WITH {TEXTS}, found AS (SELECT job_type, employment_type, prefecture, {rules.features_sql(FEATURES)} AS features FROM texts),
    sizes AS (SELECT job_type, employment_type, prefecture, count(*) AS total FROM found GROUP BY ALL)
    SELECT job_type, employment_type, prefecture, feature, count(*) AS count, round(count(*) / any_value(total), 6) AS share, any_value(total) AS total
    FROM (SELECT job_type, employment_type, prefecture, unnest(features) AS feature FROM found) JOIN sizes USING (job_type, employment_type, prefecture) GROUP BY job_type, employment_type, prefecture, feature""", base=False)
def pos05_text_features(spark, d):
    """How many adverts of each job, employment type and region have each feature."""
    found = rules.text_features(advert_texts(spark, d), FEATURES)
    return rounded(feature_frequency(found, ["job_type", "employment_type", "prefecture"]))


@query(f"WITH {TEXTS} {rules.scores_sql(AXES, 'texts', 'doc_id')}", base=False)
def cls01_scores(spark, d):
    """The 27 scores of each advert."""
    return rules.score_columns(advert_texts(spark, d), AXES).select("doc_id", *[n for s in AXES.values() for n in s])


@query(f"WITH {TEXTS} SELECT * FROM ({rules.classes_sql(AXES, KINDS, 'texts', 'doc_id')})", base=False)
def cls02_cls03_classes(spark, d):
    """Winners of the five axes, and the kind with its names, or names put together from the winners."""
    columns = ["kind", "label", "label_short", "label_proposal", "match", "combined", *[f"axis_{a}" for a in AXES]]
    return rules.classify(advert_texts(spark, d), AXES, KINDS).select("doc_id", *columns)


@query()
def cls04_classified_postings(spark, d):
    """Raw adverts enriched and classified by one call: adverts of each kind by employment type and shift type."""
    raw = advert_texts(spark, d).select("doc_id", "job_type", "prefecture", *_FIELDS, F.col("working_hours").alias("holidays"), "salary_min", "salary_max", "service_type", F.col("employment_type").alias("employment_text"))
    done = classify_postings(raw)
    return done.groupBy("kind", "employment_type", "wh_shift_type", "age_decade_primary").agg(F.count("*").alias("count"))


@query()
def clu01_group_clusters(spark, d):
    """Adverts clustered by a model of their own for each brand and return flag."""
    l, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    rows = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("advert"), F.col("p_brand").alias("job_type"), F.col("l_returnflag").alias("employment"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice",
        (F.col("l_quantity") > 25).alias("bulk"), (F.col("l_discount") > 0.05).alias("discount"), (F.col("l_tax") > 0.04).alias("tax"), (F.col("l_linestatus") == "O").alias("open"),
    )
    out = group_clusters(rows, ["job_type", "employment"], "advert", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice"], ["bulk", "discount", "tax", "open"], components=2)
    return rounded(out.select("advert", "job_type", "employment", "cluster", "k", "silhouette"), 4)


@query()
def txt07_npmi_scopes(spark, d):
    """The strongest word pairs of each language, in all sources and in its ten largest."""
    docs = T.job_scopes(table(spark, d, "documents").select("doc_id", "lang", "source", "text"), "lang", "source", "doc_id")
    return rounded(T.npmi_of_texts(docs, "doc_id", "text", r"[a-zà-ÿ]+", ["lang", "scope"]), 5)


#: A small lexicon over what the phrases say; ask_texts takes any other.
LEXICON = Lexicon(
    template=["ご応募", "応募できます", "書類"],
    legal="賞与年2回",
    difference={"strength": [("ICT", 2), ("電子カルテ", 3), ("地域", 2), ("理念", 1)], "workstyle": [("在宅勤務", 3), ("直行直帰", 2), ("フレックス", 2), ("短時間", 1)]},
    tones={"casual": [("一緒に", 2), ("アットホーム", 2)], "formal": [("ご応募", 2), ("お待ち", 1)], "urgent": [("急募", 3), ("増員", 1)], "warm": [("サポート", 2), ("安心", 2), ("歓迎", 1)]},
    told={"pay": (3, [("年収", 2), ("手当", 2), ("賞与", 2), ("給与", 2), ("万円", 1)]), "hours": (3, [("残業", 2), ("夜勤", 2), ("日勤", 2), ("シフト", 2)]), "work": (2, [("介護", 1), ("測定", 1), ("配膳", 1), ("電話", 1)])},
    people={"age": {"young": [("20代", 3), ("若手", 3), ("新卒", 3)], "middle": [("40代", 3), ("即戦力", 2), ("管理職", 2)], "senior": [("50代", 3), ("シニア", 3), ("定年", 2)]}, "life": {"family": [("主婦", 3), ("育休", 2), ("ママ", 3), ("託児", 2)], "career": [("昇進", 2), ("リーダー", 2), ("キャリア", 1)]}},
    values={"growth": [("研修", 2), ("資格取得", 2), ("キャリアアップ", 3)], "stability": [("退職金", 3), ("社会保険", 2), ("上場", 2)], "income": [("年収", 2), ("高給与", 3), ("お祝い金", 2)], "balance": [("ワークライフバランス", 3), ("残業ほぼなし", 3), ("経験", 1)]},
)
_ASKED = ["tone", "people_age", "people_life", "value_first"]
_LEVELS = {"nation": ["job_type", "employment_type"], "prefecture": ["job_type", "employment_type", "prefecture"], "municipality": ["job_type", "employment_type", "prefecture", "municipality"]}


def _asked(spark, d):
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)
    phrases = F.array(*[F.lit(p) for p in PHRASES])
    docs = table(spark, d, "documents").withColumn("said", F.transform(words, lambda w: F.get(phrases, (F.ascii(w) * 5 + F.length(w) * 11) % len(PHRASES))))
    docs = docs.select(
        "doc_id", F.coalesce("lang", F.lit("none")).alias("job_type"), F.coalesce("source", F.lit("none")).alias("prefecture"), F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("municipality"),
        F.get(F.array(*[F.lit(j) for j in _JOBS]), (F.col("doc_id") % 3).cast("int")).alias("employment_type"), F.array_join("said", "\n").alias("said"),
    )
    return ask_texts(docs, "said", LEXICON).withColumn("value_first", F.col("values")[0])


def _count_sql(term: str, text: str) -> str:
    """Occurrences of a term, those right after a negation left out."""
    def n(t: str) -> str:
        return f"((length({text}) - length(replace({text}, '{t}', ''))) // {len(t)})"

    return "(" + " - ".join([n(term), *(n(x + term) for x in LEXICON.negations)]) + ")"


def _points_sql(terms, text: str = "said") -> str:
    return "(" + " + ".join(f"{_count_sql(t, text)} * {w}" for t, w in terms) + ")"


def _best_sql(scores: dict) -> str:
    top = f"greatest({', '.join(scores.values())})"
    return f"CASE WHEN {top} <= 0 THEN '不明' " + " ".join(f"WHEN {s} = {top} THEN '{n}'" for n, s in scores.items()) + " END"


_HELD = " OR ".join(f"contains(x, '{t}')" for t in LEXICON.template)
_ASKED_SQL = rf"""words AS (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (SELECT doc_id, coalesce(lang, 'none') AS job_type, coalesce(source, 'none') AS prefecture, 'm' || (doc_id % 3) AS municipality, {_pick(_JOBS, "doc_id")} AS employment_type,
    list_transform(words, lambda w: {_listed(PHRASES)}[CAST({_CODE} % {len(PHRASES)} AS INTEGER) + 1]) AS lines FROM words WHERE len(words) > 0),
started AS (SELECT *, array_to_string(lines, chr(10)) AS said, coalesce(list_position(list_transform(lines, lambda x: contains(x, '{LEXICON.legal}')), true), 0) AS start FROM lines),
parts AS (SELECT *, array_to_string(list_filter(lines, lambda x, i: NOT (({_HELD}) OR (start > 0 AND i >= start))), chr(10)) AS own, array_to_string(list_filter(lines, lambda x, i: ({_HELD}) OR (start > 0 AND i >= start)), chr(10)) AS template FROM started),
scored AS MATERIALIZED (SELECT *, coalesce(length(template), 0) / CAST(length(said) AS DOUBLE) AS template_ratio,
    {", ".join(f"coalesce({_points_sql(t, 'own')}, 0) AS diff_{n}" for n, t in LEXICON.difference.items())},
    {", ".join(f"{_points_sql(t)} AS tone_{n}" for n, t in LEXICON.tones.items())},
    {", ".join("least(1.0, (" + " + ".join(f"CAST({_count_sql(x, 'said')} > 0 AS INTEGER)" for x, _ in t) + f") / {float(len(t))})::DOUBLE AS told_{n}" for n, (_, t) in LEXICON.told.items())},
    {", ".join(f"{_points_sql(t)} AS {k}_{n}" for k, groups in LEXICON.people.items() for n, t in groups.items())},
    {", ".join(f"{_points_sql(t)} AS value_{n}" for n, t in LEXICON.values.items())} FROM parts),
asked AS MATERIALIZED (SELECT *, {" + ".join(f"diff_{n}" for n in LEXICON.difference)} AS diff_total, {_best_sql({n: f"tone_{n}" for n in LEXICON.tones})} AS tone,
    ({" + ".join(f"told_{n} * {w}" for n, (w, _) in LEXICON.told.items())}) / {float(sum(w for w, _ in LEXICON.told.values()))} AS info,
    {", ".join(f"{_best_sql({n: f'{k}_{n}' for n in groups})} AS people_{k}" for k, groups in LEXICON.people.items())},
    {_best_sql({n: f"value_{n}" for n in LEXICON.values})} AS value_first FROM scored)"""


def _rounded_up(df: DataFrame) -> DataFrame:
    """rounded, with halves of the last digit moved up first: shares of counts often end there, and engines differ on them."""
    return rounded(df.select(*[(F.col(c) + 1e-9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))


@query(f"WITH {_ASKED_SQL} SELECT doc_id, round(template_ratio + 1e-9, 6) AS template_ratio, diff_total, tone, round(info + 1e-9, 6) AS info, people_age, people_life, value_first, {', '.join(f'value_{n}' for n in LEXICON.values)} FROM asked", base=False)
def fun46_six_questions(spark, d):
    """The answers of each advert's text."""
    out = _asked(spark, d).select("doc_id", "template_ratio", F.col("diff_total").cast("long").alias("diff_total"), "tone", "info", "people_age", "people_life", "value_first", *[F.col(f"value_{n}").cast("long").alias(f"value_{n}") for n in LEXICON.values])
    return _rounded_up(out)


def _mode_sql(c: str, what: str = "") -> str:
    return f"(SELECT {what or c} FROM unnest(list_filter(any_{c}, lambda x: x <> '不明')) t({c}) GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(f"""WITH {_ASKED_SQL},
grouped AS (SELECT CASE WHEN grouping(municipality) = 0 THEN 'municipality' WHEN grouping(prefecture) = 0 THEN 'prefecture' ELSE 'nation' END AS scope, job_type, employment_type, prefecture, municipality, count(*) AS n,
    {", ".join(f"{f}({c}) AS {c}_{n}" for c in ("template_ratio", "diff_total", "info") for n, f in (("mean", "avg"), ("std", "stddev_pop")))}, {", ".join(f"list({c}) AS any_{c}" for c in _ASKED)}
    FROM asked GROUP BY GROUPING SETS ((job_type, employment_type), (job_type, employment_type, prefecture), (job_type, employment_type, prefecture, municipality)) HAVING count(*) >= 3),
nation AS (SELECT job_type, employment_type, info_mean AS nation FROM grouped WHERE scope = 'nation')
SELECT scope, job_type, employment_type, prefecture, municipality, n, {", ".join(f"round({c}_{x} + 1e-9, 6) AS {c}_{x}" for c in ("template_ratio", "diff_total", "info") for x in ("mean", "std"))},
    CASE WHEN info_mean >= 0.20 THEN 'A' WHEN info_mean >= 0.14 THEN 'B' WHEN info_mean >= 0.10 THEN 'C' ELSE 'D' END AS grade, round(info_mean - nation + 1e-9, 6) AS gap,
    {", ".join(f"coalesce({_mode_sql(c)}, '不明') AS {c}_mode, round(coalesce({_mode_sql(c, 'count(*)')}, 0) * 100.0 / n + 1e-9, 6) AS {c}_pct" for c in _ASKED)}
FROM grouped LEFT JOIN nation USING (job_type, employment_type)""", base=False)
def pos18_text_scores(spark, d):
    """The six questions by job and employment type in the nation, its regions and places."""
    return _rounded_up(text_scopes(_asked(spark, d), _LEVELS, ["job_type", "employment_type"], _ASKED))


_SYNONYMS = {"リハビリ": "リハビリテーション", "電子カルテ": "電子カルテシステム", "主婦": "主夫主婦", "イチ": "一"}
_STOP = ["経験", "資格", "応募", "募集", "仕事"]


@query(f"""WITH {TEXTS}, runs AS (SELECT doc_id, job_type, unnest([{", ".join(f"{{'kind': '{k}', 'tokens': regexp_extract_all(all_text, '{p}')}}" for k, p in T.SCRIPT_RUNS)}], recursive := true) FROM texts),
    words AS (SELECT doc_id, job_type, kind, unnest(tokens) AS raw FROM runs),
    known AS (SELECT doc_id, job_type, kind, CASE raw {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _SYNONYMS.items())} ELSE raw END AS token FROM words)
    SELECT job_type, kind, token, count(*) AS count, count(DISTINCT doc_id) AS docs FROM known
    WHERE length(token) >= 2 AND NOT (kind <> 'kanji' AND regexp_matches(token, '^[ー\\-─━┈┉┄・…。、！？\\s　]+$')) AND (kind = 'mixed' OR token NOT IN ({", ".join(f"'{x}'" for x in _STOP)})) GROUP BY ALL""", base=False)
def txt01_script_tokens(spark, d):
    """Words of all adverts by job and script: how often, and in how many adverts."""
    return T.script_token_counts(advert_texts(spark, d), ["job_type"], "doc_id", "all_text", _SYNONYMS, _STOP)


_SHIFTS = ["日勤のみ", "シフト制", "固定時間", "夜勤専従"]
_BAND_SQL = " ".join(f"WHEN salary_type = '{n}' AND pay >= {low} AND pay < {high} THEN '{label}'" for n, (edges, labels) in PAY_BANDS.items() for low, high, label in zip(edges, edges[1:], labels))


@query(f"""WITH paid AS (SELECT c_mktsegment AS job_type, n_name AS prefecture, o_orderpriority AS municipality, CASE WHEN l_linenumber % 3 = 0 THEN '時給' ELSE '月給' END AS salary_type,
    CASE WHEN l_linenumber % 3 = 0 THEN 900 + l_partkey % 13 * 100 ELSE 150000 + l_partkey % 25 * 10000 END AS pay, {_pick(_SHIFTS, "l_suppkey")} AS shift
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
    both_levels AS (SELECT *, CASE {_BAND_SQL} ELSE '不明' END AS band FROM (SELECT job_type, prefecture, '' AS municipality, salary_type, pay, shift FROM paid UNION ALL SELECT job_type, prefecture, municipality, salary_type, pay, shift FROM paid)),
    sizes AS (SELECT job_type, salary_type, prefecture, municipality, count(*) AS total FROM both_levels GROUP BY ALL HAVING municipality = '' OR count(*) >= 10)
    SELECT job_type, salary_type, prefecture, nullif(municipality, '') AS municipality, band, shift, count(*) AS count, CAST(trunc(median(pay)) AS BIGINT) AS median, any_value(total) AS total
    FROM both_levels JOIN sizes USING (job_type, salary_type, prefecture, municipality) GROUP BY job_type, salary_type, prefecture, municipality, band, shift HAVING count(*) >= 2""", base=False)
def pos13_pay_by_shift(spark, d):
    """Bands of monthly and hourly pay by shift type in regions and their places."""
    l, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    hourly = F.col("l_linenumber") % 3 == 0
    rows = rows.select(
        F.col("c_mktsegment").alias("job_type"), F.col("n_name").alias("prefecture"), F.col("o_orderpriority").alias("municipality"), F.when(hourly, "時給").otherwise("月給").alias("salary_type"),
        F.when(hourly, 900 + F.col("l_partkey") % 13 * 100).otherwise(150000 + F.col("l_partkey") % 25 * 10000).alias("pay"), F.get(F.array(*[F.lit(x) for x in _SHIFTS]), (F.col("l_suppkey") % 4).cast("int")).alias("shift"),
    )
    return pay_by_shift(rows, ["job_type"], "salary_type", "pay", "shift", "prefecture", "municipality")
