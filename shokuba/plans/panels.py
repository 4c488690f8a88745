"""Registered queries of dashboard panels, detail tables and text parsers; they add to those of plans.queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shokuba.functions import careers as K
from shokuba.functions import people as person
from shokuba.functions import postings as advert
from shokuba.operators import applicants as A
from shokuba.operators import clusters as C
from shokuba.operators import core
from shokuba.operators import flows as G
from shokuba.operators import postings as P
from shokuba.operators import stats as S
from shokuba.plans.frames import FLAGS, SQL, adverts, areas, people, table, wishes
from shokuba.plans.queries import _COORDINATES, _TRIPS, HOME, WANT, _coordinates, _trips, _urgent, query, rounded

#: What a person holds: the brands of the parts in their orders.
_HELD = ", held AS (SELECT DISTINCT o_custkey AS person_id, p_brand AS qualification FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey), skilled AS (SELECT * FROM people JOIN held USING (person_id))"
LICENCES = ["Brand#1", "Brand#3"]


def _held(spark, d):
    o, l, p = (table(spark, d, t) for t in ("orders", "lineitem", "part"))
    out = o.select("o_orderkey", F.col("o_custkey").alias("person_id")).join(l.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(p.select("p_partkey", F.col("p_brand").alias("qualification")), F.col("l_partkey") == F.col("p_partkey"))
    return out.select("person_id", "qualification").distinct()


def _skilled(spark, d):
    return people(spark, d).join(_held(spark, d), "person_id")


#: Texts as job seekers write them, made of each person's row.
_RAW = """, raw AS (SELECT person_id AS k, CAST(person_id AS VARCHAR) AS s, age,
    CASE WHEN person_id % 11 = 0 THEN NULL ELSE age || '歳 ' || CASE WHEN gender = 'F' THEN '女性' WHEN gender = 'M' THEN '男性' ELSE '' END END AS age_text,
    CASE person_id % 6 WHEN 0 THEN '経済学部(大学)(' || (1970 + person_id % 60) || '年3月卒業)、普通科(高等学校)(' || (1966 + person_id % 60) || '年3月卒業)' WHEN 1 THEN '看護科(専門学校)(' || (1980 + person_id % 40) || '年卒)'
        WHEN 2 THEN '普通科（高校）2010/03卒業' WHEN 3 THEN '研究科(大学院)(在学中)' WHEN 4 THEN '' ELSE '保育科(短大)(' || (1990 + person_id % 30) || '卒)、中学校' END AS career,
    ['今すぐに', '1ヶ月以内', '3ヶ月以内', '3ヶ月以上先', '機会があれば転職を検討したい', '未定'][1 + person_id % 6] || CASE WHEN person_id % 5 = 0 THEN '' ELSE '（2025/' || lpad(CAST(1 + person_id % 12 AS VARCHAR), 2, '0') || '/' || lpad(CAST(1 + person_id % 28 AS VARCHAR), 2, '0') || '時点）' END AS start,
    ['3年', '10年以上', '1年未満', '未満', '', 'なし'][1 + person_id % 6] AS length, ['介護福祉士,自動車運転免許', '看護師 取得予定', '', '実務者研修,その他（喀痰吸引）'][1 + person_id % 4] AS quals,
    ['正職員,パート', 'パート・バイト', '契約職員', '正社員', ''][1 + person_id % 5] AS workstyle, ['就業中', '在職中', '退職済み', '無職', '学生', '不明', NULL][1 + person_id % 7] AS status, ['男', '女性', 'F', 'x', NULL][1 + person_id % 5] AS sex,
    ['修士課程', '大卒', '短大', '専修学校', '高卒', '中卒', '独学', NULL][1 + person_id % 8] AS education, ['大阪', '京都府', '北海道', '東京', 'x', NULL][1 + person_id % 6] AS prefecture,
    ['さいたま市大宮区1-2', '府中市宮町1', '愛知郡東郷町', '千代田区丸の内', '川場村 大字', 'JR線', NULL][1 + person_id % 7] AS municipality, ['東京都千代田区丸の内', '大阪府', '愛知県', 'x'][1 + person_id % 4] AS address FROM people)"""


def _pick(k, values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _raw(spark, d):
    p = people(spark, d)
    k = F.col("person_id")
    text = lambda c: c.cast("string")
    stated = F.concat(F.lit("（2025/"), F.lpad(text(1 + k % 12), 2, "0"), F.lit("/"), F.lpad(text(1 + k % 28), 2, "0"), F.lit("時点）"))
    career = (
        F.when(k % 6 == 0, F.concat(F.lit("経済学部(大学)("), text(1970 + k % 60), F.lit("年3月卒業)、普通科(高等学校)("), text(1966 + k % 60), F.lit("年3月卒業)")))
        .when(k % 6 == 1, F.concat(F.lit("看護科(専門学校)("), text(1980 + k % 40), F.lit("年卒)"))).when(k % 6 == 2, "普通科（高校）2010/03卒業").when(k % 6 == 3, "研究科(大学院)(在学中)").when(k % 6 == 4, "")
        .otherwise(F.concat(F.lit("保育科(短大)("), text(1990 + k % 30), F.lit("卒)、中学校")))
    )
    return p.select(
        k.alias("k"), "age", F.when(k % 11 != 0, F.concat(text(F.col("age")), F.lit("歳 "), F.when(F.col("gender") == "F", "女性").when(F.col("gender") == "M", "男性").otherwise(""))).alias("age_text"),
        career.alias("career"), F.concat(_pick(k, ["今すぐに", "1ヶ月以内", "3ヶ月以内", "3ヶ月以上先", "機会があれば転職を検討したい", "未定"]), F.when(k % 5 == 0, "").otherwise(stated)).alias("start"),
        _pick(k, ["3年", "10年以上", "1年未満", "未満", "", "なし"]).alias("length"), _pick(k, ["介護福祉士,自動車運転免許", "看護師 取得予定", "", "実務者研修,その他（喀痰吸引）"]).alias("quals"),
        _pick(k, ["正職員,パート", "パート・バイト", "契約職員", "正社員", ""]).alias("workstyle"), _pick(k, ["就業中", "在職中", "退職済み", "無職", "学生", "不明", None]).alias("status"), _pick(k, ["男", "女性", "F", "x", None]).alias("sex"),
        _pick(k, ["修士課程", "大卒", "短大", "専修学校", "高卒", "中卒", "独学", None]).alias("education"), _pick(k, ["大阪", "京都府", "北海道", "東京", "x", None]).alias("prefecture"),
        _pick(k, ["さいたま市大宮区1-2", "府中市宮町1", "愛知郡東郷町", "千代田区丸の内", "川場村 大字", "JR線", None]).alias("municipality"), _pick(k, ["東京都千代田区丸の内", "大阪府", "愛知県", "x"]).alias("address"),
    )


# --- parsers


@query(_RAW + """ SELECT k, try_cast(regexp_extract(age_text, '([0-9]+)歳', 1) AS DOUBLE) AS age, nullif(regexp_extract(age_text, '(男性|女性)', 1), '') AS gender, CASE WHEN age < 30 THEN '20代以下' WHEN age < 40 THEN '30代' WHEN age < 50 THEN '40代' WHEN age < 60 THEN '50代' ELSE '60代以上' END AS five,
    CASE WHEN age <= 30 THEN '若年層' WHEN age <= 45 THEN '中年層' WHEN age <= 60 THEN '準高齢層' ELSE '高齢層' END AS four FROM raw""")
def fun01_fun21_age(spark, d):
    a, g = person.age_gender(F.col("age_text"))
    return _raw(spark, d).select("k", a.cast("double").alias("age"), g.alias("gender"), K.age_five(F.col("age")).alias("five"), K.age_four(F.col("age")).alias("four"))


_SCHOOL = """CASE WHEN {0} LIKE '%大学院%' THEN '大学院' WHEN {0} LIKE '%大学%' THEN '大学' WHEN {0} LIKE '%短大%' THEN '短大' WHEN {0} LIKE '%専門%' THEN '専門' WHEN {0} LIKE '%高校%' OR {0} LIKE '%高等学校%' THEN '高校' WHEN {0} LIKE '%中学%' THEN '中学' ELSE 'その他' END"""
_CAREER = _RAW + f""", schools AS (SELECT *, str_split(career, '、')[1] AS one, str_split(career, '、')[2] AS two FROM raw), careers AS (SELECT k, CASE WHEN career = '' THEN 'なし' ELSE {_SCHOOL.format('one')} END AS level, nullif(regexp_extract(one, '^([^(（]+)[（(]', 1), '') AS field,
    try_cast(coalesce(nullif(regexp_extract(one, '([0-9]{{4}})年[0-9]{{1,2}}月卒業', 1), ''), nullif(regexp_extract(one, '([0-9]{{4}})年?卒', 1), ''), regexp_extract(one, '([0-9]{{4}})/[0-9]{{1,2}} *卒業', 1)) AS DOUBLE) AS graduation_year, one LIKE '%在学%' AS is_current,
    CASE WHEN career = '' THEN '' WHEN two IS NULL THEN {_SCHOOL.format('one')} ELSE {_SCHOOL.format('one')} || ',' || {_SCHOOL.format('two')} END AS levels FROM schools)"""


@query(_CAREER + " SELECT * FROM careers")
def fun15_career(spark, d):
    return _raw(spark, d).select("k", K.career(F.col("career")).alias("c")).select("k", "c.level", "c.field", F.col("c.graduation_year").cast("double").alias("graduation_year"), "c.is_current", F.array_join("c.levels", ",").alias("levels"))


@query(_RAW + """ SELECT k, CASE WHEN education = '大卒' THEN 'univ' WHEN education = '高卒' THEN 'high' END AS level_code, CASE WHEN education = '修士課程' THEN 'science' WHEN education = '高卒' THEN 'general' END AS field_code, CAST(NULL AS DOUBLE) AS grad_year,
    CASE WHEN education = '高卒' THEN 'high' WHEN education IN ('大卒', '修士課程') THEN 'medium' ELSE 'low' END AS confidence FROM raw""")
def fun16_schooling(spark, d):
    words = spark.createDataFrame([("education_levels", "大卒", "univ"), ("education_levels", "高卒", "high"), ("fields", "修士課程", "science"), ("fields", "高卒", "general")], "domain string, token string, canonical string")
    return K.schooling(_raw(spark, d).select("k", "education"), "education", words).drop("education").withColumn("grad_year", F.col("grad_year").cast("double"))


@query(_RAW + """ SELECT k, CAST(CASE length WHEN '3年' THEN 36 WHEN '10年以上' THEN 120 END AS DOUBLE) AS months, CASE length WHEN '3年' THEN '3y' WHEN '10年以上' THEN '>=10y' WHEN '1年未満' THEN '< 1y' WHEN '未満' THEN '<1y' ELSE 'unknown' END AS bucket FROM raw""")
def fun11_experience(spark, d):
    return _raw(spark, d).select("k", K.experience(F.col("length")).alias("e")).select("k", F.col("e.months").cast("double").alias("months"), "e.bucket")


@query(_RAW + """ SELECT k, x[1] AS name, x[2] AS category, x[3] = 'y' AS is_planned FROM (SELECT k, unnest(CASE quals WHEN '介護福祉士,自動車運転免許' THEN [['介護福祉士', '国家資格', 'n'], ['自動車運転免許', '免許', 'n']] WHEN '看護師 取得予定' THEN [['看護師', '医療資格', 'y']]
    WHEN '実務者研修,その他（喀痰吸引）' THEN [['実務者研修', '介護研修', 'n'], ['その他（喀痰吸引）', 'その他', 'n']] ELSE [] END) AS x FROM raw)""")
def fun12_qualifications(spark, d):
    return _raw(spark, d).select("k", F.explode(K.qualification_list(F.col("quals"))).alias("q")).select("k", "q.*")


_STATED = "try_strptime(nullif(regexp_extract(start, '([0-9]{4}/[0-9]{2}/[0-9]{2})', 1), ''), '%Y/%m/%d')"


@query(_RAW + f""", p AS (SELECT k, start, CASE WHEN start LIKE '今すぐ%' THEN 5 WHEN start LIKE '1ヶ月以内%' THEN 4 WHEN start LIKE '3ヶ月以内%' THEN 3 WHEN start LIKE '3ヶ月以上先%' THEN 2 WHEN start LIKE '機会%' THEN 1 ELSE 0 END AS points, CAST({_STATED} AS DATE) AS stated FROM raw)
    SELECT k, points, CASE WHEN points >= 1 AND stated IS NOT NULL THEN round(greatest(1.0, points - datediff('day', stated, DATE '2026-01-01') / 60.0), 2) ELSE points END AS decayed, regexp_extract(start, '^([^（]+)', 1) AS text, CAST(datediff('day', stated, DATE '2026-01-01') AS DOUBLE) AS days FROM p""")
def fun17_stated_start(spark, d):
    ref = F.to_date(F.lit("2026-01-01"))
    return _raw(spark, d).select("k", K.stated_start(F.col("start"), ref).alias("s")).select("k", "s.points", "s.decayed", "s.text", F.col("s.days").cast("double").alias("days"))


@query(_RAW + f""", p AS (SELECT k, CASE WHEN start LIKE '今すぐ%' THEN 'now' WHEN start LIKE '3ヶ月以内%' THEN '<=3m' WHEN start LIKE '機会%' THEN 'consider' ELSE 'unknown' END AS code, datediff('day', CAST({_STATED} AS DATE), DATE '2025-07-01') > 90 AS old FROM raw)
    SELECT k, code, coalesce(old, false) AS stale, (CASE code WHEN 'now' THEN 10.0 WHEN '<=3m' THEN 7.5 WHEN 'consider' THEN 2.5 ELSE 0.0 END * CASE WHEN old THEN 0.5 ELSE 1.0 END)::DOUBLE AS score FROM p""")
def fun18_start_code(spark, d):
    return _raw(spark, d).select("k", K.start_code(F.col("start"), F.to_date(F.lit("2025-07-01"))).alias("s")).select("k", "s.code", F.coalesce("s.stale", F.lit(False)).alias("stale"), "s.score")


@query(_RAW + """ SELECT k, CASE WHEN workstyle LIKE '正%' THEN '正職員' WHEN workstyle LIKE 'パート%' THEN 'パート' ELSE 'その他' END AS workstyle, CASE WHEN start LIKE '今すぐに%' THEN '今すぐに' WHEN start LIKE '1ヶ月%' THEN '1ヶ月以内' WHEN start LIKE '3ヶ月以内%' THEN '3ヶ月以内' WHEN start LIKE '3ヶ月以上%' THEN '3ヶ月以上先' WHEN start LIKE '機会%' THEN '機会があれば' ELSE 'その他' END AS start FROM raw""")
def fun19_categories(spark, d):
    return _raw(spark, d).select("k", K.workstyle(F.col("workstyle")).alias("workstyle"), K.start_category(F.col("start")).alias("start"))


@query(_RAW + """ SELECT k, CASE WHEN status IN ('就業中', '在職中') THEN '就業中' WHEN status IN ('退職済み', '無職') THEN '離職中' WHEN status = '学生' THEN '在学中' END AS status, CASE WHEN sex = '男' THEN '男性' WHEN sex IN ('女性', 'F') THEN '女性' WHEN sex IS NOT NULL THEN 'その他' END AS sex,
    CASE education WHEN '修士課程' THEN '大学院' WHEN '大卒' THEN '大学' WHEN '短大' THEN '短期大学' WHEN '専修学校' THEN '専門学校' WHEN '高卒' THEN '高等学校' WHEN '中卒' THEN '中学校' WHEN '独学' THEN 'その他' END AS education FROM raw""")
def fun20_normalised(spark, d):
    return _raw(spark, d).select("k", K.status(F.col("status")).alias("status"), K.gender(F.col("sex")).alias("sex"), K.education_level(F.col("education")).alias("education"))


@query(_RAW + """ SELECT k, coalesce(education, 'なし') AS education_level, CAST(coalesce(CASE WHEN k % 3 = 0 THEN 4 END, 0) AS INTEGER) AS urgency_score, sex FROM raw""")
def fun22_missing(spark, d):
    r = _raw(spark, d).select("k", F.col("education").alias("education_level"), F.when(F.col("k") % 3 == 0, 4).alias("urgency_score"), "sex")
    return K.fill_missing(r)


@query(_RAW + """ SELECT k, CASE municipality WHEN 'さいたま市大宮区1-2' THEN 'さいたま市大宮区' WHEN '府中市宮町1' THEN '府中市' WHEN '愛知郡東郷町' THEN '愛知郡東郷町' WHEN '千代田区丸の内' THEN '千代田区' WHEN '川場村 大字' THEN '川場村' ELSE '' END AS clean,
    CASE prefecture WHEN '大阪' THEN '大阪府' WHEN '東京' THEN '東京都' ELSE prefecture END AS full_name, CASE WHEN address LIKE '東京都%' THEN '東京都' ELSE address END AS repaired_prefecture,
    CASE WHEN address LIKE '東京都%' THEN '千代田区' WHEN address = 'x' THEN coalesce(municipality, '') WHEN municipality = 'JR線' THEN '' ELSE coalesce(municipality, '') END AS repaired_municipality FROM raw""")
def fun04_fun06_places(spark, d):
    r = _raw(spark, d).withColumn("p", K.repaired_place(F.col("address"), F.col("municipality")))
    return r.select("k", K.clean_municipality(F.col("municipality")).alias("clean"), K.full_prefecture(F.col("prefecture")).alias("full_name"), F.col("p.prefecture").alias("repaired_prefecture"), F.col("p.municipality").alias("repaired_municipality"))


# --- tables of people and what they hold


@query(_HELD + " SELECT qualification, count(*) AS count, round(avg(age), 6) AS avg_age, qualification IN ('Brand#1', 'Brand#3') AS national FROM skilled GROUP BY 1")
def agg02_qualification_master(spark, d):
    return rounded(A.persona(_skilled(spark, d), ["qualification"]).withColumn("national", F.col("qualification").isin(*LICENCES)))


@query("SELECT employment, count(*) AS count FROM people GROUP BY 1")
def agg04_employment_status(spark, d):
    return core.cross(people(spark, d), ["employment"])


_ONCE = ", once AS (SELECT DISTINCT person_id, want_municipality, municipality, age, age_group, gender, employment FROM wishes)"


@query(_HELD + _ONCE + """, base AS (SELECT want_municipality, municipality, count(*) AS count, round(avg(age), 6) AS avg_age, round(count(*) FILTER (employment = 'BUILDING') / CAST(count(*) AS DOUBLE), 6) AS employed_share FROM once GROUP BY 1, 2),
    tops AS (SELECT want_municipality, municipality, string_agg(qualification, ';' ORDER BY r) AS top_items FROM (SELECT want_municipality, municipality, qualification, row_number() OVER (PARTITION BY want_municipality, municipality ORDER BY count(*) DESC, qualification) AS r FROM once JOIN held USING (person_id) GROUP BY 1, 2, 3) WHERE r <= 3 GROUP BY 1, 2)
    SELECT base.*, top_items FROM base LEFT JOIN tops USING (want_municipality, municipality)""")
def agg05_target_and_residence(spark, d):
    keys = ["want_municipality", "municipality"]
    w = wishes(spark, d).dropDuplicates(["person_id", "want_municipality"])  # the other columns belong to the person
    base = core.cross(w, keys, [F.avg("age").alias("avg_age"), core.share(F.count_if(F.col("employment") == "BUILDING"), F.count("*"), 1.0).alias("employed_share")])
    return rounded(base.join(A.top_items(w.join(_held(spark, d), "person_id"), keys, "qualification"), keys, "left"))


@query(_HELD + _ONCE + " SELECT want_municipality, qualification, count(*) AS count, round(avg(age), 6) AS avg_age, round(count(*) FILTER (employment = 'BUILDING') / CAST(count(*) AS DOUBLE), 6) AS employment_rate FROM once JOIN held USING (person_id) GROUP BY 1, 2")
def agg06_qualification_by_target(spark, d):
    w = wishes(spark, d).dropDuplicates(["person_id", "want_municipality"]).join(_held(spark, d), "person_id")
    return rounded(core.cross(w, ["want_municipality", "qualification"], [F.avg("age").alias("avg_age"), core.share(F.count_if(F.col("employment") == "BUILDING"), F.count("*"), 1.0).alias("employment_rate")]))


@query(_HELD + " SELECT qualification, municipality, count(*) AS count, round(avg(age), 6) AS avg_age FROM skilled GROUP BY 1, 2 HAVING count(*) >= 3")
def agg12_qualification_distribution(spark, d):
    return rounded(core.cross(_skilled(spark, d), ["qualification", "municipality"], [F.avg("age").alias("avg_age")], min_count=3))


_MOBILE = ", mobile AS (SELECT person_id, count(*) FILTER (prefecture <> want_prefecture) / CAST(count(*) AS DOUBLE) AS mobility, count(DISTINCT want_municipality) AS area_count FROM wishes GROUP BY 1), movers AS (SELECT * FROM people JOIN mobile USING (person_id))"


def _movers(spark, d):
    m = wishes(spark, d).groupBy("person_id").agg(person.mobility_score(F.count_if(F.col("prefecture") != F.col("want_prefecture")), F.count("*")).alias("mobility"), F.countDistinct("want_municipality").alias("area_count"))
    return people(spark, d).join(m, "person_id")


@query(_MOBILE + " SELECT municipality, count(*) AS count, round(avg(age), 6) AS avg_age, round(avg(area_count), 6) AS avg_areas FROM movers GROUP BY 1")
def agg01_areas_by_residence(spark, d):
    return rounded(core.cross(_movers(spark, d), ["municipality"], [F.avg("age").alias("avg_age"), F.avg("area_count").alias("avg_areas")]))


@query(f", {_COORDINATES}" + """ SELECT municipality, top_age, round(top_age_share, 6) AS top_age_share, lat, lng FROM (SELECT prefecture, municipality, age_group AS top_age, count(*) / CAST(sum(count(*)) OVER (PARTITION BY municipality) AS DOUBLE) AS top_age_share, row_number() OVER (PARTITION BY municipality ORDER BY count(*) DESC, age_group) AS r FROM people GROUP BY 1, 2, 3) JOIN coords USING (prefecture, municipality) WHERE r = 1""")
def agg01_top_age_on_map(spark, d):
    return rounded(G.with_coordinates(A.top_share(people(spark, d), HOME, "age_group", "top_age"), _coordinates(spark, d), HOME).drop("prefecture"))


@query(_MOBILE + " SELECT age_group, gender, employment, count(*) AS count, round(avg(age), 6) AS avg_age, round(avg(mobility), 6) AS avg_mobility FROM movers WHERE gender IS NOT NULL GROUP BY 1, 2, 3")
def agg15_detailed_persona(spark, d):
    return rounded(A.persona(_movers(spark, d), ["age_group", "gender", "employment"], [F.avg("mobility").alias("avg_mobility")]))


def _schooled(spark, d):
    c = _raw(spark, d).select(F.col("k").alias("person_id"), K.career(F.col("career")).alias("c"))
    return people(spark, d).join(c.select("person_id", F.col("c.level").alias("level"), F.col("c.graduation_year").cast("double").alias("graduation_year")), "person_id")


@query(_CAREER + " SELECT municipality, level, age_group, count(*) AS count, round(avg(age), 6) AS avg_age FROM people JOIN careers ON k = person_id GROUP BY 1, 2, 3")
def agg16_career_by_age(spark, d):
    return rounded(A.persona(_schooled(spark, d), ["municipality", "level", "age_group"]))


@query(_CAREER + " SELECT graduation_year, count(*) AS count, round(avg(age), 6) AS avg_age FROM people JOIN careers ON k = person_id WHERE graduation_year BETWEEN 1950 AND 2030 GROUP BY 1")
def agg17_graduation_years(spark, d):
    return rounded(A.persona(_schooled(spark, d).filter("graduation_year between 1950 and 2030"), ["graduation_year"]))


@query("SELECT urgency, gender, count(*) AS count, round(avg(age), 6) AS avg_age, round(avg(6 - CAST(urgency[1] AS INTEGER)), 6) AS avg_urgency_score FROM wishes WHERE gender IS NOT NULL GROUP BY 1, 2")
def agg19_urgency_by_gender(spark, d):
    return rounded(A.urgency_profile(_urgent(spark, d), ["urgency", "gender"]))


_STARTS = _RAW + ", starts AS (SELECT k AS person_id, CASE WHEN start LIKE '今すぐに%' THEN '今すぐに' WHEN start LIKE '1ヶ月%' THEN '1ヶ月以内' WHEN start LIKE '3ヶ月以内%' THEN '3ヶ月以内' WHEN start LIKE '3ヶ月以上%' THEN '3ヶ月以上先' WHEN start LIKE '機会%' THEN '機会があれば' ELSE 'その他' END AS start FROM raw)"


def _starting(spark, d):
    return _urgent(spark, d).join(_raw(spark, d).select(F.col("k").alias("person_id"), K.start_category(F.col("start")).alias("start")), "person_id")


@query(_STARTS + " SELECT want_municipality, start, count(*) AS count, round(avg(age), 6) AS avg_age, round(avg(6 - CAST(urgency[1] AS INTEGER)), 6) AS avg_urgency_score FROM wishes JOIN starts USING (person_id) GROUP BY 1, 2")
def agg20_start_by_municipality(spark, d):
    return rounded(A.urgency_profile(_starting(spark, d), ["want_municipality", "start"]))


@query(_STARTS + " SELECT start, gender, count(*) AS count, round(avg(6 - CAST(urgency[1] AS INTEGER)), 6) AS mean_score FROM wishes JOIN starts USING (person_id) WHERE gender IS NOT NULL GROUP BY 1, 2")
def agg54_start_and_gender(spark, d):
    return rounded(core.cross(_starting(spark, d), ["start", "gender"], [F.avg("urgency_score").alias("mean_score")]))


@query("""SELECT prefecture, municipality, count(*) AS total, CAST(sum(CASE WHEN has_license THEN 1 ELSE 0 END) AS BIGINT) AS licences, 'residence' AS source FROM people GROUP BY 1, 2
    UNION ALL SELECT want_prefecture, want_municipality, count(*), CAST(sum(CASE WHEN has_license THEN 1 ELSE 0 END) AS BIGINT), 'desired' FROM wishes WHERE want_municipality NOT IN (SELECT municipality FROM people) GROUP BY 1, 2""")
def agg24_profiles_with_fallback(spark, d):
    licences = F.sum(F.col("has_license").cast("long")).alias("licences")
    home = people(spark, d).groupBy(*HOME).agg(F.count("*").alias("total"), licences).withColumn("source", F.lit("residence"))
    want = wishes(spark, d).groupBy(*[F.col(w).alias(h) for w, h in zip(WANT, HOME)]).agg(F.count("*").alias("total"), licences).withColumn("source", F.lit("desired"))
    return A.add_missing_places(home, want, HOME)


@query("""SELECT municipality, coalesce(demand_count, 0) AS demand_count, coalesce(supply_count, 0) AS supply_count, round(CASE WHEN coalesce(supply_count, 0) = 0 THEN 0 ELSE coalesce(demand_count, 0) / CAST(supply_count AS DOUBLE) END, 6) AS demand_supply_ratio, coalesce(demand_count, 0) - coalesce(supply_count, 0) AS gap
    FROM (SELECT want_municipality AS municipality, count(*) AS demand_count FROM areas GROUP BY 1) FULL JOIN (SELECT municipality, count(*) AS supply_count FROM people GROUP BY 1) USING (municipality)""")
def agg25_gap_without_smoothing(spark, d):
    return rounded(A.demand_supply_gap(areas(spark, d).select(F.col("want_municipality").alias("municipality")), people(spark, d), ["municipality"], 0))


_KIND = "CASE WHEN prefecture <> want_prefecture OR distance_km >= 80 THEN 'far' WHEN distance_km < 0.001 THEN 'same' WHEN distance_km < 30 THEN 'near' ELSE 'middle' END"


def _kinds(spark, d):
    return _trips(spark, d).withColumn("kind", G.mobility_type(F.col("distance_km"), F.col("prefecture") == F.col("want_prefecture")))


@query(_TRIPS + f""" SELECT prefecture, municipality, want_prefecture, want_municipality, age_group, gender, count(*) AS count, round(avg(distance_km), 4) AS avg_km, round(median(distance_km), 4) AS median_km, min(distance_km) AS min_km, max(distance_km) AS max_km, min({_KIND}) AS mode_kind
    FROM trips WHERE gender IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6""")
def agg26_flow_of_six_keys(spark, d):
    out = G.distance_profile(_kinds(spark, d), [*HOME, *WANT, "age_group", "gender"], measures=[core.mode("kind").alias("mode_kind")])
    return rounded(out.drop("q25_km", "q75_km", "std_km", "mode_km"), 4)


@query(_TRIPS + f""" SELECT prefecture, municipality, want_prefecture, want_municipality, age_group, gender, employment, kind, count(*) AS count, round(avg(distance_km), 4) AS avg_km FROM (SELECT *, {_KIND} AS kind FROM trips) WHERE gender IS NOT NULL GROUP BY 1, 2, 3, 4, 5, 6, 7, 8""")
def agg27_mobility_pattern(spark, d):
    keys = [*HOME, *WANT, "age_group", "gender", "employment", "kind"]
    return rounded(core.cross(_kinds(spark, d), keys, [F.avg("distance_km").alias("avg_km")]), 4)


@query(""", one AS (SELECT DISTINCT person_id, want_prefecture, want_municipality, age_group, gender FROM wishes WHERE gender IS NOT NULL), fit AS (SELECT person_id FROM one GROUP BY 1 HAVING count(*) BETWEEN 2 AND 99 AND count(DISTINCT want_prefecture) < 15)
    SELECT a.want_municipality AS place1, b.want_municipality AS place2, a.age_group, a.gender, count(*) AS count FROM one a JOIN one b ON a.person_id = b.person_id AND a.want_municipality < b.want_municipality JOIN fit ON fit.person_id = a.person_id GROUP BY 1, 2, 3, 4""")
def agg30_pairs_by_age_and_gender(spark, d):
    pairs = A.area_pairs(core.known(wishes(spark, d), ["gender"]), "person_id", "want_municipality", "want_prefecture", keep=["age_group", "gender"])
    return core.cross(pairs, ["place1", "place2", "age_group", "gender"])


@query(_TRIPS + f""", styles AS (SELECT municipality, employment, count(*) AS people FROM people GROUP BY 1, 2), flow AS (SELECT municipality, want_municipality, count(*) AS flow, round(avg(distance_km), 4) AS avg_km FROM trips GROUP BY 1, 2) SELECT * FROM styles JOIN flow USING (municipality)""")
def agg33_workstyle_and_mobility(spark, d):
    styles = core.cross(people(spark, d), ["municipality", "employment"]).withColumnRenamed("count", "people")
    flow = core.cross(_trips(spark, d), ["municipality", "want_municipality"], [F.avg("distance_km").alias("avg_km")]).withColumnRenamed("count", "flow")
    return rounded(styles.join(flow, "municipality"), 4)


@query("""SELECT p.prefecture, count(*) AS count, round(avg(age), 6) AS avg_age, any_value(top) AS top_age FROM people p JOIN (SELECT prefecture, age_group AS top, row_number() OVER (PARTITION BY prefecture ORDER BY count(*) DESC, age_group) AS r FROM people GROUP BY 1, 2) t ON t.prefecture = p.prefecture AND r = 1 GROUP BY 1""")
def agg34_prefecture_with_mode(spark, d):
    by_place = core.cross(people(spark, d), HOME, [F.avg("age").alias("avg_age")])
    top = A.top_share(people(spark, d), ["prefecture"], "age_group", "top_age").select("prefecture", "top_age")
    return rounded(A.roll_up(by_place, ["prefecture"], "count", ["avg_age"]).join(top, "prefecture"))


@query("""SELECT age_group, gender, level, "A", "B", "C", "D", "A" + "B" + "C" + "D" AS total, round("A" * 100.0 / ("A" + "B" + "C" + "D"), 6) AS a_pct FROM (SELECT age_group, gender, 'all' AS level, count(*) FILTER (m >= 0.8) AS "A", count(*) FILTER (m >= 0.5 AND m < 0.8) AS "B", count(*) FILTER (m > 0 AND m < 0.5) AS "C", count(*) FILTER (m = 0) AS "D"
    FROM (SELECT person_id, any_value(age_group) AS age_group, any_value(gender) AS gender, count(*) FILTER (prefecture <> want_prefecture) / CAST(count(*) AS DOUBLE) AS m FROM wishes GROUP BY 1) WHERE gender IS NOT NULL GROUP BY 1, 2)""")
def agg39_mobility_pivot(spark, d):
    m = _movers(spark, d).withColumn("rank", person.mobility_rank(F.col("mobility")))
    out = core.pivot_counts(m, ["age_group", "gender"], "rank", ["A", "B", "C", "D"]).withColumn("total", F.col("A") + F.col("B") + F.col("C") + F.col("D"))
    return rounded(out.withColumn("level", F.lit("all")).withColumn("a_pct", core.share(F.col("A"), F.col("total"))))


@query(f", {_COORDINATES} SELECT municipality, age_group, lat, lng, count(*) AS count, round(avg(age), 6) AS avg_age, round(avg(qualification_count), 6) AS avg_qualifications FROM people JOIN coords USING (prefecture, municipality) GROUP BY ALL")
def agg40_persona_averages_on_map(spark, d):
    counts = core.cross(people(spark, d), [*HOME, "age_group"], [F.avg("age").alias("avg_age"), F.avg("qualification_count").alias("avg_qualifications")])
    return rounded(G.with_coordinates(counts, _coordinates(spark, d), HOME).drop("prefecture"))


@query(_TRIPS + """ SELECT CASE WHEN distance_km = 0 THEN '0' WHEN distance_km < 10 THEN '<10' WHEN distance_km < 30 THEN '<30' WHEN distance_km < 50 THEN '<50' WHEN distance_km < 100 THEN '<100' ELSE '>=100' END AS bucket, count(*) AS count, round(avg(distance_km), 4) AS avg_km, round(median(distance_km), 4) AS median_km, round(stddev_samp(distance_km), 4) AS std_km, round(avg(age), 4) AS avg_age FROM trips GROUP BY 1""")
def agg43_distance_statistics(spark, d):
    km = F.col("distance_km")
    bucket = F.when(km == 0, "0").otherwise(core.bands("distance_km", (10, 30, 50, 100), ("<10", "<30", "<50", "<100", ">=100")))
    out = G.distance_profile(_trips(spark, d).withColumn("bucket", F.coalesce(bucket, F.lit("unknown"))), ["bucket"], measures=[F.avg("age").alias("avg_age")])
    return rounded(out.select("bucket", "count", "avg_km", "median_km", "std_km", "avg_age"), 4)


@query("""SELECT measure, count(*) AS n, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS spread, round(min(v), 4) AS low, round(max(v), 4) AS high FROM (SELECT municipality, unnest(['people', 'age', 'qualifications']) AS measure, unnest([CAST(count(*) AS DOUBLE), avg(age), avg(qualification_count)]) AS v FROM people GROUP BY 1) GROUP BY 1""")
def agg45_summary_statistics(spark, d):
    by = people(spark, d).groupBy("municipality").agg(F.count("*").cast("double").alias("people"), F.avg("age").alias("age"), F.avg("qualification_count").alias("qualifications"))
    long = core.melt(by, ["municipality"], ["people", "age", "qualifications"], "measure", "v")
    return rounded(long.groupBy("measure").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("spread"), F.min("v").alias("low"), F.max("v").alias("high")), 4)


# --- lists and panels


@query(_HELD + """, t AS (SELECT municipality, count(*) AS total FROM people GROUP BY 1) SELECT municipality, qualification, count, retention_rate, retention_rate >= 50.0 AS high, r AS rank FROM (SELECT municipality, qualification, count(*) AS count, round(count(*) * 100.0 / any_value(total), 2) AS retention_rate, row_number() OVER (PARTITION BY municipality ORDER BY round(count(*) * 100.0 / any_value(total), 2) DESC, qualification) AS r FROM skilled JOIN t USING (municipality) GROUP BY 1, 2) WHERE r <= 10""")
def agg47_retention_top(spark, d):
    total = people(spark, d).groupBy("municipality").agg(F.count("*").alias("total"))
    held = core.cross(_skilled(spark, d), ["municipality", "qualification"]).join(total, "municipality").withColumn("retention_rate", F.round(core.share(F.col("count"), F.col("total")), 2))
    return core.top_n(held, ["municipality"], [F.desc("retention_rate"), F.asc("qualification")], 10, "rank").select("municipality", "qualification", "count", "retention_rate", (F.col("retention_rate") >= 50.0).alias("high"), "rank")


@query(_HELD + """ SELECT qualification, age_group, gender, count(*) AS count, round(1.0 / count(*), 6) AS rarity_score, round(count(*) * 100.0 / (SELECT count(*) FROM skilled WHERE gender IS NOT NULL), 6) AS share_pct FROM skilled WHERE gender IS NOT NULL GROUP BY 1, 2, 3 ORDER BY count, qualification, age_group, gender LIMIT 20""")
def agg47_rarity_top(spark, d):
    out = core.with_share(A.rarity(_skilled(spark, d), ["qualification", "age_group", "gender"]), "count", []).drop("rarity_rank")
    return rounded(out.orderBy("count", "qualification", "age_group", "gender").limit(20))


@query(_HELD + """ SELECT qualification, count(*) FILTER (gender = 'M') AS "M", count(*) FILTER (gender = 'F') AS "F", count(*) FILTER (gender = 'M') + count(*) FILTER (gender = 'F') AS total FROM skilled GROUP BY 1 ORDER BY total DESC, qualification LIMIT 10""")
def agg48_qualification_by_gender(spark, d):
    out = core.pivot_counts(_skilled(spark, d), ["qualification"], "gender", ["M", "F"]).withColumn("total", F.col("M") + F.col("F"))
    return out.orderBy(F.desc("total"), "qualification").limit(10)


@query("""SELECT age_group, gender, employment, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY age_group, gender), 6) AS share_pct FROM people WHERE gender IS NOT NULL GROUP BY 1, 2, 3""")
def agg48_persona_employment(spark, d):
    return rounded(core.cross(people(spark, d), ["age_group", "gender", "employment"], within=["age_group", "gender"]))


@query("""SELECT p.municipality, coalesce(m.license_rate, r.license_rate) AS license_rate, CASE WHEN m.n IS NULL THEN 'prefecture' ELSE 'municipality' END AS level FROM places p LEFT JOIN (SELECT municipality, count(*) AS n, round(avg(CASE WHEN has_license THEN 1.0 ELSE 0 END), 6) AS license_rate FROM people GROUP BY 1 HAVING count(*) >= 55) m USING (municipality)
    LEFT JOIN (SELECT prefecture, round(avg(CASE WHEN has_license THEN 1.0 ELSE 0 END), 6) AS license_rate FROM people GROUP BY 1) r ON r.prefecture = p.prefecture""")
def agg51_competition_overview(spark, d):
    """Of a municipality with too few people the profile of its prefecture stands in."""
    p = people(spark, d)
    rate = F.avg(F.col("has_license").cast("double")).alias("license_rate")
    own = core.suppress(p.groupBy("municipality").agg(F.count("*").alias("n"), rate), "n", 55)
    region = p.groupBy("prefecture").agg(rate.alias("r"))
    every = _coordinates(spark, d).select(*HOME).join(own, "municipality", "left").join(region, "prefecture", "left")
    return rounded(every.select("municipality", F.coalesce("license_rate", "r").alias("license_rate"), F.when(F.col("n").isNull(), "prefecture").otherwise("municipality").alias("level")))


@query("""SELECT prefecture, want_prefecture, flow, r AS rank FROM (SELECT prefecture, want_prefecture, count(*) AS flow, row_number() OVER (PARTITION BY prefecture ORDER BY count(*) DESC, want_prefecture) AS r FROM wishes WHERE prefecture = want_prefecture OR (prefecture, want_prefecture) IN (('ASIA', 'EUROPE'), ('EUROPE', 'ASIA'), ('AFRICA', 'MIDDLE EAST'), ('MIDDLE EAST', 'AFRICA')) GROUP BY 1, 2) WHERE r <= 5""")
def agg52_realistic_destinations(spark, d):
    """Destinations by flow, of those within or next to the own region."""
    near = spark.createDataFrame([("ASIA", "EUROPE"), ("AFRICA", "MIDDLE EAST")], "src string, dst string")
    flow = core.cross(wishes(spark, d), ["prefecture", "want_prefecture"]).withColumnRenamed("count", "flow")
    return core.top_n(G.realistic(flow, "prefecture", "want_prefecture", near), ["prefecture"], [F.desc("flow"), F.asc("want_prefecture")], 5, "rank")


@query(f", {_COORDINATES} SELECT municipality, lat, lng, count(*) AS people FROM people JOIN coords USING (prefecture, municipality) WHERE lat < 38 GROUP BY ALL")
def agg56_map_markers(spark, d):
    known = _coordinates(spark, d).filter("lat < 38")
    return G.with_coordinates(core.cross(people(spark, d), HOME), known, HOME).filter("lat is not null").select("municipality", "lat", "lng", F.col("count").alias("people"))


@query(f", {_COORDINATES} SELECT want_municipality, f.municipality, flow, lat, lng, round(flow * 100.0 / sum(flow) OVER (PARTITION BY want_municipality), 6) AS share_pct FROM (SELECT want_municipality, municipality, count(*) AS flow FROM wishes WHERE municipality <> want_municipality AND employment = 'BUILDING' GROUP BY 1, 2) f JOIN coords USING (municipality)")
def agg57_inflow_sources(spark, d):
    picked = core.facets(wishes(spark, d), {"employment": "BUILDING", "age_group": "all"}).filter("municipality <> want_municipality")
    flow = core.cross(picked, ["want_municipality", "prefecture", "municipality"]).withColumnRenamed("count", "flow")
    out = core.with_share(G.with_coordinates(flow, _coordinates(spark, d), HOME), "flow", ["want_municipality"])
    return rounded(out.drop("prefecture"))


@query(""", pairs AS (SELECT a.want_municipality AS place, b.want_municipality AS rival, count(*) AS count FROM (SELECT DISTINCT person_id, want_municipality FROM wishes) a JOIN (SELECT DISTINCT person_id, want_municipality FROM wishes) b ON a.person_id = b.person_id AND a.want_municipality <> b.want_municipality GROUP BY 1, 2)
    SELECT place, rival, count, round(count * 100.0 / sum(count) OVER (PARTITION BY place), 6) AS share_pct FROM pairs""")
def agg57_competing_areas(spark, d):
    pairs = core.cross(A.area_pairs(areas(spark, d), "person_id", "want_municipality", "want_prefecture"), ["place1", "place2"])
    both = pairs.select(F.col("place1").alias("place"), F.col("place2").alias("rival"), "count").unionAll(pairs.select("place2", "place1", "count"))
    return rounded(core.with_share(both, "count", ["place"]))


@query("""SELECT place, inflow, outflow, inflow - outflow AS net_flow, round(inflow / CAST(inflow + outflow AS DOUBLE), 6) AS in_share FROM (SELECT place, CAST(sum(i) AS BIGINT) AS inflow, CAST(sum(o) AS BIGINT) AS outflow FROM (SELECT want_municipality AS place, 1 AS i, 0 AS o FROM wishes WHERE municipality <> want_municipality UNION ALL SELECT municipality, 0, 1 FROM wishes WHERE municipality <> want_municipality) GROUP BY 1) ORDER BY abs(net_flow) DESC, place LIMIT 200""")
def agg58_flow_balance_top(spark, d):
    edges = core.cross(wishes(spark, d).filter("municipality <> want_municipality"), ["municipality", "want_municipality"])
    return rounded(G.flow_balance(edges, "municipality", "want_municipality", "count").orderBy(F.desc(F.abs("net_flow")), "place").limit(200))


@query("""SELECT municipality, 'age_gender' AS part, age_group || '/' || gender AS item, CAST(count(*) AS DOUBLE) AS value FROM people WHERE gender IS NOT NULL GROUP BY 1, 3 UNION ALL SELECT municipality, 'employment', employment, count(*) FROM people GROUP BY 1, 3
    UNION ALL SELECT municipality, 'summary', 'avg_age', round(avg(age), 6) FROM people GROUP BY 1""")
def agg59_municipality_detail(spark, d):
    p = people(spark, d)
    parts = [
        core.cross(p.withColumn("item", F.concat_ws("/", "age_group", "gender")).filter("gender is not null"), ["municipality", "item"]).select("municipality", F.lit("age_gender").alias("part"), "item", F.col("count").cast("double").alias("value")),
        core.cross(p, ["municipality", "employment"]).select("municipality", F.lit("employment").alias("part"), F.col("employment").alias("item"), F.col("count").cast("double").alias("value")),
        p.groupBy("municipality").agg(F.avg("age").alias("value")).select("municipality", F.lit("summary").alias("part"), F.lit("avg_age").alias("item"), "value"),
    ]
    return rounded(core.union_tables(*parts))


@query("""SELECT count(*) AS places, CAST(sum(w) AS BIGINT) AS demand, CAST(sum(p) AS BIGINT) AS supply, count(*) FILTER (w > p) AS short, count(*) FILTER (w <= p) AS surplus, round(sum(w) / CAST(sum(p) AS DOUBLE), 6) AS ratio FROM (SELECT coalesce(w, 0) AS w, coalesce(p, 0) AS p FROM (SELECT want_municipality AS m, count(*) AS w FROM areas GROUP BY 1) FULL JOIN (SELECT municipality AS m, count(*) AS p FROM people GROUP BY 1) USING (m))""")
def agg61_gap_totals(spark, d):
    g = A.demand_supply_gap(areas(spark, d).select(F.col("want_municipality").alias("municipality")), people(spark, d), ["municipality"])
    return rounded(g.agg(F.count("*").alias("places"), F.sum("demand_count").alias("demand"), F.sum("supply_count").alias("supply"), F.count_if(F.col("gap") > 0).alias("short"), F.count_if(F.col("gap") <= 0).alias("surplus"), (F.sum("demand_count").cast("double") / F.sum("supply_count")).alias("ratio")))


@query("""SELECT municipality, round(i / CAST(s AS DOUBLE), 6) AS popularity, round(o * 100.0 / a, 6) AS mobility_rate, r AS rank FROM (SELECT *, row_number() OVER (ORDER BY i / CAST(s AS DOUBLE) DESC, municipality) AS r FROM (SELECT want_municipality AS municipality, count(*) AS i FROM areas GROUP BY 1) JOIN (SELECT municipality, count(*) AS s FROM people GROUP BY 1) USING (municipality)
    JOIN (SELECT municipality, count(*) AS a, count(*) FILTER (municipality <> want_municipality) AS o FROM wishes GROUP BY 1) USING (municipality)) WHERE r <= 10""")
def agg61_popularity(spark, d):
    w = wishes(spark, d)
    i = w.groupBy(F.col("want_municipality").alias("municipality")).agg(F.count("*").alias("i"))
    s = people(spark, d).groupBy("municipality").agg(F.count("*").alias("s"))
    o = w.groupBy("municipality").agg(F.count("*").alias("a"), F.count_if(F.col("municipality") != F.col("want_municipality")).alias("o"))
    out = i.join(s, "municipality").join(o, "municipality").select("municipality", (F.col("i").cast("double") / F.col("s")).alias("popularity"), core.share(F.col("o"), F.col("a")).alias("mobility_rate"))
    return rounded(core.ranked(out, [F.desc("popularity"), F.asc("municipality")], 10))


@query("""SELECT level, name, round(avg_age, 6) AS avg_age, round(female, 6) AS female, round(licensed, 6) AS licensed, round(urgent, 6) AS urgent, people FROM (SELECT CASE WHEN grouping(municipality) = 0 THEN 'municipality' WHEN grouping(prefecture) = 0 THEN 'prefecture' ELSE 'nation' END AS level, coalesce(municipality, prefecture, 'all') AS name, avg(age) AS avg_age, avg(CASE WHEN gender = 'F' THEN 1.0 WHEN gender = 'M' THEN 0 END) AS female, avg(CASE WHEN has_license THEN 1.0 ELSE 0 END) AS licensed, avg(CASE WHEN urgent THEN 1.0 ELSE 0 END) AS urgent, count(*) AS people FROM people GROUP BY GROUPING SETS ((), (prefecture), (prefecture, municipality)))""")
def agg62_five_measures(spark, d):
    measures = [F.avg("age").alias("avg_age"), F.avg((F.col("gender") == "F").cast("double")).alias("female"), F.avg(F.col("has_license").cast("double")).alias("licensed"), F.avg(F.col("urgent").cast("double")).alias("urgent"), F.count("*").alias("people")]
    out = core.scopes(people(spark, d), {"nation": [], "prefecture": ["prefecture"], "municipality": HOME}, measures, "level")
    return rounded(out.withColumn("name", F.coalesce("municipality", "prefecture", F.lit("all"))).drop(*HOME))


@query("""SELECT place, base, age_group, count(*) FILTER (gender = 'M') AS "M", count(*) FILTER (gender = 'F') AS "F" FROM (SELECT municipality AS place, 'residence' AS base, age_group, gender FROM people UNION ALL SELECT want_municipality, 'desired', age_group, gender FROM wishes) GROUP BY 1, 2, 3""")
def agg65_pyramid(spark, d):
    live = people(spark, d).select(F.col("municipality").alias("place"), F.lit("residence").alias("base"), "age_group", "gender")
    want = wishes(spark, d).select(F.col("want_municipality").alias("place"), F.lit("desired").alias("base"), "age_group", "gender")
    return core.pivot_counts(live.unionByName(want), ["place", "base", "age_group"], "gender", ["M", "F"])


@query("""SELECT prefecture, count(*) FILTER (urgent) AS urgent, count(*) FILTER (has_license) AS licensed, round(avg(qualification_count), 6) AS avg_qualifications, age_group, count(*) AS count FROM people GROUP BY prefecture, age_group""")
def agg67_supply_by_persona(spark, d):
    return rounded(core.cross(people(spark, d), ["prefecture", "age_group"], [F.count_if("urgent").alias("urgent"), F.count_if("has_license").alias("licensed"), F.avg("qualification_count").alias("avg_qualifications")]))


_PAIRED = """, one AS (SELECT DISTINCT person_id, want_municipality, want_prefecture, age_group FROM wishes), pair AS (SELECT a.want_municipality AS place1, b.want_municipality AS place2, a.age_group FROM one a JOIN one b ON a.person_id = b.person_id AND a.want_municipality < b.want_municipality)"""


@query(_PAIRED + """ SELECT * FROM (SELECT 'all' AS facet, place1, place2, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, place1, place2) AS rank FROM pair GROUP BY 2, 3 UNION ALL SELECT age_group, place1, place2, count(*), row_number() OVER (PARTITION BY age_group ORDER BY count(*) DESC, place1, place2) FROM pair GROUP BY 1, 2, 3) WHERE rank <= 10""")
def agg68_desired_pairs_by_facet(spark, d):
    pairs = A.area_pairs(wishes(spark, d), "person_id", "want_municipality", "want_prefecture", keep=["age_group"])
    rows = core.scopes(pairs, {"all": ["place1", "place2"], "age": ["place1", "place2", "age_group"]}, [F.count("*").alias("count")]).withColumn("facet", F.coalesce("age_group", F.lit("all")))
    return core.top_n(rows, ["facet"], [F.desc("count"), F.asc("place1"), F.asc("place2")], 10, "rank").select("facet", "place1", "place2", "count", "rank")


@query("""SELECT place, inflow, local_count, sources, destinations, round(CASE WHEN o = 0 THEN 0 ELSE (inflow - local_count) / CAST(o AS DOUBLE) END, 6) AS in_out FROM (SELECT want_municipality AS place, count(*) AS inflow, count(*) FILTER (municipality = want_municipality) AS local_count FROM wishes GROUP BY 1)
    JOIN (SELECT municipality AS place, count(*) FILTER (municipality <> want_municipality) AS o FROM wishes GROUP BY 1) USING (place)
    JOIN (SELECT place, string_agg(m, ';' ORDER BY r) AS sources FROM (SELECT want_municipality AS place, municipality AS m, row_number() OVER (PARTITION BY want_municipality ORDER BY count(*) DESC, municipality) AS r FROM wishes WHERE municipality <> want_municipality GROUP BY 1, 2) WHERE r <= 7 GROUP BY 1) USING (place)
    JOIN (SELECT place, string_agg(m, ';' ORDER BY r) AS destinations FROM (SELECT municipality AS place, want_municipality AS m, row_number() OVER (PARTITION BY municipality ORDER BY count(*) DESC, want_municipality) AS r FROM wishes WHERE municipality <> want_municipality GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1) USING (place)""")
def agg69_sources_and_destinations(spark, d):
    w = wishes(spark, d)
    other = w.filter("municipality <> want_municipality")
    base = w.groupBy(F.col("want_municipality").alias("place")).agg(F.count("*").alias("inflow"), F.count_if(F.col("municipality") == F.col("want_municipality")).alias("local_count"))
    away = w.groupBy(F.col("municipality").alias("place")).agg(F.count_if(F.col("municipality") != F.col("want_municipality")).alias("o"))
    src = A.top_items(other, ["want_municipality"], "municipality", 7).select(F.col("want_municipality").alias("place"), F.col("top_items").alias("sources"))
    dst = A.top_items(other, ["municipality"], "want_municipality", 5).select(F.col("municipality").alias("place"), F.col("top_items").alias("destinations"))
    ratio = F.when(F.col("o") == 0, 0.0).otherwise((F.col("inflow") - F.col("local_count")).cast("double") / F.col("o"))
    return rounded(base.join(away, "place").join(src, "place").join(dst, "place").withColumn("in_out", ratio).drop("o"))


@query("""SELECT age_group, count(*) FILTER (employment = 'BUILDING') AS "BUILDING", count(*) FILTER (employment = 'MACHINERY') AS "MACHINERY", round(avg(qualification_count), 6) AS avg_qualifications, round(avg(CASE WHEN has_license THEN 1.0 ELSE 0 END), 6) AS license_rate FROM people GROUP BY 1""")
def agg70_career_panel(spark, d):
    p = people(spark, d)
    means = core.cross(p, ["age_group"], [F.avg("qualification_count").alias("avg_qualifications"), F.avg(F.col("has_license").cast("double")).alias("license_rate")]).drop("count")
    return rounded(core.pivot_counts(p, ["age_group"], "employment", ["BUILDING", "MACHINERY"]).join(means, "age_group"))


@query("""SELECT CASE WHEN grouping(age_group) = 0 THEN 'age' WHEN grouping(employment) = 0 THEN 'employment' ELSE 'all' END AS scope, age_group, employment, count(*) AS count, round(avg(6 - CAST(urgency[1] AS INTEGER)), 6) AS avg_score FROM wishes GROUP BY GROUPING SETS ((), (age_group), (employment))""")
def agg71_urgency_panel(spark, d):
    return rounded(core.scopes(_urgent(spark, d), {"all": [], "age": ["age_group"], "employment": ["employment"]}, [F.count("*").alias("count"), F.avg("urgency_score").alias("avg_score")]))


@query("""SELECT persona, count, round(count * 100.0 / total, 6) AS share_pct, employment_top, rank FROM (SELECT age_group || '_' || gender AS persona, count(*) AS count, sum(count(*)) OVER () AS total, row_number() OVER (ORDER BY count(*) DESC, age_group || '_' || gender) AS rank FROM people WHERE gender IS NOT NULL GROUP BY 1)
    JOIN (SELECT age_group || '_' || gender AS persona, employment AS employment_top, row_number() OVER (PARTITION BY age_group || '_' || gender ORDER BY count(*) DESC, employment) AS r FROM people WHERE gender IS NOT NULL GROUP BY 1, 2) USING (persona) WHERE rank <= 15 AND r = 1""")
def agg72_persona_list(spark, d):
    p = core.known(people(spark, d), ["gender"]).withColumn("persona", F.concat_ws("_", "age_group", "gender"))
    out = core.ranked(core.cross(p, ["persona"], within=()), [F.desc("count"), F.asc("persona")], 15)
    return rounded(out.join(A.top_share(p, ["persona"], "employment", "employment_top").select("persona", "employment_top"), "persona"))


@query(_HELD + """, top AS (SELECT qualification FROM skilled GROUP BY 1 ORDER BY count(*) DESC, qualification LIMIT 10) SELECT qualification, """ + ", ".join(f"""count(*) FILTER (age_group = '{a}') AS "{a}\"""" for a in ("20s", "30s", "40s", "50s", "60s", "70+")) + " FROM skilled JOIN top USING (qualification) GROUP BY 1")
def agg73_qualification_matrix(spark, d):
    s = _skilled(spark, d)
    top = core.cross(s, ["qualification"]).orderBy(F.desc("count"), "qualification").limit(10).select("qualification")
    return core.pivot_counts(s.join(top, "qualification", "left_semi"), ["qualification"], "age_group", ["20s", "30s", "40s", "50s", "60s", "70+"])


@query("""SELECT 'prefecture' AS level, prefecture AS place, count(*) AS count FROM wishes GROUP BY 2 UNION ALL (SELECT 'municipality', municipality, count(*) AS n FROM wishes GROUP BY 2 ORDER BY n DESC, municipality LIMIT 10)""")
def agg74_residence_flow_top(spark, d):
    w = wishes(spark, d)
    top = [core.cross(w, [c]).orderBy(F.desc("count"), c).limit(10).select(F.lit(c).alias("level"), F.col(c).alias("place"), "count") for c in HOME]
    return core.union_tables(*top)


@query("""SELECT age_group, employment, count(*) AS count, round(avg(qualification_count), 6) AS avg_qualifications, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY age_group), 6) AS share_pct FROM people GROUP BY 1, 2""")
def agg75_age_by_employment(spark, d):
    return rounded(core.cross(people(spark, d), ["age_group", "employment"], [F.avg("qualification_count").alias("avg_qualifications")], within=["age_group"]))


@query("""SELECT prefecture, w AS demand, p AS supply, round(w / CAST(p AS DOUBLE), 6) AS demand_ratio, abs(w - p) AS absolute_gap, round(p / CAST(m AS DOUBLE), 6) AS supply_density FROM (SELECT want_prefecture AS prefecture, count(*) AS w FROM areas GROUP BY 1) JOIN (SELECT prefecture, count(*) AS p, count(DISTINCT municipality) AS m FROM people GROUP BY 1) USING (prefecture)""")
def agg76_region_cross(spark, d):
    want = areas(spark, d).groupBy(F.col("want_prefecture").alias("prefecture")).agg(F.count("*").alias("demand"))
    live = people(spark, d).groupBy("prefecture").agg(F.count("*").alias("supply"), F.countDistinct("municipality").alias("m"))
    out = want.join(live, "prefecture")
    return rounded(out.select("prefecture", "demand", "supply", (F.col("demand").cast("double") / F.col("supply")).alias("demand_ratio"), F.abs(F.col("demand") - F.col("supply")).alias("absolute_gap"), (F.col("supply").cast("double") / F.col("m")).alias("supply_density")))


@query("""SELECT age_group, gender, has_license, count(*) AS places, CAST(sum(n) AS BIGINT) AS people, round(avg(1.0 / n), 6) AS avg_rarity, count(*) FILTER (n = 1) AS unique_cells FROM (SELECT municipality, age_group, gender, has_license, count(*) AS n FROM people WHERE age_group = '20s' AND gender IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3""")
def agg77_rarity_search(spark, d):
    cells = A.rarity(core.facets(people(spark, d), {"age_group": "20s", "gender": "all"}), ["municipality", "age_group", "gender", "has_license"])
    return rounded(cells.groupBy("age_group", "gender", "has_license").agg(F.count("*").alias("places"), F.sum("count").alias("people"), F.avg("rarity_score").alias("avg_rarity"), F.count_if(F.col("count") == 1).alias("unique_cells")))


# --- joins


@query("""SELECT want_municipality, age_group, count(*) AS count FROM areas LEFT JOIN (SELECT * FROM people WHERE has_license) p USING (person_id) GROUP BY 1, 2""")
def joi02_areas_with_attributes(spark, d):
    out = areas(spark, d).join(people(spark, d).filter("has_license").select("person_id", "age_group"), "person_id", "left")
    return out.groupBy("want_municipality", "age_group").agg(F.count("*").alias("count"))


@query("""SELECT b.municipality, b.age_group, b.gender, b.n, round(1.0 / r.n, 6) AS rarity_score, c.total, c.license_rate, CAST(g.gap AS DOUBLE) AS gap, CAST(f.inflow AS DOUBLE) AS inflow FROM (SELECT municipality, age_group, gender, count(*) AS n FROM people WHERE gender IS NOT NULL GROUP BY 1, 2, 3) b
    LEFT JOIN (SELECT municipality, age_group, gender, count(*) AS n FROM people WHERE has_license AND gender IS NOT NULL GROUP BY 1, 2, 3) r USING (municipality, age_group, gender) LEFT JOIN (SELECT municipality, count(*) AS total, round(avg(CASE WHEN has_license THEN 1.0 ELSE 0 END), 6) AS license_rate FROM people GROUP BY 1) c USING (municipality)
    LEFT JOIN (SELECT municipality, w - p AS gap FROM (SELECT want_municipality AS municipality, count(*) AS w FROM areas GROUP BY 1) JOIN (SELECT municipality, count(*) AS p FROM people GROUP BY 1) USING (municipality)) g USING (municipality) LEFT JOIN (SELECT want_municipality AS municipality, count(*) AS inflow FROM areas GROUP BY 1) f USING (municipality)""")
def joi09_persona_level(spark, d):
    """Personas with the rarity of licence holders among them, and their municipality's profile, gap and inflow."""
    p, keys = people(spark, d), ["municipality", "age_group", "gender"]
    base = core.cross(p, keys).withColumnRenamed("count", "n")
    rare = A.rarity(p.filter("has_license"), keys).select(*keys, "rarity_score")
    profile = A.competition(p, ["municipality"]).select("municipality", "total", "license_rate")
    want = areas(spark, d).select(F.col("want_municipality").alias("municipality"))
    gap = A.demand_supply_gap(want, p, ["municipality"]).filter("supply_count > 0 and demand_count > 0").select("municipality", F.col("gap").cast("double").alias("gap"))
    inflow = want.groupBy("municipality").agg(F.count("*").cast("double").alias("inflow"))
    return rounded(base.join(rare, keys, "left").join(profile, "municipality", "left").join(gap, "municipality", "left").join(inflow, "municipality", "left"))


@query("""SELECT o_orderpriority, c_mktsegment, n_name, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), 6) AS share_pct FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""", base=False)
def joi11_three_way_cross(spark, d):
    """A dimension from each of three named tables, joined on keys."""
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    met = core.join_chain({"orders": o, "customer": c, "nation": n}, [("orders.o_custkey", "customer.c_custkey"), ("customer.c_nationkey", "nation.n_nationkey")])
    return rounded(core.cross(met, ["o_orderpriority", "c_mktsegment", "n_name"], within=()))


@query(f", {_COORDINATES} SELECT DISTINCT want_prefecture, want_municipality FROM areas WHERE (want_prefecture, want_municipality) NOT IN (SELECT prefecture, municipality FROM coords WHERE lat < 38)")
def joi13_missing_coordinates(spark, d):
    known = _coordinates(spark, d).filter("lat < 38").select(F.col("prefecture").alias("want_prefecture"), F.col("municipality").alias("want_municipality"))
    return core.difference(areas(spark, d).select(*WANT).distinct(), known, WANT)


@query("""SELECT age_group, employment, count(*) AS count, round(any_value(q) * 1000 / count(*), 6) AS rarity FROM people JOIN (SELECT age_group, employment, avg(qualification_count) AS q FROM people GROUP BY 1, 2) USING (age_group, employment) GROUP BY 1, 2""")
def joi16_persona_and_profile(spark, d):
    p, keys = people(spark, d), ["age_group", "employment"]
    out = core.cross(p, keys).join(p.groupBy(*keys).agg(F.avg("qualification_count").alias("q")), keys)
    return rounded(out.select(*keys, "count", (F.col("q") * 1000 / F.col("count")).alias("rarity")))


@query("""SELECT age_group, urgency, q, CASE WHEN u * 2 >= 8 THEN 'high' WHEN u * 2 >= 5 THEN 'middle' ELSE 'low' END AS level, count FROM (SELECT age_group, urgency, count(*) AS count, avg(6 - CAST(urgency[1] AS INTEGER)) AS u FROM wishes GROUP BY 1, 2) JOIN (SELECT age_group, round(avg(qualification_count), 6) AS q FROM people GROUP BY 1) USING (age_group)""")
def joi17_urgency_and_profile(spark, d):
    u = core.cross(_urgent(spark, d), ["age_group", "urgency"], [F.avg("urgency_score").alias("u")])
    q = people(spark, d).groupBy("age_group").agg(F.avg("qualification_count").alias("q"))
    score = F.col("u") * 2
    return rounded(u.join(q, "age_group").select("age_group", "urgency", "q", F.when(score >= 8, "high").when(score >= 5, "middle").otherwise("low").alias("level"), "count"))


@query(_MOBILE + """ SELECT p.age_group, CASE WHEN mobility >= 0.8 THEN 'A' WHEN mobility >= 0.5 THEN 'B' WHEN mobility > 0 THEN 'C' ELSE 'D' END AS mobility_rank, count(*) AS count FROM people p JOIN (SELECT CAST(person_id AS VARCHAR) AS id, mobility FROM mobile) m ON CAST(p.person_id AS VARCHAR) = m.id GROUP BY 1, 2""")
def joi18_persona_mobility(spark, d):
    m = _movers(spark, d).select(F.col("person_id").cast("string").alias("id"), person.mobility_rank(F.col("mobility")).alias("mobility_rank"))
    p = people(spark, d).select(F.col("person_id").cast("string").alias("id"), "age_group")
    return core.cross(p.join(m, "id"), ["age_group", "mobility_rank"])


@query("""SELECT major, grp, element, count(*) AS count FROM (SELECT unnest(str_split(p_type, ' ')) AS e FROM part) JOIN (SELECT * FROM (VALUES ('STEEL', 'metal', 'heavy', 'STEEL'), ('BRASS', 'metal', 'light', 'BRASS'), ('TIN', 'metal', 'light', 'TIN'), ('COPPER', 'metal', 'heavy', 'COPPER'), ('STD', 'size', 'usual', 'STANDARD'), ('STANDARD', 'size', 'usual', 'STANDARD'), ('SMALL', 'size', 'odd', 'SMALL')) t(e, major, grp, element)) USING (e) GROUP BY 1, 2, 3""", base=False)
def joi19_element_groups(spark, d):
    """Elements of a text list, cut forms first made whole, with their group and major group."""
    elements = table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("element"))
    alias = spark.createDataFrame([("STD", "STANDARD")], "element string, whole string")
    groups = spark.createDataFrame([("STEEL", "metal", "heavy"), ("BRASS", "metal", "light"), ("TIN", "metal", "light"), ("COPPER", "metal", "heavy"), ("STANDARD", "size", "usual"), ("SMALL", "size", "odd")], "element string, major string, grp string")
    return core.cross(P.grouped_elements(elements, "element", alias, groups), ["major", "grp", "element"])


# --- adverts

#: Texts as employers write them, made of each advert's row.
_TEXTS = """, texts AS (SELECT *, concat_ws(' ', CASE WHEN has_bulk THEN '身体介護 入浴介助' END, CASE WHEN has_tax THEN '調理補助 未経験可 20代活躍' END, CASE WHEN has_open THEN '急募 今すぐ ママさん歓迎 時短勤務' END, CASE WHEN has_discount THEN '男性活躍 力仕事 資格取得支援制度 スキルアップ' END) AS body FROM adverts)"""


def _texts(spark, d):
    parts = {"has_bulk": "身体介護 入浴介助", "has_tax": "調理補助 未経験可 20代活躍", "has_open": "急募 今すぐ ママさん歓迎 時短勤務", "has_discount": "男性活躍 力仕事 資格取得支援制度 スキルアップ"}
    return adverts(spark, d).withColumn("body", F.concat_ws(" ", *[F.when(F.col(f), F.lit(t)) for f, t in parts.items()]))


@query(_TEXTS + """ SELECT prefecture, category, count(*) AS count, round(count(*) * 100.0 / any_value(total), 6) AS share_pct, any_value(total) AS total FROM (SELECT prefecture, unnest(list_filter([CASE WHEN has_bulk AND length(body) >= 10 THEN '直接介護・看護' END, CASE WHEN has_tax AND length(body) >= 10 THEN '調理' END], lambda x: x IS NOT NULL)) AS category FROM texts) JOIN (SELECT prefecture, count(*) AS total FROM texts GROUP BY 1) USING (prefecture) GROUP BY 1, 2""")
def pos06_content_categories(spark, d):
    t = _texts(spark, d).withColumn("categories", advert.content(F.col("body"))["categories"])
    return rounded(P.tag_frequency(t, "categories", ["prefecture"]).withColumnRenamed("tag", "category"))


@query("""SELECT job_type, employment, count(*) AS n, CAST(trunc(avg(salary)) AS BIGINT) AS mean_low, CAST(trunc(median(salary)) AS BIGINT) AS median_low, CAST(trunc(avg(salary_high)) AS BIGINT) AS mean_high, CAST(trunc(median(salary_high)) AS BIGINT) AS median_high, round(avg(CAST(has_bulk AS INTEGER) + CAST(has_tax AS INTEGER)), 4) AS mean_benefits FROM adverts GROUP BY 1, 2 HAVING count(*) >= 3""")
def pos07_segment_pay(spark, d):
    a = adverts(spark, d).withColumn("benefits", F.col("has_bulk").cast("int") + F.col("has_tax").cast("int"))
    return rounded(P.salary_stats(a, "salary", "salary_high", {"segment": ["job_type", "employment"]}, means=["benefits"]).drop("scope"), 4)


@query(_TEXTS + """ SELECT prefecture, flag, CAST(sum(n) AS BIGINT) AS count, any_value(total) AS total, round(sum(n) * 100.0 / any_value(total), 6) AS share_pct FROM (SELECT prefecture, unnest(['20代', '30代', '40代', '50代', '60代']) AS flag, unnest([CAST(has_tax AS INTEGER), CAST(has_open AS INTEGER), CAST(has_discount AS INTEGER), 0, 0]) AS n FROM texts) JOIN (SELECT prefecture, count(*) AS total FROM texts GROUP BY 1) USING (prefecture) GROUP BY 1, 2""")
def pos08_age_signals(spark, d):
    t = core.counted(_texts(spark, d), "prefecture", "body").withColumn("a", advert.decades(F.col("body")))
    names = ["20代", "30代", "40代", "50代", "60代"]
    t = t.select("prefecture", "count", *[(F.col("a.scores")[n] >= 1).alias(n) for n in names])
    return rounded(P.flag_frequency(t, names, ["prefecture"], "count"))


@query(_TEXTS + """ SELECT prefecture, signal, stage, count(*) AS count FROM (SELECT prefecture, CASE WHEN has_open AND has_discount THEN 'male_leaning' WHEN has_open THEN 'female_leaning' WHEN has_discount THEN 'male_leaning' ELSE 'none' END AS signal, CASE WHEN has_open AND has_discount THEN 'キャリア形成期' WHEN has_open THEN '育児期' WHEN has_discount THEN 'キャリア形成期' ELSE 'none' END AS stage FROM texts) GROUP BY 1, 2, 3""")
def pos09_gender_and_stage(spark, d):
    t = core.counted(core.known(_texts(spark, d), ["prefecture"]), "prefecture", "body").withColumn("g", advert.gender_and_stage(F.col("body")))
    t = t.select("prefecture", "count", F.coalesce("g.signal", F.lit("none")).alias("signal"), F.coalesce("g.primary", F.lit("none")).alias("stage"))
    return t.groupBy("prefecture", "signal", "stage").agg(F.sum("count").alias("count"))


@query(_TEXTS + """ SELECT prefecture, segment, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY prefecture), 6) AS share_pct FROM (SELECT prefecture, CASE WHEN has_tax AND has_discount THEN '未経験×無資格' WHEN has_tax THEN '未経験×有資格' WHEN has_discount THEN '経験者×無資格' ELSE '経験者×有資格' END AS segment FROM texts) GROUP BY 1, 2""")
def pos10_experience_segments(spark, d):
    body = F.col("body")
    t = _texts(spark, d).withColumn("segment", advert.experience_quadrant(advert.beginners_welcome(body, F.lit(None).cast("string")), body.rlike("無資格可|資格取得支援")))
    return rounded(core.cross(t, ["prefecture", "segment"], within=["prefecture"]))


_HOURS = ["9:00～18:00 休憩60分 残業なし", "8:30〜17:30 残業月20時間", "夜勤専従 17:00〜9:00", "日勤のみ 時間外あり", "シフト制 7:00〜16:00 13:00〜22:00"]


@query(f""" SELECT prefecture, axis, category, count(*) AS count, CAST(sum(count(*)) OVER (PARTITION BY prefecture, axis) AS BIGINT) AS total, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY prefecture, axis), 6) AS share_pct, 'prefecture' AS scope FROM (SELECT prefecture, unnest(['shift', 'start', 'overtime']) AS axis, unnest([
    ['固定時間', '固定時間', '夜勤専従', '日勤のみ', 'シフト制'][1 + facility % 5], ['午前(9-11時)', '朝(7-9時)', '午後(11時以降)', '不明', '朝(7-9時)'][1 + facility % 5], ['残業なし', '月20h以内', '不明', '残業あり', '不明'][1 + facility % 5]]) AS category FROM adverts) GROUP BY 1, 2, 3""")
def pos11_work_schedule(spark, d):
    a = core.counted(adverts(spark, d).withColumn("hours", _pick(F.col("facility"), _HOURS)), "prefecture", "hours")
    w = advert.working_hours(F.col("hours"))
    a = a.select("prefecture", "count", advert.shift_type(F.col("hours")).alias("shift"), advert.hour_bands(F.array_min(w["starts"]), F.array_max(w["ends"]))[0].alias("start"), advert.overtime(F.col("hours")).alias("overtime"))
    return rounded(P.axis_shares(a, ["shift", "start", "overtime"], {"prefecture": ["prefecture"]}, 1, "count"))


_DAYS = ["完全週休2日 年間休日120日", "4週8休 年間休日108日", "シフトによる 年末年始", "日曜固定 木曜午後休", "土日祝休み GW お盆"]


@query(""" SELECT prefecture, pattern, band, count(*) AS count, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY prefecture), 6) AS share_pct FROM (SELECT prefecture, ['完全週休2日', '4週8休', 'シフト制', '日曜固定休', '土日祝休'][1 + facility % 5] AS pattern, ['120+', '105-109', 'unknown', 'unknown', 'unknown'][1 + facility % 5] AS band FROM adverts) GROUP BY 1, 2, 3""")
def pos12_holidays(spark, d):
    days = _pick(F.col("facility"), _DAYS)
    a = adverts(spark, d).select("prefecture", advert.holiday_pattern(days).alias("pattern"), F.coalesce(advert.holiday_band(advert.annual_holidays(days)), F.lit("unknown")).alias("band"))
    return rounded(core.cross(a, ["prefecture", "pattern", "band"], within=["prefecture"]))


@query(""" SELECT k, ['土日', '日曜', '不明'][1 + CASE k % 5 WHEN 4 THEN 0 WHEN 3 THEN 1 ELSE 2 END] AS weekday_off, ['', '', '年末年始', '', '夏季,GW'][1 + k % 5] AS special, CAST(CASE k % 5 WHEN 0 THEN 4 WHEN 1 THEN 3 END AS DOUBLE) AS score, CAST(CASE WHEN k % 5 = 0 THEN 60 END AS DOUBLE) AS break_minutes, ['9:00-18:00', '8:30-17:30', '17:00-9:00', '日勤のみ', '7:00-16:00'][1 + k % 5] AS summary FROM (SELECT p_partkey AS k FROM part)""", base=False)
def fun32_fun34_fun55(spark, d):
    k = F.col("k")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k")).withColumns({"days": _pick(k, _DAYS), "hours": _pick(k, _HOURS)})
    days, hours = F.col("days"), F.col("hours")
    score = F.when(advert.annual_holidays(days).isNotNull(), advert.holiday_score(advert.annual_holidays(days)))
    return p.select("k", advert.weekday_off(days).alias("weekday_off"), F.array_join(advert.special_leave(days), ",").alias("special"), score.cast("double").alias("score"), advert.break_minutes(hours).cast("double").alias("break_minutes"), advert.hours_summary(hours).alias("summary"))


@query(""" SELECT k, ['正職員', 'パート・バイト', '契約職員', NULL][1 + k % 4] AS employment, CAST(CASE k % 3 WHEN 0 THEN 3500000 WHEN 1 THEN 3800000 END AS DOUBLE) AS income, ['正職員', '派遣', 'パート・バイト'][1 + k % 3] AS in_salary FROM (SELECT p_partkey AS k FROM part)""", base=False)
def fun29_fun30(spark, d):
    k = F.col("k")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    return p.select(
        "k", advert.employment_type(_pick(k, ["【正社員】", "アルバイト", "契約職員", "x"])).alias("employment"), advert.annual_income(_pick(k, ["想定年収 350万円〜450万円", "380", "要相談"])).cast("double").alias("income"),
        advert.employment_in_salary(_pick(k, ["【正職員】月給 186,000円", "月給 20万円 派遣", "パート 時給 1,200円"])).alias("in_salary"),
    )


@query("""SELECT job_type, employment, round(avg(CASE WHEN has_open THEN salary END) - avg(CASE WHEN NOT has_open THEN salary END), 4) AS gap, count(*) FILTER (has_open) AS inexperienced, count(*) FILTER (NOT has_open) AS experienced FROM adverts GROUP BY 1, 2""")
def pos20_experience_gap(spark, d):
    """Pay of adverts open to beginners against the others."""
    beginners = F.col("has_open")
    return rounded(core.known(adverts(spark, d), ["job_type", "employment"]).groupBy("job_type", "employment").agg((F.avg(F.when(beginners, F.col("salary"))) - F.avg(F.when(~beginners, F.col("salary")))).alias("gap"), F.count_if(beginners).alias("inexperienced"), F.count_if(~beginners).alias("experienced")), 4)


# --- clusters


@query()
def clu05_applicant_segments(spark, d):
    """Segments of people by age, gender, age band and desired areas, ages beyond 1.5 interquartile ranges left out."""
    m = _movers(spark, d).withColumn("all", F.lit(1))
    m = S.trim_outliers(m, ["all"], "age").withColumns({"female": (F.coalesce("gender", F.lit("")) == "F").cast("double"), "decade": F.floor(F.col("age") / 10).cast("double")})
    grouped = C.assign_clusters(m, ["age", "female", "decade", "area_count"], ks=(4,), scaling="standard", least=-1.0)
    return rounded(C.segment_names(grouped, "age", "area_count"))


@query()
def clu06_prefecture_clusters(spark, d):
    """Groups of municipalities by the shares of their adverts."""
    shares = adverts(spark, d).groupBy("municipality").agg(F.avg("salary").alias("salary"), *[F.avg(F.col(f).cast("double")).alias(f) for f in FLAGS])
    grouped = C.assign_clusters(shares, ["salary", *FLAGS], ks=(3, 4, 5, 6), scaling="standard", few=10)
    return grouped.join(C.cluster_labels(grouped, ["salary", *FLAGS]), "cluster").select("municipality", F.col("cluster").cast("int").alias("cluster"), "label")


assert SQL  # the queries' frames
