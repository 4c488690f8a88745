"""Columns from texts of job seekers and adverts, on cases that the registered queries don't hold."""

import datetime

from pyspark.sql import functions as F

from shokuba.functions import careers as K
from shokuba.functions import postings as J
from shokuba.operators import core
from shokuba.operators import postings as PO


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame([(x,) for x in rows], "s string").select(*columns).collect()]


def test_career(spark):
    c = K.career(F.col("s"))
    rows = ["経済学部(大学)(2020年3月卒業)、普通科(高等学校)(2016年3月卒業)", "短期大学(2001卒)", "高等専門学校 在学中", "独学", "", None, "中学校、中学"]
    got = values(spark, rows, c["level"], c["field"], c["graduation_year"], c["is_current"], c["levels"])
    assert got == [
        ("大学", "経済学部", 2020, False, ["大学", "高校"]), ("大学", "短期大学", 2001, False, ["大学"]), ("高専", None, None, True, ["高専"]), ("その他", None, None, False, ["その他"]),
        ("なし", None, None, False, []), ("なし", None, None, False, []), ("中学", None, None, False, ["中学", "中学"]),
    ]


def test_experience_and_jobs(spark):
    e = K.experience(F.col("s"))
    assert values(spark, ["10年以上", "年以上", "5年未満", "未満", "３年", "x", None], e["months"], e["bucket"]) == [(120, ">=10y"), (None, ">=10y"), (None, "< 5y"), (None, "<1y"), (36, "3y"), (None, "unknown"), (None, "unknown")]
    got = values(spark, ["介護職 (3年),看護師"], K.experienced_jobs(F.col("s")))
    assert [tuple(x) for x in got[0][0]] == [("介護職", 36, "3y"), ("看護師", None, "unknown")]


def test_starts(spark):
    ref = F.lit(datetime.date(2026, 1, 1))
    s = K.stated_start(F.col("s"), ref)
    rows = ["今すぐに（2025/11/02時点）", "3ヶ月以上先", "未定（2020/1/1時点）", "機会があれば（2020/13/45時点）", "", None]
    assert values(spark, rows, s["points"], s["decayed"], s["text"], s["days"]) == [(5, 4.0, "今すぐに", 60), (2, 2.0, "3ヶ月以上先", None), (0, 0.0, "未定", 2192), (1, 1.0, "機会があれば", None), (0, 0.0, None, None), (0, 0.0, None, None)]
    c = K.start_code(F.col("s"), ref)
    assert values(spark, ["今すぐに(2025/1/1時点)", "3ヶ月以内（2025/12/31時点）", "x", " ", None], c["code"], c["stale"], c["score"]) == [("now", True, 5.0), ("<=3m", False, 7.5), ("unknown", None, 0.0), (None, None, 0.0), (None, None, 0.0)]


def test_places(spark):
    got = values(spark, ["さいたま市 大宮区1", "府中市宮町1区", "愛知郡東郷町 1", "愛知郡日進市", "千代田区", "JR", None], K.clean_municipality(F.col("s")))
    assert [v for (v,) in got] == ["さいたま市大宮区", "府中市", "愛知郡東郷町", "愛知郡日進市", "千代田区", "", ""]
    p = K.repaired_place(F.col("s"), F.lit("中央線"))
    assert values(spark, ["大阪府", "大阪府大阪市北区1-1", "大阪府x", "x", None], p["prefecture"], p["municipality"]) == [("大阪府", ""), ("大阪府", "大阪市北区"), ("大阪府", ""), ("x", "中央線"), ("", "中央線")]
    assert [v for (v,) in values(spark, ["京都", "東京", "北海", "京都府", None], K.full_prefecture(F.col("s")))] == ["京都府", "東京都", "北海", "京都府", None]


def test_fill_missing(spark):
    df = spark.createDataFrame([(None, None, None, None)], "desired_area array<string>, urgency_score int, education_level string, age int")
    assert tuple(K.fill_missing(df).first()) == ([], 0, "なし", None)


def test_applicant_table(spark):
    rows = [("49歳 女性", "京都府京都市", "京都府京都市北区,x,大阪府", "准看護師,なし", "看護科(専門学校)(2001年卒)", "今すぐに（2025/1/1時点）", 7), (None, None, None, None, None, None, 8)]
    got = K.applicant_table(spark.createDataFrame(rows, "s string, residence string, desired_area string, qualifications string, career string, desired_start string, member_id int"), {"age_gender": "s"}).collect()
    a, b = got
    assert (a.age, a.gender, a.age_bucket, a.age_group, a.residence_pref, a.residence_muni, a.area_count, a.held, a.has_national_licence, a.school.level, a.start, a.member_id) == (49, "女性", "40s", "40代", "京都府", "京都市", 2, ["准看護師"], True, "専門", "今すぐに", 7)
    assert (b.age, b.age_group, b.area_count, b.qualification_count, b.has_national_licence, b.school.level, b.start) == (None, None, 0, 0, False, "なし", "その他")
    held = spark.createDataFrame([(["管理栄養士"],)], "h array<string>")
    assert tuple(held.select(*[K.national_licence(F.col("h"), p) for p in ("exact", "master", "part", "wide part")]).first()) == (False, True, True, False)


def test_advert_texts(spark):
    assert [v for (v,) in values(spark, ["【正社員】", "非常勤", "x", None], J.employment_type(F.col("s")))] == ["正職員", "パート・バイト", None, None]
    assert [v for (v,) in values(spark, ["月給 派遣社員", "契約社員 月給", "【?】正職員", None], J.employment_in_salary(F.col("s")))] == ["派遣", "契約職員", None, None]
    assert [v for (v,) in values(spark, ["350万円〜450万円", "1,200万", "400", "99", "3500000", "x", None], J.annual_income(F.col("s")))] == [3500000, 12000000, 4000000, None, 3500000, None, None]
    assert [v for (v,) in values(spark, ["残業なし", "残業ほぼなし", "残業月5時間", "時間外労働月平均20時間", "残業月45時間", "時間外あり", "x"], J.overtime(F.col("s")))] == ["残業なし", "残業ほぼなし", "残業ほぼなし", "月20h以内", "残業あり", "残業あり", "不明"]
    assert [v for (v,) in values(spark, ["9：00～18:00", "夜勤なし 残業なし", "あ" * 50, None], J.hours_summary(F.col("s")))] == ["9:00-18:00", "夜勤なし 残業なし", "あ" * 40 + "…", None]
    c = J.content(F.col("s"))
    assert values(spark, ["調理補助と身体介護です。急募!至急!", "ぜひ一緒に働きましょう。記録業務", "短い", None], c["categories"], c["primary"], c["tone"], c["detail"]) == [
        (["直接介護・看護", "調理"], "直接介護・看護", "urgent", "low"), (["間接業務"], "間接業務", "casual", "low"), ([], None, "unknown", "low"), ([], None, "unknown", "low"),
    ]
    g = J.gender_and_stage(F.col("s"))
    assert values(spark, ["子育て 学校行事参加", "力仕事", "女性活躍 男性活躍", "x", None], g["female"], g["signal"], g["primary"]) == [(1, "female_leaning", "育児期"), (0, "male_leaning", None), (1, "neutral", None), (0, None, None), (0, None, None)]
    a = J.decades(F.col("s"))
    assert values(spark, ["平均年齢25歳 SNS 管理職", None], a["primary"], a["all"]) == [("20代", ["20代", "40代"]), (None, [])]


def test_text_scores(spark):
    t = J.text_scores(F.col("s"), {"warm": {"笑顔": 1}, "cold": {"規則": 2}}, F.length("s"))
    assert [list(v) for (v,) in values(spark, ["笑顔の規則不笑顔", "", None], t["top"])] == [["cold", "warm"], [], []]


def test_joined_tables_and_elements(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(2, "p")], "z int, w string")
    assert core.join_chain({"a": a, "b": b}, [("a.y", "b.z")]).first().w == "p"
    e = spark.createDataFrame([("ab",), ("abc",), ("zz",), (None,)], "e string")
    alias, groups = spark.createDataFrame([("ab", "abc")], "element string, whole string"), spark.createDataFrame([("abc", "g")], "element string, grp string")
    assert PO.grouped_elements(e, "e", alias, groups).groupBy("e", "grp").count().collect() == [("abc", "g", 2)]
