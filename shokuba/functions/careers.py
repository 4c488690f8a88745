"""Columns from the texts of job seekers on schooling, experience, wishes and status, and address repairs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shokuba.functions.dictionaries import NATIONAL_LICENCES
from shokuba.functions.people import PREFECTURES, _PREFECTURE, age_decade, age_gender, blank_to_null, desired_areas, extract, fold_width, holds_any, qualifications, region
from shokuba.operators.core import bands

# School levels by the words that name them, highest first.
SCHOOL_LEVELS = (("大学院", "大学院"), ("大学", "大学"), ("短大", "短大"), ("高専", "高専|高等専門学校"), ("専門", "専門"), ("高校", "高校|高等学校"), ("中学", "中学"))

# Wordings of a status, a gender and a school level.
STATUS_ALIASES = {
    "就業中": ("就業中", "在職中", "就業中（正社員）", "就業中（契約社員）", "就業中（派遣社員）", "就業中（パート）", "就業中（アルバイト）"),
    "離職中": ("離職中", "退職済み", "無職", "求職中", "転職活動中"),
    "在学中": ("在学中", "学生", "大学生", "専門学校生"),
}
GENDER_ALIASES = {"男性": ("男性", "男", "M", "Male", "male"), "女性": ("女性", "女", "F", "Female", "female")}
EDUCATION_WORDS = (
    ("大学院", "大学院|修士|博士"),
    ("大学", "大学|大卒|学士"),
    ("短期大学", "短期大学|短大"),
    ("専門学校", "専門学校|専門|専修学校"),
    ("高等学校", "高等学校|高校|高卒"),
    ("中学校", "中学校|中学|中卒"),
)

# Wished starts by the words that name them, first match wins: points, category, short code.
START_POINTS = (("今すぐ", 5), ("1ヶ月以内", 4), ("3ヶ月以内", 3), ("3ヶ月以上先", 2), ("機会があれば", 1))
START_CATEGORIES = (("今すぐに", "今すぐ"), ("1ヶ月以内", "1[ヶか]月"), ("3ヶ月以内", "3[ヶか]月以内"), ("3ヶ月以上先", "3[ヶか]月以上"), ("機会があれば", "機会があれば"))
START_CODES = (("now", "今すぐ"), ("<=3m", "3ヶ月以内"), ("consider", "機会があれば"))

# Classes of a qualification's name, first match wins.
QUALIFICATION_CLASSES = (("国家資格", "介護福祉士"), ("専門資格", "ケアマネ|介護支援専門員"), ("介護研修", "実務者研修|初任者研修"), ("免許", "自動車|運転免許"), ("医療資格", "看護"), ("その他", "その他"))

# Designated cities, whose wards belong to the municipality's name.
DESIGNATED_CITIES = "札幌市 仙台市 さいたま市 千葉市 横浜市 川崎市 相模原市 新潟市 静岡市 浜松市 名古屋市 京都市 大阪市 堺市 神戸市 岡山市 広島市 北九州市 福岡市 熊本市".split()

#: What stands in for a missing value, by column; a list stands for an empty array.
MISSING = {"desired_area": [], "urgency_score": 0, "education_level": "なし"}


def _ladder(c: Column, rungs: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise)
    for label, words in reversed(rungs):
        out = F.when(c.rlike(words), F.lit(label)).otherwise(out)
    return out


def career(c: Column) -> Column:
    """struct<level,field,graduation_year,is_current,levels> of a list of schools parted by '、'.

    The highest school gives the first four, the first one on ties; levels are those of all schools, highest first.
    Null and blank text: level なし and no levels. A school without a known word is その他.
    """
    entries = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "、"), lambda x: F.trim(x)), lambda x: x != "")

    def school(x: Column, i: Column) -> Column:
        height = F.lit(0)
        for k, (_, words) in enumerate(reversed(SCHOOL_LEVELS), 1):
            height = F.when(x.rlike(words), k).otherwise(height)
        year = F.coalesce(extract(x, r"([0-9]{4})年[0-9]{1,2}月卒業"), extract(x, r"([0-9]{4})年?卒"), extract(x, r"([0-9]{4})/[0-9]{1,2}\s*卒業")).try_cast("int")
        return F.struct(height.alias("height"), (-i).alias("place"), _ladder(x, SCHOOL_LEVELS, "その他").alias("level"), blank_to_null(F.regexp_extract(x, r"^([^(（]+)(?=[（(])", 1)).alias("field"), year.alias("year"), x.rlike("在学|中退").alias("current"))

    schools = F.transform(entries, school)
    best = F.array_max(schools)
    return F.struct(
        F.coalesce(best["level"], F.lit("なし")).alias("level"), best["field"].alias("field"), best["year"].alias("graduation_year"), F.coalesce(best["current"], F.lit(False)).alias("is_current"),
        F.transform(F.sort_array(schools, False), lambda x: x["level"]).alias("levels"),
    )


def schooling(df: DataFrame, text: str, dictionary: DataFrame) -> DataFrame:
    """`df` with level_code, field_code, grad_year and confidence of a text.

    dictionary: (domain, token, canonical), a dimension table; the whole text is looked up as a level and as a field, and
    the first year from 1900 to 2099 is taken. confidence is high with two of the three or more, medium with one.
    """
    out = df.withColumn("_t", F.trim(fold_width(F.col(text))))
    for domain, name in (("education_levels", "level_code"), ("fields", "field_code")):
        own = dictionary.filter(F.col("domain") == domain).select(F.col("token").alias("_t"), F.col("canonical").alias(name))
        out = out.join(own, "_t", "left")
    out = out.withColumn("grad_year", extract(F.col("_t"), "(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])").try_cast("int"))
    hits = sum((F.col(c).isNotNull().cast("int") for c in ("level_code", "field_code", "grad_year")), F.lit(0))
    return out.withColumn("confidence", F.when(hits >= 2, "high").when(hits == 1, "medium").otherwise("low")).drop("_t")


def experience(c: Column) -> Column:
    """struct<months,bucket> of a length of experience: 3年 is exact, 10年以上 at least, 1年未満 has no months."""
    s = fold_width(c)
    years = extract(s, "([0-9]+)(?:年|yr|years?)").try_cast("int")
    least, below = F.contains(s, F.lit("年以上")), F.contains(s, F.lit("未満"))
    bucket = (
        F.when(least, F.coalesce(F.concat(F.lit(">="), years.cast("string"), F.lit("y")), F.lit(">=10y")))
        .when(below, F.coalesce(F.concat(F.lit("< "), years.cast("string"), F.lit("y")), F.lit("<1y")))
        .otherwise(F.coalesce(F.concat(years.cast("string"), F.lit("y")), F.lit("unknown")))
    )
    return F.struct(F.when(~below | least, years * 12).alias("months"), bucket.alias("bucket"))


def experienced_jobs(c: Column) -> Column:
    """array<struct<job,months,bucket>> of 'job (length),...'; a job without brackets has an unknown length."""
    def one(x: Column) -> Column:
        held = experience(F.regexp_extract(x, r"\((.*)\)", 1))
        return F.struct(F.trim(F.regexp_extract(x, r"^([^(]*)", 1)).alias("job"), held["months"].alias("months"), held["bucket"].alias("bucket"))

    return F.transform(F.filter(F.split(fold_width(c), r"[,、，・/／;；]+"), lambda x: F.trim(x) != ""), one)


def qualification_list(c: Column) -> Column:
    """array<struct<name,category,is_planned>> of a comma list; planned ones keep their name without that word."""
    def one(x: Column) -> Column:
        name = F.trim(F.regexp_replace(x, r"\s*取得予定.*$", ""))
        return F.struct(name.alias("name"), _ladder(name, QUALIFICATION_CLASSES, "専門資格").alias("category"), F.contains(x, F.lit("取得予定")).alias("is_planned"))

    held = F.transform(F.split(c, ","), one)
    return F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) > 0, held).otherwise(F.expr("cast(array() as array<struct<name:string,category:string,is_planned:boolean>>)"))


def stated_start(c: Column, reference: Column) -> Column:
    """struct<points,decayed,text,stated,days> of a wished start: points 0-5, and less one for each 60 days since it was
    stated, 1 at least and two decimals; without a date, and with 0 points, the points as they are."""
    points = F.lit(0)
    for word, n in reversed(START_POINTS):
        points = F.when(F.contains(c, F.lit(word)), n).otherwise(points)
    points = F.coalesce(points, F.lit(0))
    stated = F.try_to_date(extract(c, "([0-9]{4}/[0-9]{1,2}/[0-9]{1,2})"), "y/M/d")
    days = F.datediff(reference, stated)
    decayed = F.when((points >= 1) & days.isNotNull(), F.greatest(F.lit(1.0), points - days / F.lit(60.0))).otherwise(points.cast("double"))
    return F.struct(points.alias("points"), F.round(decayed, 2).alias("decayed"), blank_to_null(F.regexp_extract(c, "^([^（(]+)", 1)).alias("text"), stated.alias("stated"), days.alias("days"))


def start_code(c: Column, reference: Column, days: int = 90) -> Column:
    """struct<code,stated,stale,score> of a wished start: now 10, within three months 7.5, by chance 2.5, else 0; half of
    it if stated more than `days` before. Null and blank text give null fields and 0."""
    s = blank_to_null(fold_width(c))
    code = F.when(s.isNotNull(), _ladder(s, START_CODES, "unknown"))
    stated = F.try_to_date(F.replace(extract(s, r"\(([0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2})時点\)"), F.lit("/"), F.lit("-")), "y-M-d")
    stale = F.datediff(reference, stated) > days
    base = F.when(code == "now", 10.0).when(code == "<=3m", 7.5).when(code == "consider", 2.5).otherwise(0.0)
    return F.struct(code.alias("code"), stated.alias("stated"), stale.alias("stale"), F.when(stale, base * 0.5).otherwise(base).alias("score"))


def start_category(c: Column) -> Column:
    """Category of a wished start; その他 without a known word."""
    return F.coalesce(_ladder(c, START_CATEGORIES, "その他"), F.lit("その他"))


def workstyle(c: Column) -> Column:
    """正職員, パート or その他, by the first of several wishes."""
    first = F.trim(F.get(F.split(c, ","), F.lit(0)))
    return F.when(first.rlike("正職員|正社員"), "正職員").when(first.rlike("パート|バイト"), "パート").otherwise("その他")


def by_alias(c: Column, aliases: Mapping[str, Sequence[str]], otherwise: str | None = None) -> Column:
    """Standard name of one of its wordings; otherwise where the text is another one, null where it is null or blank."""
    s = blank_to_null(c)
    out = F.lit(otherwise)
    for name, words in reversed(list(aliases.items())):
        out = F.when(s.isin(*words), F.lit(name)).otherwise(out)
    return F.when(s.isNotNull(), out)


def status(c: Column) -> Column:
    return by_alias(c, STATUS_ALIASES)


def gender(c: Column) -> Column:
    return by_alias(c, GENDER_ALIASES, "その他")


def education_level(c: Column) -> Column:
    s = blank_to_null(c)
    return F.when(s.isNotNull(), _ladder(s, EDUCATION_WORDS, "その他"))


def age_five(age: Column) -> Column:
    return bands(age, (30, 40, 50, 60), ("20代以下", "30代", "40代", "50代", "60代以上"))


def age_four(age: Column) -> Column:
    return bands(age, (30, 45, 60), ("若年層", "中年層", "準高齢層", "高齢層"), right=True)


def fill_missing(df: DataFrame, policy: Mapping[str, object] = MISSING) -> DataFrame:
    """Missing values by the policy of their column; columns without one, and policies without a column, are left."""
    def filled(name: str) -> Column:
        value = policy[name]
        stand = F.array().cast(df.schema[name].dataType) if isinstance(value, list) else F.lit(value).cast(df.schema[name].dataType)
        return F.coalesce(F.col(name), stand).alias(name)

    return df.select(*[filled(c) if policy.get(c) is not None else F.col(c) for c in df.columns])


def full_prefecture(c: Column) -> Column:
    """A prefecture's name without its last character gets it back; other texts stay. 北海道 has no short form."""
    short = {p[:-1]: p for p in PREFECTURES if p != "北海道"}
    names = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
    return F.coalesce(names[c], c)


def clean_municipality(c: Column) -> Column:
    """A municipality without street and building: a city (with its ward, if designated), a county with its town, a ward,
    a town; '' for anything else."""
    s = F.trim(F.coalesce(c, F.lit("")))
    city = F.regexp_extract(s, "^(.+?市)", 1)
    ward = F.when(city.isin(*DESIGNATED_CITIES), F.regexp_extract(F.trim(F.substring(s, F.length(city) + 1, F.length(s))), "^(.+?区)", 1)).otherwise("")
    county = F.concat(F.regexp_extract(s, r"^(.+?郡)\s*([^市]+?(?:町|村))(?:\s|$)", 1), F.regexp_extract(s, r"^(.+?郡)\s*([^市]+?(?:町|村))(?:\s|$)", 2))
    rest = [F.nullif(x, F.lit("")) for x in (county, F.regexp_extract(s, "^(.+?区)", 1), F.regexp_extract(s, r"^(.+?(?:町|村))(?:\s|$)", 1))]
    return F.when(city != "", F.concat(city, ward)).otherwise(F.coalesce(*rest, F.lit("")))


def repaired_place(prefecture: Column, municipality: Column) -> Column:
    """struct<prefecture,municipality>: where a whole address stands in place of the prefecture it is cut; a municipality
    without any municipal suffix becomes ''."""
    p, m = F.coalesce(prefecture, F.lit("")), F.coalesce(municipality, F.lit(""))
    found = F.regexp_extract(p, f"^({_PREFECTURE})", 1)
    rest = F.substring(p, F.length(found) + 1, F.length(p))
    town = F.coalesce(extract(rest, "^([^市区町村]+市[^市区町村0-9]+区)"), extract(rest, "^([^市区町村]+郡[^市区町村]+[町村])"), extract(rest, "^(.+?[市区町村])"), F.lit(""))
    kept = F.when((m != "") & ~m.rlike("[市区町村郡]"), "").otherwise(m)
    known = p.isin(*PREFECTURES)
    return F.struct(F.when(known | (found == ""), p).otherwise(found).alias("prefecture"), F.when(known, kept).when(found == "", m).otherwise(town).alias("municipality"))


def national_licence(held: Column, policy: str = "exact") -> Column:
    """Whether a list of qualifications holds a national licence: by whole names (exact, master) or parts of names."""
    return F.coalesce(holds_any(held, NATIONAL_LICENCES[policy], part=policy.endswith("part")), F.lit(False))


def applicant_table(df: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """The processed table of job seekers from their raw texts, every other column kept.

    names: columns of age_gender, residence, desired_area, qualifications, career, desired_start, where they are called
    otherwise; texts that a table lacks count as null. Adds age, gender, age_bucket, age_group, residence_pref,
    residence_muni, desired_areas (50 at most), area_count, held, qualification_count, has_national_licence, school, start.
    """
    def text(name: str) -> Column:
        own = (names or {}).get(name, name)
        return F.col(f"`{own}`") if own in df.columns else F.lit(None).cast("string")

    age, sex = age_gender(text("age_gender"))
    prefecture, municipality = region(text("residence"))
    areas, held = desired_areas(text("desired_area")), qualifications(text("qualifications"))
    return df.select(
        "*", age.alias("age"), sex.alias("gender"), age_decade(age).alias("age_bucket"), age_five(age).alias("age_group"), prefecture.alias("residence_pref"), municipality.alias("residence_muni"),
        areas.alias("desired_areas"), F.size(areas).alias("area_count"), held.alias("held"), F.size(held).alias("qualification_count"), national_licence(held).alias("has_national_licence"),
        career(text("career")).alias("school"), start_category(text("desired_start")).alias("start"),
    )
