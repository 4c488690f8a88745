"""Columns from the free text of job seekers: age, places, qualifications, careers, urgency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shokuba.operators.core import bands

# The 47 prefectures from north to south.
PREFECTURES = (
    "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 "
    "滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県"
).split()
_PREFECTURE = f"(?:{'|'.join(PREFECTURES)})"

_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
_BLANK = r"[\s\x1C-\x1F\x85\p{Z}]"


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def fold_width(c: Column) -> Column:
    """Full-width ASCII and blanks become narrow."""
    return F.translate(c, _WIDE, _NARROW)


def nfkc(c: Column) -> Column:
    """Compatibility composition (NFKC) of any text by the ICU library that Spark brings; texts of ASCII alone go past it."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))).otherwise(c)


def stripped(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, rf"^{_BLANK}++|(?<!{_BLANK}){_BLANK}++$", "")


def tokens(c: Column) -> Column:
    """Parts of a list in text, after NFKC, by commas, slashes, bars and middle dots; repeats stay, null gives none."""
    parts = F.transform(F.split(nfkc(c), r"[、，,|／/・\u00B7\u2027\u2219]+"), stripped)
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none; digits and blanks of any width count."""
    return F.nullif(F.regexp_extract(c, f"(?U){pattern}", group), F.lit(""))


def age_gender(c: Column) -> tuple[Column, Column]:
    """Age and gender from text such as '49歳 女性'."""
    folded = fold_width(c)
    return extract(folded, r"([0-9]+)\s*歳").try_cast("int"), extract(folded, "(男性|女性)")


def region(c: Column) -> tuple[Column, Column]:
    """Prefecture and what follows it, by the fixed names; both null if the text doesn't begin with one."""
    s = F.trim(c)
    return extract(s, f"^({_PREFECTURE})"), blank_to_null(F.regexp_extract(s, f"^{_PREFECTURE}(.*)$", 1))


def place_in_address(c: Column) -> tuple[Column, Column]:
    """Prefecture and municipality of an address: a designated city with its ward, a county with its town, else the
    first name that ends in a municipal suffix."""
    rest = F.regexp_extract(c, f"{_PREFECTURE}(.*)$", 1)
    town = F.coalesce(extract(rest, "^([^市区町村]+市[^市区町村0-9]+区)"), extract(rest, "^([^市区町村]+郡[^市区町村]+[町村])"), extract(rest, "^(.+?[市区町村])"))
    return extract(c, f"({_PREFECTURE})"), town


def normal_address(c: Column) -> Column:
    """Folded widths, no blanks, from the first prefecture name on."""
    s = F.regexp_replace(fold_width(c), r"\s+", "")
    return F.coalesce(extract(s, f"({_PREFECTURE}.*)$"), s)


def desired_areas(c: Column, most: int = 50) -> Column:
    """array<struct<prefecture,municipality,full>> from a comma list; parts without a prefecture are dropped."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x.rlike(f"^{_PREFECTURE}"))
    out = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, f"^({_PREFECTURE})", 1).alias("prefecture"), F.nullif(F.regexp_extract(x, f"^{_PREFECTURE}(.*)$", 1), F.lit("")).alias("municipality"), x.alias("full")))
    return F.coalesce(F.slice(out, 1, most), F.expr("cast(array() as array<struct<prefecture:string,municipality:string,full:string>>)"))


def items(c: Column, separators: str = r"[,、，・/／;；\s]+") -> Column:
    """Distinct parts of a list in text, of folded width, at least one character long."""
    return F.array_distinct(F.filter(F.split(fold_width(c), separators), lambda x: x != ""))


def qualifications(c: Column, known: Sequence[str] = ()) -> Column:
    """Names in a comma list without 'なし', planned ones and single characters. known: names by which run-together
    texts are cut, longest first."""
    if known:
        names = "|".join(sorted(known, key=lambda k: (-len(k), k)))
        parts = F.flatten(F.transform(F.split(c, ","), lambda x: F.when(x.rlike(f"^(?:{names}){{2,}}$"), F.regexp_extract_all(x, F.lit(f"({names})"), 1)).otherwise(F.array(F.trim(x)))))
    else:
        parts = F.transform(F.split(c, ","), lambda x: F.trim(x))
    return F.coalesce(F.array_distinct(F.filter(parts, lambda x: (F.length(x) >= 2) & (x != "なし") & ~F.contains(x, F.lit("取得予定")))), F.array().cast("array<string>"))


def holds_any(held: Column, names: Sequence[str], part: bool = False) -> Column:
    """Whether a list holds any of the names, or (part) a text that contains one; the policy is the list given."""
    if part:
        return F.exists(held, lambda x: x.rlike("|".join(names)))
    return F.arrays_overlap(held, F.array(*[F.lit(n) for n in names]))


def graduation_year(c: Column, low: int = 1950, high: int = 2030) -> Column:
    """Last year of the form 2016年 in a career text, if between low and high."""
    year = F.try_element_at(F.regexp_extract_all(c, F.lit(r"((?:19|20)[0-9]{2})年"), 1), F.lit(-1)).try_cast("int")
    return F.when(year.between(low, high), year)


def desired_jobs(c: Column) -> Column:
    """array<struct<name,experience,years>> from 'name (experience),...'."""
    return F.transform(F.split(c, r",(?![^()]*\))"), lambda x: F.struct(
        F.trim(F.regexp_extract(x, r"^([^(（]*)", 1)).alias("name"),
        F.nullif(F.regexp_extract(x, r"[(（]([^)）]*)[)）]", 1), F.lit("")).alias("experience"),
        F.regexp_extract(x, r"([0-9]+)年", 1).try_cast("int").alias("years"),
    ))


def age_decade(age: str | Column) -> Column:
    """Ten-year group; all under 30 are 20s, all from 70 on 70+."""
    return bands(age, (30, 40, 50, 60, 70), ("20s", "30s", "40s", "50s", "60s", "70+"))


def start_urgency(points: Column, wished: Column, reference: Column) -> Column:
    """Points of a wished start, less one for each 60 days since it was stated, 1 at least; two decimals."""
    days = F.datediff(reference, wished)
    return F.when(wished.isNull(), points.cast("double")).otherwise(F.bround(F.greatest(F.lit(1.0), points - days / F.lit(60.0)), 2))


def stale(wished: Column, reference: Column, days: int = 90) -> Column:
    return F.datediff(reference, wished) > days


def urgency_score(areas: Column, quals: Column, license: Column, status: Column, urgent: Sequence[str]) -> Column:
    """0-3 for areas, 0-2 for qualifications, 2 for a licence, 2 for an urgent status else 1."""
    return (
        F.when(areas >= 10, 3).when(areas >= 5, 2).when(areas >= 2, 1).otherwise(0)
        + F.when(quals >= 3, 2).when(quals >= 1, 1).otherwise(0)
        + F.when(license, 2).otherwise(0)
        + F.when(status.isin(*urgent), 2).otherwise(1)
    )


def urgency_rank(score: Column) -> Column:
    return F.when(score <= 2, "D").when(score <= 4, "C").when(score <= 6, "B").otherwise("A")


def mobility_score(outside: Column, areas: Column) -> Column:
    """Share of desired areas outside the home region; 0 without areas."""
    return F.when(areas > 0, outside.cast("double") / areas).otherwise(0.0)


def mobility_rank(score: Column) -> Column:
    return F.when(score >= 0.8, "A").when(score >= 0.5, "B").when(score > 0, "C").otherwise("D")


def difficulty(areas: Column, quals: Column, mobility: Column, share: Column) -> Column:
    """How hard a group is to hire, 0-100: fewer people, more qualifications and less mobility make it harder."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 - areas * 2 + quals * 8 - mobility * 20 + (1 - share) * 20))


def sample_class(n: Column) -> Column:
    """How far a count carries: 100, 30 and 10 rows."""
    return F.when(n >= 100, "SUFFICIENT").when(n >= 30, "MODERATE").when(n >= 10, "SMALL").otherwise("VERY_SMALL")
