"""Who an advert is for: beginners or the experienced, with or without a licence; and how much it says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of licences.
LICENCES = [
    "正看護師", "准看護師", "看護師免許", "看護師資格", "看護師", "保健師", "助産師", "認定看護師", "専門看護師", "介護福祉士", "社会福祉士", "精神保健福祉士", "ケアマネジャー", "ケアマネ", "介護支援専門員",
    "初任者研修", "実務者研修", "理学療法士", "作業療法士", "言語聴覚士", "管理栄養士", "栄養士", "調理師", "歯科衛生士", "歯科技工士", "薬剤師", "登録販売者", "柔道整復師", "あん摩マッサージ指圧師", "鍼灸師",
    "臨床検査技師", "診療放射線技師", "臨床工学技士", "児童指導員", "保育士", "社会福祉主事", "相談支援専門員", "児童指導員任用資格", "児童発達支援管理責任者", "サービス管理責任者", "サービス提供責任者",
]

# Patterns of requirements that welcome beginners.
BEGINNERS = [
    r"未経験.{0,3}(歓迎|可|OK|者|の方|から|でも)", r"経験.{0,3}(不問|不要|なし.{0,3}(可|OK)|なくても|問いません|問わず)", r"(新卒|第二新卒).{0,5}(歓迎|可|OK|募集|採用)", r"初心者.{0,3}(OK|可|歓迎|から|でも)",
    r"(一から|イチから|ゼロから|ゼロ.{0,3}スタート)", r"(丁寧に|しっかり|イチから).{0,5}(教え|指導|研修|サポート)", r"(はじめての方|初めての方).{0,3}(歓迎|OK|でも|も安心)", r"ブランク.{0,3}(OK|可|歓迎|ある方|の方)",
]

# Weaker signs anywhere in an advert, heeded where no experience is asked for.
BEGINNERS_WEAK = [r"(丁寧に|しっかり|イチから).{0,5}(教え|指導|研修|サポート)", r"研修.{0,3}(充実|制度|あり|体制|プログラム)", r"(安心して|安心の).{0,3}(スタート|始められ|働け)"]
EXPERIENCE_ASKED = r"経験.{0,3}(年|以上|必須|必要|者)"

# Patterns of requirements that ask for the experienced.
EXPERIENCED = [r"(実務)?経験.{0,3}(\d+年|年以上|必須|者|ある方)", r"即戦力", r"経験者.{0,3}(歓迎|優遇|募集|のみ)"]

# Patterns that do without a licence, and that need one.
NO_LICENCE = [r"無資格.{0,3}(可|OK|歓迎|の方|でも)", r"資格.{0,3}(不問|なし.{0,3}可|不要|なくても|問いません|問わず)", r"資格.{0,3}(取得支援|取得.{0,3}(サポート|補助|制度))"]
LICENCE_NEEDED = [r"(要|必須).{0,5}(資格|免許)", r"(資格|免許).{0,3}(必須|要|お持ちの方|保有者|をお持ち)", r"以下.{0,5}(資格|免許)", r"いずれか.{0,5}(資格|免許)"]
LICENCE_PLACES = r"訪問看護|保育(園|所)|幼稚園|認定こども園|薬局|ドラッグストア|歯科|病院|クリニック|診療所|医院"

# Signs of training, and of simple work.
TRAINING, SIMPLE = r"研修.{0,5}(充実|あり|制度)", r"(簡単|シンプル|単純|難しくない|誰でも)"

# Points for each field of at least so many characters.
RICHNESS = [
    ("job_description", 200, 2), ("benefits", 200, 1), ("education_training", 100, 1), ("working_hours", 30, 1), ("holidays", 30, 1), ("welcome_requirements", 10, 1), ("facility_scale", 5, 1),
    ("staff_composition", 10, 1), ("established_date", 4, 1),
]


def _any(c: Column, patterns: list[str] | str) -> Column:
    joined = patterns if isinstance(patterns, str) else "|".join(f"(?:{p})" for p in patterns)
    return F.coalesce(c.rlike(f"(?U){joined}"), F.lit(False))


def experience_segment(requirements: Column, welcome: Column, work: Column, training: Column, headline: Column, tags: Column, place: Column) -> Column:
    """Segment by experience and licence, `条件不明` where nothing speaks; null columns count as empty.

    Requirements and welcome decide; the other texts and the kind of place are asked only where they leave it open.
    """
    requirements, welcome, work, training, headline, tags, place = (F.coalesce(c.cast("string"), F.lit("")) for c in (requirements, welcome, work, training, headline, tags, place))
    said = F.concat_ws(" ", requirements, welcome)
    everything = F.concat_ws(" ", said, work, training, headline)
    named = _any(requirements, LICENCES)
    experienced = _any(said, EXPERIENCED)
    needed = _any(said, LICENCE_NEEDED) | _any(said, f"({'|'.join(LICENCES)}).{{0,5}}(必須|必要|要|お持ちの方|以上|保有)")
    free = _any(said, NO_LICENCE) | ((F.contains(tags, F.lit("無資格可")) | F.contains(tags, F.lit("資格不問"))) & ~named)
    beginner = _any(said, BEGINNERS) | F.contains(tags, F.lit("未経験可")) | (~_any(said, EXPERIENCE_ASKED) & _any(everything, BEGINNERS_WEAK))
    beginner = beginner | (~experienced & named & (F.length(F.trim(requirements)) <= 30) & ~_any(requirements, EXPERIENCE_ASKED))
    licence = needed | (~free & (named | _any(place, LICENCE_PLACES)))
    # one struct, so that no branch below reads the texts again
    seen = F.array(F.struct(beginner.alias("b"), licence.alias("l"), (free & ~licence).alias("f"), experienced.alias("e")))
    open_ended = F.when((F.length(training) > 100) | _any(everything, TRAINING), "未経験歓迎・資格必要").when(_any(everything, SIMPLE), "未経験・無資格OK").otherwise("条件不明")
    return F.transform(
        seen,
        lambda s: F.when(s["b"] & s["f"], "未経験・無資格OK").when(s["b"], "未経験歓迎・資格必要").when(s["f"], "経験者・無資格可").when(s["l"] | s["e"], "経験者・資格必須").otherwise(open_ended),
    )[0]


def content_richness(fields: dict[str, Column]) -> Column:
    """Points for the length of each field, ten at most; null fields have none."""
    points = F.lit(0)
    for name, least, n in RICHNESS:
        if name in fields:
            points = points + F.when(F.length(fields[name].cast("string")) >= least, n).otherwise(0)
    return F.least(points, F.lit(10))
