"""Columns from the texts of job adverts, generated from dictionaries given as data."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shokuba.functions.dictionaries import AGE_DECADES, BENEFITS, CONTENT, EMPLOYMENT_ALIASES, GENDER_SIGNALS, HOLIDAYS, LIFE_STAGES, SHIFTS, TAG_PATTERNS, TAG_SYNONYMS, TAGS, TONES
from shokuba.functions.people import extract, fold_width
from shokuba.operators.core import bands


def base_salary(c: Column) -> Column:
    """First amount followed by 円, separators dropped; amounts in 万円 are multiplied out."""
    s = F.regexp_replace(fold_width(c), ",", "")
    return F.coalesce((extract(s, r"([0-9]+(?:\.[0-9]+)?)万円").try_cast("double") * 10000).cast("long"), extract(s, "([0-9]{3,})円").try_cast("long"))


def allowances(c: Column) -> Column:
    """array<struct<name,amount>> of stated allowances."""
    s = F.regexp_replace(fold_width(c), ",", "")
    return F.transform(F.regexp_extract_all(s, F.lit(r"([^\s、。:：]{1,12}手当[^0-9]{0,6}[0-9]+)円"), 1), lambda x: F.struct(F.regexp_extract(x, "^(.*?手当)", 1).alias("name"), F.regexp_extract(x, "([0-9]+)$", 1).try_cast("long").alias("amount")))


def bonus_months(c: Column) -> Column:
    return extract(fold_width(c), r"([0-9]+(?:\.[0-9]+)?)\s*[ヶかカケ]?月").try_cast("double")


def annual_holidays(c: Column) -> Column:
    return extract(fold_width(c), r"年間休日\D{0,4}([0-9]{2,3})").try_cast("int")


def required_years(c: Column) -> Column:
    return F.coalesce(extract(fold_width(c), "経験([0-9]+)年"), extract(fold_width(c), "([0-9]+)年以上")).try_cast("int")


def age_limit(c: Column) -> Column:
    return extract(fold_width(c), "([0-9]{2})歳(?:以下|まで|未満)").try_cast("int")


def working_hours(c: Column) -> Column:
    """struct<starts,ends,n,night>: hours of all '9:00-18:00' spans; an end before its start is the next day."""
    s = F.translate(fold_width(c), "〜～−―", "~~--")
    spans = F.regexp_extract_all(s, F.lit(r"((?:翌)?[0-9]{1,2}[:時][0-9]{0,2}\s*[~-]\s*(?:翌)?[0-9]{1,2})[:時]"), 1)
    pairs = F.transform(spans, lambda x: F.struct(F.regexp_extract(x, "([0-9]{1,2})", 1).try_cast("int").alias("s"), F.regexp_extract(x, "([0-9]{1,2})$", 1).try_cast("int").alias("e")))
    starts, ends = F.transform(pairs, lambda p: p["s"]), F.transform(pairs, lambda p: F.when(p["e"] <= p["s"], p["e"] + 24).otherwise(p["e"]))
    return F.struct(starts.alias("starts"), ends.alias("ends"), F.size(pairs).alias("n"), (F.exists(ends, lambda e: e > 24) & ~F.contains(c, F.lit("夜勤なし"))).alias("night"))


#: Whether a text holds a pattern, never null; rules.Scan.held answers from one pass over a text for all patterns.
Held = Callable[[Column, str], Column]


def holds(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"(?U){pattern}"), F.lit(False))


def flags(c: Column, dictionary: Mapping[str, str], held: Held = holds) -> dict[str, Column]:
    """One boolean per entry (name: pattern); null text has none."""
    return {name: held(c, pattern) for name, pattern in dictionary.items()}


def tags(c: Column, dictionary: Mapping[str, str], held: Held = holds) -> Column:
    """Names of all entries whose pattern is found, in the dictionary's order."""
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in flags(c, dictionary, held).items()]))


def flag_score(c: Column, dictionary: Mapping[str, str], held: Held = holds) -> Column:
    return reduce(lambda a, b: a + b, [x.cast("int") for x in flags(c, dictionary, held).values()])


def first_of(c: Column, ladder: Sequence[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Label of the first pattern that is found; the order of the ladder is the meaning."""
    out = F.lit(otherwise)
    for label, pattern in reversed(ladder):
        out = F.when(c.rlike(f"(?U){pattern}"), F.lit(label)).otherwise(out)
    return out


def best_of(scores: Mapping[str, Column]) -> Column:
    """Name of the highest score; the first one wins a tie."""
    ordered = F.array(*[F.struct(s.cast("double").alias("score"), F.lit(-i).alias("place"), F.lit(n).alias("name")) for i, (n, s) in enumerate(scores.items())])
    return F.array_max(ordered)["name"]


def signal_score(c: Column, terms: Mapping[str, int], negations: str = "不非未無") -> Column:
    """Weighted occurrences of terms, those right after a negation left out."""
    lead = f"(?<![{negations}])" if negations else ""
    return reduce(lambda a, b: a + b, [F.regexp_count(c, F.lit(f"{lead}\\Q{t}\\E")) * w for t, w in terms.items()], F.lit(0))


def decoration_count(c: Column) -> Column:
    """Symbols and emoji by code-point ranges."""
    return F.regexp_count(c, F.lit(r"[\x{2190}-\x{21FF}\x{2500}-\x{27BF}\x{1F300}-\x{1FAFF}]"))


def richness(lengths: Sequence[Column], edges: Sequence[int] = (50, 200)) -> Column:
    """One point for each field at or over each edge of length."""
    return reduce(lambda a, b: a + b, [F.coalesce((n >= e).cast("int"), F.lit(0)) for n in lengths for e in edges])


def original_share(c: Column, legal: str, long: int = 60) -> Column:
    """Share of characters outside legal blocks. A line that matches `legal` opens a block, a line of `long` or more
    characters closes it, and short lines belong to the block they follow: a fold over the lines."""
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("own"), F.lit(0).alias("all"))

    def step(acc: Column, line: Column) -> Column:
        inside = F.when(line.rlike(legal), True).when(F.length(line) >= long, False).otherwise(acc["inside"])
        return F.struct(inside.alias("inside"), (acc["own"] + F.when(inside, 0).otherwise(F.length(line))).alias("own"), (acc["all"] + F.length(line)).alias("all"))

    return F.aggregate(F.split(c, "\n"), start, step, lambda acc: F.try_divide(acc["own"].cast("double"), acc["all"]))


def char_entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    chars = F.array_sort(F.split(c, ""))
    n = F.size(chars).cast("double")
    kinds = F.array_distinct(chars)
    p = F.transform(kinds, lambda k: F.size(F.filter(chars, lambda x: x == k)) / n)
    return F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log2(x))


def tier_label(scores: Mapping[str, Mapping[str, Column]], patterns: Sequence[tuple[str, Mapping[str, str]]], least: float = 0.8) -> Column:
    """Label of the best pattern over the axes' winners, at `least` of its conditions; else the winners joined.

    scores: axis -> {value: score}; patterns: (label, {axis: value}), of which the first best wins.
    """
    winner = {axis: best_of(s) for axis, s in scores.items()}
    fit = {label: reduce(lambda a, b: a + b, [(winner[a] == v).cast("double") for a, v in want.items()]) / len(want) for label, want in patterns}
    best = F.greatest(*fit.values()) if len(fit) > 1 else next(iter(fit.values()))
    return F.when(best >= least, best_of(fit)).otherwise(F.concat_ws("×", *winner.values()))


#: Of each tag the patterns that mean it: the word itself, other wordings, a pattern; the holiday rule adds 4週8休以上.
TAG_WORDS = {t: [*map(re.escape, (t, *TAG_SYNONYMS.get(t, ()))), *([TAG_PATTERNS[t]] if t in TAG_PATTERNS else [])] for t in TAGS} | {"4週8休以上": ["4週8休", "4週[89]休"]}


def advert_tags(c: Column, held: Held = holds) -> Column:
    """Tags of an advert's text."""
    return tags(c, {t: "|".join(words) for t, words in TAG_WORDS.items()}, held)


def benefit_flags(c: Column, held: Held = holds) -> dict[str, Column]:
    """The 25 benefit flags of a text."""
    return flags(c, BENEFITS, held)


def advert_patterns() -> dict[str, list[str]]:
    """All that advert_tags, benefit_flags, decades and gender_and_stage ask of a text, for one pass (rules.Scan)."""
    alone = [*BENEFITS.values(), *(p for ps in (*AGE_DECADES.values(), *GENDER_SIGNALS.values(), *LIFE_STAGES.values()) for p in ps)]
    return {"|".join(words): words for words in TAG_WORDS.values()} | {p: [p] for p in alone}


def content_patterns() -> dict[str, list[str]]:
    """All that `content` asks of a text."""
    return {"|".join(ps): list(ps) for ps in CONTENT.values()} | {p: [p] for ps in TONES.values() for p in ps}


def benefit_score(c: Column) -> Column:
    return flag_score(c, BENEFITS)


def holiday_pattern(c: Column) -> Column:
    """Pattern of days off; Chinese numerals for two and three days count as digits, null and blank text give null."""
    s = F.replace(F.replace(fold_width(c), F.lit("二日"), F.lit("2日")), F.lit("三日"), F.lit("3日"))
    return F.when(F.length(F.trim(c)) > 0, first_of(s, HOLIDAYS, "その他"))


def holiday_band(days: Column) -> Column:
    return bands(days, (100, 105, 110, 115, 120), ("<100", "100-104", "105-109", "110-114", "115-119", "120+"))


def shift_type(c: Column) -> Column:
    """Named shift type, else by the time spans: two or more, or flexible hours, are shifts, one is fixed."""
    s = fold_width(c)
    n = working_hours(c)["n"]
    night = s.rlike("夜勤") & ~s.rlike(r"(?U)夜勤\s*なし")
    named = first_of(F.when(night, F.regexp_replace(s, r"(?U)日勤\s*の\s*み", "")).otherwise(s), SHIFTS)
    flexible = s.rlike(r"変形労働時間|[0-9]{1,2}:[0-9]{2}.*の間で[0-9]時間") | (F.regexp_count(s, F.lit(r"[（(]?\s*[①-⑩0-9]\s*[）)]")) >= 2)
    return F.coalesce(named, F.when(flexible | (n >= 2), "シフト制").when(n == 1, "固定時間").otherwise("不明"))


def hour_bands(start: Column, end: Column) -> tuple[Column, Column]:
    """Bands of the first starting and the last ending hour; hours before 5 and 15 are unknown."""
    s = F.when(start >= 5, bands(start, (7, 9, 11), ("早朝(5-7時)", "朝(7-9時)", "午前(9-11時)", "午後(11時以降)")))
    e = F.when(end >= 15, bands(end, (17, 19, 21), ("午後早(15-17時)", "夕方(17-19時)", "夜(19-21時)", "深夜(21時以降)")))
    return F.coalesce(s, F.lit("不明")), F.coalesce(e, F.lit("不明"))


def age_signals(c: Column, patterns: Mapping[str, Sequence[str]], held: Held = holds) -> Column:
    """struct<scores,primary,all> of decades by the number of their patterns in a text; the youngest wins a tie."""
    scores = {d: reduce(lambda a, b: a + b, [held(c, p).cast("int") for p in ps]) for d, ps in patterns.items()}
    every = F.array_compact(F.array(*[F.when(s >= 1, F.lit(d)) for d, s in scores.items()]))
    return F.struct(F.struct(*[s.alias(d) for d, s in scores.items()]).alias("scores"), F.when(F.size(every) > 0, best_of(scores)).alias("primary"), every.alias("all"))


def experience_quadrant(beginner: Column, unlicensed: Column) -> Column:
    """Who an advert is for: by whether beginners and people without a licence are welcome."""
    return F.when(beginner & unlicensed, "未経験×無資格").when(beginner, "未経験×有資格").when(unlicensed, "経験者×無資格").otherwise("経験者×有資格")


def employment_type(c: Column) -> Column:
    """Standard employment type of a text without its brackets; null if it is none."""
    s = F.trim(F.translate(c, "【】", ""))
    out = F.lit(None).cast("string")
    for name, words in EMPLOYMENT_ALIASES.items():
        out = F.when(s.isin(*words), F.lit(name)).otherwise(out)
    return out


def employment_in_salary(c: Column) -> Column:
    """Employment type named in a text on pay: in 【】, at its start, or anywhere, in this order."""
    words = "正職員|正社員|パート・バイト|パート|バイト|契約職員|契約社員|業務委託|派遣|アルバイト"
    bracket = extract(c, "【(.+?)】")
    return F.when(bracket.isNotNull(), employment_type(bracket)).otherwise(F.coalesce(employment_type(extract(F.trim(c), f"^({words})")), employment_type(extract(c, f"({words})"))))


def annual_income(c: Column) -> Column:
    """Lower end of a stated annual income in yen: amounts in 万円, else a bare number, read as 万円 from 100 to 999."""
    s = F.trim(fold_width(c))
    bare = F.replace(extract(s, "^([0-9,]+)$"), F.lit(","), F.lit("")).try_cast("long")
    man = F.replace(extract(s, r"([0-9,]+)\s*万\s*円?"), F.lit(","), F.lit("")).try_cast("long")
    return F.coalesce(man * 10000, F.when(bare.between(100, 999), bare * 10000).when(bare >= 1_000_000, bare))


def beginners_welcome(requirements: Column, welcome: Column) -> Column:
    s = F.concat_ws(" ", requirements, welcome)
    return s.rlike("未経験可|未経験OK|未経験ok|未経験歓迎|未経験者歓迎|未経験の方|経験不問|経験問わず")


def shorten(c: Column, most: int = 60) -> Column:
    """A text in one line, cut to `most` characters and an ellipsis."""
    s = F.trim(F.translate(c, "\n\r", "  "))
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("…"))).otherwise(s)


def hours_summary(c: Column) -> Column:
    """The first time span as 9:00-18:00, else the words on nights and overtime, else the shortened text."""
    s = fold_width(c)
    span = r"([0-9]{1,2})[：:]([0-9]{2})\s*[~～〜ー-]\s*([0-9]{1,2})[：:]([0-9]{2})"
    parts = [F.regexp_extract(s, span, i) for i in (1, 2, 3, 4)]
    times = F.concat(parts[0], F.lit(":"), parts[1], F.lit("-"), parts[2], F.lit(":"), parts[3])
    words = F.array_join(F.array_compact(F.array(*[F.when(F.contains(s, F.lit(w)), F.lit(w)) for w in ("日勤のみ", "夜勤あり", "夜勤なし", "残業なし", "残業ほぼなし")])), " ")
    return F.when(s.rlike(span), times).when(words != "", words).otherwise(shorten(s, 40))


def break_minutes(c: Column) -> Column:
    return extract(fold_width(c), r"休憩\s*([0-9]{1,3})\s*分").try_cast("int")


def overtime(c: Column) -> Column:
    """Class of overtime: none, hardly any (five hours a month at most), within 20 hours, some, unknown."""
    s = fold_width(c)
    lead = r"(?:残業|時間外(?:労働)?)\s*"
    hours = extract(s, lead + r"月\s*(?:平均\s*)?([0-9]{1,2})\s*時間").try_cast("int")
    out = F.when(s.rlike(lead + "(なし|ゼロ|0)"), "残業なし").when(s.rlike(lead + r"(ほぼ\s*なし|少な)"), "残業ほぼなし")
    out = out.when(hours <= 5, "残業ほぼなし").when(hours <= 20, "月20h以内").when(hours.isNotNull(), "残業あり")
    return out.when(s.rlike("時間外|超過勤務"), "残業あり").otherwise("不明")


def weekday_off(c: Column) -> Column:
    """Which weekday is off for good."""
    return first_of(c, (("土日", "土日(祝)?(.{0,2})(休|お休み)"), ("日曜", "日曜(日)?(.{0,2})(休|固定)"), ("平日", "平日(.{0,2})(休|お休み)"), ("水曜", "水曜.{0,5}(休|午後休)"), ("木曜", "木曜.{0,5}(休|午後休)")), "不明")


def special_leave(c: Column) -> Column:
    """array of the special leaves a text names."""
    return tags(c, {"年末年始": "年末年始", "夏季": "お盆|夏季休暇|夏期休暇", "GW": "GW|ゴールデンウィーク", "慶弔": "慶弔|冠婚葬祭", "リフレッシュ": "リフレッシュ休暇|アニバーサリー"})


def holiday_score(days: Column) -> Column:
    """0 without days off stated, 1 below 96, 2 from 96, 3 from 105, 4 from 120."""
    return F.when(days <= 0, 0).when(days >= 120, 4).when(days >= 105, 3).when(days >= 96, 2).otherwise(1)


def content(c: Column, held: Held = holds) -> Column:
    """struct<categories,primary,tone,detail> of a job description; one under 10 characters has none, unknown and low.

    The primary task is the first category found; a tone needs two of its marks, urgent before casual before formal.
    """
    found = tags(c, {name: "|".join(patterns) for name, patterns in CONTENT.items()}, held)
    marks = {tone: flag_score(c, {p: p for p in patterns}, held) for tone, patterns in TONES.items()}
    tone = F.when(marks["urgent"] >= 2, "urgent").when(marks["casual"] >= 2, "casual").when(marks["formal"] >= 2, "formal").otherwise("neutral")
    n = F.length(c)
    detail = F.when(n >= 500, "high").when(n >= 200, "medium").otherwise("low")
    enough = F.coalesce(F.length(F.trim(c)) >= 10, F.lit(False))
    return F.struct(
        F.when(enough, found).otherwise(F.array().cast("array<string>")).alias("categories"), F.when(enough, F.get(found, F.lit(0))).alias("primary"),
        F.when(enough, tone).otherwise("unknown").alias("tone"), F.when(enough, detail).otherwise("low").alias("detail"),
    )


def decades(c: Column, held: Held = holds) -> Column:
    """age_signals by the fixed patterns."""
    return age_signals(c, AGE_DECADES, held)


def gender_and_stage(c: Column, held: Held = holds) -> Column:
    """struct<female,male,signal,stages,primary>: scores by patterns, which side leans, and the life stages named, the one
    with most patterns first and in the order of life on ties. A stage around birth or return leans female by itself."""
    f, m = (flag_score(c, {p: p for p in GENDER_SIGNALS[k]}, held) for k in ("female", "male"))
    scored = F.array(*[F.struct(flag_score(c, {p: p for p in patterns}, held).alias("n"), F.lit(-i).alias("place"), F.lit(name).alias("name")) for i, (name, patterns) in enumerate(LIFE_STAGES.items())])
    stages = F.transform(F.sort_array(F.filter(scored, lambda x: x["n"] > 0), False), lambda x: x["name"])
    first = F.get(stages, F.lit(0))
    implied = (f == 0) & (m == 0) & F.coalesce(first.isin("結婚・出産期", "育児期", "復職期"), F.lit(False))
    signal = F.when((f > m) | implied, "female_leaning").when(m > f, "male_leaning").when(f > 0, "neutral")
    return F.struct((f + implied.cast("int")).alias("female"), m.alias("male"), signal.alias("signal"), stages.alias("stages"), first.alias("primary"))


def text_scores(original: Column, terms: Mapping[str, Mapping[str, int]], n: Column, top: int = 3) -> Column:
    """struct<scores,top>: weighted signals of each kind for 1000 characters of a text, and the names of the highest."""
    scores = {k: F.coalesce(F.try_divide(signal_score(original, t) * F.lit(1000.0), n), F.lit(0.0)) for k, t in terms.items()}
    best = F.sort_array(F.filter(F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("place"), F.lit(k).alias("k")) for i, (k, s) in enumerate(scores.items())]), lambda x: x["s"] > 0), False)
    return F.struct(F.struct(*[s.alias(k) for k, s in scores.items()]).alias("scores"), F.transform(F.slice(best, 1, top), lambda x: x["k"]).alias("top"))
