"""Readers and writers on small files."""

from pyspark.sql import functions as F

from shokuba.functions import postings as J
from shokuba.operators import core
from shokuba.sources import readers, writers


def test_csv_round_trip_with_mark(spark, tmp_path):
    df = spark.createDataFrame([("あ", 1), ("b", 2)], "name string, n int")
    writers.write_tables({"t": df}, str(tmp_path), "csv")
    first = next(p for p in (tmp_path / "t").iterdir() if p.suffix == ".csv")
    assert first.read_bytes().startswith("﻿".encode())
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "t")).collect())) == [("b", "2"), ("あ", "1")]


def test_postings_with_parsed_columns(spark, tmp_path):
    (tmp_path / "p.csv").write_text('休日,給与\n"年間休日120日\n土日祝休み",想定 350万円\n,\n', encoding="utf-8-sig")
    got = readers.read_postings(spark, str(tmp_path / "p.csv"), {"休日": "days", "給与": "pay"}, {"holidays": J.annual_holidays(F.col("days")), "income": J.annual_income(F.col("pay"))}).collect()
    assert [(r.days, r.holidays, r.income) for r in got] == [("年間休日120日\n土日祝休み", 120, 3500000)]


def test_synonyms_keep_their_columns(spark):
    base = spark.createDataFrame([("q", "介護福祉士", "介福|介護福祉", "A", True)], "domain string, canonical string, synonyms string, family string, national boolean")
    over = spark.createDataFrame([("q", "介護", "介福")], "domain string, canonical string, synonyms string")
    got = {r.token: (r.canonical, r.family, r.national) for r in readers.synonym_table(base, over).collect()}
    assert got == {"介護福祉士": ("介護福祉士", "A", True), "介護福祉": ("介護福祉士", "A", True), "介福": ("介護", None, None), "介護": ("介護", None, None)}


def test_indicators_take_one_row_a_key(spark, tmp_path):
    (tmp_path / "a.csv").write_text("prefecture,v\nx,2\nx,1\n")
    base = spark.createDataFrame([("x",), ("y",)], "prefecture string")
    assert sorted(map(tuple, readers.read_indicators(spark, [str(tmp_path / "a.csv")], base).collect())) == [("x", "1"), ("y", None)]


def test_migration_with_checks(spark):
    people = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id long, name string")
    wishes = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "id long, place string")
    got = {(r.table, r.check): r.rows for r in writers.migrate({"m_people": people, "m_wishes": wishes}, {"m_people": ["id"]}, [("m_wishes", "id", "m_people", "id")]).collect()}
    assert got == {("m_people", "duplicate keys"): 1, ("m_wishes", "orphans of m_people"): 1}
    assert spark.table("m_people").filter("id = 1").first().name == "a" and spark.table("m_people").count() == 3
    tokens = spark.createDataFrame([("q", "new")] * 3 + [("q", "rare")], "domain string, token string")
    spark.sql("drop table if exists m_overlay")
    writers.promote(writers.unmatched_tokens(tokens, spark.createDataFrame([], "domain string, token string")), "m_overlay")
    assert [tuple(r) for r in spark.table("m_overlay").collect()] == [("q", "new", None)]
    for t in ("m_people", "m_wishes", "m_overlay"):
        spark.sql(f"drop table {t}")


def test_union_with_a_column_of_no_frame(spark):
    a = spark.createDataFrame([(1,)], "x int")
    assert core.union_tables(a, columns=["y", "x"]).first() == (None, 1)
