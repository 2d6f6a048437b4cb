"""Join keys are columns before a join, and parts that several results need are written once."""

import re

from conftest import row
from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.functions.keys import maybe_mojibake, name_key
from tagloom.operators import apply as A, suggest as S
from tagloom.operators.lookup import WHOLE
from tagloom.operators.reports import report_units
from tagloom.plans.fixture import fixture_index


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def joins(df) -> list[str]:
    return re.findall(r"Join (?:LeftOuter|Inner|LeftAnti).*", plan_of(df))


def test_path_keys_are_made_before_the_join(spark, tracks):
    df = tracks(row("A\\1.flac", genre="x"), row("b/2.flac"))
    plan = spark.createDataFrame([("a/1.flac", "genre", ["Classic"])], "path_key string, field string, new_values array<string>")
    edits = spark.createDataFrame([("a/1.flac", "genre", "Classic")], "path_key string, field string, value string")
    for made in (A.overlay(df, plan), A.display_overlay(df, edits)):
        assert joins(made) and not any("lower(" in j for j in joins(made))
    assert [r.genre for r in A.overlay(df, plan).orderBy("relative_path").collect()] == [["Classic"], []]
    assert [(r.edited, r.genre) for r in A.display_overlay(df, edits).orderBy("relative_path").collect()] == [(True, "Classic"), (False, None)]


def test_name_keys_are_made_before_the_join(spark):
    index = fixture_index(spark)
    df = spark.createDataFrame([("BRAHMS", ["Brahms"]), ("", []), (None, None)], "t string, v array<string>")
    found = index.resolve(df, name_key(F.col("t")), "n", "composer")
    known = index.with_facts(df, {"v": (F.col("v"), WHOLE)}, "composer")
    assert not any("regexp_replace" in j for j in joins(found)) and not any("size(" in j for j in joins(known))
    assert found.columns == ["t", "v", "n_key", "n_composer"] and known.columns == ["t", "v", "v_composer"]
    assert [r.n_composer for r in found.orderBy(F.desc_nulls_last("t")).collect()] == ["Johannes Brahms", None, None]
    assert {r.t: r.v_composer for r in known.collect()} == {"BRAHMS": "Johannes Brahms", "": None, None: None}


def test_template_parts_are_written_once(spark, tracks):
    df = tracks(*[row(f"Brahms/Trio {i}/{n}.flac", composer="Brahms", album=f"Trio {i}") for i in range(2) for n in range(2)])
    made = S.works_template(report_units(df, fixture_index(spark)), fixture_index(spark))
    assert not joins(made["works"]) and not joins(made["members"])
    assert sorted(r.first_alias for r in made["works"].collect()) == ["Trio 0", "Trio 1"]


def test_wide_characters_are_tested_before_patterns(spark):
    values = ["abc", "é", "交響曲", "ｶﾗ", "", None, "aĀé", "\U0001d11e"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    v = F.col("v")
    got = df.select("v", X.has_japanese(v).alias("j"), X.is_japanese(v).alias("h"), maybe_mojibake(v).alias("m")).collect()
    assert [(r.j, r.h, r.m) for r in got] == [
        (False, False, False), (False, False, True), (True, True, False), (False, True, False), (False, False, False),
        (None, None, None), (False, False, False), (False, False, False),
    ]
    assert "octet_length" in plan_of(df.filter(X.has_japanese(v)))
