"""What makes the passes of an audit cheap: compiled aggregates, narrow guards, dealt input."""

import re

from conftest import row
from pyspark.sql import functions as F

from tagloom.functions import keys as K, text as X
from tagloom.operators.findings import finish
from tagloom.operators.lookup import WHOLE, Index
from tagloom.operators.rules import REGISTRY
from tagloom.plans.audit import AuditContext, inspect
from tagloom.plans.fixture import MISREAD, fixture_dictionary, fixture_rows


def columns_of(spark, texts, **columns):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return {r["t"]: r for r in df.select("t", *[c.alias(n) for n, c in columns.items()]).collect()}


def test_folder_facts_are_hashed_and_right(spark, tracks):
    """Flags, counts and sets of a folder in one aggregate of objects were sorted beyond 128 folders."""
    rows = tracks(
        row("a/2.flac", title="1. Allegro", composer="Brahms", albumartist="Smetana Quartet", discnumber="2/2"),
        row("a/1.flac", title="Menuetto", albumartist="Wiener Philharmoniker"),
        row("A/3.flac", title=["x", "y"], composer=["Dvorak", "Brahms"]),
        row("b/1.flac", albumartist="Nobody", composer="Brahms", discnumber="1/1"),
    )
    needs = {"multi_disc", "sibling_composer", "folder_other", "sibling_ensemble", "styles"}
    facts = AuditContext(rows, Index.build(fixture_dictionary(spark)), needs).folders(needs)
    found = {r["folder_key"]: r.asDict() for r in facts.collect()}
    a, b = found["a"], found["b"]
    assert (a["n_rows"], a["n_titles"], a["styles"], a["multi_disc"]) == (3, 2, ["1.", "none"], True)
    assert (a["sibling_ensemble"], a["sibling_composer"], a["canon_min"], a["canon_max"]) == (
        "Wiener Philharmoniker", None, "Dvorak; Brahms", "Johannes Brahms"
    )
    assert (b["n_rows"], b["n_titles"], b["styles"], b["multi_disc"]) == (1, 0, [], False)
    assert (b["sibling_ensemble"], b["sibling_composer"]) == (None, "Johannes Brahms")
    assert "ObjectHashAggregate" not in facts._jdf.queryExecution().executedPlan().toString()


def test_only_texts_with_pairs_of_bytes_reach_the_decoder(spark):
    texts = [MISREAD, "x " + MISREAD, "Karl Böhm", "Günter Wand", "Dvořák", "ÄÖÜ", "plain", ""]
    got = columns_of(spark, texts, g=K.maybe_japanese_run(F.col("t")), m=K.maybe_mojibake(F.col("t")))
    assert {t for t in texts if got[t]["g"]} >= {MISREAD, "x " + MISREAD}
    assert not any(got[t]["g"] for t in ("Karl Böhm", "Günter Wand", "Dvořák", "plain", ""))
    assert got["Karl Böhm"]["m"]
    for a in (*range(0x40, 0x7F), *range(0x80, 0x100)):  # whatever the guard holds back has no run
        for b in (0x20, 0x41, 0x81, 0x88, 0xE0, 0xFC):
            for raw in (bytes([0x83, 0x4A, a, b]), bytes([a, b, 0x88, 0x9F]), bytes([b, a, 0x82, 0xA0, 0x20])):
                run = re.search("[぀-ヿ一-鿿]{2}", raw.decode("cp932", "replace"))
                assert not run or re.search(K._PAIR * 2, raw.decode("latin-1"))


def test_patterns_judge_as_their_definitions(spark):
    texts = [
        " Track 04 ", "track7 ", "\u0085 12-3", "12_", "a - 5 ", "a b - 5", "\tX-9\n", "1. Allegro", "1-1. x", "12 x", "( IV x", "I. x",
        "第1楽章", "٣ x", "Finale", "", "X (1797 - 1828) Y", "1797-18", "KARAJAN H", "KARAJaN", "xKARAJAN", "ÄÖÜÄÖ",
    ]
    got = columns_of(
        spark, texts, placeholder=X.is_placeholder(F.col("t")), style=X.movement_style(F.col("t")),
        span=X.has_life_span(F.col("t")), caps=X.has_caps_word(F.col("t")),
    )
    for t in texts:
        s = t.strip()
        placeholder = re.search(r"^track\s*\d+$", s, re.I) or re.search(r"^\d+([-_]\d+)?$", s) or re.search(r"^\S+\s*-\s*\d+$", s)
        assert got[t]["placeholder"] == bool(placeholder), t
        style = next((label for p, label in X.MOVEMENT_STYLES if re.search(p, t)), X.NO_STYLE)
        assert got[t]["style"] == style, t
        assert got[t]["span"] == bool(re.search(r"\(?\s*1[0-9]{3}\s*[-–]\s*[12][0-9]{3}\s*\)?", t)), t
        assert got[t]["caps"] == bool(re.search(r"\b[A-ZÄÖÜ]{5,}\b", t)), t


def test_plain_folds_are_those_of_all_texts(spark):
    """ASCII texts have classes of their own; keys and tokens stay those of the definition."""
    texts = ["A-b, C.d/E_f (G) [h] & i:j;k", "ünter Wand・x　y、z", "x\x7f\x00y", "--", "", "O'Neil \"Z\" \\ #1"]
    for separators in (X.DICTIONARY_SEPARATORS, X.FINDER_SEPARATORS):
        got = columns_of(spark, texts, k=K.name_key_of("t"), tokens=K.token_keys_of("t", separators))
        for t in texts:
            assert got[t]["k"] == K.key_of_text(t), t
            parts = [K.key_of_text(p) for p in re.split(f"[{separators}]+".replace(r"\x{3000}", "　"), t)]
            assert got[t]["tokens"] == [p for p in parts if p], t


def test_the_catalogue_is_dealt_to_all_cores(spark, tmp_path):
    """One file of orders was one task, which made all rows of the catalogue."""
    spark.range(4_000).selectExpr("id AS o_orderkey", "id % 50 AS o_custkey").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    made = fixture_rows(spark, str(tmp_path))
    assert made.count() == made.select("track_id").distinct().count() == 4_000
    sizes = [r["n"] for r in made.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) <= 1_000


def test_path_keys_are_made_once_a_row_and_folders_cut_once(spark, tracks):
    """Each finding made its path key again, and each row cut the segments of its folder."""
    rows = tracks(row("A\\Brahms/1.FLAC", artist="x; X"), row("A\\Brahms/2.FLAC"))
    index = Index.build(fixture_dictionary(spark))
    found = inspect(rows, index, rules=["R-105"])
    assert {r["path_key"] for r in found.select("path_key").collect()} == {"a/brahms/1.flac", "a/brahms/2.flac"}
    rules = [r for r in REGISTRY if r.id in ("R-102", "R-105")]
    made = AuditContext(rows, index, passes=5).row_pass(rules)
    assert "path_key" in made.columns and "replace(relative_path" not in finish(made)._jdf.queryExecution().optimizedPlan().toString()
    of_folder = {"folder": (X.segments(F.col("folder")), WHOLE)}
    folders = spark.createDataFrame([("Brahms/x",), ("Brahms/x",), ("Karajan",), (None,)], "folder string")
    plain, once = (index.facts(folders, of_folder, (), c).select("value", "first_composer", "first_conductor") for c in (None, {"folder": "folder"}))
    assert sorted(map(str, plain.collect())) == sorted(map(str, once.collect())) and once.count() == 2
