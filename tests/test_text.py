from pyspark.sql import functions as F

from tagloom.functions import text as X
from tagloom.functions.keys import (
    decode_mojibake, has_japanese_run, key_of_text, maybe_mojibake, name_key, ngram_keys, token_keys,
)


def evaluate(spark, expression, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_key_equals_its_definition(spark):
    # Blocks that are the same in every recent Unicode version.
    blocks = [(0x20, 0x860), (0x1E00, 0x2000), (0x2100, 0x2190), (0x3041, 0x3400), (0xFB00, 0xFB50), (0xFF01, 0xFFF0)]
    chars = [chr(c) for low, high in blocks for c in range(low, high)]
    words = ["バッハ", "ばっは", "Antonín Dvořák", "ﬁne ½ Ⅳ", "각 한글", "각", "Münchener Bach-Chor", "ｶﾞｷﾞ", "", "  ", "J.S.Bach"]
    values = chars + words
    got = evaluate(spark, name_key, values)
    assert [(v, g) for v, g in zip(values, got) if g != key_of_text(v)] == []


def test_key_examples(spark):
    assert evaluate(spark, name_key, ["Dvořák", "バッハ", "ヴェーバー", None, "!!"]) == ["dvorak", "ハッハ", "ウェーハー", "", ""]


def test_token_and_ngram_keys(spark):
    got = evaluate(spark, lambda v: token_keys(v, X.DICTIONARY_SEPARATORS), ["Bach-Chor (München) J.S.Bach!", ""])
    assert got == [["bach", "chor", "munchen", "j", "s", "bach"], []]
    (grams,) = evaluate(spark, lambda v: ngram_keys(v, X.FINDER_SEPARATORS), ["Herbert von Karajan 8"])
    assert grams == [
        "herbertvonkarajan8", "herbertvonkarajan", "vonkarajan8", "herbertvon", "vonkarajan", "karajan8",
        "herbert", "von", "karajan", "8",
    ]


def test_placeholder_and_title_from_file(spark):
    titles = ["Track04", "track 4", "1-1", "07", "ショス15 - 02", "Allegro", "1. Allegro"]
    assert evaluate(spark, X.is_placeholder, titles) == [True, True, True, True, True, False, False]
    stems = ["02 Symphony No.15 in A Major", "1-02 - Andante", "03", "04 Track04", "Presto"]
    assert evaluate(spark, X.title_from_stem, stems) == ["Symphony No.15 in A Major", "Andante", None, None, "Presto"]


def test_white_space_and_digits_of_all_scripts(spark):
    titles = ["　Track01", "Track01\t", "１", "Track　1", "a - 1", "　"]
    assert evaluate(spark, X.is_placeholder, titles) == [True, True, True, True, True, False]
    assert evaluate(spark, X.strip, ["　 a b \t"]) == ["a b"] and evaluate(spark, X.is_blank, [" \n", None, "x"]) == [True, True, False]
    assert evaluate(spark, X.segments, ["　a/\t/b"]) == [["a", "b"]] and evaluate(spark, X.head_of, ["a　- b"]) == ["a"]
    assert evaluate(spark, X.numbers_in, ["No. ９ 1"]) == [["９", "1"]]


def test_movement_styles(spark):
    titles = ["1. Allegro", "5-1. Allegro", "1 Allegro", "I. Allegro", "(I. Allegro)", "第1楽章 Allegro", "Allegro"]
    assert evaluate(spark, X.movement_style, titles) == ["1.", "5-1.", "1 Allegro", "I.", "(I.", "第N楽章", "none"]


def test_year_and_disc(spark):
    assert evaluate(spark, X.recording_year, ["1993-01-22T08:00:00Z", "19xx", None, "rec. 2004"]) == [1993, None, None, 2004]
    assert evaluate(spark, X.disc_number, ["2/3", " 4 ", "x", "0", None, "-1"]) == [2, 4, 1, 1, 1, 1]


def test_paths(spark):
    paths = ["a\\b/c.flac", "x.flac", "a/b.c/d.e.m4a"]
    assert evaluate(spark, X.folder_of, paths) == ["a/b", "", "a/b.c"]
    assert evaluate(spark, X.stem_of, paths) == ["c", "x", "d.e"]
    assert evaluate(spark, X.segments, ["a / b/ c0"]) == [["a", "b", "c0"]]


def test_numbers_templates_and_slugs(spark):
    assert evaluate(spark, X.numbers_in, ["No. 9 Op. 125 in 1824 9"]) == [["9", "125"]]
    assert evaluate(spark, X.work_template, ["Symphony No. 9 Op. 1", "Requiem"]) == ["Symphony No. {0} Op. 1", None]
    assert evaluate(spark, X.slug, ["I Musici!", "??"]) == ["i-musici", "ensemble"]
    assert evaluate(spark, X.loosen_number, ["No.4", "Op.  12", "4.5"]) == ["No. 4", "Op. 12", "4.5"]
    assert evaluate(spark, X.alias_lines, [" a \r\nb\n\na"]) == [["a", "b"]]


def test_natural_order(spark):
    rows = spark.createDataFrame([("a10",), ("a2",), ("a02",), ("a1b",), ("b",), ("1",)], "v string")
    got = [r[0] for r in rows.orderBy(X.natural_key(F.col("v"))).collect()]
    assert got == ["1", "a1b", "a2", "a02", "a10", "b"]


def test_mojibake(spark):
    bad = "カラヤン".encode("cp932").decode("latin-1")
    values = [bad, "カラヤン", "Karl Böhm", "Antonín Dvořák", "plain"]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    found = rows.filter(maybe_mojibake(F.col("v"))).withColumn("d", decode_mojibake(F.col("v"))).filter(has_japanese_run(F.col("d")))
    assert [(r.v, r.d) for r in found.collect()] == [(bad, "カラヤン")]


def test_diacritics_and_typos(spark):
    assert evaluate(spark, X.diacritic_words, ["Die walkure, Konig (Konig)"]) == [["Walkure", "Konig"]]
    assert evaluate(spark, X.diacritic_suggestion, ["Die Walkure"]) == ["Die Walküre"]
    typos = [(r"\bAllgro\b", "Allegro"), (r"(\d)x", "$1")]
    assert evaluate(spark, lambda v: X.fix_typos(v, typos), ["Finale: Allgro molto 3x", "Allgrox"]) == ["Finale: Allegro molto 3", "Allgrox"]


def test_typo_patterns_with_groups(spark):
    typos = [(r"(?<x>a)b", "${x}"), (r"(\w)\1", "$1"), (r"(?<x>c)d", "$x$$\\$&"), ("zz?", "${0}!")]
    assert evaluate(spark, lambda v: X.typo_match(v, typos), ["moon", "mon", "abc", "cd", "z", None]) == [True, False, True, True, True, None]
    assert evaluate(spark, lambda v: X.fix_typos(v, typos), ["abc", "moon", "cd", "z"]) == ["ac", "mon", "$x$\\cd", "z!"]
