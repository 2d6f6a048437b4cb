import tempfile
from datetime import datetime, timezone

import pytest
from conftest import row
from pyspark.sql import functions as F

from tagloom.operators import apply as A, findings as G
from tagloom.plans.audit import inspect
from tagloom.plans.fixture import fixture_index
from tagloom.schema import CHANGE_COLUMNS
from tagloom.sources import catalogue as C, export, snapshots


def changes(spark, *rows):
    """(path, field, before, after, rule, clears) as selected findings."""
    schema = "relative_path string, field string, before array<string>, after array<string>, rule_id string, clears boolean"
    df = spark.createDataFrame(list(rows), schema)
    return df.select(
        "relative_path", F.lower("relative_path").alias("path_key"), "field", F.lit(0).alias("field_ord"), "before", "after",
        "rule_id", F.when(F.col("rule_id") == "MANUAL", "Manual").otherwise("Error").alias("severity"),
        F.lit("None").alias("hold"), "clears", F.create_map(F.lit("code"), F.lit("x")).alias("evidence"),
        F.lit(True).alias("is_selected"),
    ).select(*CHANGE_COLUMNS)


def test_proposals(spark):
    df = changes(
        spark,
        ("a", "title", ["x"], ["y"], "R-1", False), ("A", "title", ["x"], ["y"], "R-2", False),
        ("b", "title", ["x"], ["y"], "R-1", False), ("b", "title", ["x"], ["z"], "R-2", False),
        ("c", "title", ["x"], ["y"], "R-1", False), ("c", "title", ["x"], ["m"], "MANUAL", False),
        ("d", "title", ["x"], [], "R-1", True), ("d", "title", ["x"], ["m"], "R-2", False),
        ("e", "title", ["x"], [], "R-403", True), ("f", "title", [], [], "R-403", True),
    )
    plan = {r.path_key: r.new_values for r in A.apply_plan(df).collect()}
    assert plan == {"a": ["y"], "c": ["m"], "e": []}
    conflicts = {r.path_key: (r.resolved, r.adopted) for r in A.apply_conflicts(df).collect()}
    assert conflicts == {"b": (False, None), "c": (True, "m"), "d": (False, None)}


def test_apply_restore_round_trip(spark, tracks):
    root = tempfile.mkdtemp(prefix="run-")
    before = tracks(
        row("a/1.flac", genre="Opera", date="1993-01-22"), row("a/2.flac", discnumber="1/1", genre="Classic"),
        row("b/3.mp3", fmt="Id3", title="Allegro.mp3"),
    )
    found = inspect(before, fixture_index(spark), rules=["R-101", "R-102", "R-103", "R-104", "R-302"])
    done = A.apply_changes(before, found, root, root + "/v2")
    assert done.mismatches.isEmpty() and done.conflicts.isEmpty()
    assert done.counters.head().asDict() == {"attempted": 2, "succeeded": 2, "applied": 6, "failed": 0}
    after = {r.relative_path: (r.genre, r.date, r.title, r.discnumber) for r in done.written.collect()}
    assert after == {
        "a/1.flac": (["Classic"], ["1993"], [], ["1/1"]), "a/2.flac": (["Classic"], [], [], ["1/1"]),
        "b/3.mp3": (["Classic"], [], ["Allegro"], ["1/1"]),
    }
    again = inspect(done.written, fixture_index(spark), rules=["R-101", "R-102", "R-103", "R-104", "R-302"])
    assert again.isEmpty()
    assert G.remove_findings(found, done.succeeded).filter("is_selected").isEmpty()
    saved = snapshots.read_snapshot(spark, done.snapshot)
    only = A.restore_items(saved, done.written).filter("path_key = 'a/1.flac' and field = 'genre'")
    some, _ = A.restore(saved, done.written, root + "/v4", selected=only, root=root, library_root="D:/Music")
    assert {r.relative_path: (r.genre, r.date) for r in some.collect() if r.relative_path == "a/1.flac"} == {"a/1.flac": (["Opera"], ["1993"])}
    assert [r.library_root for r in snapshots.list_snapshots(spark, root, True).filter("reason = 'BeforeRestore'").collect()] == ["D:/Music"]
    written, mismatches = A.restore(saved, done.written, root + "/v3")
    assert mismatches.isEmpty()
    assert sorted(written.drop("raw_tags").collect()) == sorted(before.drop("raw_tags").collect())


def test_unsupported_field_surfaces_in_verification(spark, tracks):
    before = tracks(row("b/3.mp3", fmt="Id3"), row("b/4.flac"))
    plan = A.apply_plan(changes(spark, ("b/3.mp3", "comment", [], ["c"], "MANUAL", False), ("b/4.flac", "comment", [], ["c"], "MANUAL", False)))
    left = A.verify(plan, A.overlay(before, plan)).collect()
    assert [(r.relative_path, r.expected, r.actual) for r in left] == [("b/3.mp3", ["c"], [])]


def test_restore_plan(spark, tracks):
    old = tracks(row("a/1", title="t", comment="c"), row("A/2", title="t"), row("gone", title="t"))
    new = tracks(row("a/1", title="u"), row("a/2", title="t"), row("new", title="t"))
    items = lambda v: [(r.relative_path, r.field, r.new_values) for r in A.restore_items(old, new, v).collect()]
    assert sorted(items(2)) == [("a/1", "comment", ["c"]), ("a/1", "title", ["t"])]
    # A version that did not record comments says nothing about them.
    assert items(1) == [("a/1", "title", ["t"])]
    assert [r[0] for r in A.restore_missing(old, new).collect()] == ["gone"]
    assert [r[0] for r in A.restore_added(old, new).collect()] == ["new"]


def test_manual_edits(spark, tracks):
    base = tracks(row("a/1", title="t", artist=["x", "y"]), row("a/2", title="t"))
    log = spark.createDataFrame(
        [
            (1, "A/1", "title", " new ", 1), (2, "a/1", "artist", "x", 3), (3, "a/2", "title", "u", 1), (4, "a/2", "title", "t", 1),
            (5, "a/2", "genre", "g", 1), (6, "a/2", None, None, 1), (7, "a/2", "album", "", 1), (8, "a/1", "date", None, 1),
        ],
        "seq int, relative_path string, field string, value string, bulk_size int",
    )
    edits = A.manual_edits(base, log)
    got = {(r.relative_path, r.field): (r.after, r.clears, r.evidence["code"]) for r in A.edits_to_changes(edits).collect()}
    assert got == {("a/1", "title"): (["new"], False, "edit"), ("a/1", "artist"): (["x"], False, "bulk_edit")}
    shown = {r.relative_path: (r.edited, r.multiple, r.title, r.artist) for r in A.display_overlay(base, edits).collect()}
    assert shown == {"a/1": (True, True, "new", "x"), "a/2": (False, False, "t", None)}


def test_edit_warnings(spark, tracks):
    base = tracks(
        row("a", albumartist="Various Artists", artist=["p", "q"]), row("b", fmt="Id3"),
    )
    df = changes(
        spark,
        ("a", "albumartist", ["Various Artists"], ["Wiener Philharmoniker"], "MANUAL", False),
        ("a", "artist", ["p", "q"], ["カラヤン"], "MANUAL", False), ("a", "conductor", [], ["Beethoven Trio"], "MANUAL", False),
        ("b", "comment", [], ["c"], "MANUAL", False), ("b", "date", [], ["75"], "MANUAL", False), ("b", "genre", ["g"], [], "MANUAL", True),
        ("b", "discnumber", [], ["1"], "MANUAL", False), ("b", "composer", [], ["No; One"], "MANUAL", False),
    )
    got = sorted((r.relative_path, r.field, r.code) for r in A.edit_warnings(df, base, fixture_index(spark)).collect())
    assert got == sorted([
        ("a", "albumartist", "protected"), ("a", "artist", "collapses_values"), ("a", "artist", "japanese_name"),
        ("a", "conductor", "composer_name"), ("b", "comment", "unsupported_field"), ("b", "date", "date_form"),
        ("b", "discnumber", "number_form"), ("b", "composer", "semicolon"), ("b", "composer", "not_in_dictionary"),
    ])


def test_selection_and_summary(spark):
    df = changes(spark, ("a", "title", ["x"], ["y"], "R-1", False), ("b", "title", ["x"], [], "R-1", False), ("c", "title", ["x"], ["y"], "R-2", False))
    df = df.withColumn("is_selected", G.default_selected())
    cleared = G.set_selection(df, F.col("rule_id") == "R-1", False)
    assert {r.relative_path for r in G.selected_only(cleared).collect()} == {"c"}
    heads = {r.rule_id: r.all_selected for r in G.selection_headers(cleared, F.lit(True)).collect()}
    assert heads == {"R-1": False, "R-2": True}
    total = {r.rule_id: (r.found, r.fixable, r.selected) for r in G.rule_summary(cleared).collect()}
    assert total == {"R-1": (2, 1, 0), "R-2": (1, 1, 1), None: (3, 2, 1)}


def test_scan_and_number_pairs(spark):
    raw = spark.createDataFrame(
        [
            ("x\\Backup_1\\a.flac", {}, None), ("backup_file.m4a", {"trkn": ["0x000000030009", "0x00000000", "0x0000000400", "7"], "©nam": ["t", " "]}, None),
            ("b.txt", {}, None), ("c.MP3", {"TIT2": ["q"], "COMM": ["no"]}, None), ("d.flac", None, "bad header"),
        ],
        "relative_path string, raw_tags map<string,array<string>>, error string",
    ).withColumn("full_path", F.col("relative_path"))
    good, failed = C.scan(raw)
    got = {r.relative_path: (r.format, r.title, r.tracknumber, r.comment) for r in good.collect()}
    assert got == {"backup_file.m4a": ("M4a", ["t"], ["3/9", "4", "7"], []), "c.MP3": ("Id3", ["q"], [], [])}
    assert [(r.relative_path, r.message) for r in failed.collect()] == [("d.flac", "bad header")]


def test_snapshot_names_and_history(spark, tracks):
    root, shared = tempfile.mkdtemp(prefix="run-"), tempfile.mkdtemp(prefix="run-")
    at = datetime(2026, 8, 3, 1, 2, 3, tzinfo=timezone.utc)
    df = tracks(row("a/1"))
    first = snapshots.write_snapshot(df, root, "Manual", library_root="D:/Music/", at=at)
    second = snapshots.write_snapshot(df, root, "Manual", library_root="D:/Music/", at=at)
    other = snapshots.write_snapshot(df, shared, "Manual", library_root="E:/x", at=at)
    mine = snapshots.write_snapshot(df, shared, "BeforeApply", library_root="d:\\music", at=datetime(2026, 9, 1, tzinfo=timezone.utc))
    assert first.endswith("backup_20260803010203") and second.endswith("_2")
    entries = snapshots.list_snapshots(spark, root, False).unionByName(snapshots.list_snapshots(spark, shared, True))
    got = [r.path for r in snapshots.snapshot_history(entries, "D:/Music").collect()]
    assert got == [mine, second, first] and other not in got
    with pytest.raises(FileNotFoundError):
        snapshots.read_snapshot(spark, root + "/backup_0")


def test_csv_export(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/out"
    df = changes(spark, ("a/b.flac", "title", ['say "x"'], ["y", "z"], "R-1", False))
    export.write_csv(export.change_rows(df).coalesce(1), path)
    import glob

    text = open(glob.glob(path + "/*.csv")[0], encoding="utf-8").read().splitlines()
    assert text[0].startswith('"﻿rule","severity"')
    assert text[1] == '"R-1","Error","confirmed","o","a/b.flac","a","b.flac","title","say ""x""","y; z","x"'


def test_scope(spark):
    df = spark.createDataFrame([("brahms",), ("brahms/x",), ("brahms2",), ("",)], "f string")
    assert [r.f for r in df.filter(C.in_scope(F.col("f"), "Brahms\\")).collect()] == ["brahms", "brahms/x"]
