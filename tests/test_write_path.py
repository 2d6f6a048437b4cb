"""Versions that are written row by row, places in an order, and registrations that lose no row."""

import os
import random

import pytest
from conftest import row
from pyspark.sql import functions as F
from test_workflow import changes

from tagloom.functions import text as X
from tagloom.operators import apply as A, dictionary_jobs as D, lineage
from tagloom.operators.lineage import clear, settle
from tagloom.operators.ordering import numbered, numbered_within
from tagloom.plans.fixture import fixture_dictionary, fixture_index
from tagloom.sources import catalogue as C, snapshots
from tagloom.sources.dictionary import from_rows


def test_a_row_that_fails_stops_no_other(spark, tracks, tmp_path):
    before = tracks(row("01.m4a", fmt="M4a", title="a"), row("02.m4a", fmt="M4a", title="b"), row("壊れた.m4a", fmt="M4a", title="c"), row("odd.xyz", fmt=None, title="d"), row("kept.m4a", title="e"))
    found = changes(
        spark, ("01.m4a", "title", ["a"], ["x"], "R-1", False), ("02.m4a", "title", ["b"], ["y"], "R-1", False), ("02.m4a", "genre", [], ["g"], "R-2", False),
        ("壊れた.m4a", "title", ["c"], ["z"], "R-1", False), ("odd.xyz", "title", ["d"], ["z"], "R-1", False), ("gone.m4a", "title", ["q"], ["z"], "R-1", False),
        ("kept.m4a", "title", ["e"], ["f"], "R-1", False), ("KEPT.m4a", "title", ["e"], ["g"], "R-2", False),
    )
    target = f"{tmp_path}/v2"
    done = A.apply_changes(before, found, str(tmp_path), target, error=F.when(F.col("relative_path").startswith("壊"), "IOException: locked"))
    assert {r.relative_path: r.message for r in done.failures.collect()} == {
        "壊れた.m4a": "IOException: locked", "odd.xyz": "unknown format", "gone.m4a": "not in the catalogue",
    }
    assert done.counters.head().asDict() == {"attempted": 6, "succeeded": 2, "applied": 3, "failed": 3}
    assert {r.relative_path: (r.title, r.genre) for r in done.written.collect()} == {
        "01.m4a": (["x"], []), "02.m4a": (["y"], ["g"]), "壊れた.m4a": (["c"], []), "odd.xyz": (["d"], []), "kept.m4a": (["e"], []),
    }
    assert done.written.columns == before.columns and done.mismatches.isEmpty()
    assert sorted((r.path_key, r.field) for r in done.succeeded.collect()) == [("01.m4a", "title"), ("02.m4a", "genre"), ("02.m4a", "title")]
    assert not os.path.exists(target + "._writing")
    with pytest.raises(FileExistsError):
        A.apply_changes(before, found, str(tmp_path), target)
    # what was left by a run that died is no version and does not stand in the way
    os.makedirs(f"{tmp_path}/v3._writing/x")
    assert A.restore_version(before, done.written, f"{tmp_path}/v3").counters.head().asDict() == {"attempted": 2, "succeeded": 2, "applied": 3, "failed": 0}


def test_null_fields_are_empty_ones(spark, tracks):
    schema = tracks(row("a")).schema
    old = spark.createDataFrame([row("a", genre="x"), row("b")], schema)
    gone = spark.createDataFrame([tuple(None if i in (9, 3) else v for i, v in enumerate(r)) for r in (row("a", genre="x"), row("b"))], schema)
    assert [(r.relative_path, r.field, r.current_values, r.new_values) for r in A.restore_items(old, gone).collect()] == [("a", "genre", [], ["x"])]
    assert A.restore_items(gone, gone).isEmpty()
    assert [r.e for r in gone.select(C.has_empty_field().alias("e")).collect()] == [True, True]
    assert [r.genre for r in C.with_derived(gone).collect()] == [[], []]


def test_bucketed_versions_are_compared_without_a_shuffle(spark, tracks, tmp_path):
    rows = [row(f"a/{i}.flac", title=f"t{i}", genre="g") for i in range(200)]
    newer = [row(f"A/{i}.flac", title="new" if i % 50 == 0 else f"t{i}", genre="g") for i in range(200)]
    old = snapshots.save_bucketed(tracks(*rows), "old_version", 4, f"{tmp_path}/old")
    new = snapshots.save_bucketed(tracks(*newer), "new_version", 4, f"{tmp_path}/new")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = A.restore_items(old, new)
        assert "Exchange" not in items._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.new_values[0] for r in items.collect()) == ["t0", "t100", "t150", "t50"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE old_version")
        spark.sql("DROP TABLE new_version")


def test_places_in_an_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i) for i in range(3000)] + [("hot", 1, 3000 + i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(7)
    want = {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])))}
    assert {r.i: r.place for r in numbered(df, "place", "g", "x", "i").collect()} == want
    within, seen = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        within[r[2]] = seen[r[0]] = seen.get(r[0], -1) + 1
    assert {r.i: r.place for r in numbered_within(df, "place", "g", "x", "i").collect()} == within
    assert numbered(df.limit(0), "place", "x").count() == 0


def test_natural_order(spark):
    names = ["", "1", "01", "1a", "2", "10", "9999999999999999999999", "a", "A", "a1", "a01", "a1b", "a2", "a10", "ä", "b", "Track 2.flac", "track 2.flac", "Track 10.flac", "５", "第2番", "第10番"]
    shuffled = spark.createDataFrame([(n,) for n in random.Random(3).sample(names, len(names))], "v string")
    got = [r.v for r in numbered(shuffled.withColumn("k", X.natural_key(F.col("v"))), "place", "k").orderBy("place").collect()]
    assert got[:7] == ["", "1", "1a", "01", "2", "10", "9999999999999999999999"]
    at = got.index
    # the runs before a number decide first, the shorter text of equal runs comes first
    assert at("a") < at("a1") < at("a1b") < at("a01") < at("a2") < at("a10") < at("A") < at("ä") and at("track 2.flac") < at("Track 10.flac") and at("第2番") < at("第10番")
    assert at("a") < at("ä") < at("b")
    # only ASCII digits are numbers
    assert spark.createDataFrame([("５",)], "v string").select(X.natural_key(F.col("v"))[0]["kind"].alias("k")).head().k == 1


def test_settled_tables_are_removed(spark, monkeypatch):
    monkeypatch.setattr(lineage, "_SETTLED", {})  # the index of other tests stays
    table = settle(spark.range(3).toDF("x"), "temporary")
    place = table.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(place)
    clear(spark)
    assert not os.path.exists(place)


def test_ids_of_a_stem_with_many_names(spark):
    names = spark.range(20_000).select(F.col("id").alias("ord"), F.when(F.col("id") % 1000 == 500, F.concat(F.lit("Foo "), (F.col("id") / 100).cast("int"))).otherwise("Foo").alias("canonical"))
    old = spark.createDataFrame([("foo",), ("FOO-7",), (None,)], "entity_id string")
    got = {r.ord: r.entity_id for r in D.entity_ids(names, old).collect()}
    used, want, last = {"foo", "foo-7"}, {}, {}
    for r in names.orderBy("ord").collect():
        base = r.canonical.lower().replace(" ", "-")
        n = last.get(base, 1)
        while (base if n == 1 else f"{base}-{n}") in used:
            n += 1
        last[base] = n
        want[r.ord] = base if n == 1 else f"{base}-{n}"
        used.add(want[r.ord])
    assert got == want
    assert D.entity_ids(names.limit(0), old).count() == 0


def test_decisions_become_entries_or_have_a_code(spark):
    d = fixture_dictionary(spark)
    unknown = spark.createDataFrame([(v, c, 1) for v in ("X", "x!", "Y", "カラ", "Brahms!") for c in ("composer", "person", "ensemble")], "value string, category string, n_paths long")
    rows = [
        (1, "X", "composer", "alias", "Johannes Brahms", None, None, None), (2, "x!", "composer", "alias", "Johannes Brahms", None, None, None),
        (3, "Brahms!", "composer", "alias", "Johannes Brahms", None, None, None), (4, "Y", "composer", "alias", "Nobody", None, None, None),
        (5, "X", "person", "new", None, " X Person ", None, ["Soloist"]), (6, "Y", "person", "new", None, "x person", None, ["Conductor"]),
        (7, "カラ", "person", "alias", "Herbert von Karajan", None, None, None), (8, "X", "ensemble", "alias", "Leningrad Philharmonic Orchestra", None, None, None),
        (9, "Y", "ensemble", "new", None, "Y Band", "Y-Band ", None), (10, "カラ", "ensemble", "new", None, "Z", "RU-spb-phil", None),
        (11, "none", "person", "new", None, "N", None, ["Soloist"]), (12, "Y", "person", None, None, None, None, None), (13, "Y", "person", "new", None, "Karl Böhm", None, ["Soloist"]),
    ]
    decisions = spark.createDataFrame(rows, "seq long, value string, category string, action string, target string, canonical string, entity_id string, roles array<string>")
    checked = D.register_unknown(unknown, decisions, fixture_index(spark).lookup)
    assert checked.count() == len(rows)
    made, outcome = D.take_over(d, checked)
    assert {r.seq: r.code for r in outcome.collect()} == {
        1: None, 2: "claimed", 3: "already_there", 4: "unknown_target", 5: None, 6: "claimed", 7: None, 8: None, 9: None, 10: "exists", 11: "not_found", 12: "no_action", 13: "exists",
    }
    assert made.composers.filter("canonical = 'Johannes Brahms'").head().aliases == ["Brahms", "Brahmus", "X"]
    new = made.persons.filter("canonical = 'X Person'").head()
    assert (new.aliases, new.roles) == (["X"], ["Soloist"]) and made.persons.count() == d.persons.count() + 1
    assert made.persons.filter("canonical = 'Herbert von Karajan'").head().aliases_ja == ["カラヤン", "カラ"]
    assert made.ensembles.filter("entity_id = 'ru-spb-phil'").head().aliases == ["Leningrad Philharmonic", "X"]
    band = made.ensembles.filter("entity_id = 'Y-Band'").head()
    assert (band.canonical, band.eras, band.no_conductor) == ("Y Band", [], False)


def test_work_decisions_stay(spark):
    units = spark.createDataFrame([("a/Sym 3", 1, ["Symphony 4"]), ("b", None, None)], "folder string, disc int, albums array<string>")
    rows = [(1, "a/Sym 3", 1, "C", "W", ["w"]), (2, "no", 1, "C", "W", []), (3, "b", None, "C", "　W　", ["v"]), (4, "b", 1, "C", "W", []), (5, "a/Sym 3", 1, "C", "　", [])]
    checked = D.register_works(units, spark.createDataFrame(rows, "seq long, folder string, disc int, composer string, name string, aliases array<string>"))
    assert {r.seq: (r.problem, r.warning) for r in checked.collect()} == {
        1: (None, "numbers_disagree"), 2: ("no_unit", None), 3: (None, None), 4: ("no_unit", None), 5: ("no_name", "numbers_disagree"),
    }
    (one,) = D.take_over_works(fixture_dictionary(spark, works=[("C", "W", ["x"], [])]), checked).works.collect()
    assert one.canonical == "W" and one.aliases == ["x", "v"]  # `w` is the canonical's own key


def test_overrides_offer_only_what_the_unit_has(spark):
    holds = spark.createDataFrame([("a", 1, "WorkUnknown"), ("a", 2, "WorkUnknown")], "folder string, disc int, unit_hold string")
    units = spark.createDataFrame([("a", 1, ["C1"], ["1975"]), ("a", 2, ["C2"], ["1980", "1981"])], "folder string, disc int, composers array<string>, dates array<string>")
    rows = [("a", 1, "C1", "1975"), ("a", 1, "C2", "1975"), ("a", 1, "Known", "1980"), ("a", None, "C2", "1981"), ("a", 2, None, "1982"), ("a", 2, "Known", None)]
    df = spark.createDataFrame([(f, d, c, None, y, False, "n") for f, d, c, y in rows], "folder string, disc int, composer string, work_name string, date string, exclude boolean, note string")
    names = spark.createDataFrame([("Known",)], "name string")
    got = {(r.disc, r.composer, r.date): r.problem for r in D.check_overrides(df, holds, units, names).collect()}
    assert got == {
        (1, "C1", "1975"): None, (1, "C2", "1975"): "composer_not_offered", (1, "Known", "1980"): "date_not_in_unit", (None, "C2", "1981"): None,
        (2, None, "1982"): "date_not_in_unit", (2, "Known", None): None,
    }


def test_nearest_names_with_a_common_given_name(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    names = list(dict.fromkeys(f"Johann {word(rng.randint(3, 9))}" if i % 3 == 0 else f"{word(rng.randint(1, 6))} {word(rng.randint(2, 8))}" for i in range(3000)))
    asked = {}
    for name in rng.sample(names, 300):
        s = list(name)
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(s) + 1)
            s[i : i + rng.randint(0, 1)] = rng.choice(["", "z"])
        text = "".join(s).strip()
        if text and text not in names:
            asked[text] = name
    d = from_rows(spark, composers=[(n, [], []) for n in names], works=[(a, w, [], []) for a in asked for w in ("w", "v")])
    got = {r.composer: r.closest for r in D.nearest_composers(d).collect()}

    def distance(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, line[0] = line[0], i
            for j, y in enumerate(b, 1):
                last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (x != y))
        return line[-1]

    by_length = {}
    for i, n in enumerate(names):
        by_length.setdefault(len(n), []).append((i, n))
    for a in asked:
        near = [(distance(a, n), i, n) for size in range(len(a) - 3, len(a) + 4) for i, n in by_length.get(size, ())]
        best = min((x for x in near if x[0] <= 3), default=(0, 0, None))
        assert got[a] == best[2], a
