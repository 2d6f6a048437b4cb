"""What a whole audit asks of the driver: one plan at a time, and no table of many rows by way of it."""

import pytest
from conftest import row

from tagloom.operators import lineage
from tagloom.operators.findings import rule_summary
from tagloom.operators.lookup import Index
from tagloom.operators.units import join_groups
from tagloom.plans import audit as P
from tagloom.plans.fixture import fixture_dictionary
from tagloom.schema import CHANGE_COLUMNS

RULES = ["R-101", "R-103", "R-205", "R-403", "R-501"]  # four passes


def odd_rows(tracks):
    return tracks(
        row("a/1.flac", genre="Opera", artist="x; X", album="A", composer="Johannes Brahms"),
        row("a/2.flac", genre="Classic", album="A", composer="Anton Bruckner", discnumber="2/2"),
        row("B/1.flac", title=["x", "X"]),
    )


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_findings_of_many_passes_are_written_pass_by_pass(spark, tracks, monkeypatch):
    index, rows = Index.build(fixture_dictionary(spark)), odd_rows(tracks)
    with monkeypatch.context() as at_once:
        at_once.setattr(P, "FEW_PASSES", 9)
        whole = P.inspect(rows, index, rules=RULES)
    found = P.inspect(rows, index, rules=RULES)
    plan = plan_of(found)
    assert "Exchange" not in plan and "Join" not in plan and plan.count("FileScan") == 1
    assert found.columns == CHANGE_COLUMNS == whole.columns
    assert found.count() > 4 and sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    with pytest.raises(ValueError):
        P.inspect(rows, index, rules=[])
    assert {r["rule_id"] for r in rule_summary(found).collect()} == {"R-101", "R-103", "R-205", "R-501", None}


def test_a_pass_is_planned_when_those_before_it_are_written(spark, monkeypatch):
    seen, freed = [], []
    monkeypatch.setattr(lineage, "release", freed.append)

    def frames():
        for i in range(3):
            seen.append(len(lineage._SETTLED.get(spark.sparkContext.applicationId, [])))
            yield spark.range(i).selectExpr("id", f"array('{i}', null) AS v")  # the first has no rows

    found = lineage.settle_all(spark, frames(), "parts")
    assert [n - seen[0] for n in seen] == [0, 1, 2] and len(freed) == 3
    assert sorted(map(tuple, found.collect())) == [(0, ["1", None]), (0, ["2", None]), (1, ["2", None])]


def test_facts_of_many_texts_do_not_pass_the_driver(spark, tracks, monkeypatch):
    monkeypatch.setattr(lineage, "SMALL_ROWS", 100)
    rows = [row(f"a/{i:04d} Brahms.flac", artist="Karajan", composer="Bruckner") for i in range(300)]
    ctx = P.AuditContext(tracks(*rows), Index.build(fixture_dictionary(spark)), ["stem_composer", "name:artist"])
    df = ctx.know(ctx.pick("artist", "composer"), "stem", "others")
    assert "SortMergeJoin" in plan_of(df) and "BroadcastHashJoin" not in plan_of(df)
    assert {tuple(r["stem_others"]) for r in df.collect()} == {("Johannes Brahms",)}
    few = ctx.know(ctx.pick("artist"), "artist", "person")
    assert "BroadcastHashJoin" in plan_of(few) and few.filter("artist_person = 'Herbert von Karajan'").count() == 300


def test_facts_of_many_groups_do_not_pass_the_driver(spark, monkeypatch):
    rows = spark.range(900).selectExpr("id % 300 AS g", "CAST(id AS STRING) AS relative_path")
    facts = spark.range(300).selectExpr("id AS g", "3L AS n_rows", "id * 2 AS x")
    assert "SortMergeJoin" not in plan_of(join_groups(rows, facts, ["g"]))
    monkeypatch.setattr(lineage, "SMALL_ROWS", 100)
    joined = join_groups(rows, facts, ["g"])
    assert "SortMergeJoin" in plan_of(joined) and joined.count() == joined.filter("x = g * 2").count() == 900
