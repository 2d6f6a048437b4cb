"""The queries over findings run every registered rule."""

from collections import Counter

import pytest

from tagloom.operators.rules import REGISTRY
from tagloom.plans import queries as Q

SF = "/root/testdata/sf0.001"
OVER_FINDINGS = [
    "rule_summary", "top_findings", "selection", "apply_plan", "apply_conflicts", "apply_overlay", "verify", "remaining_findings",
    "change_export", "summary_export",
]


@pytest.mark.parametrize("name", OVER_FINDINGS)
def test_no_rule_is_left_out(spark, monkeypatch, name):
    class Seen(Exception):
        pass

    def seen(tracks, index, rules=None, **_):
        raise Seen(rules)

    monkeypatch.setattr(Q, "inspect", seen)
    with pytest.raises(Seen) as found:
        Q.QUERIES[name](spark, SF)
    assert set(found.value.args[0]) == {r.id for r in REGISTRY}


@pytest.fixture(scope="module")
def changes(spark):
    return Q.audit(spark, SF, Q.ALL_RULES).persist()


def rows_of(sql):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{SF}/orders.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, Counter(map(tuple, found.fetchall()))


@pytest.mark.parametrize("name", ["rule_summary", "summary_export", "selection", "apply_plan", "rule_r403"])
def test_all_rules_against_sql(spark, monkeypatch, changes, name):
    monkeypatch.setattr(Q, "inspect", lambda *_, rules=None, **__: changes.filter(changes.rule_id.isin(list(rules))))
    names, want = rows_of(Q.ORACLES[name])
    assert Counter(map(tuple, Q.QUERIES[name](spark, SF).select(*names).collect())) == want


def test_exports_against_brute_force(spark, monkeypatch, changes):
    """Every row again in Python, and by SQL."""
    monkeypatch.setattr(Q, "inspect", lambda *_, **__: changes)
    want, groups = Counter(), Counter()
    for r in changes.collect():
        before, after = "; ".join(r.before), "; ".join(r.after)
        fix = r.hold == "None" and (bool(r.before) if r.clears else bool(r.after) and r.after != r.before)
        kind = "held" if r.hold != "None" else "confirmed" if fix and r.severity != "Info" else "review"
        shown = "(clear)" if r.clears else after if fix else ""
        args = ", ".join(f"{k}={v}" for k, v in sorted(r.evidence.items()) if k != "code" and v is not None)
        why = r.evidence["code"] + (f" ({args})" if args else "")
        folder, _, file = r.relative_path.rpartition("/")
        want[r.rule_id, r.severity, kind, "o" if kind == "confirmed" else "", r.relative_path, folder, file, r.field, before, shown, why] += 1
        groups[r.rule_id, r.field, before, shown, why] += 1
    export = Q.QUERIES["change_export"](spark, SF).collect()
    assert Counter(map(tuple, export)) == want and len({r.rule for r in export}) > 20
    top, place = [], Counter()
    for key, n in sorted(groups.items(), key=lambda x: (x[0][0], -x[1], x[0][1:])):
        place[key[0]] += 1
        top += [(*key, n, place[key[0]])] if place[key[0]] <= 8 else []
    found = Q.QUERIES["top_findings"](spark, SF).select("rule_id", "field", "before_text", "after_text", "rationale", "n", "rank").collect()
    assert sorted(map(tuple, found)) == sorted(top)
    for name in ("change_export", "top_findings"):
        names, rows = rows_of(Q.ORACLES[name])
        assert Counter(map(tuple, Q.QUERIES[name](spark, SF).select(*names).collect())) == rows
