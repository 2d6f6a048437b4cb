"""Queries that read whole aliases and give all tables of their operator."""

from collections import Counter

import duckdb

from tagloom.operators import suggest as S
from tagloom.plans import queries as Q
from tagloom.plans.fixture import derived_dictionary, fixture_index

SF = "/root/testdata/sf0.001"


def test_suggest_names_asks_whole_aliases_and_inner_parts(spark):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    out = con.execute(Q.ORACLES["suggest_names"])
    names = [d[0] for d in out.description]
    want = Counter(map(tuple, out.fetchall()))
    found = Q.QUERIES["suggest_names"](spark, SF).select(*names).collect()
    assert Counter(map(tuple, found)) == want
    asked = {r["query"] for r in found}
    aliases = {a for r in derived_dictionary(spark, SF, bundled=False).composers.collect() for a in r.aliases}
    own = {a for a in aliases if a.startswith("CA ")}  # names that the bundled entries have too
    assert own and own <= asked and {a[3:9] for a in own} <= asked


def test_works_template_gives_all_tables(spark):
    found = Counter(r.table for r in Q.QUERIES["works_template"](spark, SF).collect())
    made = S.works_template(Q.report_units(spark, SF).persist(), fixture_index(spark))
    assert len(made) == 5 and found == Counter({k: n for k, df in made.items() if (n := df.count())}) and len(found) > 1
    print(found)
