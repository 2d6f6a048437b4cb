import json
import random
import re
import tempfile

from conftest import row
from pyspark.sql import functions as F

from tagloom.functions.keys import key_of_text
from tagloom.operators import dictionary_jobs as D, suggest as S
from tagloom.plans.fixture import fixture_dictionary, fixture_index
from tagloom.sources.dictionary import from_rows, local_table, read_dictionary, read_tables, write_dictionary, write_tables, TABLES


def test_json_round_trip(spark):
    d = fixture_dictionary(spark)
    root = tempfile.mkdtemp(prefix="run-")
    path = write_dictionary(d, root, 1)
    back = read_dictionary(spark, path)
    for name, table in d.tables().items():
        assert sorted(map(str, table.collect())) == sorted(map(str, getattr(back, name).select(table.columns).collect())), name
    text = json.loads(spark.read.text(path).head()[0])
    assert "canonical" not in text["ensembles"][1] and text["ensembles"][1]["eras"][0] == {"until": 1991, "canonical": "Leningrad Philharmonic Orchestra"}
    write_tables(d, root + "/t")
    assert read_tables(spark, root + "/t").works.count() == 45


def test_json_with_comments_and_missing_lists(spark):
    path = tempfile.mkdtemp(prefix="run-") + "/d.json"
    with open(path, "w") as f:
        f.write('{ /* note */ "version": 3, "composers": [{"canonical": "X"}], "persons": null, "_x": 1 }')
    d = read_dictionary(spark, path)
    assert d.version == 3 and d.persons.isEmpty() and d.composers.head().aliases == []
    assert read_dictionary(spark, path + "no", default_path=path).version == 3


def test_nearest_composer_against_brute_force(spark):
    rng = random.Random(7)
    names = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(1, 14))).strip() or "z" for _ in range(60)]
    names = list(dict.fromkeys(names))

    def mutate(s):
        s = list(s)
        for _ in range(rng.randint(1, 5)):
            i = rng.randrange(len(s) + 1)
            s[i:i + rng.randint(0, 1)] = rng.choice(["", "q", "ab"])
        return "".join(s).strip() or "q"

    asked = list(dict.fromkeys(m for n in names for m in (mutate(n),) if m not in names))

    def distance(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, line[0] = line[0], i
            for j, y in enumerate(b, 1):
                last, line[j] = line[j], min(line[j] + 1, line[j - 1] + 1, last + (x != y))
        return line[-1]

    expected = {}
    for a in asked:
        d, i = min((distance(a, n), i) for i, n in enumerate(names))
        expected[a] = names[i] if d <= 3 else None
    d = from_rows(spark, composers=[(n, [], []) for n in names], works=[(a, "w", [], []) for a in asked])
    got = {r.composer: r.closest for r in D.nearest_composers(d).collect()}
    assert got == expected


def test_merge(spark):
    user = from_rows(
        spark, composers=[("A One", ["a1"], [])], ensembles=[("e1", "E", [], False, False, [], [])],
        typos=[("x", "y", "")], protected=[("P",)],
    )
    bundled = from_rows(
        spark, version=3, composers=[("a one", ["A1", "other", "アー"], []), ("B Two", [], [])],
        persons=[("P One", ["Conductor"], [], [])],
        ensembles=[("E1", "E", [], True, True, ["new name"], []), ("e2", None, [], False, False, [], [])],
        typos=[("x", "z", ""), ("w", "v", "")], protected=[("p",), ("Q",)],
    )
    plan = D.merge_plan(user, bundled)
    got = sorted((r.kind, r.target, r.detail) for r in plan.collect())
    assert got == sorted([
        ("add_composer", "B Two", ""), ("add_alias", "A One", "other"), ("add_alias", "A One", "アー"), ("add_person", "P One", ""),
        ("add_ensemble", "e2", ""), ("enable_no_conductor", "E1", ""), ("enable_no_era_split", "E1", ""), ("add_alias", "e1", "new name"),
        ("add_typo", "w", "v"), ("add_protected", "Q", ""),
    ])
    merged = D.merge_apply(user, bundled, plan)
    first = merged.composers.filter("ord = 0").head()
    assert (first.aliases, first.aliases_ja) == (["a1", "other"], ["アー"])
    e = merged.ensembles.filter("entity_id = 'e1'").head()
    assert e.no_conductor and e.no_era_split and e.aliases == ["new name"]
    assert merged.version == 3 and not D.needs_update(merged, bundled)


def test_redundant_aliases(spark):
    d = from_rows(
        spark,
        composers=[("Anton Bruckner", ["Bruckner", "anton bruckner", "bruckner!", "Antonbruckner", "!!"], ["ブル"])],
        persons=[("Kyung Wha", ["Soloist"], ["kyungwha", "Chung", "CHUNG"], [])],
        works=[("C", "Symphony No. 1", ["Symphony No.1", "S1"], [])],
    )
    removed = sorted((r.category, r.name, r.kept_name) for r in D.redundant_aliases(d).collect())
    assert removed == sorted([
        ("composer", "anton bruckner", "Anton Bruckner"), ("composer", "bruckner!", "Bruckner"),
        ("person", "kyungwha", "Kyung Wha"), ("person", "CHUNG", "Chung"), ("work", "Symphony No.1", "Symphony No. 1"),
    ])
    clean = D.clean_aliases(d)
    assert clean.composers.head().aliases == ["Bruckner", "Antonbruckner", "!!"]
    assert clean.composers.head().aliases_ja == ["ブル"] and clean.persons.head().aliases == ["Chung"]
    assert D.redundant_aliases(clean).isEmpty()


def test_bulk_edits(spark):
    d = fixture_dictionary(spark)
    rows = spark.createDataFrame(
        [("Johannes Brahms", "J. Brahms", 1), ("Johannes Brahms", "ブラ", 2), ("Johannes Brahms", "BRAHMS", 3), ("Nobody", "x", 4)],
        "target string, alias string, seq int",
    )
    table, rejected = D.add_aliases(d.composers, rows)
    first = table.filter("ord = 0").head()
    assert first.aliases == ["Brahms", "Brahmus", "J. Brahms"] and first.aliases_ja == ["ブラームス", "ブラ"]
    assert [r.target for r in rejected.collect()] == ["Nobody"]
    works = spark.createDataFrame(
        [(0, " Johannes Brahms", "Symphony No. 1", ["symphonyno1", "First"]), (1, "Johannes Brahms", "Requiem", ["req", "REQ", "Requiem"])],
        "ord long, composer string, canonical string, aliases array<string>",
    )
    out = D.upsert_works(d.works, works)
    assert out.count() == 46
    assert out.filter("ord = 0").head().aliases == ["Johannes Brahms 1", "First"]
    assert out.filter("canonical = 'Requiem'").head().aliases == ["req"]
    new = spark.createDataFrame(
        [(0, "A/b", None, None, None, None, True, "n"), (1, "a\\B\\", None, "C", None, None, False, "m"), (2, "A/b", 2, "C", None, None, False, "m")],
        TABLES["overrides"],
    )
    old = local_table(spark, TABLES["overrides"], [(0, "a/b/", None, None, None, None, True, "old"), (1, "z", None, None, None, None, True, "z")])
    got = sorted((r.ord, r.folder, r.disc, r.composer) for r in D.upsert_overrides(old, new).collect())
    assert [g[1:] for g in got] == [("a\\B\\", None, "C"), ("z", None, None), ("A/b", 2, "C")]


def test_entity_ids(spark):
    names = spark.createDataFrame([(0, "I Musici"), (1, "i musici!"), (2, "New"), (3, "I MUSICI")], "ord long, canonical string")
    taken = spark.createDataFrame([("i-musici",), ("I-Musici-3",)], "entity_id string")
    got = {r.ord: r.entity_id for r in D.entity_ids(names, taken).collect()}
    assert got == {0: "i-musici-2", 1: "i-musici-4", 2: "new", 3: "i-musici-5"}


def test_entity_ids_are_given_one_after_another(spark):
    rng = random.Random(1)
    for texts, old in ([["Foo", "Foo", "Foo 2"], []], [["Foo 2", "Foo", "Foo", "Foo 3", "Foo", "??", "!"], ["foo-4", "Ensemble"]],
                       [[rng.choice(["Foo", "Foo 2", "Foo 2 2", "Foo 02", "Bar"]) for _ in range(14)], ["foo-2-2", "bar-3"]]):
        used, want = {o.lower() for o in old}, {}
        for i, text in enumerate(texts):
            base = "-".join(re.findall(r"\w+", text.lower())) or "ensemble"
            want[i] = next(c for n in range(1, 99) for c in [base if n == 1 else f"{base}-{n}"] if c not in used)
            used.add(want[i])
        names = spark.createDataFrame(list(enumerate(texts)), "ord long, canonical string")
        taken = spark.createDataFrame([(o,) for o in old], "entity_id string")
        assert {r.ord: r.entity_id for r in D.entity_ids(names, taken).collect()} == want


def test_override_proposals(spark):
    holds = spark.createDataFrame([("a", 1, "DateUnknown"), ("a", 2, "Other"), ("b", 1, "DateUnknown"), ("b", 2, "DateUnknown")], "folder string, disc int, unit_hold string")
    rows = [
        ("a", 1, None, None, None, True, "n"), ("a", 2, "C", None, "x", True, "n"), ("a", None, None, None, None, True, "n"), ("b", None, None, None, None, True, "n"),
        ("b", 9, "C", None, None, False, "n"), ("b", 1, "C", None, None, False, "　"), ("b", 1, None, None, "75", False, "n"), ("b", 2, None, " ", None, None, "n"),
    ]
    df = spark.createDataFrame(rows, "folder string, disc int, composer string, work_name string, date string, exclude boolean, note string")
    got = sorted((tuple(r) for r in D.check_overrides(df, holds).collect()), key=repr)
    problems = ["exclude_not_offered", None, None, "exclude_not_offered", "not_held", "no_note", "year_form", "no_effect"]
    want = [(*r[:2], *([None] * 3 if r[5] else r[2:5]), *r[5:], p) for r, p in zip(rows, problems)]
    assert got == sorted(want, key=repr)


def test_import_and_registration(spark):
    d = fixture_dictionary(spark)
    works = local_table(spark, TABLES["works"], [(0, "Johannes Brahm", "W", ["w", "v"], [])])
    merged, issues = D.import_works(d, works, d.overrides)
    assert D.has_error(issues) and merged.works.head().aliases == ["v"]
    bad = issues.filter("code = 'composer_unknown'").head()
    assert bad.detail == "Johannes Brahms @15"
    unknown = spark.createDataFrame([("X", "person", 3), ("Y", "ensemble", 1)], "value string, category string, n_paths int")
    decisions = spark.createDataFrame(
        [("X", "person", "new", None, "X", None, []), ("Y", "ensemble", "alias", "Smetana Quartet", None, None, None)],
        "value string, category string, action string, target string, canonical string, entity_id string, roles array<string>",
    )
    got = {r.value: r.problem for r in D.register_unknown(unknown, decisions, fixture_index(spark).lookup).collect()}
    assert got == {"X": "no_role", "Y": None}


def test_suggestions_against_brute_force(spark):
    d = fixture_dictionary(spark)
    asked = ["b", "an", "bruck", "ブ", "", "zzz", "Anton B"]
    names = {c: [c, *a, *j] for c, a, j in [(r.canonical, r.aliases, r.aliases_ja) for r in d.composers.collect()]}
    expected = set()
    for q in asked:
        key, hits = key_of_text(q), []
        for c, ns in names.items():
            ranks = [((0 if key_of_text(n).startswith(key) else 2) + (n != c), i, n) for i, n in enumerate(ns) if key in key_of_text(n)]
            if ranks:
                r, _, n = min(ranks)
                hits.append((r if key else 0, c, None if n == c or not key else n))
        expected |= {(q, c, n, i + 1) for i, (_, c, n) in enumerate(sorted(hits, key=lambda h: h[:2])[:20])}
    rows = spark.createDataFrame([(q,) for q in asked], "query string")
    got = {(r.query, r.canonical, r.matched_alias, r.place) for r in S.suggest_names(rows, d, "composer").collect()}
    assert got == expected


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    edges = [(f"u{i}", f"k{rng.randrange(60)}") for i in range(40) for _ in range(2)]
    edges += [(f"c{i}", f"x{j:02}") for i in range(25) for j in (i, i + 1)]  # a long chain
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for item, key in edges:
        parent[find(item)] = find(key)
    groups = {}
    for _, key in edges:
        groups.setdefault(find(key), set()).add(key)
    expected = {key: min(g) for g in groups.values() for key in g}
    got = {r.key: r.label for r in S.components(spark.createDataFrame(edges, "item string, key string")).collect()}
    assert got == expected


def test_works_template(spark):
    units = spark.createDataFrame(
        [
            ("Brahms/ブラームス 4 - Wand", 1, 3, ["Johannes Brahms"], ["Fourth", "Box"]),
            ("Brahms/Sym 1", 1, 4, ["Johannes Brahms"], ["Box"]),
            ("Brahms/Sym 1 - Solti", 2, 4, ["Johannes Brahms"], ["First"]),
            ("Mixed", 1, 2, ["A", "B"], []),
        ],
        "folder string, disc int, n_tracks long, composers array<string>, albums array<string>",
    )
    made = S.works_template(units, fixture_index(spark))
    got = sorted((r.aliases, r.aliases_ja) for r in made["works"].collect())
    assert got == [(["First", "Sym 1"], []), (["Fourth"], ["ブラームス 4"])]
    assert [(r.album, r.owners) for r in made["ambiguous"].collect()] == [("Box", 2)]
    assert [r.folder for r in made["unresolved"].collect()] == ["Mixed"]
    assert made["foreign"].isEmpty()


def test_suggest_works(spark):
    units = spark.createDataFrame(
        [("Brahms/Piano 3 - Brahms", 1, "Johannes Brahms", ["Brahms: Symphony No.3"])],
        "folder string, disc int, composer string, albums array<string>",
    )
    got = [(r.value, r.source) for r in S.suggest_works(units, fixture_index(spark)).orderBy("place").collect()]
    assert got == [("Symphony No. 3", "hint"), ("Piano 3", "hint")]
    bare = spark.createDataFrame([("", 1, "Johannes Brahms", [])], units.schema)
    works = [r.canonical for r in fixture_index(spark).dictionary.works.filter("composer = 'Johannes Brahms'").collect()]
    got = {(r.value, r.source) for r in S.suggest_works(bare, fixture_index(spark)).collect()}
    assert works and got == {(w, "same composer") for w in sorted(works)[:8]}
