"""Hard negatives, conversation repair and archives against brute force, with nulls, ties, repeats, long rows and clashing names."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from tagloom.llm import chat_repair, hard_negatives, queries, warc


def keyed(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# hard negatives


def negatives_by_force(rows, positives=5, negatives=3):
    least = {}
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        item = (label, [math.floor(256 * x) for x in vector])
        least[vec_id] = min(least.get(vec_id, item), item)
    score = lambda a, b: sum(x * y for x, y in zip(least[a][1], least[b][1]))
    out = []
    for anchor in (v for v in least if v % 50 == 0):
        same = sorted((-score(anchor, v), v) for v in least if v != anchor and least[v][0] == least[anchor][0])[:positives]
        for minus, positive in same:
            hard = sorted((-score(anchor, v), v) for v in least if least[v][0] != least[anchor][0] and 50 * -minus <= 100 * score(anchor, v) <= 95 * -minus)
            out += [(anchor, positive, i + 1, v, -minus, -s) for i, (s, v) in enumerate(hard[:negatives])]
    return sorted(out, key=repr)


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def vectors():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        vector = [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) if i % 3 else rng.gauss(0, 0.3) for _ in range(6)]
        rows.append((i, vector, rng.choice([0, 0, 0, 1, 2]), "x", 1.0))
    rows += [(500, None, 1, "x", 1.0), (501, [0.1] * 6, None, "x", 1.0), (502, [0.1, None, 0.2], 1, "x", 1.0), (503, [float("nan")] * 6, 1, "x", 1.0)]
    rows += [(504, [float("inf")] * 6, 1, "x", 1.0), (None, [0.1] * 6, 1, "x", 1.0), (550, [], 1, "x", 1.0), (600, [0.5, 0.5], 0, "x", 1.0), (650, [0.0] * 6, 7, "x", 1.0)]
    return [*rows, rows[50], (100, [0.0] * 6, 0, "y", 2.0)]


VECTORS = "vec_id bigint, embedding array<float>, label int, anchor string, rank double"


@pytest.mark.parametrize("block", [None, 4000])
def test_hard_negatives(spark, monkeypatch, block):
    if block:  # several blocks of anchors and candidates
        monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
        monkeypatch.setattr(hard_negatives, "STEP_SCORES", 100)
    table = spark.createDataFrame(vectors(), VECTORS).repartition(4)
    found = hard_negatives.hard_negatives(table, table["vec_id"] % 50 == 0)
    want = negatives_by_force([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], c) for i, v, c, *_ in vectors()])
    assert keyed(found, *NEGATIVES) == want and len(want) > 30
    assert hard_negatives.hard_negatives(table.limit(0), table["vec_id"] % 50 == 0).count() == 0


@pytest.mark.parametrize("most", [0, 1, 300, 10**6, 2**40, 2**61])
def test_packed_products_are_exact(most):
    rng = random.Random(most)
    for low in (-most, 0, most // 2):
        rows = np.array([[rng.randint(low, most) for _ in range(5)] for _ in range(11)], np.int64)
        anchors = np.array([[rng.randint(-most, most) for _ in range(5)] for _ in range(4)], np.int64)
        packed = hard_negatives.Packed(rows, hard_negatives._weight(anchors))
        want = [[max(-(2**63) + 1, min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, r)))) for r in rows] for a in anchors]
        assert packed.scores(anchors).tolist() == want
    assert hard_negatives.Packed(np.array([[200, -200]] * 5), 2000).fields == 3


def test_ids_of_text(spark):
    table = spark.createDataFrame([(f"v{i}", [1.0, float(i % 3)], i % 2) for i in range(20)], "vec_id string, embedding array<double>, label int")
    found = hard_negatives.hard_negatives(table, table["vec_id"] == "v4").collect()
    assert found and {r["anchor_id"] for r in found} == {"v4"}


# conversation repair


def cheapest(rows):
    """Least (cost, edits, turns) over all edits, by exhausting them."""
    seen, steps = set(), []
    for role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        twice = not blank and (role, text) in seen
        seen.add((role, text))
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        steps.append((role, text, blank or twice, 0 if last and last in ".!?" else 3))
    best = {("", 0): (0, "", ())}  # initials so far, rows read
    out = []
    for i in range(len(steps) + 1):
        for _ in range(2):
            for (form, at), (cost, edits, turns) in list(best.items()):
                for role in ("user", "assistant"):
                    new = (cost + 3, edits + "I", (*turns, f"{role}:"))
                    key = (form + role[0], i)
                    if at == i and re.fullmatch(r"s?(ua)*u?", key[0]) and new < best.get(key, (9**9,)):
                        best[key] = new
        if i == len(steps):
            break
        role, text, gone, extra = steps[i]
        step = {}
        for (form, at), (cost, edits, turns) in best.items():
            moves = [("D", form, 4, ())]
            if not gone:
                moves += [("K", form + (role[:1] or "?"), extra, (f"{role}:{text}",))] + [("R", form + r[0], 3 + extra, (f"{r}:{text}",)) for r in ("user", "assistant")]
            for letter, to, price, turn in moves:
                new = (cost + price, edits + letter, turns + turn)
                if re.fullmatch(r"s?(ua)*u?", to) and new < step.get((to, i + 1), (9**9,)):
                    step[to, i + 1] = new
        best = step
    out = [v for (form, _), v in best.items() if re.fullmatch(r"(s?(ua)+)?", form)]
    return min(out)


def test_repair_of_short_conversations_is_the_ascii_least_cheapest(spark):
    kinds = [("user", "a?"), ("assistant", "b."), ("system", "c!"), ("user", "cut"), ("tool", "d."), ("user", " "), ("assistant", "b.")]
    cases = [c for n in range(4) for c in itertools.product(kinds, repeat=n)]
    rng = random.Random(1)
    cases += [tuple(rng.choice(kinds) if rng.random() < 0.5 else (rng.choice(["user", "assistant", "system", "", "agent"]), rng.choice(["x.", "y", "z! \n", "q"]) + str(i) * (i % 2)) for i in range(rng.randint(4, 6))) for _ in range(60)]
    rows = [(c, t, role, text, "x", 0) for c, case in enumerate(cases) for t, (role, text) in enumerate(case)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, key string, segment int").repartition(5)
    found = {r["key"]: r for r in chat_repair.repair_digests(table).collect()}
    assert len(found) == sum(bool(c) for c in cases)
    for c, case in enumerate(cases):
        if case:
            cost, edits, turns = cheapest(case)
            r = found[f"={c}"]
            assert (r["cost"], r["audit"]) == (cost, edits), case
            assert r["repaired_sha256"] == hashlib.sha256("\n".join(turns).encode()).hexdigest()
            assert r["illegal"] == sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(case))


def test_segments_of_a_long_conversation_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(None if c == 2 else c, rng.choice([None, *range(400)]), rng.choice([None, "user", "assistant", "system", "agent"]), rng.choice([None, "a.", "b", f"{rng.random()}!", "é" * 50])) for c in (1, 2, 3) for _ in range(500)]
    rows += [(3, 7, "user", "same.")] * 300
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    whole = keyed(chat_repair.repair_digests(table), "key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    # the workers import the module anew, so the limit reaches them by the function itself
    steps = [(rng.choice("uas?"), rng.random() < 0.2, rng.choice([0, 3])) for _ in range(200)]
    one = chat_repair.walk(steps, chat_repair.END, chat_repair.START, True)[0]
    cuts = [0, 1, 40, 41, 130, 200]
    parts = [steps[a:b] for a, b in itertools.pairwise(cuts)]
    ends = [chat_repair.END]
    for part in reversed(parts[1:]):
        ends.insert(0, chat_repair.through(chat_repair.matrix(part), ends[0]))
    state, edits = chat_repair.START, ""
    for part, end in zip(parts, ends):
        new, state = chat_repair.walk(part, end, state, part is parts[-1])
        edits += new
    assert edits == one
    assert [w[0] for w in whole] == ["", "=1", "=3"]
    by_force = {}
    for c, turn, role, text in rows:
        by_force.setdefault("" if c is None else f"={c}", []).append((turn is not None, turn or 0, " " if role is None else role, " " if text is None else text))
    for key, gaps, blank, duplicate, _, _, _, audit, _ in whole:
        own = sorted(by_force[key])
        turns = {t for known, t, _, _ in own if known}
        assert gaps == max(turns) - min(turns) + 1 - len(turns)
        seen = {(r, t) for _, _, r, t in own if t.strip()}
        assert blank == sum(not t.strip() for *_, t in own) and duplicate == len(own) - blank - len(seen)
        assert len(audit.replace("I", "")) == len(own)


def test_long_conversations_over_segments(spark):
    turns = [(1, i, ("user", "assistant")[i % 2] if i % 97 else "system", f"{i}{'.' if i % 5 else ''}") for i in range(9500)]
    table = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    found = chat_repair.repair(table)
    assert found.count() >= 3
    edits = "".join(r["edits"] for r in found.orderBy("segment").collect())
    steps = [(role[:1], False, 0 if text.endswith(".") else 3) for _, _, role, text in turns]
    want, _ = chat_repair.walk(steps, chat_repair.END, chat_repair.START, True)
    assert edits == want
    assert chat_repair.repair_digests(table).first()["cost"] == chat_repair.cost_of(want, steps)
    assert chat_repair.repair_digests(table.limit(0)).count() == 0


def test_damage_and_dropped_conversations(spark, tmp_path):
    rows = [(c, t, "user", "a. b!") for c in range(60) for t in range(3)] + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    left = {}
    for c, t, *_ in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        left.setdefault(c, []).extend([] if kind == 0 else [(t, {1: "", 2: "a b"}.get(kind, "a. b!"))] * (2 if kind == 3 else 1))
    found = {r["conv_id"]: r for r in queries.op12_checkpointed_repair(spark, str(tmp_path)).collect()}
    assert set(found) == set(left)
    for c, own in left.items():
        assert len(found[c]["audit"].replace("I", "")) == len(own)
        turns = {t for t, _ in own if t is not None}
        assert found[c]["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        if not own:
            assert tuple(found[c])[1:8] == (0, 0, 0, 0, 0, 0, "") and found[c]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


# archives


def pages():
    rows = [(i, f"http://{h}.Example.org/{p}", f"<p>{i % 40}\r\n\r\n</p>", "x", 1) for i, (h, p) in enumerate(itertools.product(["a", "b", "www.a"], range(30)))]
    rows += [(1000, None, None, "x", 1), (1001, "http://a.example.org/x y\tz\r\nq#f", "", "x", 1), (None, "http://null.org", "<p>1\r\n\r\n</p>", "x", 1), (None, "http://null.org", "alone", "x", 1)]
    rows += [(2000, "ftp://u@h.org:21/é?q=1", "é" * 100_000, "x", 1), (2000, "ftp://u@h.org:21/é?q=1", "é" * 100_000, "x", 1), (2001, "no scheme", "WARC/1.1\r\n", "x", 1)]
    return rows


PAGES = "page_id bigint, url string, html string, key string, record int"


def test_archived_pages(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_CAPTURES", 10)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    table = spark.createDataFrame(pages(), PAGES).repartition(3)
    last = {}
    for i, _, html, *_ in pages():
        last[html or ""] = max((x for x in (last.get(html or ""), i) if x is not None), default=None)
    want = []
    for i, _, html, *_ in pages():
        body = (html or "").encode()
        first = i == last[html or ""]
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if first else "revisit", None if first else last[html or ""]))
    assert keyed(warc.archived(table), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    assert warc.archived(table.limit(0)).count() == 0
    big = keyed(warc.archived(table, least=100), "page_id", "record_type")
    assert [x for x in big if x[1] == "revisit"] == []


def test_lookup_reads_the_records_of_a_url(spark, tmp_path):
    table = spark.createDataFrame(pages(), PAGES).repartition(2)
    folder = f"{tmp_path}/warc"
    assert warc.write_archives(table, folder) == len(pages())
    raw = b"".join(p.read_bytes() for p in (tmp_path / "warc").glob("part-*"))
    assert raw.count(b"WARC/1.1\r\nWARC-Type: ") == len(pages()) and raw.endswith(b"\r\n\r\n")
    index = warc.build_index(spark, folder)
    asked = spark.createDataFrame([("https://a.example.ORG/7#top",), ("http://www.a.example.org/2",), ("http://nowhere.org/",), (None,)], "url string")
    found = warc.lookup(index, asked).collect()
    assert sorted((r["id"], r["payload"].decode()) for r in found) == [("1000", ""), ("62", "<p>22\r\n\r\n</p>"), ("7", "")]
    assert {r["id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found}["7"] == ("revisit", "87", 12)


def test_url_keys(spark):
    cases = {"http://a.Example.org:80/x?y#z": "org,example,a:80)/x?y", "https://u:p@b.org": "org,b)", "no scheme": ")no%20scheme", None: ")", "http://h.org?x=1:2": "org,h)?x=1:2", "http://é.org/\n": "org,é)/%0A"}
    table = spark.createDataFrame([(c,) for c in cases], "url string")
    assert {r[0]: r[1] for r in table.select("url", warc.url_key(table["url"])).collect()} == cases


def test_damaged_payloads_are_noticed():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1:X>\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(b"hi").digest()) + b"\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    assert warc.parse_record(good + b"\r\n\r\n")["payload"] == b"hi"
    with pytest.raises(ValueError):
        warc.parse_record(good.replace(b"\r\n\r\nhi", b"\r\n\r\nho") + b"\r\n\r\n")


def test_scan_returns_memory_of_earlier_stages_first(monkeypatch):
    import importlib

    module = importlib.import_module("tagloom.llm.decontaminate")
    done = []
    monkeypatch.setattr(module, "release", lambda: done.append("release"))
    monkeypatch.setattr(module, "Automaton", lambda *a: done.append("automaton"))
    assert list(module._scan([("a", "b c")], 13)(iter(()))) == [] and done == ["release", "automaton"]
