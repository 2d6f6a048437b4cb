"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tagloom.llm import chat, decontaminate, language_crf, near_dedup, packing, quality, sharding, suffix_dedup, token_counts, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, carried string, score double, g int"
BPE = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def prose(rng, n, words=None):
    words = words or ["the", "Über", "naïve", "tree", "of", "river", "stone", "walks", "évite", "light", "and", "slowly", "x1", "日本"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", "\t"]) for _ in range(n))


def rows():
    rng = random.Random(7)
    base = prose(rng, 300, [f"w{i}" for i in range(400)])
    texts = [base, base, base + " tail", base.replace("w7 ", "W7 "), base[:900], None, "", "   \n ", "one", "one", "Two words", "a b c d e", "A B C D E", "a b c d"]
    texts += [prose(rng, rng.randint(1, 80)) for _ in range(30)]
    texts += ["\x00" * 120, "ab" * 200, prose(rng, 6000, [f"v{i}" for i in range(900)]), "<|endoftext|> <s> ▁▁ x", "é" * 60 + base[100:400]]
    out = [(i * 3 % 101, t, "en", "s", 1, "c", 0.5, 1) for i, t in enumerate(texts)]
    return [*out, out[2], (None, base, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def keyed(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(text, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_near_duplicates(docs):
    sets = {}
    for doc, text, *_ in rows():
        w = words(text)
        sets[doc] = set(zip(*(w[i:] for i in range(5)))) if len(w) > 4 else {tuple(w)} if w else set()
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations([d for d in sets if d is not None], 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    want = sorted(((d, len(sets[d]), root[d] if d is not None else None, d is None or root[d] == d) for d, *_ in rows()), key=repr)
    assert keyed(near_dedup.near_duplicates(docs)) == want
    with pytest.raises(ValueError):
        near_dedup.near_duplicates(docs, percent=60)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 98)]
    random.Random(2).shuffle(edges)
    found = {r["node"]: r["component"] for r in near_dedup.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(0, 2**63, 300, dtype=np.uint64), rng.integers(0, 2**63, (2, 50), dtype=np.uint64)
    doc = np.repeat([0, 1], 350)
    best = near_dedup.signatures(doc, np.concatenate([shared, own[0], shared, own[1]]), 2, 512)
    assert abs((best[0] == best[1]).mean() - 300 / 400) < 0.08
    one = near_dedup.signatures(np.zeros(1, int), shared[:1], 1)
    assert sorted(one[0] >> np.uint64(32)) == list(range(near_dedup.SLOTS))  # one element: a whole permutation of ranks


def test_suffix_dedup(docs):
    first = {}
    data = [(d, (t or "").encode()) for d, t, *_ in rows()]
    for d, b in data:
        for s in range(len(b) - 49) if d is not None else ():
            first[b[s : s + 50]] = min(d, first.get(b[s : s + 50], d))
    want = []
    for d, b in data:
        hit = bytearray(len(b))
        for s in range(len(b) - 49):
            if d is not None and first[b[s : s + 50]] < d:
                hit[s : s + 50] = b"\1" * 50
        runs = sum(1 for i, h in enumerate(hit) if h and (not i or not hit[i - 1]))
        want.append((d, len(b), sum(hit), runs, hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest()))
    found = suffix_dedup.repeated_spans(docs, carry=docs.columns)
    assert keyed(found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) == sorted(want, key=repr)
    kept = suffix_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == sum(1 for w in want if not w[2] or w[2] < w[1])


def test_merge_of_front_coded_runs():
    rng = random.Random(1)
    share = lambda a, b: next((i for i in range(50) if a[i] != b[i]), 50)
    for _ in range(20):
        runs = []
        for _ in range(rng.randint(1, 9)):
            keys = sorted(bytes(rng.choice(b"ab") for _ in range(6)) + b"c" * 44 for _ in range(rng.randint(0, 12)))
            runs.append((keys, [0 if not i else share(keys[i - 1], k) for i, k in enumerate(keys)]))
        order, common = suffix_dedup.merge_runs(runs)
        merged = [runs[r][0][i] for r, i in order]
        assert merged == sorted(k for keys, _ in runs for k in keys)
        assert common == [0 if not i else share(merged[i - 1], k) for i, k in enumerate(merged)]


def test_contamination(spark, docs):
    texts = {d: t for d, t, *_ in rows()}
    items = [("b", " ".join(words(texts[0])[20:60])), ("a", "Two WORDS"), ("short", "one"), ("none", " . "), ("null", None), ("a", "of the river"), (None, "stone")]
    pattern = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"
    grams = {}
    for name, text in items:
        w = words(text, pattern)
        for i in range(max(1, len(w) - 12)):
            if w:
                grams.setdefault(tuple(w[i : i + 13]), set()).add(name or "")
    want = []
    for d, t, *_ in rows():
        w, hit, found = words(t, pattern), set(), set()
        for n in {len(x) for x in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id string, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for block in (10_000, 30):  # one automaton, and several in a chain
        assert keyed(decontaminate.contamination(docs, bench, block_bytes=block).select(columns)) == sorted(want, key=repr)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[5] for w in want)
    long = spark.createDataFrame([(1, "keep " * 300 + "Two words, stay")], "doc_id int, text string")
    assert decontaminate.decontaminate(long, bench, cut=True).first()["text"] == "keep " * 300 + ", stay"
    assert not decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count()


def test_packing(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE[0])
    found = packing.pack(docs, *BPE, capacity=64).collect()
    ids = Counter()
    for d, t, *_ in rows():
        own = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(own) % 64 or 64, len(own) + 1, 64)] if len(own) > 64 else [0, len(own)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            ids[d, i, a, b - a, zlib.crc32(np.array(own[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == ids
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        ends = list(itertools.accumulate(n for _, n in sorted(parts)))
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 64
    sizes = [r.length for r in found]
    bounds = []  # no packing is below these: large pieces need sequences of their own, the rest fills them up
    for k in range(33):
        large, middle, small = [s for s in sizes if s > 64 - k], [s for s in sizes if 32 < s <= 64 - k], [s for s in sizes if k <= s <= 32]
        bounds.append(len(large) + len(middle) + max(0, math.ceil((sum(small) - (64 * len(middle) - sum(middle))) / 64)))
    assert max(bounds) <= len(sequences) <= max(bounds) + 1


def test_bin_completion_is_optimal_on_small_sets():
    def fewest(items, room):
        best = len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= room:
                    go(i + 1, [b + items[i] * (j == k) for j, b in enumerate(bins)])
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best

    rng = random.Random(3)
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(9)), reverse=True)
        plan = packing.complete(dict(Counter(items)), 24)
        assert sum(n for _, n in plan) == fewest(items, 24)
        assert Counter(s for f, n in plan for s in f * n) == Counter(items) and all(sum(f) <= 24 for f, _ in plan)


def test_token_counts_at_all_prefixes(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = token_counts.token_counts(docs, PIECES, limit=40, store=True)
    want = sorted(((d, len((t or "").encode()), len(model.encode(t or ""))) for d, t, *_ in rows()), key=repr)
    assert keyed(found.select("doc_id", "n_bytes", "n_tokens")) == want
    counter = token_counts.PrefixCounter(PIECES)
    for text in (" a  b \n\n c▁d", "naïve\t日本 x1\r\n", " ", "\n", "▁"):
        table = counter.table(text)
        counts = [len(model.encode(text[:i])) for i in range(len(text) + 1)]
        assert [counter.within(text, table, i) for i in range(len(text) + 1)] == counts
        for budget in range(1, counts[-1] + 1):
            assert counter.cut(text, table, budget) == max(i for i, n in enumerate(counts) if n <= budget)


def test_token_counts_of_a_long_segment(spark):
    """Every prefix from one pass: no part longer than two pieces is encoded or kept as a key."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = "".join(random.Random(3).choices("abcdefghijklmnopqrstuvwxyzABC0123456789+/日本\U0001f600", k=3000))
    counter, encoded = token_counts.PrefixCounter(PIECES), []
    make = counter.fits.make
    counter.fits.make = lambda pair: encoded.append(len("".join(pair))) or make(pair)
    table = counter.table(text)
    assert len(table) == len(text) + 1 and max(encoded) <= 32
    assert all(len(k) <= token_counts.REMEMBERED_CHARS for k in counter.segments)
    assert all(table[i] == len(model.encode(text[:i])) for i in [*range(60), *range(60, 3000, 97), 3000])
    found = token_counts.token_counts(spark.createDataFrame([(1, text)], "doc_id int, text string"), PIECES, limit=500, store=True).head()
    assert found.n_tokens == table[-1] and found.cut_chars == max(i for i, n in enumerate(table) if n <= 500)
    assert [(p.end, p.tokens) for p in found.prefixes] == [(i, n) for i, n in enumerate(table.tolist())][1:]


def test_quality_statistics_and_forest(spark, docs):
    found = {r.doc_id: r for r in quality.quality_verdicts(docs, spark.createDataFrame([], "doc_id bigint, quality int")).collect()}
    for d, t, *_ in rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams, covered = Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            covered |= {i, i + 1, i + 2} if grams[tuple(w[i : i + 3])] > 1 else set()
        r = found[d]
        want = (len(w), sum(map(len, w)), sum((t or "").count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and r.kept == (not r.base_failed)
    rng = random.Random(4)
    many = [(i, prose(rng, 90, [f"w{j}" for j in range(500)]) if i % 9 else " ".join(f"w{rng.randint(0, 400)}###" for _ in range(90)), int(i % 9 > 0)) for i in range(900)]
    table = spark.createDataFrame(many, "doc_id bigint, text string, quality int")
    kept = {r.doc_id: r.kept for r in quality.quality_verdicts(table.drop("quality"), table.drop("text")).collect()}
    held = [(kept[d], q) for d, _, q in many if zlib.crc32(str(d).encode()) % 5 == 0]
    assert not any(k for k, q in held if not q) and sum(k for k, q in held if q) > 0.95 * sum(q for _, q in held)


def labelled(spark):
    rng = random.Random(5)
    words = {"en": ["the", "river", "walks", "slowly", "through", "night"], "de": ["der", "fluss", "geht", "langsam", "durch", "nacht"]}
    data = []
    for i in range(600):
        lang = "en" if i % 3 else "de"
        text = [rng.choice(words[lang]) + rng.choice(["", "", "s", "en"]) for _ in range(40)]
        toxic = int(i % 7 == 0)
        for _ in range(3 * toxic):
            text.insert(rng.randint(0, len(text)), rng.choice(["blockhead", "nitwits"]))
        data.append((i, " ".join(text), lang, toxic))
    return spark.createDataFrame([*data, (9001, None, None, None), (9002, "12 .", "en", None)], "doc_id bigint, text string, lang string, toxic int")


def test_languages(spark):
    table = labelled(spark)
    found = {r.doc_id: r for r in language_crf.languages(table).collect()}
    truth = {r.doc_id: r.lang for r in table.collect()}
    held = [d for d, r in found.items() if r.held_out and d < 9000]
    assert len(found) == 602 and sum(found[d].lang_pred == truth[d] for d in held) > 0.97 * len(held)
    assert (found[9001].lang_pred, found[9002].lang_pred) == ("und", "und") and all(0 <= r.score <= 1 for r in found.values())
    assert all(r.lang_pred == "und" for r in language_crf.languages(table.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect())
    assert language_crf.languages(table.limit(0)).count() == 0


def test_language_of_long_repeated_and_rare_texts(spark):
    rng = random.Random(8)
    words_of = {"en": ["the", "of", "and", "river", "stone"], "de": ["und", "der", "Fluß", "Stein", "nicht"], "ja": ["日本", "語です", "川と", "石"]}
    text = lambda lang, n: " ".join(rng.choice(words_of[lang]) for _ in range(n))
    rows = [(i, text("en" if i % 2 else "de", 30), "en" if i % 2 else "de", "x", 1.0) for i in range(3000)]
    rows += [(4000 + i, text("ja", 3000), "ja", "x", 1.0) for i in range(12)]  # rare, and all above the sample's length
    rows += [rows[5], rows[5], (5, "der Fluß und der Stein nicht", "de", "x", 1.0), (6000, "12 ?! ²", "en", "x", 1.0), (None, "the river", None, None, None), (6001, "Und-der/Fluß", None, "x", 1.0)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string, score double").repartition(4)
    found = language_crf.languages(table).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert all(r.lang_pred == "ja" for d in range(4000, 4012) for r in by_id[d])
    assert sorted(r.lang_pred for r in by_id[5]) == ["de", "en", "en", "en"] and len({r.score for r in by_id[5] if r.lang_pred == "en"}) == 1
    assert by_id[6000][0].lang_pred == "und" and by_id[None][0].lang_pred == "en" and by_id[6001][0].lang_pred == "de"


def test_features_of_words_at_once():
    words = ["a", "Straße", "日本語", "x-y1z", "of"]
    flat, owner = language_crf.features(words, language_crf.word_hashes(["of", "xyz"]))
    for i, word in enumerate(words):
        alone, _ = language_crf.features([word], language_crf.word_hashes(["of", "xyz"]))
        letters = language_crf.inner(word)
        assert sorted(flat[owner == i]) == sorted(alone)
        assert len(alone) == 1 + 2 * min(4, len(letters)) + (len(letters) + 1) + len(letters)
    other, _ = language_crf.features(["of"], language_crf.word_hashes([]))
    same, _ = language_crf.features(["of"], language_crf.word_hashes(["of"]))
    assert (other != same).sum() == 1


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    step = rng.random((3, 3)) + 0.1
    step /= step.sum(1, keepdims=True)
    for lengths in ([1, 4, 2], [5]):
        potential = rng.random((sum(lengths), 3)) + 0.05
        found, at = language_crf.forward_backward(potential, np.array(lengths), step), 0
        for n in lengths:
            want = np.zeros((n, 3))
            for path in itertools.product(range(3), repeat=n):
                weight = (np.full(3, 1 / 3) @ step)[path[0]] * np.prod([potential[at + i, s] for i, s in enumerate(path)]) * np.prod([step[a, b] for a, b in zip(path, path[1:])])
                for i, s in enumerate(path):
                    want[i, s] += weight
            assert np.allclose(found[at : at + n], want / want.sum(1, keepdims=True))
            at += n
    blocks = language_crf.BLOCK
    potential = rng.random((500, 3)) + 0.05
    try:
        whole = language_crf.forward_backward(potential, np.array([300, 200]), step)
        language_crf.BLOCK = 7
        assert np.allclose(whole, language_crf.forward_backward(potential, np.array([300, 200]), step))
    finally:
        language_crf.BLOCK = blocks


def test_toxicity(spark):
    table = labelled(spark).withColumnRenamed("toxic", "label")
    labels = table.selectExpr("doc_id", "label AS toxic").where("toxic IS NOT NULL")
    found = {r.doc_id: r for r in toxicity.toxicity_scores(table, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [d for d, r in found.items() if r.held_out and d < 9000]
    assert len(found) == 602 and sum(found[d].predicted == truth[d] for d in held) > 0.95 * len(held)
    assert toxicity.without_toxic(table, labels).columns == table.columns
    assert not any(r.predicted for r in toxicity.toxicity_scores(table, labels.limit(0)).collect())


def test_toxicity_of_long_repeated_and_no_texts(spark):
    table = labelled(spark).selectExpr("doc_id", "text", "toxic AS label", "'x' AS score", "1 AS predicted")
    labels = table.selectExpr("doc_id", "label AS toxic").where("toxic IS NOT NULL")
    marked = [r.text for r in table.where("label = 1").limit(1).collect()][0]
    odd = [(8001, marked * 400), (8002, None), (8003, marked), (8003, marked), (None, marked)]
    more = table.union(spark.createDataFrame([(d, t, None, "x", 1) for d, t in odd], table.schema))
    found = toxicity.toxicity_scores(more, labels.union(labels.limit(5)), carry=["score"]).collect()
    assert len(found) == more.count() and len({r.score for r in found if r.doc_id == 8003}) == 1
    by_id = {r.doc_id: r for r in found}
    assert by_id[8001].predicted == by_id[8003].predicted == by_id[None].predicted == 1 and by_id[8002].predicted == 0
    assert by_id[8001].carried["score"] == "x"
    assert toxicity.toxicity_scores(table.limit(0), labels).count() == 0


def test_operators_on_no_documents(spark, docs):
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.quality_verdicts(docs.limit(0), labels).count() == 0


def test_sharding(spark, docs):
    names = lambda n: spark.createDataFrame([(f"s{i}",) for i in range(n)] + [(None,), ("s0",)], "shard string")
    tables = {n: {r.slot: r.shard for r in sharding.lookup_table(names(n), slots=211).collect()} for n in (5, 6)}
    owner, tried = {}, [0] * 5
    number = lambda s, p: int(hashlib.md5(s.encode()).hexdigest()[12 * p : 12 * p + 12], 16)
    while len(owner) < 211:
        for i in range(5):
            while len(owner) < 211:
                slot = (number(f"s{i}", 0) % 211 + tried[i] * (number(f"s{i}", 1) % 210 + 1)) % 211
                tried[i] += 1
                if slot not in owner:
                    owner[slot] = f"s{i}"
                    break
    assert tables[5] == owner
    assert {n for n in Counter(tables[5].values()).values()} <= {42, 43}
    moved = sum(tables[5][s] != tables[6][s] and tables[6][s] != "s5" for s in tables[5])
    assert moved < 0.3 * 211
    placed = sharding.assign(docs, sharding.lookup_table(names(5), slots=211), slots=211).collect()
    assert len(placed) == len(rows()) and all(r.shard == owner[number("" if r.doc_id is None else str(r.doc_id), 0) % 211] for r in placed)
    assert sharding.lookup_table(names(1).limit(0), slots=211).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(names(2), slots=100)


def test_chats(spark):
    talk = lambda c, n, *own: [(c, i, "user" if i % 2 == 0 else "assistant", own[i] if i < len(own) else f"t{i}", "x") for i in range(n)]
    data = talk(1, 2) + talk(2, 5) + talk(3, 5) + talk(4, 3, "other") + talk(5, 300) + talk(6, 4, None, "<|im_end|>") + talk(7, 1)[:1] * 3
    data += [(None, 0, "user", "lost", "x"), (8, None, None, None, "x"), (8, 1, "user", "b", "x"), (8, 1, "user", "a", "x")]
    df = spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string, place string")
    found = {(r.conv_id, r.segment): r for r in chat.format_chats(df).collect()}
    assert sorted(found) == [(4, 0), (5, 0), (5, 1), (6, 0), (8, 0)]
    assert (found[5, 0].n_turns, found[5, 1].n_turns, found[5, 1].first_place, found[5, 1].total_turns) == (256, 44, 257, 300)
    assert found[8, 0].rendered == "<|im_start|>\n<|im_end|>\n<|im_start|>user\na<|im_end|>\n<|im_start|>user\nb<|im_end|>\n"
    assert "<| im_end|>" in found[6, 0].rendered
    assert chat.format_chats(df.limit(0)).count() == 0


def test_empty_tables(docs):
    none = docs.limit(0)
    for out in (near_dedup.near_duplicates(none), suffix_dedup.repeated_spans(none), packing.pack(none, *BPE), token_counts.token_counts(none, PIECES)):
        assert out.count() == 0
