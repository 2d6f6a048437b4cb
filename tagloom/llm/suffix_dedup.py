"""Suffix-array dedup: a distributed merge sort of front-coded suffix runs, combined by loser trees over known prefixes.

A byte goes if a string of 50 bytes that covers it also starts in a document with a smaller id. To sort every suffix
would move many times the input, so suffixes are sampled by content: each window of 50 bytes names one of its
26-byte grams, the one with the smallest hash, as its anchor. Equal windows name equal anchors, so

1. groups of documents exchange the hashes of their anchors, and learn which occur in documents of two ids or more;
2. each group sorts the suffixes at those anchors (50 bytes, with the 24 bytes before) into runs. Equal contexts of
   one run are folded to the smallest id; the others are decided on the spot. Runs are front-coded: the length of
   the prefix shared with the suffix before, and the rest;
3. runs meet by anchor. A loser tree merges them and keeps for each head the prefix it shares with the last suffix
   given out, so known prefixes are never compared again, and the merged order has its common-prefix lengths;
4. these lengths and the bytes before the anchors tell for each window the smallest id that has it. What is to go
   returns to the documents.

Contexts are compared byte by byte up to the 50 bytes; the bytes before an anchor by a 64-bit hash of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import group_count, prefix_sums, release, span_hashes, steps

SPAN, GRAM = 50, 26
#: Bytes of text in a group, and in one vectorised step.
GROUP_BYTES, STEP_BYTES = 10_000_000, 1_000_000
BEFORE = SPAN - GRAM
_SHIFT = np.uint64(16)
RUN = "bucket int, g int, lcp binary, rest binary, left binary, span binary, ids binary, place binary, done binary"


def pack(values: np.ndarray) -> bytes:
    """Values byte by byte, all lowest bytes first, compressed."""
    import zstandard

    flat = np.ascontiguousarray(values)
    planes = flat.view(np.uint8).reshape(len(flat), -1).T.tobytes() if len(flat) else b""
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, dtype: type, shape: tuple[int, ...] = (-1,)) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    values = np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)
    return values.reshape(shape) if len(shape) > 1 else values


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Place and gram hash of each anchor, and the least and largest distance of its windows' starts before it."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    if n < SPAN:
        return empty, np.zeros(0, np.uint64), empty, empty
    at = np.arange(n - GRAM + 1)
    grams = span_hashes(prefix_sums(data), at, at + GRAM)
    low = grams & ~np.uint64(31)  # the low bits hold the distance to the smallest gram, the first of equal ones
    for shift in (1, 2, 4, 8, BEFORE + 1 - 16):
        low = np.minimum(low[:-shift], low[shift:] + np.uint64(shift))
    long = np.diff(offsets) >= SPAN
    edge = np.zeros(n + 1, np.int32)
    edge[offsets[:-1][long]] += 1
    edge[offsets[1:][long] - SPAN + 1] -= 1
    start = np.flatnonzero(np.cumsum(edge)[: len(low)])
    place = start + (low[start] & np.uint64(31)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else empty
    last = np.concatenate([first[1:], [len(place)]])[: len(first)] - 1
    return place[first], grams[place[first]], place[first] - start[last], place[first] - start[first]


class Group:
    """The distinct (id, text) of a group in a fixed order, as one buffer; rows without an id take no part."""

    def __init__(self, table: pa.Table):
        release()
        ids = table.column("id").to_pylist()
        texts = [t or b"" for t in table.column("text").cast(pa.large_binary()).to_pylist()]
        self.rows, self.texts = ids, texts
        keys = sorted({(i, t) for i, t in zip(ids, texts) if i is not None})
        number = {k: n for n, k in enumerate(keys)}
        self.order = [number.get((i, t), -1) for i, t in zip(ids, texts)]
        self.ids = np.array([i for i, _ in keys], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in keys], dtype=np.int64)])
        self.data = np.frombuffer(b"".join(t for _, t in keys), np.uint8)

    def steps(self):
        """(first document, buffer, offsets) of consecutive parts."""
        for low, high in steps(self.offsets, STEP_BYTES):
            a, b = self.offsets[low], self.offsets[high]
            yield low, self.data[a:b], self.offsets[low : high + 1] - a


def _prints(buckets: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        group = Group(table)
        hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for first, data, offsets in group.steps():
            place, grams, _, _ = anchors(data, offsets)
            hashes.append(grams >> _SHIFT)
            owners.append(group.ids[first + np.searchsorted(offsets, place, "right") - 1])
        key, owner = np.concatenate(hashes), np.concatenate(owners)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        end = np.concatenate([new[1:], [len(key)]])[: len(new)] - 1
        several = owner[new] != owner[end]
        key = key[new]
        bucket = ((key >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        deltas = lambda x: pack(np.diff(x, prepend=np.uint64(0)))
        parts = [(b, key[i:j], several[i:j]) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
        g = table.column("g")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in parts], pa.int32()), "g": pa.array([g] * len(parts), pa.int32()),
                "single": pa.array([deltas(k[~s]) for _, k, s in parts], pa.binary()), "several": pa.array([deltas(k[s]) for _, k, s in parts], pa.binary()),
            }
        )

    return run


def _shared(table: pa.Table) -> pa.Table:
    """For each group the anchors of this bucket that occur in documents of two ids or more, somewhere."""
    g = table.column("g").to_pylist()
    load = lambda c: [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in table.column(c).to_pylist()]
    single, several = load("single"), load("several")
    keys = np.sort(np.concatenate([*single, *several]))
    twice = np.union1d(keys[1:][keys[1:] == keys[:-1]], np.concatenate(several)) if len(keys) else keys
    found = [np.intersect1d(np.union1d(a, b), twice, assume_unique=True) for a, b in zip(single, several)]
    return pa.table({"g": pa.array(g, pa.int32()), "shared": pa.array([pack(np.diff(x, prepend=np.uint64(0))) for x in found], pa.binary())})


def _big_endian(rows: np.ndarray) -> list[np.ndarray]:
    """Columns of 8 bytes each, as numbers that compare like the bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return list(wide.view(">u8").T.astype(np.uint64))


def _runs(buckets: int) -> Callable:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        out = {name: [] for name in ("bucket", "g", "lcp", "rest", "left", "span", "ids", "place", "done")}
        types = [pa.int32(), pa.int32(), *[pa.binary()] * 7]
        if not docs.num_rows:
            return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})
        group, g = Group(docs), docs.column("g")[0].as_py()
        shared = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in answers.column("shared").to_pylist()]
        shared = np.sort(np.concatenate([np.zeros(0, np.uint64), *shared]))
        parts = []
        for first, data, offsets in group.steps():
            place, grams, least, most = anchors(data, offsets)
            at = np.minimum(np.searchsorted(shared, grams >> _SHIFT), max(0, len(shared) - 1))
            keep = shared[at] == grams >> _SHIFT if len(shared) else np.zeros(len(place), bool)
            place, grams, least, most = place[keep], grams[keep], least[keep], most[keep]
            if not len(place):
                continue
            padded = np.concatenate([np.zeros(BEFORE, np.uint8), data, np.zeros(SPAN, np.uint8)])
            context = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + SPAN)[place]
            left, right = context[:, :BEFORE].copy(), context[:, BEFORE:].copy()
            column = np.arange(BEFORE)
            left[column < (BEFORE - most)[:, None]] = 0  # bytes that no window of this anchor has
            right[np.arange(SPAN) >= (SPAN - least)[:, None]] = 0
            doc = np.searchsorted(offsets, place, "right") - 1
            parts.append((left, right, least.astype(np.uint8), most.astype(np.uint8), group.ids[first + doc], (first + doc).astype(np.uint32), (place - offsets[doc]).astype(np.uint32), grams))
        if not parts:
            return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})
        left, right, least, most, ids, doc, place, grams = (np.concatenate(x) for x in zip(*parts))
        bucket = ((grams >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((ids, most, least, *reversed(_big_endian(left)), *reversed(_big_endian(right)), bucket))
        left, right, least, most, ids, doc, place, bucket = (x[order] for x in (left, right, least, most, ids, doc, place, bucket))
        same = np.zeros(len(ids), bool)
        same[1:] = (right[1:] == right[:-1]).all(1) & (left[1:] == left[:-1]).all(1) & (least[1:] == least[:-1]) & (most[1:] == most[:-1])
        heads = np.flatnonzero(~same)
        smallest = np.repeat(ids[heads], np.diff(np.append(heads, len(ids))))
        decided = ids > smallest
        full = ((np.uint32(2) << most.astype(np.uint32)) - (np.uint32(1) << least.astype(np.uint32))).astype(np.uint32)
        done = np.stack([doc[decided], place[decided], full[decided]], 1)
        out["bucket"].append(g % buckets)
        out["g"].append(g)
        out["done"].append(pack(done.ravel()))
        for name in ("lcp", "rest", "left", "span", "ids", "place"):
            out[name].append(None)
        left, right, least, most, ids, doc, place, bucket = (x[~decided] for x in (left, right, least, most, ids, doc, place, bucket))
        common = np.zeros(len(ids), np.uint8)
        if len(ids) > 1:
            differ = right[1:] != right[:-1]
            common[1:] = np.where(differ.any(1), differ.argmax(1), SPAN)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for b, (i, j) in enumerate(zip(cuts, cuts[1:])):
            if j > i:
                lcp = common[i:j].copy()
                lcp[0] = 0
                out["bucket"].append(b)
                out["g"].append(g)
                out["lcp"].append(pack(lcp))
                out["rest"].append(pack(right[i:j][np.arange(SPAN) >= lcp[:, None]]))
                out["left"].append(pack(left[i:j].ravel()))
                out["span"].append(pack(np.concatenate([least[i:j], most[i:j]])))
                out["ids"].append(pack(ids[i:j]))
                out["place"].append(pack(np.concatenate([doc[i:j], place[i:j]])))
                out["done"].append(None)
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})

    return run


def decode_run(lcp: np.ndarray, rest: bytes) -> list[bytes]:
    """Suffixes of a front-coded run."""
    keys, before, at = [], b"", 0
    for shared in lcp.tolist():
        before = before[:shared] + rest[at : at + SPAN - shared]
        at += SPAN - shared
        keys.append(before)
    return keys


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merges sorted runs (keys, common prefix with the key before): (run, place) in order, and common-prefix lengths.

    A loser tree. Each head knows the prefix it shares with the key last given out: the one that shares more comes
    first, and only of two that share equally much are bytes compared, from there on. Equal keys come in any order.
    """
    width = 1
    while width < max(1, len(runs)):
        width *= 2
    heads = [keys[0] if keys else b"" for keys, _ in runs] + [b""] * (width - len(runs))
    shares = [0 if keys else -1 for keys, _ in runs] + [-1] * (width - len(runs))
    at, sizes = [0] * len(runs), [len(keys) for keys, _ in runs]

    def play(a: int, b: int) -> tuple[int, int]:
        """(first, second) of two heads; the second's share is then with the first."""
        x, y = shares[a], shares[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        p, q = heads[a], heads[b]
        if p[x:] == q[x:]:
            shares[b] = SPAN
            return a, b
        while p[x] == q[x]:
            x += 1
        if p[x] < q[x]:
            shares[b] = x
            return a, b
        shares[a] = x
        return b, a

    losers = [0] * width
    winners = list(range(width))
    level = width
    while level > 1:
        level //= 2
        after = []
        for i in range(level):
            first, second = play(winners[2 * i], winners[2 * i + 1])
            losers[level + i] = second
            after.append(first)
        winners = after
    best = winners[0]
    order: list[tuple[int, int]] = []
    common: list[int] = []
    while shares[best] >= 0:
        order.append((best, at[best]))
        common.append(shares[best])
        at[best] += 1
        if at[best] < sizes[best]:
            keys, lcp = runs[best]
            heads[best], shares[best] = keys[at[best]], lcp[at[best]]
        else:
            shares[best] = -1
        node = (best + width) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2
    return order, common


def _windows(common: np.ndarray, left: np.ndarray, least: np.ndarray, most: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each anchor the distances (as bits) of the windows before it that start in a document of a smaller id."""
    found = np.zeros(len(ids), np.uint32)
    before = np.zeros(len(ids), np.uint64)
    for r in range(BEFORE + 1):
        if r:
            before = (before + left[:, BEFORE - r].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
            before ^= before >> np.uint64(29)
        part = np.cumsum(common < SPAN - r)
        rows = np.flatnonzero((least <= r) & (r <= most) & (np.bincount(part)[part] > 1))
        if not len(rows):
            continue
        rows = rows[np.lexsort((before[rows], part[rows]))]
        new = np.ones(len(rows), bool)
        new[1:] = (part[rows][1:] != part[rows][:-1]) | (before[rows][1:] != before[rows][:-1])
        heads = np.flatnonzero(new)
        smallest = np.repeat(np.minimum.reduceat(ids[rows], heads), np.diff(np.append(heads, len(rows))))
        found[rows[ids[rows] > smallest]] |= np.uint32(1 << r)
    return found


def _merge(table: pa.Table) -> pa.Table:
    release()
    out_g, out_done = [], []
    runs, lefts, spans, ids, places, groups = [], [], [], [], [], []
    for row in table.to_pylist():
        if row["done"] is not None:
            out_g.append(row["g"])
            out_done.append(row["done"])
            continue
        lcp = unpack(row["lcp"], np.uint8)
        runs.append((decode_run(lcp, unpack(row["rest"], np.uint8).tobytes()), lcp.tolist()))
        lefts.append(unpack(row["left"], np.uint8).reshape(-1, BEFORE))
        spans.append(unpack(row["span"], np.uint8).reshape(2, -1).T)
        ids.append(unpack(row["ids"], np.int64))
        places.append(unpack(row["place"], np.uint32).reshape(2, -1).T)
        groups.append(np.full(len(lcp), row["g"], np.int64))
    if runs:
        order, common = merge_runs(runs)
        starts = np.concatenate([[0], np.cumsum([len(k) for k, _ in runs])])
        at = np.array([starts[r] + i for r, i in order], np.int64)
        left, span, owner, place, g = (np.concatenate(x)[at] for x in (lefts, spans, ids, places, groups))
        found = _windows(np.array(common), left, span[:, 0], span[:, 1], owner)
        hit = found > 0
        for x in np.unique(g[hit]):
            own = hit & (g == x)
            out_g.append(int(x))
            out_done.append(pack(np.concatenate([place[own], found[own][:, None]], 1).astype(np.uint32).ravel()))
    return pa.table({"g": pa.array(out_g, pa.int32()), "done": pa.array(out_done, pa.binary())})


def _remove(texts: bool) -> Callable:
    return lambda docs, answers: _removed(docs, answers, texts)


def _removed(docs: pa.Table, answers: pa.Table, texts: bool) -> pa.Table:
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    rows: list[tuple] = []
    if docs.num_rows:
        group = Group(docs)
        starts = np.zeros(len(group.data) + 1, bool)
        for done in answers.column("done").to_pylist():
            doc, place, found = unpack(done, np.uint32).reshape(-1, 3).T
            at = group.offsets[doc] + place
            for r in range(BEFORE + 1):
                starts[at[(found >> np.uint32(r)) & 1 == 1] - r] = True
        total = np.zeros(len(starts), np.uint32)
        np.cumsum(starts[:-1], out=total[1:])
        gone = total[1:] > total[np.maximum(np.arange(len(group.data)) - SPAN + 1, 0)]
        results: dict[int, tuple] = {}
        for row, text in zip(group.order, group.texts):
            if row not in results or row < 0:
                a, b = (group.offsets[row], group.offsets[row + 1]) if row >= 0 else (0, 0)
                flags = gone[a:b] if row >= 0 else np.zeros(len(text), bool)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
                kept = np.frombuffer(text, np.uint8)[~flags].tobytes()
                spans = [{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2])]
                shown = (kept.decode("utf-8", "ignore"), spans) if texts else (None, None)
                results[row] = (len(text), int(flags.sum()), len(spans), hashlib.sha256(kept).hexdigest(), *shown)
            rows.append(results[row])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), spans_type]
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "spans"]
    columns = {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds))}
    return pa.table({"id": docs.column("id"), "carried": docs.column("carried"), **columns})


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = (), texts: bool = True) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256, kept_text, spans (bytes), carried.

    `kept_text` is what remains, without characters that were cut apart; it and `spans` are null without `texts`. Null is the empty text. Rows of one id are
    documents that do not count against each other; equal rows get equal results. A row without an id is neither
    smaller nor larger than any, so it stays whole. Ids are whole numbers, or text that casts to one. Texts below 50
    bytes stay whole. Columns named in `carry` come
    along in the struct `carried`.
    """
    groups = group_count(docs, text_col, GROUP_BYTES)
    keyed = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carried")
    )
    keyed = keyed.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    prints = keyed.groupBy("g").applyInArrow(_prints(groups), "bucket int, g int, single binary, several binary")
    shared = prints.groupBy("bucket").applyInArrow(_shared, "g int, shared binary")
    runs = keyed.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_runs(groups), RUN)
    done = runs.groupBy("bucket").applyInArrow(_merge, "g int, done binary")
    schema = keyed.select("id", "carried").schema
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    schema = schema.add("kept_sha256", "string").add("kept_text", "string").add("spans", docs.sparkSession.sql("SELECT CAST(array() AS array<struct<start: bigint, end: bigint>>) AS s").schema["s"].dataType)
    out = keyed.groupBy("g").cogroup(done.groupBy("g")).applyInArrow(_remove(texts), schema)
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with repeated bytes removed from the texts; same columns. A document that loses all its text goes."""
    found = repeated_spans(docs, id_col, text_col, carry=docs.columns).where("n_removed = 0 OR n_removed < n_bytes")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(f"carried.`{text_col}`"))
    return found.select(*[text.alias(c) if c == text_col else F.col(f"carried.`{c}`").alias(c) for c in docs.columns])
