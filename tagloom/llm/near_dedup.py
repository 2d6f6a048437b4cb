"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, star contraction.

Per document the distinct five-word shingles give a SuperMinHash signature: every element draws the slots in a
random order, and its j-th draw has a rank in [j, j + 1). Levels are processed for all elements of a step at
once; a document stops as soon as each slot holds a rank below the next level, which no later draw can improve.

* Documents of equal sets are one class, so copies never meet in pairs.
* Bands of four slots: a link of 0.75 shares no band of 32 with probability 5e-6.
* A bucket is first a star around its smallest document. After components are known, only buckets that still
  hold several components compare members of different components, in blocks of bounded size, by signature.
* Every candidate is confirmed on the full shingle sets, recomputed from the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import LOWER, SPACED, mix, part, prefix_sums, ranges, release, settle, span_hashes, steps, utf8, word_bounds

WIDTH = 5
SLOTS, ROWS = 128, 4
BANDS = SLOTS // ROWS
#: Slots of the longer signature by which candidates are compared before their sets are. In a link of 0.75
#: 384 +- 9.8 of them agree; fewer than ALIKE_SLOTS is over five deviations off.
FINE_SLOTS, ALIKE_SLOTS = 512, 333
#: A step of the longer signature keeps a kilobyte for each shingle.
FINE_BYTES = 100_000
#: Members of a bucket that are compared with each other in one block.
BLOCK = 1024
_UNSET = np.uint64((1 << 64) - 1)

__all__ = ["LOWER", "components", "near_duplicates", "shingles", "signatures"]


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles, sorted; a text of fewer than five words has its whole sequence as one."""
    starts, ends, first = word_bounds(data, offsets, SPACED)
    words = span_hashes(prefix_sums(data, lower=True), starts, ends)
    n = np.diff(first)
    count = np.where(n >= WIDTH, n - WIDTH + 1, np.minimum(n, 1))
    doc, at = np.repeat(np.arange(len(n)), count), ranges(first[:-1], count)
    if not len(at):
        return doc, np.zeros(0, np.uint64)
    total, limit = np.zeros(len(at), np.uint64), first[doc + 1]
    for j in range(WIDTH):
        inside = at + j < limit
        total = total * np.uint64(0xA24BAED4963EE407) + np.where(inside, words[np.minimum(at + j, len(words) - 1)], 0)
    total = mix(total + np.minimum(n, WIDTH)[doc].astype(np.uint64))
    order = np.lexsort((total, doc))
    doc, total = doc[order], total[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (total[1:] != total[:-1])
    return doc[new], total[new]


def _draw(hashes: np.ndarray, level: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank (level in the high half, a random fraction in the low half) and the position that is swapped at this level."""
    x = mix(hashes + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    place = np.uint64(level) + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(slots - level)) >> np.uint64(32))
    return (np.uint64(level) << np.uint64(32)) | (x >> np.uint64(32)), place.astype(np.int64)


def signatures(doc: np.ndarray, hashes: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash of n documents; a document without elements keeps the largest value in every slot."""
    best = np.full(n * slots, _UNSET, np.uint64)
    rank, place = _draw(hashes, 0, slots)
    np.minimum.at(best, doc * slots + place, rank)
    order = None
    for level in range(1, slots):
        open_ = (best.reshape(n, slots).max(1) >= np.uint64(level << 32))[doc]
        if not open_.all():
            doc, hashes, place = doc[open_], hashes[open_], place[open_]
            order = order[open_] if order is not None else None
        if not len(doc):
            break
        row = np.arange(len(doc))
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(doc), 1))
            order[row, place] = 0
        rank, place = _draw(hashes, level, slots)
        slot = order[row, place].astype(np.int64)
        order[row, place] = order[:, level]
        np.minimum.at(best, doc * slots + slot, rank)
    return best.reshape(n, slots)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        release()
        data, offsets = utf8(batch.column(1))
        for low, high in steps(offsets):
            n = high - low
            doc, hashes = shingles(*part(data, offsets, low, high))
            count = np.bincount(doc, minlength=n)
            at = np.concatenate([[0], np.cumsum(count)])
            digest = []
            for seed in (1, 2):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes * np.uint64(2 * seed + 1) + np.uint64(seed)), dtype=np.uint64)])
                digest.append(pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)))
            best = signatures(doc, hashes, n)
            key = np.repeat(salt[None], n, 0)
            for j in range(ROWS):
                key = mix(key * np.uint64(0x9FB21C651E98DF25) + best[:, j::ROWS])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(key.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, n), pa.array(count.astype(np.int64)), *digest, bands, pa.array([r.tobytes() for r in key.astype(np.uint32)], pa.binary())],
                names=["id", "n_shingles", "hi", "lo", "bands", "marks"],
            )


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One byte of each slot of the longer signature."""
    for batch in batches:
        release()
        data, offsets = utf8(batch.column(1))
        for low, high in steps(offsets, FINE_BYTES):
            best = mix(signatures(*shingles(*part(data, offsets, low, high)), high - low, FINE_SLOTS)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([r.tobytes() for r in best], pa.binary())], names=["id", "sig"])


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, FINE_SLOTS) for i in (2, 3))
        yield batch.select([0, 1]).filter(pa.array((left == right).sum(1) >= ALIKE_SLOTS))


def _confirm(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            release()
            texts = [utf8(batch.column(i)) for i in (2, 3)]
            for low, high in steps(texts[0][1] + texts[1][1]):
                sides = [shingles(*part(*x, low, high)) for x in texts]
                n = high - low
                sizes = [np.bincount(d, minlength=n) for d, _ in sides]
                doc, key = (np.concatenate([s[i] for s in sides]) for i in (0, 1))
                order = np.lexsort((key, doc))
                doc, key = doc[order], key[order]
                both = np.bincount(doc[1:][(doc[1:] == doc[:-1]) & (key[1:] == key[:-1])], minlength=n)
                yield batch.select([0, 1]).slice(low, n).filter(pa.array((100 * both >= percent * (sizes[0] + sizes[1] - both)) & (both > 0)))

    return run


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alike pairs of different components in each block (key, i, j); rows come sorted by block.

    A pair that shares several buckets is taken in the one of their first common band.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, label, own = (table.column(c).to_numpy() for c in ("node", "label", "own"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, FINE_SLOTS)
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint32).reshape(-1, BANDS)
        band = int((marks[0] == np.uint32(table.column("key")[0].as_py() & 0xFFFFFFFF)).argmax())
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        values, count = np.unique(label, return_counts=True)
        most = values[count.argmax()]
        for x in np.flatnonzero(label != most):  # of two rows of the largest component there is nothing to ask
            # a pair of two smaller components is asked once, from its smaller node
            other = (label != label[x]) & ((label == most) | (node > node[x]))
            other = np.flatnonzero(other if same else other & (own != own[x]))
            other = other[(sig[other] == sig[x]).sum(1) >= ALIKE_SLOTS]
            other = other[(marks[other] == marks[x]).argmax(1) == band]
            if len(other):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[other], node[x])), pa.array(np.maximum(node[other], node[x]))], schema=schema)

    held: list[pa.Table] = []
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        keys = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
        for low, high in zip(cuts, cuts[1:]):
            if high == low:
                continue
            if held and tuple(keys[low]) != last:
                yield from pairs(pa.concat_tables(held))
                held = []
            held.append(table.slice(low, high - low))
            last = tuple(keys[low])
    if held:
        yield from pairs(pa.concat_tables(held))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge (a, b); component is the smallest node reachable.

    Alternating large-star and small-star contraction; each round is written to the shared folder.
    """
    def swapped(df: DataFrame) -> DataFrame:
        return df.union(df.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def state(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = state(now)
    while before[0]:
        both = swapped(now)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = settle(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |common shingles| >= percent * |all shingles| (percent of at least 75: the
    bands are set for that). Null, empty and word-free texts have no shingles, are linked with nothing and kept. A
    row without an id is linked with nothing and has a null component_id, but is kept. Rows of one id count as one
    document when links are followed. Ids are whole numbers, or text that casts to one. Other columns of `docs` are ignored, so their names cannot clash.
    """
    if percent < 75:
        raise ValueError("the bands are set for a similarity of 0.75 or more")
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = settle(source.mapInArrow(_sketch, "id bigint, n_shingles bigint, hi bigint, lo bigint, bands array<bigint>, marks binary"), "sketches")
    real = sketches.where("id IS NOT NULL AND n_shingles > 0")
    classes = settle(real.groupBy("hi", "lo").agg(F.min("id").alias("node")), "classes")
    firsts = real.join(classes.withColumnRenamed("node", "id"), ["hi", "lo", "id"], "left_semi")
    band = firsts.select(F.col("id").alias("node"), F.explode("bands").alias("key"))
    buckets = band.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).where("pivot < top")
    members = settle(band.join(buckets.select("key", "pivot"), "key"), "buckets")
    wanted = members.select(F.col("node").alias("id")).distinct()
    texts = settle(source.join(wanted, "id", "left_semi"), "texts")
    sigs = texts.mapInArrow(_fine, "id bigint, sig binary").join(firsts.select("id", "marks"), "id")
    sigs = settle(sigs, "signatures")

    def of(df: DataFrame, side: str, value: str) -> DataFrame:
        return df.select(F.col("id").alias(side), F.col(value).alias(f"{value}_{side}"))

    def both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        joined = pairs.join(of(table, "b", value), "b").join(of(table, "a", value), "a")
        return joined.select("a", "b", f"{value}_a", f"{value}_b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        return settle(both(pairs, texts, "text").mapInArrow(_confirm(percent), "a bigint, b bigint"), "links")

    star = members.where("node > pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    star = settle(both(star, sigs, "sig").mapInArrow(_alike, "a bigint, b bigint"), "stars")
    links = confirmed(star)
    labels = settle(components(links), "labels")

    labelled = members.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    open_ = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x < y")
    open_ = open_.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    rows = labelled.join(open_, "key").join(sigs.withColumnRenamed("id", "node"), "node")
    rows = rows.withColumn("own", F.pmod(F.hash("node"), "blocks")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "t").alias("i"), F.greatest("own", "t").alias("j"), "node", "label", "own", "sig", "marks")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    rest = rows.mapInArrow(_across, "a bigint, b bigint").distinct().join(star, ["a", "b"], "left_anti")
    more = confirmed(settle(rest, "rest"))
    if not more.isEmpty():
        labels = settle(components(links.union(more)), "labels")

    named = classes.join(labels, "node", "left").select("hi", "lo", F.coalesce("component", "node").alias("component"))
    linked = sketches.select("id", "n_shingles", "hi", "lo").join(named, ["hi", "lo"], "left")
    return _result(linked, id_col, F.when(F.col("n_shingles") > 0, F.least("component", "id")).otherwise(F.col("id")))


def _result(df: DataFrame, id_col: str, component: Column) -> DataFrame:
    component = F.when(F.col("id").isNotNull(), component)
    return df.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )
