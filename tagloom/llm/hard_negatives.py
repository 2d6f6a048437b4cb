"""Hard-negative mining by Kronecker-packed products.

Components are integers. Those of several candidates, biased so that none is negative, stand in separated fields of
one 64-bit integer, so a single multiplication by an anchor's component advances the inner products of all of them;
after the last component the fields are unpacked, and what bias and offset added is taken off: the scores are exact.
The width of a field follows from the values of a cell; where not even one field fits 64 bits, the wide integer is a
Python integer of any length.

Anchors meet all rows in cells, a block of anchors and a block of candidates each, so that a task holds two blocks
whatever the number of rows or the size of a label. Blocks are dealt by a hash of the id.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagloom.llm.common import settle, shuffle_partitions

SCALE = 256
#: Bytes of components (as longs) of a block of candidates; anchors have a quarter.
BLOCK_BYTES = 8_000_000
#: Rows that a block of candidates has at least, as far as there are so many.
LEAST_ROWS = 1024
#: Scores that are held at once.
STEP_SCORES = 4_000_000
#: Fields of a wide integer where 64 bits do not hold one.
WIDE_FIELDS = 16
_NONE = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where the vector or a component is null or not finite."""
    exact = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(exact, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(exact, lambda x: F.floor(x * scale)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of components; shorter vectors are filled up with zeros."""
    column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.int64()))
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), int(size.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out


class Packed:
    """Candidates' components in fields of wide integers, for anchors whose absolute components sum to `weight` at most."""

    def __init__(self, rows: np.ndarray, weight: int):
        self.n, dims = rows.shape
        low = int(rows.min(initial=0))
        #: |sum of anchor component x biased component| is at most this; added once, it keeps every field from borrowing
        self.offset = weight * (int(rows.max(initial=0)) - low)
        self.bias = -low
        self.width = (2 * self.offset + 1).bit_length()
        self.fields = 64 // self.width
        self.wide = not self.fields
        self.fields = self.fields or WIDE_FIELDS
        words = -(-self.n // self.fields)
        kind = object if self.wide else np.uint64
        padded = np.zeros((words * self.fields, dims), kind)
        padded[: self.n] = (rows.astype(object) + self.bias) if self.wide else (rows + self.bias).astype(np.uint64)
        self.words = np.zeros((dims, words), kind)
        self.start = 0 if self.wide else np.uint64(0)
        for f in range(self.fields):
            shift = f * self.width if self.wide else np.uint64(f * self.width)
            self.words += padded[f * words : (f + 1) * words].T << shift
            self.start += (self.offset if self.wide else np.uint64(self.offset)) << shift

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """(anchors, candidates); a score beyond a long is held at the end of its range."""
        total = (anchors.astype(object) if self.wide else anchors.astype(np.uint64)) @ self.words + self.start
        taken = [self.offset + self.bias * int(sum(map(int, a))) for a in anchors]  # what bias and offset have added
        if self.wide:
            mask = (1 << self.width) - 1
            parts = [(total >> (f * self.width)) & mask for f in range(self.fields)]
            out = np.concatenate(parts, 1)[:, : self.n] - np.array(taken, object)[:, None]
            return np.clip(out, -_MOST, _MOST).astype(np.int64)
        mask = np.uint64((1 << self.width) - 1) if self.width < 64 else np.uint64(_MOST * 2 + 1)
        parts = [(total >> np.uint64(f * self.width)) & mask for f in range(self.fields)]
        out = np.concatenate(parts, 1)[:, : self.n]
        # all in wrapping 64-bit arithmetic: the difference itself fits
        held = np.array([t % (1 << 64) for t in taken], np.uint64)
        return (out - held[:, None]).view(np.int64)


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the k highest of each row, `_NONE` left out; equal scores: the first column. Overwrites scores."""
    rows = np.arange(len(scores))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(1)
        value = scores[rows, at]
        some = value != _NONE
        if not some.any():
            break
        found.append((rows[some], at[some], value[some]))
        scores[rows, at] = _NONE
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _sides(anchors: pa.Table, rows: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]:
    """Anchors, candidates sorted by id, and their components in equally many columns."""
    rows = rows.take(pc.sort_indices(rows["id"]))
    a, c = _matrix(anchors["v"]), _matrix(rows["v"])
    dims = max(a.shape[1], c.shape[1])
    return anchors, rows, *(np.pad(x, ((0, 0), (0, dims - x.shape[1]))) for x in (a, c))


def _weight(a: np.ndarray) -> int:
    return max((sum(abs(int(x)) for x in row) for row in a), default=0)


def _codes(anchors: pa.Table, rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the values of a column on both sides, equal where the values are."""
    both = pa.concat_arrays([x for t in (anchors, rows) for x in t[name].chunks]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return both[: len(anchors)], both[len(anchors) :]


def _steps(n: int, width: int) -> list[slice]:
    size = max(1, STEP_SCORES // max(1, width))
    return [slice(i, min(n, i + size)) for i in range(0, n, size)]


def _nearest(k: int, kind: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A cell's best k rows of the same label for each anchor."""

    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[pa.Array, pa.Array, np.ndarray]] = []
        if len(anchors) and len(rows):
            anchors, rows, a, c = _sides(anchors, rows)
            a_id, c_id = _codes(anchors, rows, "id")
            a_label, c_label = _codes(anchors, rows, "label")
            for label in np.unique(a_label):
                mine, theirs = np.flatnonzero(a_label == label), np.flatnonzero(c_label == label)
                packed = Packed(c[theirs], _weight(a[mine]))
                for part in _steps(len(mine), len(theirs)) if len(theirs) else ():
                    scores = packed.scores(a[mine[part]])
                    scores[a_id[mine[part]][:, None] == c_id[theirs]] = _NONE
                    row, at, score = _best(scores, k)
                    out.append((anchors["id"].take(pa.array(mine[part][row])), rows["id"].take(pa.array(theirs[at])), score))
        return pa.table({
            "anchor_id": pa.chunked_array([c for x in out for c in x[0].chunks], kind), "positive_id": pa.chunked_array([c for x in out for c in x[1].chunks], kind),
            "positive_score": pa.chunked_array([pa.array(x[2], pa.int64()) for x in out], pa.int64()),
        })

    return cell


def _hardest(k: int, low: int, high: int, kind: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A cell's best k rows of another label for each anchor and positive, between `low` and `high` percent of its score."""

    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[pa.Array, pa.Array, np.ndarray, pa.Array, np.ndarray]] = []
        if len(anchors) and len(rows):
            anchors, rows, a, c = _sides(anchors, rows)
            a_label, c_label = _codes(anchors, rows, "label")
            packed = Packed(c, _weight(a))
            positives = anchors["positives"].to_pylist()
            for part in _steps(len(a), len(c)):
                scores = packed.scores(a[part])
                scores[a_label[part][:, None] == c_label] = _NONE
                for place in range(max(len(p) for p in positives[part])):
                    own = np.array([i for i, p in enumerate(positives[part]) if place < len(p)])
                    score = [positives[part][i][place]["positive_score"] for i in own]
                    least = np.array([-(-low * s // 100) for s in score])
                    most = np.array([high * s // 100 for s in score])
                    held = scores[own]
                    held[(held < least[:, None]) | (held > most[:, None])] = _NONE
                    row, at, value = _best(held, k)
                    out.append((
                        anchors["id"].take(pa.array(own[row] + part.start)), pa.array([positives[part][i][place]["positive_id"] for i in own[row]], kind),
                        np.array(score, np.int64)[row], rows["id"].take(pa.array(at)), value,
                    ))
        long = lambda i: pa.chunked_array([pa.array(x[i], pa.int64()) for x in out], pa.int64())
        return pa.table({
            "anchor_id": pa.chunked_array([c for x in out for c in x[0].chunks], kind), "positive_id": pa.chunked_array([x[1] for x in out], kind),
            "positive_score": long(2), "negative_id": pa.chunked_array([c for x in out for c in x[3].chunks], kind), "negative_score": long(4),
        })

    return cell


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows where `anchors` holds. The positives of an anchor are its best `positives` other rows of the
    same label; for each, the best `negatives` rows of another label whose score is `low` to `high` percent of the
    positive's. Scores are inner products of floor(scale * x); higher ones come first, ties by smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows of one id are one row,
    the least by label and vector. Shorter vectors count as filled up with zeros. Components and scores beyond a long
    are held at the ends of its range. An anchor without positives or without such negatives has no rows; so has an
    empty table. Other columns are ignored, so their names cannot clash.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    kept = kept.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    kept = kept.groupBy("id").agg(F.min(F.struct("label", "v", "anchor")).alias("r")).select("id", "r.*")
    kept = settle(kept, "vectors")
    size = kept.agg(F.count("*").alias("n"), F.count_if("anchor").alias("a"), F.max(F.size("v")).alias("dims")).first()
    most = max(1, BLOCK_BYTES // (8 * max(1, size["dims"] or 1)))
    row_blocks = max(1, -(-size["n"] // most), min(shuffle_partitions(spark), size["n"] // LEAST_ROWS))
    anchor_blocks = max(1, -(-size["a"] // max(1, most // 4)))
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = kept.select("id", "label", "v", block(row_blocks, 1).alias("c_block")).select("*", every(anchor_blocks).alias("a_block"))
    asked = kept.where("anchor").select("id", "label", "v", block(anchor_blocks, 2).alias("a_block"))
    kind = kept.schema["id"].dataType.simpleString()
    arrow = to_arrow_type(kept.schema["id"].dataType)

    def cells(left: DataFrame, function: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        left = left.select("*", every(row_blocks).alias("c_block"))
        return left.groupBy("a_block", "c_block").cogroup(candidates.groupBy("a_block", "c_block")).applyInArrow(function, schema)

    near = cells(asked, _nearest(positives, arrow), f"anchor_id {kind}, positive_id {kind}, positive_score bigint")
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")))
    near = near.where(F.col("rank") <= positives).groupBy(F.col("anchor_id").alias("id"))
    near = settle(asked.join(near.agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives")), "id"), "positives")
    hard = cells(near, _hardest(negatives, low, high, arrow), f"anchor_id {kind}, positive_id {kind}, positive_score bigint, negative_id {kind}, negative_score bigint")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
