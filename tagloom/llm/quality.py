"""Quality rules: an isolation forest on rule statistics, with a threshold from labelled rows.

The statistics of every whole text are counted on the bytes of an Arrow column. Trees of random splits are grown on a
bounded sample of labelled rows, a forest for each statistic, as a value that is odd in one statistic only would drown
among the splits of the others. A document whose path through a forest is short is anomalous there. Each forest's
threshold is set on labelled rows that it was not grown from; a forest that finds no bad rows has no say.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import SPACED, byte_class, held_out, mix, part, prefix_sums, ranges, span_hashes, steps, utf8, word_bounds

#: Labelled rows that the forest and its threshold are fitted on, at most.
SAMPLE = 8000
TREES, TREE_ROWS, DEPTH = 48, 64, 10
#: Share of good labelled rows that each forest's threshold must keep.
KEEP_GOOD = 0.999
#: A forest counts if it finds this share of the bad rows, and ten times the share that it finds of good ones.
USEFUL = 0.02
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_marks"]
_SYMBOL, _UPPER, _DIGIT = byte_class(b"#*$%&|<>"), byte_class(range(65, 91)), byte_class(range(48, 58))
_MARK = byte_class(b"!?\"'()[]{}=/\\@~^_+-:;")
_LINE = ~byte_class([10])


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: whether an equal (doc, key) stands earlier, and whether it occurs twice or more."""
    order = np.lexsort((key, doc))
    same = np.zeros(len(doc) + 1, bool)
    same[1:-1] = (doc[order][1:] == doc[order][:-1]) & (key[order][1:] == key[order][:-1])
    later, twice = np.empty(len(doc), bool), np.empty(len(doc), bool)
    later[order], twice[order] = same[:-1], same[:-1] | same[1:]
    return later, twice


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COUNTS of each text, as integers."""
    n = len(offsets) - 1
    starts, ends, first = word_bounds(data, offsets, SPACED)
    sums = prefix_sums(data)
    words = span_hashes(sums, starts, ends)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    inside = SPACED[data]
    later, _ = _repeats(doc, words)
    windows = np.maximum(n_words - 2, 0)
    at, window_doc = ranges(first[:-1], windows), np.repeat(np.arange(n), windows)
    covered = np.zeros(len(words), bool)
    if len(at):
        key = mix(mix(words[at] + np.uint64(1)) + words[at + 1] * np.uint64(0x9FB21C651E98DF25) + mix(words[at + 2]))
        twice = at[_repeats(window_doc, key)[1]]
        for j in range(3):
            covered[twice + j] = True
    l_starts, l_ends, l_first = word_bounds(data, offsets, _LINE)
    filled = np.concatenate([[0], np.cumsum(inside)])
    real = filled[l_ends] > filled[l_starts]
    l_doc = np.repeat(np.arange(n), np.diff(l_first))[real]
    again, _ = _repeats(l_doc, span_hashes(sums, l_starts[real], l_ends[real]))
    per_word = lambda flags: np.bincount(doc[flags], minlength=n)
    return np.stack(
        [
            n_words, _sums(inside & ((data & 0xC0) != 0x80), offsets), _sums(_SYMBOL[data], offsets), np.bincount(l_doc[again], minlength=n),
            per_word(covered), np.bincount(l_doc, minlength=n), per_word(~later), _sums(_UPPER[data], offsets), _sums(_DIGIT[data], offsets), _sums(_MARK[data], offsets),
        ],
        1,
    ).astype(np.int64)


def features(counts: np.ndarray) -> np.ndarray:
    """Rule statistics that do not grow with a text's length, and its length on a log scale."""
    x = dict(zip(COUNTS, counts.T.astype(float)))
    words, chars, lines = np.maximum(x["n_words"], 1), np.maximum(x["word_chars"], 1), np.maximum(x["n_lines"], 1)
    return np.stack(
        [
            np.log1p(x["n_words"]), x["word_chars"] / words, x["n_symbols"] / words, x["n_dup_lines"] / lines, x["n_repeat_words"] / words,
            x["n_distinct"] / words ** 0.8, x["n_upper"] / chars, x["n_digits"] / chars, x["n_marks"] / chars,
        ],
        1,
    )


@dataclass
class Forest:
    """Isolation trees as arrays: (tree, node) -> split feature (-1: leaf), split value, path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    length: np.ndarray
    rows: int

    @staticmethod
    def grow(x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, depth: int = DEPTH, seed: int = 3) -> Forest:
        rng = np.random.default_rng(seed)
        rows = max(2, min(rows, len(x)))
        shape = (trees, 2 ** (depth + 1) - 1)
        forest = Forest(np.full(shape, -1, np.int64), np.zeros(shape), np.zeros(shape), rows)
        for tree in range(trees):
            todo = [(0, 0, x[rng.choice(len(x), rows, replace=len(x) < rows)])]
            while todo:
                node, level, own = todo.pop()
                low, high = own.min(0), own.max(0)
                open_ = np.flatnonzero(high > low)
                if level == depth or len(own) < 2 or not len(open_):
                    forest.length[tree, node] = level + _average(len(own))
                    continue
                f = rng.choice(open_)
                v = rng.uniform(low[f], high[f])
                forest.feature[tree, node], forest.value[tree, node] = f, v
                left = own[:, f] <= v
                todo += [(2 * node + 1, level + 1, own[left]), (2 * node + 2, level + 1, own[~left])]
        return forest

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1): 2 ** -(mean path length / average path length); rows without a tree score 0.5."""
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for feature, value, length in zip(self.feature, self.value, self.length):
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1)) - 1):
                f = feature[node]
                node = np.where(f >= 0, 2 * node + 2 - (x[row, np.maximum(f, 0)] <= value[node]), node)
            total += length[node]
        return 2.0 ** (-total / max(1, len(self.feature)) / max(_average(self.rows), 1e-9))


def _average(n: int) -> float:
    """Average path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def calibrate(scores: np.ndarray, good: np.ndarray, keep_good: float = KEEP_GOOD) -> float:
    """The score at and above which rows go: over that of `keep_good` of the good rows, and halfway to the bad ones above."""
    kept = np.sort(scores[good])
    if not len(kept):
        return 1.0
    least = float(np.nextafter(kept[min(len(kept) - 1, int(np.ceil(keep_good * len(kept))) - 1)], 2))
    above = scores[~good & (scores >= least)]
    return (least + float(np.quantile(above, 0.05))) / 2 if len(above) else least


Model = list[tuple[int, Forest, float]]  # statistic, its forest, its threshold


def fit(x: np.ndarray, good: np.ndarray, keep_good: float = KEEP_GOOD) -> Model:
    """Forests with a say. Every third row sets thresholds, the others grow trees; without bad rows all have a say."""
    third = np.arange(len(x)) % 3 == 0
    model: Model = []
    if (~third).sum() < 2 or not (good & third).any():
        return model
    for k in range(x.shape[1]):
        forest = Forest.grow(x[~third][:, [k]])
        scores = forest.score(x[third][:, [k]])
        threshold = calibrate(scores, good[third], keep_good)
        bad, wrong = (scores[~good[third]] >= threshold), (scores[good[third]] >= threshold).mean()
        if not len(bad) or bad.mean() > max(USEFUL, 10 * wrong):
            model.append((k, forest, threshold))
    return model


def margin(model: Model, x: np.ndarray) -> np.ndarray:
    """The largest score among the forests, as a share of the forest's threshold; 1 and more is anomalous."""
    return np.max([forest.score(x[:, [k]]) / threshold for k, forest, threshold in model], axis=0) if model else np.zeros(len(x))


def _measure(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for low, high in steps(offsets):
                counts = statistics(*part(data, offsets, low, high))
                score = margin(model, features(counts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *map(pa.array, counts.T), pa.array(score)], names=["id", *COUNTS, "margin"])

    return run


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, keep_good: float = KEEP_GOOD) -> DataFrame:
    """One row per input row: id, COUNTS, base_failed, margin, kept.

    base_failed: fewer than 50 words, or over half of them in repeated three-word windows; such rows are not kept.
    Others are kept if no forest scores them at its threshold or above (margin < 1). Null and word-free texts have zero
    counts and so fail. At most `sample` labelled rows, the first by a hash of their id, are used. Without labelled
    good rows that pass the base rules every row that passes them is kept. Rows with equal ids get verdicts of their
    own. Other columns are ignored.
    """
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", margin double"
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("label").isNotNull() & ~held_out("id"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(sample)  # a bounded number of rows, so small enough to broadcast
    fitted = source.join(F.broadcast(chosen.select("id").distinct()), "id", "left_semi").mapInArrow(_measure([]), schema)
    rows = fitted.join(F.broadcast(chosen), "id").toPandas().drop_duplicates("id").sort_values("id")
    counts = rows[COUNTS].to_numpy(np.int64).reshape(-1, len(COUNTS))
    x, good = features(counts), rows["label"].to_numpy() == 1
    passed = (counts[:, 0] >= MIN_WORDS) & (100 * counts[:, 4] <= MAX_REPEAT_PERCENT * counts[:, 0])
    out = source.mapInArrow(_measure(fit(x[passed], good[passed], keep_good)), schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.select(
        F.col("id").alias(id_col), *COUNTS, failed.alias("base_failed"), "margin", (~failed & (F.col("margin") < 1)).alias("kept")
    )
