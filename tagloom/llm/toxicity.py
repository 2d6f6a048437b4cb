"""Toxicity by compression distance: windows are compressed with a toxic and an ordinary zstandard dictionary.

Both dictionaries share a base that zstandard trains on ordinary windows. Behind it stands a tail of fragments: the
word beginnings that mark toxic training texts (by the likelihood ratio of their document counts) in one, as many
bytes of the commonest ordinary words in the other. A window that the toxic dictionary compresses better has such
fragments. How many windows do, and by how much, is calibrated on labelled rows that the dictionaries have not seen.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import held_out

#: Labelled rows of either class that the model is fitted on, at most; texts above the length are not among them.
SAMPLE, SAMPLE_CHARS = 1500, 40_000
WINDOW = 12
BASE_BYTES = 8192
FRAGMENTS, LEAST_G2, LEAST_DOCS = 64, 30.0, 5
LEVEL = 6


def windows(text: str | None) -> list[bytes]:
    """Windows of twelve lower-case words, with a blank at either end."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def _counts(texts: list[str]) -> Counter:
    """Texts that each word beginning stands in. A word between the same neighbours as before does not count again,
    so copies of a text are no further evidence."""
    count: Counter = Counter()
    seen: set[tuple[str, str, str]] = set()
    for text in texts:
        words = ["", *text.lower().split(), ""]
        new = {x for x in zip(words, words[1:], words[2:]) if x not in seen}
        seen |= new
        count.update({f" {w} "[:n] for w in {w for _, w, _ in new} for n in range(5, 11) if n <= len(w) + 2})
    return Counter({g.encode("utf-8", "surrogatepass"): n for g, n in count.items()})


def fragments(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """Word beginnings far commoner in toxic texts, the strongest first; none begins with another."""
    a, b = _counts(toxic), _counts(ordinary)
    n, m = len(toxic), len(ordinary)

    def g2(gram: bytes) -> float:
        x, y = a[gram], b[gram]
        if x * m <= y * n:
            return 0.0
        share = (x + y) / (n + m)
        parts = ((x, n * share), (y, m * share), (n - x, n - n * share), (m - y, m - m * share))
        return 2 * sum(o * np.log(o / e) for o, e in parts if o)

    ranked = sorted((-g2(g), -len(g), g) for g, k in a.items() if k >= LEAST_DOCS)
    chosen: list[bytes] = []
    for weight, _, gram in ranked:
        if -weight < LEAST_G2 or len(chosen) == FRAGMENTS:
            break
        if not any(gram.startswith(c) or c.startswith(gram) for c in chosen):
            chosen.append(gram)
    return chosen


def dictionaries(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes]:
    """Contents of the toxic and the ordinary dictionary, of equal length."""
    import zstandard

    samples = [w for t in ordinary for w in windows(t)][:40_000]
    try:
        base = zstandard.train_dictionary(BASE_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on
        base = b"".join(samples)[-BASE_BYTES:]
    tail = b"".join(reversed(fragments(toxic, ordinary))) + b" "
    common = Counter(w for t in ordinary for w in set(t.lower().split()))
    filler = " ".join(w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[:1000]).encode("utf-8", "surrogatepass")
    return base + tail, base + filler[: len(tail)].ljust(len(tail))


class Distance:
    """Compressed lengths of windows under both dictionaries."""

    def __init__(self, contents: tuple[bytes, bytes]):
        import zstandard

        self.sides = []
        for content in contents:
            plan = zstandard.ZstdCompressionParameters.from_level(
                LEVEL, source_size=64, dict_size=len(content), write_content_size=False, write_checksum=False, write_dict_id=False
            )
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=plan)
            self.sides.append(zstandard.ZstdCompressor(dict_data=held, compression_params=plan).compress)

    def features(self, text: str | None) -> list[float]:
        toxic, ordinary = self.sides
        saved = np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(text)] or [0])
        return [np.log1p((saved >= 2).sum()), np.log1p((saved >= 4).sum()), (saved >= 3).mean(), min(saved.max(), 12) / 4, saved.mean(), np.log1p(len(saved))]


class Logistic:
    """Ridge logistic regression by Newton steps; with one class or no rows it gives the class's share."""

    def __init__(self, x: np.ndarray, y: np.ndarray, odds: float = 1.0, ridge: float = 1e-3):
        """`odds`: how many times commoner label 0 is among all labelled rows than in y."""
        rows = np.where(y == 1, 1.0, odds)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(y) else (0.0, 1.0)
        # beyond the rows it has seen nothing is known: a far longer text counts as the longest of them
        self.low, self.high = (x.min(0), x.max(0)) if len(y) else (-np.inf, np.inf)
        self.weight, self.share = None, float(y.mean()) if len(y) else 0.0
        if len(set(y.tolist())) < 2:
            return
        z = self._rows(x)
        weight = np.zeros(z.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z @ weight, -30, 30)))
            hessian = (z * (rows * p * (1 - p))[:, None]).T @ z + ridge * len(y) * np.eye(len(weight))
            weight -= np.linalg.solve(hessian, z.T @ (rows * (p - y)) + ridge * len(y) * weight)
        self.weight = weight

    def _rows(self, x: np.ndarray) -> np.ndarray:
        return np.c_[(np.clip(x, self.low, self.high) - self.mean) / self.scale, np.ones(len(x))]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weight is None:
            return np.full(len(x), min(self.share, 0.49))
        return 1 / (1 + np.exp(-np.clip(self._rows(x) @ self.weight, -30, 30)))


def _score(contents: tuple[bytes, bytes], model: Logistic) -> Callable:
    made: list[Distance] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Distance(contents))
        for batch in batches:
            x = np.array([made[0].features(t) for t in batch.column(0).to_pylist()]).reshape(-1, 6)
            yield batch.drop_columns(["text"]).append_column("score", pa.array(model(x) if len(x) else [], pa.float64()))

    return run


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic", sample: int = SAMPLE, carry: list[str] = (),
) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, carried.

    Learns from at most `sample` rows of either label, the first by a hash of their id, outside the held-out fold;
    `labelled` is the table with their texts (default: `docs`). Texts above `SAMPLE_CHARS` characters are not among
    them, and the base is trained on the first 40,000 windows of their ordinary texts. A third of them calibrates.
    Every whole text is scored, however long; an empty table gives no rows; null and empty texts count as one empty window. Without labels of both classes no row is predicted
    toxic. Repeated labels of one id: label 1 wins. Columns named in `carry` come along in the struct `carried`.
    """
    texts = (docs if labelled is None else labelled).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("label").isin(0, 1) & ~held_out("id"))
    marks = marks.groupBy("id").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("id"))
    # two bounded selections: few enough rows to broadcast
    chosen = marks.where("label = 1").orderBy("order", "id").limit(sample).union(marks.where("label = 0").orderBy("order", "id").limit(2 * sample))
    rows = texts.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "id").toPandas().drop_duplicates("id").sort_values("order")
    y = rows["label"].to_numpy(int)
    third = np.zeros(len(y), bool)
    for label in (0, 1):
        third[np.flatnonzero(y == label)[::3]] = True
    of = lambda keep: rows["text"][keep].tolist()
    contents = dictionaries(of(~third & (y == 1)), of(~third & (y == 0)))
    distance = Distance(contents)
    n = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count("*").alias("n")).collect()}
    taken = (third & (y == 0)).sum() / max(1, (third & (y == 1)).sum())
    odds = n.get(0, 0) / max(1, n.get(1, 0)) / taken if taken else 1.0
    model = Logistic(np.array([distance.features(t) for t in of(third)]).reshape(-1, 6), y[third], odds or 1.0)
    source = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("id"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    out = source.mapInArrow(_score(contents, model), source.drop("text").schema.add("score", "double"))
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "carried")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are not predicted toxic, with the same columns."""
    found = toxicity_scores(docs, labels, id_col=id_col, text_col=text_col, carry=docs.columns).where("predicted = 0")
    return found.select(*[F.col(f"carried.`{c}`").alias(c) for c in docs.columns])
