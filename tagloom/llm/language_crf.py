"""Language identification by a linear-chain conditional random field over the words of a text.

Each word has affix, n-gram and lexicon features with learned weights; neighbouring words are tied by learned
transitions, so code-switched text gets a label for each word from its context. Forward-backward gives every
word's marginals exactly, in blocks: matrix products over blocks first, then the words inside all blocks at once.
The language of a text is the one with the largest share of its words' marginals.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import held_out, prefix_sums, ranges, span_hashes

#: Labelled rows that the model is fitted on, shared out among the languages, but so many of each at least; characters
#: that are taken of each.
SAMPLE, LEAST_OF_LANGUAGE, SAMPLE_CHARS = 600, 20, 8000
HASHES = 1 << 17
LEXICON = 3000
#: Words of one language in a row in the training chains, which switch between languages.
STRETCH = 30
EPOCHS = 5
BLOCK = 64
#: Words that a task remembers, and words that one forward-backward step handles.
REMEMBERED, STEP_WORDS = 300_000, 300_000
UNKNOWN = "und"


def letters_only(text: str | None) -> list[str]:
    """Lower-case words that have a letter."""
    return [w for w in (text or "").lower().split() if w.isalpha() or any(map(str.isalpha, w))]


_OTHER = re.compile(r"[\W\d_]+")
#: Told apart by these: whole words, prefixes, suffixes, n-grams.
_WORD, _PREFIX, _SUFFIX, _GRAM = (np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x9B05688C2B3E6C1F, 0x510E527FADE682D1))


def inner(word: str) -> str:
    """The letters of a word."""
    return word if word.isalpha() else _OTHER.sub("", word)


def features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words at once, and the word of each.

    They are the word if it is in the lexicon, prefixes and suffixes up to four characters, and character bi- and
    trigrams with both ends marked. All are spans of one byte buffer, hashed from its prefix sums."""
    n = len(words)
    text = "".join([f"^{w}$" for w in map(inner, words)])
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # where each character begins
    size = np.fromiter((len(inner(w)) for w in words), np.int64, n)
    first = np.cumsum(size + 2) - (size + 2)  # the mark before each word
    sums, every = prefix_sums(data), np.arange(n)
    found, owner = [], []

    def take(salt: np.uint64, starts: np.ndarray, ends: np.ndarray, of: np.ndarray) -> None:
        found.append((span_hashes(sums, at[starts], at[ends]) ^ salt) % np.uint64(HASHES))
        owner.append(of)

    whole = span_hashes(sums, at[first + 1], at[first + 1 + size])
    found.append(np.where(np.isin(whole, lexicon), whole ^ _WORD, _WORD) % np.uint64(HASHES))
    owner.append(every)
    for k in (1, 2, 3, 4):
        long = every[size >= k]
        take(_PREFIX, first[long] + 1, first[long] + 1 + k, long)
        take(_SUFFIX, first[long] + 1 + size[long] - k, first[long] + 1 + size[long], long)
    for k in (2, 3):
        count = np.maximum(0, size + 3 - k)
        starts = ranges(first, count)
        take(_GRAM, starts, starts + k, np.repeat(every, count))
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of words as `features` has them."""
    data = "".join(words).encode("utf-8", "surrogatepass")
    end = np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.int64) if words else np.zeros(0, np.int64)
    return span_hashes(prefix_sums(np.frombuffer(data, np.uint8)), np.append(0, end[:-1]) if words else end, end)


def forward_backward(potential: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Marginals of every word. potential: (words, labels), positive; lengths of the chains, all over 0; step: (labels, labels)."""
    k = potential.shape[1]
    blocks = -(-lengths // BLOCK)
    chain_first = np.cumsum(blocks) - blocks
    index = ranges(np.zeros(len(lengths), np.int64), blocks)
    start = np.repeat(np.cumsum(lengths) - lengths, blocks) + index * BLOCK
    size = np.minimum(BLOCK, np.repeat(lengths, blocks) - index * BLOCK)
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(BLOCK)]  # blocks with more than t words
    product = np.tile(np.eye(k), (len(order), 1, 1))
    for t in range(int(size[0])):
        n = active[t]
        product[:n] = (product[:n].reshape(-1, k) @ step).reshape(n, k, k) * potential[start[:n] + t][:, None, :]
        product[:n] /= product[:n].sum((1, 2), keepdims=True)
    enter, leave = np.full((len(order), k), 1 / k), np.ones((len(order), k))
    for j in range(1, int(blocks.max())):
        own = place[chain_first[blocks > j] + j]
        before = place[chain_first[blocks > j] + j - 1]
        value = np.einsum("na,nab->nb", enter[before], product[before])
        enter[own] = value / value.sum(1, keepdims=True)
    for j in range(int(blocks.max()) - 1, 0, -1):
        own = place[chain_first[blocks > j] + j]
        before = place[chain_first[blocks > j] + j - 1]
        value = np.einsum("nab,nb->na", product[own], leave[own])
        leave[before] = value / value.sum(1, keepdims=True)
    marginals = np.empty_like(potential)
    for t in range(int(size[0])):
        n = active[t]
        enter[:n] = (enter[:n] @ step) * potential[start[:n] + t]
        enter[:n] /= enter[:n].sum(1, keepdims=True)
        marginals[start[:n] + t] = enter[:n]
    for t in range(int(size[0]) - 1, -1, -1):
        n = active[t]
        at = start[:n] + t
        marginals[at] *= leave[:n]
        leave[:n] = (leave[:n] * potential[at]) @ step.T
        leave[:n] /= leave[:n].sum(1, keepdims=True)
    return marginals / marginals.sum(1, keepdims=True)


class Model:
    """Weights of the features (hash, label), transitions (label, label), and the lexicon."""

    def __init__(self, labels: list[str], lexicon: np.ndarray):
        self.labels, self.lexicon = labels, lexicon
        self.weight = np.zeros((HASHES, len(labels)), np.float32)
        self.step = np.zeros((len(labels), len(labels)))

    def scores(self, found: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Sums of the weights of each word's features, for each label."""
        return np.stack([np.bincount(owner, self.weight[found, j], n) for j in range(len(self.labels))], 1)

    @staticmethod
    def potential(scores: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(scores - scores.max(1, keepdims=True), -30, 0).astype(float))


def train(texts: list[str], langs: list[str], seed: int = 5) -> Model | None:
    """A model by gradient ascent on the likelihood of chains in which stretches of the sample's texts alternate."""
    words = [letters_only(t) for t in texts]
    labels = sorted({x for x, w in zip(langs, words) if w})
    if not labels:
        return None
    by_lang = {x: Counter() for x in labels}
    for x, w in zip(langs, words):
        if w:
            by_lang[x].update(set(w))
    common = {w for c in by_lang.values() for w, _ in sorted(c.items(), key=lambda y: (-y[1], y[0]))[: LEXICON // len(labels)]}
    lexicon = word_hashes(sorted({inner(w) for w in common}))
    model = Model(labels, lexicon)
    stretches = [(labels.index(x), w[i : i + STRETCH]) for x, w in zip(langs, words) for i in range(0, len(w), STRETCH)]
    rng = np.random.default_rng(seed)
    known: dict[str, int] = {}
    ids = [np.array([known.setdefault(x, len(known)) for x in w]) for _, w in stretches]
    flat, owner = features(list(known), lexicon)
    squares = np.full(model.weight.shape, 1e-6, np.float32)
    seen = np.full(model.step.shape, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(stretches))
        for batch in np.array_split(order, max(1, len(order) // 2000)):
            word = np.concatenate([ids[i] for i in batch])
            gold = np.repeat([stretches[i][0] for i in batch], [len(ids[i]) for i in batch])
            # eight stretches make a chain
            lengths = np.array([sum(len(ids[i]) for i in batch[a : a + 8]) for a in range(0, len(batch), 8)])
            scores = model.scores(flat, owner, len(known))
            step = np.exp(model.step)
            marginals = forward_backward(model.potential(scores)[word], lengths, step / step.sum(1, keepdims=True))
            error = -marginals
            error[np.arange(len(word)), gold] += 1
            by_word = np.stack([np.bincount(word, error[:, j], len(known)) for j in range(len(labels))], 1)
            gradient = np.stack([np.bincount(flat, by_word[owner, j], HASHES) for j in range(len(labels))], 1) / len(word)
            gradient -= 1e-6 * model.weight
            squares += gradient**2
            model.weight += (0.3 * gradient / np.sqrt(squares)).astype(np.float32)
            follows = np.ones(len(word), bool)
            follows[np.cumsum(lengths) - lengths] = False
            at = np.flatnonzero(follows)
            pairs = np.zeros(model.step.shape)
            np.add.at(pairs, (gold[at - 1], gold[at]), 1)
            expected = pairs.sum(1, keepdims=True) * step / step.sum(1, keepdims=True)
            change = (pairs - expected) / len(word)
            seen += change**2
            model.step += 0.3 * change / np.sqrt(seen)
    return model


def _label(model: Model | None) -> Callable:
    memory: dict[str, int] = {}
    scores: list[np.ndarray] = []

    def rows_of(texts: list[list[str]]) -> np.ndarray:
        new = [w for w in dict.fromkeys(w for t in texts for w in t) if w not in memory]
        if len(memory) + len(new) > REMEMBERED:
            memory.clear()
            scores.clear()
            new = list(dict.fromkeys(w for t in texts for w in t))
        if new:
            memory.update(zip(new, range(len(memory), len(memory) + len(new))))
            scores.append(model.potential(model.scores(*features(new, model.lexicon), len(new))))
            scores[:] = [np.concatenate(scores)]
        return scores[0][np.fromiter((memory[w] for t in texts for w in t), np.int64)]

    def label(texts: list[list[str]]) -> tuple[list[str], list[float]]:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        names, best = [UNKNOWN] * len(texts), [0.0] * len(texts)
        full = np.flatnonzero(lengths)
        if model is None or not len(full):
            return names, best
        step = np.exp(model.step)
        marginals = forward_backward(rows_of(texts), lengths[full], step / step.sum(1, keepdims=True))
        share = np.add.reduceat(marginals, np.cumsum(lengths[full]) - lengths[full], axis=0) / lengths[full][:, None]
        for i, row in zip(full, share):
            names[i], best[i] = model.labels[int(row.argmax())], float(min(1.0, row.max()))
        return names, best

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            best: list[float] = []
            held: list[list[str]] = []
            n = 0
            for text in batch.column(1).to_pylist():
                held.append(letters_only(text))
                n += len(held[-1])
                if n >= STEP_WORDS:
                    for out, new in zip((names, best), label(held)):
                        out += new
                    held, n = [], 0
            for out, new in zip((names, best), label(held)):
                out += new
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(best, pa.float64())], names=["id", "lang_pred", "score"])

    return run


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: id, held_out, lang_pred, score.

    Learns from the text and non-null language of rows outside the held-out fold: `sample` rows shared out evenly among
    the languages, `LEAST_OF_LANGUAGE` of each at least, the first by a hash of their id; of each the first
    `SAMPLE_CHARS` characters. So a rare language, or one with long texts only, is learned too. Every whole text is
    labelled. Null texts and texts without a letter are `und` with score 0, and so is every text if there is nothing to
    learn from. Equal shares: the first language by name. Repeated rows get the same label and count once in the
    sample. An empty table gives no rows. Other columns are ignored, so their names cannot clash.
    """
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = known.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    known = known.select("id", "lang", F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    known = known.withColumn("order", F.xxhash64("id")).withColumn("print", F.xxhash64("text"))
    key = ["lang", "order", "id", "print"]
    each = max(LEAST_OF_LANGUAGE, sample // max(1, known.agg(F.count_distinct("lang")).first()[0]))
    # rows are chosen without their texts, as every task sends its first ones; only the texts of the chosen follow
    # first within parts of a language, then among the few rows that are left, as one language can have most rows
    first = known.select(key).distinct().withColumn("part", F.pmod("order", F.lit(64)))
    for parts in (["lang", "part"], ["lang"]):
        place = F.row_number().over(Window.partitionBy(*parts).orderBy("order", "id", "print"))
        first = first.withColumn("place", place).where(F.col("place") <= each)
    chosen = F.broadcast(first.select(key))
    rows = known.join(chosen, key, "left_semi").groupBy(key).agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: tuple(r[c] for c in key))
    model = train([r["text"] for r in rows], [r["lang"] for r in rows])
    out = source.mapInArrow(_label(model), f"id {kind}, lang_pred string, score double")
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")
