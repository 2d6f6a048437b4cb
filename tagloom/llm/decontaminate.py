"""Benchmark decontamination with a generalised suffix automaton of the benchmark's word sequences.

The automaton of all items is built once per block of items and shipped to the tasks; training words are
streamed through it, which gives the longest match that ends at each word. Every match of 13 words or more, and
every whole item of fewer words, marks its words as hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import merge_spans, release

WINDOW = 13
#: A document is contaminated if 20 * n_hit >= n_words.
COVER = 20
#: Bytes of item texts in one automaton; more items go through several automata, one after another.
BLOCK_BYTES = 8_000_000
_INSIDE = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Lower-cases A-Z and makes every byte outside `[0-9a-z]` and multi-byte characters a blank.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _INSIDE else 0x20 for b in range(256))


def fold(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences; `vocabulary` maps a word to its number."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.names: list[str] = []
        for name, words in items:
            self.names.append(name)
            state = 0
            for word in words:
                state = self._extend(state, self.vocabulary.setdefault(word, len(self.vocabulary)))
        # states are split while later items come in, so what belongs to them is set on the finished automaton
        members: list[set[int]] = [set() for _ in self.length]
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for item, (_, words) in enumerate(items):
            state = 0
            for word in words:
                state = self.next[state][self.vocabulary[word]]
                up = state
                while up > 0 and item not in members[up]:
                    members[up].add(item)
                    up = self.link[up]
            if 0 < len(words) < window:
                self.short[state].append((len(words), item))
        self.items = members
        self.has_short = [False] * len(self.length)
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.has_short[state] = bool(self.short[state]) or self.has_short[self.link[state]]

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            old = self.next[last][word]
            return old if self.length[old] == self.length[last] + 1 else self._split(last, word, old)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            old = self.next[at][word]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._split(at, word, old)
        return new

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.length.append(length)
        self.next.append(following)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, at: int, word: int, old: int) -> int:
        """The shorter strings of `old` become a state of their own."""
        new = self._state(self.length[at] + 1, dict(self.next[old]), self.link[old])
        self.link[old] = new
        while at >= 0 and self.next[at].get(word) == old:
            self.next[at][word] = new
            at = self.link[at]
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of hit words (not merged), and the items with an occurring window."""
        following, link, length, has_short, window = self.next, self.link, self.length, self.has_short, self.window
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        state = size = 0
        get = self.vocabulary.get
        for at, word in enumerate(map(get, words)):
            if word is None:
                state = size = 0
                continue
            to = following[state].get(word)
            if to is None:
                while state > 0:
                    state = link[state]
                    to = following[state].get(word)
                    if to is not None:
                        break
                if to is None:
                    state = size = 0
                    continue
                size = length[state]
            state = to
            size += 1
            if size >= window:
                up = state
                while length[link[up]] >= window:
                    up = link[up]
                found |= self.items[up]
                spans.append((at + 1 - window, at + 1))
            if has_short[state]:
                up = state
                while up > 0 and has_short[up]:
                    for n, item in self.short[up]:
                        if up != state or size >= n:
                            spans.append((at + 1 - n, at + 1))
                            found.add(item)
                    up = link[up]
        return spans, {self.names[i] for i in found}


def _scan(items: list[tuple[str, str]], window: int) -> Callable:
    built: list[Automaton] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what an earlier stage's task left in this worker
        if not built:
            built.append(Automaton([(name, fold(text)) for name, text in items], window))
        for batch in batches:
            columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names) if n in ("text", "spans", "items")}
            spans, names = [], []
            for text, old, seen in zip(columns["text"], columns["spans"], columns["items"]):
                new, found = built[0].scan(fold(text))
                spans.append([{"start": a, "end": b} for a, b in merge_spans([*((x["start"], x["end"]) for x in old), *new])])
                names.append(sorted({*seen, *found}))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            out = batch.set_column(batch.schema.get_field_index("spans"), "spans", pa.array(spans, kind))
            yield out.set_column(out.schema.get_field_index("items"), "items", pa.array(names, pa.list_(pa.string())))

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans, names = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("text", "spans", "items"))
        n_words = [len(fold(t)) for t in texts]
        out = batch.append_column("n_words", pa.array(n_words, pa.int64()))
        out = out.append_column("n_hit", pa.array([sum(x["end"] - x["start"] for x in s) for s in spans], pa.int64()))
        out = out.append_column("items_sha256", pa.array([hashlib.sha256(",".join(n).encode()).hexdigest() for n in names], pa.string()))
        yield out.drop_columns(["text"])


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", carry: list[str] = (), window: int = WINDOW, cover: int = COVER, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items, items_sha256, spans (hit words), contaminated, carried.

    Null and word-free texts have no words and are clean; items without words (or null) never occur; rows of one
    item_id count once in n_items; a null item_id counts as the item ''. Columns named in `carry` come along in the
    struct `carried`, whatever they are called. An empty benchmark leaves all documents clean. The benchmark is a
    query set: its texts pass the driver, in automata of at most `block_bytes` of text each, chained one after
    another, so a task holds bounded automata whatever the number of items.
    """
    blocks: list[list[tuple[str, str]]] = [[]]
    held = 0
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(item_text_col).alias("t")).where("t IS NOT NULL")
    for row in rows.distinct().toLocalIterator():
        if held and held + len(row["t"]) > block_bytes:
            blocks, held = [*blocks, []], 0
        blocks[-1].append((row["i"], row["t"]))
        held += len(row["t"])
    out = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"),
        F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)").alias("spans"), F.expr("CAST(array() AS array<string>)").alias("items"),
    )
    for block in blocks[:-1]:
        out = out.mapInArrow(_scan(block, window), out.schema)
    last = _scan(blocks[-1], window)
    schema = out.drop("text").schema.add("n_words", "long").add("n_hit", "long").add("items_sha256", "string")
    out = out.mapInArrow(lambda batches: _digest(last(batches)), schema)
    return out.select(
        F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), "items", "items_sha256", "spans",
        ((F.col("n_hit") > 0) & (cover * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "carried",
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: bool = False) -> DataFrame:
    """`docs` without contaminated documents; with `cut`, hit words of the others go too, as the words of a text left.

    Same columns as `docs`. A document whose hits stay below the coverage limit is kept as it is unless `cut` is set.
    """
    found = contamination(docs, benchmark, id_col, text_col, carry=docs.columns).where("NOT contaminated")
    kept = found.select(*[F.col(f"carried.`{c}`").alias(c) for c in docs.columns], F.col("spans").alias("_spans") if cut else F.lit(None).alias("_spans"))
    if cut:
        kept = kept.mapInArrow(_cut(text_col), kept.schema)
    return kept.drop("_spans")


def _cut(text_col: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            spans = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
            texts = [_without(t, s) if t and s else t for t, s in zip(batch.column(at).to_pylist(), spans)]
            yield batch.set_column(at, text_col, pa.array(texts, pa.string()))

    return run


def _without(text: str, spans: list[dict]) -> str:
    data = text.encode("utf-8", "surrogatepass")
    folded = data.translate(_FOLD)
    bounds, at = [], 0
    for word in folded.split():
        at = folded.index(word, at)
        bounds.append((at, at + len(word)))
        at += len(word)
    out, last = [], 0
    for span in spans:
        out.append(data[last : bounds[span["start"]][0]])
        last = bounds[span["end"] - 1][1]
    return b"".join([*out, data[last:]]).decode("utf-8", "ignore")
