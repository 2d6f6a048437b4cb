"""Token counts of sentencepiece BPE by a table of exact counts at every prefix.

In the model's vocabulary no piece continues after a blank or holds a line break, so a text falls into segments
(blanks and the word behind them; a line break is one token) that are encoded independently. Within a segment one
pass finds the last piece of every prefix: a sequence of pieces is what the model gives if and only if it gives every
two neighbours for their joined text, so the last piece of a prefix is the one that fits behind the last piece of what
is left of it. The counts of all prefixes of a text follow as running sums; its token count and its cut are read there.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
#: Segments, and pairs of pieces, that a task remembers; beyond it starts anew. Longer segments are not remembered.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64
_BLANK = "▁"
_SEGMENT = re.compile("\n| *[^ \n]+| +")


class _Memory(dict):
    """Values by key; a missing one is made once."""

    def __init__(self, make: Callable):
        self.make = make

    def __missing__(self, key):
        found = self.make(key)
        if len(key) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = found
        return found


class PrefixCounter:
    """Exact token counts of texts and of all their prefixes (in characters).

    The model puts one blank before a text that is not empty.
    """

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        if any(_BLANK in p.lstrip(_BLANK) or "\n" in p for p in pieces):
            raise ValueError("a piece crosses a blank or line break, so segments are not independent")
        encode = model.encode
        if encode("a  b") != encode("a") + encode(" b") or encode("a\nb")[:-1] != encode("a\n") or len(encode("\n")) != 2:
            raise ValueError("the model changes blanks, so segments are not independent")
        if len(encode("\n\x00\U0010ffff")) != 7:
            raise ValueError("the model does not give unknown characters as bytes")
        # pieces that the model gives for their own text, blanks as such
        self.pieces = {
            p.replace(_BLANK, " ") for i, p in enumerate(pieces)
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)) and encode("\n" + p)[2:] == [i]
        }
        self.heads = {p[:n] for p in self.pieces for n in range(len(p) + 1)}
        self.ids = {p.replace(_BLANK, " "): i for i, p in enumerate(pieces)}
        self.fits = _Memory(lambda pair: encode("\n" + pair[0] + pair[1])[2:] == [self.ids[pair[0]], self.ids[pair[1]]])
        self.steps = _Memory(self._step)
        self.segments = _Memory(self._prefixes)

    def _step(self, read: str) -> tuple[str, tuple[tuple[str, int], ...]]:
        """The longest end of what was read that begins a piece, and the pieces that end here, the longest first."""
        ends = [read[i:] for i in range(len(read) + 1)]
        return next(e for e in ends if e in self.heads), tuple((e, len(e)) for e in ends if e in self.pieces)

    def _prefixes(self, segment: str) -> bytes:
        """Tokens of every prefix of a segment, as 32-bit numbers."""
        if segment == "\n":
            return array("i", [1]).tobytes()
        steps, fits, state = self.steps, self.fits, ""
        last, counts = [""], array("i", [0])
        for end, char in enumerate(segment, 1):
            state, found = steps[state + char]
            for piece, size in found:
                before = last[end - size]
                if not before or fits[before, piece]:
                    last.append(piece)
                    counts.append(counts[end - size] + 1)
                    break
            else:  # a character that the model does not know: its bytes, and nothing joins it
                if found:
                    raise ValueError(f"no piece ends the prefix {segment[:end]!r}")
                last.append("")
                counts.append(counts[-1] + len(char.encode("utf-8", "surrogatepass")))
        return counts[1:].tobytes()

    def table(self, text: str) -> np.ndarray:
        """Tokens of text[:0], text[:1], ..., text."""
        segments = _SEGMENT.findall(f" {text}".replace(_BLANK, " "))
        counts = np.frombuffer(b"".join(map(self.segments.__getitem__, segments)), np.int32)
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        own = counts[np.cumsum(sizes) - 1].astype(np.int64)
        out = counts + np.repeat(np.cumsum(own) - own, sizes)
        out[0] = 0
        return out

    def count(self, text: str) -> int:
        return int(self.table(text)[-1])

    def within(self, text: str, table: np.ndarray, at: int) -> int:
        """Tokens of text[:at]."""
        return int(table[min(max(at, 0), len(text))])

    def cut(self, text: str, table: np.ndarray, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens."""
        return len(text) - int((table[::-1] <= budget).argmax()) if budget >= 0 else 0


def _count(model_path: str, limit: int, store: bool) -> Callable:
    made: list[PrefixCounter] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(PrefixCounter(model_path))
        counter = made[0]
        for batch in batches:
            tokens, cuts, tables = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                table = counter.table(text)
                tokens.append(int(table[-1]))
                cuts.append(counter.cut(text, table, limit))
                tables.append([{"end": e, "tokens": c} for e, c in enumerate(table.tolist())][1:] if store else None)
            kind = pa.list_(pa.struct([("end", pa.int64()), ("tokens", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tokens, pa.int64()), pa.array(cuts, pa.int64()), pa.array(tables, kind), batch.column(2)],
                names=["id", "n_tokens", "cut_chars", "prefixes", "n_bytes"],
            )

    return run


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, store: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit, cut_chars, prefixes.

    `cut_chars` is the length of the longest prefix with at most `limit` tokens. Both come from the table of the
    counts at every prefix, which is made for every text; `prefixes` has it with `store`, else null. Null is the
    empty text; repeated rows and null ids stay as they are. Other columns are ignored.
    """
    text = F.col(text_col).cast("string")
    source = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("n_bytes"))
    kind = docs.select(F.col(id_col).alias("id")).schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens bigint, cut_chars bigint, prefixes array<struct<end: bigint, tokens: bigint>>, n_bytes bigint"
    out = source.mapInArrow(_count(model_path, limit, store), schema)
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cut_chars", "prefixes")
