"""Best-fit packing of token pieces by bin completion with branch and bound.

Lengths are at most `capacity`, so the whole corpus is a histogram of that many counts. The search works on the
histogram: it takes the largest length left, enumerates the undominated fillings around it, repeats the chosen
filling as often as the counts allow, and prunes by the bound ceil(tokens left / capacity). The best-fit
decreasing packing, made on the same histogram, is the incumbent. Pieces are then ranked within their length
(in salted parts) and look up sequence and offset by arithmetic.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import settle, shuffle_partitions

CAPACITY = 1024
END_ID = 2
#: Nodes that the search visits before it keeps the best packing so far.
NODES = 400
#: Fillings that one node enumerates, and lengths that a partial filling is continued with.
FILLINGS, BRANCHES = 12, 3
#: Nodes from one best-fit incumbent to the next.
INCUMBENT_EVERY = 8

Plan = list[tuple[tuple[int, ...], int]]  # (lengths of one sequence in order, number of such sequences)


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, many equal lengths at a time: each goes to the fullest sequence that has room."""
    by_room: dict[int, list[list]] = {}
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in by_room if r >= size), default=None)
            if room is None:
                fits = capacity // size
                bins, each = (left // fits, fits) if left >= fits else (1, left)
                by_room.setdefault(capacity - each * size, []).append([(size,) * each, bins])
                left -= bins * each
                continue
            filling, bins = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
            each = min(room // size, max(1, left // bins))
            used = min(bins, left // each)
            if used < bins:
                by_room.setdefault(room, []).append([filling, bins - used])
            by_room.setdefault(room - each * size, []).append([filling + (size,) * each, used])
            left -= used * each
    return [(tuple(f), n) for groups in by_room.values() for f, n in groups]


def fillings(counts: dict[int, int], largest: int, capacity: int, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Sets of lengths that fit beside `largest`, tightest first, without those that another dominates.

    A filling is dominated if one more length fits, or one of its lengths can be exchanged for the next larger one
    that is there. At most 8 * most partial fillings are looked at, those of large lengths first.
    """
    free = {s: n - (s == largest) for s, n in counts.items() if s <= capacity - largest and n > (s == largest)}
    sizes = sorted(free, reverse=True)
    falling = [-s for s in sizes]
    found: list[tuple[int, tuple[int, ...]]] = []
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, capacity - largest, ())]
    budget = 8 * most
    while stack and budget and not (len(found) >= most and min(found)[0] == 0):
        budget -= 1
        start, room, chosen = stack.pop()
        ahead = []
        i = max(start, bisect_left(falling, -room))
        while i < len(sizes) and len(ahead) < BRANCHES:
            if chosen.count(sizes[i]) < free[sizes[i]]:
                ahead.append((i, room - sizes[i], (*chosen, sizes[i])))
            i += 1
        stack += reversed(ahead)
        if ahead:
            continue
        larger = False  # a size that fits besides, or instead of a smaller one
        for size in reversed(sizes):
            if size > room:
                break
            larger = larger or chosen.count(size) < free[size]
        for size in set(chosen):
            above = bisect_left(falling, -size) - 1
            larger = larger or above >= 0 and sizes[above] - size <= room and chosen.count(sizes[above]) < free[sizes[above]]
        if not larger:
            found.append((room, chosen))
    return [f for _, f in sorted(found)[:most]] or [_first_fit(free, sizes, capacity - largest)]


def _first_fit(free: dict[int, int], sizes: list[int], room: int) -> tuple[int, ...]:
    chosen: list[int] = []
    for size in sizes:
        times = min(free[size], room // size)
        chosen += [size] * times
        room -= size * times
    return tuple(chosen)


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """The packing with the fewest sequences found; the fewest possible if it meets the bound or the search ends.

    Depth first. A node is what is left, and how many sequences lead to it. It is pruned if even without further waste
    it needs as many sequences as the incumbent; its own best-fit rest may become the incumbent.
    """
    best = best_fit(counts, capacity)
    fewest, bound = sum(n for _, n in best), -(-sum(s * n for s, n in counts.items()) // capacity)
    stack: list[tuple[dict[int, int], tuple | None, int]] = [(dict(counts), None, 0)]
    visits = 0
    while stack and fewest > bound and visits < nodes:
        left, path, used = stack.pop()
        if used + -(-sum(s * n for s, n in left.items()) // capacity) >= fewest:
            continue
        if not left or visits % INCUMBENT_EVERY == 0:
            rest = best_fit(left, capacity)
            if used + sum(n for _, n in rest) < fewest:
                steps, at = [], path
                while at:
                    steps.append(at[0])
                    at = at[1]
                best, fewest = [*reversed(steps), *rest], used + sum(n for _, n in rest)
        visits += 1
        if not left:
            continue
        largest = max(left)
        ahead = []
        for filling in fillings(left, largest, capacity):
            sequence = (largest, *filling)
            uses = Counter(sequence)
            times = min(left[s] // n for s, n in uses.items())
            after = {s: n - times * uses.get(s, 0) for s, n in left.items()}
            ahead.append(({s: n for s, n in after.items() if n}, ((sequence, times), path), used + times))
        stack += reversed(ahead)
    return best


class Encoder:
    """Token ids as the library `tokenizers` gives them for a byte-level BPE file.

    The same vocabulary as ranks runs several times faster and gives the same ids; texts in which a special token's
    string stands go through `tokenizers` itself.
    """

    def __init__(self, json_path: str, rank_path: str | None, pattern: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast = None
        if rank_path:
            import tiktoken

            with open(rank_path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("pack", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _pieces(make: Callable[[], Encoder], capacity: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = make()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encoder.ids(text or ""), end_id], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
                rows += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names=["id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def _lookup(plan: Plan) -> dict[int, tuple[list[int], list[tuple[int, int, list[int]]]]]:
    """By length: first ranks of the intervals, and (first rank, first sequence, offsets in a sequence) of each."""
    table: dict[int, tuple[list, list]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for filling, times in plan:
        places: dict[int, list[int]] = {}
        offset = 0
        for size in filling:
            places.setdefault(size, []).append(offset)
            offset += size
        for size, offsets in places.items():
            starts, rows = table.setdefault(size, ([], []))
            starts.append(taken.get(size, 0))
            rows.append((taken.get(size, 0), sequence, offsets))
            taken[size] = taken.get(size, 0) + times * len(offsets)
        sequence += times
    return table


def _place(table: dict) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for size, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist()):
                starts, rows = table[size]
                first, sequence, offsets = rows[bisect_right(starts, rank) - 1]
                out.append((sequence + (rank - first) // len(offsets), offsets[(rank - first) % len(offsets)]))
            batch = batch.drop_columns(["rank"])
            for i, name in enumerate(("sequence_id", "offset")):
                batch = batch.append_column(name, pa.array([x[i] for x in out], pa.int64()))
            yield batch

    return run


def pack(
    docs: DataFrame, json_path: str, rank_path: str | None = None, pattern: str = "", id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end_id: int = END_ID, nodes: int = NODES,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and `end_id`; null and empty texts are the end id alone. Only documents of more than
    `capacity` ids are cut, into pieces of `capacity` of which the first may be shorter. Repeated rows are packed
    each on its own; an empty table gives no rows. Ids are whole numbers, or text that casts to one. Other columns are ignored, so their names cannot clash. What
    passes the driver is the histogram of lengths and its plan, whatever the number of documents.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    make = _maker(json_path, rank_path, pattern)
    pieces = source.mapInArrow(_pieces(make, capacity, end_id), "id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint")
    salt = F.pmod(F.xxhash64("id", "piece"), F.lit(max(8, shuffle_partitions(spark))))
    pieces = settle(pieces.withColumn("salt", salt), "pieces")
    parts = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    table = _lookup(complete({r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity, nodes))
    # rank within a length: rows before this part, then the place in the part
    before = parts.withColumn("before", F.expr("sum(n) OVER (PARTITION BY length ORDER BY salt) - n")).drop("n")
    ranked = pieces.withColumn("in_part", F.expr("row_number() OVER (PARTITION BY length, salt ORDER BY id, piece) - 1"))
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("in_part"))
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", "rank")
    placed = ranked.mapInArrow(_place(table), "id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return placed.withColumnRenamed("id", id_col)


def _maker(json_path: str, rank_path: str | None, pattern: str) -> Callable[[], Encoder]:
    made: list[Encoder] = []

    def make() -> Encoder:
        if not made:
            made.append(Encoder(json_path, rank_path, pattern))
        return made[0]

    return make
