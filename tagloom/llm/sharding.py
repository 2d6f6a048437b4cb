"""Sharding by a permutation-filled lookup table, in SQL functions only.

Each shard prefers the slots of a prime-sized table in an order of its own, (offset + j * skip) mod slots. The shards
take turns; at its turn a shard claims the first slot of its order that is free. A row's key hashes to a slot, and
the broadcast table gives its shard in constant time. Adding or removing a shard moves few slots between the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime, and at least a hundred times the number of shards for even shares.
SLOTS = 4093
#: The largest table: one int for each slot is broadcast.
MOST_SLOTS = 65_537
#: Places of its order that a shard looks at first; only if none is free does it look at all the rest.
AHEAD = 64


def number(text: Column, part: int) -> Column:
    """A number of 48 bits from the md5 of `text`; part 0 or 1."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1 + 12 * part, 12), 16, 10).cast("bigint")


def lookup_table(shards: DataFrame, shard_col: str = "shard", slots: int = SLOTS) -> DataFrame:
    """(slot, shard) for all slots. Shards take turns by name; repeated and null names count once and not at all.

    The table has `slots` rows whatever the data; filling it is one task of a few seconds. No
    shard gives an empty table. More shards than slots: the later names get no slot.
    """
    if not 2 < slots <= MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime of at most {MOST_SLOTS}")
    name = F.col(shard_col).cast("string")
    own = shards.where(name.isNotNull()).select(name.alias("shard")).distinct()
    own = own.withColumn("start", number(F.col("shard"), 0) % slots).withColumn("skip", number(F.col("shard"), 1) % (slots - 1) + 1)
    listed = own.agg(F.array_sort(F.collect_list(F.struct("shard", "start", "skip"))).alias("s")).where("size(s) > 0")
    free = f"j -> get(a.owner, CAST((x.start + j * x.skip) % {slots} AS int)) = -1"
    first_free = f"get(filter(sequence(x.tried, least(x.tried + {AHEAD}, {slots}) - 1), {free}), 0)"
    any_free = f"get(filter(sequence(x.tried, {slots} - 1), {free}), 0)"
    claims = F.expr(
        f"""
        aggregate(
          sequence(0, {slots} - 1),
          named_struct('owner', array_repeat(-1, {slots}), 'tried', array_repeat(0, size(s))),
          (a, turn) -> get(transform(transform(
            transform(
              array(turn % greatest(size(s), 1)),
              i -> named_struct('i', i, 'start', get(s, i).start, 'skip', get(s, i).skip, 'tried', get(a.tried, i))),
            x -> named_struct('x', x, 'j', coalesce({first_free}, {any_free}))),
            y -> named_struct(
              'owner', concat(
                slice(a.owner, 1, CAST((y.x.start + y.j * y.x.skip) % {slots} AS int)), array(y.x.i),
                slice(a.owner, CAST((y.x.start + y.j * y.x.skip) % {slots} AS int) + 2, {slots})),
              'tried', concat(slice(a.tried, 1, y.x.i), array(y.j + 1), slice(a.tried, y.x.i + 2, size(s))))
          ), 0),
          a -> a.owner)
        """
    )
    filled = listed.select("s", claims.alias("owner"))
    return filled.select("s", F.posexplode_outer("owner").alias("slot", "i")).where("slot IS NOT NULL").select("slot", F.expr("element_at(s, i + 1).shard").alias("shard"))


def assign(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """One row per input row: id, slot, shard. A null id has the key ''; equal ids share a shard; an empty table of
    shards leaves shard null. Other columns of `docs` are ignored, so their names cannot clash."""
    slot = (number(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 0) % slots).cast("int")
    placed = docs.select(F.col(id_col), slot.alias("slot"))
    return placed.join(F.broadcast(table), "slot", "left").select(F.col(id_col), "slot", "shard")
