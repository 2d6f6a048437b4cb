"""Chat formatting: cumulative snapshots collapse to maximal conversations, which are then rendered. SQL functions only.

A log often holds the same conversation several times, each longer than the one before. Every turn gets the hash of
the conversation up to it: a running sum of hashes of (place, role, text), taken in blocks of turns so that a long
conversation is not one window. A conversation whose full hash is a prefix hash of a longer one is dropped by an
anti-join, and of equal conversations the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Turns that one window or one rendered row holds.
BLOCK = 256
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _placed(turns: DataFrame) -> DataFrame:
    """conv_id, place (from 1), total, role, text and the running hashes h1, h2 of each turn."""
    key = ["conv_id", "block"]
    rows = turns.withColumn("md", F.md5(F.concat("role", F.lit("\x1f"), "text").cast("binary"))).withColumn("block", F.floor(F.col("turn") / BLOCK))
    rows = rows.withColumn("k", F.expr("row_number() OVER (PARTITION BY conv_id, block ORDER BY turn, role, md, text)"))
    before = rows.groupBy(*key).agg(F.count("*").alias("n"))
    before = before.selectExpr(
        "conv_id", "block", "sum(n) OVER (PARTITION BY conv_id ORDER BY block) - n AS start", "sum(n) OVER (PARTITION BY conv_id) AS total"
    )
    rows = rows.join(before, key).withColumn("place", F.col("start") + F.col("k")).drop("start", "k")
    for name, hashed in (("h1", F.xxhash64("place", "md")), ("h2", F.xxhash64("md", "place"))):
        rows = rows.withColumn(name, hashed.cast("decimal(20,0)"))
    over = "OVER (PARTITION BY conv_id, block ORDER BY place)"
    sums = rows.groupBy(*key).agg(F.sum("h1").alias("b1"), F.sum("h2").alias("b2"))
    sums = sums.selectExpr("conv_id", "block", *[f"sum(b{i}) OVER (PARTITION BY conv_id ORDER BY block) - b{i} AS b{i}" for i in (1, 2)])
    rows = rows.selectExpr("conv_id", "block", "place", "total", "role", "text", f"sum(h1) {over} AS r1", f"sum(h2) {over} AS r2")
    rows = rows.join(sums, key)
    return rows.selectExpr("conv_id", "place", "total", "role", "text", "CAST(r1 + b1 AS decimal(38,0)) AS h1", "CAST(r2 + b2 AS decimal(38,0)) AS h2")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that stay, from rows as `_placed` makes them."""
    full = turns.where("place = total").groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    longer = turns.where("place < total").select("place", "h1", "h2").distinct()
    return full.join(longer, ["place", "h1", "h2"], "left_anti").select("conv_id")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of at most 256 rendered turns of each maximal conversation: conv_id, segment, first_place, n_turns, total_turns, rendered.

    The segments of a conversation, one after another, are its rendering. Turns stand by their number; equal numbers by
    role and text; a null number comes first. Turns are dealt by number in blocks of 256 numbers, so all turns of one
    conversation that have no number, or the same one, are one window. Equal rows count once; null roles and texts are empty. Rows without a
    conversation id belong to none and are left out. Turn markers inside a text or role are broken by a blank, so they
    cannot end a turn. Other columns are ignored, so their names cannot clash.
    """
    safe = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"<\|im_", "<| im_")
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.coalesce(F.col(turn_col).cast("bigint"), F.lit(-(2**40))).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    placed = _placed(rows.distinct())
    kept = placed.join(maximal(placed), "conv_id", "left_semi")
    piece = F.concat(F.lit(OPEN), safe("role"), F.lit("\n"), safe("text"), F.lit(CLOSE + "\n"))
    kept = kept.select("conv_id", F.floor((F.col("place") - 1) / BLOCK).alias("segment"), "total", "place", piece.alias("piece"))
    out = kept.groupBy("conv_id", "segment").agg(
        F.min("place").alias("first_place"), F.count("*").alias("n_turns"), F.max("total").alias("total_turns"),
        F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("pieces"),
    )
    rendered = F.array_join(F.transform("pieces", lambda p: p["piece"]), "")
    return out.select(F.col("conv_id").alias(conv_col), "segment", "first_place", "n_turns", "total_turns", rendered.alias("rendered"))
