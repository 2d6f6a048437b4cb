"""Album units (G1): rows grouped by folder (case-sensitive) and disc."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions import text as X
from tagloom.functions.keys import name_key
from tagloom.operators.lineage import settle, sized
from tagloom.operators.lookup import Index

UNIT = ["folder", "disc"]
# Rows of a group that one task is to join with the group's facts.
SHARE_ROWS = 50_000


def join_groups(rows: DataFrame, facts: DataFrame, keys: list[str], how: str = "left", share_rows: int = SHARE_ROWS) -> DataFrame:
    """Join of rows with the one row of facts of their group; large groups are dealt over tasks.

    ``facts`` are written first and have ``n_rows``, the rows of the group or more. A group
    of more than ``share_rows`` rows is cut into shares by its paths, and its facts go to
    each share; such groups are few, as many as fit into the rows. Facts of many groups are
    merged with the rows."""
    facts = settle(facts, "groups")
    shares = F.ceil(F.col("n_rows") / share_rows).cast("int")
    large = facts.filter(F.col("n_rows") > share_rows).select(*keys, shares.alias("_shares"))
    share = F.coalesce(F.pmod(F.xxhash64("relative_path"), F.col("_shares")), F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(large), keys, "left").withColumn("_share", share).drop("_shares")
    copied = facts.withColumn("_share", F.explode(F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1))).drop("n_rows")
    return dealt.join(sized(copied, facts.count()), [*keys, "_share"], how).drop("_share")


def unit_values(tracks: DataFrame, index: Index, albumartist: bool = False, raw_date: bool = False) -> DataFrame:
    """Distinct (unit, kind, value) with ``n`` rows each: composers and artists as canonicals
    where known. Names are folded and looked up once per unit, not once per track.

    ``kind``: c composer, p artist, d year, a album, e albumartist, t the track itself."""

    def tagged(kind: str, values: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), values.alias("values"))

    date = F.col("date") if raw_date else F.array_compact(F.array(F.col("rec_year").cast("string")))
    parts = [
        tagged("t", F.array(F.lit(None).cast("string"))),
        tagged("c", F.col("composer")), tagged("p", F.col("artist")),
        tagged("d", date), tagged("a", F.col("album")),
    ]
    if albumartist:
        parts.append(tagged("e", F.col("albumartist")))
    rows = tracks.select(*UNIT, F.inline(F.array(*parts))).select(*UNIT, "kind", F.explode("values").alias("value"))
    rows = rows.filter((F.col("kind") == "t") | ~X.is_blank(F.col("value")))
    rows = rows.groupBy(*UNIT, "kind", "value").agg(F.count("*").alias("n"))
    key = F.when(F.col("kind").isin("c", "p", "e"), name_key(F.col("value")))
    known = index.resolve(rows, key, "n", "composer", "person", "ens_id")
    value = (
        F.when(F.col("kind") == "c", F.coalesce("n_composer", "value"))
        .when(F.col("kind") == "p", F.coalesce("n_person", "value"))
        .when((F.col("kind") == "e") & F.col("n_ens_id").isNotNull(), F.concat(F.lit("#"), F.col("n_ens_id")))
        .otherwise(F.col("value"))
    )
    return known.select(*UNIT, "kind", value.alias("value"), "n")


def _of(kind: str) -> Column:
    return F.when(F.col("kind") == kind, F.col("value"))


def album_units(tracks: DataFrame, index: Index, albumartist: bool = False, raw_date: bool = False) -> DataFrame:
    """G1: sorted distinct values per unit. Map-side partial sets, so a hot unit
    sends its distinct values once per task, not its rows."""
    kinds = {"c": "composers", "p": "artists", "d": "dates", "a": "albums"}
    if albumartist:
        kinds["e"] = "albumartists"
    return unit_values(tracks, index, albumartist, raw_date).groupBy(*UNIT).agg(
        F.sum(F.when(F.col("kind") == "t", F.col("n"))).alias("n_tracks"),
        *[F.array_sort(F.collect_set(_of(k))).alias(name) for k, name in kinds.items()],
    )


def unit_facts(tracks: DataFrame, index: Index) -> DataFrame:
    """What the album-name rule needs of a unit: smallest and largest value per
    kind. They are equal exactly when the unit has one value, so no lists are built."""
    aggregates = []
    for kind, name in (("c", "composer"), ("p", "artist"), ("d", "date")):
        aggregates += [F.min(_of(kind)).alias(f"{name}_min"), F.max(_of(kind)).alias(f"{name}_max")]
    aggregates += [F.min(_of("a")).alias("album_min"), F.sum(F.when(F.col("kind") == "t", F.col("n"))).alias("n_rows")]
    return unit_values(tracks, index).groupBy(*UNIT).agg(*aggregates)


def sole(name: str) -> Column:
    return F.when(F.col(f"{name}_min") == F.col(f"{name}_max"), F.col(f"{name}_min"))


def unit_works(tracks: DataFrame, index: Index) -> DataFrame:
    """Works that the unit's albums name: first album in sorted order, per composer."""
    albums = tracks.select(*UNIT, F.explode("album").alias("album")).distinct()
    named = albums.withColumn("_key", name_key(F.col("album")))
    hits = named.join(index.works, F.col("_key") == F.col("work_key"))
    return (
        hits.groupBy(*UNIT, "work_composer")
        .agg(F.min(F.struct("album", "work")).alias("w"))
        .select(*UNIT, F.col("work_composer").alias("unit_composer"), F.col("w.work").alias("work_from_album"))
    )


def with_folder_works(units: DataFrame, index: Index) -> DataFrame:
    """Adds the work that the folder names: last segment first, whole before its head.

    The units are already spread by (folder, disc), so trying the segments and
    folding back to one row per unit needs no further shuffle."""
    candidates = F.flatten(
        F.transform(F.reverse(X.segments(F.col("folder"))), lambda s: F.array(s, X.head_of(s)))
    )
    tried = units.select("*", F.posexplode_outer(candidates).alias("_pos", "_text")).withColumn(
        "_key", F.nullif(name_key(F.col("_text")), F.lit(""))
    )
    hits = tried.join(
        index.works, (F.col("_key") == F.col("work_key")) & (F.col("unit_composer") == F.col("work_composer")), "left"
    )
    facts = [c for c in units.columns if c not in UNIT]
    folded = hits.groupBy(*UNIT).agg(
        F.first(F.struct(*facts)).alias("_facts"),
        F.min(F.when(F.col("work").isNotNull(), F.struct("_pos", "work"))).alias("_best"),
    )
    return folded.select(*UNIT, "_facts.*", F.col("_best.work").alias("work_from_folder"))


def decide_album_names(tracks: DataFrame, index: Index) -> DataFrame:
    """The album-name decision per unit, in the order of the decision table:
    override, composer, work, date, artist. ``album`` is set, or ``hold`` is."""
    facts = index.with_override(unit_facts(tracks, index))
    composer = F.coalesce("override.composer", sole("composer"))
    units = facts.filter(~F.coalesce("override.exclude", F.lit(False))).withColumn("unit_composer", composer)
    if index.has_works:
        units = with_folder_works(units, index).join(
            unit_works(tracks, index), [*UNIT, "unit_composer"], "left"
        )
    else:
        nothing = F.lit(None).cast("string")
        units = units.withColumns({"work_from_album": nothing, "work_from_folder": nothing})
    disagree = F.col("work_from_album") != F.col("work_from_folder")
    work = F.coalesce(
        "override.work_name",
        F.when(~F.coalesce(disagree, F.lit(False)), F.coalesce("work_from_album", "work_from_folder")),
    )
    date = F.coalesce(sole("date"), F.col("override.date"))
    artist = sole("artist")
    decided = units.withColumns({"_work": work, "_date": date, "_artist": artist})
    hold = (
        F.when(F.col("unit_composer").isNull(), "WorkUnknown")
        .when(F.col("_work").isNull(), "WorkUnknown")
        .when(F.col("_date").isNull(), "DateUnknown")
        .when(F.col("_artist").isNull(), "ArtistUnknown")
    )

    def missing_or_split(name: str) -> Column:
        return F.when(F.col(f"{name}_min").isNull(), f"{name}_missing").otherwise(f"{name}_split")

    code = (
        F.when(F.col("unit_composer").isNull(), missing_or_split("composer"))
        .when(F.col("_work").isNull() & disagree, "work_disagrees")
        .when(F.col("_work").isNull(), "work_unregistered")
        .when(F.col("_date").isNull(), missing_or_split("date"))
        .when(F.col("_artist").isNull(), missing_or_split("artist"))
        .when(F.col("override.work_name").isNotNull(), "work_from_override")
        .when(F.col("work_from_album").isNotNull() & F.col("work_from_folder").isNotNull(), "work_from_both")
        .when(F.col("work_from_album").isNotNull(), "work_from_album")
        .otherwise("work_from_folder")
    )
    album = F.concat("unit_composer", F.lit(": "), "_work", F.lit(" - "), "_date", F.lit("/"), "_artist")
    return decided.select(
        *UNIT,
        F.coalesce(hold, F.lit("None")).alias("unit_hold"),
        F.when(hold.isNull(), album).alias("unit_album"),
        code.alias("unit_code"),
        F.col("_work").alias("unit_work"),
        F.col("album_min").alias("unit_first_album"),
        F.when(sole("date").isNull(), F.col("override.date")).alias("unit_override_date"),
        "n_rows",
    )
