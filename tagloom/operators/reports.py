"""Catalogue reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tagloom.functions import text as X
from tagloom.operators.lookup import Index
from tagloom.operators.units import album_units
from tagloom.schema import FIELDS
from tagloom.sources.catalogue import with_derived

NO_VALUE = "-"


def folder_tree(tracks: DataFrame) -> DataFrame:
    """Number of files at and below every folder, the root as ''.

    Files are counted per folder first; only folders are expanded to ancestors."""
    per_folder = with_derived(tracks).groupBy("folder").agg(F.count("*").alias("n"))
    parts = F.filter(F.split("folder", "/"), lambda s: s != "")
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    return (
        per_folder.select(F.explode(ancestors).alias("folder"), "n")
        .groupBy("folder")
        .agg(F.sum("n").alias("n_files"))
    )


def library_stats(tracks: DataFrame) -> DataFrame:
    """One row of counts over the whole table."""
    multiple = F.lit(False)
    semicolon = F.lit(False)
    for f in FIELDS:
        multiple = multiple | X.has_multiple(F.col(f))
        semicolon = semicolon | F.exists(f, lambda v: F.contains(v, F.lit(";")))
    return tracks.agg(
        F.count("*").alias("n_tracks"),
        *[F.count_if(F.size(f) == 0).alias(f"missing_{f}") for f in FIELDS if f != "comment"],
        F.count_if(multiple).alias("multi_value_rows"),
        F.count_if(semicolon).alias("semicolon_rows"),
        F.count_if(F.map_contains_key("raw_tags", F.lit("cond"))).alias("wrong_conductor_key"),
    )


def format_counts(tracks: DataFrame) -> DataFrame:
    """G6."""
    return tracks.groupBy("format").agg(F.count("*").alias("n_tracks"))


def report_units(tracks: DataFrame, index: Index) -> DataFrame:
    """Units as the reports see them: raw dates, ensembles by entity id."""
    return album_units(with_derived(tracks), index, albumartist=True, raw_date=True)


def inventory(units: DataFrame) -> DataFrame:
    """One row of totals."""
    folders = units.groupBy(F.lower("folder").alias("folder_key")).agg(
        F.count("*").alias("n_units"), F.sum("n_tracks").alias("n_files")
    )
    several = F.col("n_units") > 1
    return folders.agg(
        F.sum("n_files").alias("files"),
        F.count("*").alias("folders"),
        F.sum("n_units").alias("units"),
        F.count_if(several).alias("multi_disc_folders"),
        F.coalesce(F.sum(F.when(several, F.col("n_units"))), F.lit(0)).alias("units_below"),
        F.coalesce(F.sum(F.when(several, F.col("n_files"))), F.lit(0)).alias("files_below"),
    )


def multi_disc_folders(units: DataFrame) -> DataFrame:
    """Folders with several discs and their disc list."""
    return (
        units.groupBy(F.lower("folder").alias("folder_key"))
        .agg(
            F.min("folder").alias("folder"),
            F.count("*").alias("n_units"),
            F.sum("n_tracks").alias("n_files"),
            F.array_join(F.transform(F.array_sort(F.collect_set("disc")), lambda d: d.cast("string")), ", ").alias("discs"),
        )
        .filter("n_units > 1")
        .drop("folder_key")
    )


COHERENCE_FIELDS = [
    ("composer", "composers"), ("date", "dates"), ("artist", "artists"),
    ("albumartist", "albumartists"), ("album", "albums"),
]


def coherence(units: DataFrame) -> DataFrame:
    """Units with none, one, or several values per field."""
    entries = [F.struct(F.lit(n).alias("field"), F.size(c).alias("n")) for n, c in COHERENCE_FIELDS]
    return (
        units.select(F.inline(F.array(*entries)))
        .groupBy("field")
        .agg(
            F.count_if(F.col("n") == 0).alias("none"),
            F.count_if(F.col("n") == 1).alias("one"),
            F.count_if(F.col("n") >= 2).alias("several"),
        )
    )


def split_units(units: DataFrame, column: str) -> DataFrame:
    """G8 details: units that hold several values of a column."""
    return units.filter(F.size(column) >= 2).select(
        "folder", "disc", "n_tracks", F.array_join(column, " / ").alias("values")
    )


def dateless_units(units: DataFrame) -> DataFrame:
    return units.filter(F.size("dates") == 0).select(
        "folder", "disc", "n_tracks", joined("composers").alias("composer"), joined("artists").alias("artist")
    )


def joined(column: str) -> Column:
    """The single value, the values joined by '+', or a dash."""
    return F.when(F.size(column) == 0, NO_VALUE).otherwise(F.array_join(column, "+"))


def collision_candidates(units: DataFrame) -> DataFrame:
    """(composer, artist, date) that several units share.

    The members are a relation of their own (``collision_members``): a popular
    triple may cover many units."""
    single = units.filter("size(composers) = 1 and size(artists) = 1 and size(dates) = 1")
    return (
        single.groupBy(
            F.col("composers")[0].alias("composer"), F.col("artists")[0].alias("artist"), F.col("dates")[0].alias("date")
        )
        .agg(F.count("*").alias("n_units"), F.sum("n_tracks").alias("n_files"))
        .filter("n_units >= 2")
    )


def collision_members(units: DataFrame) -> DataFrame:
    single = units.filter("size(composers) = 1 and size(artists) = 1 and size(dates) = 1").select(
        F.col("composers")[0].alias("composer"), F.col("artists")[0].alias("artist"), F.col("dates")[0].alias("date"),
        "folder", "disc", "n_tracks",
    )
    keys = collision_candidates(units).select("composer", "artist", "date")
    return single.join(keys, ["composer", "artist", "date"])


def merged_groups(units: DataFrame) -> DataFrame:
    """How many (composer, album) groups would merge without artist and date."""
    return (
        units.filter("size(composers) = 1 and size(albums) = 1")
        .groupBy(F.col("composers")[0].alias("c"), F.col("albums")[0].alias("a"))
        .agg(F.count("*").alias("n"))
        .agg(F.count_if(F.col("n") >= 2).alias("merged_groups"))
    )


def ensembles_with_artists(units: DataFrame) -> DataFrame:
    """Ensembles that several artists appear with. Pairs first, then names."""
    pairs = (
        units.filter("size(albumartists) = 1")
        .groupBy(F.col("albumartists")[0].alias("ensemble"), joined("artists").alias("artist"))
        .agg(F.count("*").alias("n"))
    )
    return (
        pairs.groupBy("ensemble")
        .agg(F.sum("n").alias("n_units"), F.array_sort(F.collect_list("artist")).alias("a"))
        .filter(F.size("a") >= 2)
        .select("ensemble", "n_units", F.array_join("a", " / ").alias("artists"))
    )


def artists_with_dates(units: DataFrame) -> DataFrame:
    """(artist, ensemble) pairs that only the year tells apart."""
    triples = (
        units.filter("size(albumartists) = 1 and size(artists) = 1")
        .groupBy(
            F.col("albumartists")[0].alias("ensemble"), F.col("artists")[0].alias("artist"), joined("dates").alias("date")
        )
        .agg(F.count("*").alias("n"))
    )
    return (
        triples.groupBy("ensemble", "artist")
        .agg(F.sum("n").alias("n_units"), F.array_sort(F.collect_list("date")).alias("d"))
        .filter(F.size("d") >= 2)
        .select("ensemble", "artist", "n_units", F.array_join("d", " / ").alias("dates"))
    )
