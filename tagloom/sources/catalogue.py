"""Catalogue source (S1-S5): from raw tag rows to the ``tracks`` table."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagloom.functions import text as X
from tagloom.operators.lineage import cut
from tagloom.schema import FIELDS, FORMAT_BY_EXTENSION

# Raw tag name of each field per format.
RAW_NAMES = {
    "M4a": {
        "title": "©nam", "artist": "©ART", "albumartist": "aART", "composer": "©wrt",
        "conductor": "©con", "album": "©alb", "genre": "©gen",
        "date": "©day", "tracknumber": "trkn", "discnumber": "disk", "comment": "©cmt",
    },
    "Flac": {
        "title": "TITLE", "artist": "ARTIST", "albumartist": "ALBUMARTIST", "composer": "COMPOSER",
        "conductor": "CONDUCTOR", "album": "ALBUM", "genre": "GENRE", "date": "DATE",
        "tracknumber": "TRACKNUMBER", "discnumber": "DISCNUMBER", "comment": "COMMENT",
    },
    "Id3": {
        "title": "TIT2", "artist": "TPE1", "albumartist": "TPE2", "composer": "TCOM",
        "conductor": "TPE3", "album": "TALB", "genre": "TCON", "date": "TDRC",
        "tracknumber": "TRCK", "discnumber": "TPOS",
    },
}
HEX_PREFIX = "0x"
EXCLUDED_PREFIX = "backup_"
# Rows of a listing that a task holds.
LISTED_ROWS = 10_000


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(X.file_name_of(path), r"(\.[^.]*)$", 1))


def format_of(path: Column) -> Column:
    chain = None
    for extension, name in FORMAT_BY_EXTENSION.items():
        test = extension_of(path) == extension
        chain = F.when(test, name) if chain is None else chain.when(test, name)
    return chain


def is_target(path: Column, extensions: list[str] | None = None) -> Column:
    """A wanted extension, and no directory segment of a backup."""
    directories = F.split(X.folder_of(path), "/")
    backup = F.exists(directories, lambda s: F.startswith(F.lower(s), F.lit(EXCLUDED_PREFIX)))
    return extension_of(path).isin(extensions or list(FORMAT_BY_EXTENSION)) & ~backup


def decode_number_pair(values: Column) -> Column:
    """S4: '0x..' bytes to 'n/total' or 'n'; both zero drops the value."""

    def decode(v: Column) -> Column:
        digits = F.substr(v, F.lit(3))
        number = F.conv(F.substr(digits, F.lit(5), F.lit(4)), 16, 10).cast("int")
        total = F.when(
            F.length(digits) >= 12, F.conv(F.substr(digits, F.lit(9), F.lit(4)), 16, 10).cast("int")
        ).otherwise(0)
        is_pair = (
            F.startswith(v, F.lit(HEX_PREFIX))
            & digits.rlike("^[0-9A-Fa-f]{8,}$")
            & (F.length(digits) % 2 == 0)
        )
        text = (
            F.when((number == 0) & (total == 0), F.lit(None).cast("string"))
            .when(total > 0, F.concat_ws("/", number.cast("string"), total.cast("string")))
            .otherwise(number.cast("string"))
        )
        return F.when(is_pair, text).otherwise(v)

    return F.array_compact(F.transform(values, decode))


def cleanse(values: Column) -> Column:
    """Blank values go; a field without values is an empty array."""
    return F.filter(F.coalesce(values, X.no_texts()), lambda v: ~X.is_blank(v))


def canonical_fields(raw: DataFrame) -> DataFrame:
    """S3 + S4 + S5: one column per field from the raw tag map of each row.

    The names of a format are fixed, so each field is a map access inside the
    row; nothing is exploded or shuffled."""
    columns = []
    for field in FIELDS:
        chain = None
        for fmt, names in RAW_NAMES.items():
            if field in names:
                test, value = F.col("format") == fmt, F.try_element_at("raw_tags", F.lit(names[field]))
                chain = F.when(test, value) if chain is None else chain.when(test, value)
        value = F.coalesce(chain, X.no_texts())
        if field in ("tracknumber", "discnumber"):
            value = F.when(F.col("format") == "M4a", decode_number_pair(value)).otherwise(value)
        columns.append(cleanse(value).alias(field))
    return raw.select("relative_path", "full_path", "format", *columns, "raw_tags")


def scan(raw: DataFrame, extensions: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """S1-S5 over rows (relative_path, full_path, raw_tags, error): good and failed rows.

    A row without a path (a malformed line) is a failed row. Rows are not sorted here; a global sort belongs to an output (``in_path_order``)."""
    target = is_target(F.col("relative_path"), extensions) | F.col("relative_path").isNull()
    wanted = raw.filter(target).withColumn("format", format_of(F.col("relative_path")))
    unreadable = "error is not null or raw_tags is null or relative_path is null"
    failed = wanted.filter(unreadable).select(
        "relative_path", F.coalesce("error", F.lit("unreadable row")).alias("message")
    )
    good = canonical_fields(wanted.filter(f"not ({unreadable})"))
    return good, failed


RAW_JSON = (
    "relative_path string, full_path string, raw_tags map<string,array<string>>, "
    "error string, _corrupt string"
)


def read_raw_json(spark: SparkSession, path: str) -> DataFrame:
    """Metadata rows as JSON lines. A malformed line becomes a failed row."""
    rows = (
        spark.read.schema(RAW_JSON)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    return rows.select(
        "relative_path", "full_path", "raw_tags",
        F.coalesce("error", F.when(F.col("_corrupt").isNotNull(), F.concat(F.lit("malformed row: "), "_corrupt"))).alias("error"),
    )


def children(place: str) -> Iterator[tuple[str, bool]]:
    """(name, is a folder) of what lies in a folder; an unreadable folder has nothing. Links to folders are not followed."""
    if place.startswith(("file:", "/")):
        try:
            with os.scandir(place.removeprefix("file:")) as entries:
                for entry in entries:
                    if entry.is_dir(follow_symlinks=False):
                        yield entry.name, True
                    elif entry.is_file():
                        yield entry.name, False
        except (PermissionError, FileNotFoundError):
            return
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(quote(place, safe=":/"))
    for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        yield info.base_name, info.type == fs.FileType.Directory


def _listing(base: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def batch(rows: list[tuple[str, bool]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_())], names=["relative_path", "is_folder"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, bool]] = []
        for folders in batches:
            for folder in folders.column(0).to_pylist():
                for name, is_folder in children(base + folder):
                    rows.append((folder + name, is_folder))
                    if len(rows) >= LISTED_ROWS:
                        yield batch(rows)
                        rows = []
        yield batch(rows)

    return run


def list_files(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """S1 as a listing: paths below ``root``, whatever their names and sizes, without reading any content.

    Goes down level by level: tasks list the folders of a level and write what they find, and the folders among it
    are the next level. A backup folder is not entered. The driver sees only whether a level has folders."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/") + "/"
    level, files = spark.createDataFrame([("",)], "folder string"), []
    while True:
        listed = cut(level.mapInArrow(_listing(base), "relative_path string, is_folder boolean"))
        files.append(listed.filter(~F.col("is_folder") & is_target(F.col("relative_path"), extensions)))
        inner = listed.filter(F.col("is_folder") & ~F.startswith(F.lower(X.file_name_of(F.col("relative_path"))), F.lit(EXCLUDED_PREFIX)))
        if inner.isEmpty():
            break
        level = inner.select(F.concat("relative_path", F.lit("/")).alias("folder")).repartition("folder")
    found = reduce(DataFrame.unionByName, files)
    return found.select(
        "relative_path", F.concat(F.lit(base), "relative_path").alias("full_path"), format_of(F.col("relative_path")).alias("format")
    )


def normalised(tracks: DataFrame) -> DataFrame:
    """A field without values is an empty array, never null."""
    return tracks.withColumns({f: F.coalesce(f, X.no_texts()) for f in FIELDS if f in tracks.columns})


def with_derived(tracks: DataFrame) -> DataFrame:
    """P4-P6 columns used by rules and reports; null fields become empty."""
    path = F.col("relative_path")
    return normalised(tracks).withColumns(
        {
            "path_key": F.lower(X.unified_path(path)),
            "folder": X.folder_of(path),
            "folder_key": F.lower(X.folder_of(path)),
            "stem": X.stem_of(path),
            "disc": X.disc_number(X.single(F.col("discnumber"))),
            "rec_year": X.recording_year(X.single(F.col("date"))),
        }
    )


def path_order(path: str = "relative_path") -> list[Column]:
    """Path order ignoring case, made total by the path itself."""
    return [F.upper(F.col(path)), F.col(path)]


def in_path_order(df: DataFrame, path: str = "relative_path") -> DataFrame:
    return df.orderBy(*path_order(path))


def in_scope(folder_key: Column, folder: str) -> Column:
    """The folder itself or below it, ignoring case, on a separator boundary."""
    wanted = folder.replace("\\", "/").rstrip("/").lower()
    if not wanted:
        return F.lit(True)
    return (folder_key == wanted) | F.startswith(folder_key, F.lit(wanted + "/"))


def has_empty_field() -> Column:
    """Any field but free text has no value."""
    tests = [F.coalesce(F.size(f), F.lit(0)) <= 0 for f in FIELDS if f != "comment"]
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def contains_text(query: str) -> Column:
    """Path or any value contains the text, ignoring case."""
    haystack = F.concat_ws("\n", "relative_path", *FIELDS)  # skips null fields
    return F.contains(F.upper(haystack), F.upper(F.lit(query)))


def edited_only(tracks: DataFrame, edits: DataFrame) -> DataFrame:
    """Rows with at least one pending edit."""
    return tracks.join(edits.select("path_key"), "path_key", "left_semi")
