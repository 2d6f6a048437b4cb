"""Dictionary source and sink (S6, S7) and its seven tables.

Every table carries ``ord``, the position in the source list, because the first
registration of a name wins everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tagloom.schema import DICTIONARY_JSON

_NAMES = "canonical string, aliases array<string>, aliases_ja array<string>"
TABLES = {
    "composers": f"ord long, {_NAMES}",
    "persons": f"ord long, canonical string, roles array<string>, aliases array<string>, aliases_ja array<string>",
    "ensembles": (
        "ord long, entity_id string, canonical string, "
        "eras array<struct<from_year:int,until_year:int,canonical:string>>, "
        "no_era_split boolean, no_conductor boolean, aliases array<string>, aliases_ja array<string>"
    ),
    "works": f"ord long, composer string, {_NAMES}",
    "overrides": (
        "ord long, folder string, disc int, composer string, work_name string, "
        "date string, exclude boolean, note string"
    ),
    "typos": "ord long, pattern string, replacement string, note string",
    "protected": "ord long, value string",
}


@dataclass(frozen=True)
class Dictionary:
    composers: DataFrame
    persons: DataFrame
    ensembles: DataFrame
    works: DataFrame
    overrides: DataFrame
    typos: DataFrame
    protected: DataFrame
    version: int = 1

    def with_tables(self, **tables) -> "Dictionary":
        return replace(self, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "version"}


def from_rows(spark: SparkSession, version: int = 1, **tables) -> Dictionary:
    """Build a dictionary from Python rows without ``ord`` (list order is used)."""
    return Dictionary(
        version=version,
        **{
            name: local_table(spark, schema, [(i, *row) for i, row in enumerate(tables.get(name, []))])
            for name, schema in TABLES.items()
        },
    )


def local_table(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small table as a local relation, whose size Catalyst knows exactly."""
    kind = T.StructType.fromDDL(schema)

    def plain(value, t: T.DataType):
        if isinstance(t, T.StructType) and value is not None:
            return {f.name: plain(v, f.dataType) for f, v in zip(t.fields, value)}
        if isinstance(t, T.ArrayType) and value is not None:
            return [plain(v, t.elementType) for v in value]
        return value

    data = [plain(row, kind) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=to_arrow_schema(kind)), kind)


def _texts(value: Column) -> Column:
    return F.coalesce(value, F.array().cast("array<string>"))


def read_dictionary(spark: SparkSession, path: str, default_path: str | None = None) -> Dictionary:
    """One JSON object with seven lists; a missing list counts as empty.

    ``default_path`` is read when nothing lies at ``path``."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)
    if not exists and default_path is None:
        raise FileNotFoundError(path)
    source = (
        spark.read.schema(DICTIONARY_JSON)
        .option("multiLine", True)
        .option("allowComments", True)
        .json(path if exists else default_path)
    )
    version = source.select("version").head()

    def table(column: str, *columns: Column) -> DataFrame:
        return source.select(F.posexplode(column).alias("pos", "e")).select(
            F.col("pos").cast("long").alias("ord"), *columns
        )

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    canonical, aliases, aliases_ja = (
        F.col("e.canonical").alias("canonical"),
        _texts(F.col("e.aliases")).alias("aliases"),
        _texts(F.col("e.aliasesJa")).alias("aliases_ja"),
    )
    eras = F.transform(
        F.coalesce(
            F.col("e.eras"), F.array().cast("array<struct<from:int,until:int,canonical:string>>")
        ),
        lambda e: F.struct(
            e["from"].alias("from_year"), e["until"].alias("until_year"), e["canonical"].alias("canonical")
        ),
    )
    return Dictionary(
        composers=table("composers", canonical, aliases, aliases_ja),
        persons=table("persons", canonical, _texts(F.col("e.roles")).alias("roles"), aliases, aliases_ja),
        ensembles=table(
            "ensembles",
            F.col("e.entityId").alias("entity_id"),
            canonical,
            eras.alias("eras"),
            flag("e.noEraSplit").alias("no_era_split"),
            flag("e.noConductor").alias("no_conductor"),
            aliases,
            aliases_ja,
        ),
        works=table("works", F.col("e.composer").alias("composer"), canonical, aliases, aliases_ja),
        overrides=table(
            "albumOverrides",
            F.col("e.folder").alias("folder"),
            F.col("e.disc").alias("disc"),
            F.col("e.composer").alias("composer"),
            F.col("e.workName").alias("work_name"),
            F.col("e.date").alias("date"),
            flag("e.exclude").alias("exclude"),
            F.col("e.note").alias("note"),
        ),
        typos=table(
            "typos",
            F.col("e.pattern").alias("pattern"),
            F.col("e.replacement").alias("replacement"),
            F.col("e.note").alias("note"),
        ),
        protected=source.select(F.posexplode("protectedAlbumArtists").alias("pos", "value")).select(
            F.col("pos").cast("long").alias("ord"), "value"
        ),
        version=(version[0] if version and version[0] is not None else 1),
    )


# How the table columns are called in the JSON document.
_JSON_LISTS = {
    "composers": ("composers", {"canonical": "canonical", "aliases": "aliases", "aliases_ja": "aliasesJa"}),
    "persons": (
        "persons",
        {"canonical": "canonical", "roles": "roles", "aliases": "aliases", "aliases_ja": "aliasesJa"},
    ),
    "ensembles": (
        "ensembles",
        {
            "entity_id": "entityId", "canonical": "canonical", "eras": "eras",
            "no_era_split": "noEraSplit", "no_conductor": "noConductor",
            "aliases": "aliases", "aliases_ja": "aliasesJa",
        },
    ),
    "works": (
        "works",
        {"composer": "composer", "canonical": "canonical", "aliases": "aliases", "aliases_ja": "aliasesJa"},
    ),
    "overrides": (
        "albumOverrides",
        {
            "folder": "folder", "disc": "disc", "composer": "composer", "work_name": "workName",
            "date": "date", "exclude": "exclude", "note": "note",
        },
    ),
    "typos": ("typos", {"pattern": "pattern", "replacement": "replacement", "note": "note"}),
}


def dictionary_document(dictionary: Dictionary) -> DataFrame:
    """The dictionary as one JSON document, null properties left out.

    The document is one row because the format is one object; a dictionary too
    large for that is kept as the seven tables (``write_tables``)."""
    lists = []
    for name, table in dictionary.tables().items():
        if name == "protected":
            entry, label = F.struct("ord", F.col("value").alias("e")), "protectedAlbumArtists"
        else:
            label, columns = _JSON_LISTS[name]
            made = []
            for source, target in columns.items():
                column = F.col(source)
                if source == "eras":
                    column = F.transform(
                        column,
                        lambda e: F.struct(
                            e["from_year"].alias("from"), e["until_year"].alias("until"),
                            e["canonical"].alias("canonical"),
                        ),
                    )
                made.append(column.alias(target))
            entry = F.struct("ord", F.struct(*made).alias("e"))
        part = table.agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]).alias(label))
        lists.append(part.scalar().alias(label))
    one = dictionary.composers.sparkSession.range(1)
    return one.select(F.to_json(F.struct(F.lit(dictionary.version).alias("version"), *lists)).alias("value"))


def write_dictionary(dictionary: Dictionary, root: str, revision: int) -> str:
    """One revision per directory, so the previous one stays readable."""
    path = f"{root.rstrip('/')}/revision={revision}"
    dictionary_document(dictionary).coalesce(1).write.mode("errorifexists").text(path)
    return path


def write_tables(dictionary: Dictionary, root: str) -> None:
    for name, table in dictionary.tables().items():
        table.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{name}")


def read_tables(spark: SparkSession, root: str, version: int = 1) -> Dictionary:
    return Dictionary(
        version=version,
        **{
            name: spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
            for name, schema in TABLES.items()
        },
    )


def describe(dictionary: Dictionary) -> DataFrame:
    """number of entries per list."""
    parts = [
        table.agg(F.count("*").alias("entries")).select(F.lit(name).alias("list"), "entries")
        for name, table in dictionary.tables().items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("version", F.lit(dictionary.version))
