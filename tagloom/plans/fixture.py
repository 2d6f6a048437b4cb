"""A catalogue derived from the ``orders`` table, and a small dictionary for it.

``SCALARS`` is plain SQL that means the same in Spark and in other engines, so
results can be checked side by side. It reads the whole table. The folders grow with
it, and one of them holds a third of all rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.functions import text as X
from tagloom.operators.lineage import settle, shared_dir
from tagloom.operators.lookup import Index
from tagloom.schema import FIELDS
from tagloom.sources.dictionary import Dictionary, from_rows

# A Japanese name whose Shift-JIS bytes were read as Latin-1.
MISREAD = "カラヤン".encode("cp932").decode("latin-1")

SCALARS = """
WITH comp(i, v) AS (VALUES (0,'Johannes Brahms'),(1,'Antonín Dvořák'),(2,'Anton Bruckner'),(3,'Franz Schubert'),(4,'Ludwig van Beethoven')),
seg(i, v) AS (VALUES (0,'Brahms'),(1,'Dvorak'),(2,'Bruckner'),(3,'Schubert'),(4,'Beethoven')),
jseg(i, v) AS (VALUES (0,'ブラームス'),(1,'ドヴォルザーク'),(2,'ブルックナー'),(3,'シューベルト'),(4,'名曲集')),
cvar(i, v) AS (VALUES (0,'Brahms'),(1,'Antonin Dvorak'),(2,'Bruckner, Anton'),(3,CAST(NULL AS STRING)),(4,'Clara Unknown'),(5,'Anton Bruckner; Anton Bruckner'),(6,'Franz Schubert(1797-1828)'),(7,'ベートーヴェン')),
perf(i, v) AS (VALUES (0,'Karl Böhm'),(1,'Herbert von Karajan'),(2,'Günter Wand'),(3,'Smetana Quartet'),(4,'Karl Bohm'),(5,'Peter Hurford')),
avar(i, v) AS (VALUES (0,'カラヤン'),(1,'KARAJAN Herbert'),(2,'Wiener Philharmoniker, Smetana Quartet'),(3,'Nobody Known'),(4,'Beethoven Trio'),(5,'Doe, Jane')),
ens(i, v) AS (VALUES (0,'Wiener Philharmoniker'),(1,'Vienna Philharmonic'),(2,'Leningrad Philharmonic Orchestra'),(3,'Smetana Quartet'),(4,'Münchener Bach-Chor'),(5,'Various Artists'),(6,'Beethoven'),(7,'Karajan / Berlin Ensemble'),(8,'Wiener Philharmoniker;wiener philharmoniker'),(9,'Royal Concertgebouw Orchestra'),(10,'スメタナ四重奏団')),
titles(i, v) AS (VALUES (0,'1. Allegro con brio'),(1,'2. Andante'),(2,'Finale: Allgro molto'),(3,'Track04'),(4,'I. Adagio'),(5,'Die Walkure.flac'),(6,'1-1'),(7,'Menuetto'),(8,'Tannhauser Overture'),(9,'Variations on a Theme of Haydn; Brahms'),(10,'第1楽章 Allegro'),(11,'Siegfired and Andate')),
dates(i, v) AS (VALUES (0,'1975'),(1,'1993-01-22T08:00:00Z'),(2,CAST(NULL AS STRING)),(3,'1992'),(4,'19xx')),
discs(i, v) AS (VALUES (0,'1/1'),(1,CAST(NULL AS STRING)),(2,'2/2'),(3,'1')),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 40 ELSE CAST(floor(o_custkey / 3) AS BIGINT) END AS f FROM orders)
SELECT b.k AS track_id, b.f AS f,
       concat(seg.v, '/', comp.v, ' ', CAST(b.f % 9 + 1 AS STRING), ' - ', pf.v, ' ', CAST(b.f AS STRING), '/', lpad(CAST(b.k AS STRING), 12, '0'), ' ', tt.v, '.flac') AS relative_path,
       concat(seg.v, '/', comp.v, ' ', CAST(b.f % 9 + 1 AS STRING), ' - ', pf.v, ' ', CAST(b.f AS STRING)) AS folder,
       tt.v AS title,
       CASE WHEN b.f % 2 = 1 THEN pf.v WHEN b.k % 13 = 0 THEN comp.v WHEN b.k % 17 = 0 THEN CAST(NULL AS STRING) WHEN b.k % 11 = 0 THEN av.v ELSE pf.v END AS artist,
       CASE WHEN b.f % 20 IN (5, 14) THEN 'Wiener Philharmoniker' WHEN b.f % 20 = 6 THEN 'Smetana Quartet' ELSE en.v END AS albumartist,
       CASE WHEN b.f % 4 < 2 AND b.k % 10 = 0 THEN cv.v WHEN b.f % 40 = 39 THEN CAST(NULL AS STRING) WHEN b.f % 40 = 38 THEN 'Anton Bruckner' ELSE comp.v END AS composer,
       CASE WHEN b.k % 29 = 0 THEN 'Clara Unknown' END AS composer2,
       CASE WHEN b.k % 4 = 0 THEN CAST(NULL AS STRING) ELSE pf.v END AS conductor,
       CASE WHEN b.f % 10 = 7 THEN concat(jseg.v, ' ', CAST(b.f % 9 + 1 AS STRING)) WHEN b.f % 10 = 3 THEN 'Symphony No.1' WHEN b.k % 31 = 0 THEN CAST(NULL AS STRING) ELSE concat('Symphony No.', CAST(b.f % 9 + 1 AS STRING)) END AS album,
       CASE WHEN b.k % 19 = 0 THEN CAST(NULL AS STRING) WHEN b.k % 23 = 0 THEN 'Opera' WHEN b.k % 97 = 0 THEN 'MISREAD' ELSE 'Classic' END AS genre,
       CASE WHEN b.f % 3 = 0 THEN dt.v ELSE '1975' END AS date,
       concat(CAST(b.k % 12 + 1 AS STRING), '/12') AS tracknumber,
       ds.v AS discnumber
FROM b
JOIN comp ON comp.i = b.f % 5 JOIN seg ON seg.i = b.f % 5 JOIN jseg ON jseg.i = b.f % 5
JOIN perf pf ON pf.i = b.f % 6 JOIN avar av ON av.i = b.k % 6
JOIN ens en ON en.i = b.k % 11 JOIN cvar cv ON cv.i = b.k % 8
JOIN titles tt ON tt.i = b.k % 12 JOIN dates dt ON dt.i = b.k % 5
JOIN discs ds ON ds.i = CASE WHEN b.f % 11 = 0 THEN b.k % 4 ELSE b.k % 2 END
""".replace("MISREAD", MISREAD)

COMPOSERS = [
    ("Johannes Brahms", ["Brahms", "Brahmus"], ["ブラームス"]),
    ("Antonín Dvořák", ["Dvorak"], ["ドヴォルザーク"]),
    ("Anton Bruckner", ["Bruckner"], ["ブルックナー"]),
    ("Franz Schubert", ["Schubert"], ["シューベルト"]),
    ("Ludwig van Beethoven", ["Beethoven"], ["ベートーヴェン"]),
]
PERSONS = [
    ("Karl Böhm", ["Conductor"], ["Karl Boehm", "Bohm"], ["ベーム"]),
    ("Herbert von Karajan", ["Conductor"], ["Karajan"], ["カラヤン"]),
    ("Günter Wand", ["Conductor"], ["Wand"], ["ヴァント"]),
    ("Peter Hurford", ["Soloist"], ["Hurford"], []),
]
# entity id, canonical, eras (from, until, name), no era split, no conductor, aliases, Japanese aliases
ENSEMBLES = [
    ("at-wiener-phil", "Wiener Philharmoniker", [], False, False, ["Vienna Philharmonic"], ["ウィーン・フィル"]),
    ("ru-spb-phil", None,
     [(None, 1991, "Leningrad Philharmonic Orchestra"), (1991, None, "Saint Petersburg Philharmonic Orchestra")],
     False, False, ["Leningrad Philharmonic"], []),
    ("nl-concertgebouw", "Concertgebouworkest", [], True, False, ["Royal Concertgebouw Orchestra"], []),
    ("cz-smetana-quartet", "Smetana Quartet", [], False, True, [], ["スメタナ四重奏団"]),
    ("de-muenchener-bach-chor", "Münchener Bach-Chor", [], False, False, [], []),
]
WORKS = [
    (c, f"Symphony No. {n}", [f"{c} {n}"], []) for c, _, _ in COMPOSERS for n in range(1, 10)
]
TYPOS = [
    (r"\bAllgro\b", "Allegro", "term"),
    (r"\bAndate\b", "Andante", "term"),
    (r"\bSiegfired\b", "Siegfried", "name"),
    (r"\bBrahmus\b", "Brahms", "name"),
]
PROTECTED = ["Various Artists"]


def folder_name(f: int) -> str:
    composers, performers = [c[0] for c in COMPOSERS], [
        "Karl Böhm", "Herbert von Karajan", "Günter Wand", "Smetana Quartet", "Karl Bohm", "Peter Hurford",
    ]
    seg = ["Brahms", "Dvorak", "Bruckner", "Schubert", "Beethoven"][f % 5]
    return f"{seg}/{composers[f % 5]} {f % 9 + 1} - {performers[f % 6]} {f}"


# folder, disc, composer, work name, date, exclude, note
OVERRIDES = [
    (folder_name(12), None, None, None, None, True, "collection"),
    (folder_name(3), None, None, None, "1975", False, "year of the main work"),
    (folder_name(9), None, None, None, "1975", False, "year of the main work"),
    (folder_name(13), None, None, "Symphony No. 9", None, False, "named by hand"),
    (folder_name(21), None, "Antonín Dvořák", None, None, False, "main composer"),
    (folder_name(33), 2, None, None, "1992", False, "second disc"),
    (folder_name(33), None, None, None, "1975", False, "all discs"),
]


def fixture_dictionary(spark: SparkSession, **changes) -> Dictionary:
    tables = dict(
        composers=COMPOSERS, persons=PERSONS, ensembles=ENSEMBLES, works=WORKS, overrides=OVERRIDES,
        typos=TYPOS, protected=[(p,) for p in PROTECTED],
    )
    tables.update(changes)
    return from_rows(spark, **tables)


_INDEXES: dict[tuple, Index] = {}


def fixture_index(spark: SparkSession) -> Index:
    """One index per application: the dictionary is the same for every query."""
    key = (spark.sparkContext.applicationId,)
    if key not in _INDEXES:
        _INDEXES[key] = Index.build(fixture_dictionary(spark))
    return _INDEXES[key]


_ROWS: dict[tuple, DataFrame] = {}


def fixture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``SCALARS`` with lists of values, written once per application and folder as a
    catalogue is: in files, so that a scan is dealt to tasks whatever the splits of the orders,
    and no scan makes the lists again. The keys of the orders are dealt to all cores first, as one
    file of them is few splits."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ROWS:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
        dealt = orders.repartition(spark.sparkContext.defaultParallelism)
        rows = spark.sql(SCALARS.replace("FROM orders", "FROM {orders}"), orders=dealt)
        lists = {f: F.array_compact(F.array(f)) for f in FIELDS if f not in ("composer", "comment")}
        lists["composer"] = F.array_compact(F.array("composer", "composer2"))
        lists["comment"] = X.no_texts()
        tracks = rows.select("track_id", "relative_path", *[lists[f].alias(f) for f in FIELDS])
        _ROWS[key] = settle(tracks, "catalogue", records=20_000)
    return _ROWS[key]


def fixture_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture_rows(spark, sf_dir).select(
        "relative_path",
        F.concat(F.lit("/library/"), "relative_path").alias("full_path"),
        F.lit("Flac").alias("format"),
        *FIELDS,
        F.map_from_entries(F.array().cast("array<struct<k:string,v:array<string>>>")).alias("raw_tags"),
    )


def fixture_snapshot(tracks: DataFrame) -> DataFrame:
    """An earlier state of the catalogue: some rows not there yet, some genres other."""
    k = F.regexp_extract("relative_path", r"/(\d{12}) [^/]*$", 1).cast("long")
    genre = F.when(k % 37 == 0, F.array(F.lit("Old"))).otherwise(F.col("genre"))
    return tracks.filter(k % 31 != 0).withColumn("genre", genre)


def fixture_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of manual edits, one or two per row: changes, repeats, clears, resets."""
    rows = fixture_rows(spark, sf_dir)
    return rows.selectExpr(
        "relative_path",
        """inline(array(
          struct(track_id * 2 AS seq, array('genre', 'artist', 'date', 'albumartist', 'discnumber')[track_id % 5] AS field,
            array('Classic', ' Karl Böhm ', NULL, 'カラヤン', '1-1', 'Brahms', 'New; Name')[track_id % 7] AS value,
            IF(track_id % 2 = 0, 3, 1) AS bulk_size),
          struct(track_id * 2 + 1 AS seq, IF(track_id % 3 = 0, NULL, IF(track_id % 3 = 1, 'genre', 'composer')) AS field,
            IF(track_id % 9 = 4, NULL, 'Classic') AS value, 1 AS bulk_size)))""",
    )


def fixture_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of empty files, one for each supplier, made by tasks below the shared folder."""
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").selectExpr(
        """CASE s_suppkey % 7 WHEN 0 THEN 'a/_New/' WHEN 1 THEN 'a/.h' WHEN 2 THEN 'b/Backup_x/' WHEN 3 THEN '_' WHEN 4 THEN 'b/c/' WHEN 5 THEN 'b/c/d e/' ELSE '' END
           || s_suppkey || CASE s_suppkey % 7 WHEN 1 THEN '.m4a' WHEN 3 THEN '.mp3' WHEN 4 THEN '.txt' WHEN 5 THEN '.FLAC' WHEN 6 THEN '.aiff' ELSE '.flac' END AS name"""
    )
    root = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"

    def touch(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if ":" in root else (fs.LocalFileSystem(), root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                system.open_output_stream(f"{base}/{name}").close()
            yield batch

    names.mapInArrow(touch, "name string").write.format("noop").mode("overwrite").save()
    return root


def fixture_versions(spark: SparkSession) -> str:
    """A new place for a written version below the shared folder."""
    return f"{shared_dir(spark)}/version-{uuid.uuid4().hex}"


def fixture_decisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Unknown values, and a decision for each customer with typical faults."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS k")
    category = "CASE k % 3 WHEN 0 THEN 'composer' WHEN 1 THEN 'person' ELSE 'ensemble' END"
    unknown = customers.selectExpr("'Va ' || (k % 800) AS value", f"{category} AS category").groupBy("value", "category").agg(F.count("*").alias("n_paths"))
    decisions = customers.selectExpr(
        "CAST(k AS LONG) AS seq", "'Va ' || (k % 900) AS value", f"{category} AS category",
        "CASE WHEN k % 5 = 0 THEN 'new' WHEN k % 25 = 1 THEN NULL ELSE 'alias' END AS action",
        """CASE WHEN k % 7 = 0 THEN ' ' WHEN k % 11 = 0 THEN 'Nobody' WHEN k % 3 = 0 THEN 'Ca ' || substr(md5(CAST(k % 1300 AS STRING)), 1, 10)
           WHEN k % 3 = 1 THEN 'Pe ' || md5(CAST(k % 120 AS STRING)) ELSE 'En ' || md5(CAST(k % 2000 AS STRING)) END AS target""",
        "CASE WHEN k % 13 = 0 THEN ' ' ELSE 'New ' || (k % 400) END AS canonical",
        "CASE WHEN k % 17 = 0 THEN NULL ELSE 'n' || (k % 300) END AS entity_id",
        "CASE WHEN k % 4 = 0 THEN CAST(array() AS ARRAY<STRING>) ELSE array('Soloist') END AS roles",
    )
    return unknown, decisions


def derived_dictionary(spark: SparkSession, sf_dir: str, bundled: bool = True) -> Dictionary:
    """A dictionary as large as the tables it is derived from, with typical faults.
    The user's form (``bundled`` False) lacks a third of the entries and some aliases."""

    def read(table: str, *columns: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)

    def part(df: DataFrame) -> DataFrame:
        return df if bundled else df.filter("ord % 3 <> 0")

    second = "'AL-' || substr(md5(CAST(k % 1200 AS STRING)), 1, 8)" if bundled else "'Al ' || substr(md5(CAST(k % 1100 AS STRING)), 1, 8)"
    composers = read("customer", "c_custkey").selectExpr("c_custkey AS k").selectExpr(
        "CAST(k AS LONG) AS ord", "'Ca ' || substr(md5(CAST(k % 1300 AS STRING)), 1, 10) AS canonical",
        f"array({second}, upper('Ca ' || substr(md5(CAST(k % 1300 AS STRING)), 1, 10)), 'Ca' || substr(md5(CAST(k % 1300 AS STRING)), 1, 10)) AS aliases",
        "CAST(array() AS ARRAY<STRING>) AS aliases_ja",
    )
    persons = read("supplier", "s_suppkey").selectExpr("s_suppkey AS k").selectExpr(
        "CAST(k AS LONG) AS ord", "'Pe ' || md5(CAST(k AS STRING)) AS canonical",
        "CASE WHEN k % 5 = 0 THEN CAST(array() AS ARRAY<STRING>) WHEN k % 7 = 0 THEN array('Dancer') ELSE array('Conductor') END AS roles",
        "array('AL-' || substr(md5(CAST(k AS STRING)), 1, 8)) AS aliases", "CAST(array() AS ARRAY<STRING>) AS aliases_ja",
    )
    ensembles = read("part", "p_partkey").selectExpr("p_partkey AS k").selectExpr(
        "CAST(k AS LONG) AS ord", "'e' || CAST(k % 1900 AS STRING) AS entity_id",
        "CASE WHEN k % 3 = 0 THEN NULL ELSE 'En ' || md5(CAST(k AS STRING)) END AS canonical",
        """CASE WHEN k % 4 <> 0 THEN CAST(array() AS ARRAY<STRUCT<from_year: INT, until_year: INT, canonical: STRING>>)
           ELSE array(struct(CAST(NULL AS INT) AS from_year, 1950 AS until_year, 'Ea ' || md5(CAST(k AS STRING)) AS canonical),
                      struct(1940 + CAST(k % 3 AS INT) * 10 AS from_year, CAST(NULL AS INT) AS until_year, 'Eb ' || md5(CAST(k AS STRING)) AS canonical)) END AS eras""",
        "k % 5 = 0 AS no_era_split", f"k % 11 = 0 AND {str(bundled).lower()} AS no_conductor",
        "CAST(array() AS ARRAY<STRING>) AS aliases", "CAST(array() AS ARRAY<STRING>) AS aliases_ja",
    )
    works = read("part", "p_partkey").selectExpr("p_partkey AS k").selectExpr(
        "CAST(k AS LONG) AS ord",
        """CASE WHEN k % 50 = 1 THEN 'Cb ' || substr(md5(CAST(k % 1300 AS STRING)), 1, 10)
           WHEN k % 50 = 2 THEN 'Nobody ' || md5(CAST(k AS STRING)) ELSE 'Ca ' || substr(md5(CAST(k % 1300 AS STRING)), 1, 10) END AS composer""",
        "CASE WHEN k % 60 = 0 THEN '' ELSE 'Opus ' || CAST(k % 4 AS STRING) END AS canonical",
        "array('op' || CAST(k % 6 AS STRING), 'OPUS' || CAST(k % 4 AS STRING)) AS aliases", "CAST(array() AS ARRAY<STRING>) AS aliases_ja",
    )
    overrides = read("orders", "o_orderkey").selectExpr("o_orderkey AS k").selectExpr(
        "CAST(k AS LONG) AS ord", "CASE WHEN k % 100 = 0 THEN '' ELSE 'f/' || CAST(k AS STRING) END AS folder", "CAST(NULL AS INT) AS disc",
        "CASE WHEN k % 4 = 0 THEN 'X' END AS composer", "CAST(NULL AS STRING) AS work_name",
        "CASE WHEN k % 6 = 0 THEN '19xx' WHEN k % 6 = 1 THEN '1990' END AS date", "k % 9 = 0 AS exclude",
        "CASE WHEN k % 7 = 0 THEN '' ELSE 'note' END AS note",
    )
    typos = read("nation", "n_nationkey").selectExpr(
        "CAST(n_nationkey AS LONG) AS ord", "CASE WHEN n_nationkey % 8 = 0 THEN '(' || CAST(n_nationkey AS STRING) ELSE 'x' || CAST(n_nationkey AS STRING) END AS pattern",
        "CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'y' END AS replacement", "'' AS note",
    )
    protected = read("supplier", "s_suppkey").selectExpr(
        "CAST(s_suppkey AS LONG) AS ord", "CASE WHEN s_suppkey % 40 = 0 THEN '!!' ELSE 'Pr ' || CAST(s_suppkey % 80 AS STRING) END AS value"
    )
    return Dictionary(
        composers=part(composers), persons=part(persons), ensembles=part(ensembles), works=works, overrides=overrides,
        typos=part(typos), protected=part(protected), version=2 if bundled else 1,
    )
