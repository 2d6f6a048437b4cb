"""Cutting lineage: checkpoints and written tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local session without one gets its own;
    on a cluster the folder must be named, as a machine's own folder does not survive it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


_SETTLED: dict[str, list[str]] = {}


def settle(df: DataFrame, name: str, by: str | None = None, records: int = 0) -> DataFrame:
    """``df`` written once as a table and read back. Catalyst then knows its size, and
    no executor's loss repeats the work. A file has at most ``records`` rows (0: any
    number). ``clear`` removes the tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(by) if by else df.write
    writer.option("maxRecordsPerFile", records).parquet(path)
    _SETTLED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of a written table that may go to all tasks as a whole, by way of the driver.
SMALL_ROWS = 20_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows as a side of a join: beyond ``SMALL_ROWS`` it is merged, as few bytes
    in files can be many rows, and fewer still by the share of its columns that is read."""
    return df.hint("merge") if rows > SMALL_ROWS else df


def settle_each(df: DataFrame, name: str, by: str, values: list[str]) -> dict[str, DataFrame]:
    """``df`` written once, and the rows of each value of ``by`` as a table of its own, so that
    Catalyst knows the size of each: a large one does not make the small ones count as large.
    One of many rows is merged in joins."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    _SETTLED.setdefault(spark.sparkContext.applicationId, []).append(path)
    schema = df.drop(by).schema
    rows = dict(spark.read.schema(df.schema).parquet(path).groupBy(by).count().collect())

    def part(value: str) -> DataFrame:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return spark.read.schema(schema).parquet(place.toString())
        return spark.createDataFrame([], schema)

    return {v: sized(part(v), rows.get(v, 0)).withColumn(by, F.lit(v)) for v in values}


def release(spark: SparkSession) -> None:
    """Lets go of plans that nothing needs any more. Their broadcasts and shuffle files stay until the
    driver collects its garbage, and its heap grows by what lies between two collections."""
    gc.collect()
    spark._jvm.System.gc()


def settle_all(spark: SparkSession, frames: Iterable[DataFrame], name: str) -> DataFrame:
    """Frames of the same columns, written one after the other and read back as one table. A frame
    is asked for when those before it are written, so the driver plans and runs one at a time."""
    paths = []
    for df in frames:
        paths.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
        df.write.option("compression", "zstd").parquet(paths[-1])
        _SETTLED.setdefault(spark.sparkContext.applicationId, []).append(paths[-1])
        schema = df.schema
        del df
        release(spark)
    return spark.read.schema(schema).parquet(*paths)


def clear(spark: SparkSession) -> None:
    """Removes the tables that ``settle`` has written in this application, an index's
    lookup among them: for the end, when nothing that was made from them is read any more."""
    for path in _SETTLED.pop(spark.sparkContext.applicationId, []):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
