import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tagloom.schema import FIELDS, TRACK_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return session


def row(path, fmt="Flac", **fields):
    """A literal track; a field is a string or a list of strings."""
    values = [[v] if isinstance(v, str) else list(v) for v in (fields.get(f, []) for f in FIELDS)]
    return (path, "/library/" + path, fmt, *values, {})


@pytest.fixture(scope="session")
def tracks(spark):
    return lambda *rows: spark.createDataFrame(list(rows), TRACK_SCHEMA)
