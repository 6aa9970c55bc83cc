import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks.compare import connect, local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    return connect(SF)


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def plays(spark):
    """Build a play table from (userid, time, artist, track) tuples."""
    from pyspark.sql import functions as F

    def build(rows):
        df = spark.createDataFrame(
            rows, "userid string, ts string, artist_name string, track_name string"
        )
        return df.select(
            "userid",
            F.col("ts").cast("timestamp").alias("timestamp"),
            F.lit("").alias("artist_mbid"),
            "artist_name",
            F.lit("").alias("track_mbid"),
            "track_name",
        )

    return build
