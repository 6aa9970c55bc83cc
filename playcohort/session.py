"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Hours and weekdays are read off UTC instants. Joins on a user or an artist may meet a
# key that holds a large share of the rows: AQE then splits that partition, even where
# the following aggregate needs one more exchange because of it. Shuffles are cut fine and put
# together again by size, so that a task sorts or aggregates about 16 MB of shuffled rows in
# memory. At that size each shuffle may reach 10 GB; more parts would compress worse. Files are
# read 32 MB at a time: a stored roll-up is packed well, and a task that combines its rows before a
# shuffle holds a group for nearly every row it reads.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "640",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators count on to an existing session."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app_name: str = "playcohort", master: str | None = None, conf: dict[str, str] | None = None
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    # Call sites in error messages cost several round trips per column expression.
    options = {"spark.python.sql.dataFrameDebugging.enabled": "false", **RUNTIME_CONF}
    for key, value in {**options, **(conf or {})}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


_local_base: dict[str, str] = {}
_on_release: list[Callable[[], None]] = []


def on_release(forget: Callable[[], None]) -> Callable[[], None]:
    """Have ``forget`` called when scratch tables are deleted, by whatever remembers some."""
    _on_release.append(forget)
    return forget


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's scratch tables."""
    return f"{_scratch_base(spark)}/playcohort-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete the scratch tables of this application. DataFrames that still read them, and
    whatever was returned lazily, cannot be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for forget in _on_release:
        forget()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store Spark reads the path from."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path in this application's run folder; ``release`` removes them all."""
    return f"{run_folder(spark)}/{uuid.uuid4().hex}"


def _scratch_base(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only by a local master without that setting; on a
    cluster the setting is required, since executors do not share a local disk.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        app = sc.applicationId
        base = _local_base[app] = _local_base.get(app) or tempfile.mkdtemp(prefix="playcohort-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def staged(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """The rows as a written table in the scratch folder.

    For a roll-up that several later steps read: it is computed once, each reader fetches
    only its columns, and a lost executor costs a re-read instead of a recomputation.
    """
    path = scratch_dir(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, for loops whose plan would otherwise grow every round."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)
