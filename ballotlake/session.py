"""Sessions, table reading and the shared scratch folder."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ballotlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def command_session(master: str | None = None) -> SparkSession:
    """The session of a command: the running one, that of ``spark-submit``, one on ``master``, or else one on this machine."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    if master is None and not os.environ.get("PYSPARK_GATEWAY_PORT") and "--master" not in os.environ.get("PYSPARK_SUBMIT_ARGS", "") and not os.environ.get("MASTER"):
        return local_session()
    builder = SparkSession.builder.appName("ballotlake").config("spark.sql.session.timeZone", "UTC")
    master = master or os.environ.get("MASTER")
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder. Columns and filters reach the scan through Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only on one machine (a ``local`` master), where the setting is absent, a local one is chosen; on a cluster its absence is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if not conf and current:
        return current.rstrip("/")
    if not conf:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf = f"file:///tmp/ballotlake-{uuid.uuid4().hex}"
    if not current:
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/ballotlake/{what}-{uuid.uuid4().hex}"


#: Shuffle files of a write go once it is done, not when the driver happens to collect its garbage: what was written is read from its files.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _tidied(spark: SparkSession):
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def written(df: DataFrame, what: str, parts: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that a lost
    executor never forces the producing stages to run again. ``parts``: a column of few values by which files are laid apart."""
    spark = df.sparkSession
    path = scratch(spark, what)
    with _tidied(spark):
        (df.write.partitionBy(parts) if parts else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Number, size and last change of the files of a table: what tells whether it is still the one that was read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return (0, 0, 0)
    top = fs.getFileStatus(p)
    files = list(fs.listStatus(p)) if top.isDirectory() else [top]
    return (len(files), sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0))


_MARTS: dict[tuple, tuple[str, DataFrame]] = {}


def mart(spark: SparkSession, key: tuple, sources: list[str], build) -> DataFrame:
    """What ``build`` gives, written once in the session's shared folder and read by every later query, as long as the source tables do not change and the folder is not emptied."""
    k = (spark.sparkContext.applicationId, *key, *[fingerprint(spark, s) for s in sources])
    if k in _MARTS and fingerprint(spark, f"{_MARTS[k][0]}/_SUCCESS")[0]:
        return _MARTS[k][1]
    path, df = scratch(spark, "mart"), build()
    with _tidied(spark):
        df.write.parquet(path)
    _MARTS[k] = (path, spark.read.schema(df.schema).parquet(path))
    return _MARTS[k][1]
