"""Weekly tumbling aggregates and deduplication over a folder that files arrive in (2.M of the inventory: additive)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def ballot_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """The rows of the Parquet files of a folder as they arrive; of a path that is one file, that file."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    single = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)


def once(stream: DataFrame, keys: list[str], received: str, late: str = "30 days") -> DataFrame:
    """The first row of each key; state is kept for ``late`` only."""
    return stream.withWatermark(received, late).dropDuplicatesWithinWatermark(keys)


def weekly_counts(stream: DataFrame, received: str, by: list[str], late: str = "14 days") -> DataFrame:
    """Rows per week (Monday first) and ``by``; a week closes ``late`` after its end."""
    week = F.window(F.col(received), "7 days", "7 days", "4 days")
    return stream.withWatermark(received, late).groupBy(week, *by).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("semaine"), *by, "n")


def rebuild_on_arrival(stream: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Call ``rebuild`` with each micro-batch: the weekly alerts are made anew when ballots arrive. ``rebuild`` must write by batch id, so that a repeated batch changes nothing."""
    return stream.writeStream.foreachBatch(rebuild).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
