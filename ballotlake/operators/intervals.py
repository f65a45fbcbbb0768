"""Problem 3: overlapping, nested, touching and gapped intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days from 1970-01-01 to 9999-12-31, the end of an open interval.
OPEN = 2932896


def clip_to_shards(df: DataFrame, keys: list[str], start: str, end: str, shard_days: int, origin: int, horizon: int) -> DataFrame:
    """Cut intervals of day numbers at the borders of time shards: ``keys``, ``shard``, ``s``, ``e``.

    Days before ``origin`` are in the first shard and days from ``horizon`` on in the last, so that an open
    interval makes a bounded number of pieces. The borders are a matter of speed only: the result is the same.
    """
    last = (horizon - origin) // shard_days
    number = lambda c: F.least(F.greatest(F.floor((c - F.lit(origin)) / F.lit(shard_days)), F.lit(0)), F.lit(last)).cast("int")
    lo = F.lit(origin) + F.col("shard") * shard_days
    return (
        df.select(*keys, F.col(start).alias("s0"), F.col(end).alias("e0"))
        .withColumn("shard", F.explode(F.sequence(number(F.col("s0")), number(F.col("e0")))))
        .select(
            *keys, "shard",
            F.when(F.col("shard") == 0, F.col("s0")).otherwise(F.greatest("s0", lo)).cast("int").alias("s"),
            F.when(F.col("shard") == last, F.col("e0")).otherwise(F.least("e0", lo + (shard_days - 1))).cast("int").alias("e"),
        )
    )


def merge_intervals(df: DataFrame, entity: str, start: str, end: str, shard_days: int = 1461, origin: int = -10957, horizon: int = 25567) -> DataFrame:
    """Merge the intervals of each entity into periods and list the gaps between them.

    ``start`` and ``end`` are dates, both included; a null ``end`` is open; the day after an end
    continues a period. Rows without an entity or a start, or that end before they start, cover nothing. Repeated rows
    change nothing. Result: ``entity``, ``genre`` (periode or trou), ``debut``, ``fin`` as day numbers (``OPEN``: open).

    Two levels: the intervals are clipped into time shards and those of one entity and shard with the same
    start become one before the shuffle, so a group has at most as many rows as its shard has days however many
    intervals the entity has. They are merged within the shard; what touches a shard's border is then stitched to its
    neighbour and coalesced. All later steps keep the partitioning by entity.
    """
    days = df.select(F.col(entity).alias("__k"), F.unix_date(F.col(start)).alias("__s"), F.coalesce(F.unix_date(F.col(end)), F.lit(OPEN)).alias("__e"))
    days = days.where(F.col("__k").isNotNull() & F.col("__s").isNotNull() & (F.col("__e") >= F.col("__s")))
    pieces = clip_to_shards(days, ["__k"], "__s", "__e", shard_days, origin, horizon)
    pieces = pieces.groupBy("__k", "shard", "s").agg(F.max("e").alias("e"))
    local = _coalesce(pieces, ["__k", "shard"]).withColumnRenamed("shard", "__shard")
    periods = _coalesce(local, ["__k"])
    before = F.lag("e").over(W.partitionBy("__k").orderBy("s"))
    row = lambda genre, a, b: F.struct(F.lit(genre).alias("genre"), a.alias("debut"), b.alias("fin"))
    period = row("periode", F.col("s"), F.col("e"))
    return (
        periods.withColumn("b", before)
        .withColumn("x", F.explode(F.when(F.col("b").isNull(), F.array(period)).otherwise(F.array(row("trou", F.col("b") + 1, F.col("s") - 1), period))))
        .select(F.col("__k").alias(entity), "x.genre", "x.debut", "x.fin")
    )


def _coalesce(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps and islands: ``s`` and ``e`` of the longest runs within ``keys``."""
    w = W.partitionBy(*keys).orderBy("s")
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    return (
        df.withColumn("__new", F.when(F.col("s") <= reach + 1, 0).otherwise(1))
        .withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*keys, "__run")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .drop("__run")
    )
