"""Problem 5: events with the attributes known at their time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import OPEN, clip_to_shards


def known_spans(versions: DataFrame, record: str, received: str, start: str, end: str, tie: list[str]) -> DataFrame:
    """For each version of a record, the days on which it is the one known and covers the day: ``lo``..``hi``.

    A version is known from the day of its receipt to the day before the next version's; of
    several received on one day the last counts (ties of the time by ``tie``). ``start``/``end`` are dates, a null
    end is open. Versions without a record, receipt or start, and empty spans, are left out - but they do
    replace the versions before them. Columns named lo and hi are replaced.
    """
    w = W.partitionBy(record).orderBy(F.col(received), *[F.col(c) for c in tie])
    known = F.unix_date(F.to_date(received))
    return (
        versions.where(F.col(record).isNotNull() & F.col(received).isNotNull())
        .withColumn("__next", F.lead(known).over(w))
        .withColumn("lo", F.greatest(known, F.unix_date(start)))
        .withColumn("hi", F.least(F.coalesce(F.unix_date(end), F.lit(OPEN)), F.coalesce(F.col("__next") - 1, F.lit(OPEN))))
        .where(F.col(start).isNotNull() & (F.coalesce(F.unix_date(end), F.lit(OPEN)) >= F.unix_date(start)) & (F.col("lo") <= F.col("hi")))
        .drop("__next")
    )


def attribute_changes(spans: DataFrame, entity: str, value: str, priority: list[str], shard_days: int, origin: int, horizon: int) -> DataFrame:
    """Changes of the best known value of each entity: ``entity``, ``shard``, ``day``, ``value`` (null: none from here on).

    Of the spans that hold on a day the one highest in ``priority`` (then in ``value``) is best. The spans are
    clipped to time shards, and those of one entity with the same days become one first, so that a
    group is bounded by the days of its shard, not by its number of spans.
    """
    best = F.struct(*[F.col(c).alias(f"p{i}") for i, c in enumerate([*priority, value])])
    cut = clip_to_shards(spans.select(entity, best.alias("best"), "lo", "hi"), [entity, "best"], "lo", "hi", shard_days, origin, horizon)
    cut = cut.groupBy(entity, "shard", "s", "e").agg(F.max("best").alias("best"))
    bounds = cut.select(entity, "shard", F.explode(F.array(F.col("s"), F.col("e") + 1)).alias("day")).distinct()
    a, b = bounds.alias("a"), cut.alias("b")
    holds = (F.col(f"a.{entity}") == F.col(f"b.{entity}")) & (F.col("a.shard") == F.col("b.shard")) & F.col("a.day").between(F.col("b.s"), F.col("b.e"))
    return (
        a.join(b, holds, "left")
        .groupBy(F.col(f"a.{entity}").alias(entity), F.col("a.shard").alias("shard"), F.col("a.day").alias("day"))
        .agg(F.max("b.best").alias("best"))
        .select(entity, "shard", "day", F.col(f"best.p{len(priority)}").alias("value"))
    )


def spread_entities(weights: DataFrame, entity: str, tasks: int, shares: int = 4) -> DataFrame | None:
    """(__k, __spread): the entities with more than a fair part of all events, and over how many parts each goes. At most ``shares`` times ``tasks`` of them can be, so they may be broadcast; None if there is none.

    ``weights``: (entity, n), the number of events of each entity.
    """
    spark = weights.sparkSession
    total = weights.agg(F.sum("n")).first()[0] or 0
    fair = max(1.0, total / (shares * tasks))
    heavy = weights.where((F.col("n") > F.lit(fair)) & F.col(entity).isNotNull()).select(entity, "n").collect()
    rows = [(r[0], int(-(-r[1] // fair))) for r in heavy]
    return None if not rows else F.broadcast(spark.createDataFrame(rows, f"__k {weights.schema[entity].dataType.simpleString()}, __spread int"))


def with_known_value(
    events: DataFrame, spans: DataFrame, entity: str, day: str, value: str, priority: list[str], shard_days: int = 731, origin: int = 10957, horizon: int = 25567, keep_unplaced: bool = True, weights: DataFrame | None = None, tasks: int | None = None
) -> DataFrame:
    """Add ``value``_connu to each event: the entity's value that was known and held on the event's day.

    Events and attribute changes are united, sorted by entity and day - a change before an event of the same day -
    and the last change is carried forward. A change to "none" is carried forward too. Events without an entity or day
    get null (or, without ``keep_unplaced``, no row); events are otherwise neither dropped nor repeated. ``day`` is a date, ``value`` any type. The sort is within (entity, time shard), and
    no shard needs the one before it, since spans are clipped. An entity with more than a fair part of all events is also spread by a hash of the event; its changes,
    of which there are no more than days, go along to every part. ``weights`` has the number of events of each entity (entity, n), where it can be had for less than
    from the events. The result keeps that partitioning (columns ``__shard`` and ``__part``), so that a later grouping by entity, shard, part and more needs no shuffle. A column that is named like the result is replaced.
    """
    spark = events.sparkSession
    last = (horizon - origin) // shard_days
    changes = attribute_changes(spans, entity, value, priority, shard_days, origin, horizon)
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spread = spread_entities(events.groupBy(entity).agg(F.count(F.lit(1)).alias("n")) if weights is None else weights, entity, tasks)
    d = F.unix_date(F.col(day))
    shard = F.least(F.greatest(F.floor((d - F.lit(origin)) / F.lit(shard_days)), F.lit(0)), F.lit(last)).cast("int")
    others = [c for c in events.columns if c not in (entity, day, f"{value}_connu")]
    left = events.select(F.col(entity).alias("__k"), shard.alias("__shard"), d.alias("__d"), F.lit(1).alias("__prio"), *[F.col(f"`{c}`") for c in others])
    parts = F.coalesce(F.col("__spread"), F.lit(1))
    part = F.pmod(F.xxhash64("__d", *[F.col(f"`{c}`") for c in others]), parts).cast("int")
    left = left.withColumn("__part", F.lit(0)) if spread is None else left.join(spread, "__k", "left").withColumn("__part", part).drop("__spread")
    known = F.col("__k").isNotNull() & F.col("__d").isNotNull()
    right = changes.select(F.col(entity).alias("__k"), F.col("shard").alias("__shard"), F.col("day").alias("__d"), F.lit(0).alias("__prio"), F.struct(F.col("value").alias("v")).alias("__c"))
    right = right.withColumn("__part", F.lit(0)) if spread is None else right.join(spread, "__k", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__spread")
    both = left.where(known).unionByName(right, allowMissingColumns=True)
    w = W.partitionBy("__k", "__shard", "__part").orderBy("__d", "__prio").rowsBetween(W.unboundedPreceding, 0)
    carried = both.withColumn("__v", F.last("__c", ignorenulls=True).over(w)["v"]).where(F.col("__prio") == 1).drop("__c")
    rest = left.where(~known).withColumn("__v", F.lit(None).cast(right.schema["__c"].dataType["v"].dataType))
    named = lambda x: x.select(F.col("__k").alias(entity), F.date_from_unix_date("__d").alias(day), *others, F.col("__v").alias(f"{value}_connu"), "__shard", "__part")
    return named(carried).unionByName(named(rest)) if keep_unplaced else named(carried)
