"""How often two items occur in the same basket, and under the same label (J4, J5): the counting behind agreement and co-occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

#: Baskets that are counted together, one bit each.
BITS = 64
#: Shares of a task's fair load above which a routing key is spread over several tasks.
SHARES = 4


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` in several tasks for each core: for groups of little data that take long, which would otherwise be put together in a few tasks."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def numbered(rows: DataFrame, item: str, *aggs) -> DataFrame:
    """(item, num, aggregates): a number for each distinct item, written once so that it stays the same."""
    return written(rows.groupBy(item).agg(*(aggs or (F.lit(0).alias("__one"),))).withColumn("num", F.monotonically_increasing_id()), "items")


def counted_pairs(rows: DataFrame, basket: str, item: str, label: str, labels: tuple, by: tuple[str, ...] = (), block: int = 1024, tasks: int | None = None, drawn: DataFrame | None = None) -> DataFrame:
    """(by, a, b, same, both) for all pairs a < b that share a basket: baskets that hold both, and those in which both have the same label.

    ``rows`` has one row per (by, basket, item); ``item`` is a long of 0 or more; a label that is not one of ``labels`` (or null) is like no other. ``by``: columns
    to count apart. Rows without a basket or item fall away. ``drawn``: (basket, one more column of ``by``, named last): in what each basket counts; it is laid to the whole
    basket once it is made, so its rows are not shuffled as often as it is drawn.

    A basket becomes one sorted array, cut into blocks of ``block`` items; every pair of its blocks is a unit of at most ``block`` squared pairs, however large the
    basket. Units go to tasks by the smallest hash of their basket's items, so that baskets of the same items meet. A key with more than a fair part of
    all pairs is spread by a hash of the basket over as many tasks as its weight asks for, in turn, so tasks are even in size though one item is in most baskets.

    In a task up to 64 baskets of one key are laid on top of each other: an item becomes one bit set per label, and a pair of items costs
    a few ands and bit counts for all 64 instead of one row for each basket. Where baskets of a key have too little in common for that to be the
    shorter way, their bits are taken one at a time. Sums are made in the task before the shuffle.
    """
    spark = rows.sparkSession
    tasks = tasks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    kinds, names = len(labels), [*by, *([c for c in drawn.columns if c != basket] if drawn is not None else [])]
    by = [f"__by{i}" for i in range(len(names))]
    kind = F.lit(kinds)
    for i, x in enumerate(labels):
        kind = F.when(F.col(label) == x, i).otherwise(kind)
    code = (F.col(item) * (kinds + 1) + kind).alias("c")
    src = rows.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(*[F.col(n).alias(b) for n, b in zip(names, by) if n in rows.columns], F.col(basket).alias("__s"), F.xxhash64(F.col(item)).alias("__h"), code)
    often = drawn.select(F.col(basket).alias("__s"), F.col(names[-1]).alias(by[-1])) if drawn is not None else None
    units = written(_units(src, by, block, often), "units")
    placed = _placed(units, by, tasks)
    return _summed(placed, by, kinds).select(*[F.col(b).alias(n) for n, b in zip(names, by)], "a", "b", "same", "both")


def _units(src: DataFrame, by: list[str], block: int, drawn: DataFrame | None = None) -> DataFrame:
    """Pairs of blocks: ``x`` alone, or ``x`` with ``y`` of which all items come later; ``k``: the routing key."""
    baskets = src.groupBy(*[b for b in by if b in src.columns], "__s").agg(F.array_sort(F.collect_list("c")).alias("all"), F.min("__h").alias("k")).where(F.size("all") > 1)
    baskets = baskets if drawn is None else baskets.join(drawn, "__s")
    last = F.ceil(F.size("all") / F.lit(block)).cast("int") - 1
    cuts = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    part = lambda n: F.slice("all", n * block + 1, F.lit(block))
    u = baskets.select(*by, "__s", "k", "all", (last > 0).alias("cut"), F.explode(cuts).alias("at"))
    i, j = F.col("at.i"), F.col("at.j")
    return u.select(
        *by, F.xxhash64("__s").alias("s"), F.when(F.col("cut"), F.concat_ws("/", F.col("__s").cast("string"), i, j)).alias("u"),
        F.when(F.col("cut"), F.xxhash64("k", "__s", i, j)).otherwise(F.col("k")).alias("k"),
        F.when(F.col("cut"), part(i)).otherwise(F.col("all")).alias("x"), F.when(i != j, part(j)).alias("y"),
    )


def _placed(units: DataFrame, by: list[str], tasks: int) -> DataFrame:
    """Units on tasks. The keys above a fair part come to the driver: by definition at most SHARES times the number of tasks."""
    spark = units.sparkSession
    weight = F.size("x").cast("double") * F.coalesce(2.0 * F.size("y"), F.size("x").cast("double"))
    keys = written(units.groupBy("k").agg(F.sum(weight).alias("w")), "keys")
    fair = (keys.agg(F.sum("w")).first()[0] or 0.0) / (SHARES * tasks)
    heavy, at = [], 0
    for r in keys.where(F.col("w") > fair).orderBy(F.col("w").desc(), "k").collect():
        n = max(1, round(r["w"] / fair))
        heavy.append((r["k"], n, at % tasks))
        at += n
    table = F.broadcast(spark.createDataFrame(heavy, "k bigint, spread int, first int"))
    p = units.join(table, "k", "left").withColumn("salt", F.pmod("s", F.coalesce("spread", F.lit(1))).cast("int"))
    p = p.withColumn("part", F.pmod(F.coalesce(F.col("first").cast("bigint") + F.col("salt"), F.col("k")), F.lit(tasks)).cast("int"))
    return p.drop("spread", "first").repartitionById(tasks, F.col("part"))


def _summed(placed: DataFrame, by: list[str], kinds: int) -> DataFrame:
    """The counts: baskets of one key on top of each other, pairs of their items, sums."""
    keys = ["part", *by, "k", "salt", "u"]
    n = F.row_number().over(W.partitionBy(*keys).orderBy("s")) - 1
    p = placed.withColumn("n", n).withColumn("pack", F.floor(F.col("n") / BITS)).withColumn("bit", F.expr(f"shiftleft(1L, CAST(n % {BITS} AS INT))"))
    none = F.array().cast("array<bigint>")
    side = lambda c, v: F.transform(F.coalesce(F.col(c), none), lambda e: F.struct(F.lit(v).alias("side"), e.alias("c")))
    one = p.select(*keys, "pack", "bit", F.explode(F.concat(side("x", 0), side("y", 1))).alias("e"))
    one = one.select(*keys, "pack", "bit", "e.side", F.expr(f"e.c div {kinds + 1}").alias("item"), F.expr(f"e.c % {kinds + 1}").alias("kind"))
    bits = [F.bit_or(F.when(F.col("kind") == i, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(f"b{i}") for i in range(kinds)]
    items = one.groupBy(*keys, "pack", "side", "item").agg(F.bit_or("bit").alias("any"), *bits)
    them = F.struct("item", "any", *[f"b{i}" for i in range(kinds)])
    packs = items.groupBy(*keys, "pack").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == 0, them))).alias("x"), F.array_sort(F.collect_list(F.when(F.col("side") == 1, them))).alias("y"),
        F.sum(F.bit_count("any")).alias("held"), F.bit_count(F.bit_or("any")).alias("baskets"),
    )
    # laid together a pack costs the square of its items; one by one about held * held / baskets
    together = (F.size("x").cast("double") * F.size("x") * F.col("baskets") <= 2.0 * F.col("held") * F.col("held")) | (F.col("baskets") == 1)
    every = F.array(F.struct(F.col("x"), F.col("y"), F.lit(-1).cast("bigint").alias("mask")))
    single = F.expr(f"transform(sequence(0, {BITS - 1}), b -> struct(filter(x, e -> e.any & shiftleft(1L, b) != 0) AS x, filter(y, e -> e.any & shiftleft(1L, b) != 0) AS y, shiftleft(1L, b) AS mask))")
    laid = packs.select(*by, F.explode(F.when(together, every).otherwise(single)).alias("z"), (F.size("y") > 0).alias("cut")).select(*by, "z.x", "z.y", "z.mask", "cut")
    first = laid.select(*by, "x", "y", "mask", "cut", F.posexplode("x").alias("pos", "p"))
    two = first.select(*by, "mask", "p", F.explode(F.expr("IF(cut, y, slice(x, pos + 2, size(x)))")).alias("q"))
    same = F.lit(0)
    for i in range(kinds):
        same = same + F.bit_count(F.col(f"p.b{i}").bitwiseAND(F.col(f"q.b{i}")).bitwiseAND(F.col("mask")))
    both = F.bit_count(F.col("p.any").bitwiseAND(F.col("q.any")).bitwiseAND(F.col("mask")))
    pairs = two.select(*by, F.col("p.item").alias("a"), F.col("q.item").alias("b"), same.cast("bigint").alias("same"), both.cast("bigint").alias("both")).where(F.col("both") > 0)
    return pairs.groupBy(*by, "a", "b").agg(F.sum("same").alias("same"), F.sum("both").alias("both"))
