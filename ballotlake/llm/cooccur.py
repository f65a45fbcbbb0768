"""Problem 6: how often items occur together, and how much more often than chance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pairs import counted_pairs, numbered


def last_labels(rows: DataFrame, basket: str, item: str, label: str, received: str) -> DataFrame:
    """(basket, item, label): items once per basket, with the label received last (the greater one on a tie). Rows without a basket or item fall away.

    ``label`` is a whole number from 0 to 6 or null. Time and label travel as one long, so the sum is a hash aggregation that combines before the shuffle.
    """
    kept = rows.where(F.col(basket).isNotNull() & F.col(item).isNotNull())
    at = F.coalesce(F.unix_micros(F.col(received).cast("timestamp")), F.lit(-(1 << 58)))
    code = at * 8 + F.coalesce(F.col(label).cast("bigint") + 1, F.lit(0))
    last = kept.groupBy(basket, item).agg(F.max(code).alias("__x"))
    found = F.pmod("__x", F.lit(8)) - 1
    return last.select(basket, item, F.when(found >= 0, found).cast("int").alias(label))


def marginals(ballots: DataFrame, item: str, label: str, labels: tuple, min_same: int = 0) -> DataFrame:
    """(item, num, n0, n1, ...): a number for each item and how often it takes each label.

    Items in fewer than ``min_same`` baskets can reach no pair of that many and are left out (exact).
    """
    counts = [F.count_if(F.col(label) == x).alias(f"n{i}") for i, x in enumerate(labels)]
    return numbered(ballots, item, *counts, F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_same).drop("__n")


def together(ballots: DataFrame, items: DataFrame, basket: str, item: str, label: str, labels: tuple, min_same: int = 0) -> DataFrame:
    """(a, b, same, both) for pairs a < b of item numbers that share a basket: baskets in which both occur, and with the same label.

    ``ballots`` has one row per (basket, item), as from :func:`last_labels`; ``items`` is from :func:`marginals`. A label that is null is like no other.
    Ordered pairs are emitted and summed in the task before the shuffle by :func:`~ballotlake.operators.pairs.counted_pairs`.
    """
    rows = ballots.join(items.select(item, "num"), item).select(basket, "num", label)
    return counted_pairs(rows, basket, "num", label, labels).where(F.col("same") >= min_same)


def lift(pairs: DataFrame, items: DataFrame, item: str, labels: int) -> DataFrame:
    """Name the pairs (``item_a`` < ``item_b``) and add ``chance`` (expected ``same`` if each item took its labels at its own shares in the ``both`` baskets), ``lift`` and ``pmi``.

    ``num`` and ``den`` are the same ratio as whole numbers, lift = same * den / (both * num), for comparisons without rounding.
    """
    a = items.select(F.col("num").alias("a"), F.col(item).alias("__ia"), *[F.col(f"n{i}").alias(f"x{i}") for i in range(labels)])
    b = items.select(F.col("num").alias("b"), F.col(item).alias("__ib"), *[F.col(f"n{i}").alias(f"y{i}") for i in range(labels)])
    total = lambda s: sum((F.col(f"{s}{i}") for i in range(1, labels)), F.col(f"{s}0"))
    num = sum((F.col(f"x{i}") * F.col(f"y{i}") for i in range(1, labels)), F.col("x0") * F.col("y0"))
    j = pairs.join(a, "a").join(b, "b").withColumn("num", num).withColumn("den", total("x") * total("y"))
    j = j.withColumn("chance", F.col("both") * F.col("num") / F.nullif("den", F.lit(0)))
    ratio = F.when(F.col("num") > 0, F.col("same") * F.col("den") / (F.col("both") * F.col("num")))
    pmi = F.when(ratio > 0, F.log2(ratio))
    return j.select(F.least("__ia", "__ib").alias("item_a"), F.greatest("__ia", "__ib").alias("item_b"), "same", "both", "num", "den", "chance", ratio.alias("lift"), pmi.alias("pmi"))
