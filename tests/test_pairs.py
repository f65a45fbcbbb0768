"""Pair counting: brute force at every block size, the evenness of tasks, and baskets of any size."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ballotlake.operators import agreement, pairs


def brute(rows):
    baskets, both, same = {}, Counter(), Counter()
    for *b, i, p in rows:
        if b[-1] is not None and i is not None:
            baskets.setdefault(tuple(b), {})[i] = p
    for key, x in baskets.items():
        for a, b in combinations(sorted(x), 2):
            k = (*key[:-1], a, b)
            both[k] += 1
            same[k] += x[a] is not None and x[a] in (0, 1, 2) and x[a] == x[b]
    return {k: (same[k], both[k]) for k in both}


@pytest.mark.parametrize("block", [1024, 7, 1])
def test_counts_against_brute_force(spark, block):
    rng = random.Random(block)
    rows = [(f"s{b}", i, rng.choice([0, 1, 2, 3, None])) for b in range(150) for i in rng.sample(range(45), rng.randrange(0, 30))]
    rows += [(None, 1, 1), ("s1", None, 1), ("solo", 7, None)]
    df = spark.createDataFrame(rows, "basket string, item bigint, label int").withColumn("k", F.lit(1))
    out = pairs.counted_pairs(df, "basket", "item", "label", (0, 1, 2), block=block)
    assert out.columns == ["a", "b", "same", "both"]
    assert {(r["a"], r["b"]): (r["same"], r["both"]) for r in out.collect()} == brute(rows)


def test_counts_apart_and_baskets_with_nothing_in_common(spark):
    rng = random.Random(3)
    rows = [(rng.choice("xy"), f"s{b}", i, rng.randrange(3)) for b in range(80) for i in rng.sample(range(5000), 6)] + [("x", f"h{b}", i, 0) for b in range(200) for i in (1, 2 + b % 5)]
    rows = list({(b, s, i): (b, s, i, p) for b, s, i, p in rows}.values())
    df = spark.createDataFrame(rows, "u string, basket string, item bigint, label int")
    out = pairs.counted_pairs(df, "basket", "item", "label", (0, 1, 2), ("u",))
    assert {(r["u"], r["a"], r["b"]): (r["same"], r["both"]) for r in out.collect()} == brute(rows)
    assert pairs.counted_pairs(df.where("false"), "basket", "item", "label", (0, 1, 2)).count() == 0


def test_one_chamber_is_spread_evenly(spark):
    """One assembly whose first member is in a quarter of all events: no task has twice the work of the middle one."""
    b = spark.range(3000).withColumnRenamed("id", "s").crossJoin(spark.range(300).withColumnRenamed("id", "i"))
    b = b.where(F.pmod(F.xxhash64("s", "i"), F.lit(300)) < 75).select(F.col("s").alias("__s"), F.xxhash64("i").alias("__h"), (F.col("i") * 4).alias("c"))
    units = pairs.written(pairs._units(b, [], 1024), "units")
    placed = pairs._placed(units, [], 16).groupBy("part").agg(F.sum(F.size("x") * F.size("x")).alias("w"))
    load = sorted(r["w"] for r in placed.collect())
    assert len(load) == 16 and load[-1] < 2 * load[8]


def test_a_basket_of_many_items_is_emitted_in_blocks(spark):
    big = spark.range(3000).select(F.lit("big").alias("s"), F.col("id").alias("i"), (F.col("id") % 2).cast("int").alias("p"))
    units = pairs._units(big.select(F.col("s").alias("__s"), F.xxhash64("i").alias("__h"), (F.col("i") * 4 + F.col("p")).alias("c")), [], 256)
    sizes = [(len(r["x"]), len(r["y"] or [])) for r in units.collect()]
    assert len(sizes) == 12 * 13 // 2 and max(max(s) for s in sizes) == 256
    out = pairs.counted_pairs(big, "s", "i", "p", (0, 1)).agg(F.count(F.lit(1)), F.sum("same"), F.max("both")).first()
    assert tuple(out) == (3000 * 2999 // 2, 2 * (1500 * 1499 // 2), 1)


def test_agreement_of_members(spark):
    rows = [("s1", "B", "pour"), ("s1", "A", "pour"), ("s2", "A", "contre"), ("s2", "B", "abstention"), ("s2", "C", "abstention")]
    df = spark.createDataFrame(rows, "scrutin_uid string, acteur_uid string, position string")
    got = {tuple(r) for r in agreement.pair_counts(df).select("a", "b", "accord", "communs").collect()}
    assert got == {("A", "B", 1, 2), ("A", "C", 0, 1), ("B", "C", 1, 1)}
    assert agreement.pair_counts(df, floor=2).count() == 1
