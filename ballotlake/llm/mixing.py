"""Problem 9: mixing sources to target weights."""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass
class Plan:
    """What one source gives: ``copies`` of every document, and of the documents of each length so many once more."""

    source: str
    weight: float
    most: int
    documents: int
    available: int
    budget: int
    copies: int
    extra: dict[int, int]
    most_of_a_length: int = 0

    @property
    def tokens(self) -> int:
        return self.copies * self.available + sum(n * x for n, x in self.extra.items())


#: How many times the longest length is left for the program, so that it has documents to choose from.
ROOM = 20


def fit(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their sum is as near below ``budget`` as can be.

    A proportional share of every length comes first, so that the choice resembles the source; then one more of the lengths whose share lost most to rounding, until no more than
    ROOM times the longest length is left; two of each of the 64 shortest lengths are given back. So what is left is bounded by the longest text and by nothing else, and a bounded-knapsack program over reachable sums fills all of it.
    """
    total = sum(n * c for n, c in lengths.items())
    if budget <= 0 or not total:
        return {}
    if budget >= total:
        return dict(lengths)
    take = {n: c * budget // total for n, c in lengths.items()}
    rest = budget - sum(n * x for n, x in take.items())
    longest = ROOM * max(lengths)
    for n in sorted(lengths, key=lambda n: (-(lengths[n] * budget % total), n)):
        if rest <= longest:
            break
        if take[n] < lengths[n]:
            take[n] += 1
            rest -= n
    for n in sorted(lengths)[:64]:  # a few of the shortest are given back, since they fit where others don't
        back = min(take[n], 2)
        take[n] -= back
        rest += n * back
    left = {n: min(lengths[n] - take[n], rest // n) for n in lengths if 0 < n <= rest and lengths[n] > take[n]}
    for n, x in knapsack(left, rest).items():
        take[n] += x
    return {n: x for n, x in take.items() if x}


def knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """The counts within ``counts`` whose sum is the largest not above ``budget``: dynamic programming over
    reachable sums, each a bit (in units of the common divisor), with the count of a length split in powers of two."""
    unit = gcd(*counts) or 1
    counts, budget = {n // unit: c for n, c in counts.items()}, budget // unit
    mask = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for n in sorted(counts):
        c, k = counts[n], 1
        while c > 0:
            k = min(k, c)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            c -= k
            k *= 2
        if reach >> budget & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            taken[n * unit] = taken.get(n * unit, 0) + k
            at -= n * k
    return taken


def plan_mix(histogram: dict[str, dict[int, int]], weights: dict[str, tuple[float, int]], total: int | None = None) -> list[Plan]:
    """The plan for each source with a positive weight. ``histogram``: documents by source and length in tokens.

    ``total``: the size wanted; without it the largest at which every source that has documents reaches its share within its
    repetitions. A source too small for its share of a given ``total`` gives all it may.
    """
    known = {s: (w, max(int(m or 0), 0)) for s, (w, m) in weights.items() if w and w > 0}
    size = {s: sum(n * c for n, c in histogram.get(s, {}).items()) for s in known}
    norm = sum(w for s, (w, _) in known.items() if size[s] and known[s][1]) or 1.0
    if total is None:
        total = min((int(m * size[s] * norm / w) for s, (w, m) in known.items() if size[s] and m), default=0)
    plans = []
    for s, (w, m) in sorted(known.items()):
        lengths = {n: c for n, c in histogram.get(s, {}).items() if n > 0}
        budget = min(round(total * w / norm), m * size[s])
        copies = budget // size[s] if size[s] else 0
        plans.append(Plan(s, w, m, sum(histogram.get(s, {}).values()), size[s], budget, copies, fit(lengths, budget - copies * size[s]) if copies < m else {}, max(lengths.values(), default=0)))
    return plans


def length_histogram(sized: DataFrame, source: str, n_tokens: str) -> dict[str, dict[int, int]]:
    """Documents by source and exact length; as many rows as there are different lengths, whatever the number of documents."""
    out: dict[str, dict[int, int]] = {}
    for r in sized.where(F.col(source).isNotNull()).groupBy(source, n_tokens).count().toLocalIterator():
        out.setdefault(r[0], {})[r[1]] = r[2]
    return out


def select(sized: DataFrame, plans: list[Plan], key: str, source: str, n_tokens: str, seed: int = 42, to_rank: int = 20_000) -> DataFrame:
    """Columns of ``sized`` and ``copies`` (at least 1; a column of that name is replaced) of the documents in the mix. Documents without a source
    or of one without a weight take no part; rows that repeat are documents of their own.

    Within a source and length the documents come in the order of a seeded hash of ``key``. The hash is cut into ranges of about ``to_rank`` documents of the commonest length, however
    many there are; counts of the ranges tell which lie wholly within the number wanted and in which one it ends. Only the documents of that range are ranked.
    """
    spark, sized = sized.sparkSession, sized.drop("copies")
    most = max((p.most_of_a_length for p in plans), default=0)
    bits = min(30, max(1, -(-most // to_rank) - 1).bit_length())
    rows = [(p.source, n, x) for p in plans for n, x in p.extra.items()]
    wanted = spark.createDataFrame(rows, "__s string, __n bigint, __x bigint")
    whole = spark.createDataFrame([(p.source, p.copies) for p in plans], "__s string, __copies bigint")
    d = sized.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))).withColumn("__b", F.shiftrightunsigned("__h", 64 - bits))
    d = d.join(F.broadcast(whole), F.col(source) == F.col("__s")).drop("__s")
    group = [source, n_tokens]
    ranges = d.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__k"))
    ranges = ranges.withColumn("__before", F.sum("__k").over(W.partitionBy(*group).orderBy("__b")) - F.col("__k"))
    ends = ranges.join(wanted, (F.col(source) == F.col("__s")) & (F.col(n_tokens) == F.col("__n"))).where((F.col("__before") < F.col("__x")) & (F.col("__before") + F.col("__k") >= F.col("__x")))
    ends = ends.select(F.col("__s").alias("__es"), F.col("__n").alias("__en"), F.col("__b").alias("__eb"), (F.col("__x") - F.col("__before")).alias("__more"))
    j = d.join(ends, (F.col(source) == F.col("__es")) & (F.col(n_tokens) == F.col("__en")), "left")
    at_end = F.coalesce(F.col("__b") == F.col("__eb"), F.lit(False))
    sure = j.where(~at_end).withColumn("__once", F.when(F.col("__b") < F.col("__eb"), 1).otherwise(0))
    rank = F.row_number().over(W.partitionBy(*group).orderBy("__h", key))
    last = j.where(at_end).withColumn("__once", F.when(rank <= F.col("__more"), 1).otherwise(0))
    both = sure.unionByName(last)
    return both.withColumn("copies", F.col("__copies") + F.col("__once")).where(F.col("copies") > 0).select(*sized.columns, "copies")


def report(selected: DataFrame, plans: list[Plan], source: str, n_tokens: str) -> DataFrame:
    """Per source: what it has, its target, and what the selection really holds. Sums come from the selected rows. ``manque``: tokens short of the aim, an upper bound
    of the distance to the best choice there is."""
    spark = selected.sparkSession
    rows = [(p.source, p.weight, p.most, p.documents, p.available, p.budget) for p in plans]
    base = spark.createDataFrame(rows, "source string, poids double, repetitions_max bigint, documents bigint, tokens bigint, tokens_vises bigint")
    got = selected.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("documents_retenus"), F.sum("copies").alias("exemplaires"), F.sum(F.col("copies") * F.col(n_tokens)).alias("tokens_retenus"), F.max("copies").alias("repetitions")
    )
    j = base.join(got, "source", "left").na.fill(0, ["documents_retenus", "exemplaires", "tokens_retenus", "repetitions"])
    j = j.withColumn("manque", F.col("tokens_vises") - F.col("tokens_retenus"))
    all_tokens = F.sum("tokens_retenus").over(W.partitionBy())
    return j.withColumn("part", F.when(all_tokens > 0, F.col("tokens_retenus") / all_tokens)).withColumn("ecart", F.col("part") - F.col("poids"))
