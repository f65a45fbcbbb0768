"""Problem 1: references to records that do not exist (yet, or any more)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def parent_registry(parents: DataFrame, on: Sequence[str], seen: str, removed: DataFrame | None, removed_at: str) -> DataFrame:
    """One row per parent key: ``on``, ``first_seen``, ``removed_at`` (first logged removal, null if none). Key columns may be null, and null is then part of the key.

    A repeated parent counts from the first time it was received. ``removed`` has ``on`` and
    ``removed_at``; keys in it that are no parents are of no use and fall away. Both are summed in one pass, combined before the shuffle.
    """
    at = lambda d, c, r, p: d.select(*on, c.cast("timestamp").alias("first_seen"), r.cast("timestamp").alias("removed_at"), F.lit(p).alias("__parent"))
    rows = at(parents, F.col(seen), F.lit(None), 1)
    if removed is not None:
        rows = rows.unionByName(at(removed, F.lit(None), F.col(removed_at), 0))
    sums = rows.groupBy(*on).agg(F.min("first_seen").alias("first_seen"), F.min("removed_at").alias("removed_at"), F.max("__parent").alias("__parent"))
    return sums.where(F.col("__parent") == 1).drop("__parent")


def orphan_references(refs: DataFrame, registry: DataFrame, on: Sequence[str], seen: str, match: str = "simple") -> DataFrame:
    """The rows of ``refs`` whose reference names no parent that was on file when the row was received.

    ``on``: the columns of the (composite) key, under the same names in ``refs`` and ``registry``;
    ``seen``: when the reference was received; ``registry``: from :func:`parent_registry`.

    The references are grouped by the mask of their null key columns and each mask is anti-joined on its
    other columns. ``match`` is what SQL declares for a key that is null in part: ``simple``: no reference at
    all; ``partial``: the columns that are given must occur together in some parent; ``full``: an error, so the row
    comes out. A key that is null in every column never refers to anything.

    A parent counts for a reference when it was first received at or before the reference, and no removal
    of it was logged at or before the reference. A reference without a time is an orphan only when no
    parent has its key at all. Columns of ``refs`` are kept; rows are neither dropped nor repeated, and those
    that repeat come out as often as they came in. Empty inputs are allowed: without parents every reference is an orphan.

    A hot key splits over tasks: the registry has one row per key, so AQE may cut a skewed partition of
    ``refs`` at will.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    n = len(on)
    parts = []
    for given in (c for k in range(n, 0, -1) for c in combinations(range(n), k)):
        # null tests instead of a number for the mask: where a source has a column of nulls only, the planner sees that a mask has no rows there and leaves its join out
        rows = refs
        for i, c in enumerate(on):
            rows = rows.where(F.col(f"`{c}`").isNotNull() if i in given else F.col(f"`{c}`").isNull())
        if len(given) < n:
            if match == "simple":
                continue
            if match == "full":
                parts.append(rows)
                continue
        names = [on[i] for i in given]
        p = registry.where(F.lit(True))
        for c in names:
            p = p.where(F.col(c).isNotNull())
        p = p.select(*[F.col(c).alias(f"__p{i}") for i, c in enumerate(names)], F.col("first_seen").alias("__first"), F.col("removed_at").alias("__gone"))
        rows = rows.alias("r")
        at = F.col(f"r.`{seen}`")
        there = at.isNull() | ((F.col("__first").isNull() | (F.col("__first") <= at)) & (F.col("__gone").isNull() | (F.col("__gone") > at)))
        equal = [F.col(f"r.`{c}`") == F.col(f"__p{i}") for i, c in enumerate(names)]
        cond = there
        for e in equal:
            cond = cond & e
        parts.append(rows.join(p, cond, "left_anti"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def orphans_by_period(orphans: DataFrame, name: str, seen: str, on: Sequence[str], unit: str = "month") -> DataFrame:
    """Orphan rows and distinct keys per table and period of receipt; rows without a time have the period null."""
    rows = orphans.groupBy(name, F.to_date(F.date_trunc(unit, seen)).alias("periode"), *on).agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(name, "periode").agg(F.sum("n").alias("n_lignes"), F.count(F.lit(1)).alias("n_cles"))
