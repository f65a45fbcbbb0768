"""Group lines, dissent and who took part (lines of the inventory: B17, X6, G8-G10, J3, J6, V5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import EXPRESSED, OPEN_YEAR, STRUCTURAL_CAUSES, day, rate
from .intervals import OPEN, merge_intervals

#: A group has a line when its top share is above LINE and at least MIN_VOTERS voted.
LINE, MIN_VOTERS = 0.5, 5


def group_lines(expressed: DataFrame, event: str, group: str, position: str) -> DataFrame:
    """Per (event, group): the three counts, voters, top count, tie, label (null on a tie) and top share.

    Counts are combined map-side; a group that holds many of the ballots is as cheap as any other.
    """
    n = {p: f"n_{p}" for p in EXPRESSED}
    c = expressed.groupBy(event, group).agg(*[F.count_if(F.col(position) == p).alias(x) for p, x in n.items()])
    c = c.withColumn("votants_groupe", sum((F.col(x) for x in list(n.values())[1:]), F.col("n_pour")))
    c = c.where(F.col("votants_groupe") > 0).withColumn("n_majoritaire", F.greatest(*n.values()))
    ties = sum((F.when(F.col(x) == F.col("n_majoritaire"), 1).otherwise(0) for x in n.values()), F.lit(0))
    c = c.withColumn("partage", ties > 1)
    label = F.lit(None).cast("string")
    for p, x in reversed(list(n.items())):
        label = F.when(F.col(x) == F.col("n_majoritaire"), p).otherwise(label)
    return c.withColumn("majoritaire", F.when(~F.col("partage"), label)).withColumn("part_majoritaire", F.col("n_majoritaire") / F.col("votants_groupe"))


def has_line(min_voters: int = MIN_VOTERS, line: float = LINE) -> Column:
    """Exactly the share ``line`` is a split group, not one with a line."""
    return F.col("majoritaire").isNotNull() & (F.col("votants_groupe") >= min_voters) & (F.col("part_majoritaire") > line)


def dissent_flag(position: Column, min_voters: int = MIN_VOTERS, line: float = LINE) -> Column:
    """True, false, or null where the group has no line."""
    return F.when(has_line(min_voters, line), position != F.col("majoritaire"))


def against_line(expressed: DataFrame, lines: DataFrame, min_voters: int = MIN_VOTERS, line: float = LINE) -> DataFrame:
    """Every expressed ballot whose group - the one on the ballot - has a line, with the flag ``dissident``."""
    held = lines.where(has_line(min_voters, line)).select("scrutin_uid", "groupe_uid", "majoritaire", "votants_groupe", "part_majoritaire")
    return expressed.join(held, ["scrutin_uid", "groupe_uid"]).withColumn("dissident", F.col("position") != F.col("majoritaire"))


def dissent_by(compared: DataFrame, keys: list[str], min_ballots: int) -> DataFrame:
    """Per ``keys``: comparable ballots, those against the line, and their rate, from ``min_ballots`` on."""
    out = compared.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_votes"), F.count_if("dissident").alias("n_dissidents"))
    return out.where(F.col("n_votes") >= min_ballots).withColumn("taux", F.col("n_dissidents") / F.col("n_votes"))


def term_periods(members: DataFrame, periods: str = "periodes_mandat") -> DataFrame:
    """(acteur_uid, debut, fin): each member's terms as the union of closed intervals; an open end is null."""
    p = members.select("acteur_uid", F.explode(periods).alias("p")).select("acteur_uid", day("p.debut").alias("d"), day("p.fin").alias("f"))
    p = p.withColumn("f", F.when(F.year("f") < OPEN_YEAR, F.col("f")))
    runs = merge_intervals(p, "acteur_uid", "d", "f").where(F.col("genre") == "periode")
    end = F.when(F.col("fin") < OPEN, F.date_from_unix_date("fin"))
    return runs.select("acteur_uid", F.date_from_unix_date("debut").alias("debut"), end.alias("fin"))


def calendar(events: DataFrame, flags: dict[str, Column] | None = None) -> DataFrame:
    """(jour, and for each flag the number of its events up to and with that day). As many rows as days, whatever the number of events."""
    flags = flags or {"n": F.lit(True)}
    per_day = events.where(F.col("jour").isNotNull()).groupBy("jour").agg(*[F.count_if(c).alias(f) for f, c in flags.items()])
    w = W.orderBy("jour").rowsBetween(W.unboundedPreceding, 0)
    return per_day.select("jour", *[F.sum(f).over(w).alias(f) for f in flags])


def eligible_counts(periods: DataFrame, cal: DataFrame, flags: list[str]) -> DataFrame:
    """Per member, the number of events of each flag within its terms: the range join as differences of cumulative counts.

    The counts up to an end, less those before a start, are looked up as of that day: bounds and days are united and the last count is carried forward.
    No member is ever joined with every event.
    """
    start = periods.select("acteur_uid", F.date_sub("debut", 1).alias("jour"), F.lit(-1).alias("signe"))
    end = periods.select("acteur_uid", F.coalesce("fin", F.lit("9999-12-31").cast("date")).alias("jour"), F.lit(1).alias("signe"))
    bounds = start.unionByName(end).groupBy("jour").agg(F.count(F.lit(1)))
    known = cal.select("jour", F.struct(*flags).alias("c"))
    w = W.orderBy("jour").rowsBetween(W.unboundedPreceding, 0)
    lookup = bounds.select("jour").join(known, "jour", "full").withColumn("c", F.last("c", ignorenulls=True).over(w)).select("jour", *[F.coalesce(F.col(f"c.{f}"), F.lit(0)).alias(f) for f in flags])
    return start.unionByName(end).join(lookup, "jour").groupBy("acteur_uid").agg(*[F.sum(F.col("signe") * F.col(f)).alias(f) for f in flags])


def headcount_by_day(periods: DataFrame, events: DataFrame) -> DataFrame:
    """(jour, concernes): members in office on each day with an event, by a sweep over days."""
    starts = periods.select(F.col("debut").alias("jour"), F.lit(1).alias("d"))
    ends = periods.where(F.col("fin").isNotNull()).select(F.date_add("fin", 1).alias("jour"), F.lit(-1).alias("d"))
    steps = starts.unionByName(ends).groupBy("jour").agg(F.sum("d").alias("d"))
    days = events.where(F.col("jour").isNotNull()).select("jour").distinct().withColumn("evt", F.lit(True))
    w = W.orderBy("jour").rowsBetween(W.unboundedPreceding, 0)
    return steps.join(days, "jour", "full").withColumn("concernes", F.sum(F.coalesce("d", F.lit(0))).over(w)).where("evt").select("jour", "concernes")


def in_term(rows: DataFrame, periods: DataFrame) -> DataFrame:
    """Add ``eligible``: the row's day is within a term of its member. Rows are joined on the member, never on days alone."""
    p = periods.select(F.col("acteur_uid").alias("__m"), F.struct(F.col("debut").alias("d"), F.coalesce("fin", F.lit("9999-12-31").cast("date")).alias("f")).alias("p"))
    p = p.groupBy("__m").agg(F.collect_list("p").alias("ps"))
    j = rows.join(p, F.col("acteur_uid") == F.col("__m"), "left")
    inside = F.exists("ps", lambda x: (x["d"] <= F.col("jour")) & (F.col("jour") <= x["f"]))
    return j.withColumn("eligible", F.coalesce(inside, F.lit(False))).drop("__m", "ps")


def participation(counts: DataFrame, flagged: DataFrame, eligible: str = "n") -> DataFrame:
    """Per member with a term: eligible events, expressed and structural ones among them, denominator and rate (null at 0).

    ``counts``: from :func:`eligible_counts`; ``flagged``: ballots from :func:`in_term`.
    """
    took = flagged.where("eligible").groupBy("acteur_uid").agg(
        F.count_if(F.col("position").isin(*EXPRESSED)).alias("exprimes"),
        F.count_if((F.col("position") == "nonVotant") & F.col("cause").isin(*STRUCTURAL_CAUSES)).alias("structurels"),
    )
    j = counts.withColumnRenamed(eligible, "eligibles").join(took, "acteur_uid", "left").na.fill(0, ["exprimes", "structurels"])
    j = j.withColumn("denominateur", F.greatest(F.col("eligibles") - F.col("structurels"), F.lit(0)))
    return j.withColumn("taux", rate(F.col("exprimes"), F.col("denominateur")))
