"""How abstention behaves and when it could have tipped a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lines import has_line


def abstention_rate(expressed: DataFrame, by: str) -> DataFrame:
    """Per value of ``by``: expressed ballots, abstentions and their share."""
    out = expressed.groupBy(by).agg(F.count(F.lit(1)).alias("n_votes"), F.count_if(F.col("position") == "abstention").alias("n_abstentions"))
    return out.withColumn("taux", F.col("n_abstentions") / F.col("n_votes"))


def decomposition(expressed: DataFrame, lines: DataFrame, min_voters: int = 5) -> DataFrame:
    """Every abstention is by order (the line is to abstain), a withdrawal from another line, or undetermined; the three shares sum to 1."""
    a = expressed.where(F.col("position") == "abstention").join(lines, ["scrutin_uid", "groupe_uid"], "left")
    kind = F.when(has_line(min_voters), F.when(F.col("majoritaire") == "abstention", "consigne").otherwise("retrait")).otherwise("indeterminee")
    out = a.groupBy(kind.alias("nature")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("part", F.col("n") / F.sum("n").over(W.partitionBy()))


def cohesion_by_line(lines: DataFrame, min_voters: int = 10) -> DataFrame:
    """Mean top share and number of group lines by what the line is."""
    kept = lines.where(F.col("majoritaire").isNotNull() & (F.col("votants_groupe") >= min_voters))
    return kept.groupBy("majoritaire").agg(F.avg("part_majoritaire").alias("cohesion"), F.count(F.lit(1)).alias("n"))


def sides_by_group(expressed: DataFrame) -> DataFrame:
    """Per event and group, the number on each side."""
    return expressed.groupBy("scrutin_uid", "groupe_uid").agg(*[F.count_if(F.col("position") == p).alias(p) for p in ("pour", "contre", "abstention")])


def between_camps(positioned: DataFrame, min_per_camp: int = 10) -> DataFrame:
    """Per event with three large enough camps: their median places, whether the abstainers' is between, and how far along (0: left camp, 1: right camp).

    ``positioned``: expressed ballots with the member's ``axe``.
    """
    m = positioned.where(F.col("axe").isNotNull()).groupBy("scrutin_uid").agg(
        *[F.count_if(F.col("position") == p).alias(f"n_{p}") for p in ("pour", "contre", "abstention")],
        *[F.median(F.when(F.col("position") == p, F.col("axe"))).alias(f"m_{p}") for p in ("pour", "contre", "abstention")],
    )
    m = m.where((F.col("n_pour") >= min_per_camp) & (F.col("n_contre") >= min_per_camp) & (F.col("n_abstention") >= min_per_camp))
    lo, hi = F.least("m_pour", "m_contre"), F.greatest("m_pour", "m_contre")
    m = m.withColumn("entre", (F.col("m_abstention") > lo) & (F.col("m_abstention") < hi))
    return m.withColumn("relatif", F.when(hi > lo, (F.col("m_abstention") - lo) / (hi - lo)))


def between_summary(camps: DataFrame) -> DataFrame:
    return camps.agg(F.count(F.lit(1)).alias("n_scrutins"), F.avg(F.col("entre").cast("int")).alias("part_entre"), F.median("relatif").alias("relatif_median"))


def tipping(events: DataFrame, min_voters: int = 20) -> DataFrame:
    """Events that the abstainers could have turned: an adopted one needs as many as the margin, a rejected one (a draw is one) one more."""
    e = events.where((F.col("n_abstention") > 0) & (F.col("nb_votants") > min_voters) & F.col("n_pour").isNotNull() & F.col("n_contre").isNotNull())
    adopted = F.col("n_pour") > F.col("n_contre")
    e = e.withColumn("ecart", F.abs(F.col("n_pour") - F.col("n_contre")))
    e = e.withColumn("requis", F.when(adopted, F.col("ecart")).otherwise(F.col("ecart") + 1)).where(F.col("n_abstention") >= F.col("requis"))
    return e.withColumn("vers", F.when(adopted, "rejet").otherwise("adoption")).withColumn("marge", F.col("n_abstention") / F.col("requis"))


def close_votes(events: DataFrame, max_gap: int = 10, min_voters: int = 0) -> DataFrame:
    e = events.withColumn("ecart", F.abs(F.col("n_pour") - F.col("n_contre")))
    return e.where((F.col("ecart") <= max_gap) & (F.col("nb_votants") > min_voters))
