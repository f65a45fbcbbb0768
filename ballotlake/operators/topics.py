"""Terms that surge in a week at equal document volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import binomial_tail, q_values
from ..functions.text import tokens

#: Weeks of reference, least documents, false-discovery rate.
REFERENCE_WEEKS, MIN_DOCUMENTS, FDR = 8, 5, 0.05


def monday(c) -> F.Column:
    return F.date_trunc("week", c).cast("date")


def week_frequencies(docs: DataFrame, ident: str, day: str, text: str, excluded: DataFrame | None = None, bigrams: bool = True) -> DataFrame:
    """(semaine, terme, n, n_docs, n_documents): occurrences, documents that hold the term, documents of the week.

    Counts per document come first, so the later sums are over whole documents and there is no distinct count to expand.
    ``excluded``: words (column ``mot``) that are not terms, such as names; terms and pairs that hold one are taken off by an anti-join, as names grow with the data.
    """
    d = docs.where(F.col(day).isNotNull()).select(F.col(ident).alias("__id"), monday(F.col(day)).alias("semaine"), F.col(text).alias("t"))
    size = d.groupBy("semaine").agg(F.count(F.lit(1)).alias("n_documents"))
    t = d.select("__id", "semaine", F.explode(tokens(F.col("t"), bigrams=bigrams)).alias("terme"))
    one = t.groupBy("__id", "semaine", "terme").agg(F.count(F.lit(1)).alias("n"))
    f = one.groupBy("semaine", "terme").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))
    if excluded is not None:
        bad = f.select("terme").distinct().select("terme", F.explode(F.split("terme", " ")).alias("mot")).join(excluded.select("mot").distinct(), "mot", "left_semi").select("terme").distinct()
        f = f.join(bad, "terme", "left_anti")
    return f.join(size, "semaine")


def surges(freqs: DataFrame, reference: int = REFERENCE_WEEKS, min_docs: int = MIN_DOCUMENTS, fdr: float | None = FDR, rises_only: bool = True) -> DataFrame:
    """Every term of every week against the weeks before it that are present in the data (at most ``reference``).

    share = documents with the term / documents, over the reference weeks; expected = share * documents of the week; score = (n - expected) /
    sqrt(expected + 1); p = binomial tail; q = Benjamini-Hochberg over the week's terms with enough documents and (``rises_only``) a positive score. Weeks without history
    have no row. All weeks come out of one pass: each (week, term) row is spread to the weeks it is a reference for.
    """
    weeks = freqs.groupBy("semaine").agg(F.max("n_documents").alias("nd"))
    w = W.orderBy("semaine")
    ranked = weeks.withColumn("rang", F.row_number().over(w))
    before = w.rowsBetween(-reference, -1)
    base = ranked.withColumn("nd_ref", F.sum("nd").over(before)).where(F.col("nd_ref") > 0)
    f = freqs.join(ranked.select("semaine", "rang"), "semaine")
    spread = f.select("terme", F.explode(F.sequence(F.col("rang") + 1, F.col("rang") + reference)).alias("rang"), F.col("n_docs").alias("r"))
    past = spread.groupBy("terme", "rang").agg(F.sum("r").alias("n_ref"))
    now = f.where(F.col("n_docs") >= min_docs).join(base.select("semaine", "nd_ref"), "semaine").join(past, ["terme", "rang"], "left").na.fill(0, ["n_ref"])
    p = F.least(F.greatest(F.col("n_ref") / F.col("nd_ref"), F.lit(0.0)), F.lit(1.0))
    now = now.withColumn("p0", p).withColumn("attendu", F.col("p0") * F.col("n_documents"))
    now = now.withColumn("score", (F.col("n_docs") - F.col("attendu")) / F.sqrt(F.col("attendu") + 1))
    if rises_only:
        now = now.where(F.col("score") > 0)
    now = now.withColumn("p", binomial_tail(F.col("n_docs").cast("double"), F.col("n_documents").cast("double"), F.col("p0")))
    by = W.partitionBy("semaine")
    now = now.withColumn("tests", F.count(F.lit(1)).over(by)).withColumn("ordre", F.row_number().over(by.orderBy(F.round("p", 12), "terme")))
    out = q_values(now, "p", "tests", "ordre", ["semaine"])
    if fdr is not None:
        out = out.where(F.col("q") <= fdr)
    return out.select("semaine", "terme", "n", "n_docs", "n_documents", "attendu", "score", "p", "q")


def rising(freqs: DataFrame, week: str | None = None, reference: int = REFERENCE_WEEKS, min_docs: int = MIN_DOCUMENTS, k: int = 25, rises_only: bool = True, merge: bool = True, fdr: float | None = FDR) -> DataFrame:
    """The ``k`` terms of one week with the highest score (M15); by default of the last week there is.

    ValueError for a week without data, without a week before it, or without documents. ``merge``: without redundant terms; ``fdr`` None: whatever their q.
    """
    weeks = freqs.groupBy("semaine").agg(F.max("n_documents").alias("n"))
    target = F.lit(week).cast("date") if week else F.lit(weeks.agg(F.max("semaine")).first()[0])
    seen = weeks.agg(F.count_if(F.col("semaine") == target).alias("here"), F.max(F.when(F.col("semaine") == target, F.col("n"))).alias("n")).first()
    if not seen["here"]:
        raise ValueError(f"no data for the week of {week}")
    before = [r["semaine"] for r in weeks.where(F.col("semaine") < target).orderBy(F.col("semaine").desc()).limit(reference).collect()]
    if not before:
        raise ValueError("not enough history for a reference")
    kept = freqs.where(F.col("semaine").isin(before) | (F.col("semaine") == target))
    total = weeks.where(F.col("semaine").isin(before)).agg(F.sum("n")).first()[0]
    if not seen["n"] or not total:
        raise ValueError("no documents to compare with")
    found = surges(kept, reference, min_docs, fdr, rises_only).where(F.col("semaine") == target)
    found = without_redundant(found) if merge else found
    return found.orderBy(F.col("score").desc(), "terme").limit(k)


def without_redundant(found: DataFrame, share: float = 0.8, decimals: int = 3, small: int = 3) -> DataFrame:
    """Drop single words that a pair holding them explains, then keep one of the terms of a week that are equal in counts.

    A word goes when some pair with it has at least ``share`` of its documents. Of a class (same documents, same rounded expectation) of at most
    ``small`` terms the longest pair of which both words are in the class stays, if there is one; otherwise the term of fewest words, then the shortest, then the
    one with the best score.
    """
    words = found.withColumn("mots", F.split("terme", " "))
    pairs = words.where(F.size("mots") > 1).select("semaine", F.explode("mots").alias("mot"), F.col("n_docs").alias("__n"))
    best = pairs.groupBy(F.col("semaine").alias("semaine"), F.col("mot").alias("terme")).agg(F.max("__n").alias("__n"))
    kept = words.join(best, ["semaine", "terme"], "left").where(F.col("__n").isNull() | (F.col("__n") < F.lit(share) * F.col("n_docs"))).drop("__n")
    cls = W.partitionBy("semaine", "n_docs", F.round("attendu", decimals))
    kept = kept.withColumn("__size", F.count(F.lit(1)).over(cls)).withColumn("__all", F.collect_list(F.struct("terme")).over(cls))
    inside = (F.size("mots") > 1) & F.forall("mots", lambda m: F.exists("__all", lambda t: t["terme"] == m)) & (F.col("__size") <= small)
    order = [inside.desc(), F.when(inside, -F.length("terme")), F.size("mots"), F.length("terme"), F.col("score").desc(), F.col("terme")]
    kept = kept.withColumn("__r", F.row_number().over(cls.orderBy(*order))).where(F.col("__r") == 1)
    return kept.drop("mots", "__size", "__all", "__r")


def term_series(freqs: DataFrame, term: str) -> DataFrame:
    """Weekly share of a term, zero in the weeks without it."""
    weeks = freqs.groupBy("semaine").agg(F.max("n_documents").alias("n_documents"))
    own = freqs.where(F.col("terme") == term).select("semaine", "n_docs")
    j = weeks.join(own, "semaine", "left").na.fill(0, ["n_docs"])
    return j.withColumn("part", F.col("n_docs") / F.col("n_documents"))
