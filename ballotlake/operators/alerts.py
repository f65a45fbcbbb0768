"""Weekly alerts (L1-L9, W12, W13) and data invariants."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .intervals import OPEN, merge_intervals
from .lines import has_line, headcount_by_day
from .topics import monday

ALERT = ["semaine", "categorie", "cle", "detail", "intensite"]
#: Seats of the assembly, examples kept per anomaly.
SEATS, EXAMPLES = 577, 8


def with_week(df: DataFrame) -> DataFrame:
    return df.where(F.col("jour").isNotNull()).withColumn("semaine", monday(F.col("jour")))


def _alert(df: DataFrame, category: str, key, detail, intensity) -> DataFrame:
    return df.select("semaine", F.lit(category).alias("categorie"), key.alias("cle"), detail.alias("detail"), intensity.alias("intensite"))


def close(events: DataFrame, max_gap: int = 15, min_voters: int = 50) -> DataFrame:
    e = with_week(events).withColumn("ecart", F.abs(F.col("n_pour") - F.col("n_contre"))).where((F.col("ecart") <= max_gap) & (F.col("nb_votants") > min_voters))
    return _alert(e, "vote serré", F.col("scrutin_uid"), F.col("ecart").cast("string"), 1 - F.col("ecart") / max_gap)


def fractures(lines: DataFrame, events: DataFrame, threshold: float = 0.08, min_voters: int = 15) -> DataFrame:
    """Groups with a majority line that enough members left."""
    g = lines.where(has_line(min_voters)).join(with_week(events).select("scrutin_uid", "semaine"), "scrutin_uid").withColumn("hors", 1 - F.col("part_majoritaire"))
    g = g.where(F.col("hors") >= threshold)
    return _alert(g, "fracture de groupe", F.concat_ws("/", "scrutin_uid", "groupe_uid"), F.col("majoritaire"), F.least(F.lit(1.0), F.col("hors") / 0.5))


def split_groups(lines: DataFrame, events: DataFrame, threshold: float = 0.5, min_voters: int = 15) -> DataFrame:
    """Groups without a majority: exactly the threshold is split."""
    g = lines.where((F.col("votants_groupe") >= min_voters) & (F.col("part_majoritaire") <= threshold)).join(with_week(events).select("scrutin_uid", "semaine"), "scrutin_uid")
    return _alert(g, "groupe partagé", F.concat_ws("/", "scrutin_uid", "groupe_uid"), F.col("majoritaire"), F.least(F.lit(1.0), (threshold - F.col("part_majoritaire")) / threshold + 0.5))


def ruptures(compared: DataFrame, events: DataFrame, min_ballots: int = 10, threshold: float = 0.25, gap: float = 0.10) -> DataFrame:
    """Members whose dissent in a week is high and well above their usual rate over all weeks."""
    c = compared.join(with_week(events).select("scrutin_uid", "semaine"), "scrutin_uid")
    week = c.groupBy("semaine", "acteur_uid").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("dissident").cast("int")).alias("t"))
    usual = compared.groupBy("acteur_uid").agg(F.avg(F.col("dissident").cast("int")).alias("h"))
    j = week.where((F.col("n") >= min_ballots) & (F.col("t") >= threshold)).join(usual, "acteur_uid", "left").withColumn("d", F.col("t") - F.coalesce("h", F.lit(0.0)))
    j = j.where(F.col("d") > gap)
    return _alert(j, "député en rupture", F.col("acteur_uid"), F.col("n").cast("string"), F.least(F.lit(1.0), F.col("d") / 0.5))


def activity(events: DataFrame) -> DataFrame:
    """Weeks far from the mean of the eight calendar weeks before; a week without events counts as none there."""
    n = with_week(events).groupBy("semaine").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.datediff("semaine", F.lit("1970-01-05").cast("date")) / 7)
    w = W.orderBy(F.col("k").cast("long")).rangeBetween(-8, -1)
    n = n.withColumn("ref", F.coalesce(F.sum("n").over(w), F.lit(0)) / 8.0).where(F.col("ref") >= 1).withColumn("r", F.col("n") / F.col("ref"))
    n = n.where((F.col("r") <= 0.5) | (F.col("r") >= 2.0))
    return _alert(n, "activité", F.date_format("semaine", "yyyy-MM-dd"), F.col("n").cast("string"), F.least(F.lit(1.0), F.abs(F.col("r") - 1) / 2))


def surging(found: DataFrame, k: int = 8) -> DataFrame:
    w = W.partitionBy("semaine").orderBy(F.col("score").desc(), "terme")
    top = found.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return _alert(top, "poussée thématique", F.col("terme"), F.col("n_docs").cast("string"), F.least(F.lit(1.0), F.col("score") / 20))


def all_alerts(parts: list[DataFrame], per_category: int = 5) -> DataFrame:
    """At most so many per week and category, by intensity, ties by key."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = W.partitionBy("semaine", "categorie").orderBy(F.round("intensite", 9).desc(), "cle")
    return out.withColumn("rang", F.row_number().over(w)).where(F.col("rang") <= per_category)


def bulletin(alerts: DataFrame, week: str) -> str:
    """The week's alerts as Markdown; the cap per category bounds what comes to the driver."""
    lines, last = [f"# Semaine du {week}"], None
    for r in alerts.where(F.col("semaine") == week).orderBy("categorie", F.col("intensite").desc(), "cle").collect():
        if r["categorie"] != last:
            lines += ["", f"## {r['categorie']}", ""]
            last = r["categorie"]
        lines.append(f"- {r['cle']} ({r['detail']}, {r['intensite']:.2f})")
    return "\n".join(lines) + "\n"


# --- invariants: each gives (controle, cle, message)


def _anomaly(df: DataFrame, check: str, key, message) -> DataFrame:
    return df.select(F.lit(check).alias("controle"), key.alias("cle"), message.alias("message"))


def bad_terms(periods: DataFrame) -> DataFrame:
    """Terms (acteur_uid, debut, fin) without a start, that end before they start, or overlap the one before."""
    w = W.partitionBy("acteur_uid").orderBy(F.col("debut").asc_nulls_first(), F.col("fin").asc_nulls_last())
    end = F.coalesce("fin", F.lit("9999-12-31").cast("date"))
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    p = periods.withColumn("reach", reach)
    why = F.when(F.col("debut").isNull(), "sans début").when(end < F.col("debut"), "vide").when(F.col("debut") <= F.col("reach"), "chevauchement")
    return _anomaly(p.withColumn("why", why).where(F.col("why").isNotNull()), "mandats", F.col("acteur_uid"), F.col("why"))


def headcounts(periods: DataFrame, events: DataFrame, seats: int = SEATS) -> DataFrame:
    """Events on days with more members in office than seats: a sweep over days, as starts less ends carried forward."""
    n = headcount_by_day(periods, events).where(F.col("concernes") > seats).withColumnRenamed("concernes", "n")
    e = events.join(n, "jour")
    return _anomaly(e, "effectifs", F.col("scrutin_uid"), F.col("n").cast("string"))


def shared_seats(periods: DataFrame, members: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Every pair of members of one constituency in office on the same day; with ``events`` only those in office on the day of some event.

    Of two overlapping terms the later one starts within the other, so a term is brought by its start to all terms of its seat that hold that year, and
    meets each once: an equi-join on seat and year. Years end with the last start, so an open term has no more of them than the data. Whether an event falls in
    the common days is the difference of two running counts over the calendar.
    """
    s = periods.join(members.where(F.col("num_circo").isNotNull() & F.col("departement").isNotNull()).select("acteur_uid", F.concat_ws("/", "departement", "num_circo").alias("siege")), "acteur_uid")
    s = s.select("siege", "acteur_uid", "debut", F.coalesce("fin", F.lit("9999-12-31").cast("date")).alias("f"))
    last = s.groupBy("siege").agg(F.max("debut").alias("last"))
    held = s.join(last, "siege").withColumn("an", F.explode(F.sequence(F.year("debut"), F.greatest(F.year("debut"), F.year(F.least("f", "last"))))))
    held = held.select("siege", "an", F.col("acteur_uid").alias("u"), F.col("debut").alias("d"), F.col("f").alias("e"))
    begun = s.select("siege", F.year("debut").alias("an"), "acteur_uid", "debut", "f")
    pairs = begun.join(held, ["siege", "an"]).where((F.col("d") <= F.col("debut")) & (F.col("debut") <= F.col("e")) & (F.col("u") != F.col("acteur_uid")))
    if events is not None:
        pairs = _with_event(pairs, events)
    return _anomaly(pairs, "sieges_uniques", F.col("siege"), F.concat_ws(" ", F.least("acteur_uid", "u"), F.greatest("acteur_uid", "u"))).distinct()


#: Members laid against all of a seat at a time, one bit each.
BITS_AT_ONCE = 4096


def shared_seat_totals(periods: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """(controle, n, x): of each seat how many rows :func:`shared_seats` with ``events`` has, and the first of them, without a row for every pair.

    Terms become spans of the days with an event. A member meets those present on its first day and those who begin by its last one: two bit sets,
    the latter from unions over powers of two of days. A seat is one group of a row per term; its pairs only exist as bits.
    """
    held = members.where(F.col("num_circo").isNotNull() & F.col("departement").isNotNull()).select("acteur_uid", F.concat_ws("/", "departement", "num_circo").alias("siege"))
    end = F.coalesce("fin", F.lit("9999-12-31").cast("date"))
    s = periods.join(held, "acteur_uid").select("siege", "acteur_uid", F.unix_date("debut").alias("d"), F.unix_date(end).alias("f"))
    days = np.array(sorted(r[0] for r in events.where(F.col("jour").isNotNull()).select(F.unix_date("jour")).distinct().collect()), dtype=np.int64)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        n, first = _meetings(pdf["acteur_uid"].to_numpy(), np.searchsorted(days, pdf["d"].to_numpy()), np.searchsorted(days, pdf["f"].to_numpy(), "right") - 1)
        return pd.DataFrame({"siege": [pdf["siege"].iloc[0]], "n": [n], "m": [first]} if n else {"siege": [], "n": [], "m": []})

    out = s.groupBy("siege").applyInPandas(total, "siege string, n bigint, m array<string>")
    return out.select(F.lit("sieges_uniques").alias("controle"), "n", F.transform("m", lambda m: F.struct(F.col("siege").alias("cle"), m.alias("message"))).alias("x"))


def _meetings(who: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[int, list[str]]:
    """How many pairs of members have spans in common, and the first of them as messages. Both bounds of a span are included; an empty one meets none."""
    kept = start <= end
    names, of = np.unique(who[kept].astype(str), return_inverse=True)
    if len(names) < 2:
        return 0, []
    _, at = np.unique(np.concatenate([start[kept], end[kept]]), return_inverse=True)
    start, end = at[: len(of)], at[len(of) :]
    order = np.argsort(of, kind="stable")
    start, end, of = start[order], end[order], of[order]
    begins = np.searchsorted(of, np.arange(len(names)))
    points, ends_of = int(at.max()) + 1, np.append(begins[1:], len(of))
    n, met = 0, [[] for _ in names]
    spaced = any(" " in x for x in names)
    found: set[str] = set()
    prefixes = sorted(range(len(names)), key=lambda i: names[i] + " ")
    for low in range(0, len(names), BITS_AT_ONCE):
        high = min(low + BITS_AT_ONCE, len(names))
        own = np.flatnonzero((of >= low) & (of < high))
        here, new = (np.zeros((points, (high - low + 7) // 8), np.uint8) for _ in range(2))
        for k in own:
            v = of[k] - low
            here[start[k] : end[k] + 1, v >> 3] |= np.uint8(128 >> (v & 7))
            new[start[k], v >> 3] |= np.uint8(128 >> (v & 7))
        levels = [new]
        while 2 << (len(levels) - 1) <= points:
            step = 1 << (len(levels) - 1)
            levels.append(levels[-1][:-step] | levels[-1][step:])
        for a in range(0, len(names), BITS_AT_ONCE):
            b = min(a + BITS_AT_ONCE, len(names))
            lo, hi = begins[a], ends_of[b - 1]
            rows = here[start[lo:hi]]
            for k in range(len(levels)):
                width = end[lo:hi] - start[lo:hi]  # of the days after the first
                some = np.flatnonzero((width >= 1 << k) & (width < 2 << k))
                rows[some] |= levels[k][start[lo:hi][some] + 1] | levels[k][end[lo:hi][some] - (1 << k) + 1]
            each = np.bitwise_or.reduceat(rows, begins[a:b] - lo, axis=0)
            n += int(np.bitwise_count(each).sum(dtype=np.int64))
            wanted = range(a, b) if spaced else [i for i in prefixes[: 2 * EXAMPLES] if a <= i < b]
            for i in wanted:
                others = np.flatnonzero(np.unpackbits(each[i - a])[: high - low]) + low
                met[i] += [int(j) for j in others if j > i]
    n = (n - len(names)) // 2  # each pair from both sides, and everyone meets itself
    if spaced:
        found = {f"{names[i]} {names[j]}" for i in range(len(names)) for j in met[i]}
        return len(found), sorted(found)[:EXAMPLES]
    first = sorted(f"{names[i]} {names[j]}" for i in prefixes[: 2 * EXAMPLES] for j in met[i])[:EXAMPLES]
    if len(first) < min(n, EXAMPLES):  # the first names meet few: all are looked at
        return n, _first_meetings(names, of, start, end)
    return n, first


def _first_meetings(names: np.ndarray, of: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    first: list[str] = []  # in the order of the messages
    for i in sorted(range(len(names)), key=lambda i: names[i] + " "):
        own = np.flatnonzero(of == i)
        hit = np.zeros(len(of), bool)
        for k in own:
            hit |= (start <= end[k]) & (start[k] <= end)
        first += [f"{names[i]} {names[j]}" for j in np.unique(of[hit]) if j > i]
        if len(first) >= EXAMPLES:
            break
    return sorted(first)[:EXAMPLES]


def _with_event(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """The pairs of which some event day is from ``debut`` to the earlier of the ends ``f`` and ``e``. The calendar has one row a day, whatever the data, and is broadcast."""
    days = events.where(F.col("jour").isNotNull()).groupBy("jour").agg(F.count(F.lit(1)).alias("n"))
    ends = days.agg(F.min("jour").alias("a"), F.max("jour").alias("b"))
    every = ends.where(F.col("a").isNotNull()).select(F.explode(F.sequence("a", "b")).alias("jour"))
    upto = every.join(days, "jour", "left").select("jour", F.sum(F.coalesce("n", F.lit(0))).over(W.orderBy("jour").rowsBetween(W.unboundedPreceding, 0)).alias("c"))
    one = ends.first()
    if one is None or one["a"] is None:
        return pairs.where("false")
    p = pairs.withColumn("__b", F.least("f", "e", F.lit(one["b"]))).withColumn("__a", F.greatest(F.col("debut"), F.lit(one["a"]))).where(F.col("__a") <= F.col("__b"))
    start = F.broadcast(upto.select(F.date_add("jour", 1).alias("__a"), F.col("c").alias("__ca")))
    end = F.broadcast(upto.select(F.col("jour").alias("__b"), F.col("c").alias("__cb")))
    return p.join(end, "__b").join(start, "__a", "left").where(F.col("__cb") > F.coalesce("__ca", F.lit(0)))


def out_of_term(flagged: DataFrame) -> DataFrame:
    return _anomaly(flagged.where(~F.col("eligible")), "votes_hors_mandat", F.concat_ws("/", "scrutin_uid", "acteur_uid"), F.col("position"))


def two_positions(raw: DataFrame) -> DataFrame:
    """Members with more than one position in an event among the rows as received."""
    g = raw.where(F.col("position").isNotNull()).groupBy("scrutin_uid", "acteur_uid").agg(F.count_distinct("position").alias("n")).where(F.col("n") > 1)
    return _anomaly(g, "releve_complet", F.concat_ws("/", "scrutin_uid", "acteur_uid"), F.col("n").cast("string"))


def source_totals(events: DataFrame, ballots: DataFrame) -> DataFrame:
    """Events whose published counts differ from a recount; a missing count is 0 on either side."""
    names = {"pour": "n_pour", "contre": "n_contre", "abstention": "n_abstention", "nonVotant": "n_non_votant"}
    r = ballots.groupBy("scrutin_uid").agg(*[F.count_if(F.col("position") == p).alias(f"r_{p}") for p in names])
    j = events.join(r, "scrutin_uid", "left")
    wrong = F.filter(F.array(*[F.when(F.coalesce(F.col(n), F.lit(0)) != F.coalesce(F.col(f"r_{p}"), F.lit(0)), p) for p, n in names.items()]), lambda x: x.isNotNull())
    return _anomaly(j.withColumn("w", wrong).where(F.size("w") > 0), "totaux_source", F.col("scrutin_uid"), F.concat_ws(",", "w"))


def verify(parts: list[DataFrame], counted: DataFrame | None = None) -> DataFrame:
    """Per check with an anomaly: how many and a few examples. ``counted``: (controle, n, x) of checks whose anomalies are counted and not listed."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    part = out.withColumn("__s", F.pmod(F.xxhash64("cle", "message"), F.lit(64)))  # a check may have more rows than one task should sort
    r = part.withColumn("__r", F.row_number().over(W.partitionBy("controle", "__s").orderBy("cle", "message")))
    r = r.groupBy("controle", "__s").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("__r") <= EXAMPLES, F.struct("cle", "message"))).alias("x"))
    r = r.select("controle", "n", "x") if counted is None else r.select("controle", "n", "x").unionByName(counted)
    first = F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, EXAMPLES)
    return r.groupBy("controle").agg(F.sum("n").alias("n"), first.alias("x")).select("controle", "n", F.col("x.cle").alias("exemples"))


class InvalidData(ValueError):
    """The data break an invariant."""


def require(anomalies: DataFrame) -> None:
    """Raise if any check found something: the gate before publication."""
    found = anomalies.collect()
    if found:
        raise InvalidData("; ".join(f"{r['controle']}: {r['n']}, {', '.join(r['exemples'])}" for r in found))


def gaps_of(periods: DataFrame) -> DataFrame:
    """Interruptions of each member's terms."""
    g = merge_intervals(periods, "acteur_uid", "debut", "fin").where((F.col("genre") == "trou") & (F.col("fin") < OPEN))
    return g.select("acteur_uid", F.date_from_unix_date("debut").alias("debut"), F.date_from_unix_date("fin").alias("fin"))
