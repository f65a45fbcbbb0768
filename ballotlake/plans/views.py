"""What pages show of a member, an event and the whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.expr import EXPRESSED, rate
from ..functions.stats import jeffreys
from ..operators import abstention, agreement, alerts, amendments, lines, scaling
from ..session import written
from . import rollcall
from .assembly import Assembly, sql
from .rollcall import FLOOR, tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(statement: str | None = None):
    def add(f: Callable[[Assembly], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf: tidy(f(Assembly(spark, sf)))
        if statement:
            ORACLE[f.__name__] = statement
        return f

    return add


# --- an event ----------------------------------------------------------------------------------------------------

_DISSENT = "CASE WHEN ln.majoritaire IS NOT NULL AND ln.votants_groupe >= 5 AND ln.part_majoritaire > 0.5 AND b.position IN ('pour', 'contre', 'abstention') THEN b.position <> ln.majoritaire END"


@query(sql("ev bal mem per mp ln", f""", hc AS (SELECT scrutin_uid, count(*) AS n FROM ev JOIN mp ON ev.jour BETWEEN mp.debut AND mp.fin GROUP BY 1),
b AS (SELECT bal.*, ev.jour FROM bal JOIN ev USING (scrutin_uid) JOIN mem USING (acteur_uid) WHERE EXISTS (SELECT 1 FROM mp WHERE mp.acteur_uid = bal.acteur_uid AND ev.jour BETWEEN mp.debut AND mp.fin)),
c AS (SELECT b.scrutin_uid, count(*) FILTER (b.position = 'pour') AS pour, count(*) FILTER (b.position = 'contre') AS contre, count(*) FILTER (b.position = 'abstention') AS abstention, count(*) FILTER (b.position = 'nonVotant') AS empeche,
 count(*) FILTER (b.position IN ('pour', 'contre', 'abstention') AND par_delegation) AS delegues, count(*) FILTER ({_DISSENT}) AS dissidents FROM b LEFT JOIN ln ON ln.scrutin_uid = b.scrutin_uid AND ln.groupe_uid = b.groupe_uid GROUP BY 1)
SELECT ev.scrutin_uid, coalesce(n, 0) AS concernes, coalesce(pour, 0) AS pour, coalesce(contre, 0) AS contre, coalesce(abstention, 0) AS abstention, coalesce(empeche, 0) AS empeche, coalesce(delegues, 0) AS delegues, coalesce(dissidents, 0) AS dissidents,
coalesce(n, 0) - coalesce(pour, 0) - coalesce(contre, 0) - coalesce(abstention, 0) - coalesce(empeche, 0) AS absents, (SELECT count(*) FROM mem) - coalesce(n, 0) AS hors_mandat, 577 - coalesce(n, 0) AS vacants
FROM ev LEFT JOIN hc USING (scrutin_uid) LEFT JOIN c USING (scrutin_uid)"""))
def releves_scrutins(a: Assembly) -> DataFrame:
    """Every event with how many members have each status, by subtraction from the day's headcount: absent members have no row to count, and no member is joined with an event."""
    n = lines.headcount_by_day(lines.term_periods(a.members), a.events)
    b = rollcall._flagged(a).where("eligible").join(a.members.select("acteur_uid"), "acteur_uid", "left_semi")
    b = b.join(a.lines.select("scrutin_uid", "groupe_uid", "majoritaire", "votants_groupe", "part_majoritaire"), ["scrutin_uid", "groupe_uid"], "left")
    said = F.col("position").isin(*EXPRESSED)
    c = b.groupBy("scrutin_uid").agg(
        *[F.count_if(F.col("position") == p).alias(p) for p in EXPRESSED], F.count_if(F.col("position") == "nonVotant").alias("empeche"), F.count_if(said & F.col("par_delegation")).alias("delegues"),
        F.count_if(said & lines.dissent_flag(F.col("position"))).alias("dissidents"),
    )
    total = a.members.count()
    e = a.events.select("scrutin_uid", "jour").join(n, "jour", "left").join(c, "scrutin_uid", "left")
    e = e.na.fill(0, ["concernes", *EXPRESSED, "empeche", "delegues", "dissidents"]).drop("jour")
    e = e.withColumn("absents", F.col("concernes") - F.col("pour") - F.col("contre") - F.col("abstention") - F.col("empeche"))
    return e.withColumn("hors_mandat", F.lit(total) - F.col("concernes")).withColumn("vacants", F.lit(alerts.SEATS) - F.col("concernes"))


@query(sql("ev bal mem per mp ln", f""", s AS (SELECT * FROM ev WHERE type_vote_code = 'SPS' AND jour IS NOT NULL ORDER BY scrutin_uid LIMIT 1), e AS (SELECT DISTINCT acteur_uid FROM mp, s WHERE s.jour BETWEEN mp.debut AND mp.fin),
b AS (SELECT bal.* FROM bal JOIN s USING (scrutin_uid))
SELECT mem.acteur_uid, nom_complet, groupe, b.position, CASE WHEN e.acteur_uid IS NULL THEN 'hors_mandat' WHEN b.position IN ('pour', 'contre', 'abstention') THEN b.position WHEN b.position = 'nonVotant' THEN 'empeche' ELSE 'absent' END AS statut,
{_DISSENT} AS dissident, coalesce(par_delegation, false) AS par_delegation, cause, en_exercice FROM mem LEFT JOIN e USING (acteur_uid) LEFT JOIN b USING (acteur_uid) LEFT JOIN ln ON ln.scrutin_uid = b.scrutin_uid AND ln.groupe_uid = b.groupe_uid"""))
def releve_scrutin(a: Assembly) -> DataFrame:
    """All members in the first solemn event; see :func:`event_page` for any other."""
    s = a.events.where((F.col("type_vote_code") == "SPS") & F.col("jour").isNotNull()).orderBy("scrutin_uid").select("scrutin_uid").first()
    return event_page(a, s[0] if s else "")


def event_page(a: Assembly, uid: str) -> DataFrame:
    """Every member with its status in one event; starts from members, since the absent have no ballot."""
    e = a.events.where(F.col("scrutin_uid") == uid).select("jour").first()
    m = a.members.select("acteur_uid", "nom_complet", "groupe", "en_exercice").withColumn("jour", F.lit(e[0] if e else None).cast("date"))
    m = lines.in_term(m, lines.term_periods(a.members)).drop("jour")
    b = a.ballots.where(F.col("scrutin_uid") == uid).select("acteur_uid", "groupe_uid", "position", "par_delegation", "cause")
    line = a.lines.where(F.col("scrutin_uid") == uid).select("groupe_uid", "majoritaire", "votants_groupe", "part_majoritaire")
    j = m.join(b, "acteur_uid", "left").join(line, "groupe_uid", "left")
    flag = F.when(F.col("position").isin(*EXPRESSED), lines.dissent_flag(F.col("position")))
    return j.select("acteur_uid", "nom_complet", "groupe", "position", rollcall.status(F.col("eligible"), F.col("position")).alias("statut"), flag.alias("dissident"), F.coalesce("par_delegation", F.lit(False)).alias("par_delegation"), "cause", "en_exercice")


@query(sql("ev am", ", d AS (SELECT dossier_uid, count(*) AS n, count(*) FILTER (sort = 'Adopté') AS ad FROM am WHERE dossier_uid IS NOT NULL GROUP BY 1) SELECT scrutin_uid, 'https://vote.invalid/' || numero AS scrutin, 'https://dossier.invalid/' || dossier_uid AS dossier, 'https://seance.invalid/' || seance_uid AS seance, coalesce(n, 0) AS amendements, coalesce(ad, 0) AS adoptes FROM ev LEFT JOIN d USING (dossier_uid)"))
def liens_scrutins(a: Assembly) -> DataFrame:
    """Evidence of each event: links, null where there is nothing to link to, and the amendments to its bill."""
    d = amendments.outcomes_by(a.amendments.where(F.col("dossier_uid").isNotNull()), ["dossier_uid"]).select("dossier_uid", F.col("deposes").alias("amendements"), "adoptes")
    e = a.events.join(d, "dossier_uid", "left").na.fill(0, ["amendements", "adoptes"])
    at = lambda what, c: text.link(f"https://{what}.invalid/%s", F.col(c).cast("string"))
    return e.select("scrutin_uid", at("vote", "numero").alias("scrutin"), at("dossier", "dossier_uid").alias("dossier"), at("seance", "seance_uid").alias("seance"), "amendements", "adoptes")


# --- a member ----------------------------------------------------------------------------------------------------


def _busiest(a: Assembly) -> str:
    r = a.expressed.join(a.members.select("acteur_uid"), "acteur_uid", "left_semi").groupBy("acteur_uid").count().orderBy(F.col("count").desc(), "acteur_uid").first()
    return r[0] if r else ""


_WHO = ", w AS (SELECT acteur_uid FROM xb JOIN mem USING (acteur_uid) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), b AS (SELECT bal.* FROM bal JOIN w USING (acteur_uid))"


@query(sql("ev bal mem per mp ln", _WHO + f""", t AS (SELECT * FROM ev WHERE portee = 'texte'), el AS (SELECT DISTINCT scrutin_uid FROM t, mp JOIN w USING (acteur_uid) WHERE t.jour BETWEEN mp.debut AND mp.fin)
SELECT t.scrutin_uid, t.jour, b.position, CASE WHEN el.scrutin_uid IS NULL THEN 'hors_mandat' WHEN b.position IN ('pour', 'contre', 'abstention') THEN b.position WHEN b.position = 'nonVotant' THEN 'empeche' ELSE 'absent' END AS statut,
{_DISSENT} AS dissident, coalesce(par_delegation, false) AS par_delegation FROM t LEFT JOIN el USING (scrutin_uid) LEFT JOIN b USING (scrutin_uid) LEFT JOIN ln ON ln.scrutin_uid = b.scrutin_uid AND ln.groupe_uid = b.groupe_uid"""))
def releve_depute(a: Assembly) -> DataFrame:
    """All events of the highest stake for the busiest member; see :func:`member_record` for any other."""
    return member_record(a, _busiest(a))


def member_record(a: Assembly, uid: str) -> DataFrame:
    """Every event of the highest stake with one member's status in it; starts from the events, so what was missed is there."""
    e = a.events.where(F.col("portee") == "texte").select("scrutin_uid", "jour").withColumn("acteur_uid", F.lit(uid))
    e = lines.in_term(e, lines.term_periods(a.members.where(F.col("acteur_uid") == uid)))
    b = a.ballots.where(F.col("acteur_uid") == uid).select("scrutin_uid", "groupe_uid", "position", "par_delegation")
    j = e.join(b, "scrutin_uid", "left").join(a.lines.select("scrutin_uid", "groupe_uid", "majoritaire", "votants_groupe", "part_majoritaire"), ["scrutin_uid", "groupe_uid"], "left")
    flag = F.when(F.col("position").isin(*EXPRESSED), lines.dissent_flag(F.col("position")))
    return j.select("scrutin_uid", "jour", "position", rollcall.status(F.col("eligible"), F.col("position")).alias("statut"), flag.alias("dissident"), F.coalesce("par_delegation", F.lit(False)).alias("par_delegation"))


@query(sql("ev bal mem per mp", rollcall._PART + """, x AS (SELECT acteur_uid, coalesce(n, 0) AS eligibles, coalesce(x, 0) AS exprimes, greatest(coalesce(n, 0) - coalesce(st, 0), 0) AS d FROM al LEFT JOIN el USING (acteur_uid) LEFT JOIN tk USING (acteur_uid))
SELECT acteur_uid, eligibles, exprimes, round(CASE WHEN d > 0 THEN exprimes / d END, 6) AS taux FROM x ORDER BY round(CASE WHEN d > 0 THEN exprimes / d END, 9) NULLS LAST, acteur_uid LIMIT 20"""))
def moins_presents(a: Assembly) -> DataFrame:
    """The twenty least present members; one without a denominator comes last."""
    n = lines.eligible_counts(lines.term_periods(a.members), lines.calendar(a.events), ["n"])
    p = lines.participation(n, rollcall._flagged(a))
    return p.orderBy(F.round("taux", 9).asc_nulls_last(), "acteur_uid").limit(20).select("acteur_uid", "eligibles", "exprimes", "taux")


@query(sql("ev bal mem ln", _WHO + f""", v AS (SELECT b.scrutin_uid, ev.jour, b.position, {_DISSENT} AS dissident FROM b JOIN ev USING (scrutin_uid) LEFT JOIN ln ON ln.scrutin_uid = b.scrutin_uid AND ln.groupe_uid = b.groupe_uid WHERE b.position IN ('pour', 'contre', 'abstention'))
SELECT scrutin_uid, jour, position, (SELECT count(*) FROM v) AS total, (SELECT count(*) FROM v WHERE dissident) AS gardes FROM v WHERE dissident ORDER BY jour DESC NULLS LAST, scrutin_uid LIMIT 20"""))
def dissidences_depute(a: Assembly) -> DataFrame:
    """The last twenty dissents of the busiest member, with how many ballots it cast and how many of them are dissents."""
    return member_log(a, _busiest(a), dissents_only=True, limit=20)


def member_log(a: Assembly, uid: str, dissents_only: bool = False, limit: int = 50) -> DataFrame:
    own = a.expressed.where(F.col("acteur_uid") == uid).select("scrutin_uid", "groupe_uid", "position").join(a.events.select("scrutin_uid", "jour"), "scrutin_uid")
    j = own.join(a.lines.select("scrutin_uid", "groupe_uid", "majoritaire", "votants_groupe", "part_majoritaire"), ["scrutin_uid", "groupe_uid"], "left").withColumn("dissident", lines.dissent_flag(F.col("position")))
    kept = F.col("dissident") if dissents_only else F.lit(True)
    total = j.agg(F.count(F.lit(1)).alias("n"), F.count_if(kept).alias("k")).first()
    return j.where(kept).orderBy(F.col("jour").desc_nulls_last(), "scrutin_uid").limit(limit).select("scrutin_uid", "jour", "position", F.lit(total["n"]).alias("total"), F.lit(total["k"]).alias("gardes"))


@query()
def bilans(a: Assembly) -> DataFrame:
    """Per member the record in the three scopes that make up the whole (bills, the rest by subtraction, solemn ones), each with its denominator; a rate is null without any ballot."""
    s = _scopes(a)
    one = F.struct("perimetre", "eligibles", *EXPRESSED, "empeche", "absent", "delegues", F.when(F.col("exprimes") > 0, rate(F.col("exprimes"), F.col("eligibles"))).alias("part_exprimee"))
    return s.withColumn("exprimes", F.col("pour") + F.col("contre") + F.col("abstention")).groupBy("acteur_uid").agg(F.array_sort(F.collect_list(one)).alias("bilan"))


def _scopes(a: Assembly) -> DataFrame:
    """The three scopes, and all but the bills by subtraction."""
    s = rollcall.statistiques_deputes(a)
    n = ["eligibles", *EXPRESSED, "empeche", "absent", "delegues"]
    whole = F.when(F.col("perimetre") == "tous", 1).when(F.col("perimetre") == "texte", -1).otherwise(0)
    rest = s.groupBy("acteur_uid").agg(*[F.sum(whole * F.col(c)).alias(c) for c in n]).withColumn("perimetre", F.lit("autres"))
    return s.select("acteur_uid", "perimetre", *n).unionByName(rest.select("acteur_uid", "perimetre", *n))


@query(sql("ev bal mem per mp", rollcall._PART + """, d AS (SELECT mem.acteur_uid, groupe, en_exercice, coalesce(n, 0) AS el, coalesce(x, 0) AS ex, greatest(coalesce(n, 0) - coalesce(st, 0), 0) AS dn FROM mem LEFT JOIN el USING (acteur_uid) LEFT JOIN tk USING (acteur_uid)),
r AS (SELECT *, CASE WHEN dn > 0 THEN ex / dn END AS p FROM d)
SELECT groupe, count(*) AS effectif, count(*) FILTER (en_exercice) AS effectif_actuel, round(avg(p), 6) AS participation_moyenne, round(median(p), 6) AS participation_mediane, round(min(p), 6) AS participation_min, round(max(p), 6) AS participation_max,
round(CASE WHEN sum(dn) > 0 THEN sum(ex) / sum(dn) END, 6) AS participation_ensemble FROM r GROUP BY 1"""))
def presence_groupes(a: Assembly) -> DataFrame:
    """Per group the members' presence - mean, median, extremes - and the ratio of the sums."""
    n = lines.eligible_counts(lines.term_periods(a.members), lines.calendar(a.events), ["n"])
    p = a.members.select("acteur_uid", "groupe", "en_exercice").join(lines.participation(n, rollcall._flagged(a)), "acteur_uid", "left").na.fill(0, ["exprimes", "denominateur"])
    return p.groupBy("groupe").agg(
        F.count(F.lit(1)).alias("effectif"), F.count_if("en_exercice").alias("effectif_actuel"), F.avg("taux").alias("participation_moyenne"), F.median("taux").alias("participation_mediane"), F.min("taux").alias("participation_min"),
        F.max("taux").alias("participation_max"), rate(F.sum("exprimes"), F.sum("denominateur")).alias("participation_ensemble"),
    )


@query()
def fiches(a: Assembly) -> DataFrame:
    """One nested row per member: identity, activity, place, amendments, all co-signers, responsibilities, all members measured with it from the nearest and from the farthest.

    Each part is written by itself, so that the shuffles of one are gone before the next begins; what is joined at the end has one row per member. The lists of
    members are as many as the counted pairs and are not written before: the other parts come to them.
    """
    numbers = rollcall._numbers(a)
    near = agreement.nearest_by_number(rollcall._counted(a), numbers, None, FLOOR)
    n = lines.eligible_counts(lines.term_periods(a.members), lines.calendar(a.events), ["n"])
    part = lines.participation(n, rollcall._flagged(a)).select("acteur_uid", F.struct("eligibles", "exprimes", "structurels", "denominateur", "taux").alias("activite"))
    d = lines.dissent_by(lines.against_line(a.expressed, a.lines), ["acteur_uid"], 1).withColumn("i", jeffreys(F.col("n_dissidents").cast("double"), F.col("n_votes").cast("double")))
    d = d.select("acteur_uid", F.struct("n_votes", "n_dissidents", "taux", F.col("i.bas").alias("bas"), F.col("i.haut").alias("haut"), (F.col("n_votes") >= 50).alias("comparable")).alias("dissidence"))
    w = W.partitionBy("unite")
    place = rollcall._intervals(a).withColumn("rang", F.row_number().over(w.orderBy("position", "acteur_uid"))).withColumn("classes", F.count(F.lit(1)).over(w))
    place = place.groupBy("acteur_uid").agg(F.array_sort(F.collect_list(F.struct("unite", "position", "bas", "haut", "rang", "classes", "n_votes"))).alias("positions"))
    own = amendments.by_author(a.amendments, ["auteur_uid"]).join(amendments.outcomes_by(a.amendments, ["auteur_uid"]).drop("deposes", "examines", "adoptes", "rejetes"), "auteur_uid", "left").withColumnRenamed("auteur_uid", "acteur_uid")
    m = amendments.filed_and_cosigned(a.amendments).drop("deposes").join(own, "acteur_uid", "left")
    m = m.select("acteur_uid", F.struct(*[c for c in m.columns if c != "acteur_uid"]).alias("amendements"))
    co = amendments.co_signers(a.amendments, a.members)
    tasks = rollcall.responsabilites(a).groupBy("acteur_uid").agg(F.array_sort(F.collect_list(F.struct("rang", "type_organe", "organe_uid", "libelle"))).alias("responsabilites"))
    out = a.members.select("acteur_uid", "nom_complet", "groupe", text.slug(F.col("nom_complet")).alias("slug"), "departement", "num_circo", "en_exercice", "periodes_mandat")
    out = out.withColumn("slug_unique", F.count(F.lit(1)).over(W.partitionBy("slug")) == 1)
    parts = [written(arm, "part") for arm in (part, d, m, co)]
    for arm in (*parts[:2], place, *parts[2:], tasks):
        out = out.join(arm, "acteur_uid", "left")
    return out.join(numbers.select("acteur_uid", "num"), "acteur_uid").join(near, "num", "left").drop("num")


# --- matrices ----------------------------------------------------------------------------------------------------


@query()
def matrice_groupes(a: Assembly) -> DataFrame:
    """Agreement of every ordered pair of groups, both conventions, with the place of each group by its median on the axis; groups without one come last."""
    p = rollcall._fitted(a).where((F.col("genre") == "membre") & (F.col("axe") == 1)).select(F.col("uid").alias("acteur_uid"), F.col("valeur").alias("x"))
    g = a.members.where(F.col("groupe").isNotNull() & F.col("en_exercice")).select("acteur_uid", "groupe").join(p, "acteur_uid", "left").groupBy("groupe")
    g = g.agg(F.median("x").alias("mediane"), F.count_distinct("acteur_uid").alias("effectif")).withColumn("rang", F.row_number().over(W.orderBy(F.col("mediane").asc_nulls_last(), "groupe")))
    sitting = a.members.where("en_exercice")
    m = agreement.with_all_pairs(agreement.group_agreement(rollcall._pairs(a), sitting, FLOOR), sitting, ("n_paires", "scrutins_communs"))
    one = g.select(F.col("groupe").alias("groupe_a"), F.col("rang").alias("rang_a"), F.col("effectif").alias("effectif_a"))
    return m.join(one, "groupe_a").join(g.select(F.col("groupe").alias("groupe_b"), F.col("rang").alias("rang_b")), "groupe_b")


@query()
def matrice_accords(a: Assembly) -> DataFrame:
    """Per assembly or college the matrix of agreement in the order of the axis, packed: one byte a pair of the upper triangle (255: not measured), two for the shared events, and the bounds of the scale in twentieths."""
    place = rollcall._fitted(a).where((F.col("genre") == "membre") & (F.col("axe") == 1)).select("unite", F.col("uid").alias("u"), F.col("valeur").alias("x"))
    return scaling.packed_matrices(rollcall._pairs(a), place)


@query()
def groupes_series(a: Assembly) -> DataFrame:
    """The groups in the order in which their agreement with all others changes least."""
    return scaling.seriated(agreement.with_all_pairs(agreement.group_agreement(rollcall._pairs(a), a.members, FLOOR), a.members), "groupe_a", "groupe_b", "accord_moyen")


# --- the whole ---------------------------------------------------------------------------------------------------


@query(sql("ev", "SELECT CAST(date_trunc('week', max(jour)) AS date) AS semaine FROM ev"))
def derniere_semaine(a: Assembly) -> DataFrame:
    """The Monday of the last day with an event."""
    return a.events.agg(F.max("jour").alias("j")).select(alerts.monday(F.col("j")).alias("semaine"))


@query(sql("ev", """, k AS (SELECT 'portee' AS champ, portee AS valeur FROM ev UNION ALL SELECT 'categorie', categorie FROM ev UNION ALL SELECT 'type_vote_code', type_vote_code FROM ev),
n AS (SELECT champ, valeur, count(*) AS n FROM k GROUP BY 1, 2) SELECT champ, valeur, n, round(n / sum(n) OVER (PARTITION BY champ), 6) AS part FROM n
UNION ALL SELECT 'dossier', 'avec', count(dossier_uid), round(count(dossier_uid) / count(*), 6) FROM ev UNION ALL SELECT 'bloc', 'dossiers', count(DISTINCT dossier_uid), NULL FROM ev UNION ALL SELECT 'bloc', 'seances', count(DISTINCT seance_uid), NULL FROM ev"""))
def apercu_comptes(a: Assembly) -> DataFrame:
    """Events by stake, category and kind, how many name a bill, and how many blocks there are."""
    e = a.events
    one = [e.select(F.lit(c).alias("champ"), F.col(c).alias("valeur")) for c in ("portee", "categorie", "type_vote_code")]
    n = one[0].unionByName(one[1]).unionByName(one[2]).groupBy("champ", "valeur").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.col("n") / F.sum("n").over(W.partitionBy("champ")))
    s = e.agg(F.count("dossier_uid").alias("d"), F.count(F.lit(1)).alias("t"), F.count_distinct("dossier_uid").alias("b"), F.count_distinct("seance_uid").alias("s"))
    rows = F.array(
        F.struct(F.lit("dossier").alias("champ"), F.lit("avec").alias("valeur"), F.col("d").alias("n"), rate(F.col("d"), F.col("t")).alias("part")),
        F.struct(F.lit("bloc").alias("champ"), F.lit("dossiers").alias("valeur"), F.col("b").alias("n"), F.lit(None).cast("double").alias("part")),
        F.struct(F.lit("bloc").alias("champ"), F.lit("seances").alias("valeur"), F.col("s").alias("n"), F.lit(None).cast("double").alias("part")),
    )
    return n.unionByName(s.select(F.explode(rows).alias("r")).select("r.*"))


@query(sql("ev", "SELECT year(jour) AS annee, count(*) AS n, list(scrutin_uid ORDER BY jour DESC, scrutin_uid)[1:5] AS derniers FROM ev WHERE jour IS NOT NULL GROUP BY 1"))
def derniers_par_annee(a: Assembly) -> DataFrame:
    """Per year how many events there are and the last five of them, newest first."""
    e = a.events.where(F.col("jour").isNotNull()).withColumn("annee", F.year("jour"))
    top = e.withColumn("r", F.row_number().over(W.partitionBy("annee").orderBy(F.col("jour").desc(), "scrutin_uid"))).where(F.col("r") <= 5)
    top = top.groupBy("annee").agg(F.array_sort(F.collect_list(F.struct("r", "scrutin_uid"))).alias("x")).select("annee", F.col("x.scrutin_uid").alias("derniers"))
    return e.groupBy("annee").agg(F.count(F.lit(1)).alias("n")).join(top, "annee")


@query(sql("ev", "SELECT count(*) AS total FROM ev WHERE contains(lower(titre), 'santé') AND portee = 'detail'"))
def recherche_total(a: Assembly) -> DataFrame:
    """How many events the search finds, beside the page that ``recherche_scrutins`` shows."""
    return a.events.where(F.contains(F.lower("titre"), F.lit("santé")) & (F.col("portee") == "detail")).agg(F.count(F.lit(1)).alias("total"))


@query(sql("bal mem", ", g AS (SELECT acteur_uid, round(count(*) FILTER (position = 'pour') / count(*), 4) AS p FROM xb GROUP BY 1) SELECT groupe, p AS valeur, count(*) AS n FROM g JOIN mem USING (acteur_uid) WHERE groupe IS NOT NULL GROUP BY 1, 2"))
def valeurs_par_groupe(a: Assembly) -> DataFrame:
    """The values a distribution is drawn from, each once per group with its number, so that no group is gathered in one row."""
    g = a.expressed.groupBy("acteur_uid").agg(F.round(F.count_if(F.col("position") == "pour") / F.count(F.lit(1)), 4).alias("valeur"))
    return g.join(a.members.where(F.col("groupe").isNotNull()).select("acteur_uid", "groupe"), "acteur_uid").groupBy("groupe", "valeur").agg(F.count(F.lit(1)).alias("n"))


_OTHER = "NOT regexp_matches(coalesce(titre, ''), '^la motion|^l.ensemble\\b|^(l.|les )(sous.)?amendements?\\b|^le sous.amendement|^(l.|les )articles?\\b|^la déclaration|^la demande', 'i')"


@query(sql("ev", f"SELECT portee, scrutin_uid, titre FROM ev WHERE {_OTHER} QUALIFY row_number() OVER (PARTITION BY portee ORDER BY scrutin_uid) <= 10"))
def exemples_sans_categorie(a: Assembly) -> DataFrame:
    """Up to ten titles of each stake that match no category."""
    t = F.coalesce("titre", F.lit(""))
    e = a.events.where((text.category(t) == "autre") & ~t.rlike("(?iu)^la motion"))
    return e.withColumn("r", F.row_number().over(W.partitionBy("portee").orderBy("scrutin_uid"))).where(F.col("r") <= 10).select("portee", "scrutin_uid", "titre")


@query(sql("ev bal mem", rollcall._XM + "SELECT portee, count(DISTINCT scrutin_uid) AS n_scrutins, CASE portee WHEN 'detail' THEN 0 WHEN 'intermediaire' THEN 1 WHEN 'texte' THEN 2 ELSE 3 END::BIGINT AS ordre FROM xm GROUP BY 1"))
def portees_ordonnees(a: Assembly) -> DataFrame:
    """The stakes in order with the events that agreement at each rests on."""
    return rollcall._known(a, "portee").groupBy("portee").agg(F.count_distinct("scrutin_uid").alias("n_scrutins")).withColumn("ordre", text.level_order(F.col("portee")))


@query()
def inertie_portees(a: Assembly) -> DataFrame:
    """The share of the first axis by stake, of each assembly or college: does it rise with what is at stake?"""
    x = rollcall._with_units(a).join(a.events.select("scrutin_uid", "portee"), "scrutin_uid").where(F.col("portee").isNotNull())
    x = x.withColumn("unite", F.concat_ws("|", "unite", "portee"))
    p = scaling.pca(x, dims=1).groupBy("unite").agg(F.max("inertie1").alias("inertie1"), F.count(F.lit(1)).alias("n_membres"))
    return p.select(F.split("unite", r"\|")[0].alias("unite"), F.split("unite", r"\|")[1].alias("portee"), "inertie1", "n_membres")


@query()
def abstention_camps_modele(a: Assembly) -> DataFrame:
    """The abstainers' place between the camps on the axis of the model of their assembly or college."""
    p = rollcall._fitted(a).where((F.col("genre") == "membre") & (F.col("axe") == 1)).select("unite", F.col("uid").alias("acteur_uid"), F.col("valeur").alias("axe"))
    x = rollcall._with_units(a).join(p, ["unite", "acteur_uid"])
    return abstention.between_camps(x).select("scrutin_uid", "entre", "relatif")


# --- network -----------------------------------------------------------------------------------------------------


@query(sql("mem am", rollcall._NET + """SELECT a, b, ga AS groupe_a, gb AS groupe_b, communs, round(communs / (x.signatures + y.signatures - communs), 6) AS jaccard FROM eg JOIN nd x ON x.acteur_uid = a JOIN nd y ON y.acteur_uid = b
WHERE x.signatures >= 5 AND y.signatures >= 5 AND communs >= 2 AND ga IS DISTINCT FROM gb ORDER BY round(communs / (x.signatures + y.signatures - communs), 9) DESC, a, b LIMIT 20"""))
def paires_cosignataires(a: Assembly) -> DataFrame:
    """The twenty pairs across groups that sign together most, for their signatures."""
    e, n = rollcall._network(a)
    return amendments.top_pairs(e, n, a.members, 20, 5, 2)


_SOLO = """, mo AS (SELECT * FROM mem WHERE en_exercice), so AS (SELECT DISTINCT amendement_uid, u AS acteur_uid FROM (SELECT amendement_uid, auteur_uid AS u FROM am WHERE jour >= DATE '2024-10-01' AND NOT coalesce(auteur_rapporteur, false)
 UNION ALL SELECT amendement_uid, nullif(upper(trim(unnest(cosignataires))), '') FROM am WHERE jour >= DATE '2024-10-01' AND NOT coalesce(auteur_rapporteur, false)) WHERE u IN (SELECT acteur_uid FROM mo)),
sk AS (SELECT * FROM so WHERE amendement_uid IN (SELECT amendement_uid FROM so GROUP BY 1 HAVING count(*) BETWEEN 2 AND 10)) SELECT l.acteur_uid AS a, r.acteur_uid AS b, count(*) AS communs FROM sk l JOIN sk r ON l.amendement_uid = r.amendement_uid AND l.acteur_uid < r.acteur_uid GROUP BY 1, 2"""


@query(sql("mem am", _SOLO))
def cosignatures_restreintes(a: Assembly) -> DataFrame:
    """The network of sitting members, since a day, without what rapporteurs file."""
    return amendments.network(amendments.signatures(amendments.chosen(a.amendments, "2024-10-01", True), a.members.where("en_exercice")))[0]


@query(sql("mem am", rollcall._NET + """, pr AS (SELECT mem.acteur_uid, groupe, signatures FROM mem JOIN nd USING (acteur_uid)), sz AS (SELECT groupe, count(*) AS taille FROM pr GROUP BY 1), n AS (SELECT count(*) AS n FROM pr),
ow AS (SELECT u, sum(communs) AS liens, sum(CASE WHEN ga IS DISTINCT FROM gb THEN communs ELSE 0 END) AS dehors FROM (SELECT a AS u, communs, ga, gb FROM eg UNION ALL SELECT b, communs, gb, ga FROM eg) GROUP BY 1)
SELECT acteur_uid, pr.groupe, signatures, round(dehors / liens, 6) AS part_dehors, round((dehors / liens) / nullif((n.n - taille) / (n.n - 1), 0), 6) AS ouverture FROM pr JOIN sz ON sz.groupe IS NOT DISTINCT FROM pr.groupe CROSS JOIN n LEFT JOIN ow ON u = acteur_uid"""))
def ouverture(a: Assembly) -> DataFrame:
    """The openness of every member who signs, whatever its group; null without links."""
    e, n = rollcall._network(a)
    return amendments.openness(e, n, a.members).select("acteur_uid", "groupe", "signatures", "part_dehors", F.col("ratio").alias("ouverture"))


@query(sql("mem am", rollcall._NET + """, n AS (SELECT amendement_uid, count(*) AS n FROM s0 GROUP BY 1 HAVING count(*) >= 2), k AS (SELECT c AS plafond, n.* FROM n, unnest([NULL, 100, 40, 20, 10, 6]) t(c) WHERE c IS NULL OR n <= c),
sc AS (SELECT plafond, s0.amendement_uid, acteur_uid FROM k JOIN s0 USING (amendement_uid)), pc AS (SELECT l.plafond, l.acteur_uid AS a, r.acteur_uid AS b, count(*) AS c FROM sc l JOIN sc r ON l.amendement_uid = r.amendement_uid AND l.plafond IS NOT DISTINCT FROM r.plafond AND l.acteur_uid < r.acteur_uid GROUP BY 1, 2, 3),
tp AS (SELECT * FROM pc QUALIFY row_number() OVER (PARTITION BY plafond ORDER BY c DESC, a, b) = 1), sm AS (SELECT plafond, median(m) AS mediane_signatures FROM (SELECT plafond, acteur_uid, count(*) AS m FROM sc GROUP BY 1, 2) GROUP BY 1)
SELECT CAST(k.plafond AS BIGINT) AS plafond, count(*) AS n_amendements, CAST(sum(n) AS BIGINT) AS n_signatures, max(mediane_signatures) AS mediane_signatures, max(tp.a) AS a, max(tp.b) AS b, max(tp.c) AS communs
FROM k LEFT JOIN tp ON tp.plafond IS NOT DISTINCT FROM k.plafond LEFT JOIN sm ON sm.plafond IS NOT DISTINCT FROM k.plafond GROUP BY 1"""))
def plafonds_compares(a: Assembly) -> DataFrame:
    """Caps on signers and none: amendments kept, signatures, the median of members' signatures and the pair that signs together most."""
    return amendments.caps_compared(a.amendments, a.members)


@query(sql("ev bal mem", rollcall._XM + rollcall._PAIRS + "SELECT mem.acteur_uid, groupe, count(taux) AS n_mesures FROM mem LEFT JOIN (SELECT a AS acteur_uid, taux FROM pg UNION ALL SELECT b, taux FROM pg) USING (acteur_uid) WHERE en_exercice GROUP BY 1, 2"))
def mesures_par_depute(a: Assembly) -> DataFrame:
    """Of every sitting member, with how many others its agreement is measured."""
    p = agreement.mirrored(rollcall._pairs(a).join(a.members.select(F.col("acteur_uid").alias("a")), "a", "left_semi").join(a.members.select(F.col("acteur_uid").alias("b")), "b", "left_semi").select("a", "b"))
    n = p.groupBy(F.col("a").alias("acteur_uid")).agg(F.count(F.lit(1)).alias("n_mesures"))
    return a.members.where("en_exercice").select("acteur_uid", "groupe").join(n, "acteur_uid", "left").na.fill(0, ["n_mesures"])
