"""One function per command a user types, each with its options and a DataFrame as its result."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import abstention, agreement, alerts, amendments, ideal, lines, topics
from ..sources import catalog, ingest
from . import rollcall, views
from .assembly import Assembly

COMMANDS: dict[str, Callable[..., DataFrame]] = {}


def command(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Register a command: the first argument is the assembly, the others are its options, typed by their defaults."""
    COMMANDS[f.__name__] = f
    return f


def options(name: str) -> dict[str, inspect.Parameter]:
    return {k: p for k, p in list(inspect.signature(COMMANDS[name]).parameters.items())[1:]}


def _since(a: Assembly, depuis: str | None = None, portee: str | None = None) -> DataFrame:
    """The expressed ballots of known members in chosen events."""
    e = rollcall.select_events(a.events, since=depuis, levels=[portee] if portee else None)
    return rollcall._known(a).join(e.select("scrutin_uid"), "scrutin_uid", "left_semi")


def _pairs(a: Assembly, depuis: str | None, portee: str | None, floor: int) -> DataFrame:
    if depuis is None and portee is None and floor >= rollcall.FLOOR:
        return rollcall._pairs(a).where(F.col("communs") >= floor)
    return agreement.pair_counts(_since(a, depuis, portee), floor=floor)


@command
def proches(a: Assembly, nom: str, k: int = 10, hors_groupe: bool = False, inverse: bool = False, depuis: str | None = None, min_communs: int = 30) -> DataFrame:
    """The members nearest to one (or farthest from it)."""
    who = rollcall.one_member(a.members, nom)
    own = a.members.where(F.col("acteur_uid") == who).select("groupe").first()[0]
    c = agreement.counts_with_one(_since(a, depuis), who).where(F.col("communs") >= min_communs).withColumn("taux", F.col("accord") / F.col("communs"))
    j = c.join(a.members.select(F.col("acteur_uid").alias("b"), "nom_complet", "groupe"), "b")
    if hors_groupe:
        j = j.where(~F.col("groupe").eqNullSafe(F.lit(own)))
    order = F.col("taux").asc() if inverse else F.col("taux").desc()
    return j.orderBy(order, "b").limit(k).select(F.col("b").alias("acteur_uid"), "nom_complet", "groupe", "taux", "communs")


@command
def paires(a: Assembly, k: int = 20, meme_groupe: bool = False, min_communs: int = 100, depuis: str | None = None) -> DataFrame:
    return agreement.remarkable(_pairs(a, depuis, None, min_communs), a.members, k, min_communs, across=not meme_groupe)


@command
def cohesion(a: Assembly, depuis: str | None = None, min_communs: int = 30) -> DataFrame:
    g = agreement.group_agreement(_pairs(a, depuis, None, min_communs), a.members, min_communs)
    return agreement.cohesion(g, a.members).orderBy(F.col("cohesion").desc_nulls_last(), "groupe")


@command
def participation(a: Assembly, k: int = 15, pire: bool = False) -> DataFrame:
    n = lines.eligible_counts(lines.term_periods(a.members), lines.calendar(a.events), ["n"])
    p = lines.participation(n, rollcall._flagged(a)).join(a.members.select("acteur_uid", "nom_complet", "groupe"), "acteur_uid")
    order = F.col("taux").asc_nulls_last() if pire else F.col("taux").desc_nulls_last()
    return p.orderBy(order, "acteur_uid").limit(k)


@command
def dissidence(a: Assembly, k: int = 15, min_votes: int = 20) -> DataFrame:
    d = lines.dissent_by(lines.against_line(a.expressed, a.lines), ["acteur_uid"], min_votes)
    return d.join(a.members.select("acteur_uid", "nom_complet", "groupe"), "acteur_uid").orderBy(F.col("taux").desc(), "acteur_uid").limit(k)


@command
def portees(a: Assembly, groupe_a: str | None = None, groupe_b: str | None = None, min_communs: int = 10) -> DataFrame:
    """Agreement of groups at each stake."""
    g = agreement.group_agreement(rollcall._pairs(a, "portee", floor=min_communs), a.members, min_communs, ["portee"])
    for c, v in (("groupe_a", groupe_a), ("groupe_b", groupe_b)):
        g = g if v is None else g.where(F.col(c) == v)
    return g.orderBy("groupe_a", "groupe_b", "portee")


def _model(a: Assembly, portee: str | None, o: ideal.Options) -> DataFrame:
    e = rollcall.select_events(a.events, levels=[portee] if portee else None)
    x = rollcall._with_units(a)
    return ideal.usable(x, e, o).join(x.select("scrutin_uid", "unite").distinct(), "scrutin_uid")


@command
def positions(a: Assembly, k: int = 15, dimensions: int = 1, portee: str | None = None, pivots: bool = False, incertitude: bool = False) -> DataFrame:
    """Ideal points of each assembly or college; ``pivots``: the members nearest to the median; ``incertitude``: with intervals."""
    o = replace(rollcall._MODEL, dims=dimensions)
    u = _model(a, portee, o)
    if incertitude:
        p = ideal.bootstrap(u, a.events, o=o, unit="unite")
    else:
        axes = [F.max(F.when(F.col("axe") == i, F.col("valeur"))).alias("position" if i == 1 else f"axe{i}") for i in range(1, dimensions + 1)]
        p = ideal.positions(u, "unite", o).where(F.col("genre") == "membre").groupBy("unite", F.col("uid").alias("acteur_uid")).agg(*axes)
    if pivots:
        from pyspark.sql import Window as W

        w = W.partitionBy("unite")
        p = p.withColumn("ecart", F.abs(F.col("position") - F.median("position").over(w))).withColumn("r", F.row_number().over(w.orderBy("ecart", "acteur_uid"))).where(F.col("r") <= k).drop("r")
    return p.join(a.members.select("acteur_uid", "nom_complet", "groupe"), "acteur_uid", "left").orderBy("unite", "position", "acteur_uid")


@command
def dimensions(a: Assembly, max_dimensions: int = 3, portee: str | None = None) -> DataFrame:
    return ideal.dimensionality(_model(a, portee, rollcall._MODEL), most=max_dimensions, unit="unite").orderBy("unite", "dims")


@command
def abstentions(a: Assembly, k: int = 15, portee: str | None = None, bascule: bool = False) -> DataFrame:
    """Rates by group; ``bascule``: the events that abstention could have tipped."""
    e = rollcall.select_events(a.events, levels=[portee] if portee else None)
    if bascule:
        return abstention.tipping(e).orderBy(F.col("marge").desc_nulls_last(), "scrutin_uid").limit(k)
    x = a.expressed.join(e.select("scrutin_uid"), "scrutin_uid", "left_semi").join(a.members.select("acteur_uid", "groupe"), "acteur_uid")
    return abstention.abstention_rate(x, "groupe").orderBy(F.col("taux").desc(), "groupe")


def _network(a: Assembly, max_signataires: int, depuis: str | None, sans_rapporteurs: bool, en_exercice: bool):
    m = a.members.where("en_exercice") if en_exercice else a.members
    return amendments.network(amendments.signatures(amendments.chosen(a.amendments, depuis, sans_rapporteurs), m, max_signataires))


@command
def cosignatures(a: Assembly, k: int = 15, par_groupe: bool = False, meme_groupe: bool = False, max_signataires: int = 10, depuis: str | None = None, sans_rapporteurs: bool = False, en_exercice: bool = False, min_signatures: int = 10, min_communs: int = 5) -> DataFrame:
    edges, nodes = _network(a, max_signataires, depuis, sans_rapporteurs, en_exercice)
    if par_groupe:
        return amendments.links_between_groups(edges, a.members).where(F.col("part") > 0.005).orderBy(F.col("part").desc(), "groupe_a", "groupe_b").limit(k)
    return amendments.top_pairs(edges, nodes, a.members, k, min_signatures, min_communs, across=not meme_groupe)


@command
def courtiers(a: Assembly, k: int = 15, max_signataires: int = 10, min_signatures: int = 30) -> DataFrame:
    edges, nodes = _network(a, max_signataires, None, False, False)
    return amendments.brokers(edges, nodes, a.members, min_signatures).orderBy(F.col("ratio").desc_nulls_last(), "acteur_uid").limit(k)


@command
def sujets(a: Assembly, semaine: str | None = None, k: int = 20, source: str = "tout", baisses: bool = False, fdr: float = 0.05) -> DataFrame:
    """The terms that surge in a week (``baisses``: those that fall, too)."""
    f = topics.week_frequencies(rollcall._corpus(a, source), "id", "jour", "t", rollcall._names(a))
    return topics.rising(f, semaine, k=k, rises_only=not baisses, fdr=None if baisses else fdr)


@command
def serie(a: Assembly, terme: str, source: str = "tout") -> DataFrame:
    f = topics.week_frequencies(rollcall._corpus(a, source), "id", "jour", "t", rollcall._names(a))
    return topics.term_series(f, terme).orderBy("semaine")


@command
def amendements(a: Assembly, k: int = 20, par_groupe: bool = False, depuis: str | None = None) -> DataFrame:
    by = "auteur_groupe_uid" if par_groupe else "auteur_uid"
    return amendments_by(a, by, depuis).orderBy(F.col("deposes").desc(), by).limit(k)


def amendments_by(a: Assembly, by: str, since: str | None) -> DataFrame:
    return amendments.by_author(amendments.chosen(a.amendments, since), [by])


@command
def alertes(a: Assembly, semaine: str | None = None, sans_sujets: bool = False, max_par_categorie: int = 5) -> DataFrame:
    """A week's alerts, by default those of the last week with an event."""
    found = rollcall.alert_parts(a, with_topics=not sans_sujets)
    week = semaine or str(views.derniere_semaine(a).first()[0])
    return alerts.all_alerts(found, max_par_categorie).where(F.col("semaine") == F.lit(week).cast("date")).orderBy("categorie", "rang")


@command
def fiche(a: Assembly, nom: str) -> DataFrame:
    return views.fiches(a).where(F.col("acteur_uid") == rollcall.one_member(a.members, nom))


@command
def scrutin(a: Assembly, uid: str) -> DataFrame:
    return views.event_page(a, uid).orderBy("nom_complet", "acteur_uid")


@command
def releve(a: Assembly, nom: str) -> DataFrame:
    return views.member_record(a, rollcall.one_member(a.members, nom)).orderBy(F.col("jour").desc_nulls_last(), "scrutin_uid")


@command
def votes(a: Assembly, nom: str, dissidents: bool = False, limite: int = 50) -> DataFrame:
    return views.member_log(a, rollcall.one_member(a.members, nom), dissidents, limite)


@command
def info(a: Assembly) -> DataFrame:
    """Rows, columns and days of the tables that are there."""
    days = {"scrutins": "date_d", "amendements": "date_depot_d"}
    names = [n for n in (*catalog.SCHEMAS, "documents") if a.has(n)]
    return catalog.info({n: a.raw(n) for n in names}, {n: c for n, c in days.items() if n in names})


@command
def verifier(a: Assembly) -> DataFrame:
    return rollcall.verification(a).orderBy("controle")


def build(spark: SparkSession, raw: str, target: str, legislature: str | None = None) -> catalog.Catalog:
    """All tables from a folder of raw files: the family of a document is the folder it lies in."""
    d = catalog.json_documents(spark, raw)
    family = F.regexp_extract("chemin", r".*/(scrutin|organe|acteur|amendement)s?/", 1)
    return ingest.build_all(spark, d.withColumn("famille", family), target, legislature)
