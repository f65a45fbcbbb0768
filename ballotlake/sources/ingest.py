"""Raw nested JSON into the published tables (B1-B17): each document is parsed once, to VARIANT, and read by paths in the JVM; singletons, lists, nil and wrapped values alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import EXPRESSED, OPEN_YEAR, day, key, latest
from ..functions.text import category, contestation, level, strip_html
from .catalog import Catalog, bill_of_path

#: The four lists of a group's nominal count and the position each stands for.
BUCKETS = {"pours": "pour", "contres": "contre", "abstentions": "abstention", "nonVotants": "nonVotant"}


def at(v: Column, *keys: str) -> Column:
    """The VARIANT under a path, null if it is missing."""
    return F.try_variant_get(v, "$" + "".join(f"['{k}']" for k in keys), "variant")


def text(v: Column, *keys: str) -> Column:
    """The value under a path: #text is unwrapped, nil and empty are null, other scalars are text."""
    path = "$" + "".join(f"['{k}']" for k in keys)
    plain = F.try_variant_get(v, path, "string")
    wrapped = F.try_variant_get(v, path + "['#text']", "string")
    return F.nullif(F.when(F.startswith(plain, F.lit("{")), wrapped).otherwise(plain), F.lit(""))


def whole(v: Column) -> Column:
    """null, one value or a list: always a list of VARIANT."""
    one = F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(v))
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), one, F.array().cast("array<variant>"))


def number(v: Column, *keys: str) -> Column:
    return text(v, *keys).try_cast("bigint")


def documents(raw: DataFrame, content: str, root: str) -> DataFrame:
    """``raw`` with the whole documents of one kind, bare or under their name, as VARIANT ``d``; cut-off ones and those without a uid are left out."""
    v = raw.withColumn("__v", F.try_parse_json(F.col(content)))
    d = v.where(F.col("__v").isNotNull()).withColumn("d", F.coalesce(at(F.col("__v"), root), F.col("__v"))).drop("__v")
    return d.where(text(F.col("d"), "uid").isNotNull())


def _received(raw: DataFrame, received: str) -> list[str]:
    return [received] if received in raw.columns else []


def _once(df: DataFrame, keys: list[str], received: list[str]) -> DataFrame:
    """One row per key: the one received last, the greatest on a tie."""
    return latest(df, keys, received[0] if received else None).drop(*received)


def bodies(raw: DataFrame, content: str = "contenu", received: str = "recu_le") -> DataFrame:
    x, r = F.col("d"), _received(raw, received)
    d = documents(raw, content, "organe")
    d = d.select(
        key(text(x, "uid")).alias("organe_uid"), text(x, "codeType").alias("code_type"), text(x, "libelle").alias("libelle"), text(x, "libelleAbrege").alias("libelle_abrege"),
        text(x, "libelleAbrev").alias("libelle_abrev"), text(x, "viMoDe", "dateDebut").alias("date_debut"), text(x, "viMoDe", "dateFin").alias("date_fin"),
        text(x, "legislature").alias("legislature"), text(x, "positionPolitique").alias("position_politique"), *r,
    )
    return _once(d, ["organe_uid"], r)


def actors(raw: DataFrame, content: str = "contenu", received: str = "recu_le") -> DataFrame:
    """The civil state of each person."""
    x, r = F.col("d"), _received(raw, received)
    d = documents(raw, content, "acteur")
    who = lambda *k: text(x, "etatCivil", *k)
    d = d.select(
        key(text(x, "uid")).alias("acteur_uid"), who("ident", "civ").alias("civilite"), who("ident", "prenom").alias("prenom"), who("ident", "nom").alias("nom"),
        who("infoNaissance", "dateNais").alias("date_naissance"), who("dateDeces").alias("date_deces"), text(x, "profession", "libelleCourant").alias("profession"),
        text(x, "profession", "socProcINSEE", "catSocPro").alias("cat_socio_pro"), text(x, "uri_hatvp").alias("uri_hatvp"), *r,
    )
    return _once(d, ["acteur_uid"], r)


def actor_mandates(raw: DataFrame, content: str = "contenu", received: str = "recu_le") -> DataFrame:
    """One row per mandate and body of it: two levels of explode."""
    r = _received(raw, received)
    d = documents(raw, content, "acteur")
    m = d.select(key(text(F.col("d"), "uid")).alias("acteur_uid"), F.explode(whole(at(F.col("d"), "mandats", "mandat"))).alias("m"), *r)
    x = F.col("m")
    m = m.select("acteur_uid", "m", F.explode(whole(at(x, "organes", "organeRef"))).alias("o"), *r)
    place = lambda k: text(x, "election", "lieu", k)
    m = m.select(
        key(text(x, "uid")).alias("mandat_uid"), "acteur_uid", text(x, "typeOrgane").alias("type_organe"), key(text(F.col("o"))).alias("organe_uid"), text(x, "legislature").alias("legislature"),
        text(x, "dateDebut").alias("date_debut"), text(x, "mandature", "datePriseFonction").alias("date_prise_fonction"), text(x, "dateFin").alias("date_fin"), text(x, "infosQualite", "codeQualite").alias("qualite"),
        place("departement").alias("departement"), place("numDepartement").alias("num_departement"), place("numCirco").alias("num_circo"), place("region").alias("region"), *r,
    )
    return _once(m, ["mandat_uid", "organe_uid"], r)


def events(raw: DataFrame, content: str = "contenu", received: str = "recu_le") -> DataFrame:
    x, r = F.col("d"), _received(raw, received)
    d = documents(raw, content, "scrutin")
    total = lambda *k: number(x, "syntheseVote", *k)
    d = d.select(
        key(text(x, "uid")).alias("scrutin_uid"), number(x, "numero").alias("numero"), text(x, "dateScrutin").alias("date"), text(x, "legislature").alias("legislature"),
        text(x, "typeVote", "codeTypeVote").alias("type_vote_code"), text(x, "typeVote", "libelleTypeVote").alias("type_vote_libelle"), text(x, "sort", "code").alias("sort_code"), text(x, "sort", "libelle").alias("sort_libelle"),
        F.coalesce(text(x, "titre"), text(x, "objet", "libelle")).alias("titre"), text(x, "demandeur", "texte").alias("demandeur"), key(text(x, "objet", "dossierLegislatif", "dossierRef")).alias("dossier_uid"),
        text(x, "objet", "dossierLegislatif", "libelle").alias("dossier_titre"), text(x, "seanceRef").alias("seance_uid"), text(x, "modePublicationDesVotes").alias("mode_publication"),
        total("nombreVotants").alias("nb_votants"), total("suffragesExprimes").alias("suffrages_exprimes"), total("nbrSuffragesRequis").alias("suffrages_requis"), total("decompte", "pour").alias("n_pour"),
        total("decompte", "contre").alias("n_contre"), total("decompte", "abstentions").alias("n_abstention"), total("decompte", "nonVotants").alias("n_non_votant"), *r,
    )
    d = _once(d, ["scrutin_uid"], r)
    d = d.withColumn("date_d", day("date")).withColumn("categorie", category(F.col("titre"))).withColumn("portee", level(F.col("categorie")))
    return d.withColumn("contestation", contestation(F.col("n_pour"), F.col("n_contre")))


def ballots(raw: DataFrame, content: str = "contenu", received: str = "recu_le") -> DataFrame:
    """Four levels of explode: body, group, list, voter."""
    r = _received(raw, received)
    d = documents(raw, content, "scrutin").select(key(text(F.col("d"), "uid")).alias("scrutin_uid"), F.explode(whole(at(F.col("d"), "ventilationVotes", "organe"))).alias("o"), *r)
    g = d.select("scrutin_uid", F.explode(whole(at(F.col("o"), "groupes", "groupe"))).alias("g"), *r)
    x = F.col("g")
    lists = F.array(*[F.struct(F.lit(p).alias("position"), whole(at(x, "vote", "decompteNominatif", b, "votant")).alias("v")) for b, p in BUCKETS.items()])
    b = g.select("scrutin_uid", key(text(x, "organeRef")).alias("groupe_uid"), text(x, "vote", "positionMajoritaire").alias("position_majoritaire_groupe"), F.explode(lists).alias("l"), *r)
    v = b.select("scrutin_uid", "groupe_uid", "position_majoritaire_groupe", F.col("l.position").alias("position"), F.explode("l.v").alias("v"), *r)
    y = F.col("v")
    out = v.select(
        "scrutin_uid", key(text(y, "acteurRef")).alias("acteur_uid"), "groupe_uid", "position", "position_majoritaire_groupe",
        F.coalesce(text(y, "parDelegation") == "true", F.lit(False)).alias("par_delegation"), text(y, "causePositionVote").alias("cause"), *r,
    )
    return _once(out.where(F.col("acteur_uid").isNotNull()), ["scrutin_uid", "acteur_uid"], r)


def amendments(raw: DataFrame, content: str = "contenu", path: str = "chemin", received: str = "recu_le") -> DataFrame:
    """The first author counts; co-signers without nulls; what is missing in one place is looked for in the other."""
    x, r = F.col("d"), _received(raw, received)
    d = documents(raw, content, "amendement").withColumn("__signed", at(F.col("d"), "signataires")).where(F.col("__signed").isNotNull() | at(F.col("d"), "auteur").isNotNull())
    authors = whole(at(x, "signataires", "auteur"))
    first = F.try_element_at(F.when(F.size(authors) > 0, authors).otherwise(whole(at(x, "auteur"))), F.lit(1))
    signers = F.filter(F.transform(whole(at(x, "signataires", "cosignataires", "acteurRef")), lambda s: text(s)), lambda s: s.isNotNull())
    ident = lambda k: text(x, "identification", k)
    d = d.withColumn("a", first).withColumn("c", signers)
    a, life = F.col("a"), lambda *k: text(x, "cycleDeVie", *k)
    d = d.select(
        key(text(x, "uid")).alias("amendement_uid"), F.coalesce(ident("numeroLong"), ident("numeroOrdreDepot")).alias("numero"), F.coalesce(text(x, "texteLegislatifRef"), ident("texteLegislatifRef")).alias("texte_legislatif_uid"),
        bill_of_path(F.col(path)).alias("dossier_uid"), F.coalesce(ident("legislature"), text(x, "legislature")).alias("legislature"), life("dateDepot").alias("date_depot"), life("dateSort").alias("date_sort"),
        life("etatDesTraitements", "etat", "libelle").alias("etat"), life("sort").alias("sort"), key(text(a, "acteurRef")).alias("auteur_uid"), key(text(a, "groupePolitiqueRef")).alias("auteur_groupe_uid"),
        text(a, "typeAuteur").alias("auteur_type"), text(a, "auteurRapporteurOrganeRef").isNotNull().alias("auteur_rapporteur"), F.size("c").cast("bigint").alias("nb_cosignataires"), F.col("c").alias("cosignataires"),
        text(x, "pointeurFragmentTexte", "division", "titre").alias("division_titre"), text(x, "pointeurFragmentTexte", "division", "articleDesignationCourte").alias("division_article"),
        text(x, "corps", "contenuAuteur", "dispositif").alias("dispositif"), text(x, "corps", "contenuAuteur", "exposeSommaire").alias("expose_sommaire"), *r,
    )
    d = _once(d, ["amendement_uid"], r)
    return d.withColumn("dispositif", strip_html(F.col("dispositif"))).withColumn("expose_sommaire", strip_html(F.col("expose_sommaire"))).withColumn("date_depot_d", day("date_depot"))


def members(mandates: DataFrame, people: DataFrame, groups: DataFrame, legislature: str | None = None) -> DataFrame:
    """One row per person with a seat: periods, interruptions, bounds, seat, last group with its labels, name, and whether the seat is still held.

    ``mandates``: the last version of each (schema ``mandats``); ``people``: ``acteurs``; ``groups``: ``organes``. Taking office counts over the mandate's start. Periods that
    touch do not interrupt. An open end wins over every other; seat columns are the last that are known; the group is the open one that started last, else the last one.
    """
    m = mandates if legislature is None else mandates.where(F.col("legislature") == legislature)
    end = day("date_fin")
    m = m.withColumn("debut", day("date_debut")).withColumn("fin", F.when(F.year(end) < OPEN_YEAR, end))
    seat = m.where(F.col("type_organe") == "ASSEMBLEE").withColumn("debut", F.coalesce(day("date_prise_fonction"), "debut")).where(F.col("debut").isNotNull() & F.col("acteur_uid").isNotNull())
    w = W.partitionBy("acteur_uid").orderBy("debut", F.col("fin").asc_nulls_last(), "mandat_uid")
    seat = seat.withColumn("avant", F.lag("fin").over(w)).withColumn("coupure", F.coalesce(F.col("debut") > F.date_add("avant", 1), F.lit(False)))
    period = F.struct(F.date_format("debut", "yyyy-MM-dd").alias("debut"), F.date_format("fin", "yyyy-MM-dd").alias("fin"))
    hole = F.struct(F.date_format(F.date_add("avant", 1), "yyyy-MM-dd").alias("debut"), F.date_format(F.date_sub("debut", 1), "yyyy-MM-dd").alias("fin"))
    place = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("debut", "mandat_uid", c)))[c].alias(c)
    s = seat.groupBy("acteur_uid").agg(
        F.array_sort(F.collect_list(period)).alias("periodes_mandat"), F.bool_or("coupure").alias("mandat_interrompu"), F.array_sort(F.collect_list(F.when(F.col("coupure"), hole))).alias("interruptions"),
        F.min("debut").alias("mandat_debut_d"), F.when(F.bool_or(F.col("fin").isNull()), None).otherwise(F.max("fin")).alias("mandat_fin_d"), *[place(c) for c in ("departement", "num_departement", "num_circo", "region")],
    )
    g = m.where((F.col("type_organe") == "GP") & F.col("organe_uid").isNotNull())
    g = g.groupBy("acteur_uid").agg(F.max(F.struct(F.col("fin").isNull().alias("o"), "debut", "mandat_uid", "organe_uid", "qualite")).alias("x"), F.count_distinct("organe_uid").alias("nb_groupes_legislature"))
    g = g.select("acteur_uid", F.col("x.organe_uid").alias("groupe_uid"), F.col("x.qualite").alias("groupe_qualite"), "nb_groupes_legislature")
    b = groups.select(F.col("organe_uid").alias("groupe_uid"), F.col("libelle").alias("groupe_libelle"), F.col("libelle_abrev").alias("groupe"), F.col("position_politique").alias("groupe_position"))
    j = s.join(people, "acteur_uid", "left").join(g, "acteur_uid", "left").join(b, "groupe_uid", "left")
    return j.select(
        "*", F.date_format("mandat_debut_d", "yyyy-MM-dd").alias("mandat_debut"), F.date_format("mandat_fin_d", "yyyy-MM-dd").alias("mandat_fin"),
        F.concat("prenom", F.lit(" "), "nom").alias("nom_complet"), F.col("mandat_fin_d").isNull().alias("en_exercice"),
    )


def build_all(spark: SparkSession, raw: DataFrame, target: str, legislature: str | None = None, family: str = "famille") -> Catalog:
    """Build and write every table from the raw documents (``famille``: scrutin, organe, acteur, amendement; ``contenu``, ``chemin``); the catalog of the target.

    Each table is read back before another is made from it, so no document is parsed for more than its own tables.
    """
    from ..operators.lines import group_lines

    c = Catalog(spark, target)
    of = lambda kind: raw.where(F.col(family) == kind)
    c.write("organes", bodies(of("organe")))
    c.write("acteurs", actors(of("acteur")))
    c.write("mandats", actor_mandates(of("acteur")))
    c.write("deputes", members(c.load("mandats"), c.load("acteurs"), c.load("organes"), legislature))
    c.write("scrutins", events(of("scrutin")))
    c.write("votes", ballots(of("scrutin")))
    c.write("positions_groupe", group_lines(c.load("votes").where(F.col("position").isin(*EXPRESSED)), "scrutin_uid", "groupe_uid", "position"))
    if not of("amendement").isEmpty():
        c.write("amendements", amendments(of("amendement")))
    return c
