"""The clean base relations of a data folder: one row per key, tidy keys, parsed days, null where nothing was measured."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import EXPRESSED, day, key, latest, position
from ..operators.lines import group_lines
from ..session import fingerprint, mart, table
from ..sources.catalog import OPTIONAL, schema


class Assembly:
    """Relations over one folder. One row per key costs a shuffle of all rows received, so each clean relation is written once in a session, in the shared folder,
    and read from there by every query, its columns only; a source table that changes makes a new one.
    """

    def __init__(self, spark: SparkSession, sf: str):
        self.spark, self.sf = spark, sf

    def _mart(self, name: str, sources: list[str], build) -> DataFrame:
        return mart(self.spark, (self.sf, name), [f"{self.sf}/{t}.parquet" for t in sources], build)

    def raw(self, name: str) -> DataFrame:
        """A table as received; an optional one that is not there is empty, so that what rests on it is empty too."""
        if name in OPTIONAL and not self.has(name):
            return self.spark.createDataFrame([], schema(name).add("recu_le", "timestamp"))
        return table(self.spark, self.sf, name)

    def has(self, name: str) -> bool:
        """Whether there is such a table: of those that are optional, what needs them switches off."""
        return fingerprint(self.spark, f"{self.sf}/{name}.parquet")[0] > 0

    @cached_property
    def events(self) -> DataFrame:
        return self._mart("events", ["scrutins"], self._events)

    def _events(self) -> DataFrame:
        s = self.raw("scrutins")
        s = s.select(
            key("scrutin_uid").alias("scrutin_uid"), "numero", F.coalesce(day("date"), F.col("date_d")).alias("jour"), "type_vote_code", "sort_code", "titre",
            key("dossier_uid").alias("dossier_uid"), "seance_uid", "nb_votants", "n_pour", "n_contre", "n_abstention", "n_non_votant", "categorie", "portee", "contestation", "recu_le",
        )
        return latest(s.where(F.col("scrutin_uid").isNotNull()), ["scrutin_uid"]).drop("recu_le")

    @cached_property
    def ballots(self) -> DataFrame:
        return self._mart("ballots", ["votes"], self._ballots)

    def _ballots(self) -> DataFrame:
        """The last received row of each (event, member)."""
        v = self.raw("votes").select(
            key("scrutin_uid").alias("scrutin_uid"), key("acteur_uid").alias("acteur_uid"), position("position").alias("position"), key("groupe_uid").alias("groupe_uid"),
            "par_delegation", "cause", "recu_le",
        )
        v = v.where(F.col("scrutin_uid").isNotNull() & F.col("acteur_uid").isNotNull())
        return latest(v, ["scrutin_uid", "acteur_uid"]).drop("recu_le")

    @cached_property
    def expressed(self) -> DataFrame:
        return self.ballots.where(F.col("position").isin(*EXPRESSED))

    @cached_property
    def members(self) -> DataFrame:
        return self._mart("members", ["deputes"], self._members)

    def _members(self) -> DataFrame:
        d = self.raw("deputes").select(
            key("acteur_uid").alias("acteur_uid"), "nom_complet", "groupe", key("groupe_uid").alias("groupe_uid"), "groupe_position", "en_exercice", "departement", "num_departement", "num_circo",
            "date_naissance", "periodes_mandat", "recu_le",
        )
        return latest(d.where(F.col("acteur_uid").isNotNull()), ["acteur_uid"]).drop("recu_le")

    @cached_property
    def lines(self) -> DataFrame:
        return self._mart("lines", ["votes"], self._lines)

    def _lines(self) -> DataFrame:
        return group_lines(self.expressed.where(F.col("groupe_uid").isNotNull()), "scrutin_uid", "groupe_uid", "position")

    @cached_property
    def amendments(self) -> DataFrame:
        return self._mart("amendments", ["amendements"], self._amendments)

    def _amendments(self) -> DataFrame:
        a = self.raw("amendements").select(
            key("amendement_uid").alias("amendement_uid"), key("auteur_uid").alias("auteur_uid"), key("auteur_groupe_uid").alias("auteur_groupe_uid"), "auteur_rapporteur", "sort",
            key("dossier_uid").alias("dossier_uid"), F.coalesce(F.col("date_depot_d"), day("date_depot")).alias("jour"), "nb_cosignataires", "cosignataires", "expose_sommaire", "dispositif", "division_titre", "recu_le",
        )
        return latest(a.where(F.col("amendement_uid").isNotNull()), ["amendement_uid"]).drop("recu_le")

    @cached_property
    def bodies(self) -> DataFrame:
        o = self.raw("organes")
        o = o.select(key("organe_uid").alias("organe_uid"), "code_type", "libelle", "libelle_abrege", "libelle_abrev", "date_debut", "date_fin", "legislature", "position_politique", "recu_le")
        return latest(o.where(F.col("organe_uid").isNotNull()), ["organe_uid"]).drop("recu_le")

    @cached_property
    def mandates(self) -> DataFrame:
        return self._mart("mandates", ["mandats"], self._mandates)

    def _mandates(self) -> DataFrame:
        """The last version of each mandate, with its days; an open end is null."""
        from .problems import mandates

        m = mandates(self.spark, self.sf)
        return latest(m.where(F.col("mandat_uid").isNotNull()), ["mandat_uid"]).drop("recu_le")


def _k(c: str) -> str:
    return f"nullif(upper(trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"


def _day(c: str) -> str:
    t = f"trim({c}, ' ' || chr(9) || chr(160))"
    return (
        f"try_cast(CASE WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN substr({t}, 1, 10) "
        f"WHEN regexp_matches({t}, '^\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN substr({t}, 7, 4) || '-' || substr({t}, 4, 2) || '-' || substr({t}, 1, 2) "
        f"WHEN regexp_matches({t}, '^\\d{{8}}') THEN substr({t}, 1, 4) || '-' || substr({t}, 5, 2) || '-' || substr({t}, 7, 2) END AS date)"
    )


#: The same relations for the SQL check: ev, bal, xb (expressed), mem, ln (lines), dis (dissent), am, man.
CTE = {
    "ev": f"""ev AS (SELECT {_k('scrutin_uid')} AS scrutin_uid, numero, coalesce({_day('date')}, date_d) AS jour, type_vote_code, sort_code, titre, {_k('dossier_uid')} AS dossier_uid, seance_uid,
  nb_votants, n_pour, n_contre, n_abstention, n_non_votant, categorie, portee, contestation FROM scrutins QUALIFY row_number() OVER (PARTITION BY {_k('scrutin_uid')} ORDER BY recu_le DESC) = 1)""",
    "bal": f"""bal0 AS (SELECT {_k('scrutin_uid')} AS scrutin_uid, {_k('acteur_uid')} AS acteur_uid, {_k('groupe_uid')} AS groupe_uid,
  CASE lower(trim(position, ' ' || chr(9) || chr(160))) WHEN 'pour' THEN 'pour' WHEN 'contre' THEN 'contre' WHEN 'abstention' THEN 'abstention' WHEN 'nonvotant' THEN 'nonVotant' END AS position,
  par_delegation, cause, recu_le FROM votes),
bal AS (SELECT * EXCLUDE (recu_le) FROM bal0 WHERE scrutin_uid IS NOT NULL AND acteur_uid IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY scrutin_uid, acteur_uid ORDER BY recu_le DESC, position DESC, groupe_uid DESC, par_delegation DESC, cause DESC) = 1),
xb AS (SELECT * FROM bal WHERE position IN ('pour', 'contre', 'abstention'))""",
    "mem": f"""mem AS (SELECT {_k('acteur_uid')} AS acteur_uid, nom_complet, groupe, {_k('groupe_uid')} AS groupe_uid, groupe_position, en_exercice, departement, num_departement, num_circo, date_naissance,
  periodes_mandat FROM deputes WHERE {_k('acteur_uid')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_k('acteur_uid')} ORDER BY recu_le DESC) = 1)""",
    "ln": """lc AS (SELECT scrutin_uid, groupe_uid, count(*) FILTER (position = 'pour') AS n_pour, count(*) FILTER (position = 'contre') AS n_contre, count(*) FILTER (position = 'abstention') AS n_abstention
  FROM xb WHERE groupe_uid IS NOT NULL GROUP BY 1, 2),
lm AS (SELECT *, n_pour + n_contre + n_abstention AS votants_groupe, greatest(n_pour, n_contre, n_abstention) AS n_majoritaire FROM lc),
lt AS (SELECT *, (CASE WHEN n_pour = n_majoritaire THEN 1 ELSE 0 END) + (CASE WHEN n_contre = n_majoritaire THEN 1 ELSE 0 END) + (CASE WHEN n_abstention = n_majoritaire THEN 1 ELSE 0 END) > 1 AS partage FROM lm),
ln AS (SELECT *, CASE WHEN partage THEN NULL WHEN n_pour = n_majoritaire THEN 'pour' WHEN n_contre = n_majoritaire THEN 'contre' ELSE 'abstention' END AS majoritaire,
  n_majoritaire / votants_groupe AS part_majoritaire FROM lt)""",
    "dis": """dis AS (SELECT xb.*, ln.majoritaire, ln.votants_groupe, ln.part_majoritaire, xb.position <> ln.majoritaire AS dissident FROM xb JOIN ln USING (scrutin_uid, groupe_uid)
  WHERE ln.majoritaire IS NOT NULL AND ln.votants_groupe >= 5 AND ln.part_majoritaire > 0.5)""",
    "am": f"""am AS (SELECT {_k('amendement_uid')} AS amendement_uid, {_k('auteur_uid')} AS auteur_uid, {_k('auteur_groupe_uid')} AS auteur_groupe_uid, auteur_rapporteur, sort, {_k('dossier_uid')} AS dossier_uid,
  coalesce(date_depot_d, {_day('date_depot')}) AS jour, nb_cosignataires, cosignataires, expose_sommaire, dispositif, division_titre FROM amendements WHERE {_k('amendement_uid')} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {_k('amendement_uid')} ORDER BY recu_le DESC) = 1)""",
    "man": f"""man0 AS (SELECT {_k('mandat_uid')} AS mandat_uid, {_k('acteur_uid')} AS acteur_uid, {_k('organe_uid')} AS organe_uid, {_k('type_organe')} AS type_organe, {_day('date_debut')} AS debut,
  CASE WHEN year({_day('date_fin')}) < 2999 THEN {_day('date_fin')} END AS fin, recu_le FROM mandats),
man AS (SELECT * EXCLUDE (recu_le) FROM man0 WHERE mandat_uid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY mandat_uid ORDER BY recu_le DESC, acteur_uid DESC, organe_uid DESC, type_organe DESC, debut DESC, fin DESC) = 1)""",
    "org": f"""org AS (SELECT {_k('organe_uid')} AS organe_uid, code_type, libelle, libelle_abrege, libelle_abrev, date_debut, date_fin, legislature, position_politique FROM organes
  WHERE {_k('organe_uid')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_k('organe_uid')} ORDER BY recu_le DESC) = 1)""",
    "per": f"""per AS (SELECT acteur_uid, d AS debut, CASE WHEN f IS NULL OR year(f) >= 2999 THEN DATE '9999-12-31' ELSE f END AS fin FROM (
  SELECT acteur_uid, {_day('p.debut')} AS d, {_day('p.fin')} AS f FROM (SELECT acteur_uid, unnest(periodes_mandat) AS p FROM mem)) WHERE d IS NOT NULL AND (f IS NULL OR f >= d))""",
    "mp": """pa AS (SELECT *, max(fin) OVER (PARTITION BY acteur_uid ORDER BY debut, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM per),
pb AS (SELECT *, sum(CASE WHEN debut - 1 <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY acteur_uid ORDER BY debut, fin ROWS UNBOUNDED PRECEDING) AS run FROM pa),
mp AS (SELECT acteur_uid, min(debut) AS debut, max(fin) AS fin FROM pb GROUP BY acteur_uid, run)""",
}


def sql(names: str, body: str) -> str:
    """A statement over some of the relations."""
    return "WITH " + ",\n".join(CTE[n] for n in names.split()) + "\n" + body
