"""The queries of the general problems (1, 3, 4, 5) over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import OPEN_YEAR, day, key, latest
from ..operators.asof import known_spans, with_known_value
from ..operators.intervals import merge_intervals
from ..operators.orphans import orphan_references, orphans_by_period, parent_registry
from ..operators.variants import classify, links
from ..session import table, written


def mandates(spark: SparkSession, sf: str) -> DataFrame:
    """All versions of the mandates, with clean keys and days; an open end is null."""
    m = table(spark, sf, "mandats")
    end = day("date_fin")
    return m.select(
        key("mandat_uid").alias("mandat_uid"), key("acteur_uid").alias("acteur_uid"), key("organe_uid").alias("organe_uid"), key("type_organe").alias("type_organe"),
        day("date_debut").alias("debut"), F.when(F.year(end) < OPEN_YEAR, end).alias("fin"), "recu_le",
    )


#: What refers to what: table, column, and the table it names. Each column is a part of one composite key, null where a reference does not have it.
REFERENCES = (("votes", "acteur_uid", "deputes", "acteur_uid"), ("positions_groupe", "groupe_uid", "organes", "organe_uid"), ("scrutins", "dossier_uid", "dossiers", "dossier_uid"))
KEY = ["acteur_uid", "groupe_uid", "dossier_uid"]


def references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All references (nom_table, scrutin_uid, KEY, recu_le) and the registry of what they refer to, under the composite key KEY with nulls in the parts a row does not name."""
    none = F.lit(None).cast("string")
    at = lambda column, value: [(value if c == column else none).alias(c) for c in KEY]
    refs = [table(spark, sf, t).select(F.lit(t).alias("nom_table"), key("scrutin_uid").alias("scrutin_uid"), *at(c, key(c)), "recu_le") for t, c, _, _ in REFERENCES]
    parents = [table(spark, sf, p).select(*at(c, key(k)), "recu_le") for _, c, p, k in REFERENCES]
    gone = table(spark, sf, "suppressions")
    removed = [gone.where(F.lower(F.trim("nom_table")) == p).select(*at(c, key("cle")), "supprime_le") for _, c, p, _ in REFERENCES]
    union = lambda x: x[0].unionByName(x[1]).unionByName(x[2])
    return union(refs), parent_registry(union(parents), KEY, "recu_le", union(removed), "supprime_le")


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    refs, registry = references(spark, sf)
    return orphan_references(refs, registry, KEY, "recu_le", "partial")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The null mask of a reference tells what it names; each mask is anti-joined on the column it has."""
    return _orphans(spark, sf).select("nom_table", "scrutin_uid", F.coalesce(*KEY).alias("cle")).distinct()


def p1_periodes(spark: SparkSession, sf: str) -> DataFrame:
    return orphans_by_period(_orphans(spark, sf), "nom_table", "recu_le", KEY)


def p1_lignes(spark: SparkSession, sf: str, match: str = "partial") -> DataFrame:
    """Ballots whose (event, group) is no group position on file when they were received, per month: a key of two columns of which either may be missing."""
    on = ["scrutin_uid", "groupe_uid"]
    v = table(spark, sf, "votes").select(F.lit("votes").alias("nom_table"), *[key(c).alias(c) for c in on], "recu_le")
    p = table(spark, sf, "positions_groupe").select(*[key(c).alias(c) for c in on], "recu_le")
    return orphans_by_period(orphan_references(v, parent_registry(p, on, "recu_le", None, ""), on, "recu_le", match), "nom_table", "recu_le", on)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    m = latest(mandates(spark, sf), ["mandat_uid"]).where(F.col("type_organe") == "ASSEMBLEE")
    out = merge_intervals(m, "acteur_uid", "debut", "fin")
    text = lambda c: F.date_format(F.date_from_unix_date(F.col(c)), "yyyy-MM-dd").alias(c)
    return out.select("acteur_uid", "genre", text("debut"), text("fin"))


def p4_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return classify(table(spark, sf, "bruts"), "brut_id", "contenu")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes are written by subtype, so that each typed table reads its own files."""
    return links(written(p4_nodes(spark, sf), "p4", "sous_type"))


def p4_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and records of each typed table."""
    return p4_nodes(spark, sf).groupBy("sous_type").agg(F.count(F.lit(1)).alias("n_lignes"), F.count_distinct("record").alias("n_documents"))


def p4_variantes(spark: SparkSession, sf: str) -> DataFrame:
    """How many records and nodes each structural variant has, by subtype."""
    return p4_nodes(spark, sf).groupBy("variante", "sous_type").agg(F.count_distinct("record").alias("n_documents"), F.count(F.lit(1)).alias("n_noeuds"))


def event_days(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "scrutins")
    return s.select(key("scrutin_uid").alias("scrutin_uid"), F.coalesce(day("date"), F.col("date_d")).alias("jour")).groupBy("scrutin_uid").agg(F.min("jour").alias("jour"))


def p5_spans(spark: SparkSession, sf: str) -> DataFrame:
    """The days on which each version of a group mandate was known and held."""
    spans = known_spans(mandates(spark, sf), "mandat_uid", "recu_le", "debut", "fin", ["debut", "fin", "organe_uid", "type_organe", "acteur_uid"])
    return spans.where((F.col("type_organe") == "GP") & F.col("acteur_uid").isNotNull() & F.col("organe_uid").isNotNull())


def ballots_by_day(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Every ballot (scrutin_uid, acteur_uid, jour) of a known event day, and the last of these days."""
    days = written(event_days(spark, sf).where(F.col("jour").isNotNull()), "days")  # of a known size, so that the planner may send it along instead of shuffling ballots
    v = table(spark, sf, "votes").select(key("scrutin_uid").alias("scrutin_uid"), key("acteur_uid").alias("acteur_uid"))
    last = days.agg(F.max(F.unix_date("jour"))).first()[0]
    return v.join(days, "scrutin_uid"), (last if last is not None else 0)


def ballots_of_members(spark: SparkSession, sf: str) -> DataFrame:
    """(acteur_uid, n): what one pass over one column of the votes tells; keys are cleaned once they are counted."""
    n = table(spark, sf, "votes").groupBy("acteur_uid").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(key("acteur_uid").alias("acteur_uid")).agg(F.sum("n").alias("n"))


def p5_known(spark: SparkSession, sf: str) -> DataFrame:
    """Every ballot of a known event day with the group its member was known to be in on that day (null: none)."""
    v, last = ballots_by_day(spark, sf)
    out = with_known_value(v, p5_spans(spark, sf), "acteur_uid", "jour", "organe_uid", ["debut", "recu_le", "mandat_uid"], horizon=max(last, 11000), weights=ballots_of_members(spark, sf))
    return out.groupBy("acteur_uid", "__shard", "__part", "scrutin_uid").agg(F.max("jour").alias("jour"), F.max("organe_uid_connu").alias("groupe_uid")).drop("__shard", "__part")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """The member's group of today travels with the mandates, so ballots are shuffled by event and by member, and no more."""
    today = table(spark, sf, "deputes").select(key("acteur_uid").alias("acteur_uid"), key("groupe_uid").alias("groupe_uid"))
    today = today.groupBy("acteur_uid").agg(F.max("groupe_uid").alias("aujourdhui")).where(F.col("acteur_uid").isNotNull())
    differs = F.when(~F.col("organe_uid").eqNullSafe(F.col("aujourdhui")), F.col("organe_uid"))
    spans = p5_spans(spark, sf).join(today, "acteur_uid").withColumn("autre", F.struct(differs.alias("groupe")))
    v, last = ballots_by_day(spark, sf)
    priority = ["debut", "recu_le", "mandat_uid"]
    out = with_known_value(v, spans, "acteur_uid", "jour", "autre", priority, horizon=max(last, 11000), keep_unplaced=False, weights=ballots_of_members(spark, sf))
    out = out.where(F.col("autre_connu.groupe").isNotNull()).select("acteur_uid", "__shard", "__part", "scrutin_uid", F.col("autre_connu.groupe").alias("groupe_uid"))
    return out.distinct().select("scrutin_uid", "acteur_uid", "groupe_uid")


QUERIES = {
    "p1_found": p1_found,
    "p1_periodes": p1_periodes,
    "p1_lignes": p1_lignes,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_variantes": p4_variantes,
    "p4_tables": p4_tables,
    "p5_found": p5_found,
    "p5_connus": p5_known,
}

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8195) || chr(8199) || chr(8239) || chr(12288)"


def _k(c: str) -> str:
    return f"nullif(upper(trim({c}, {_BLANKS})), '')"


def _day(c: str) -> str:
    t = f"trim({c}, {_BLANKS})"
    return (
        f"try_cast(CASE WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN substr({t}, 1, 10) "
        f"WHEN regexp_matches({t}, '^\\d{{2}}/\\d{{2}}/\\d{{4}}') THEN substr({t}, 7, 4) || '-' || substr({t}, 4, 2) || '-' || substr({t}, 1, 2) "
        f"WHEN regexp_matches({t}, '^\\d{{8}}') THEN substr({t}, 1, 4) || '-' || substr({t}, 5, 2) || '-' || substr({t}, 7, 2) END AS date)"
    )


_REFS = f"""
WITH refs AS (
  SELECT 'votes' AS nom_table, {_k('scrutin_uid')} AS scrutin_uid, 'deputes' AS cible, {_k('acteur_uid')} AS cle, recu_le FROM votes
  UNION ALL SELECT 'positions_groupe', {_k('scrutin_uid')}, 'organes', {_k('groupe_uid')}, recu_le FROM positions_groupe
  UNION ALL SELECT 'scrutins', {_k('scrutin_uid')}, 'dossiers', {_k('dossier_uid')}, recu_le FROM scrutins
), parents AS (
  SELECT cible, cle, min(recu_le) AS vu FROM (
    SELECT 'deputes' AS cible, {_k('acteur_uid')} AS cle, recu_le FROM deputes
    UNION ALL SELECT 'organes', {_k('organe_uid')}, recu_le FROM organes
    UNION ALL SELECT 'dossiers', {_k('dossier_uid')}, recu_le FROM dossiers) GROUP BY 1, 2
), gone AS (SELECT nom_table AS cible, {_k('cle')} AS cle, min(supprime_le) AS le FROM suppressions GROUP BY 1, 2),
orphans AS (
  SELECT r.* FROM refs r LEFT JOIN parents p ON p.cible = r.cible AND p.cle = r.cle LEFT JOIN gone g ON g.cible = r.cible AND g.cle = r.cle
  WHERE r.cle IS NOT NULL AND (p.cle IS NULL OR p.vu > r.recu_le OR g.le <= r.recu_le))
"""

_MANDATS = f"""
m AS (SELECT {_k('mandat_uid')} AS mandat_uid, {_k('acteur_uid')} AS acteur_uid, {_k('organe_uid')} AS organe_uid, {_k('type_organe')} AS type_organe,
  {_day('date_debut')} AS debut, CASE WHEN year({_day('date_fin')}) < 2999 THEN {_day('date_fin')} ELSE DATE '9999-12-31' END AS fin, recu_le FROM mandats)
"""

_T = "nullif(trim(CASE WHEN json_type({0}) = 'OBJECT' THEN json_extract_string({0}, '$.\"#text\"') WHEN json_type({0}) = 'NULL' THEN NULL ELSE json_extract_string({0}, '$') END), '')"


def _t(x: str) -> str:
    return _T.format(x)


def _l(x: str) -> str:
    return f"CASE WHEN json_type({x}) = 'ARRAY' THEN CAST({x} AS JSON[]) WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN CAST([] AS JSON[]) ELSE [CAST({x} AS JSON)] END"


_BRUTS = (
    "WITH r AS (SELECT brut_id, CAST(contenu AS JSON) AS c FROM bruts WHERE json_valid(contenu)), "
    "d AS (SELECT brut_id, d, @UK@ AS uid FROM (SELECT brut_id, coalesce(c->'$.scrutin', c->'$.organe', c->'$.amendement', c) AS d FROM r)), "
    "o AS (SELECT brut_id, uid, unnest(@OL@) AS o FROM d), gg AS (SELECT brut_id, uid, row_number() OVER () AS g_id, g FROM (SELECT brut_id, uid, unnest(@GL@) AS g FROM o)), "
    "v AS (@VS@), s AS (SELECT brut_id, uid, d->'$.syntheseVote' AS s FROM d WHERE json_type(d->'$.syntheseVote') = 'OBJECT'), "
    "k AS (SELECT uid, unnest(['nombreVotants', 'suffragesExprimes', 'nbrSuffragesRequis']) AS f, s AS h FROM s UNION ALL SELECT uid, unnest(json_keys(s->'$.decompte')), s->'$.decompte' FROM s WHERE json_type(s->'$.decompte') = 'OBJECT'), "
    "kv AS (SELECT uid, f, h->('$.\"' || f || '\"') AS x FROM k WHERE NOT starts_with(f, '@') AND NOT starts_with(f, '#')), "
    "au AS (SELECT brut_id, uid, unnest(@AL@) AS a FROM d)"
)
_BRUTS = _BRUTS.replace("@UK@", f"upper({_t(chr(40) + 'd->' + chr(39) + '$.uid' + chr(39) + chr(41))})").replace("@OL@", _l("(d->'$.ventilationVotes.organe')")).replace("@GL@", _l("(o->'$.groupes.groupe')")).replace("@AL@", _l("(d->'$.signataires.auteur')"))
_BRUTS = _BRUTS.replace("@VS@", " UNION ALL ".join(f"SELECT brut_id, uid, g_id, '{p}' AS liste, unnest({_l(chr(40) + f'g->{chr(39)}$.vote.decompteNominatif.{p}.votant{chr(39)}' + chr(41))}) AS v FROM gg" for p in ("pours", "contres", "abstentions", "nonVotants")))

_KNOWN = f"""
WITH {_MANDATS}, e AS (SELECT {_k('scrutin_uid')} AS scrutin_uid, min(coalesce({_day('date')}, date_d)) AS jour FROM scrutins GROUP BY 1),
v AS (SELECT DISTINCT {_k('scrutin_uid')} AS scrutin_uid, {_k('acteur_uid')} AS acteur_uid FROM votes),
d AS (SELECT {_k('acteur_uid')} AS acteur_uid, max({_k('groupe_uid')}) AS aujourdhui FROM deputes GROUP BY 1),
spans AS (
  SELECT *, greatest(debut, CAST(recu_le AS date)) AS lo, least(fin, coalesce(CAST(suivant AS date) - 1, DATE '9999-12-31')) AS hi FROM (
    SELECT *, lead(recu_le) OVER (PARTITION BY mandat_uid ORDER BY recu_le, debut, fin, organe_uid, type_organe, acteur_uid) AS suivant FROM m)
), known AS (
  SELECT v.scrutin_uid, v.acteur_uid, s.organe_uid FROM v JOIN e USING (scrutin_uid)
  JOIN spans s ON s.acteur_uid = v.acteur_uid AND e.jour BETWEEN s.lo AND s.hi AND e.jour BETWEEN s.debut AND s.fin
  WHERE s.type_organe = 'GP'
  QUALIFY row_number() OVER (PARTITION BY v.scrutin_uid, v.acteur_uid ORDER BY s.debut DESC, s.recu_le DESC, s.mandat_uid DESC) = 1)
"""

ORACLE = {
    "p4_found": _BRUTS + f"""
SELECT DISTINCT genre, parent, enfant, valeur FROM (
  SELECT 'synthese' AS genre, uid AS parent, f AS enfant, {_t('x')} AS valeur FROM kv
  UNION ALL SELECT 'groupe', uid, upper({_t("(g->'$.organeRef')")}), {_t("(g->'$.vote.positionMajoritaire')")} FROM gg
  UNION ALL SELECT 'votant', uid, upper({_t("(v->'$.acteurRef')")}), liste FROM v
  UNION ALL SELECT 'organe', uid, 'codeType', {_t("(d->'$.codeType')")} FROM d
  UNION ALL SELECT 'rapporteur', uid, upper({_t("(a->'$.acteurRef')")}), upper({_t("(a->'$.auteurRapporteurOrganeRef')")}) FROM au)
WHERE parent IS NOT NULL AND enfant IS NOT NULL AND valeur IS NOT NULL""",
    "p4_tables": _BRUTS + """, n AS (
  SELECT brut_id, CASE WHEN json_exists(d, '$.syntheseVote') OR json_exists(d, '$.ventilationVotes') THEN 'scrutin' WHEN json_exists(d, '$.signataires') THEN 'amendement' WHEN json_exists(d, '$.codeType') THEN 'organe' ELSE 'document' END AS sous_type FROM d WHERE uid IS NOT NULL
  UNION ALL SELECT brut_id, 'synthese' FROM s WHERE len(json_keys(s)) > 0 UNION ALL SELECT brut_id, 'groupe' FROM gg WHERE json_exists(g, '$.organeRef') AND json_exists(g, '$.vote')
  UNION ALL SELECT brut_id, 'votant' FROM v WHERE json_exists(v, '$.acteurRef') UNION ALL SELECT brut_id, 'auteur' FROM au WHERE json_exists(a, '$.acteurRef'))
SELECT sous_type, count(*) AS n_lignes, count(DISTINCT brut_id) AS n_documents FROM n GROUP BY 1""",
    "p1_found": _REFS + "SELECT DISTINCT nom_table, scrutin_uid, cle FROM orphans",
    "p1_periodes": _REFS + "SELECT nom_table, CAST(date_trunc('month', recu_le) AS date) AS periode, count(*) AS n_lignes, count(DISTINCT cle) AS n_cles FROM orphans GROUP BY 1, 2",
    "p1_lignes": f"""
WITH v AS (SELECT {_k('scrutin_uid')} AS s, {_k('groupe_uid')} AS g, recu_le FROM votes),
p AS (SELECT {_k('scrutin_uid')} AS s, {_k('groupe_uid')} AS g, min(recu_le) AS vu FROM positions_groupe GROUP BY 1, 2),
ps AS (SELECT s, min(vu) AS vu FROM p WHERE s IS NOT NULL GROUP BY 1), pg AS (SELECT g, min(vu) AS vu FROM p WHERE g IS NOT NULL GROUP BY 1),
o AS (SELECT v.* FROM v LEFT JOIN p ON p.s = v.s AND p.g = v.g LEFT JOIN ps ON ps.s = v.s LEFT JOIN pg ON pg.g = v.g
  WHERE CASE WHEN v.s IS NOT NULL AND v.g IS NOT NULL THEN p.vu IS NULL OR p.vu > v.recu_le WHEN v.s IS NOT NULL THEN ps.vu IS NULL OR ps.vu > v.recu_le WHEN v.g IS NOT NULL THEN pg.vu IS NULL OR pg.vu > v.recu_le ELSE false END)
SELECT 'votes' AS nom_table, CAST(date_trunc('month', recu_le) AS date) AS periode, count(*) AS n_lignes, count(DISTINCT (s, g)) AS n_cles FROM o GROUP BY 1, 2""",
    "p3_found": f"""
WITH {_MANDATS}, last AS (
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY mandat_uid ORDER BY recu_le DESC, acteur_uid DESC, organe_uid DESC, type_organe DESC, debut DESC, fin DESC) = 1
), seat AS (SELECT acteur_uid, debut, fin FROM last WHERE type_organe = 'ASSEMBLEE' AND debut IS NOT NULL AND fin >= debut AND acteur_uid IS NOT NULL),
a AS (SELECT *, max(fin) OVER (PARTITION BY acteur_uid ORDER BY debut, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seat),
b AS (SELECT *, sum(CASE WHEN debut - 1 <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY acteur_uid ORDER BY debut, fin ROWS UNBOUNDED PRECEDING) AS run FROM a),
p AS (SELECT acteur_uid, run, min(debut) AS debut, max(fin) AS fin FROM b GROUP BY 1, 2),
g AS (SELECT *, lag(fin) OVER (PARTITION BY acteur_uid ORDER BY debut) AS avant FROM p)
SELECT acteur_uid, 'periode' AS genre, strftime(debut, '%Y-%m-%d') AS debut, strftime(fin, '%Y-%m-%d') AS fin FROM p
UNION ALL SELECT acteur_uid, 'trou', strftime(avant + 1, '%Y-%m-%d'), strftime(debut - 1, '%Y-%m-%d') FROM g WHERE avant IS NOT NULL
""",
    "p5_connus": _KNOWN + "SELECT v.scrutin_uid, v.acteur_uid, e.jour, k.organe_uid AS groupe_uid FROM v JOIN e USING (scrutin_uid) LEFT JOIN known k ON k.scrutin_uid = v.scrutin_uid AND k.acteur_uid IS NOT DISTINCT FROM v.acteur_uid WHERE e.jour IS NOT NULL",
    "p5_found": _KNOWN + """
SELECT k.scrutin_uid, k.acteur_uid, k.organe_uid AS groupe_uid FROM known k JOIN d USING (acteur_uid) WHERE k.organe_uid IS DISTINCT FROM d.aujourdhui
""",
}
