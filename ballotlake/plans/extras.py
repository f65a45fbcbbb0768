"""Further queries of the inventory: sets, samples, peaks, comparisons of two maps, what notebooks ask, and a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.expr import STRUCTURAL_CAUSES, key, position
from ..operators import agreement, amendments, ideal, lines, scaling
from ..session import scratch, written
from ..streaming import weekly
from . import rollcall
from .assembly import Assembly, sql
from .rollcall import tidy

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(statement: str | None = None):
    def add(f: Callable[[Assembly], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf: tidy(f(Assembly(spark, sf)))
        if statement:
            ORACLE[f.__name__] = statement
        return f

    return add


# --- small relational ones ---------------------------------------------------------------------------------------


@query(sql("bal", "SELECT DISTINCT cause FROM bal WHERE cause IS NOT NULL AND cause NOT IN ('MG', 'PAN')"))
def causes_a_classer(a: Assembly) -> DataFrame:
    """Causes in the data that a list of known ones (here without PSE) lacks: a set difference."""
    known = a.spark.createDataFrame([(c,) for c in STRUCTURAL_CAUSES if c != "PSE"], "cause string")
    return a.ballots.where(F.col("cause").isNotNull()).select("cause").subtract(known)


@query(sql("mem", "SELECT departement, num_departement, count(*) AS n, min(acteur_uid) AS premier, max(acteur_uid) AS dernier FROM mem GROUP BY 1, 2"))
def par_departement(a: Assembly) -> DataFrame:
    return a.members.groupBy("departement", "num_departement").agg(F.count(F.lit(1)).alias("n"), F.min("acteur_uid").alias("premier"), F.max("acteur_uid").alias("dernier"))


@query(sql("ev mem per mp", ", el AS (SELECT mp.acteur_uid, count(*) AS n FROM mp JOIN ev ON ev.jour BETWEEN mp.debut AND mp.fin GROUP BY 1), s AS (SELECT acteur_uid, coalesce(n, 0) AS n FROM mem LEFT JOIN el USING (acteur_uid) WHERE en_exercice) SELECT acteur_uid, n AS eligibles FROM s WHERE n < (SELECT max(n) FROM s)"))
def entres_en_cours(a: Assembly) -> DataFrame:
    """Sitting members who could take part in fewer events than others."""
    n = lines.eligible_counts(lines.term_periods(a.members), lines.calendar(a.events), ["n"])
    s = a.members.where("en_exercice").select("acteur_uid").join(n, "acteur_uid", "left").select("acteur_uid", F.coalesce("n", F.lit(0)).alias("eligibles"))
    top = s.agg(F.max("eligibles")).first()[0]
    return s.where(F.col("eligibles") < F.lit(top))


@query(sql("ev", ", w AS (SELECT CAST(date_trunc('week', jour) AS date) AS semaine, count(*) AS n FROM ev WHERE jour IS NOT NULL GROUP BY 1) SELECT semaine, n, round(n / avg(n) OVER (), 6) AS rapport FROM w QUALIFY row_number() OVER (ORDER BY n DESC, semaine) = 1"))
def pic_activite(a: Assembly) -> DataFrame:
    """The busiest week and how it stands to the mean."""
    w = a.events.where(F.col("jour").isNotNull()).groupBy(F.date_trunc("week", "jour").cast("date").alias("semaine")).agg(F.count(F.lit(1)).alias("n"))
    top = F.max(F.struct("n", (-F.unix_date("semaine")).alias("d"), "semaine"))
    return w.agg(top.alias("x"), F.avg("n").alias("m")).select("x.semaine", "x.n", (F.col("x.n") / F.col("m")).alias("rapport"))


@query(sql("ev", ", r AS (SELECT scrutin_uid, contestation, row_number() OVER (ORDER BY contestation NULLS LAST, scrutin_uid) AS rang, count(*) OVER () AS n FROM ev) SELECT scrutin_uid, rang FROM r WHERE rang IN (SELECT CAST(1 + floor(k * (n - 1) / 19.0) AS BIGINT) FROM range(20) t(k), (SELECT max(n) AS n FROM r))"))
def echantillon_regulier(a: Assembly) -> DataFrame:
    """Twenty events at even distances in the order of contestation. Ranks come from counts of value ranges, so no task sorts everything."""
    return evenly_spaced(a.events.select("scrutin_uid", "contestation"), "contestation", "scrutin_uid", 20).select("scrutin_uid", "rang")


def evenly_spaced(df: DataFrame, value: str, ident: str, k: int, buckets: int = 256) -> DataFrame:
    """``k`` rows at even distances in the order of ``value`` (nulls last), ties by ``ident``, with their rank; first and last included."""
    b = F.coalesce(F.least(F.floor(F.col(value) * buckets), F.lit(buckets)), F.lit(buckets + 1)).cast("int")
    d = df.withColumn("__b", b)
    n = d.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    n = n.withColumn("__before", F.sum("__n").over(W.orderBy("__b")) - F.col("__n"))
    total = df.count()
    rank = F.row_number().over(W.partitionBy("__b").orderBy(F.col(value).asc_nulls_last(), ident)) + F.col("__before")
    picks = sorted({1 + i * (total - 1) // (k - 1) for i in range(k)}) if total and k > 1 else [1]
    return d.join(n, "__b").withColumn("rang", rank).where(F.col("rang").isin(picks)).drop("__b", "__n", "__before")


@query(sql("ev", """, c AS (SELECT scrutin_uid, portee, coalesce(titre, '') AS t FROM ev)
SELECT portee, count(*) AS n, count(*) FILTER (NOT regexp_matches(t, '^la motion|^l.ensemble\\b|^(l.|les )(sous.)?amendements?\\b|^le sous.amendement|^(l.|les )articles?\\b|^la déclaration|^la demande', 'i')) AS n_autres FROM c GROUP BY 1"""))
def titres_sans_categorie(a: Assembly) -> DataFrame:
    """How many titles match no category, by stake (motions all match here)."""
    t = F.coalesce("titre", F.lit(""))
    other = (text.category(t) == "autre") & ~t.rlike("(?iu)^la motion")
    return a.events.groupBy("portee").agg(F.count(F.lit(1)).alias("n"), F.count_if(other).alias("n_autres"))


@query(sql("mem am", rollcall._NET + ", w AS (SELECT a, b FROM ed ORDER BY communs DESC, a, b LIMIT 1) SELECT sg.amendement_uid FROM sg, w WHERE sg.acteur_uid IN (w.a, w.b) GROUP BY 1 HAVING count(*) = 2"))
def signes_ensemble(a: Assembly) -> DataFrame:
    """The amendments that the two members who sign together most often both signed."""
    s = amendments.signatures(a.amendments, a.members)
    top = amendments.network(s)[0].orderBy(F.col("communs").desc(), "a", "b").first()
    two = [top["a"], top["b"]] if top else []
    return s.where(F.col("acteur_uid").isin(two)).groupBy("amendement_uid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 2).select("amendement_uid")


@query(sql("ev bal mem am", rollcall._XM + rollcall._PAIRS + rollcall._NET + """SELECT groupe_a, groupe_b, round(gg.accord_moyen, 6) AS accord_moyen, round(coalesce(lp.part, 0), 6) AS part FROM gg LEFT JOIN lp USING (groupe_a, groupe_b)
WHERE groupe_a <> groupe_b AND gg.accord_moyen >= 0.4 AND coalesce(lp.part, 0) < 0.01"""))
def accord_sans_signature(a: Assembly) -> DataFrame:
    """Groups that vote alike but hardly sign together."""
    g = agreement.group_agreement(rollcall._pairs(a), a.members, rollcall.FLOOR).where(F.col("groupe_a") != F.col("groupe_b"))
    k = amendments.links_between_groups(amendments.network(amendments.signatures(a.amendments, a.members))[0], a.members)
    j = g.join(k, ["groupe_a", "groupe_b"], "left").select("groupe_a", "groupe_b", "accord_moyen", F.coalesce("part", F.lit(0.0)).alias("part"))
    return j.where((F.col("accord_moyen") >= 0.4) & (F.col("part") < 0.01))


@query(sql("bal", rollcall._CAMPS + "SELECT scrutin_uid, entre, round(relatif, 6) AS relatif FROM k WHERE relatif IS NOT NULL ORDER BY abs(round(relatif, 6) - 0.5), scrutin_uid LIMIT 25"))
def abstentions_centrales(a: Assembly) -> DataFrame:
    """The events whose abstainers are nearest to the middle between the camps."""
    c = rollcall._camps(a).where(F.col("relatif").isNotNull())
    return c.orderBy(F.abs(F.round("relatif", 6) - 0.5), "scrutin_uid").limit(25).select("scrutin_uid", "entre", "relatif")


@query(sql("ev bal mem am", rollcall._XM + rollcall._PAIRS + rollcall._NET + """, vm AS (SELECT a, b, taux FROM pg UNION ALL SELECT b, a, taux FROM pg), v8 AS (SELECT a, b FROM vm QUALIFY row_number() OVER (PARTITION BY a ORDER BY taux DESC, b) <= 8),
j AS (SELECT a, b, communs / (x.signatures + y.signatures - communs) AS jac FROM ed JOIN nd x ON x.acteur_uid = a JOIN nd y ON y.acteur_uid = b), jm AS (SELECT a, b, jac FROM j UNION ALL SELECT b, a, jac FROM j),
s8 AS (SELECT a, b FROM jm QUALIFY row_number() OVER (PARTITION BY a ORDER BY jac DESC, b) <= 8), m AS (SELECT DISTINCT a FROM v8)
SELECT m.a AS acteur_uid, count(s8.b) AS n_communs FROM m LEFT JOIN v8 ON v8.a = m.a LEFT JOIN s8 ON s8.a = v8.a AND s8.b = v8.b GROUP BY 1"""))
def voisins_communs(a: Assembly) -> DataFrame:
    """How many of a member's nearest by votes are among its nearest by signatures."""
    v = agreement.neighbours(rollcall._pairs(a), a.members, 8, rollcall.FLOOR).groupBy("a").agg(F.collect_set("b").alias("v"))
    e, n = amendments.network(amendments.signatures(a.amendments, a.members))
    j = agreement.mirrored(amendments.jaccard(e, n, 1).select("a", "b", "jaccard"))
    s = j.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.col("jaccard").desc(), "b"))).where(F.col("r") <= 8).groupBy("a").agg(F.collect_set("b").alias("s"))
    return v.join(s, "a", "left").select(F.col("a").alias("acteur_uid"), F.coalesce(F.size(F.array_intersect("v", "s")), F.lit(0)).alias("n_communs"))


@query(sql("am", "SELECT amendement_uid, CAST(len(cosignataires) AS BIGINT) AS n, nb_cosignataires = len(cosignataires) AS conforme FROM am WHERE nb_cosignataires > 5"))
def cosignataires_conformes(a: Assembly) -> DataFrame:
    m = a.amendments.where(F.col("nb_cosignataires") > 5)
    return m.select("amendement_uid", F.size("cosignataires").alias("n"), (F.col("nb_cosignataires") == F.size("cosignataires")).alias("conforme"))


@query(sql("ev bal mem ln", """, e AS (SELECT scrutin_uid, jour FROM ev WHERE portee = 'texte'), b AS (SELECT xb.*, e.jour FROM xb JOIN e USING (scrutin_uid) JOIN mem USING (acteur_uid))
SELECT b.acteur_uid, b.scrutin_uid, b.jour, b.position, ln.majoritaire, CASE WHEN ln.majoritaire IS NOT NULL AND ln.votants_groupe >= 5 AND ln.part_majoritaire > 0.5 THEN b.position <> ln.majoritaire END AS dissident
FROM b LEFT JOIN ln ON ln.scrutin_uid = b.scrutin_uid AND ln.groupe_uid = b.groupe_uid"""))
def votes_engageants(a: Assembly) -> DataFrame:
    """Every ballot of a member on file on an event of the highest stake, with the three-valued dissent flag."""
    e = a.events.where(F.col("portee") == "texte").select("scrutin_uid", "jour")
    b = a.expressed.join(e, "scrutin_uid").join(a.members.select("acteur_uid"), "acteur_uid", "left_semi")
    j = b.join(a.lines.select("scrutin_uid", "groupe_uid", "majoritaire", "votants_groupe", "part_majoritaire"), ["scrutin_uid", "groupe_uid"], "left")
    return j.select("acteur_uid", "scrutin_uid", "jour", "position", "majoritaire", lines.dissent_flag(F.col("position")).alias("dissident"))


@query("SELECT champ, valeur, count(*) AS n FROM (SELECT 'groupe' AS champ, groupe AS valeur FROM deputes UNION ALL SELECT 'categorie', categorie FROM scrutins UNION ALL SELECT 'sort', sort FROM amendements) GROUP BY GROUPING SETS ((champ, valeur), (champ))")
def effectifs_groupes(a: Assembly) -> DataFrame:
    """Counts of values of three columns as received, with their totals (rollup)."""
    u = a.raw("deputes").select(F.lit("groupe").alias("champ"), F.col("groupe").alias("valeur"))
    u = u.unionByName(a.raw("scrutins").select(F.lit("categorie").alias("champ"), F.col("categorie").alias("valeur"))).unionByName(a.raw("amendements").select(F.lit("sort").alias("champ"), F.col("sort").alias("valeur")))
    r = u.rollup("champ", "valeur").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return r.where(F.col("g") < 3).drop("g")


# --- models --------------------------------------------------------------------------------------------------------


@query()
def axes_compares(a: Assembly) -> DataFrame:
    """Per assembly or college: correlation of the ideal points with the first principal axis."""
    x = written(rollcall._with_units(a), "units")
    p = rollcall._fitted(a).where((F.col("genre") == "membre") & (F.col("axe") == 1)).select(F.col("unite"), F.col("uid").alias("acteur_uid"), F.col("valeur").alias("p"))
    j = p.join(scaling.pca(x).select("unite", "acteur_uid", "axe1"), ["unite", "acteur_uid"])
    return j.groupBy("unite").agg(F.count(F.lit(1)).alias("n"), F.abs(F.corr("p", "axe1")).alias("correlation"))


@query()
def scrutins_discriminants(a: Assembly) -> DataFrame:
    """Per assembly or college the ten events that part members most and the ten that part them least."""
    e = ideal.separating_power(rollcall._fitted(a))
    w = W.partitionBy("unite")
    e = e.withColumn("haut", F.row_number().over(w.orderBy(F.col("pouvoir").desc(), "scrutin_uid"))).withColumn("bas", F.row_number().over(w.orderBy("pouvoir", "scrutin_uid")))
    return e.where((F.col("haut") <= 10) | (F.col("bas") <= 10))


@query()
def medianes_axes(a: Assembly) -> DataFrame:
    """Per unit and group the median place on both axes."""
    p = scaling.pca(rollcall._with_units(a)).join(a.members.select("acteur_uid", "groupe"), "acteur_uid")
    return p.groupBy("unite", "groupe").agg(F.count(F.lit(1)).alias("n"), F.median("axe1").alias("axe1"), F.median("axe2").alias("axe2"))


@query(sql("ev am", rollcall._CORPUS + rollcall._SURGE + " SELECT max(semaine) AS semaine, count(DISTINCT semaine) AS n_semaines FROM qv WHERE q <= 0.2"))
def derniere_semaine_poussee(a: Assembly) -> DataFrame:
    """The last week in which any term surges."""
    return rollcall._surges(a).agg(F.max("semaine").alias("semaine"), F.count_distinct("semaine").alias("n_semaines"))


# --- stream --------------------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT lower(trim(position, ' ' || chr(9) || chr(160))) AS p, recu_le FROM votes)
SELECT CAST(date_trunc('week', recu_le) AS date) AS semaine, CASE WHEN p = 'nonvotant' THEN 'nonVotant' ELSE p END AS position, count(*) AS n FROM v GROUP BY 1, 2""")
def flux_hebdo(a: Assembly) -> DataFrame:
    """Rows received per week and position, as a stream over the files; read until all there is has been taken in. The state is one count per week and position."""
    spark = a.spark
    schema = a.raw("votes").schema
    s = weekly.ballot_stream(spark, f"{a.sf}/votes.parquet", schema)
    s = s.select(position("position").alias("position"), F.col("recu_le").cast("timestamp").alias("recu_le"))
    counts = s.groupBy(F.window("recu_le", "7 days", "7 days", "4 days"), "position").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("semaine"), "position", "n")
    out = scratch(spark, "stream")

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch-{batch % 2}")
        put.last = batch % 2

    put.last = None
    q = counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    empty = "semaine date, position string, n bigint"
    return spark.createDataFrame([], empty) if put.last is None else spark.read.schema(empty).parquet(f"{out}/batch-{put.last}")


@query("""WITH v AS (SELECT upper(trim(scrutin_uid, ' ' || chr(9) || chr(160))) AS s, upper(trim(acteur_uid, ' ' || chr(9) || chr(160))) AS m, lower(trim(position, ' ' || chr(9) || chr(160))) AS p FROM votes)
SELECT CASE WHEN p = 'nonvotant' THEN 'nonVotant' ELSE p END AS position, count(DISTINCT (s, m)) AS n FROM v WHERE s <> '' AND m <> '' GROUP BY 1""")
def flux_uniques(a: Assembly) -> DataFrame:
    """Ballots taken in once each, as a stream that drops what comes again: the state holds a key for as long as the watermark says, here for all the time of the data. Batches are written by their number, so a repeated one changes nothing."""
    spark, out = a.spark, scratch(a.spark, "stream")
    s = weekly.ballot_stream(spark, f"{a.sf}/votes.parquet", a.raw("votes").schema)
    s = s.select(key("scrutin_uid").alias("scrutin_uid"), key("acteur_uid").alias("acteur_uid"), position("position").alias("position"), F.col("recu_le").cast("timestamp").alias("recu_le"))
    s = weekly.once(s.where(F.col("scrutin_uid").isNotNull() & F.col("acteur_uid").isNotNull()), ["scrutin_uid", "acteur_uid", "position"], "recu_le", "36500 days")

    def put(df: DataFrame, batch: int) -> None:
        df.groupBy("position").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/batches/batch={batch}")

    weekly.rebuild_on_arrival(s, put, f"{out}/checkpoint").awaitTermination()
    kept = "position string, n bigint, batch int"
    return spark.read.schema(kept).parquet(f"{out}/batches").groupBy("position").agg(F.sum("n").alias("n"))
