"""Amendments and the co-signature network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import key, rate
from .agreement import mirrored, with_groups
from .pairs import counted_pairs, numbered

#: The outcomes of an amendment and the column that counts each; without one it was not examined.
OUTCOMES = {"Adopté": "adoptes", "Rejeté": "rejetes", "Tombé": "tombes", "Retiré": "retires", "Non soutenu": "non_soutenus"}
NO_GROUP = "NI"


def adoption() -> list[Column]:
    """Filed, examined, adopted, rejected: for use in ``agg``."""
    return [
        F.count(F.lit(1)).alias("deposes"),
        F.count("sort").alias("examines"),
        F.count_if(F.col("sort") == "Adopté").alias("adoptes"),
        F.count_if(F.col("sort") == "Rejeté").alias("rejetes"),
    ]


def by_author(amendments: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: counts, mean number of co-signers, distinct authors, and the adoption rate - of the examined ones, null if there are none."""
    out = amendments.groupBy(*keys).agg(*adoption(), F.avg("nb_cosignataires").alias("cosignataires_moyen"), F.count_distinct("auteur_uid").alias("n_auteurs"))
    return out.withColumn("taux_adoption", rate(F.col("adoptes"), F.col("examines")))


def outcomes_by(amendments: DataFrame, keys: list[str]) -> DataFrame:
    """All five outcomes per key in one pass."""
    return amendments.groupBy(*keys).agg(F.count(F.lit(1)).alias("deposes"), F.count("sort").alias("examines"), *[F.count_if(F.col("sort") == o).alias(c) for o, c in OUTCOMES.items()])


def filed_and_cosigned(amendments: DataFrame) -> DataFrame:
    """Per member: amendments filed and amendments co-signed (full outer)."""
    filed = amendments.where(F.col("auteur_uid").isNotNull()).groupBy(F.col("auteur_uid").alias("acteur_uid")).agg(F.count(F.lit(1)).alias("deposes"))
    names = amendments.select(F.explode("cosignataires").alias("c")).select(key("c").alias("acteur_uid")).where(F.col("acteur_uid").isNotNull())
    signed = names.groupBy("acteur_uid").agg(F.count(F.lit(1)).alias("cosignes"))
    return filed.join(signed, "acteur_uid", "full").na.fill(0, ["deposes", "cosignes"])


def signatures(amendments: DataFrame, members: DataFrame, at_most: int | None = 10, at_least: int = 2) -> DataFrame:
    """(amendement_uid, acteur_uid): the known members who signed, author included, each once; the bounds on their number hold after that."""
    who = F.concat(F.array("auteur_uid"), F.coalesce("cosignataires", F.array().cast("array<string>")))
    s = amendments.select("amendement_uid", F.explode(who).alias("c")).select("amendement_uid", key("c").alias("acteur_uid")).where(F.col("acteur_uid").isNotNull()).distinct()
    s = s.join(members.select("acteur_uid"), "acteur_uid", "left_semi")
    n = s.groupBy("amendement_uid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    if at_most is not None:
        n = n.where(F.col("n") <= at_most)
    return s.join(n.select("amendement_uid"), "amendement_uid", "left_semi").select("amendement_uid", "acteur_uid")


def chosen(amendments: DataFrame, since: str | None = None, without_rapporteurs: bool = False) -> DataFrame:
    """Amendments filed since a day, without those that rapporteurs file."""
    out = amendments if since is None else amendments.where(F.col("jour") >= F.lit(since).cast("date"))
    return out.where(~F.coalesce("auteur_rapporteur", F.lit(False))) if without_rapporteurs else out


def network(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, communs) with a < b, and (acteur_uid, signatures). The bound on signers bounds the pairs of an amendment."""
    x = signed.groupBy("amendement_uid").agg(F.array_sort(F.collect_set("acteur_uid")).alias("x"))
    left = x.select(F.posexplode("x").alias("pos", "a"), "x")
    edges = left.select("a", F.explode(F.expr("slice(x, pos + 2, size(x))")).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("communs"))
    return edges, signed.groupBy("acteur_uid").agg(F.count(F.lit(1)).alias("signatures"))


def jaccard(edges: DataFrame, nodes: DataFrame, min_signatures: int = 20, min_shared: int = 0) -> DataFrame:
    """Shared over united signatures, for pairs of members with enough signatures each."""
    n = nodes.where(F.col("signatures") >= min_signatures)
    a = n.select(F.col("acteur_uid").alias("a"), F.col("signatures").alias("sa"))
    b = n.select(F.col("acteur_uid").alias("b"), F.col("signatures").alias("sb"))
    j = edges.where(F.col("communs") >= min_shared).join(a, "a").join(b, "b")
    return j.withColumn("jaccard", F.col("communs") / (F.col("sa") + F.col("sb") - F.col("communs")))


def co_signers(amendments: DataFrame, members: DataFrame, at_most: int = 10) -> DataFrame:
    """(acteur_uid, cosignataires): all who ever signed with a member, ranked: by Jaccard over the amendments of at most ``at_most`` signers (those that whole groups file tell
    no more than the group; none in common, and nothing to measure by, are last), then by Jaccard over all amendments (``jaccard_tous``, ``communs_tous``), then by uid.

    Both are counted in one pass: the amendments of few signers are those of one label. Pairs of an amendment are counted by blocks of its signers, however many these are.
    """
    signed = signatures(amendments, members, None)
    n = signed.groupBy("amendement_uid").agg(F.count(F.lit(1)).alias("n"))
    rows = signed.join(n, "amendement_uid").select("amendement_uid", "acteur_uid", (F.col("n") <= at_most).alias("peu"))
    items = numbered(rows, "acteur_uid", F.count_if("peu").alias("s"), F.count(F.lit(1)).alias("st"))
    pairs = counted_pairs(rows.join(items.select("acteur_uid", "num"), "acteur_uid"), "amendement_uid", "num", "peu", (True,))
    end = lambda c: items.select(F.col("num").alias(c), *[F.col(x).alias(f"{x}{c}") for x in ("acteur_uid", "s", "st")])
    share = lambda both, size: rate(F.col(both), F.col(f"{size}a") + F.col(f"{size}b") - F.col(both))
    j = pairs.join(end("a"), "a").join(end("b"), "b").select(F.col("acteur_uida").alias("a"), F.col("acteur_uidb").alias("b"), share("same", "s").alias("j"), "same", share("both", "st").alias("jt"), "both")
    one = F.struct(F.when(F.col("j") > 0, -F.col("j")).otherwise(0.0).alias("loin"), (-F.col("jt")).alias("loin_tous"), "b", "j", "same", "jt", "both")
    j = mirrored(j).groupBy(F.col("a").alias("acteur_uid")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    ranked = lambda x, i: F.struct((i + 1).alias("rang"), x["b"].alias("b"), x["j"].alias("jaccard"), x["same"].alias("communs"), x["jt"].alias("jaccard_tous"), x["both"].alias("communs_tous"))
    return j.select("acteur_uid", F.transform("x", ranked).alias("cosignataires"))


def top_pairs(edges: DataFrame, nodes: DataFrame, members: DataFrame, k: int = 20, min_signatures: int = 20, min_shared: int = 5, across: bool = True) -> DataFrame:
    """The ``k`` pairs with the highest Jaccard, by default across groups; ties by uids."""
    p = with_groups(jaccard(edges, nodes, min_signatures, min_shared), members)
    if across:
        p = p.where(~F.col("groupe_a").eqNullSafe(F.col("groupe_b")))
    return p.orderBy(F.round("jaccard", 9).desc(), "a", "b").limit(k).select("a", "b", "groupe_a", "groupe_b", "communs", "jaccard")


def links_between_groups(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Per ordered pair of groups: links and their share of the first group's links; a pair within a group counts once."""
    e = with_groups(edges, members).where(F.col("groupe_a").isNotNull() & F.col("groupe_b").isNotNull()).select("groupe_a", "groupe_b", "communs")
    other = e.where(F.col("groupe_a") != F.col("groupe_b")).select(F.col("groupe_b").alias("groupe_a"), F.col("groupe_a").alias("groupe_b"), "communs")
    links = e.unionByName(other).groupBy("groupe_a", "groupe_b").agg(F.sum("communs").alias("liens"))
    return links.withColumn("part", F.col("liens") / F.sum("liens").over(W.partitionBy("groupe_a")))


def openness(edges: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Per member who signs: the share of its links that leave the group, over the share to expect from the group's size; null without links. Members without a group are of one."""
    present = members.select("acteur_uid", "groupe").join(nodes, "acteur_uid")
    size = present.groupBy(F.col("groupe").alias("__g")).agg(F.count(F.lit(1)).alias("taille"))
    e = with_groups(mirrored(edges), members)
    own = e.groupBy(F.col("a").alias("acteur_uid")).agg(F.sum("communs").alias("liens"), F.sum(F.when(~F.col("groupe_a").eqNullSafe(F.col("groupe_b")), F.col("communs")).otherwise(0)).alias("dehors"))
    total = present.count()
    j = present.join(size, F.col("groupe").eqNullSafe(F.col("__g"))).drop("__g").join(own, "acteur_uid", "left")
    expected = rate(F.lit(total) - F.col("taille"), F.lit(total - 1))
    share = rate(F.col("dehors"), F.col("liens"))
    return j.select("acteur_uid", "groupe", "signatures", "liens", share.alias("part_dehors"), expected.alias("part_attendue"), F.try_divide(share, F.nullif(expected, F.lit(0.0))).alias("ratio"))


def brokers(edges: DataFrame, nodes: DataFrame, members: DataFrame, min_signatures: int = 30) -> DataFrame:
    """:func:`openness` of the members of real groups who sign enough."""
    return openness(edges, nodes, members).where(F.col("groupe").isNotNull() & (F.col("groupe") != NO_GROUP) & (F.col("signatures") >= min_signatures))


def vote_and_signature(links: DataFrame, groups: DataFrame) -> DataFrame:
    """Per pair of different groups: agreement in votes, share of links, both average ranks and their difference."""
    from ..functions.stats import average_rank

    j = groups.where(F.col("groupe_a") != F.col("groupe_b")).join(links, ["groupe_a", "groupe_b"])
    j = j.select("groupe_a", "groupe_b", "accord_moyen", "part")
    j = j.withColumn("rang_vote", average_rank(F.col("accord_moyen").desc(), [F.lit(0)])).withColumn("rang_signature", average_rank(F.col("part").desc(), [F.lit(0)]))
    return j.withColumn("ecart_rang", F.col("rang_signature") - F.col("rang_vote"))


def cap_sweep(amendments: DataFrame, members: DataFrame, caps: tuple[int, ...] = (100, 40, 20, 10, 6)) -> DataFrame:
    """Per cap on signers: amendments kept and signatures on them, in one pass over the signatures."""
    s = signatures(amendments, members, None)
    n = s.groupBy("amendement_uid").agg(F.count(F.lit(1)).alias("n"))
    out = n.select("n", F.explode(F.array(*[F.lit(c) for c in caps])).alias("plafond")).where(F.col("n") <= F.col("plafond"))
    return out.groupBy("plafond").agg(F.count(F.lit(1)).alias("n_amendements"), F.sum("n").alias("n_signatures"))


def caps_compared(amendments: DataFrame, members: DataFrame, caps: tuple[int | None, ...] = (None, 100, 40, 20, 10, 6)) -> DataFrame:
    """Per cap on signers (null: none): amendments kept, signatures on them, the median of members' signatures and the pair with most in common.

    Pairs are counted once for each amendment, by the number of its signers, and summed up to each cap: an amendment is never emitted once per cap.
    """
    s = signatures(amendments, members, None)
    n = s.groupBy("amendement_uid").agg(F.count(F.lit(1)).alias("n"))
    cap = F.explode(F.array(*[F.lit(c).cast("long") for c in caps])).alias("plafond")
    fits = F.col("plafond").isNull() | (F.col("n") <= F.col("plafond"))
    kept = n.select("n", cap).where(fits).groupBy("plafond").agg(F.count(F.lit(1)).alias("n_amendements"), F.sum("n").alias("n_signatures"))
    by = s.join(n, "amendement_uid").groupBy("acteur_uid", "n").agg(F.count(F.lit(1)).alias("m")).select("acteur_uid", "n", "m", cap).where(fits)
    middle = by.groupBy("plafond", "acteur_uid").agg(F.sum("m").alias("m")).groupBy("plafond").agg(F.median("m").alias("mediane_signatures"))
    rows = s.join(n, "amendement_uid").withColumn("__l", F.lit(0))
    items = numbered(rows, "acteur_uid")
    pairs = counted_pairs(rows.join(items.select("acteur_uid", "num"), "acteur_uid"), "amendement_uid", "num", "__l", (0,), ("n",)).select("n", "a", "b", "both", cap).where(fits)
    pairs = pairs.groupBy("plafond", "a", "b").agg(F.sum("both").alias("communs"))
    one, two = items.select(F.col("num").alias("a"), F.col("acteur_uid").alias("na")), items.select(F.col("num").alias("b"), F.col("acteur_uid").alias("nb"))
    pairs = pairs.join(one, "a").join(two, "b").select("plafond", F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "communs")
    best = pairs.withColumn("r", F.row_number().over(W.partitionBy("plafond").orderBy(F.col("communs").desc(), "a", "b"))).where(F.col("r") == 1).drop("r")
    same = lambda x, y: x.join(y.withColumnRenamed("plafond", "__p"), F.col("plafond").eqNullSafe(F.col("__p")), "left").drop("__p")
    return same(same(kept, middle), best)
