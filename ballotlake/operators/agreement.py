"""Who votes with whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import EXPRESSED
from ..session import written
from .pairs import counted_pairs, numbered


def pair_counts(expressed: DataFrame, by: list[str] | None = None, floor: int = 1) -> DataFrame:
    """(by, a, b, accord, communs) for pairs a < b of members: events in which both expressed, and on the same side.

    ``by``: columns of the event to count apart (stake levels in one pass). Members are numbered, so that pairs are of longs; names come back to what reaches the floor.
    """
    by = by or []
    items = numbered(expressed, "acteur_uid")
    rows = expressed.join(items.select("acteur_uid", "num"), "acteur_uid")
    out = counted_pairs(rows, "scrutin_uid", "num", "position", EXPRESSED, tuple(by)).where(F.col("both") >= floor)
    return _named(out, items, by)


def member_numbers(members: DataFrame) -> DataFrame:
    """(acteur_uid, num, bits): a number for each member, larger for a larger uid; its lowest ``bits`` bits tell the group (0: none), so pairs of numbers need no join to
    tell whether they are of one group. Written once, so that it stays the same."""
    groups = members.where(F.col("groupe").isNotNull()).groupBy("groupe").agg(F.lit(1).alias("__one"))
    groups = groups.select("groupe", F.row_number().over(W.orderBy("groupe")).alias("__g"))
    names = members.select("acteur_uid", "groupe").join(groups, "groupe", "left").select("acteur_uid", F.coalesce("__g", F.lit(0)).cast("bigint").alias("__g"))
    bits = groups.agg(F.coalesce(F.max("__g"), F.lit(0)).alias("n")).first()["n"].bit_length()
    return written(names.orderBy("acteur_uid").select("acteur_uid", F.shiftleft(F.monotonically_increasing_id(), bits).bitwiseOR(F.col("__g")).alias("num"), F.lit(bits).alias("bits")), "members")


def numbered_counts(expressed: DataFrame, numbers: DataFrame, floor: int = 1) -> DataFrame:
    """(a, b, same, both) of :func:`pair_counts` for the members numbered, a < b being numbers."""
    rows = expressed.select("scrutin_uid", "acteur_uid", "position").join(numbers.select("acteur_uid", "num"), "acteur_uid")
    return counted_pairs(rows, "scrutin_uid", "num", "position", EXPRESSED).where(F.col("both") >= floor)


def named_counts(counted: DataFrame, numbers: DataFrame) -> DataFrame:
    """(a, b, accord, communs) of counted pairs of numbers."""
    return _named(counted, numbers, [])


def _named(counted: DataFrame, items: DataFrame, by: list[str]) -> DataFrame:
    """Counted pairs of numbers with the members' names."""
    one, two = items.select(F.col("num").alias("a"), F.col("acteur_uid").alias("na")), items.select(F.col("num").alias("b"), F.col("acteur_uid").alias("nb"))
    return counted.join(one, "a").join(two, "b").select(*by, F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), F.col("same").alias("accord"), F.col("both").alias("communs"))


def agreement(pairs: DataFrame, floor: int = 30) -> DataFrame:
    """Add the rate; pairs below the floor are not measured and have no row."""
    return pairs.where(F.col("communs") >= floor).withColumn("taux", F.col("accord") / F.col("communs"))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions."""
    swap = {"a": "b", "b": "a", "groupe_a": "groupe_b", "groupe_b": "groupe_a"}
    other = pairs.select(*[F.col(swap.get(c, c)).alias(c) for c in pairs.columns])
    return pairs.unionByName(other)


def with_groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    g = members.select("acteur_uid", "groupe")
    a = g.select(F.col("acteur_uid").alias("a"), F.col("groupe").alias("groupe_a"))
    b = g.select(F.col("acteur_uid").alias("b"), F.col("groupe").alias("groupe_b"))
    return pairs.join(a, "a").join(b, "b")


def group_agreement(pairs: DataFrame, members: DataFrame, floor: int = 30, by: list[str] | None = None) -> DataFrame:
    """Per ordered pair of groups: mean of the pair rates, ratio of the sums, pairs and shared events; the two conventions differ.

    A pair within one group counts once, a pair across two comes out for both orders. Members without a group are left out. Groups without a measured
    pair have no row (no measure), not a zero.
    """
    by = by or []
    p = with_groups(agreement(pairs, floor), members).where(F.col("groupe_a").isNotNull() & F.col("groupe_b").isNotNull())
    both = p.select(*by, "groupe_a", "groupe_b", "taux", "accord", "communs")
    other = p.where(F.col("groupe_a") != F.col("groupe_b")).select(*by, F.col("groupe_b").alias("groupe_a"), F.col("groupe_a").alias("groupe_b"), "taux", "accord", "communs")
    out = both.unionByName(other).groupBy(*by, "groupe_a", "groupe_b").agg(
        F.avg("taux").alias("accord_moyen"), (F.sum("accord") / F.sum("communs")).alias("accord_agrege"), F.count(F.lit(1)).alias("n_paires"), F.sum("communs").alias("scrutins_communs")
    )
    return out


def with_all_pairs(measured: DataFrame, members: DataFrame, zero: tuple[str, ...] = ()) -> DataFrame:
    """Every ordered pair of the members' groups, with null where nothing was measured (0 in the columns ``zero``). Groups are few beside members; what comes out is their square by definition."""
    names = members.where(F.col("groupe").isNotNull()).groupBy("groupe").agg(F.lit(1).alias("__one")).agg(F.array_sort(F.collect_list("groupe")).alias("g"))
    pairs = names.select(F.explode("g").alias("groupe_a"), "g").select("groupe_a", F.explode("g").alias("groupe_b"))
    return pairs.join(measured, ["groupe_a", "groupe_b"], "left").na.fill(0, list(zero))


def cohesion(groups: DataFrame, members: DataFrame) -> DataFrame:
    """The diagonal of :func:`group_agreement` with each group's headcount."""
    size = members.where(F.col("groupe").isNotNull()).groupBy("groupe").agg(F.count(F.lit(1)).alias("effectif"))
    own = groups.where(F.col("groupe_a") == F.col("groupe_b")).select(F.col("groupe_a").alias("groupe"), F.col("accord_moyen").alias("cohesion"), "n_paires")
    return size.join(own, "groupe", "left")


def counts_with_one(expressed: DataFrame, member: str) -> DataFrame:
    """(b, accord, communs) of one member with all others: its events are found first, so one row of the matrix costs one row."""
    own = expressed.where(F.col("acteur_uid") == member).select("scrutin_uid", F.col("position").alias("__p"))
    others = expressed.where(F.col("acteur_uid") != member).join(own, "scrutin_uid")
    return others.groupBy(F.col("acteur_uid").alias("b")).agg(F.count_if(F.col("position") == F.col("__p")).alias("accord"), F.count(F.lit(1)).alias("communs"))


def neighbours(pairs: DataFrame, members: DataFrame, k: int = 8, floor: int = 30, inverse: bool = False, outside: bool = False) -> DataFrame:
    """The ``k`` nearest (or farthest) members of every member, ties by uid; ``outside``: of other groups only. Two members without a group are of the same one."""
    g = mirrored(with_groups(agreement(pairs, floor), members))
    if outside:
        g = g.where(~F.col("groupe_a").eqNullSafe(F.col("groupe_b")))
    order = F.col("taux").asc() if inverse else F.col("taux").desc()
    w = W.partitionBy("a").orderBy(order, "b")
    return g.withColumn("rang", F.row_number().over(w)).where(F.col("rang") <= k).select("a", "b", "taux", "communs", "rang")


def nearest(counted: DataFrame, numbers: DataFrame, k: int | None = 8, floor: int = 30) -> DataFrame:
    """(a, proches, hors_groupe, opposes): what :func:`neighbours` gives of the nearest members, the nearest of other groups and the farthest, as arrays, in one pass;
    without ``k`` every member measured with it is in them.

    ``counted``: from :func:`numbered_counts`. Pairs travel once, as numbers. A member's pairs are at most as many as it has members beside it.
    """
    return nearest_by_number(counted, numbers, k, floor).join(numbers.select("num", F.col("acteur_uid").alias("a")), "num").select("a", "proches", "hors_groupe", "opposes")


def nearest_by_number(counted: DataFrame, numbers: DataFrame, k: int | None, floor: int) -> DataFrame:
    """:func:`nearest` by the member's number, ``num``, in the place of ``a``: rows lie by it, so that what is joined to them moves and they do not."""
    bits = numbers.agg(F.max("bits")).first()[0] or 0
    group = lambda c: F.col(c).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
    p = counted.where(F.col("both") >= floor)
    ways = F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    p = p.select(F.explode(ways).alias("p"), F.col("same").cast("int").alias("same"), F.col("both").cast("int").alias("both")).select("p.a", "p.b", "same", "both").repartition("a")
    p = p.join(numbers.select(F.col("num").alias("b"), F.col("acteur_uid").alias("nb")), "b")
    # an array is sorted by its fields in turn: the share of events on different sides, or on the same, then the name
    apart, taux = (F.col("both") - F.col("same")) / F.col("both"), lambda x: x["same"] / x["both"]
    p = p.groupBy(F.col("a").alias("num")).agg(F.array_sort(F.collect_list(F.struct(apart.alias("apart"), F.col("nb").alias("b"), "same", "both", (group("a") != group("b")).alias("dehors")))).alias("tous"))
    far = F.array_sort(F.transform("tous", lambda x: F.struct(taux(x).alias("taux"), x["b"].alias("b"), x["same"].alias("same"), x["both"].alias("both"))))
    lists = {"proches": F.col("tous"), "hors_groupe": F.filter("tous", lambda x: x["dehors"]), "opposes": far}
    ranked = lambda x, i: F.struct((i + 1).alias("rang"), x["b"].alias("b"), taux(x).alias("taux"), x["both"].cast("bigint").alias("communs"))
    p = p.select("num", *[F.transform(c if k is None else F.slice(c, 1, k), ranked).alias(name) for name, c in lists.items()])
    return p.select("num", *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in lists])


def remarkable(pairs: DataFrame, members: DataFrame, k: int = 20, floor: int = 100, across: bool = True) -> DataFrame:
    """The ``k`` pairs with the highest rate, by default across groups; ties by uids."""
    p = with_groups(agreement(pairs, floor), members)
    if across:
        p = p.where(~F.col("groupe_a").eqNullSafe(F.col("groupe_b")))
    return p.orderBy(F.col("taux").desc(), "a", "b").limit(k)


def sample_size_check(expressed: DataFrame, events: DataFrame, pairs: list[tuple[str, str]], members: DataFrame, level: str, m: int, draws: int = 40, seed: int = 0, floor: int = 10) -> DataFrame:
    """Is the agreement of two groups at ``level`` outside what random samples of ``m`` events of the whole give?

    Each draw takes ``m`` events without replacement by a seeded hash; all draws are aggregated in one pass. Only members of the groups asked for are counted, and the
    ballots of an event are brought together once, however often it is drawn.
    Result: groupe_a, groupe_b, observe, plancher, plafond, hors (null without a measure).
    """
    couples = sorted(set(pairs))
    at = F.array_compact(F.array(*[F.when(F.col("groupe").isin(a, b), i) for i, (a, b) in enumerate(couples)]))
    asked = members.select("acteur_uid", F.explode(at).alias("couple"))
    x = written(expressed.select("scrutin_uid", "acteur_uid", "position").join(asked, "acteur_uid"), "asked")
    drawn = events.select("scrutin_uid", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("tirage"))
    w = W.partitionBy("tirage").orderBy(F.xxhash64(F.lit(seed), "tirage", "scrutin_uid"), "scrutin_uid")
    drawn = drawn.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= m).select("scrutin_uid", "tirage")
    own = events.where(F.col("portee") == level).select("scrutin_uid", F.lit(0).alias("tirage"))
    items = numbered(x, "acteur_uid")
    counted = counted_pairs(x.join(items.select("acteur_uid", "num"), "acteur_uid"), "scrutin_uid", "num", "position", EXPRESSED, ("couple",), drawn=drawn.unionByName(own))
    rates = group_agreement(_named(counted.where(F.col("both") >= floor), items, ["couple", "tirage"]), members, floor, ["couple", "tirage"])
    wanted = F.lit(False)
    for i, (a, b) in enumerate(couples):
        wanted = wanted | ((F.col("couple") == i) & (F.col("groupe_a") == a) & (F.col("groupe_b") == b))
    rates = rates.where(wanted)
    real = F.col("tirage") == 0
    out = rates.groupBy("groupe_a", "groupe_b").agg(
        F.max(F.when(real, F.col("accord_moyen"))).alias("observe"), F.min(F.when(~real, F.col("accord_moyen"))).alias("plancher"), F.max(F.when(~real, F.col("accord_moyen"))).alias("plafond")
    )
    return out.withColumn("hors", (F.col("observe") < F.col("plancher")) | (F.col("observe") > F.col("plafond")))


