"""The inventory's operators on small cases by hand."""

import base64
import datetime as dt
import math
import random
import time
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ballotlake.functions import stats, text
from ballotlake.operators import abstention, agreement, alerts, amendments, ideal, lines, scaling, topics
from ballotlake.plans import rollcall, views
from ballotlake.plans.assembly import Assembly
from ballotlake.plans.rollcall import one_member, status
from ballotlake.session import written

D = dt.date
TOY = {"A": ["pour", "pour", "contre", "contre", "abstention", "pour"], "B": ["pour", "pour", "contre", "contre", "abstention", "pour"], "C": ["contre", "contre", "pour", "pour", "abstention", "contre"], "D": ["pour"]}


@pytest.fixture(scope="module")
def toy(spark):
    return spark.createDataFrame([(f"s{j}", m, p) for m, x in TOY.items() for j, p in enumerate(x, 1)], "scrutin_uid string, acteur_uid string, position string")


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("A", "G1", "Anne Un"), ("B", "G1", "Bob Deux"), ("C", "G2", "Cléo Trois"), ("D", "G2", "Dan Trois")], "acteur_uid string, groupe string, nom_complet string")


def test_pair_agreement(toy, people):
    p = {(r["a"], r["b"]): (r["accord"], r["communs"]) for r in agreement.pair_counts(toy).collect()}
    assert p == {("A", "B"): (6, 6), ("A", "C"): (1, 6), ("B", "C"): (1, 6), ("A", "D"): (1, 1), ("B", "D"): (1, 1), ("C", "D"): (0, 1)}
    one = {r["b"]: (r["accord"], r["communs"]) for r in agreement.counts_with_one(toy, "A").collect()}
    assert one == {"B": (6, 6), "C": (1, 6), "D": (1, 1)}


def test_group_agreement_conventions(toy, people):
    g = {(r["groupe_a"], r["groupe_b"]): r for r in agreement.group_agreement(agreement.pair_counts(toy), people, 1).collect()}
    assert g["G1", "G1"]["n_paires"] == 1 and g["G1", "G2"]["n_paires"] == 4
    assert math.isclose(g["G1", "G2"]["accord_moyen"], 7 / 12) and math.isclose(g["G1", "G2"]["accord_agrege"], 4 / 14)
    assert g["G1", "G2"]["accord_moyen"] == g["G2", "G1"]["accord_moyen"]
    g3 = {(r["groupe_a"], r["groupe_b"]): r for r in agreement.group_agreement(agreement.pair_counts(toy), people, 3).collect()}
    assert g3["G1", "G2"]["n_paires"] == 2 and math.isclose(g3["G1", "G2"]["accord_agrege"], 1 / 6) and ("G2", "G2") not in g3


def test_neighbours(toy, people):
    n = agreement.neighbours(agreement.pair_counts(toy), people, 1, 3)
    assert {(r["a"], r["b"]) for r in n.collect()} == {("A", "B"), ("B", "A"), ("C", "A")}
    far = agreement.neighbours(agreement.pair_counts(toy), people, 1, 3, inverse=True, outside=True)
    assert {(r["a"], r["b"]) for r in far.collect()} == {("A", "C"), ("B", "C"), ("C", "A")}


@pytest.mark.parametrize(
    "votes,label,tie,share,voters",
    [((2, 1, 0), "pour", False, 2 / 3, 3), ((2, 2, 0), None, True, 0.5, 4), ((3, 2, 2), "pour", False, 3 / 7, 7), ((7, 5, 5), "pour", False, 7 / 17, 17), ((3, 2, 1), "pour", False, 0.5, 6)],
)
def test_group_line(spark, votes, label, tie, share, voters):
    data = [("s", "g", p) for p, n in zip(("pour", "contre", "abstention"), votes) for _ in range(n)]
    r = lines.group_lines(spark.createDataFrame(data, "scrutin_uid string, groupe_uid string, position string"), "scrutin_uid", "groupe_uid", "position").first()
    assert (r["majoritaire"], r["partage"], r["votants_groupe"]) == (label, tie, voters) and math.isclose(r["part_majoritaire"], share)


def test_dissent_flag_has_three_values(spark):
    df = spark.createDataFrame([("pour", "pour", 0.9), ("contre", "pour", 0.9), ("abstention", "pour", 0.41), ("pour", None, None), ("contre", "pour", 0.5)], "position string, majoritaire string, part_majoritaire double").withColumn("votants_groupe", F.lit(30))
    assert [r[0] for r in df.select(lines.dissent_flag(F.col("position"))).collect()] == [False, True, None, None, None]


def test_terms_are_unions_of_closed_intervals(spark):
    p = "array<struct<debut:string,fin:string>>"
    m = spark.createDataFrame([("a", [("2024-07-08", "2024-10-21"), ("2025-11-06", None)]), ("b", [("2024-07-08", "2024-10-21")]), ("c", [])], f"acteur_uid string, periodes_mandat {p}")
    days = {"a": [(D(2024, 9, 1), True), (D(2024, 12, 1), False), (D(2025, 6, 1), False), (D(2026, 6, 2), True)], "b": [(D(2024, 7, 7), False), (D(2024, 7, 8), True), (D(2024, 10, 21), True), (D(2024, 10, 22), False)], "c": [(D(2025, 1, 1), False)]}
    rows = spark.createDataFrame([(k, d, e) for k, x in days.items() for d, e in x], "acteur_uid string, jour date, attendu boolean")
    periods = lines.term_periods(m)
    assert lines.in_term(rows, periods).where("eligible <> attendu").count() == 0
    events = spark.createDataFrame([(D(2024, 7, 8),), (D(2024, 10, 21),), (D(2024, 10, 22),), (D(2025, 11, 6),), (D(2026, 1, 1),), (None,)], "jour date")
    got = {r["acteur_uid"]: r["n"] for r in lines.eligible_counts(periods, lines.calendar(events), ["n"]).collect()}
    assert got == {"a": 4, "b": 2}


def test_participation(spark):
    counts = spark.createDataFrame([("P", 4), ("O", 4), ("X", 0)], "acteur_uid string, n bigint")
    b = [("P", "pour", None), *[("P", "nonVotant", "PAN")] * 3, ("O", "pour", None), ("O", "pour", None)]
    flagged = spark.createDataFrame(b, "acteur_uid string, position string, cause string").withColumn("eligible", F.lit(True))
    got = {r["acteur_uid"]: (r["structurels"], r["denominateur"], r["taux"]) for r in lines.participation(counts, flagged).collect()}
    assert got == {"P": (3, 1, 1.0), "O": (0, 4, 0.5), "X": (0, 0, None)}


def test_status_is_ordered(spark):
    df = spark.createDataFrame([(True, "pour"), (True, None), (True, "nonVotant"), (False, None), (False, "pour"), (None, "pour")], "e boolean, p string")
    assert [r[0] for r in df.select(status(F.col("e"), F.col("p"))).collect()] == ["pour", "absent", "empeche", "hors_mandat", "hors_mandat", "hors_mandat"]


def test_one_member(people):
    assert one_member(people, "anne un") == "A"
    with pytest.raises(KeyError, match="ambiguous"):
        one_member(people, "trois")
    with pytest.raises(KeyError, match="none"):
        one_member(people, "zoé")


def test_tipping(spark):
    e = spark.createDataFrame([("a", 200, 190, 10), ("b", 190, 200, 10), ("c", 190, 200, 11), ("d", 200, 200, 1)], "scrutin_uid string, n_pour int, n_contre int, n_abstention int").withColumn("nb_votants", F.lit(400))
    assert {(r["scrutin_uid"], r["vers"], r["requis"]) for r in abstention.tipping(e).collect()} == {("a", "rejet", 10), ("c", "adoption", 11), ("d", "adoption", 1)}


def test_abstention_decomposition(spark):
    x = spark.createDataFrame([("S1", "G1"), ("S2", "G1"), ("S3", "G2"), ("S4", "G3")], "scrutin_uid string, groupe_uid string").withColumn("position", F.lit("abstention"))
    ln = spark.createDataFrame([("S1", "G1", "abstention", 0.9), ("S2", "G1", "pour", 0.9), ("S3", "G2", "pour", 0.41)], "scrutin_uid string, groupe_uid string, majoritaire string, part_majoritaire double").withColumn("votants_groupe", F.lit(30))
    got = {r["nature"]: (r["n"], r["part"]) for r in abstention.decomposition(x, ln).collect()}
    assert got == {"consigne": (1, 0.25), "retrait": (1, 0.25), "indeterminee": (2, 0.5)}


@pytest.mark.parametrize("pattern,between,relative", [("c" * 10 + "a" * 10 + "p" * 10, True, 0.5), ("p" * 10 + "a" * 10 + "c" * 10, True, 0.5), ("c" * 14 + "a" * 2 + "p" * 14, None, None)])
def test_abstainers_between_camps(spark, pattern, between, relative):
    names = {"p": "pour", "c": "contre", "a": "abstention"}
    data = [("s", names[k], float(x)) for k, x in zip(pattern, np.linspace(-1, 1, 30))]
    got = abstention.between_camps(spark.createDataFrame(data, "scrutin_uid string, position string, axe double")).collect()
    assert (got == []) if between is None else (got[0]["entre"] is between and abs(got[0]["relatif"] - relative) < 0.05)


def test_network(spark):
    e = spark.createDataFrame([("A", "B", 80), ("A", "C", 10), ("A", "D", 5), ("B", "C", 10), ("B", "D", 5), ("C", "D", 2)], "a string, b string, communs bigint")
    n = spark.createDataFrame([("A", 100), ("B", 100), ("C", 40), ("D", 20)], "acteur_uid string, signatures bigint")
    m = spark.createDataFrame([("A", "G1"), ("B", "G1"), ("C", "G1"), ("D", "G2")], "acteur_uid string, groupe string")
    j = {(r["a"], r["b"]): r["jaccard"] for r in amendments.jaccard(e, n, 30).collect()}
    assert math.isclose(j["A", "B"], 80 / 120) and ("A", "D") not in j
    k = {(r["groupe_a"], r["groupe_b"]): (r["liens"], r["part"]) for r in amendments.links_between_groups(e, m).collect()}
    assert k["G1", "G1"][0] == 100 and k["G1", "G2"][0] == 12 and math.isclose(k["G1", "G2"][1], 12 / 112)
    b = {r["acteur_uid"]: r for r in amendments.brokers(e, n, m, 1).collect()}
    assert b["D"]["part_dehors"] == 1.0 and b["D"]["ratio"] == 1.0 and b["A"]["ratio"] < 1 and math.isclose(b["A"]["part_attendue"], 1 / 3)


def test_adoption_rate(spark):
    a = [("x", "Adopté")] * 25 + [("x", "Rejeté")] * 25 + [("x", None)] * 50 + [("y", "Adopté")] + [("y", "Tombé")] * 9 + [("z", None)] * 5
    df = spark.createDataFrame(a, "auteur_uid string, sort string").withColumn("nb_cosignataires", F.lit(1))
    assert {r["auteur_uid"]: r["taux_adoption"] for r in amendments.by_author(df, ["auteur_uid"]).collect()} == {"x": 0.5, "y": 0.1, "z": None}


@pytest.mark.parametrize(
    "title,cat",
    [
        ("l'ensemble de la proposition de loi", "ensemble"), ("L'ensemble du projet", "ensemble"), ("l'amendement n° 7", "amendement"), ("le sous-amendement n° 2", "amendement"), ("les amendements identiques n° 3", "amendement"),
        ("l'article premier", "article"), ("la motion de censure déposée", "motion_censure"), ("la motion de rejet préalable", "motion_procedure"), ("la déclaration du Gouvernement", "declaration"), ("la première partie", "autre"), ("", "autre"), (None, "autre"),
    ],
)
def test_category(spark, title, cat):
    assert spark.createDataFrame([(title,)], "t string").select(text.category(F.col("t"))).first()[0] == cat


def test_html_and_tokens(spark):
    df = spark.createDataFrame([("R&#x00E9;dactionnel",), ("<p>Cet amendement <b>vise</b> à</p>",), ("&amp;#x00E9;t&#x00E9;",), ("a&nbsp;&nbsp;  b",), ("<p></p>",), (None,)], "t string")
    assert [r[0] for r in df.select(text.strip_html(F.col("t"))).collect()] == ["Rédactionnel", "Cet amendement vise à", "été", "a b", None, None]
    df = spark.createDataFrame([("un go et ub",), (None,), ("",), ("Écologie agricole des forêts",), ("mixte paritaire",)], "t string")
    assert [r[0] for r in df.select(text.tokens(F.col("t"))).collect()] == [[], [], [], ["ecologie", "agricole", "forets", "ecologie agricole", "agricole forets"], []]


def test_surges(spark):
    weeks = [D(2026, 1, 5), D(2026, 1, 12), D(2026, 1, 19), D(2026, 1, 26)]
    rows = [(w, "retraites", 20, 20, 100) for w in weeks] + [(w, "agricole", n, n, 100) for w, n in zip(weeks, (2, 2, 2, 40))] + [(w, "alinea", n, 30, 100) for w, n in zip(weeks, (30, 30, 30, 300))]
    f = spark.createDataFrame(rows, "semaine date, terme string, n bigint, n_docs bigint, n_documents bigint")
    found = topics.surges(f).where(F.col("semaine") == D(2026, 1, 26)).collect()
    assert [r["terme"] for r in found] == ["agricole"] and found[0]["q"] >= found[0]["p"] and found[0]["q"] <= 1
    s = {r["semaine"]: r["part"] for r in topics.term_series(f.where("terme <> 'agricole' OR n_docs > 2"), "agricole").collect()}
    assert s[weeks[0]] == 0 and s[weeks[3]] == 0.4


def test_redundant_terms(spark):
    w = D(2026, 1, 5)
    rows = [(w, "eau", 40, 1.0, 9.0), (w, "eau potable", 39, 1.0, 8.0), (w, "loup", 12, 2.0, 5.0), (w, "meute loup", 12, 2.0, 5.0), (w, "meute", 30, 2.0, 5.0)]
    f = spark.createDataFrame(rows, "semaine date, terme string, n_docs bigint, attendu double, score double")
    assert {r["terme"] for r in topics.without_redundant(f).collect()} == {"eau potable", "meute", "meute loup"}


def test_statistics(spark):
    exact = sum(math.comb(20, j) * 0.3**j * 0.7 ** (20 - j) for j in range(9, 21))
    assert math.isclose(stats.tail(9, 20, 0.3), exact, rel_tol=1e-10)
    assert stats.tail(0, 20, 0.3) == 1.0 and stats.tail(21, 20, 0.3) == 0.0
    assert math.isclose(stats.incomplete_beta(2, 3, 0.5), 0.6875, rel_tol=1e-12)
    r = spark.createDataFrame([(0.0, 10.0), (10.0, 10.0), (5.0, 0.0), (None, 3.0)], "k double, n double").select(stats.jeffreys("k", "n").alias("i")).select("i.*").collect()
    assert 0 < r[0]["bas"] < r[0]["haut"] < 0.3 and r[1]["bas"] > 0.7 and r[2]["bas"] is None and r[3]["haut"] is None


def toy_model(n=60, m=80, seed=1):
    rng = np.random.default_rng(seed)
    x, b, a = rng.normal(size=n), rng.normal(0, 1.5, m), rng.normal(size=m)
    y = (rng.random((n, m)) < 1 / (1 + np.exp(-(np.outer(x, b) - a)))).astype(float)
    return x, y


def test_ideal_points_recover_the_truth():
    x, y = toy_model()
    f = ideal.estimate(y, np.ones_like(y), anchor=x < 0)
    assert np.corrcoef(f.x[:, 0], x)[0, 1] > 0.9 and f.x[x < 0].mean() < 0
    assert abs(f.x.mean()) < 1e-6 and abs(f.x.std() - 1) < 1e-6
    few = ideal.estimate(y, np.ones_like(y), ideal.Options(iterations=5))
    assert f.metrics["loglik"] > few.metrics["loglik"] * 1.05
    tight = ideal.estimate(y, np.ones_like(y), ideal.Options(ridge_b=8.0))
    assert tight.metrics["max_b"] < f.metrics["max_b"]
    held = ideal.estimate(y, np.ones_like(y), ideal.Options(held_out=0.2)).metrics
    assert held["apre_test"] <= held["apre"] + 0.05
    with pytest.raises(ValueError):
        ideal.estimate(y[:, :1], np.ones((60, 1)))


def test_two_axes_probabilities_and_weights(spark):
    rng = np.random.default_rng(4)
    x, b = rng.normal(size=(70, 2)) * [2.0, 1.0], rng.normal(size=(90, 2))
    y = (rng.random((70, 90)) < 1 / (1 + np.exp(-(x @ b.T)))).astype(float)
    f = ideal.estimate(y, np.ones_like(y), ideal.Options(dims=2))
    assert np.allclose(f.x.mean(0), 0, atol=1e-6) and np.allclose(np.cov(f.x.T, bias=True), np.eye(2), atol=1e-6)
    both = np.linalg.lstsq(np.column_stack([f.x, np.ones(70)]), x, rcond=None)[0]
    assert np.corrcoef((np.column_stack([f.x, np.ones(70)]) @ both)[:, 0], x[:, 0])[0, 1] > 0.9
    times = np.where(np.arange(90) % 3 == 0, 2.0, 1.0)
    twice = np.repeat(np.arange(90), times.astype(int))
    one, two = ideal.estimate(y, np.ones_like(y), ideal.Options(iterations=300, tolerance=1e-9), weight=times), ideal.estimate(y[:, twice], np.ones((70, len(twice))), ideal.Options(iterations=300, tolerance=1e-9))
    assert abs(np.corrcoef(one.x[:, 0], two.x[:, 0])[0, 1]) > 0.999
    rows = [("u", f"m{i:02}", f"s{j:02}", int(v)) for i, r in enumerate(y) for j, v in enumerate(r)]
    df = spark.createDataFrame(rows, "unite string, acteur_uid string, scrutin_uid string, y int")
    fitted = ideal.positions(df, "unite", ideal.Options(dims=2))
    p = {(r["acteur_uid"], r["scrutin_uid"]): r["p"] for r in ideal.predicted(df, fitted).collect()}
    assert np.allclose([[p[f"m{i:02}", f"s{j:02}"] for j in range(90)] for i in range(70)], f.probabilities(), atol=1e-6)
    power = {r["scrutin_uid"]: r["pouvoir"] for r in ideal.separating_power(fitted).collect()}
    assert np.allclose([power[f"s{j:02}"] for j in range(90)], np.linalg.norm(f.b, axis=1), atol=1e-6)


def test_the_search_finds_a_minimum():
    a = np.diag([1.0, 10.0, 100.0])
    at, value, _ = ideal.minimise(lambda t: (0.5 * t @ a @ t - t.sum(), a @ t - 1), np.array([5.0, -3.0, 2.0]), 100, 0.0)
    assert np.allclose(at, [1.0, 0.1, 0.01], atol=1e-4) and abs(value + 0.555) < 1e-6


def test_quality_bounds():
    y = np.array([[1.0, 0.0], [1.0, 1.0], [0.0, 0.0]])
    assert ideal.quality(y, np.ones_like(y), y)[1] == 1.0
    assert ideal.quality(y, np.ones_like(y), np.array([[1.0, 0.0]] * 3))[1] == 0.0


def test_bootstrap_in_spark(spark):
    _, y = toy_model(40, 40)
    rows = [(f"m{i:02}", f"s{j:02}", int(v)) for i, r in enumerate(y) for j, v in enumerate(r)]
    b = spark.createDataFrame(rows, "acteur_uid string, scrutin_uid string, y int")
    e = spark.createDataFrame([(f"s{j:02}", None if j == 3 else "d", f"se{j // 4}", None) for j in range(40)], "scrutin_uid string, dossier_uid string, seance_uid string, jour string")
    assert ideal.blocks(e) == "seance_uid"
    got = ideal.bootstrap(b, e, 6, o=ideal.Options(iterations=15)).collect()
    assert len(got) == 40 and all(r["bas"] <= r["haut"] and r["n_tirages"] == 6 and r["n_votes"] == 40 for r in got)


def test_draws_side_by_side_are_placed_as_each_alone():
    _, y = toy_model(40, 50)
    mask = (np.random.default_rng(3).random(y.shape) < 0.6).astype(float)
    mask[7, 10:] = 0.0  # a member of few events, which some draws leave out
    y, anchor = y * mask, np.arange(40) < 5
    draws = [np.bincount(np.random.default_rng(r).integers(0, 50, 50), minlength=50).astype(float) for r in range(12)] + [np.eye(50)[0]]
    got = ideal.drawn_places(y, mask, draws, ideal.Options(), anchor)
    assert got[-1] is None
    for w, (members, x) in zip(draws[:-1], got[:-1]):
        cols = np.flatnonzero(w)
        held = np.flatnonzero(mask[:, cols].any(1))
        one = ideal.estimate(y[np.ix_(held, cols)], mask[np.ix_(held, cols)], ideal.Options(), anchor[held], w[cols])
        assert list(members) == list(held) and np.allclose(x, one.x, atol=1e-8)


def test_misfit_of_steep_values():
    v = np.array([[-800.0, -1.0, 0.0, 2.0, 800.0]])
    for part in (slice(None), slice(0, 4)):
        value, p = ideal.misfit(v[:, part].copy(), np.ones_like(v[:, part]))
        assert math.isclose(value, np.logaddexp(0.0, v[:, part]).sum()) and np.allclose(p, ideal.logistic(v[:, part]))


def test_ballots_of_a_small_unit_travel_once(spark):
    got = spark.createDataFrame([(1,), (5_000,), (60_000,), (10**9,)], "n bigint").select("n", ideal.parts(F.col("n"), 61).alias("k")).collect()
    assert {r["n"]: r["k"] for r in got} == {1: 1, 5_000: 1, 60_000: 2, 10**9: 5}
    for n in (1, 2, 5):
        made = [r for k in range(n) for r in ideal._part(pd.DataFrame({"__part": [k], "__parts": [n]}), 61)]
        assert made == list(range(61))


def test_nearest_in_one_pass_are_the_neighbours(spark):
    rng = random.Random(5)
    names = [f"m{i:02}" for i in range(30)]
    people = spark.createDataFrame([(m, rng.choice(["G1", "G2", "G3", None])) for m in names], "acteur_uid string, groupe string")
    cast = [(f"s{j}", m, rng.choice(["pour", "contre", "abstention"])) for j in range(9) for m in rng.sample(names, 22)] + [("s0", "unknown", "pour")]
    cast = spark.createDataFrame(cast, "scrutin_uid string, acteur_uid string, position string")
    numbers = agreement.member_numbers(people)
    got = {r["a"]: r for r in agreement.nearest(agreement.numbered_counts(cast, numbers, 2), numbers, 4, 3).collect()}
    pairs = agreement.pair_counts(cast.where("acteur_uid <> 'unknown'"))
    for name, how in {"proches": {}, "hors_groupe": {"outside": True}, "opposes": {"inverse": True}}.items():
        wanted = {}
        for r in agreement.neighbours(pairs, people, 4, 3, **how).orderBy("a", "rang").collect():
            wanted.setdefault(r["a"], []).append((r["rang"], r["b"], r["taux"], r["communs"]))
        assert {a: [tuple(x) for x in r[name]] for a, r in got.items() if r[name]} == wanted


def test_without_k_all_who_were_measured_are_near_and_far(spark):
    rng = random.Random(6)
    names = [f"m{i:02}" for i in range(25)]
    people = spark.createDataFrame([(m, rng.choice(["G1", "G2", None])) for m in names], "acteur_uid string, groupe string")
    cast = spark.createDataFrame([(f"s{j}", m, rng.choice(["pour", "contre", "abstention"])) for j in range(8) for m in rng.sample(names, 18)], "scrutin_uid string, acteur_uid string, position string")
    numbers = agreement.member_numbers(people)
    got = {r["a"]: r for r in agreement.nearest(agreement.numbered_counts(cast, numbers, 2), numbers, None, 3).collect()}
    pairs = agreement.pair_counts(cast)
    for name, how in {"proches": {}, "hors_groupe": {"outside": True}, "opposes": {"inverse": True}}.items():
        wanted = {}
        for r in agreement.neighbours(pairs, people, len(names), 3, **how).orderBy("a", "rang").collect():
            wanted.setdefault(r["a"], []).append((r["rang"], r["b"], r["taux"], r["communs"]))
        assert max(len(x) for x in wanted.values()) > 8
        assert {a: [tuple(x) for x in r[name]] for a, r in got.items() if r[name]} == wanted


def test_co_signers_of_amendments_with_any_number_of_signers(spark):
    people = [f"P{i:02}" for i in range(14)]
    signed = {"few": people[:3], "few2": [people[0], people[1], people[1]], "ten": people[:10], "eleven": people[:11], "all": people, "alone": [people[5]], "stranger": [people[6], "X"]}
    members = spark.createDataFrame([(p,) for p in people], "acteur_uid string")
    a = spark.createDataFrame([(k, v[0], v[1:]) for k, v in signed.items()], "amendement_uid string, auteur_uid string, cosignataires array<string>")
    known = {k: set(v) & set(people) for k, v in signed.items()}
    known = [v for v in known.values() if len(v) > 1]

    def shared(x, y, most):
        both = [v for v in known if len(v) <= most and x in v and y in v]
        either = [v for v in known if len(v) <= most and (x in v or y in v)]
        return len(both) / len(either) if either else None, len(both)

    wanted = {}
    for x in people:
        others = [(y, *shared(x, y, 10), *shared(x, y, 99)) for y in people if y != x]
        others.sort(key=lambda o: (-(o[1] or 0), -o[3], o[0]))
        wanted[x] = [(i, *o) for i, o in enumerate(others, 1)]
    got = {r["acteur_uid"]: [tuple(x) for x in r["cosignataires"]] for r in amendments.co_signers(a, members).collect()}
    assert got == wanted and wanted["P11"][0][2:] == (None, 0, 1.0, 1)


def test_cards_hold_all_co_signers_and_all_counted_pairs(spark):
    a = Assembly(spark, "/root/testdata/sf0.001")
    cards = views.fiches(a).select("acteur_uid", *[F.coalesce(F.size(c), F.lit(0)).alias(c) for c in ("cosignataires", "proches", "opposes")]).collect()
    assert len(cards) == a.members.count()
    edges = amendments.network(amendments.signatures(a.amendments, a.members, None))[0]
    n = 2 * rollcall._pairs(a).count()
    assert max(r["proches"] for r in cards) > 8
    assert sum(r["proches"] for r in cards) == sum(r["opposes"] for r in cards) == n and sum(r["cosignataires"] for r in cards) == 2 * edges.count()


def test_a_written_table_leaves_no_shuffle(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        n = set()
        while files.hasNext():
            name = files.next().getName()
            if name.startswith("shuffle_"):
                n.add(name)
        return n

    before = shuffles()
    df = written(spark.range(1000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count(), "test")
    for _ in range(50):
        if not (left := shuffles() - before):
            break
        time.sleep(0.2)
    assert not left and df.count() == 7


def test_overlaps_and_bracketing(spark):
    i = spark.createDataFrame([("a", 0.0, 2.0), ("b", 1.0, 3.0), ("c", 2.0, 2.5), ("d", 9.0, 9.5), ("e", None, None)], "acteur_uid string, bas double, haut double")
    assert {r[0]: r[1] for r in ideal.overlaps(i).select("acteur_uid", "n_chevauchements").collect()} == {"a": 2, "b": 2, "c": 2, "d": 0}
    p = spark.createDataFrame([("x", 0.5), ("y", 1.0), ("z", 3.0)], "uid string, x double")
    g = spark.createDataFrame([("G1", 0.0), ("G2", 1.0), ("G3", 2.0)], "nom string, x double")
    assert {r["uid"]: (r["avant"], r["apres"]) for r in ideal.bracketing(p, g).collect()} == {"x": ("G1", "G2"), "y": ("G2", "G3"), "z": ("G3", None)}


def test_every_unit_has_intervals_overlaps_brackets_and_grid(spark):
    rows = [(u, f"{u}m{i:02}", f"{u}s{j:02}", int(v)) for u, n, k in (("U", 40, 30), ("V", 24, 20)) for i, r in enumerate(toy_model(n, k)[1]) for j, v in enumerate(r)]
    b = spark.createDataFrame(rows, "unite string, acteur_uid string, scrutin_uid string, y int")
    # one unit lacks a bill file, the other has them all: each has its own kind of block
    e = [(s, None if s == "Us03" else "d" + s[1:3], "x" + s[:3], None) for s in sorted({r[2] for r in rows})]
    e = spark.createDataFrame(e, "scrutin_uid string, dossier_uid string, seance_uid string, jour string")
    o = ideal.Options(iterations=10)
    got = {(r["unite"], r["acteur_uid"]): r for r in ideal.bootstrap(b, e, 20, o=o, unit="unite").collect()}
    assert len(got) == 64 and all(r["n_tirages"] == 20 and r["n_votes"] == {"U": 30, "V": 20}[u] for (u, _), r in got.items())
    for u in "UV":
        one = b.where(F.col("unite") == u).drop("unite")
        for r in ideal.bootstrap(one, e.where(F.col("scrutin_uid").startswith(u)), 20, o=o).collect():
            assert all(math.isclose(r[c], got[u, r["acteur_uid"]][c], abs_tol=1e-6) for c in ("position", "bas", "haut"))
    i = spark.createDataFrame([("U", "a", 0.0, 2.0), ("U", "b", 1.0, 3.0), ("V", "c", 0.0, 9.0), ("V", "d", 1.0, 2.0), ("V", "e", 3.0, 4.0)], "unite string, acteur_uid string, bas double, haut double")
    assert {r["acteur_uid"]: r["n_chevauchements"] for r in ideal.overlaps(i, "unite").collect()} == {"a": 1, "b": 1, "c": 2, "d": 1, "e": 1}
    p = spark.createDataFrame([("U", "x", 1.0), ("V", "x", 1.0)], "unite string, uid string, x double")
    g = spark.createDataFrame([("U", "G1", 0.0), ("V", "G2", 2.0)], "unite string, nom string, x double")
    assert {r["unite"]: (r["avant"], r["apres"]) for r in ideal.bracketing(p, g, "unite").collect()} == {"U": ("G1", None), "V": (None, "G2")}
    d = ideal.dimensionality(b, 2, 1, iterations=5, unit="unite").collect()
    assert {(r["unite"], r["dims"], r["gain"] is None) for r in d} == {(u, k, k == 1) for u in "UV" for k in (1, 2)}


def test_maps(spark, toy):
    u = toy.withColumn("unite", F.lit("u"))
    p = {r["acteur_uid"]: r["axe1"] for r in scaling.pca(u).collect()}
    assert math.isclose(p["A"], p["B"]) and p["A"] * p["C"] < 0
    m = {r["acteur_uid"]: r["axe1"] for r in scaling.mds(u, floor=3).collect()}
    assert math.isclose(m["A"], m["B"], abs_tol=1e-9) and m["A"] * m["C"] < 0
    assert scaling.units(toy).select("unite").distinct().count() == 1
    assert spark.createDataFrame([(0.5,), (None,), (1.2,)], "x double").select(scaling.quantised(F.col("x"))).collect()[0][0] == 127


def test_packed_matrices_and_order(spark):
    p = spark.createDataFrame([("a", "b", 3, 4), ("a", "c", 1, 70000), ("b", "z", 1, 2)], "a string, b string, accord bigint, communs bigint")
    x = spark.createDataFrame([("u", "a", 0.5), ("u", "b", -1.0), ("u", "c", 2.0), ("v", "z", 0.0)], "unite string, u string, x double")
    got = {r["unite"]: r for r in scaling.packed_matrices(p, x).collect()}
    u = got["u"]
    assert u["ordre"] == ["b", "a", "c"] and u["mesurables"] == 2 and (u["echelle_bas"], u["echelle_haut"]) == (0.0, 0.75)
    assert list(base64.b64decode(u["accord_b64"])) == [round(0.75 * 254), 255, 0] and list(np.frombuffer(base64.b64decode(u["communs_b64"]), "<u2")) == [4, 0, 65535]
    assert got["v"]["n"] == 1 and got["v"]["accord_b64"] == ""
    cells = [(a, b, 1.0 if a[0] == b[0] else 0.0) for a in ("l1", "r1", "l2", "r2") for b in ("l1", "r1", "l2", "r2")] + [("m", b, None) for b in ("l1", "r1", "l2", "r2", "m")] + [(a, "m", None) for a in ("l1", "r1", "l2", "r2")]
    order = [r["a"] for r in scaling.seriated(spark.createDataFrame(cells, "a string, b string, v double"), "a", "b", "v").orderBy("rang").collect() if r["a"] != "m"]
    assert {order[0][0], order[1][0]} in ({"l"}, {"r"}) and len(order) == 4


def test_invariants(spark):
    t = spark.createDataFrame([("a", D(2024, 1, 1), D(2024, 2, 1)), ("a", D(2024, 1, 15), None), ("b", None, None), ("c", D(2024, 5, 1), D(2024, 4, 1))], "acteur_uid string, debut date, fin date")
    assert {(r["cle"], r["message"]) for r in alerts.bad_terms(t).collect()} == {("a", "chevauchement"), ("b", "sans début"), ("c", "vide")}
    e = spark.createDataFrame([("s1", D(2024, 1, 20)), ("s2", D(2024, 3, 1))], "scrutin_uid string, jour date")
    ok = t.where("acteur_uid = 'a'")
    assert [r["cle"] for r in alerts.headcounts(ok, e, 1).collect()] == ["s1"]
    m = spark.createDataFrame([("a", "D", "1"), ("z", "D", "1")], "acteur_uid string, departement string, num_circo string")
    two = spark.createDataFrame([("a", D(2024, 1, 1), D(2024, 2, 1)), ("z", D(2024, 2, 1), None)], "acteur_uid string, debut date, fin date")
    assert [r["message"] for r in alerts.shared_seats(two, m).collect()] == ["a z"]
    v = alerts.verify([alerts.bad_terms(t)])
    with pytest.raises(alerts.InvalidData, match="mandats: 3"):
        alerts.require(v)
    alerts.require(v.where("false"))


def test_every_pair_of_a_shared_seat(spark):
    day = lambda k: D(2023, 6, 1) + dt.timedelta(k)
    terms = [("a", 1, 400), ("b", 50, 90), ("c", 60, 70), ("d", 300, None), ("d", 2, 3), ("e", 500, None), ("f", 71, 71), ("g", 401, 499), ("x", 1, None)]
    p = spark.createDataFrame([(m, day(s), None if e is None else day(e)) for m, s, e in terms], "acteur_uid string, debut date, fin date")
    m = spark.createDataFrame([(u, "D", "2" if u == "x" else "1") for u in "abcdefgx"], "acteur_uid string, departement string, num_circo string")
    end = lambda e: 10**6 if e is None else e
    brute = {f"{x} {y}" for x, s, e in terms for y, t, f in terms if x < y and "x" not in (x, y) and s <= end(f) and t <= end(e)}
    got = [r["message"] for r in alerts.shared_seats(p, m).collect()]
    assert sorted(got) == sorted(brute) and "b c" in got
    days = (80, 450)
    e = spark.createDataFrame([(f"s{k}", day(k)) for k in days] + [("s0", None)], "scrutin_uid string, jour date")
    at = {f"{x} {y}" for x, s, e_ in terms for y, t, f in terms for k in days if x < y and "x" not in (x, y) and max(s, t) <= k <= min(end(e_), end(f))}
    assert {r["message"] for r in alerts.shared_seats(p, m, e).collect()} == at
    assert alerts.shared_seats(p, m, e.where("jour IS NULL")).count() == 0


def test_statements_are_read_whole(spark):
    e = spark.createDataFrame([("s1", D(2024, 1, 1), "digues")], "scrutin_uid string, jour date, titre string")
    m = spark.createDataFrame([("a1", D(2024, 1, 1), "<p>" + "eau " * 300 + "digues</p>", "Article 3 plage")], "amendement_uid string, jour date, expose_sommaire string, division_titre string")
    f = topics.week_frequencies(rollcall._corpus(SimpleNamespace(events=e, amendments=m, has=lambda t: True)), "id", "jour", "t")
    assert {r["terme"]: (r["n"], r["n_docs"]) for r in f.where(F.col("terme").isin("digues", "eau", "plage")).collect()} == {"digues": (2, 2), "eau": (300, 1), "plage": (1, 1)}
    only = SimpleNamespace(events=e, amendments=m, has=lambda t: False)
    assert rollcall._corpus(only).count() == 1
    with pytest.raises(ValueError):
        rollcall._corpus(only, "amendements")


def test_alerts_rank_distinct_surges_below_the_rate(spark, monkeypatch):
    rows = [("eau potable", 20, 9.0, 0.01), ("eau", 21, 8.0, 0.01), ("potable", 20, 7.0, 0.01), ("loup", 12, 3.0, 0.04), ("vent", 11, 2.0, 0.1)]
    found = spark.createDataFrame([(D(2024, 1, 1), t, n, float(n) / 10, s, q) for t, n, s, q in rows], "semaine date, terme string, n_docs int, attendu double, score double, q double")
    monkeypatch.setattr(rollcall, "_surges", lambda a: found)
    none = spark.createDataFrame([], "semaine date, categorie string, cle string, detail string, intensite double")
    for name in ("close", "fractures", "split_groups", "ruptures", "activity"):
        monkeypatch.setattr(alerts, name, lambda *_: none)
    monkeypatch.setattr(lines, "against_line", lambda *_: None)
    a = SimpleNamespace(events=None, lines=None, expressed=None)
    assert {r["cle"]: r["rang"] for r in rollcall.alertes(a).collect()} == {"eau potable": 1, "loup": 2}


def test_activity_counts_empty_weeks(spark):
    days = [D(2024, 1, 1) + dt.timedelta(7 * k) for k in range(8) for _ in range(4)] + [D(2024, 2, 26)] * 20
    e = spark.createDataFrame([(f"s{i}", d) for i, d in enumerate(days)], "scrutin_uid string, jour date")
    got = alerts.activity(e).collect()
    assert {r["semaine"] for r in got} >= {D(2024, 2, 26)}


def test_sample_check_counts_only_the_groups_asked_for(spark, monkeypatch):
    rng = random.Random(12)
    group = {f"m{i}": "ABC"[i % 3] for i in range(18)} | {"m18": None}
    votes = [(f"s{s}", m, rng.choice(["pour", "contre", "abstention"])) for s in range(30) for m in [*group, "unknown"] if rng.random() < 0.8]
    x = spark.createDataFrame([*votes, ("nowhere", "m0", "pour"), ("nowhere", "m3", "pour")], "scrutin_uid string, acteur_uid string, position string")
    events = spark.createDataFrame([(f"s{s}", "intermediaire" if s % 2 else "detail") for s in range(30)], "scrutin_uid string, portee string")
    members = spark.createDataFrame(list(group.items()), "acteur_uid string, groupe string")
    sizes, count = [], agreement.counted_pairs
    monkeypatch.setattr(agreement, "counted_pairs", lambda rows, *a, **k: sizes.append(rows.count()) or count(rows, *a, **k))
    got = {(r["groupe_a"], r["groupe_b"]): r["observe"] for r in agreement.sample_size_check(x, events, [("A", "A"), ("A", "B"), ("A", "A")], members, "intermediaire", 15, draws=5, floor=3).collect()}
    cast = {(s, m): p for s, m, p in votes if int(s[1:]) % 2}
    def mean(a, b):
        rates = []
        for u, v in [(u, v) for u in group for v in group if u < v and {group[u], group[v]} == {a, b}]:
            both = [cast[s, u] == cast[s, v] for s in {s for s, _ in cast} if (s, u) in cast and (s, v) in cast]
            rates += [sum(both) / len(both)] if len(both) >= 3 else []
        return sum(rates) / len(rates)
    assert {k: round(v, 9) for k, v in got.items()} == {("A", "A"): round(mean("A", "A"), 9), ("A", "B"): round(mean("A", "B"), 9)}
    assert sizes == [sum(2 if group.get(m) == "A" else group.get(m) == "B" for _, m, _ in [*votes, ("", "m0", ""), ("", "m3", "")])]


def test_meetings_on_a_seat_against_brute_force(monkeypatch):
    rng = random.Random(4)
    for case in range(60):
        monkeypatch.setattr(alerts, "BITS_AT_ONCE", 16 if case % 2 else 4096)
        spans = [(f"m{rng.randrange(40)}" + (" x" if case % 5 == 0 else ""), s, s + rng.randrange(-1, 12)) for s in (rng.randrange(120 if case % 3 else 2000) for _ in range(rng.randrange(1, 90)))]
        who, start, end = (np.array(x) for x in zip(*spans))
        want = sorted({f"{a} {b}" for a, s, e in spans for b, t, f in spans if a < b and s <= e and t <= f and s <= f and t <= e})
        assert alerts._meetings(who.astype(object), start, end) == (len(want), want[:8]), case
