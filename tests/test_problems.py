"""The general problems: small cases by hand, brute force, and every kind of untidy input."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from ballotlake.functions.expr import day, key, position
from ballotlake.operators.asof import known_spans, with_known_value
from ballotlake.operators.intervals import OPEN, merge_intervals
from ballotlake.operators.orphans import orphan_references, orphans_by_period, parent_registry
from ballotlake.operators.variants import Automaton, classify, deep_loads, links, typed

D = dt.date
T = dt.datetime


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


def test_days_in_every_notation(spark):
    texts = ["2024-03-05", "05/03/2024", "20240305", "2024-03-05T10:00:00.000+01:00", " 2024-03-05\xa0", "5.3.2024", "2024/3/5", "5-3-2024 12:00"]
    df = spark.createDataFrame([(t,) for t in [*texts, "2024-02-30", "31/02/2024", "", " ", None, "hier"]], "t string")
    got = [r[0] for r in df.select(day("t")).collect()]
    assert got[: len(texts)] == [D(2024, 3, 5)] * len(texts)
    assert got[len(texts) :] == [None] * 6


def test_keys_and_positions(spark):
    df = spark.createDataFrame([("\tpa1\xa0",), ("PA1 ",), ("　Pa1",), ("",), (" \xa0",), (None,), ("é1",)], "k string")
    assert [r[0] for r in df.select(key("k")).collect()] == ["PA1", "PA1", "PA1", None, None, None, "É1"]
    df = spark.createDataFrame([(" Pour",), ("NONVOTANT",), ("abstention\xa0",), ("oui",), (None,)], "p string")
    assert [r[0] for r in df.select(position("p")).collect()] == ["pour", "nonVotant", "abstention", None, None]


# --- 1


@pytest.fixture
def registry(spark):
    parents = spark.createDataFrame([("A", "1", T(2020, 1, 2)), ("A", "1", T(2020, 1, 5)), ("B", "2", None), ("C", "3", T(2020, 1, 1))], "x string, y string, vu timestamp")
    gone = spark.createDataFrame([("C", "3", T(2020, 2, 1)), ("Z", "9", T(2020, 2, 1))], "x string, y string, le timestamp")
    return parent_registry(parents, ["x", "y"], "vu", gone, "le")


def refs(spark, data):
    return spark.createDataFrame(data, "n int, x string, y string, at timestamp, first_seen string, removed_at string")


def case(n, x, y, at):
    return (n, x, y, at, "extra", "extra")


def test_orphans_by_time_and_mask(spark, registry):
    data = [
        case(1, "A", "1", T(2020, 1, 2)), case(2, "A", "1", T(2020, 1, 1)), case(3, "A", "2", T(2020, 1, 3)), case(4, "C", "3", T(2020, 1, 31)), case(5, "C", "3", T(2020, 2, 1)),
        case(6, "A", None, T(2020, 1, 3)), case(7, None, "9", T(2020, 1, 3)), case(8, None, None, T(2020, 1, 3)), case(9, "A", "1", None), case(10, "Q", "1", None), case(11, "B", "2", T(1990, 1, 1)),
        case(3, "A", "2", T(2020, 1, 3)),
    ]
    r = refs(spark, data)
    found = lambda m: sorted(x["n"] for x in orphan_references(r, registry, ["x", "y"], "at", m).collect())
    assert found("simple") == [2, 3, 3, 5, 10]
    assert found("partial") == [2, 3, 3, 5, 7, 10]
    assert found("full") == [2, 3, 3, 5, 6, 7, 10]
    assert orphan_references(r, registry, ["x", "y"], "at").columns == r.columns
    with pytest.raises(ValueError):
        orphan_references(r, registry, ["x", "y"], "at", "some")


def test_orphans_of_empty_tables(spark, registry):
    none = refs(spark, [])
    assert orphan_references(none, registry, ["x", "y"], "at").count() == 0
    nobody = parent_registry(spark.createDataFrame([], "x string, y string, vu timestamp"), ["x", "y"], "vu", None, "le")
    one = refs(spark, [case(1, "A", "1", T(2020, 1, 2))])
    assert orphan_references(one, nobody, ["x", "y"], "at", "partial").count() == 1
    assert rows(orphans_by_period(one.unionByName(one), "x", "at", ["x", "y"])) == [("A", D(2020, 1, 1), 2, 1)]


def test_each_mask_is_joined_on_its_own_column(spark):
    """References of several kinds as parts of one key: the null mask tells them apart, and masks that cannot occur cost no join."""
    none = F.lit(None).cast("string")
    kinds = [spark.createDataFrame([(k, T(2020, 1, 5)) for k in v], "k string, at timestamp").select((F.col("k") if c == "x" else none).alias("x"), (F.col("k") if c == "y" else none).alias("y"), "at") for c, v in (("x", ["1", "2", None]), ("y", ["1", "3"]))]
    parents = spark.createDataFrame([("1", None, T(2020, 1, 1)), (None, "3", T(2020, 1, 1)), (None, "1", T(2020, 1, 9))], "x string, y string, at timestamp")
    gone = spark.createDataFrame([(None, "3", T(2020, 1, 2))], "x string, y string, le timestamp")
    reg = parent_registry(parents, ["x", "y"], "at", gone, "le")
    out = orphan_references(kinds[0].unionByName(kinds[1]), reg, ["x", "y"], "at", "partial")
    assert rows(out, "x", "y") == sorted([("2", None), (None, "1"), (None, "3")], key=repr)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 2


# --- 3


def brute_merge(items):
    covered = set()
    for s, e in items:
        covered.update(range(s, e + 1))
    out, last = [], None
    for d in sorted(covered):
        if last is not None and d == last[1] + 1:
            last[1] = d
        else:
            last = [d, d]
            out.append(last)
    return [tuple(x) for x in out]


@pytest.mark.parametrize("width", [7, 30, 1461])
def test_merge_against_brute_force(spark, width):
    rng = random.Random(width)
    data = {e: [(s, s + rng.randrange(0, 40)) for s in (rng.randrange(18000, 18600) for _ in range(rng.randrange(1, 25)))] for e in "abcdefgh"}
    day0 = D(1970, 1, 1)
    flat = [(e, day0 + dt.timedelta(s), day0 + dt.timedelta(f), 1) for e, x in data.items() for s, f in x]
    df = spark.createDataFrame(flat + flat[:5], "who string, d date, f date, shard int")
    got = merge_intervals(df, "who", "d", "f", shard_days=width, origin=18100, horizon=18500).collect()
    for e, x in data.items():
        expected = brute_merge(x)
        assert sorted((r["debut"], r["fin"]) for r in got if r["who"] == e and r["genre"] == "periode") == expected
        holes = [(a[1] + 1, b[0] - 1) for a, b in zip(expected, expected[1:])]
        assert sorted((r["debut"], r["fin"]) for r in got if r["who"] == e and r["genre"] == "trou") == holes


def test_merge_open_empty_null(spark):
    df = spark.createDataFrame(
        [("a", D(2020, 1, 1), D(2020, 1, 31)), ("a", D(2020, 2, 1), None), ("a", D(2019, 1, 5), D(2019, 1, 1)), ("a", None, D(2020, 1, 1)), (None, D(2020, 1, 1), None), ("b", D(9999, 12, 31), None), ("b", D(2020, 1, 1), D(2020, 1, 1))],
        "who string, d date, f date",
    )
    got = rows(merge_intervals(df, "who", "d", "f"), "who", "genre", "debut", "fin")
    d = lambda x: (x - D(1970, 1, 1)).days
    assert got == sorted([("a", "periode", d(D(2020, 1, 1)), OPEN), ("b", "periode", d(D(2020, 1, 1)), d(D(2020, 1, 1))), ("b", "periode", OPEN, OPEN), ("b", "trou", d(D(2020, 1, 2)), OPEN - 1)], key=repr)
    assert merge_intervals(df.where("false"), "who", "d", "f").count() == 0


def test_a_hot_entity_is_bounded_by_days(spark):
    df = spark.range(200000).select(F.lit("x").alias("who"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 700).cast("int")).alias("d"))
    got = merge_intervals(df.withColumn("f", F.col("d")), "who", "d", "f").collect()
    assert [(r["genre"], r["fin"] - r["debut"]) for r in got] == [("periode", 699)]


# --- 4

NIL = {"@xmlns:xsi": "u", "@xsi:nil": "true"}


def vote(uid, groups, **more):
    return {"scrutin": {"uid": uid, "syntheseVote": {"nombreVotants": 3, "suffragesExprimes": {"#text": "2"}, "nbrSuffragesRequis": NIL, "decompte": {"@x": "y", "pour": "2", "contre": None}}, "ventilationVotes": {"organe": {"organeRef": "PO0", "groupes": {"groupe": groups}}}, **more}}


def group(ref, label, **lists):
    return {"organeRef": ref, "vote": {"positionMajoritaire": label, "decompteNominatif": lists or None}}


def test_variants_flatten_with_links(spark):
    whole = json.dumps(vote(" vt1 ", [group("po1", {"#text": "pour"}, pours={"votant": {"acteurRef": "pa1"}}, contres={"votant": [{"acteurRef": {"#text": "pa2"}}, {"acteurRef": NIL}]}), group("PO2", "", abstentions=None), {"organeRef": "PO3", "vote": None}]))
    organ = json.dumps({"@t": "x", "uid": {"#text": "PO9"}, "codeType": {"@xmlns": "u", "#text": "GP"}, "secretariat": {"codeType": "INTERNE"}})
    amendment = json.dumps({"amendement": {"uid": "AM1", "signataires": {"auteur": [{"acteurRef": "PA1", "auteurRapporteurOrganeRef": "po5"}, {"acteurRef": "PA2", "auteurRapporteurOrganeRef": NIL}], "cosignataires": {"acteurRef": ["PA3"]}}}})
    data = [(1, whole), (2, whole), (3, organ), (4, amendment), (5, whole[:-20]), (6, ""), (7, None), (8, "[]"), (9, "12"), (10, '{"uid": null}')]
    df = spark.createDataFrame([(i, c, "z") for i, c in data], "brut_id int, contenu string, uid string")
    nodes = classify(df, "brut_id", "contenu")
    got = set(rows(links(nodes), "genre", "parent", "enfant", "valeur"))
    assert got == {
        ("synthese", "VT1", "nombreVotants", "3"), ("synthese", "VT1", "suffragesExprimes", "2"), ("synthese", "VT1", "pour", "2"), ("groupe", "VT1", "PO1", "pour"),
        ("votant", "VT1", "PA1", "pours"), ("votant", "VT1", "PA2", "contres"), ("organe", "PO9", "codeType", "GP"), ("rapporteur", "AM1", "PA1", "PO5"),
    }
    g = typed(nodes.where("record = '1'"), "groupe").collect()
    v = typed(nodes.where("record = '1'"), "votant").collect()
    assert {x["noeud_parent"] for x in v} == {x["noeud"] for x in g if x["organe_ref"] == "po1"}
    counts = {c["champ"]: c["nombre"] for r in typed(nodes.where("record = '1'"), "synthese").collect() for c in r["comptes"]}
    assert counts == {"nombreVotants": 3, "suffragesExprimes": 2, "pour": 2}
    assert {r["par_delegation"] for r in v} == {None}
    assert links(classify(df.where("false"), "brut_id", "contenu")).count() == 0


def test_deep_records_are_read_whole(spark):
    deep = 5000
    inner = json.dumps(vote("VT7", [group("PO1", "pour", pours={"votant": {"acteurRef": "PA1", "parDelegation": "true"}})]))
    texts = ['{"a": [' * deep + inner + "]}" * deep, '{"a": [' * deep + inner + "]}" * (deep - 1), '{"scrutin": ' + inner[:-1] + ', "x": ' + "[" * deep + "]" * deep + "}}"]
    nodes = classify(spark.createDataFrame(list(enumerate(texts)), "b int, c string"), "b", "c")
    assert {(r["record"], r["acteur_ref"], r["par_delegation"]) for r in typed(nodes, "votant").collect()} == {("0", "PA1", True), ("2", "PA1", True)}


def test_the_deep_reader_agrees_with_json():
    good = ['{"a": [1, -2.5e3, "x\\n\\u00e9", true, null, {}], "b": {"c": []}, "b": 2}', " [ ] ", '"t"', "12", "[[],[{}]]", "[NaN]"]
    for t in good:
        assert repr(deep_loads(t)) == repr(json.loads(t))
    for t in ("", "{", "[1,]", '{"a"}', '{"a":1,}', "[1] 2", '"open', "tru", "{1:2}", "[1 2]", '{"a":}'):
        with pytest.raises(ValueError):
            deep_loads(t)


def test_shapes_count_not_names(spark):
    r = vote("VT8", [group("PO1", "pour", pours={"votant": {"acteurRef": "PA1"}}, contres={"membre": [{"acteurRef": "PA2"}]})])["scrutin"]
    renamed = {"uid": "VT8", "bilan": r["syntheseVote"], "detail": {"instance": {"x": {"y": r["ventilationVotes"]["organe"]["groupes"]["groupe"]}}}}
    wrong = {"uid": "VT9", "syntheseVote": {"pour": "9"}, "ventilationVotes": {"groupe": {"acteurRef": "PA3"}}}
    am = {"uid": "AM8", "signataires": {"premier": {"acteurRef": "PA4", "auteurRapporteurOrganeRef": "PO4"}, "cosignataires": {"acteurRef": "PA5"}}}
    data = [(i, json.dumps(x)) for i, x in enumerate((renamed, wrong, am))]
    nodes = classify(spark.createDataFrame(data, "b int, c string"), "b", "c")
    got = set(rows(links(nodes), "genre", "parent", "enfant", "valeur"))
    assert got == {
        ("synthese", "VT8", "nombreVotants", "3"), ("synthese", "VT8", "suffragesExprimes", "2"), ("synthese", "VT8", "pour", "2"), ("groupe", "VT8", "PO1", "pour"),
        ("votant", "VT8", "PA1", "pours"), ("votant", "VT8", "PA2", "contres"), ("rapporteur", "AM8", "PA4", "PO4"),
    }
    assert typed(nodes, "auteur").count() == 1


def test_a_long_record_and_shapes(spark):
    big = json.dumps(vote("VT2", [group(f"PO{i}", "pour", pours={"votant": [{"acteurRef": f"PA{i}_{j}"} for j in range(200)]}) for i in range(50)]))
    out = links(classify(spark.createDataFrame([(1, big)], "b int, c string"), "b", "c"))
    assert out.where("genre = 'votant'").count() == 10000
    a = Automaton()
    assert a.rows({"uid": "x", "codeType": "GP"})[0] == a.rows({"codeType": "Q", "uid": "y"})[0] != a.rows({"uid": "x"})[0]


# --- 5


def test_known_value_against_brute_force(spark):
    rng = random.Random(5)
    day0 = D(2024, 1, 1)
    on = lambda k: day0 + dt.timedelta(k)
    versions, n = [], 0
    for m in range(40):
        for _ in range(rng.randrange(1, 4)):
            n += 1
            s = rng.randrange(0, 60)
            versions.append((f"M{m}", f"A{m % 9}", f"G{rng.randrange(4)}", on(s) if rng.random() > 0.1 else None, on(s + rng.randrange(-3, 50)) if rng.random() > 0.3 else None, T(2024, 1, 1) + dt.timedelta(hours=rng.randrange(0, 24 * 70)), n))
    events = [(f"S{i}", f"A{rng.randrange(10)}" if rng.random() > 0.05 else None, on(rng.randrange(0, 90)) if rng.random() > 0.05 else None, "x") for i in range(400)]
    events += events[:3]
    v = spark.createDataFrame(versions, "mandat string, who string, grp string, d date, f date, recu timestamp, n int")
    e = spark.createDataFrame(events, "evt string, who string, jour date, value string")
    spans = known_spans(v, "mandat", "recu", "d", "f", ["n"])
    out = with_known_value(e, spans, "who", "jour", "grp", ["d", "recu", "mandat"], shard_days=10, origin=19730, horizon=19790)

    def expected(who, jour):
        if who is None or jour is None:
            return None
        last = {}
        for x in sorted((x for x in versions if x[5].date() <= jour), key=lambda x: (x[5], x[6])):
            last[x[0]] = x
        held = [x for x in last.values() if x[1] == who and x[3] and x[3] <= jour and (x[4] is None or x[4] >= jour)]
        return max(held, key=lambda x: (x[3], x[5], x[0]))[2] if held else None

    got = sorted(((r["evt"], r["who"], r["jour"], r["grp_connu"]) for r in out.collect()), key=repr)
    assert got == sorted(((i, w, j, expected(w, j)) for i, w, j, _ in events), key=repr)


def test_a_hot_entity_is_spread(spark):
    e = spark.range(4000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 200)).alias("who"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")).alias("jour"), "id")
    v = spark.createDataFrame([("M1", "hot", "G1", D(2024, 1, 10), D(2024, 1, 19), T(2024, 1, 1)), ("M2", "hot", "G2", D(2024, 1, 15), None, T(2024, 1, 1))], "mandat string, who string, grp string, d date, f date, recu timestamp")
    out = with_known_value(e, known_spans(v, "mandat", "recu", "d", "f", []), "who", "jour", "grp", ["d"], tasks=8)
    parts = {r["__part"]: r["n"] for r in out.where("who = 'hot'").groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(parts) > 8 and max(parts.values()) < 300
    first = D(2024, 1, 1)
    right = lambda k: None if k < 9 else "G1" if k < 14 else "G2"
    assert all(r["grp_connu"] == (right((r["jour"] - first).days) if r["who"] == "hot" else None) for r in out.collect()) and out.count() == 4000


def test_known_value_of_empty_inputs(spark):
    v = spark.createDataFrame([], "mandat string, who string, grp string, d date, f date, recu timestamp")
    spans = known_spans(v, "mandat", "recu", "d", "f", [])
    e = spark.createDataFrame([("S1", "A", D(2024, 1, 1)), ("S2", None, None)], "evt string, who string, jour date")
    assert rows(with_known_value(e, spans, "who", "jour", "grp", ["d"]), "evt", "grp_connu") == [("S1", None), ("S2", None)]
    assert with_known_value(e.where("false"), spans, "who", "jour", "grp", ["d"]).count() == 0
    assert with_known_value(e, spans, "who", "jour", "grp", ["d"], keep_unplaced=False).count() == 1
