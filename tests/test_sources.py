"""Catalog, raw files, ingest, downloads, marts and streams."""

import datetime as dt
import json
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import ballotlake
from ballotlake.operators import alerts
from ballotlake.sources import catalog, ingest
from ballotlake.streaming import weekly

NIL = {"@xsi:nil": "true"}


def test_catalog_and_schemas(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path))
    assert not c.has("votes") and c.optional("amendements") is None
    with pytest.raises(FileNotFoundError, match="build the tables"):
        c.load("votes")
    c.build_all({"votes": spark.createDataFrame([("s", "a")], "scrutin_uid string, acteur_uid string")})
    assert c.load("votes").schema == catalog.schema("votes") and c.load("votes").first()["position"] is None
    r = catalog.info({"votes": c.load("votes")}, {}).first()
    assert (r["n_lignes"], r["n_colonnes"], r["premier"]) == (1, 7, None)


def test_json_files_at_any_depth(spark, tmp_path):
    for path in ("a/x/DLR1/DLR2/one.json", "a/incorrect/two.json", "b/DLR3/q/r/three.json", "b/DLR3/no.txt"):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text('{\n "uid": 1\n}')
    rows = {r["chemin"].rpartition("/")[2]: r["dossier_uid"] for r in catalog.json_documents(spark, str(tmp_path)).collect()}
    assert rows == {"one.json": "DLR2", "two.json": None, "three.json": "DLR3"}
    assert catalog.json_documents(spark, str(tmp_path), part="a").count() == 2
    assert catalog.json_documents(spark, str(tmp_path), part="q").count() == 1 and catalog.json_documents(spark, str(tmp_path), part="none").count() == 0


def test_ingest_of_untidy_documents(spark):
    voter = {"acteurRef": {"#text": "pa1"}, "parDelegation": "true", "causePositionVote": NIL}
    s = {"uid": {"#text": "vt1"}, "numero": "12", "dateScrutin": "2024-05-06", "titre": NIL, "objet": {"libelle": "l'ensemble du projet", "dossierLegislatif": {"dossierRef": "DLR1"}}, "typeVote": {"codeTypeVote": "SPS"}}
    s |= {"syntheseVote": {"nombreVotants": "x", "decompte": {"pour": "3", "contre": {"#text": "1"}}}}
    s |= {"ventilationVotes": {"organe": {"groupes": {"groupe": [{"organeRef": "po1", "vote": {"positionMajoritaire": "pour", "decompteNominatif": {"pours": {"votant": voter}, "contres": None, "nonVotants": {"votant": [{"acteurRef": "PA2"}, NIL]}}}}]}}}}
    texts = [json.dumps({"scrutin": s}), json.dumps(s), json.dumps(s)[:-9], None, "", "[1]"]
    raw = spark.createDataFrame([(t,) for t in texts], "contenu string")
    e = ingest.events(raw).collect()
    assert len(e) == 1 and (e[0]["scrutin_uid"], e[0]["titre"], e[0]["nb_votants"], e[0]["n_contre"], e[0]["categorie"], e[0]["portee"], e[0]["dossier_uid"]) == ("VT1", "l'ensemble du projet", None, 1, "ensemble", "texte", "DLR1")
    assert e[0]["contestation"] == 0.25 and e[0]["date_d"] == dt.date(2024, 5, 6)
    b = {(r["acteur_uid"], r["position"], r["groupe_uid"], r["par_delegation"], r["cause"]) for r in ingest.ballots(raw).collect()}
    assert b == {("PA1", "pour", "PO1", True, None), ("PA2", "nonVotant", "PO1", False, None)}
    a = {"amendement": {"uid": "am1", "signataires": {"auteur": [{"acteurRef": "pa1", "auteurRapporteurOrganeRef": "PO2"}, {"acteurRef": "PA9"}], "cosignataires": {"acteurRef": ["PA3", NIL]}}, "corps": {"contenuAuteur": {"dispositif": "&lt;p&gt;R&#x00E9;diger&lt;/p&gt;"}}, "cycleDeVie": {"dateDepot": "2025-01-02T00:00:00.000+01:00"}}}
    r = ingest.amendments(spark.createDataFrame([(json.dumps(a), "x/DLR7/am1.json")], "contenu string, chemin string")).first()
    assert (r["amendement_uid"], r["auteur_uid"], r["auteur_rapporteur"], r["nb_cosignataires"], r["dispositif"], r["dossier_uid"], r["date_depot_d"]) == ("AM1", "PA1", True, 1, "Rédiger", "DLR7", dt.date(2025, 1, 2))
    assert ingest.bodies(raw.where("false")).count() == 0


def test_members_from_mandates(spark):
    m = [("a", "ASSEMBLEE", "X", "1", "2024-07-01", "2025-01-31", "2024-07-08", None, "01"), ("a", "ASSEMBLEE", "X", "2", "2025-02-01", None, None, None, None), ("b", "ASSEMBLEE", "X", "3", "2024-07-08", "2024-10-21", None, None, "02"), ("b", "ASSEMBLEE", "X", "4", "2025-11-06", None, None, None, "03"), ("a", "GP", "G1", "5", "2024-07-08", "2024-12-01", None, "Membre", None), ("a", "GP", "G2", "6", "2024-09-01", None, None, "Présidente", None), ("c", "GP", "G2", "7", "2024-09-01", None, None, "Membre", None)]
    df = spark.createDataFrame(m, "acteur_uid string, type_organe string, organe_uid string, mandat_uid string, date_debut string, date_fin string, date_prise_fonction string, qualite string, num_departement string")
    df = df.select("*", *[F.lit(None).cast("string").alias(c) for c in ("departement", "num_circo", "region", "legislature")])
    people = spark.createDataFrame([("a", "Ana", "Li"), ("b", None, "Bo")], "acteur_uid string, prenom string, nom string")
    groups = spark.createDataFrame([("G2", "Groupe deux", "GD", "Minoritaire")], "organe_uid string, libelle string, libelle_abrev string, position_politique string")
    got = {r["acteur_uid"]: r for r in ingest.members(df, people, groups).collect()}
    a, b = got["a"], got["b"]
    assert a["mandat_interrompu"] is False and a["periodes_mandat"][0]["debut"] == "2024-07-08" and a["groupe_uid"] == "G2" and a["nb_groupes_legislature"] == 2
    assert (a["groupe"], a["groupe_qualite"], a["nom_complet"], a["en_exercice"], a["num_departement"]) == ("GD", "Présidente", "Ana Li", True, "01")
    assert b["mandat_interrompu"] is True and [tuple(x) for x in b["interruptions"]] == [("2024-10-22", "2025-11-05")] and b["mandat_fin"] is None
    assert (b["nom_complet"], b["num_departement"], b["groupe"]) == (None, "03", None) and set(got) == {"a", "b"}


def test_all_tables_from_raw_documents(spark, tmp_path):
    seat = {"uid": "PM1", "typeOrgane": "ASSEMBLEE", "legislature": "17", "dateDebut": "2024-07-01", "dateFin": NIL, "mandature": {"datePriseFonction": "2024-07-08"}, "organes": {"organeRef": "PO1"}, "election": {"lieu": {"departement": "Ain", "numDepartement": "01", "numCirco": "2", "region": {"#text": "ARA"}}}}
    group = {"uid": "PM2", "typeOrgane": "GP", "legislature": "17", "dateDebut": "2024-07-10", "dateFin": None, "infosQualite": {"codeQualite": "Membre"}, "organes": {"organeRef": ["PO2", "PO2"]}}
    person = {"acteur": {"uid": {"#text": "pa1"}, "etatCivil": {"ident": {"civ": "Mme", "prenom": "Ana", "nom": "Li"}, "infoNaissance": {"dateNais": "1980-01-02"}, "dateDeces": NIL}, "profession": {"libelleCourant": "Juge", "socProcINSEE": {"catSocPro": "Cadres"}}, "uri_hatvp": NIL, "mandats": {"mandat": [seat, group]}}}
    body = {"organe": {"uid": "PO2", "codeType": "GP", "libelle": "Groupe deux", "libelleAbrev": "GD", "viMoDe": {"dateDebut": "2024-07-01"}}}
    event = {"scrutin": {"uid": "VT1", "numero": "7", "dateScrutin": "2024-09-01", "titre": "l'ensemble", "sort": {"code": "adopté", "libelle": "L'a"}, "demandeur": {"texte": "x"}, "seanceRef": "RU1", "syntheseVote": {"suffragesExprimes": "1", "decompte": {"pour": "1"}}, "ventilationVotes": {"organe": {"groupes": {"groupe": {"organeRef": "PO2", "vote": {"decompteNominatif": {"pours": {"votant": {"acteurRef": "PA1"}}}}}}}}}}
    am = {"amendement": {"uid": "AM1", "identification": {"numeroOrdreDepot": "12"}, "signataires": {"auteur": {"acteurRef": "PA1"}}, "cycleDeVie": {"sort": "Adopté", "dateSort": "2024-09-02"}, "pointeurFragmentTexte": {"division": {"titre": "Article 1", "articleDesignationCourte": "ART. 1"}}, "corps": {"contenuAuteur": {"exposeSommaire": "&lt;p&gt;Eau&lt;/p&gt;"}}}}
    later = json.loads(json.dumps(event))
    later["scrutin"]["titre"] = "l'article 2"
    rows = [("acteur", person, 1), ("organe", body, 1), ("scrutin", event, 1), ("scrutin", later, 2), ("amendement", am, 1)]
    raw = spark.createDataFrame([(f, json.dumps(d), "a/DLR9/x.json", dt.datetime(2024, 1, k)) for f, d, k in rows] + [("acteur", '{"acteur": {"uid"', "", None)], "famille string, contenu string, chemin string, recu_le timestamp")
    c = ingest.build_all(spark, raw, str(tmp_path), "17")
    d = c.load("deputes").first()
    assert (d["acteur_uid"], d["nom_complet"], d["groupe"], d["departement"], d["region"], d["en_exercice"], d["mandat_debut_d"], d["cat_socio_pro"]) == ("PA1", "Ana Li", "GD", "Ain", "ARA", True, dt.date(2024, 7, 8), "Cadres")
    assert {(r["mandat_uid"], r["organe_uid"], r["qualite"]) for r in c.load("mandats").collect()} == {("PM1", "PO1", None), ("PM2", "PO2", "Membre")}
    e = c.load("scrutins").first()
    assert (e["titre"], e["categorie"], e["sort_code"], e["seance_uid"], e["demandeur"], e["suffrages_exprimes"]) == ("l'article 2", "article", "adopté", "RU1", "x", 1)
    assert [(r["n_pour"], r["majoritaire"]) for r in c.load("positions_groupe").collect()] == [(1, "pour")]
    m = c.load("amendements").first()
    assert (m["numero"], m["sort"], m["expose_sommaire"], m["division_titre"], m["division_article"], m["dossier_uid"], m["date_sort"]) == ("12", "Adopté", "Eau", "Article 1", "ART. 1", "DLR9", "2024-09-02")
    for name in catalog.SCHEMAS:
        assert c.load(name).schema == catalog.schema(name), name


def test_downloads(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    with zipfile.ZipFile(src / "d.zip", "w") as z:
        z.writestr("json/one.json", "{}")
    d = catalog.Downloader(str(tmp_path / "raw"))
    known = {"x": catalog.Dataset("x", (src / "d.zip").as_uri(), "x")}
    assert d.fetch_all(known) == {"x": True} and (tmp_path / "raw/x/json/one.json").exists()
    assert d.fetch_all(known) == {"x": False} and d.fetch_all(known, force=True) == {"x": True}
    with pytest.raises(KeyError, match="nope"):
        d.fetch_all(known, ["nope"])
    assert {x.key for x in catalog.datasets("https://data.invalid/").values()} == {"scrutins", "acteurs", "amendements"}
    (src / "A.jpg").write_bytes(b"1")
    address = src.as_uri() + "/{uid}.jpg"
    assert d.fetch_images(["A", "B"], address) == {"new": 1, "changed": 0, "unchanged": 0, "removed": 0, "absent": 1}
    (src / "A.jpg").write_bytes(b"2")
    assert d.fetch_images(["A"], address)["changed"] == 1
    (src / "A.jpg").unlink()
    assert d.fetch_images(["A"], address)["removed"] == 1


def test_json_safe_and_bulletin(spark):
    df = spark.createDataFrame([(float("nan"), 1), (float("inf"), 2), (0.5, 3), (None, 4)], "x double, i int")
    assert [r["x"] for r in catalog.json_safe(df).orderBy("i").collect()] == [None, None, 0.5, None]
    a = spark.createDataFrame([(dt.date(2024, 1, 1), "c", "k", "d", 0.5, 1)], "semaine date, categorie string, cle string, detail string, intensite double, rang int")
    assert "## c" in alerts.bulletin(a, "2024-01-01") and "- k (d, 0.50)" in alerts.bulletin(a, "2024-01-01")


def test_weekly_stream_with_late_rows(spark, tmp_path):
    """A row that comes before its week is closed counts, one that comes after it does not; a key counts once."""
    schema = "k string, at timestamp"
    shape = spark.createDataFrame([], schema).schema
    day = lambda m, d: dt.datetime(2024, m, d)
    arrivals = [[("a", day(1, 2)), ("a", day(1, 2)), ("b", day(1, 9))], [("c", day(3, 1)), ("old", day(1, 3))], [("older", day(1, 2)), ("c", day(3, 1))]]
    folder, seen, keys = tmp_path / "in", [], []
    folder.mkdir()
    for i, rows in enumerate(arrivals):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        next((tmp_path / f"w{i}").glob("part*")).rename(folder / f"{i}.parquet")
        stream = weekly.ballot_stream(spark, str(folder), shape)
        counts = weekly.weekly_counts(stream, "at", [])
        weekly.rebuild_on_arrival(counts, lambda df, _: seen.extend(tuple(r) for r in df.collect()), str(tmp_path / "c1")).awaitTermination()
        once = weekly.once(stream, ["k"], "at")
        weekly.rebuild_on_arrival(once, lambda df, _: keys.extend(r["k"] for r in df.collect()), str(tmp_path / "c2")).awaitTermination()
    got = dict(seen)
    assert got[dt.date(2024, 1, 1)] == 3 and got[dt.date(2024, 1, 8)] == 1 and dt.date(2024, 2, 26) not in got
    assert sorted(k for k in keys if k in "abc") == ["a", "b", "c"]


def test_core_stands_without_the_text_subpackage(tmp_path):
    """Nothing outside ``llm`` imports it, and the entry point leaves its queries out where it is absent."""
    import shutil

    root = Path(ballotlake.__file__).resolve().parent.parent
    shutil.copytree(root / "ballotlake", tmp_path / "ballotlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q and set(e.oracle_sql()) <= set(q); import ballotlake.plans.marts, ballotlake.__main__"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
