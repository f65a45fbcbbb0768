"""The command surface, the detector's options, and sessions."""

import datetime as dt
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ballotlake import __main__, session
from ballotlake.operators import topics
from ballotlake.plans import commands
from ballotlake.plans.assembly import Assembly

SF = "/root/testdata/sf0.001"
D = dt.date


@pytest.fixture(scope="module")
def a(spark):
    if not Path(SF).exists():
        pytest.skip("no test data")
    return Assembly(spark, SF)


ARGS = {"serie": {"terme": "digues"}, "sujets": {"semaine": None, "baisses": True}, "portees": {"min_communs": 3}, "cosignatures": {"min_signatures": 1, "min_communs": 1, "sans_rapporteurs": True}, "dimensions": {"max_dimensions": 1}}


@pytest.mark.parametrize("name", sorted(commands.COMMANDS))
def test_every_command_answers(spark, a, name):
    who = a.members.where(F.col("nom_complet").isNotNull()).groupBy("nom_complet").count().where("count = 1").orderBy("nom_complet").first()[0]
    args = dict(ARGS.get(name, {}))
    args |= {k: who for k in commands.options(name) if k == "nom"} | {k: a.events.orderBy("scrutin_uid").first()["scrutin_uid"] for k in commands.options(name) if k == "uid"}
    try:
        rows = commands.COMMANDS[name](a, **args).limit(50).collect()
    except KeyError as e:  # the name is part of another one
        assert "ambiguous" in str(e)
        return
    assert rows is not None
    if name in ("participation", "dissidence", "info", "verifier", "scrutin"):
        assert rows


def test_options_reach_the_operators(spark, a):
    few, many = commands.participation(a, k=3).count(), commands.participation(a, k=7, pire=True)
    assert few == 3 and many.count() == 7
    top, low = commands.participation(a, k=1).first()["taux"], many.first()["taux"]
    assert low <= top
    everything, recent = commands.amendements(a, k=10**6), commands.amendements(a, k=10**6, depuis="2025-06-01")
    assert recent.agg(F.sum("deposes")).first()[0] < everything.agg(F.sum("deposes")).first()[0]


def test_the_command_line(spark, capsys, tmp_path):
    if not Path(SF).exists():
        pytest.skip("no test data")
    assert __main__.main(["--data", SF, "participation", "--k", "2", "--pire"]) == 0
    assert __main__.main(["--data", SF, "--out", f"{tmp_path}/x", "run", "derniere_semaine"]) == 0 and spark.read.parquet(f"{tmp_path}/x").count() == 1
    assert __main__.main(["--data", SF, "verifier"]) == 1
    assert __main__.main(["list"]) == 0 and "p1_found" in capsys.readouterr().out


def test_the_detector_says_what_is_missing(spark):
    weeks = [D(2024, 1, 1) + dt.timedelta(7 * k) for k in range(3)]
    f = spark.createDataFrame([(w, "eau", 5, 5, 20) for w in weeks[:2]] + [(weeks[2], "eau", 15, 15, 20), (weeks[1], "loup", 12, 12, 20), (weeks[2], "loup", 5, 5, 20)], "semaine date, terme string, n bigint, n_docs bigint, n_documents bigint")
    assert [r["terme"] for r in topics.rising(f).collect()] == ["eau"]
    both = topics.rising(f, rises_only=False, fdr=None, merge=False).collect()
    assert [r["terme"] for r in both] == ["eau", "loup"] and both[1]["score"] < 0 and topics.rising(f, rises_only=False, fdr=None, k=1).count() == 1
    with pytest.raises(ValueError, match="no data"):
        topics.rising(f, "2025-01-06")
    with pytest.raises(ValueError, match="history"):
        topics.rising(f, "2024-01-01")
    with pytest.raises(ValueError, match="no documents"):
        topics.rising(f.withColumn("n_documents", F.lit(0)))


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.shared_folder(Session())


def test_a_mart_follows_its_source(spark, tmp_path):
    p = f"{tmp_path}/t.parquet"
    spark.range(3).write.parquet(p)
    read = lambda: session.mart(spark, ("x", str(tmp_path)), [p], lambda: spark.read.parquet(p))
    one = read()
    assert read() is one and one.count() == 3
    spark.range(5).write.mode("overwrite").parquet(p)
    assert read().count() == 5
    path = next(v[0] for k, v in session._MARTS.items() if k[1:3] == ("x", str(tmp_path)) and v[1].count() == 5)
    shutil.rmtree(path.removeprefix("file:"))
    assert read().count() == 5


def test_without_amendments_what_needs_them_is_empty(spark, tmp_path):
    if not Path(SF).exists():
        pytest.skip("no test data")
    for name in ("scrutins", "votes", "deputes", "organes", "mandats"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    b = Assembly(spark, str(tmp_path))
    assert not b.has("amendements") and b.amendments.count() == 0
    assert commands.cosignatures(b, par_groupe=True).count() == 0 and commands.amendements(b).count() == 0 and commands.courtiers(b).count() == 0
    assert commands.serie(b, "digues").count() > 0
