"""Every core query with SQL against that SQL, and the shape of the plans, over the smallest data (skipped where there are none)."""

import importlib.util
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test data")


def tool():
    spec = importlib.util.spec_from_file_location("compare", Path(__file__).resolve().parent.parent / "tools/compare.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def core() -> list[str]:
    modules = [m for m in entry._modules() if ".llm." not in m.__name__]
    return [n for m in modules for n in m.ORACLE]


@pytest.mark.parametrize("name", core())
def test_same_rows_as_sql(spark, con, name):
    norm = tool().norm
    rows = entry.queries()[name](spark, SF)
    cols = sorted(rows.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert cols == sorted(names)
    other = Counter(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert Counter(tuple(norm(r[c]) for c in cols) for r in rows.collect()) == other


PLANNED = "p1_found p3_found p5_found participation statistiques_deputes accord_groupes voisins dissidence abstention_decomposition cosignatures_groupes courtiers alerte_ruptures controle_hors_mandat controle_effectifs".split()


@pytest.mark.parametrize("name", PLANNED)
def test_no_nested_loops_and_no_row_at_a_time_python(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan


def test_only_the_columns_asked_for_are_read(spark):
    plan = entry.queries()["delegation_portees"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and not any("position_majoritaire_groupe" in s or "demandeur" in s or "dossier_titre" in s for s in scans)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["acteur_uid", "genre", "debut", "fin"] and df.count() > 0


def test_verification_counts_members_with_two_positions(spark):
    n = entry.queries()["controle_releve"](spark, SF).count()
    found = {r["controle"]: r["n"] for r in entry.queries()["verification"](spark, SF).collect()}
    assert n > 0 and found["releve_complet"] == n
