"""Build and publish the serving tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.alerts import require
from ..sources.catalog import json_index, json_safe
from . import extras, problems, rollcall, views

#: The tables a site or dashboard reads, each one query.
MARTS = (
    "liste_groupes index_votes fiches statistiques_deputes dissidence_intervalles participation table_groupes cohesion_groupes accord_groupes accord_portees voisins "
    "cosignatures_groupes courtiers amendements_par_depute amendements_par_groupe amendements_par_dossier scrutins_bascule abstention_decomposition poussees_hebdo alertes responsabilites releves_scrutins bilans presence_groupes matrice_groupes matrice_accords liens_scrutins ouverture"
).split()


def known_queries() -> dict:
    return problems.QUERIES | rollcall.QUERIES | extras.QUERIES | views.QUERIES


def publish(spark: SparkSession, source: str, target: str, names: list[str] | None = None, gate: bool = True, allowed: tuple[str, ...] = ()) -> list[str]:
    """Write the marts of ``source`` as Parquet under ``target``, and the vote index as JSON lines too.

    With ``gate`` nothing is written if any of the six invariants is broken, but for those that are ``allowed`` by name.
    """
    if gate:
        found = rollcall.QUERIES["verification"](spark, source)
        require(found.where(~found["controle"].isin(*allowed)) if allowed else found)
    done = []
    for name in names or MARTS:
        df = json_safe(known_queries()[name](spark, source))
        df.write.mode("overwrite").parquet(f"{target}/{name}.parquet")
        if name == "index_votes":
            json_index(df, f"{target}/{name}.json")
        done.append(name)
    return done

