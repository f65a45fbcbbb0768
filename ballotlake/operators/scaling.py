"""Maps of the members (M1, M2, F35, F37-F39): principal axes and classical scaling.

A map is made of one assembly or college at a time, whose size bounds the matrix; many are made at once, each in its own group of
``applyInPandas``. :func:`units` finds them in the ballots.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import EXPRESSED
from .pairs import spread

#: Members above which no dense matrix is made.
MOST_MEMBERS = 5000


def units(expressed: DataFrame, rounds: int = 2) -> DataFrame:
    """(scrutin_uid, unite): the assembly or college each event belongs to.

    An event starts with the member of the smallest hash as its label; members take the label most of their events have, events the one most of
    their members have. A few strays in an event change nothing. Labels are counted map-side; ties go to the smaller label.
    """
    e = expressed.groupBy("scrutin_uid").agg(F.min(F.struct(F.xxhash64("acteur_uid").alias("h"), F.col("acteur_uid").alias("u")))["u"].alias("unite"))
    pairs = expressed.select("scrutin_uid", "acteur_uid")
    for _ in range(rounds):
        m = _mode(pairs.join(e, "scrutin_uid"), "acteur_uid")
        e = _mode(pairs.join(m, "acteur_uid"), "scrutin_uid")
    return e


def _mode(df: DataFrame, by: str) -> DataFrame:
    n = df.groupBy(by, "unite").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "unite"))["unite"]
    return n.groupBy(by).agg(best.alias("unite"))


def _dense(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Members and the codes of their positions (-1: none) in the unit's events."""
    members, events = sorted(pdf["acteur_uid"].unique()), sorted(pdf["scrutin_uid"].unique())
    if len(members) > MOST_MEMBERS:
        raise ValueError(f"{len(members)} members; a map is made of at most {MOST_MEMBERS}")
    out = np.full((len(members), len(events)), -1)
    out[pd.Index(members).get_indexer(pdf["acteur_uid"]), pd.Index(events).get_indexer(pdf["scrutin_uid"])] = pdf["position"].map(EXPRESSED.index)
    return members, out


def _axes(unit: str, names: list[str], values: np.ndarray, vectors: np.ndarray, total: float, dims: int) -> pd.DataFrame:
    out: dict = {"unite": unit, "acteur_uid": names}
    for k in range(dims):
        v, lam = (vectors[:, k], max(values[k], 0.0)) if k < len(values) else (np.zeros(len(names)), 0.0)
        lead = v[np.argmax(np.abs(v) > 1e-9)]
        out |= {f"axe{k + 1}": v * np.sqrt(lam) * (1 if lead >= 0 else -1), f"inertie{k + 1}": lam / total if total > 0 else 0.0}
    return pd.DataFrame(out)


def _map(ballots: DataFrame, unit: str, dims: int, fit) -> DataFrame:
    schema = "unite string, acteur_uid string, " + ", ".join(f"axe{k} double, inertie{k} double" for k in range(1, dims + 1))
    src = ballots.select(F.col(unit).cast("string").alias("__unit"), "acteur_uid", "scrutin_uid", "position")
    return spread(src, "__unit").groupBy("__unit").applyInPandas(fit, schema)


def pca(ballots: DataFrame, unit: str = "unite", dims: int = 2) -> DataFrame:
    """Axes and shares of inertia of the matrix of signs (+1 for, -1 against, 0 otherwise), its event columns centred. The first member's sign is positive."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names, codes = _dense(pdf)
        x = (codes == 0).astype(float) - (codes == 1)
        u, s, _ = np.linalg.svd(x - x.mean(0), full_matrices=False)
        return _axes(pdf["__unit"].iloc[0], names, s * s, u, float((s * s).sum()), dims)

    return _map(ballots, unit, dims, fit)


def mds(ballots: DataFrame, unit: str = "unite", dims: int = 2, floor: int = 10) -> DataFrame:
    """The same by classical scaling of 1 - agreement; pairs below the floor take the mean distance. Inertias are shares of the first ``dims`` eigenvalues."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names, codes = _dense(pdf)
        both = (codes >= 0).astype(float) @ (codes >= 0).T.astype(float)
        same = sum((codes == k).astype(float) @ (codes == k).T.astype(float) for k in range(len(EXPRESSED)))
        d = np.where(both >= floor, 1 - same / np.maximum(both, 1), np.nan)
        np.fill_diagonal(d, 0.0)
        off = d[~np.eye(len(names), dtype=bool)]
        d = np.where(np.isnan(d), off[~np.isnan(off)].mean() if (~np.isnan(off)).any() else 0.0, d)
        h = np.eye(len(names)) - 1.0 / len(names)
        values, vectors = np.linalg.eigh(-0.5 * h @ (d * d) @ h)
        order = np.argsort(values)[::-1][:dims]
        return _axes(pdf["__unit"].iloc[0], names, values[order], vectors[:, order], float(np.clip(values[order], 0, None).sum()), dims)

    return _map(ballots, unit, dims, fit)


def seriation(m: np.ndarray) -> np.ndarray:
    """Order of rows by the first left singular vector of the centred matrix."""
    filled = np.where(np.isnan(m), np.nanmean(m) if np.isfinite(m).any() else 0.0, m)
    u, *_ = np.linalg.svd(filled - filled.mean(0), full_matrices=False)
    return np.argsort(u[:, 0], kind="stable")


def quantised(c) -> F.Column:
    """A rate in 0..1 as a whole number 0..254, half to even; 255 where it is missing."""
    return F.coalesce(F.rint(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * 254).cast("int"), F.lit(255))


def packed_matrices(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """Per unit the matrix of agreement in the order of ``x``, packed in base64 (A16, F37): one byte a pair of the upper triangle (as :func:`quantised`), two for the shared events, the order, and the bounds of
    the scale in twentieths. ``pairs``: a, b, accord, communs; ``places``: unite, u, x. Only pairs within a unit are brought to it, and a unit has at most MOST_MEMBERS members.
    """
    one = places.select("unite", F.col("u").alias("a"), F.col("x").alias("xa"))
    two = places.select(F.col("unite").alias("__v"), F.col("u").alias("b"))
    inside = pairs.select("a", "b", "accord", "communs").join(one, "a").join(two, "b").where(F.col("unite") == F.col("__v"))
    rows = inside.select("unite", "a", "xa", "b", "accord", "communs").unionByName(one, allowMissingColumns=True)
    return rows.groupBy("unite").applyInPandas(_packed, "unite string, n int, mesurables long, echelle_bas double, echelle_haut double, ordre array<string>, accord_b64 string, communs_b64 string")


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    who = pdf[pdf["b"].isna()].sort_values(["xa", "a"])["a"].tolist()
    if len(who) > MOST_MEMBERS:
        raise ValueError(f"{len(who)} members; a matrix is made of at most {MOST_MEMBERS}")
    at, p = pd.Index(who), pdf[pdf["b"].notna()]
    i, k = at.get_indexer(p["a"]), at.get_indexer(p["b"])
    share, both = np.full((len(who), len(who)), np.nan), np.zeros((len(who), len(who)))
    rates = (p["accord"] / p["communs"]).to_numpy(dtype=float)
    share[i, k] = share[k, i] = rates
    both[i, k] = both[k, i] = p["communs"].to_numpy(dtype=float)
    top = np.triu_indices(len(who), 1)
    s = share[top]
    byte = np.where(np.isnan(s), 255, np.rint(np.clip(np.nan_to_num(s), 0, 1) * 254)).astype(np.uint8)
    count = np.minimum(both[top], 65535).astype("<u2")
    low, high = (np.floor(rates.min() * 20) / 20, np.ceil(rates.max() * 20) / 20) if len(rates) else (0.0, 1.0)
    text = lambda x: base64.b64encode(x.tobytes()).decode()
    return pd.DataFrame([(pdf["unite"].iloc[0], len(who), len(rates), low, high, who, text(byte), text(count))], columns=["unite", "n", "mesurables", "echelle_bas", "echelle_haut", "ordre", "accord_b64", "communs_b64"])


def seriated(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(row, rang): the rows of a matrix of groups in the order of :func:`seriation`. The matrix has as many cells as there are pairs of groups."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index=row, columns=column, values=value).sort_index(axis=0).sort_index(axis=1)
        return pd.DataFrame({row: m.index[seriation(m.to_numpy(dtype=float))], "rang": np.arange(1, len(m) + 1)})

    return cells.select(row, column, value, F.lit(1).alias("__all")).groupBy("__all").applyInPandas(order, f"{row} string, rang int")
