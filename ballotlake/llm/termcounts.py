"""Problem 7: occurrences and record counts of every term, kept up to date by signed deltas."""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.expr import trimmed
from ..session import scratch

_TAG = r"(?s)</?[A-Za-z][^<>]*>|<!--.*?-->"


def _fold_table() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, by rule."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(cp).lower())[0]
        if base.isascii() and chr(cp).lower() == chr(cp):
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


_SRC, _DST = _fold_table()


def folded(c: Column) -> Column:
    """Lower case without accents, whether composed or combining."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{M}+", ""), _SRC, _DST)


@F.pandas_udf(StringType())
def _decoded(s: pd.Series) -> pd.Series:
    def one(t):
        while t is not None and "&" in t:
            u = html.unescape(t)
            if u == t:
                break
            t = u
        return t

    return s.map(one, na_action="ignore")


def as_read(c: Column) -> Column:
    """Tags become blanks and entities are decoded as often as they were encoded. Only texts with & leave the JVM."""
    plain = F.regexp_replace(c, _TAG, " ")
    decoded = F.when(plain.contains("&"), _decoded(F.when(plain.contains("&"), plain))).otherwise(plain)
    return F.regexp_replace(decoded, _TAG, " ")


def words_of(text: Column) -> Column:
    """The runs of three or more letters a-z of a text as read."""
    return F.regexp_extract_all(folded(as_read(text)), F.lit("[a-z]{3,}"), F.lit(0))


def signed_terms(signed: DataFrame) -> DataFrame:
    """(terme, d_occ, d_rec) from rows (signe, t): one row per occurrence, of which one per text counts the record.

    The words of a text are sorted within its row, so that the first of each kind is known there; nothing is shuffled before terms are summed.
    """
    w = signed.select("signe", F.array_sort(words_of(F.col("t"))).alias("w"))
    marked = F.transform("w", lambda x, i: F.struct(x.alias("terme"), ((i == 0) | (F.get("w", i - 1) != x)).cast("bigint").alias("premier")))
    return w.select("signe", F.explode(marked).alias("x")).select("x.terme", F.col("signe").cast("bigint").alias("d_occ"), (F.col("signe") * F.col("x.premier")).alias("d_rec"))


def terms_of(records: DataFrame, record: str, text: str) -> DataFrame:
    """(record, terme, n): the runs of three or more letters a-z in each record's text and how often each occurs.

    Null, blank and word-less texts have none.
    """
    return records.select(record, F.explode(words_of(F.col(text))).alias("terme")).groupBy(record, "terme").agg(F.count(F.lit(1)).alias("n"))


_DELTA = "terme string, d_occ bigint, d_rec bigint, part bigint"
_STATE = "record string, texte string, part bigint"
#: The term that stands for the records themselves; no term is empty.
_RECORDS = ""


class TermCounts:
    """Persistent counts in a shared folder: signed deltas partitioned by a hash of the term, and each record's last text partitioned by a hash of the record.

    A batch writes only what it changes: the new texts of its records, and per term the change of occurrences and records. Of the state it reads only the
    parts its records fall in, and of those only the rows of its records: their keys are few beside the state, so they go to it and not it to them. Counts are the
    sum of the deltas since the last compaction; after ``keep`` batches both are folded to one, deleted records fall out. Every batch has its
    own folder, written in full or not at all, so it may be run again after a loss. The number of parts follows the first batch, ``rows`` to a part.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, parts: int | None = None, rows: int = 200_000, keep: int = 16):
        self.spark, self.path, self.parts, self.rows, self.keep = spark, path or scratch(spark, "terms"), parts, rows, keep
        self.deltas: list[str] = []
        self.states: list[str] = []
        self.made = 0

    def _parts(self, first: DataFrame) -> int:
        if self.parts is None:
            self.parts = min(4096, max(4, -(-first.count() // self.rows)))
        return self.parts

    def _write(self, df: DataFrame, what: str, by: str, n: int) -> str:
        self.made += 1
        path = f"{self.path}/{what}-{self.made:06d}"
        df.withColumn("part", F.pmod(F.xxhash64(by), F.lit(n))).repartition(n, "part").write.mode("overwrite").partitionBy("part").parquet(path)
        return path

    def add_signed(self, deltas: DataFrame) -> TermCounts:
        """Merge rows (terme, d_occ, d_rec) as they are."""
        sums = deltas.groupBy("terme").agg(F.sum("d_occ").cast("bigint").alias("d_occ"), F.sum("d_rec").cast("bigint").alias("d_rec"))
        self.deltas.append(self._write(sums.where("d_occ <> 0 OR d_rec <> 0"), "delta", "terme", self.parts or 4))
        return self

    def _state(self, keys: DataFrame | None = None) -> DataFrame | None:
        """(record, texte): each record's last text, null if it was deleted; of the records of ``keys`` (record, part) only, where given."""
        if not self.states:
            return None
        only = [r[0] for r in keys.select("part").distinct().collect()] if keys is not None else None  # at most as many as there are parts
        out = None
        for i, p in enumerate(self.states):
            r = self.spark.read.schema(_STATE).parquet(p)
            if only is not None:
                r = r.where(F.col("part").isin(only)).join(keys.select("record"), "record", "left_semi")
            r = r.select("record", F.struct(F.lit(i).alias("b"), "texte").alias("x"))
            out = r if out is None else out.unionByName(r)
        return out.groupBy("record").agg(F.max("x").alias("x")).select("record", "x.texte")

    def apply(self, batch: DataFrame, record: str, text: str, sequence: str | None = None) -> TermCounts:
        """Take in a batch of versions of records: new ones are added, changed ones replace their former text, those with a null text are deleted.

        Of a record that comes several times the version with the greatest ``sequence`` counts (a null one comes first; on a tie, and without a sequence, a text wins over none, then the
        greater one). Rows without a ``record`` are left out. Unchanged records cost a join and nothing else.
        """
        at = F.col(sequence) if sequence else F.lit(0)
        rows = batch.where(F.col(record).isNotNull()).select(F.col(record).cast("string").alias("record"), F.struct(at.alias("at"), F.col(text).alias("t")).alias("x"))
        new = rows.groupBy("record").agg(F.max("x").alias("x")).select("record", F.col("x.t").alias("texte"))
        n = self._parts(rows)
        new = self.spark.read.schema(_STATE).parquet(self._write(new, "batch", "record", n))
        old = self._state(new)
        if old is None:
            changed = new.where(F.col("texte").isNotNull()).withColumn("ancien", F.lit(None).cast("string"))
        else:
            changed = new.join(old.withColumnRenamed("texte", "ancien"), "record", "left").where(~F.col("texte").eqNullSafe(F.col("ancien")))
        path = self._write(changed.drop("part"), "state", "record", n)
        changed = self.spark.read.schema(f"ancien string, {_STATE}").parquet(path)
        both = F.array(F.struct(F.lit(1).alias("signe"), F.col("texte").alias("t")), F.struct(F.lit(-1).alias("signe"), F.col("ancien").alias("t")))
        signed = changed.select(F.explode(both).alias("x")).select("x.signe", "x.t").where(F.col("t").isNotNull())
        records = signed.where(trimmed("t").isNotNull()).select(F.lit(_RECORDS).alias("terme"), F.lit(0).cast("bigint").alias("d_occ"), F.col("signe").cast("bigint").alias("d_rec"))
        self.states.append(path)
        self.add_signed(signed_terms(signed).unionByName(records))
        return self.compact() if len(self.states) > self.keep else self

    def _sums(self) -> DataFrame:
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(_DELTA).parquet(p) for p in self.deltas])
        return rows.groupBy("terme").agg(F.sum("d_occ").alias("n_occurrences"), F.sum("d_rec").alias("n_records")).where(F.col("n_records") != 0)

    def counts(self) -> DataFrame:
        """(terme, n_occurrences, n_records) of every term that some record holds."""
        return self._sums().where(F.col("terme") != _RECORDS)

    def compact(self) -> TermCounts:
        """Fold all deltas into one and all states into one, without the deleted records."""
        n = self.parts or 4
        self.deltas = [self._write(self._sums().select("terme", F.col("n_occurrences").alias("d_occ"), F.col("n_records").alias("d_rec")), "compact", "terme", n)]
        if self.states:
            self.states = [self._write(self._state().where(F.col("texte").isNotNull()), "base", "record", n)]
        return self

    def n_records(self) -> int:
        """The number of records with a text that is not blank."""
        row = self._sums().where(F.col("terme") == _RECORDS).first()
        return row["n_records"] if row else 0


def marked(counts: DataFrame, total: int, rare: int = 2, common: float = 0.2) -> DataFrame:
    """Add ``marque``: rare (at most ``rare`` records), commun (more than the share ``common`` of ``total``), else null. Rare wins."""
    return counts.withColumn("marque", F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > F.lit(common * total), "commun"))
