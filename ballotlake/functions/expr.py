"""Column factories shared by all operators. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters with the Unicode property White_Space.
BLANKS = (
    "\t\n\x0b\x0c\r \x85\xa0            "
    "    　"
)

#: Expressed positions, all positions, and causes of a structural non-vote.
EXPRESSED = ("pour", "contre", "abstention")
POSITIONS = (*EXPRESSED, "nonVotant")
STRUCTURAL_CAUSES = ("MG", "PSE", "PAN")

#: An end in this year or later means that the interval is still open.
OPEN_YEAR = 2999
OPEN_DAY = "9999-12-31"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without blanks of any kind at the ends; a blank text becomes null."""
    return F.nullif(F.btrim(col(c), F.lit(BLANKS)), F.lit(""))


def key(c: Column | str) -> Column:
    """A reference key: blanks and letter case do not count, a blank one is no key.

    Most keys are visible ASCII characters from end to end; only the others are searched for blanks of every kind, which is slow.
    """
    c = col(c)
    return F.upper(F.when(c.rlike("^[!-~]++$"), c).otherwise(trimmed(c)))


def position_number(c: Column | str) -> Column:
    """The place of a position word, in any case, in the alphabetical order of the four (from 0), else null. Only words with unusual blanks are searched for them."""
    words = F.array(*[F.lit(p.lower()) for p in sorted(POSITIONS)])
    at = F.coalesce(F.nullif(F.array_position(words, F.lower(F.trim(col(c)))), F.lit(0)), F.array_position(words, F.lower(trimmed(c))))
    return F.nullif(at, F.lit(0)).cast("int") - 1


def position(c: Column | str) -> Column:
    """One of the four position words in any case, else null."""
    return F.get(F.array(*[F.lit(p) for p in sorted(POSITIONS)]), position_number(c))


def day(c: Column | str) -> Column:
    """The calendar day written in a text, in any of the usual notations, else null.

    yyyy-MM-dd (also with / or .), dd/MM/yyyy (also with - or .; day before month), yyyyMMdd, each
    with or without a time after it. Days that do not exist are null.
    """
    c = col(c)
    t = trimmed(c)
    iso = r"^\d{4}-\d{2}-\d{2}(?!\d)"
    year_first = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d).*$"
    day_first = r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4})(?!\d).*$"
    packed = r"^(\d{4})(\d{2})(\d{2})(?!\d).*$"
    text = (
        F.when(c.rlike(iso), F.substring(c, 1, 10))
        .when(t.rlike(iso), F.substring(t, 1, 10))
        .when(t.rlike(year_first), F.regexp_replace(t, year_first, "$1-$2-$3"))
        .when(t.rlike(day_first), F.regexp_replace(t, day_first, "$3-$2-$1"))
        .when(t.rlike(packed), F.regexp_replace(t, packed, "$1-$2-$3"))
    )
    return text.try_cast("date")


def rate(num: Column, den: Column) -> Column:
    """A ratio that is null, never zero and never an error, when there is nothing to divide by."""
    return F.when(den != 0, num / den)


def text_hash(c: Column | str) -> Column:
    """128 bits of a text as a struct of two longs; stands for the text in groupings."""
    c = col(c)
    return F.struct(F.xxhash64(c).alias("h1"), F.xxhash64(F.lit(7), c, F.length(c)).alias("h2"))


def latest(df: DataFrame, keys: list[str], received: str | None = "recu_le") -> DataFrame:
    """Of each key the row received last; the greatest row where times tie or are not known, so that the choice is the same every time. Columns of map type are left out."""
    rest = [c for c, t in df.dtypes if c not in (*keys, received) and not t.startswith("map")]
    top = F.max(F.struct(*([F.col(received)] if received else []), *[F.col(c) for c in rest])).alias("__top")
    return df.groupBy(*keys).agg(top).select(*keys, *([f"__top.{received}"] if received else []), *[f"__top.{c}" for c in rest])
