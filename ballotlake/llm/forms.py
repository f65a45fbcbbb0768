"""Problem 2: one form for texts that look the same.

Unicode tables come from :mod:`unicodedata` by rule; their size is bounded by Unicode itself (a few thousand rows), so they may be
broadcast at any data size.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import BLANKS, text_hash
from ..session import written

#: Letters of other alphabets shaped like Latin ones.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "Ϝ": "F", "Ѵ": "V", "Ӏ": "I", "Ս": "U",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮢ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "Ⲁ": "A", "Ⲃ": "B", "Ⲥ": "C", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "Օ": "O", "Տ": "S", "Լ": "L", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "ɑ": "a", "ɡ": "g",
}
#: Characters drawn as a hyphen.
HYPHENS = "‐‑‒–−﹘﹣－⁃"
#: Characters that show nothing besides those of the category Cf.
SILENT = "͏ᅟᅠ឴឵ㅤﾠ"


def _step(ch: str) -> str | None:
    """What a character stands for, one step; "" if it shows nothing; None if it stays."""
    if ch in BLANKS or ch == "⠀":
        return None if ch == " " else " "
    if ch in HYPHENS:
        return "-"
    if ch in LOOK_ALIKES:
        return LOOK_ALIKES[ch]
    cp = ord(ch)
    if unicodedata.category(ch) == "Cf" or ch in SILENT or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or 0x180B <= cp <= 0x180D:
        return ""
    d = unicodedata.decomposition(ch)
    if not d:
        return None
    kind, *rest = d.split() if d[0] == "<" else ["", *d.split()]
    if kind in ("", "<wide>", "<narrow>", "<noBreak>") or 0xFB00 <= cp <= 0xFB06:
        return "".join(chr(int(x, 16)) for x in rest)
    return None


def _full(ch: str) -> str:
    s = _step(ch)
    return ch if s is None else "".join(map(_full, s)) if s != ch else ch


@lru_cache(1)
def mapping_rows() -> list[tuple[str, list[str]]]:
    """(character, what it becomes) for every character that changes, Hangul syllables among them."""
    rows = []
    for cp in range(0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        full = unicodedata.normalize("NFD", ch) if 0xAC00 <= cp <= 0xD7A3 else _full(ch)
        if full != ch:
            rows.append((ch, list(full)))
    return rows


#: The place of a conjoining vowel or final consonant, which goes on with the syllable before it.
GOES_ON = -1


@lru_cache(1)
def class_rows() -> list[tuple[str, int]]:
    """(character, combining class) for every character that isn't a starter; conjoining vowels and finals have GOES_ON."""
    marks = [(chr(cp), k) for cp in range(0x300, 0x1F000) if not 0xD800 <= cp <= 0xDFFF and (k := unicodedata.combining(chr(cp)))]
    return marks + [(chr(cp), GOES_ON) for cp in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))]


@lru_cache(1)
def composition_pairs() -> dict[str, str]:
    """Two characters, written together, and the one they compose to: every canonical composition but those of Hangul, which are a matter of arithmetic."""
    out = {}
    for cp in range(0xC0, 0x1F000):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        ch, d = chr(cp), unicodedata.decomposition(chr(cp))
        if d and d[0] != "<" and " " in d:
            two = "".join(chr(int(x, 16)) for x in d.split())
            if unicodedata.normalize("NFC", two) == ch:
                out[two] = ch
    return out


def _three_bytes(cp: Column) -> Column:
    """The character of a code point from U+0800 to U+FFFF, by its bytes: a table of all syllables would be written out in every plan."""
    cp = cp.cast("int")
    octets = F.shiftright(cp, 12) * 0x10000 + F.shiftright(cp, 6).bitwiseAND(0x3F) * 0x100 + cp.bitwiseAND(0x3F) + 0xE08080
    return F.unhex(F.hex(octets)).cast("string")


def _composed(s: Column, c: Column) -> Column:
    """What a character and the next one compose to, null if they don't."""
    pairs = composition_pairs()
    table = F.map_from_arrays(F.split(F.lit("\n".join(pairs)), "\n"), F.split(F.lit("\n".join(pairs.values())), "\n"))
    a, b = F.ascii(s), F.ascii(c)
    first = F.when((a >= 0x1100) & (a <= 0x1112) & (b >= 0x1161) & (b <= 0x1175), ((a - 0x1100) * 21 + b - 0x1161) * 28)
    second = F.when((a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b >= 0x11A8) & (b <= 0x11C2), a - 0xAC00 + b - 0x11A7)
    return F.when((b >= 0x1161) & (b <= 0x11C2), _three_bytes(F.coalesce(first, second) + 0xAC00)).otherwise(F.try_element_at(table, F.concat(s, c)))


def recomposed(m: Column) -> Column:
    """The text of a cluster (array of ccc, ch in canonical order): each character is composed with the first one unless a kept one between them blocks it, which
    is one of the same class or a starter."""
    none = F.array().cast("array<string>")
    start = F.struct(F.element_at(m, 1)["ch"].alias("s"), F.lit(GOES_ON - 1).alias("last"), none.alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        got = F.when(acc["last"] < x["ccc"], _composed(acc["s"], x["ch"]))
        block = F.greatest(acc["last"], F.when(x["ccc"] == GOES_ON, 999).otherwise(x["ccc"]))
        taken = F.struct(got.alias("s"), acc["last"].alias("last"), acc["kept"].alias("kept"))
        return F.when(got.isNotNull(), taken).otherwise(F.struct(acc["s"].alias("s"), block.alias("last"), F.concat(acc["kept"], F.array(x["ch"])).alias("kept")))

    whole = F.aggregate(F.slice(m, 2, F.size(m)), start, step, lambda acc: F.concat(acc["s"], F.array_join(acc["kept"], "")))
    return F.when(F.size(m) == 1, F.element_at(m, 1)["ch"]).otherwise(whole)


_ALL_BLANKS = BLANKS + "⠀"
_BLANK_CLASS = "[" + "".join(f"\\x{{{ord(b):X}}}" for b in _ALL_BLANKS) + "]+"


def token_forms(tokens: DataFrame) -> DataFrame:
    """(k, forme) for distinct tokens (k, token) without blanks, by code points; ``k`` stands for the token.

    Each token is exploded to positioned code points, which a broadcast join replaces by what they stand for; marks are
    ordered by combining class within their cluster, clusters are recomposed, and the string is rebuilt. One shuffle (by k) holds
    through all these steps, and no row but the first carries the token.
    """
    spark = tokens.sparkSession
    mapping = F.broadcast(_table(spark, mapping_rows(), "ch string, becomes array<string>"))
    classes = F.broadcast(_table(spark, class_rows(), "ch string, ccc int"))
    points = tokens.select("k", F.posexplode(F.split("token", "")).alias("pos", "ch"))
    points = points.join(mapping, "ch", "left").select("k", "pos", F.posexplode(F.coalesce("becomes", F.array("ch"))).alias("sub", "ch"))
    points = points.join(classes, "ch", "left").select("k", "pos", "sub", "ch", F.coalesce("ccc", F.lit(0)).alias("ccc"))
    w = W.partitionBy("k").orderBy("pos", "sub")
    before = F.coalesce(F.lag("ccc").over(w), F.lit(1))
    begins = (F.col("ccc") == 0) | ((F.col("ccc") == GOES_ON) & (before > 0))
    points = points.withColumn("begins", F.when(begins, 1).otherwise(0))
    points = points.withColumn("cluster", F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0)))
    # a starter comes first (class 0 before the others but after what goes on with it, so its own place decides)
    place = F.when(F.col("ccc") > 0, F.col("ccc")).otherwise(F.lit(0))
    clusters = points.groupBy("k", "cluster").agg(F.array_sort(F.collect_list(F.struct(place.alias("o"), "pos", "sub", "ccc", "ch"))).alias("m"))
    parts = F.array_sort(F.collect_list(F.struct("cluster", recomposed(F.col("m")).alias("s"))))
    return clusters.groupBy("k").agg(F.array_join(F.transform(parts, lambda x: x["s"]), "").alias("forme"))


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _alone(full: list[str], marks: dict[str, int]) -> str:
    """What a character that stands for ``full`` becomes by itself, recomposed cluster by cluster as :func:`token_forms` does it."""
    clusters, before = [], 1
    for c in full:
        k = marks.get(c, 0)
        if not clusters or k == 0 or (k == GOES_ON and before > 0):
            clusters.append("")
        clusters[-1] += c
        before = k
    return "".join(unicodedata.normalize("NFC", c) for c in clusters)


@lru_cache(1)
def single_forms() -> tuple[dict[str, str], list[int]]:
    """Characters whose form is one other character or nothing, with that form; and the code points whose form rests on their neighbours or is longer.

    In a text without any of the latter every character begins its own cluster, so nothing moves or composes across characters and the form is made one by one.
    """
    marks = dict(class_rows())
    forms, tied = {}, {ord(c) for c in marks}
    for ch, full in mapping_rows():
        if ch in _ALL_BLANKS:
            continue
        form = _alone(full, marks)
        if (full and full[0] in marks) or len(form) > 1 or (form and form in _ALL_BLANKS):
            tied.add(ord(ch))
        elif form != ch and ord(ch) not in tied:
            forms[ch] = form
    return forms, sorted(tied)


@lru_cache(1)
def _tied_class() -> str:
    """The code points of :func:`single_forms` that rest on others, as a class of a regular expression."""
    runs: list[list[int]] = []
    for cp in single_forms()[1]:
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    return "[" + "".join(f"\\x{{{x:X}}}-\\x{{{y:X}}}" for x, y in runs) + "]"


#: Ranges without a code point whose form rests on others, which hold most texts: a shorter way to the answer.
_MOSTLY = ((0, 0x2FF), (0x2000, 0x206F))
#: Texts of characters that all stay as they are, but for blanks.
_STAYS = r"^[\x00-\x{AC}\x{AE}-\x{24F}]*+$"


def _tied(text: Column) -> Column:
    """Whether a text has characters whose form rests on their neighbours; false for null."""
    quick = "^[" + "".join(f"\\x{{{x:X}}}-\\x{{{y:X}}}" for x, y in _MOSTLY) + "]*+$"
    return F.coalesce(~text.rlike(quick) & text.rlike(_tied_class()), F.lit(False))


def _one_by_one(text: Column) -> Column:
    """The form of a text that is not :func:`_tied`."""
    forms, _ = single_forms()
    kept = sorted(forms, key=lambda c: (not forms[c], c))  # what shows nothing comes last: translate drops what has no counterpart
    shown = F.when(text.rlike(_STAYS), text).otherwise(F.translate(text, "".join(kept), "".join(forms[c] for c in kept)))
    return F.trim(F.regexp_replace(shown, _BLANK_CLASS, " "))


def canonical(df: DataFrame, text: str, out: str = "forme") -> DataFrame:
    """Add ``out``: the one form of ``text``, equal exactly for texts that look the same.

    Differences of width or composition, silent characters, kinds and numbers of blanks (also at the ends), kinds of
    hyphens and look-alike letters go; case, accents, digits and punctuation stay. A null text stays null; a text that shows nothing becomes
    "". Rows are neither dropped nor repeated, other columns are kept, but one named ``out`` is replaced.

    A text without marks, conjoining letters and characters that stand for several is translated where it lies, without a shuffle. The others are parted by
    blanks into tokens; no mark moves or composes across a blank, so each distinct token is brought to its form once and joined
    back by position, from a written table so that plans do not hold all of this again. Equal texts are worked on once (a hot text costs nothing); a hot token has one row per distinct text
    and may be split by AQE since the other side has one row per token.
    """
    rows = df if out == text else df.drop(out)
    whole = rows.where(~_tied(F.col(text))).withColumn(out, _one_by_one(F.col(text)))
    tied = rows.where(_tied(F.col(text))).withColumn("__h", text_hash(text))
    texts = tied.groupBy("__h").agg(F.first(text).alias("__t"))
    words = texts.select("__h", F.posexplode(F.split("__t", _BLANK_CLASS)).alias("pos", "token")).where(F.col("token") != "").withColumn("k", text_hash("token"))
    forms = token_forms(words.groupBy("k").agg(F.first("token").alias("token")))
    joined = words.drop("token").join(forms, "k").where(F.col("forme") != "")
    parts = F.array_sort(F.collect_list(F.struct("pos", F.col("forme").alias("f"))))
    rebuilt = written(joined.groupBy("__h").agg(F.array_join(F.transform(parts, lambda x: x["f"]), " ").alias("__f")), "forms")
    with_form = tied.join(rebuilt, "__h", "left").drop("__h").withColumn(out, F.coalesce("__f", F.lit(""))).drop("__f")
    return whole.unionByName(with_form)


def look_alike_classes(forms: DataFrame, group: str, ident: str, text: str, form: str = "forme") -> DataFrame:
    """(group, classe, ident, text, n_liens): the texts that look like another one. ``classe`` stands for the form; ``n_liens``: rows of the class with another text.

    One row per group, ident and text, so it grows with the texts and not with their pairs. Texts that show nothing look like no other.
    Forms of only one text are found by hashes and fall away first, so that of the texts only those travel on that have a class.
    """
    t = forms.where(F.col(ident).isNotNull() & F.col(text).isNotNull()).select(group, ident, text, form).withColumn("__f", F.xxhash64(group, form))
    h = t.select("__f", text_hash(text).alias("h")).select("__f", F.col("h.h1").alias("p"), F.col("h.h2").alias("q"))
    seen = h.groupBy("__f").agg(F.min("p").alias("p0"), F.max("p").alias("p1"), F.min("q").alias("q0"), F.max("q").alias("q1"))
    several = seen.where((F.col("p0") != F.col("p1")) | (F.col("q0") != F.col("q1"))).select("__f")
    t = written(t.join(several, "__f", "left_semi").select(group, ident, text, form).distinct(), "alike").where(F.col(form) != "")  # sooner, it would have every form made twice
    size = t.groupBy(group, form, text).agg(F.count(F.lit(1)).alias("__n"))
    all_of = size.groupBy(group, form).agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__kinds")).where(F.col("__kinds") > 1)
    links = size.join(all_of, [group, form]).select(group, form, text, (F.col("__all") - F.col("__n")).alias("n_liens"))
    return t.join(links, [group, form, text]).select(group, F.hex(F.xxhash64(form)).alias("classe"), form, ident, text, "n_liens")


def look_alike_pairs(classes: DataFrame, group: str, ident: str, text: str, form: str = "forme") -> DataFrame:
    """(group, cle_a, cle_b): different idents whose texts have one form but are not the same characters: the classes written out.

    Only distinct texts of a class are paired, never copies of one text.
    """
    reps = classes.select(group, form, text).distinct()
    a, b = reps.alias("a"), reps.alias("b")
    same = (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col(f"a.{form}") == F.col(f"b.{form}")) & (F.col(f"a.{text}") < F.col(f"b.{text}"))
    pairs = a.join(b, same).select(F.col(f"a.{group}").alias(group), F.col(f"a.{text}").alias("ta"), F.col(f"b.{text}").alias("tb"))
    one = classes.select(group, F.col(text).alias("ta"), F.col(ident).alias("ia"))
    two = classes.select(group, F.col(text).alias("tb"), F.col(ident).alias("ib"))
    out = pairs.join(one, [group, "ta"]).join(two, [group, "tb"]).where(F.col("ia") != F.col("ib"))
    return out.select(group, F.least("ia", "ib").alias("cle_a"), F.greatest("ia", "ib").alias("cle_b")).distinct()
