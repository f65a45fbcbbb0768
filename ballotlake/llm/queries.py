"""The queries of the text and corpus problems (2, 6, 7, 8, 9, 10) over the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import EXPRESSED, POSITIONS, key, position_number, trimmed
from ..session import table, written
from . import cooccur, encode, forms, langid, mixing, termcounts

VOCABULARY = f"{encode.vocabulary_folder()}/byte_bpe_50k.tiktoken"


# --- 2


def _p2_texts(spark: SparkSession, sf: str) -> DataFrame:
    """(champ, cle, texte): the titles and names as received."""
    s = table(spark, sf, "scrutins").select(F.lit("scrutins.titre").alias("champ"), key("scrutin_uid").alias("cle"), F.col("titre").alias("texte"))
    d = table(spark, sf, "deputes").select(F.lit("deputes.nom_complet").alias("champ"), key("acteur_uid").alias("cle"), F.col("nom_complet").alias("texte"))
    return s.unionByName(d)


def p2_formes(spark: SparkSession, sf: str) -> DataFrame:
    """Every title and name with its one form."""
    return forms.canonical(_p2_texts(spark, sf).distinct(), "texte")


def _p2_members(spark: SparkSession, sf: str) -> DataFrame:
    f = forms.canonical(_p2_texts(spark, sf).where(F.col("cle").isNotNull() & F.col("texte").isNotNull()), "texte")
    return forms.look_alike_classes(f, "champ", "cle", "texte")


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """(champ, forme, cle, n_liens): every title and name that looks like another, its class, and how many of the class have another text."""
    return _p2_members(spark, sf).select("champ", "forme", "cle", "texte", "n_liens")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return forms.look_alike_pairs(written(_p2_members(spark, sf), "classes"), "champ", "cle", "texte")


# --- 6

P6_SAME, P6_LIFT_PER_MILLE = 12, 1811


#: Labels as numbers, in the order in which the greater one wins a tie.
P6_SIDES = tuple(sorted(POSITIONS).index(p) for p in EXPRESSED)


def expressed_ballots(spark: SparkSession, sf: str) -> DataFrame:
    """The last received ballot of each member in each event, where it took one of the three sides (position: a number)."""
    v = table(spark, sf, "votes").select(key("scrutin_uid").alias("scrutin_uid"), key("acteur_uid").alias("acteur_uid"), position_number("position").alias("position"), "recu_le")
    return cooccur.last_labels(v, "scrutin_uid", "acteur_uid", "position", "recu_le").where(F.col("position").isin(*P6_SIDES))


def p6_pairs(spark: SparkSession, sf: str, min_same: int = 0) -> DataFrame:
    """Every pair of members that share an event and took the same side in at least ``min_same``, with counts, lift and pmi (null where they never did)."""
    ballots = written(expressed_ballots(spark, sf), "ballots")
    members = cooccur.marginals(ballots, "acteur_uid", "position", P6_SIDES, min_same)
    pairs = cooccur.together(ballots, members, "scrutin_uid", "acteur_uid", "position", P6_SIDES, min_same)
    rated = cooccur.lift(pairs, members, "acteur_uid", len(P6_SIDES))
    return rated.select(F.col("item_a").alias("acteur_a"), F.col("item_b").alias("acteur_b"), "same", "both", "num", "den", "lift", F.round("pmi", 6).alias("pmi"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    more = F.col("same") * F.col("den") * 1000 > F.col("both") * F.col("num") * P6_LIFT_PER_MILLE
    return p6_pairs(spark, sf, P6_SAME).where(more).select("acteur_a", "acteur_b")


# --- 7


def versions(spark: SparkSession, sf: str, deleted: bool = False) -> DataFrame:
    """(uid, texte, le): every version of every statement as received; with ``deleted`` also a null one for each logged deletion."""
    a = table(spark, sf, "amendements").select(key("amendement_uid").alias("uid"), F.col("expose_sommaire").alias("texte"), F.col("recu_le").cast("timestamp").alias("le"))
    if deleted:
        gone = table(spark, sf, "suppressions").where(F.lower(trimmed("nom_table")) == "amendements")
        a = a.unionByName(gone.select(key("cle").alias("uid"), F.lit(None).cast("string").alias("texte"), F.col("supprime_le").cast("timestamp").alias("le")))
    return a.where(F.col("uid").isNotNull())


def p7_counts(spark: SparkSession, sf: str, deleted: bool = False) -> termcounts.TermCounts:
    """The counts of all statements as they came in: a first load with what was there by the middle of the time, then an increment with the later versions."""
    v = versions(spark, sf, deleted)
    middle = v.agg(F.percentile_approx(F.unix_micros("le"), 0.5)).first()[0]
    early = F.col("le").isNull() | (F.unix_micros("le") <= F.lit(middle))
    c = termcounts.TermCounts(spark)
    return c.apply(v.where(early), "uid", "texte", "le").apply(v.where(~early), "uid", "texte", "le")


def p7_list_counts(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """The same for the published lists: documents by term, and the documents of all weeks."""
    p = table(spark, sf, "poussees").distinct()
    term = termcounts.folded(trimmed("terme"))
    deltas = p.where(trimmed("terme").isNotNull()).select(term.alias("terme"), F.coalesce("n_docs", F.lit(0)).alias("d_occ"), F.coalesce("n_docs", F.lit(0)).alias("d_rec"))
    total = p.groupBy("semaine").agg(F.max("n_documents").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return termcounts.TermCounts(spark).add_signed(deltas).counts(), total


def p7_termes(spark: SparkSession, sf: str) -> DataFrame:
    """(champ, terme, n_occurrences, n_records, marque) of every term."""
    c = p7_counts(spark, sf)
    lists, total = p7_list_counts(spark, sf)
    a = termcounts.marked(c.counts(), c.n_records()).select(F.lit("amendements.expose_sommaire").alias("champ"), "*")
    b = termcounts.marked(lists, total).select(F.lit("poussees.terme").alias("champ"), "*")
    return a.unionByName(b)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_termes(spark, sf).where(F.col("marque").isNotNull()).select("champ", "terme", "marque")


def p7_apres_suppressions(spark: SparkSession, sf: str) -> DataFrame:
    """The terms of the statements that are still there when deletions are taken in at their time; one received again after its deletion counts."""
    return p7_counts(spark, sf, deleted=True).counts()


# --- 8


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return encode.Corpus(docs, "text", VOCABULARY).ids(["doc_id"])


def p8_decoded(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text) made from the ids alone; "" for null and empty texts."""
    return encode.decode(p8_ids(spark, sf), "doc_id", "ids", VOCABULARY)


# --- 9


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, list[mixing.Plan]]:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    sized = written(encode.Corpus(docs, "text", VOCABULARY).sizes(["doc_id", "source"]), "sizes")
    weights = {r["source"]: (r["poids"], r["repetitions_max"]) for r in table(spark, sf, "poids_sources").where("source IS NOT NULL").collect()}
    plans = mixing.plan_mix(mixing.length_histogram(sized, "source", "n_tokens"), weights)
    return mixing.select(sized, plans, "doc_id", "source", "n_tokens"), plans


def p9_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The share each source reaches in the mix, beside its target."""
    chosen, plans = _mix(spark, sf)
    return mixing.report(chosen, plans, "source", "n_tokens")


def p9_selection(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the mix."""
    return _mix(spark, sf)[0]


# --- 10


def p10_langues(spark: SparkSession, sf: str) -> DataFrame:
    """Every document and paragraph with its language and confidence."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    settings = langid.Settings()
    sample, counts = langid.training_sample(docs, "doc_id", "text", "lang", settings)
    model = langid.train(sample, counts, settings)
    return langid.label_documents(docs, "doc_id", "text", "lang", model, counts, settings)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return langid.wrong_or_mixed(p10_langues(spark, sf), "doc_id")


QUERIES = {
    "p2_found": p2_found,
    "p2_formes": p2_formes,
    "p2_classes": p2_classes,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p7_found": p7_found,
    "p7_termes": p7_termes,
    "p7_apres_suppressions": p7_apres_suppressions,
    "p8_ids": p8_ids,
    "p8_decoded": p8_decoded,
    "p9_parts": p9_parts,
    "p9_selection": p9_selection,
    "p10_found": p10_found,
    "p10_langues": p10_langues,
}

_K = "nullif(upper(trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))), '')"


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The letters, hyphens and blanks found in the titles and names by a plain count of their characters, and what each looks like.
_SEEN = "еаіѕосрСЅВјхМКАТІРуНХЕОЈ" "οΜΡΒΤΝΑΙΕΚΥΟΗΧΖ" "‐‑–−"
_AS = "eaisocpCSBjxMKATIPyHXEOJ" "oMPBTNAIEKYOHXZ" "----"
_SPACES = (0x09, 0x0A, 0x0D, 0xA0, 0x2002, 0x2003, 0x2007, 0x2009, 0x202F, 0x3000)
_NOTHING = (0xAD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0xFEFF)


def _form_sql(c: str) -> str:
    """The same form by string functions; for the characters that occur in these titles and names."""
    src, dst = _SEEN + "".join(map(chr, range(0xFF01, 0xFF5F))), _AS + "".join(map(chr, range(0x21, 0x7F)))
    src, dst = src + "".join(map(chr, _SPACES)), dst + " " * len(_SPACES)
    base = f"replace(replace({c}, {_sql_text(chr(0xFB01))}, 'fi'), {_sql_text(chr(0xFB02))}, 'fl')"
    t = f"translate({base}, {_sql_text(src + ''.join(map(chr, _NOTHING)))}, {_sql_text(dst)})"
    return f"nfc_normalize(trim(regexp_replace({t}, ' +', ' ', 'g')))"


_BALLOTS = f"""
WITH v AS (
  SELECT {_K.format('scrutin_uid')} AS s, {_K.format('acteur_uid')} AS m, lower(trim(position, ' ' || chr(9) || chr(10) || chr(160))) AS p, recu_le FROM votes
), l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY s, m ORDER BY recu_le DESC, p DESC) = 1),
e AS (SELECT s, m, p FROM l WHERE p IN ('pour', 'contre', 'abstention')),
n AS (SELECT m, count(*) AS t, count(*) FILTER (p = 'pour') AS a, count(*) FILTER (p = 'contre') AS b, count(*) FILTER (p = 'abstention') AS c FROM e GROUP BY 1),
x AS (SELECT l.m AS ma, r.m AS mb, count(*) AS both_, count(*) FILTER (l.p = r.p) AS same FROM e l JOIN e r ON l.s = r.s AND l.m < r.m GROUP BY 1, 2),
y AS (SELECT x.*, na.a * nb.a + na.b * nb.b + na.c * nb.c AS num, na.t * nb.t AS den FROM x JOIN n na ON na.m = ma JOIN n nb ON nb.m = mb)
"""

#: Entities as they occur in the statements, after & itself was decoded as often as it was encoded.
_ENTITIES = {"&nbsp;": " ", "&eacute;": "é", "&agrave;": "à", "&egrave;": "è", "&lt;": "<", "&gt;": ">"} | {f"&#x{ord(c):04X};": c for c in "éàèêûÀôîâçÉÈÊù"}


def _read_sql(c: str) -> str:
    t = f"regexp_replace({c}, '</?[A-Za-z][^<>]*>', ' ', 'g')"
    for _ in range(4):
        t = f"replace({t}, '&amp;', '&')"
    for a, b in _ENTITIES.items():
        t = f"replace({t}, '{a}', '{b}')"
    return f"regexp_extract_all(strip_accents(lower(regexp_replace({t}, '</?[A-Za-z][^<>]*>', ' ', 'g'))), '[a-z]{{3,}}')"


def _term_sql(rows: str) -> str:
    """Terms of the statements in rows (k, t), and of the published lists."""
    return f"""WITH s AS ({rows}), w AS (SELECT k, unnest({_read_sql('t')}) AS terme FROM s WHERE t IS NOT NULL),
c AS (SELECT terme, count(*) AS n_occurrences, count(DISTINCT k) AS n_records FROM w GROUP BY 1), n AS (SELECT count(*) AS n FROM s WHERE trim(t, ' ' || chr(9) || chr(10) || chr(13) || chr(160)) <> ''),
p AS (SELECT DISTINCT * FROM poussees), pn AS (SELECT sum(n) AS n FROM (SELECT max(n_documents) AS n FROM p GROUP BY semaine)),
pc AS (SELECT strip_accents(lower(trim(terme, ' ' || chr(9) || chr(160)))) AS terme, CAST(sum(n_docs) AS BIGINT) AS n FROM p WHERE trim(terme, ' ' || chr(9) || chr(160)) <> '' GROUP BY 1),
m AS (SELECT 'amendements.expose_sommaire' AS champ, terme, n_occurrences, n_records, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records > 0.2 * (SELECT n FROM n) THEN 'commun' END AS marque FROM c
  UNION ALL SELECT 'poussees.terme', terme, n, n, CASE WHEN n <= 2 THEN 'rare' WHEN n > 0.2 * (SELECT n FROM pn) THEN 'commun' END FROM pc WHERE n <> 0)
"""


_LAST = "SELECT {k} AS k, expose_sommaire AS t FROM amendements WHERE {k} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {k} ORDER BY recu_le DESC, expose_sommaire DESC NULLS LAST) = 1".format(k=_K.format("amendement_uid"))
_LEFT = "SELECT k, t FROM (SELECT {k} AS k, expose_sommaire AS t, recu_le AS le FROM amendements UNION ALL SELECT {c}, NULL, supprime_le FROM suppressions WHERE lower(trim(nom_table)) = 'amendements') WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY le DESC, t DESC NULLS LAST) = 1".format(
    k=_K.format("amendement_uid"), c=_K.format("cle")
)

_FORMS = f"""
WITH t AS (
  SELECT 'scrutins.titre' AS champ, {_K.format('scrutin_uid')} AS cle, titre AS texte FROM scrutins
  UNION ALL SELECT 'deputes.nom_complet', {_K.format('acteur_uid')}, nom_complet FROM deputes),
f AS (SELECT DISTINCT champ, cle, texte, {_form_sql('texte')} AS forme FROM t)
"""

ORACLE = {
    "p7_found": _term_sql(_LAST) + "SELECT champ, terme, marque FROM m WHERE marque IS NOT NULL",
    "p7_termes": _term_sql(_LAST) + "SELECT * FROM m",
    "p7_apres_suppressions": _term_sql(_LEFT) + "SELECT terme, n_occurrences, n_records FROM c",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p2_formes": _FORMS + "SELECT * FROM f",
    "p2_classes": _FORMS + """, k AS (SELECT * FROM f WHERE cle IS NOT NULL AND texte IS NOT NULL AND forme <> ''), n AS (SELECT champ, forme, texte, count(*) AS n FROM k GROUP BY 1, 2, 3)
SELECT k.champ, k.forme, k.cle, k.texte, CAST(sum(n.n) AS BIGINT) AS n_liens FROM k JOIN n ON n.champ = k.champ AND n.forme = k.forme AND n.texte <> k.texte GROUP BY 1, 2, 3, 4""",
    "p2_found": _FORMS + """
SELECT DISTINCT a.champ, a.cle AS cle_a, b.cle AS cle_b FROM f a JOIN f b ON a.champ = b.champ AND a.forme = b.forme AND a.cle < b.cle AND a.texte <> b.texte
WHERE a.forme <> ''""",
    "p6_found": _BALLOTS + "SELECT ma AS acteur_a, mb AS acteur_b FROM y WHERE same >= 12 AND same * den * 1000 > both_ * num * 1811",
    "p6_pairs": _BALLOTS + """SELECT ma AS acteur_a, mb AS acteur_b, same, both_ AS both, num, den, CASE WHEN num > 0 THEN (same * den) / (both_ * num) END AS lift,
round(CASE WHEN num > 0 AND same > 0 THEN log2(same / (both_ * num / den)) END, 6) AS pmi FROM y""",
}
