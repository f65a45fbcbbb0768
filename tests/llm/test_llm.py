"""The text and corpus problems: brute force, exact round trips, held-out accuracy, and every kind of untidy input."""

import datetime as dt
import html
import os
import random
import re
import unicodedata
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ballotlake.llm import cooccur, encode, forms, langid, mixing, queries, termcounts
from ballotlake.llm.gru import PAD, BiGru

VOCAB = f"{encode.vocabulary_folder()}/byte_bpe_50k.tiktoken"


# --- 2


def norm(spark, texts):
    df = spark.createDataFrame([(i, t, "old", "x") for i, t in enumerate(texts)], "i int, t string, forme string, token string")
    return [r["forme"] for r in forms.canonical(df, "t").orderBy("i").collect()]


def test_equal_looks_become_equal(spark):
    groups = [
        ["Hélène Cobrat", "Hélène Cobrat", "Hélène  Cobrat", "　Hélène Cobrat ", "H​élène Co­brat", "Ηélène Cοbrаt", "Ｈélène Ｃｏbrat", "Hé⁠lène  ﻿ Cobrat"],
        ["l‑eau－12", "l-eau-12", "l‐eau-１２"],
        ["ﬁxe", "fixe"],
        ["q̣̇", "q̣̇"],
        ["ế", "ế", "ế"],
    ]
    for g in groups:
        assert len(set(norm(spark, g))) == 1, g
    assert norm(spark, ["é", "ế", "ё"]) == ["é", "ế", "ë"]
    different = ["Helene", "Hélène", "hélène", "H.élène", "H1", "Hl", "n°", "no", "x²", "x2"]
    assert len(set(norm(spark, different))) == len(different)


def test_forms_agree_with_unicode_normalisation(spark):
    rng = random.Random(3)
    alphabet = "abéèçÅø ̧̣́̀ñẖ̈ạệ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 14))) for _ in range(80)]
    got = norm(spark, texts)
    by = {}
    for t, f in zip(texts, got):
        by.setdefault(" ".join(unicodedata.normalize("NFC", t).split()), set()).add(f)
    assert all(len(x) == 1 for x in by.values())
    assert len({next(iter(x)) for x in by.values()}) == len(by)


def test_forms_of_nulls_blanks_long_and_repeated(spark):
    long = "Ａｂ​" * 20000
    assert norm(spark, [None, "", " 　", "​", long, "a", "a"]) == [None, "", "", "", "Ab" * 20000, "a", "a"]
    df = spark.createDataFrame([], "i int, t string")
    assert forms.canonical(df, "t").count() == 0


def test_pairs_of_looks(spark):
    df = spark.createDataFrame([("c", "1", "ab"), ("c", "2", "аb"), ("c", "3", "ab"), ("c", "3", "ab"), ("d", "4", "ab"), ("c", "5", ""), ("c", "6", " "), ("c", "7", None), ("c", "2", "ab ")], "champ string, cle string, texte string")
    f = forms.canonical(df, "texte")
    classes = forms.look_alike_classes(f, "champ", "cle", "texte")
    got = {tuple(r) for r in forms.look_alike_pairs(classes, "champ", "cle", "texte").collect()}
    assert got == {("c", "1", "2"), ("c", "2", "3")}
    links = {(r["cle"], r["texte"]): r["n_liens"] for r in classes.collect()}
    assert links == {("1", "ab"): 2, ("3", "ab"): 2, ("2", "аb"): 3, ("2", "ab "): 3}


def test_hangul_and_blocked_marks_follow_the_standard(spark):
    rng = random.Random(2)
    base = "가각힣ㄱ" + "\u1100\u1161\u11a8\u1112\u1175\u11c2" + "aAeoà\u03b1" + "\u0331\u0301\u0323\u0307\u0327\u0345\u0313\u0300"
    texts = ["가나", unicodedata.normalize("NFD", "가나"), "a\u0331\u0301", "á\u0331", "\u1161a", "e\u11a8\u0301"] + ["".join(rng.choice(base) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    want = ["".join(forms.LOOK_ALIKES.get(c, c) for c in unicodedata.normalize("NFD", t)) for t in texts]
    assert norm(spark, texts) == [unicodedata.normalize("NFC", t) for t in want]


def test_every_letter_of_the_list_and_none_beside(spark):
    assert norm(spark, ["".join(forms.LOOK_ALIKES)]) == ["".join(forms.LOOK_ALIKES.values())]
    apart = "бгджзийлпфцчшщъыьэюяΓΔΘΛΞΠΣΦΨΩβγδεζηθλμξπσφψωßþðøłđ"
    assert norm(spark, [apart]) == [unicodedata.normalize("NFC", apart)]


def test_only_texts_with_marks_are_taken_apart(spark, monkeypatch):
    """Characters whose form does not rest on others are translated in place, with the form that the long way gives them."""
    taken, long_way = [], forms.token_forms
    monkeypatch.setattr(forms, "token_forms", lambda t: taken.extend(r["token"] for r in t.collect()) or long_way(t))
    assert norm(spark, ["le vote", "Élève  ＡＢ‐с", "déc\u0301u vu"]) == ["le vote", "Élève AB-c", "dé\u0107u vu"]
    assert sorted(taken) == ["déc\u0301u", "vu"]
    tied = set(forms.single_forms()[1])
    chars = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0xE0000, 0xE0200)) if c not in tied and chr(c) not in forms._ALL_BLANKS]
    words = ["x" + "y".join(chars[i : i + 40]) + "x" for i in range(0, len(chars), 40)]
    df = spark.createDataFrame([(w, w) for w in words], "k string, token string")
    apart = {r["k"]: r["forme"] for r in long_way(df).collect()}
    assert norm(spark, words) == [apart[w] for w in words]
    assert all(not lo <= c <= hi for c in tied for lo, hi in forms._MOSTLY)
    assert all(ord(c) == 0xAD or ord(c) > 0x24F for c in forms.single_forms()[0])


# --- 6


def test_pairs_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(f"s{b}", i, rng.randrange(3), dt.datetime(2024, 1, 1 + rng.randrange(5))) for b in range(60) for i in rng.sample(range(25), rng.randrange(0, 12))]
    rows += [(b, i, (p + 1) % 3, dt.datetime(2024, 2, 1)) for b, i, p, _ in rows[:30]] + rows[:10] + [(None, 1, 1, None), ("s1", None, 1, None), ("solo", 7, None, None), ("s2", 99, None, None), ("s2", 98, None, None)]
    df = spark.createDataFrame(rows, "basket string, item bigint, label int, at timestamp").withColumn("n", F.lit(1))
    once = cooccur.last_labels(df, "basket", "item", "label", "at")
    last = {}
    for b, i, p, t in rows:
        if b is not None and i is not None:
            last[b, i] = max(last.get((b, i), (dt.datetime.min, -1)), (t or dt.datetime.min, -1 if p is None else p))
    baskets = {}
    for (b, i), (_, p) in last.items():
        baskets.setdefault(b, {})[i] = p
    both, same = Counter(), Counter()
    for x in baskets.values():
        for a, b in combinations(sorted(x), 2):
            both[a, b] += 1
            same[a, b] += x[a] == x[b] >= 0
    items = cooccur.marginals(once, "item", "label", (0, 1, 2))
    count = lambda least: cooccur.together(once, cooccur.marginals(once, "item", "label", (0, 1, 2), least), "basket", "item", "label", (0, 1, 2), least)
    name = {r["num"]: r["item"] for r in items.collect()}
    pairs = cooccur.together(once, items, "basket", "item", "label", (0, 1, 2))
    got = {tuple(sorted((name[r["a"]], name[r["b"]]))): (r["same"], r["both"]) for r in pairs.collect()}
    assert got == {k: (same[k], both[k]) for k in both}
    assert sorted((r["same"], r["both"]) for r in count(3).collect()) == sorted((same[k], both[k]) for k in both if same[k] >= 3)
    share = Counter((i, p) for (_, i), (_, p) in last.items())
    rated = cooccur.lift(pairs, items, "item", 3).collect()
    assert len(rated) == len(both)
    for r in rated:
        assert r["num"] == sum(share[r["item_a"], p] * share[r["item_b"], p] for p in range(3)) and (r["same"], r["both"]) == (same[r["item_a"], r["item_b"]], both[r["item_a"], r["item_b"]])
    none = once.where("false")
    assert cooccur.together(none, cooccur.marginals(none, "item", "label", (0, 1, 2)), "basket", "item", "label", (0, 1, 2)).count() == 0


# --- 7


def brute_terms(texts):
    occ, rec = Counter(), Counter()
    for t in texts:
        if t is None:
            continue
        t = re.sub(r"</?[A-Za-z][^<>]*>", " ", t)
        while (u := html.unescape(t)) != t:
            t = u
        t = re.sub(r"</?[A-Za-z][^<>]*>", " ", t)
        t = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
        w = re.findall("[a-z]{3,}", t)
        occ.update(w)
        rec.update(set(w))
    return {k: (occ[k], rec[k]) for k in occ}


def test_signed_deltas_follow_every_change(spark):
    rng = random.Random(7)
    words = ["Été", "été", "&eacute;t&amp;eacute;", "<b>eau</b>", "l&apos;eau", "ab", "œuvre", "x<y", "forêt<br/>forêt", "&nbsp;"]
    make = lambda: rng.choice([None, "", " ", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))])
    state, counts = {}, termcounts.TermCounts(spark)
    for step in range(4):
        batch = {f"r{rng.randrange(25)}": make() for _ in range(15)}
        state |= batch
        rows = [(k, v, 1) for k, v in batch.items()]
        counts.apply(spark.createDataFrame([*rows, rows[0], (None, "perdu", 1)], "uid string, t string, terme int"), "uid", "t")
        got = {r["terme"]: (r["n_occurrences"], r["n_records"]) for r in counts.counts().collect()}
        assert got == brute_terms(state.values()), step
    assert counts.n_records() == sum(v is not None and v.strip() != "" for v in state.values())
    before = {tuple(r) for r in counts.counts().collect()}
    assert {tuple(r) for r in counts.compact().counts().collect()} == before
    empty = termcounts.TermCounts(spark).apply(spark.createDataFrame([], "uid string, t string"), "uid", "t")
    assert empty.counts().count() == 0 and empty.n_records() == 0


def test_versions_of_one_batch_and_what_a_batch_reads(spark, tmp_path):
    t = lambda k: dt.datetime(2024, 1, k)
    c = termcounts.TermCounts(spark, f"file://{tmp_path}/terms", parts=8, keep=2)
    load = lambda rows: c.apply(spark.createDataFrame(rows, "uid string, t string, le timestamp, part int"), "uid", "t", "le")
    got = lambda: {r["terme"]: (r["n_occurrences"], r["n_records"]) for r in c.counts().collect()}
    load([("r", "zebra zebra", t(1), 0), ("s", "apple", t(1), 0)])
    load([("r", None, t(3), 0), ("r", "apple", t(2), 0), ("s", "pear", t(3), 0), ("s", "zzz zzz", t(2), 0), ("u", "late", None, 0), ("u", "fig", t(1), 0)])
    assert got() == {"pear": (1, 1), "fig": (1, 1)} and c.n_records() == 2
    signed = [r for p in c.deltas for r in spark.read.parquet(p).collect()]
    assert {r["terme"] for r in signed if r["d_rec"] < 0} == {"zebra", "apple"}
    load([("r", "back", t(5), 0), ("s", "pear", t(9), 0)])
    assert got() == {"pear": (1, 1), "fig": (1, 1), "back": (1, 1)} and len(c.states) == len(c.deltas) == 1
    load([("u", " ", t(2), 0)])
    assert got() == {"pear": (1, 1), "back": (1, 1)} and c.n_records() == 2
    plan = c._state(spark.read.schema(termcounts._STATE).parquet(f"file://{tmp_path}/terms/batch-{c.made - 2:06d}"))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part#", plan)


def test_marks_and_long_texts(spark):
    c = spark.createDataFrame([("a", 9, 2), ("b", 3, 3), ("c", 20, 4), ("d", 21, 5)], "terme string, n_occurrences int, n_records int")
    assert {r["terme"]: r["marque"] for r in termcounts.marked(c, 20).collect()} == {"a": "rare", "b": None, "c": None, "d": "commun"}
    long = "mot <i>été</i> " * 30000
    got = {r["terme"]: r["n"] for r in termcounts.terms_of(spark.createDataFrame([("x", long)], "r string, t string"), "r", "t").collect()}
    assert got == {"mot": 30000, "ete": 30000}


# --- 8


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary")
def test_encoding_is_exact_and_decodes(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    odd = ["l'été  de\n\n 1999…", "  ", "\t a　b  c", "<|endoftext|>", "I'll don't'S", "日本 ก็ 🙂🏽é", "x" * 3000, "a\r\n\r\n  b ", "½ ² ٣ Ⅷ", "​z﻿", "mot " * 20000]
    rows = [(i, x) for i, x in enumerate(odd)] + [(100, None), (101, ""), (102, odd[0]), (102, odd[0]), (None, "eau")]
    df = spark.createDataFrame([(i, x, 0) for i, x in rows], "doc_id bigint, text string, pos int")
    corpus = encode.Corpus(df, "text", VOCAB, hot=3)
    expected = sorted(((i, t.encode(x, add_special_tokens=False).ids if x else []) for i, x in rows), key=repr)
    assert sorted(((r[0], list(r[1])) for r in corpus.ids(["doc_id"]).collect()), key=repr) == expected
    assert sorted(((r[0], r[1]) for r in corpus.sizes(["doc_id"]).collect()), key=repr) == sorted(((i, len(x)) for i, x in expected), key=repr)
    back = {r[0]: r[1] for r in encode.decode(corpus.ids(["doc_id"]).where("doc_id < 100"), "doc_id", "ids", VOCAB).collect()}
    assert back == dict(enumerate(odd))
    assert encode.Corpus(df.where("false"), "text", VOCAB).ids(["doc_id"]).count() == 0


# --- 9


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), min_size=1, max_size=6), st.integers(0, 300))
def test_knapsack_is_optimal(counts, budget):
    got = mixing.knapsack(counts, budget)
    assert all(0 < x <= counts[n] for n, x in got.items())
    reach = {0}
    for n, c in counts.items():
        reach = {r + n * k for r in reach for k in range(c + 1) if r + n * k <= budget}
    assert sum(n * x for n, x in got.items()) == max(reach)


def test_fit_of_large_budgets():
    rng = random.Random(9)
    lengths = {rng.randrange(1, 3000): rng.randrange(1, 4000) for _ in range(600)}
    total = sum(n * c for n, c in lengths.items())
    for budget in (0, 7, total // 3, total - 1, total + 5):
        take = mixing.fit(lengths, budget)
        assert all(x <= lengths[n] for n, x in take.items())
        assert budget - 10 <= sum(n * x for n, x in take.items()) <= budget or budget > total


def test_what_is_left_is_bounded_by_the_longest_text(monkeypatch):
    rng = random.Random(5)
    seen = []
    program = mixing.knapsack
    monkeypatch.setattr(mixing, "knapsack", lambda counts, rest: seen.append(rest) or program(counts, rest))
    for _ in range(60):
        lengths = {rng.randrange(1, 5000): rng.randrange(1, 10 ** rng.randrange(1, 7)) for _ in range(rng.randrange(1, 200))}
        budget = rng.randrange(1, sum(n * c for n, c in lengths.items()) + 1)
        take = mixing.fit(lengths, budget)
        assert all(0 <= x <= lengths[n] for n, x in take.items()) and 0 <= budget - sum(n * x for n, x in take.items()) <= max(lengths)
        assert not seen or seen.pop() <= (mixing.ROOM + 128) * max(lengths)


def test_only_the_last_range_is_ranked(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), (F.col("id") % 3 + 1).alias("n_tokens"))
    weights = {"a": (1.0, 2)}
    histogram = mixing.length_histogram(df, "source", "n_tokens")
    pick = lambda total, r: {(x["doc_id"], x["copies"]) for x in mixing.select(df, mixing.plan_mix(histogram, weights, total), "doc_id", "source", "n_tokens", to_rank=r).collect()}
    for total in (1, 777, 4999, 12345):
        few, all_ = pick(total, 40), pick(total, 10**9)
        assert few == all_
        n = {x: y for x, y in few}
        assert sum((k % 3 + 1) * c for k, c in n.items()) == total


def test_mix_reaches_its_shares(spark):
    rng = random.Random(1)
    rows = [(i, s, n) for i, (s, n) in enumerate([("a", rng.randrange(1, 400)) for _ in range(900)] + [("b", rng.randrange(1, 400)) for _ in range(60)] + [("c", 50)] * 200 + [(None, 9), ("zero", 0), ("sans", 8)])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, source string, n_tokens bigint, copies int")
    weights = {"a": (0.6, 1), "b": (0.2, 3), "c": (0.2, 2), "zero": (0.1, 2), "absent": (0.1, 1), "nul": (None, 1)}
    plans = mixing.plan_mix(mixing.length_histogram(df, "source", "n_tokens"), weights)
    chosen = mixing.select(df, plans, "doc_id", "source", "n_tokens")
    got = {r["source"]: r for r in mixing.report(chosen, plans, "source", "n_tokens").collect()}
    for s, w in (("a", 0.6), ("b", 0.2), ("c", 0.2)):
        assert abs(got[s]["part"] - w) < 0.005 and got[s]["repetitions"] <= weights[s][1] and got[s]["tokens_retenus"] == next(p.tokens for p in plans if p.source == s)
    assert got["absent"]["tokens_retenus"] == 0 and {r["source"] for r in chosen.collect()} <= {"a", "b", "c"}
    assert {tuple(r) for r in chosen.collect()} == {tuple(r) for r in mixing.select(df, plans, "doc_id", "source", "n_tokens").collect()}
    asked = mixing.plan_mix(mixing.length_histogram(df, "source", "n_tokens"), weights, 10**9)
    assert all(p.tokens == p.most * p.available for p in asked if p.available)
    none = df.where("false")
    assert mixing.select(none, mixing.plan_mix({}, weights), "doc_id", "source", "n_tokens").count() == 0


# --- 10


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    g = BiGru(3, 4, 1)
    for k in g.p:
        g.p[k] = g.p[k].astype(np.float64)
    x = rng.integers(97, 103, (6, 5)).astype(np.int16)
    x[4:, 1] = PAD
    y = rng.integers(0, 3, 5)
    _, grads = g.gradients(x, y)
    for k, v in grads.items():
        at = np.unravel_index(np.argmax(np.abs(v)), v.shape)
        e = 1e-3
        g.p[k][at] += e
        up = g.gradients(x, y)[0]
        g.p[k][at] -= 2 * e
        down = g.gradients(x, y)[0]
        g.p[k][at] += e
        assert abs((up - down) / (2 * e) - v[at]) < 2e-3 * max(1.0, abs(v[at])), k


SAMPLES = {
    "fr": "le gouvernement propose de renforcer la protection des forêts communales dans les territoires isolés avec cette mesure pour nos habitants".split(),
    "en": "the committee should clarify the rules for drinking water and report back every year with this measure that our members support".split(),
    "de": "der ausschuss unterstützt die reform der schulen und berichtet jährlich über das gesetz nach dieser anhörung für unsere gemeinden".split(),
}


def sentence(rng, lang, n=12):
    return " ".join(rng.choice(SAMPLES[lang]) for _ in range(n)).capitalize() + "."


def test_language_of_held_out_texts_despite_wrong_labels(spark):
    rng = random.Random(10)
    s = langid.Settings(documents=120, windows=400, hidden=16, batch=64, rounds=((120, 0.02), (200, 0.015)))
    sample = []
    for lang, n in (("fr", 120), ("en", 40), ("de", 40)):
        for _ in range(n):
            sample.append((lang if rng.random() > 0.15 else rng.choice(list(SAMPLES)), sentence(rng, lang)))
    model = langid.train(sample, Counter(k for k, _ in sample), s)
    texts = [(lang, sentence(rng, lang)) for lang in SAMPLES for _ in range(60)]
    q, n = langid.pooled(model, [t for _, t in texts], s.read_bytes)
    right = np.mean([langid.LANGUAGES[k] == lang for k, (lang, _) in zip(q.argmax(1), texts)])
    assert right >= 0.97 and (n > 0).all()

    mixed = sentence(rng, "fr", 20) + "\n \n" + sentence(rng, "en", 10) + "\n\n\n12 000\n\n" + sentence(rng, "fr", 15)
    rows = [(1, sentence(rng, "fr", 20), "fra"), (2, sentence(rng, "fr", 20), "EN"), (3, sentence(rng, "de", 20), None), (4, mixed, "fr-FR"), (5, None, "fr"), (6, "", None), (7, "12 34\n\n56", "und"), (8, sentence(rng, "en", 8000), "en"), (1, sentence(rng, "fr", 20), "fr")]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id bigint, text string, lang string, langue string, segment int")
    out = langid.label_documents(df, "doc_id", "text", "lang", model, {"fr": 100}, s)
    got = {tuple(r) for r in langid.wrong_or_mixed(out, "doc_id").collect()}
    assert got == {(2, 0, "fr"), (3, 0, "de"), (4, 1, "fr"), (4, 2, "en"), (4, 4, "fr")}
    assert {r["doc_id"] for r in out.where("langue IS NULL").collect()} == {5, 6, 7}
    assert langid.label_documents(df.where("false"), "doc_id", "text", "lang", model, {}, s).count() == 0
    assert langid.training_sample(df.where("false"), "doc_id", "text", "lang", s) == ([], {})
    assert isinstance(langid.train([], {}, s), BiGru)


def test_labels_and_paragraphs(spark):
    df = spark.createDataFrame([("fr-FR",), (" FRA ",), ("English",), ("pt_BR",), ("und",), ("",), (None,), ("ru",), ("frisian",)], "l string")
    assert [r[0] for r in df.select(langid.language_code("l")).collect()] == ["fr", "fr", "en", "pt", None, None, None, None, None]
    assert langid.paragraphs("\n\na\nb\n \t\n\r\nc\n") == ["a\nb", "c\n"]
    assert langid.paragraphs(None) == langid.paragraphs(" \n ") == []
    x, of = langid.windows(["abc", "", "é" * 5], 4)
    assert x.shape == (4, 4) and of.tolist() == [0, 2, 2, 2] and (x == PAD).sum() == 1 + 2
    rng = random.Random(8)
    texts = ["".join(rng.choice("aé 日🙂b") for _ in range(rng.randrange(0, 200))) for _ in range(50)] + ["x" * 999, "\ud800"]
    x, of = langid.windows(texts, 24)
    whole = [bytes(x[of == i][x[of == i] != PAD].astype(np.uint8)) for i in range(len(texts))]
    assert whole == [t.encode("utf-8", "replace") for t in texts]
    for i, row in zip(of, x):
        bytes(row[row != PAD].astype(np.uint8)).decode("utf-8")


def test_a_wrong_label_never_decides(spark):
    rng = random.Random(3)
    s = langid.Settings(documents=60, windows=200, hidden=12, batch=48, rounds=((60, 0.02), (100, 0.015)))
    sample = [(lang, sentence(rng, lang)) for lang in SAMPLES for _ in range(60)]
    counts = {"fr": 9000, "en": 100, "de": 100}
    model = langid.train(sample, counts, s)
    rows = [(1, "Non.", "en"), (2, "Non.", "fr"), (3, "Non.", None), (3, "Non.", None), (4, None, "en")]
    out = langid.label_documents(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang", model, counts, s)
    got = sorted((r["doc_id"], r["langue"], r["segment"], r["confiance"] is not None) for r in out.collect())
    assert len({k for _, k, _, _ in got if k}) == 1 and len(got) == 9 and got[-1] == (4, None, 0, False)


def test_pairs_below_the_bound_of_the_cases_come_out(spark, tmp_path):
    rows = [("s1", "A", "pour"), ("s1", "B", "pour"), ("s1", "C", "contre"), ("s2", "A", "contre"), ("s2", "C", "contre"), ("s3", "B", "pour"), ("s3", "C", "abstention"), ("s4", "D", "pour")]
    spark.createDataFrame([(*r, "2024-01-01") for r in rows], "scrutin_uid string, acteur_uid string, position string, recu_le string").write.parquet(f"{tmp_path}/votes.parquet")
    got = {(r["acteur_a"], r["acteur_b"]): (r["same"], r["both"], r["pmi"] is None) for r in queries.QUERIES["p6_pairs"](spark, str(tmp_path)).collect()}
    assert got == {("A", "B"): (1, 1, False), ("A", "C"): (1, 2, False), ("B", "C"): (0, 2, True)}
    assert queries.QUERIES["p6_found"](spark, str(tmp_path)).count() == 0
