"""Problem 10: a language and a confidence for every document and every paragraph of a mixed one."""

from __future__ import annotations

import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import text_hash, trimmed
from .gru import PAD, BiGru

LANGUAGES = ("fr", "en", "de", "es", "it", "pt", "nl", "pl")

#: What a label may call each language (first part of a tag, lower case).
NAMES = {
    "fr": ("fr", "fra", "fre", "french", "français", "francais", "francés", "französisch"),
    "en": ("en", "eng", "english", "anglais", "inglés", "englisch"),
    "de": ("de", "deu", "ger", "german", "allemand", "alemán", "deutsch"),
    "es": ("es", "spa", "spanish", "espagnol", "español", "castellano", "spanisch"),
    "it": ("it", "ita", "italian", "italien", "italiano", "italienisch"),
    "pt": ("pt", "por", "portuguese", "portugais", "português", "portugués", "portugiesisch"),
    "nl": ("nl", "nld", "dut", "dutch", "néerlandais", "nederlands", "niederländisch"),
    "pl": ("pl", "pol", "polish", "polonais", "polski", "polnisch"),
}

_BREAK = re.compile(r"\n(?:[^\S\n]*\n)+")


@dataclass(frozen=True)
class Settings:
    """Bounds of the training sample and of the training; none of them touches what is labelled.

    ``documents``: labelled documents per language; ``windows``: byte windows per language; ``train_bytes`` and ``read_bytes``: the
    length of a window in training and in labelling; ``rounds``: (steps, rate) of the networks that clean the labels and of the one that is used; ``clear``: the mean probability from which
    a training paragraph counts as clearly in a language; ``switch``: the
    mean probability from which a paragraph counts as in another language than most of its document, and a single paragraph as in another than its label.
    """

    documents: int = 400
    windows: int = 6000
    train_bytes: int = 64
    read_bytes: int = 96
    hidden: int = 32
    batch: int = 256
    rounds: tuple[tuple[int, float], tuple[int, float]] = ((160, 0.012), (320, 0.008))
    clear: float = 0.5
    switch: float = 0.62
    seed: int = 17


def language_code(c: Column | str) -> Column:
    """The language a label names in whatever notation, else null."""
    head = F.split(F.lower(trimmed(c)), r"[-_@. (]")[0]
    out = F.lit(None).cast("string")
    for code in reversed(LANGUAGES):
        out = F.when(head.isin(*NAMES[code]), code).otherwise(out)
    return out


def paragraphs(text: str | None) -> list[str]:
    """Paragraphs in order; they are parted by lines that are empty or hold only blanks."""
    if not text:
        return []
    return [p for p in _BREAK.split(text.replace("\r\n", "\n")) if p.strip()]


def has_word(text: str) -> bool:
    return any(map(str.isalpha, text))


def letters(x: np.ndarray) -> np.ndarray:
    """Where bytes are letters: ASCII letters and the first bytes of most letters that aren't."""
    low = x | 32
    return ((low >= 97) & (low <= 122) & (x < 128)) | ((x >= 0xC3) & (x <= 0xDF))


def cuts(b: np.ndarray, size: int) -> list[int]:
    """Where the windows of at most ``size`` bytes begin: after a blank of the last quarter where there is one, else before a character, never within one."""
    out, at = [0], 0
    blanks = np.flatnonzero(b <= 32) + 1
    while len(b) - at > size:
        end = at + size
        k = int(np.searchsorted(blanks, end, "right")) - 1
        if k >= 0 and blanks[k] > at + size - size // 4:
            end = int(blanks[k])
        else:
            back = end
            while back > at and (b[back] & 0xC0) == 0x80:
                back -= 1
            end = back if back > at else end
        out.append(end)
        at = end
    return out


def windows(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte windows (N, size) that cover every text in whole, and the number of each window's text."""
    raw = [np.frombuffer(t.encode("utf-8", "replace"), np.uint8) for t in texts]
    starts = [cuts(b, size) if len(b) else [] for b in raw]
    out = np.full((sum(map(len, starts)), size), PAD, np.int16)
    of, at = np.zeros(len(out), np.int64), 0
    for i, (b, x) in enumerate(zip(raw, starts)):
        for s, e in zip(x, [*x[1:], len(b)]):
            out[at, : e - s] = b[s:e]
            of[at] = i
            at += 1
    return out, of


def pieces(pdf: pd.DataFrame, text: str, most: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """The rows of a batch, some at a time: as many as have ``most`` characters together, at least one. Bounds the memory of what is made from them."""
    length = pdf[text].map(lambda t: len(t) if t is not None else 0).to_numpy(dtype=np.int64)
    group = (np.cumsum(length) - length) // most
    for k in np.unique(group):
        yield pdf[group == k]


def pooled(model: BiGru, texts: list[str], size: int, chunk: int = 384) -> tuple[np.ndarray, np.ndarray]:
    """Mean probability of each language over the letters of each text (N, L), and the number of letters."""
    x, of = windows(texts, size)
    total, count = np.zeros((len(texts), model.labels)), np.zeros(len(texts))
    order = np.argsort((x != PAD).sum(1), kind="stable")
    for s in range(0, len(order), chunk):
        rows = order[s : s + chunk]
        w = x[rows]
        w = np.ascontiguousarray(w[:, : max(1, int((w != PAD).sum(1).max()))].T)
        live = letters(w).astype(np.float32)
        q = model.probabilities(w)
        np.add.at(total, of[rows], np.einsum("tbk,tb->bk", q, live))
        np.add.at(count, of[rows], live.sum(0))
    return total / np.maximum(count, 1)[:, None], count


def training_sample(docs: DataFrame, ident: str, text: str, lang: str, settings: Settings) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """(language, text) of at most ``settings.documents`` labelled documents per language, picked by a hash of the id,
    and how many documents each label has in all. Ranks are cut map-side, so no task sees all documents of a language."""
    known = docs.select(language_code(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.lit(settings.seed), F.col(ident)).alias("h"))
    known = known.where(F.col("l").isNotNull() & trimmed("t").isNotNull())
    counts = {r["l"]: r["count"] for r in known.groupBy("l").count().collect()}
    top = known.withColumn("r", F.row_number().over(W.partitionBy("l").orderBy("h"))).where(F.col("r") <= settings.documents)
    return [(r["l"], r["t"]) for r in top.orderBy("l", "r").select("l", "t").collect()], counts


def train(sample: list[tuple[str, str]], counts: dict[str, int], settings: Settings = Settings()) -> BiGru:
    """Learn from labels of which many are wrong.

    Languages are drawn by the root of their frequency: a text of a frequent language under a wrong label is outweighed
    by those under the right one. The documents are parted into two halves; a network trained on one half reads the paragraphs of the other, which it can't
    have learnt by heart. Only paragraphs it clearly gives their label's language stay, and only of documents of which it gives that language most letters. The network that
    is returned learns from these.
    """
    size = len(LANGUAGES)
    texts, labels, doc = [], [], []
    for i, (lang, text) in enumerate(sample):
        for p in paragraphs(text):
            if has_word(p):
                texts.append(p)
                labels.append(LANGUAGES.index(lang))
                doc.append(i)
    model = BiGru(size, settings.hidden, settings.seed)
    if not texts:
        return model
    x, of = windows(texts, settings.train_bytes)
    y, doc = np.array(labels), np.array(doc)
    half = doc % 2
    rng = np.random.default_rng(settings.seed)
    pick = np.concatenate([rng.permutation(np.flatnonzero(y[of] == k))[: settings.windows] for k in range(size)])
    weights = np.sqrt(np.array([counts.get(k, 0) for k in LANGUAGES], float))
    keep = np.zeros(len(texts), bool)

    def judged(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The paragraphs of the other half as the network of half ``k`` reads them."""
        steps, rate = settings.rounds[0]
        judge = BiGru(size, settings.hidden, settings.seed + 1 + k)
        use = pick[half[of[pick]] == k]
        judge.train(x[use], y[of[use]], weights, steps, settings.batch, rate, settings.seed + k)
        others = np.flatnonzero(half != k)
        return others, *(pooled(judge, [texts[i] for i in others], settings.read_bytes) if len(others) else (np.zeros((0, size)), np.zeros(0)))

    with ThreadPoolExecutor(2) as both:  # each has its own seed, so the order in which they end changes nothing
        for others, q, n in both.map(judged, (0, 1)):
            if len(others):
                agrees = q.argmax(1) == y[others]
                share = np.bincount(doc[others], n * agrees, len(sample)) / np.maximum(np.bincount(doc[others], n, len(sample)), 1)
                keep[others] = agrees & (q.max(1) >= settings.clear) & (share[doc[others]] > 0.5)
    for k in range(size):
        if not keep[y == k].any():
            keep[y == k] = True
    use = pick[keep[of[pick]]]
    steps, rate = settings.rounds[1]
    model.train(x[use], y[of[use]], weights, steps, settings.batch, rate, settings.seed + 2)
    return model


def label_documents(docs: DataFrame, ident: str, text: str, lang: str, model: BiGru, counts: dict[str, int], settings: Settings = Settings()) -> DataFrame:
    """(ident, label, segment, langue, confiance, mixte): each document (segment 0) and each of its paragraphs (1, 2, ...).

    A paragraph's language is the one with the highest mean probability over its letters, which is its confidence. A document's is
    the one with the most letters, its confidence the mean of that language over all letters. ``mixte``: the paragraphs
    are in two or more languages. Null, empty and word-less texts have one row without a language; word-less paragraphs have none but are counted.
    A single paragraph below ``settings.switch`` has the language that is likeliest when it is also taken into account how often each occurs (``counts``), and the
    probability that this gives as its confidence; the document's own label never decides. ``label``: the code the given label names. Whole texts are read, in Arrow batches,
    each distinct text once; rows that repeat repeat theirs. Copies are put together before the texts are
    shuffled, once; the languages of a text go back to its rows by its hash.
    """
    prior = np.array([counts.get(k, 0) + 1.0 for k in LANGUAGES])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for batch in batches for part in pieces(batch, "t")):
            parts = [paragraphs(t) for t in pdf["t"]]
            flat = [(d, k, p) for d, ps in enumerate(parts) for k, p in enumerate(ps, 1) if has_word(p)]
            q, n = pooled(model, [p for *_, p in flat], settings.read_bytes) if flat else (np.zeros((0, 1)), np.zeros(0))
            by: dict[int, list[int]] = {}
            for j, (d, _, _) in enumerate(flat):
                by.setdefault(d, []).append(j)
            rows = []
            for d, i in enumerate(zip(pdf["h1"], pdf["h2"])):
                js = by.get(d)
                if not js:
                    rows.append((*i, 0, None, None, False))
                    continue
                best = [int(q[j].argmax()) for j in js]
                size = [max(float(n[j]), 1.0) for j in js]
                held = np.zeros(q.shape[1])
                for b, s in zip(best, size):
                    held[b] += s
                main = int(held.argmax())
                if len(js) == 1 and q[js[0]][main] < settings.switch:
                    q[js[0]] = q[js[0]] * prior / (q[js[0]] * prior).sum()
                    best = [main := int(q[js[0]].argmax())]
                final = [b if b == main or q[j][b] >= settings.switch else main for b, j in zip(best, js)]
                mixed = len(set(final)) > 1
                rows.append((*i, 0, LANGUAGES[main], float(sum(q[j][main] * s for j, s in zip(js, size)) / sum(size)), mixed))
                rows.extend((*i, flat[j][1], LANGUAGES[b], float(q[j][b]), mixed) for b, j in zip(final, js))
            yield pd.DataFrame(rows, columns=["h1", "h2", "segment", "langue", "confiance", "mixte"])

    src = docs.select(F.col(ident).alias("__i"), language_code(lang).alias("label"), F.when(F.col(text).isNotNull(), text_hash(text)).alias("h"), F.col(text).alias("t"))
    texts = src.where(F.col("t").isNotNull()).groupBy("h.h1", "h.h2").agg(F.first("t").alias("t"))
    found = texts.mapInPandas(read, "h1 bigint, h2 bigint, segment bigint, langue string, confiance double, mixte boolean")
    out = src.select("__i", "label", "h.h1", "h.h2").join(found, ["h1", "h2"], "left")
    return out.select(F.col("__i").alias(ident), "label", F.coalesce("segment", F.lit(0)).alias("segment"), "langue", "confiance", F.coalesce("mixte", F.lit(False)).alias("mixte"))


def wrong_or_mixed(labelled: DataFrame, ident: str) -> DataFrame:
    """(ident, segment, langue): documents whose label is missing or wrong, and all paragraphs of mixed ones."""
    c = F.col("langue").isNotNull()
    case = F.when(F.col("segment") == 0, ~F.col("label").eqNullSafe(F.col("langue"))).otherwise(F.col("mixte"))
    return labelled.where(c & case).select(ident, "segment", "langue")
