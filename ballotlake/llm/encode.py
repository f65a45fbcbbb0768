"""Problem 8: token ids of a whole corpus by a public tokenizer, through a table of distinct words."""

from __future__ import annotations

import base64
import importlib.util
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import text_hash
from ..session import written

#: The split of the byte-level vocabularies, with Unicode white space for \s.
SPACE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def vocabulary_folder() -> str:
    """Where the public vocabularies are: ``/opt/tokenizers``, or the installed package of them."""
    if os.path.isdir("/opt/tokenizers"):
        return "/opt/tokenizers"
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec else "/opt/tokenizers"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _encoder(path: str):
    """One per worker process."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=read_ranks(path), special_tokens={})


def word_ids(words: DataFrame, vocabulary: str) -> DataFrame:
    """Add ``ids`` to distinct words; each is encoded once, whole, so its merges never cross a word's border."""

    @F.pandas_udf("array<int>")
    def ids(s: pd.Series) -> pd.Series:
        return pd.Series(_encoder(vocabulary).encode_ordinary_batch(s.tolist(), num_threads=1))

    return words.withColumn("ids", ids("word"))


def split_words(text) -> F.Column:
    """The words of a text in order; put together they are the text."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


class Corpus:
    """The distinct texts of a corpus, cut to words, with the dictionary of its distinct words.

    Equal texts are one (128-bit hash), so a text that a third of all rows repeat is worked on once. The
    dictionary (word, count, ids) is written to the shared folder: words are counted map-side, then each is encoded once. The ``hot``
    most frequent words - a bound on rows, not on data - are broadcast; they stand for nearly all occurrences, and no word that is frequent enough to
    skew a join is left for the shuffled rest.
    """

    def __init__(self, docs: DataFrame, text: str, vocabulary: str, hot: int = 20000):
        self.docs, self.text = docs.withColumn("__h", text_hash(text)), text
        some = F.col(text).isNotNull() & (F.col(text) != "")
        self.texts = self.docs.where(some).groupBy("__h").agg(F.first(text).alias("t"))
        words = docs.where(some).select(F.explode(split_words(F.col(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        self.dictionary = written(word_ids(words, vocabulary), "dictionary")
        ranked = self.dictionary.orderBy(F.col("n").desc(), "word").limit(hot).select("word", F.col("ids").alias("hot_ids"))
        self.hot = F.broadcast(written(ranked, "hot"))
        self.words = self.texts.select("__h", F.posexplode(split_words(F.col("t"))).alias("pos", "word")).join(self.hot, "word", "left")
        self.rest = self.words.where(F.col("hot_ids").isNull()).select("__h", "pos", "word").join(self.dictionary.select("word", "ids"), "word")

    def ids(self, keep: list[str], out: str = "ids") -> DataFrame:
        """``keep`` and the ids of each row's text; null and empty texts have an empty list. No row is dropped or repeated."""
        inside = self.words.where(F.col("hot_ids").isNotNull()).groupBy("__h").agg(F.collect_list(F.struct("pos", F.col("hot_ids").alias("ids"))).alias("a"))
        outside = self.rest.groupBy("__h").agg(F.collect_list(F.struct("pos", "ids")).alias("b"))
        none = F.array().cast("array<struct<pos:int,ids:array<int>>>")
        parts = F.array_sort(F.concat(F.coalesce("a", none), F.coalesce("b", none)))
        made = self.texts.select("__h").join(inside, "__h", "left").join(outside, "__h", "left").select("__h", F.flatten(F.transform(parts, lambda x: x["ids"])).alias("__ids"))
        j = self.docs.select(*keep, "__h").join(made, "__h", "left")
        return j.select(*keep, F.coalesce("__ids", F.array().cast("array<int>")).alias(out))

    def sizes(self, keep: list[str], out: str = "n_tokens") -> DataFrame:
        """``keep`` and the number of ids of each row's text."""
        a = self.words.groupBy("__h").agg(F.sum(F.size("hot_ids")).alias("a"))
        b = self.rest.groupBy("__h").agg(F.sum(F.size("ids")).alias("b"))
        made = a.join(b, "__h", "left").select("__h", (F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))).alias("__n"))
        return self.docs.select(*keep, "__h").join(made, "__h", "left").select(*keep, F.coalesce("__n", F.lit(0)).cast("bigint").alias(out))


def pieces(spark: SparkSession, vocabulary: str) -> DataFrame:
    """(id, piece): the bytes of each id as hexadecimal digits; as many rows as the vocabulary has."""
    rows = [(i, b.hex()) for b, i in read_ranks(vocabulary).items()]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["id", "piece"]), "id int, piece string")


def decode(encoded: DataFrame, key: str, ids: str, vocabulary: str, out: str = "text") -> DataFrame:
    """``key`` and the text of each list of ids, through a join with the pieces; an empty list gives "". ``key`` is unique and not null.

    Ids that are not in the vocabulary give nothing.
    """
    table = F.broadcast(pieces(encoded.sparkSession, vocabulary))
    rows = encoded.repartition(key).select(key, F.posexplode_outer(ids).alias("pos", "id")).join(table, "id", "left")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("piece", F.lit("")).alias("p")))), lambda x: x["p"])
    return rows.groupBy(key).agg(F.decode(F.unhex(F.array_join(parts, "")), "UTF-8").alias(out))
