"""Vocabulary alignment and lookups on embeddings (rank, word, vec)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstead.functions.vectors import normalized
from vecstead.sources.text import last_of_each_word


#: Chosen words that are broadcast; more are joined by a shuffle.
MOST_SENT = 1_000_000


def chosen_words(first: DataFrame, second: DataFrame, n: int, random: bool = False, seed: int = 1234) -> DataFrame:
    """(word): of the words both have, the n of the lowest rank in the first, or, if `random`, n by md5; fewer than n raise then.

    Only words and ranks move, not vectors.
    """
    both = first.groupBy("word").agg(F.max("rank").alias("rank")).join(second.select("word").distinct(), "word", "left_semi")
    if not random:
        return both.orderBy("rank").limit(n).select("word")
    if both.count() < n:
        raise ValueError(f"fewer than {n} shared words")
    return both.orderBy(F.md5(F.concat("word", F.lit(str(seed)))), "word").limit(n).select("word")


def shared(first: DataFrame, second: DataFrame, n: int = -1, random: bool = False, seed: int = 1234) -> DataFrame:
    """(rank, word, x, y) of the words both have; x and rank are the first's.

    With n > 0, the n of the lowest rank, or, if `random`, n by a hash of the word, where fewer than n raise. The words are
    chosen first, so only their vectors are shuffled, and the rows stay spread over the join's partitions.
    """
    if n > 0:
        words = chosen_words(first, second, n, random, seed)
        words = F.broadcast(words) if n <= MOST_SENT else words
        first, second = (e.join(words, "word", "left_semi") for e in (first, second))
    a, b = last_of_each_word(first), last_of_each_word(second)
    return a.select("rank", "word", F.col("vec").alias("x")).join(b.select("word", F.col("vec").alias("y")), "word").select("rank", "word", "x", "y")


def anchor_bundle(anchor: DataFrame, other_anchor: DataFrame, n: int = -1) -> DataFrame:
    """(rank, word, e, f): the anchors on their shared words, to be stored and used with many pairs."""
    return shared(anchor, other_anchor, n).select("rank", "word", F.col("x").alias("e"), F.col("y").alias("f"))


def write_anchors(bundle: DataFrame, path: str, algo: str | None = None, seed: int | None = None) -> None:
    """Replaces a bundle in `path`: the only one there, or that of an algorithm and a seed, beside others."""
    bundle.write.mode("overwrite").parquet(_anchor_path(path, algo, seed))


def read_anchors(spark: SparkSession, path: str, algo: str | None = None, seed: int | None = None) -> DataFrame:
    return spark.read.parquet(_anchor_path(path, algo, seed)).select("rank", "word", "e", "f")


def _anchor_path(path: str, algo: str | None, seed: int | None) -> str:
    return "/".join([path, *([f"algo={algo}"] if algo is not None else []), *([f"seed={seed}"] if seed is not None else [])])


def with_bundle(first: DataFrame, second: DataFrame, bundle: DataFrame) -> DataFrame:
    """(rank, word, x, y, e, f) on the bundle's words; a word that either embedding lacks raises."""
    a, b = last_of_each_word(first), last_of_each_word(second)
    out = bundle.join(a.select("word", F.col("vec").alias("x")), "word", "left").join(b.select("word", F.col("vec").alias("y")), "word", "left")
    there = F.assert_true(F.col("x").isNotNull() & F.col("y").isNotNull(), F.concat(F.lit("missing word: "), "word")).isNull()
    return out.where(there).select("rank", "word", "x", "y", "e", "f")


def with_anchors(first: DataFrame, second: DataFrame, anchor: DataFrame, other_anchor: DataFrame, n: int = -1) -> DataFrame:
    """(rank, word, x, y, e, f) on the anchors' shared vocabulary; a word that either embedding lacks raises."""
    return with_bundle(first, second, anchor_bundle(anchor, other_anchor, n))


def in_vocabulary(words: DataFrame, emb: DataFrame) -> DataFrame:
    return words.join(emb.select("word").distinct(), "word", "left_semi")


def out_of_vocabulary(words: DataFrame, emb: DataFrame) -> DataFrame:
    return words.join(emb.select("word").distinct(), "word", "left_anti")


def represent(words: DataFrame, emb: DataFrame, dim: int) -> DataFrame:
    """`words` with their vec, zeros for words that `emb` lacks."""
    found = words.join(last_of_each_word(emb).select("word", "vec"), "word", "left")
    return found.withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)))


def lookup(words: DataFrame, emb: DataFrame) -> DataFrame:
    """`words` with their vec; a word that `emb` lacks raises."""
    found = words.join(last_of_each_word(emb).select("word", "vec"), "word", "left")
    return found.withColumn("vec", F.coalesce("vec", F.raise_error(F.concat(F.lit("missing word: "), "word")).cast("array<double>")))


def subembedding(emb: DataFrame, words: list[str]) -> DataFrame:
    """(pos, word, vec) in the order of `words`; repeated requests give repeated rows, missing words raise."""
    if not isinstance(words, list):
        raise TypeError("words must be a list, for its order")
    asked = emb.sparkSession.createDataFrame(list(enumerate(words)), "pos bigint, word string")
    return lookup(asked, emb).select("pos", "word", "vec")


def vocabulary(emb: DataFrame) -> DataFrame:
    return emb.select("rank", "word").orderBy("rank")


def normalize(emb: DataFrame) -> DataFrame:
    return emb.withColumn("vec", normalized("vec"))
