"""A training corpus from `documents`: quality, language, near copies, benchmark passages, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstead.llm.common import fold, quoted, release, table, written
from vecstead.llm.decontaminate import decontaminate
from vecstead.llm.language_id import UNKNOWN, identify_language, learn_languages
from vecstead.llm.near_copies import drop_near_copies
from vecstead.llm.packing import pack_documents
from vecstead.llm.quality import learn_quality, score_quality

#: Texts of a lower cosine with every language are rejected, unless they have fewer characters and so are too short to tell.
LEAST_COSINE, LEAST_CHARACTERS = 0.1, 200


def _where(docs: DataFrame, judged: Callable[[DataFrame], DataFrame], keep: Column) -> DataFrame:
    """The rows of `docs` that are kept once `judged` has added its columns to the text alone; columns come back as they were."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumnRenamed(names[[c.lower() for c in docs.columns].index("text")], "text")
    kept = [("text" if c.lower() == "text" else n) for c, n in zip(docs.columns, names)]
    return judged(plain).where(keep).select(*[F.col(quoted(k)) for k in kept]).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the neighbours vote low.

    Null and empty texts get the mean vote and are dropped or kept by it; without labels every document stays. Repeated rows
    fare alike; columns of whatever names come back as they were; an empty table stays empty.
    """
    model = learn_quality(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return _where(docs, lambda x: score_quality(x, model), F.col("predicted") == 1)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, null ones too, and longer texts that are like no language.

    Where no row names a language nothing is known and all rows go. Repeated rows fare alike; columns of whatever names come
    back as they were; an empty table stays empty.
    """
    learned = learn_languages(docs.where(fold("doc_id", 5) != 0))
    return _where(docs, lambda x: identify_language(x, learned), (F.col("lang_pred") != UNKNOWN) & ((F.col("score") >= LEAST_COSINE) | (F.length("text") < LEAST_CHARACTERS)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the smallest id, null ids last, and one of repeated rows.

    Texts link at a Jaccard similarity of 0.8 or more of their sets of five-word shingles. A SimHash can't decide that (at
    exactly 0.8 two fingerprints of 64 bits differ in about 10 bits, and one pair in 40 is within 4), so the links are found
    by a prefix filter and verified on the sets; hashing, components and the rest are shared with the SimHash operator.
    Columns of whatever names come back as they were; an empty table stays empty.
    """
    return drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item.

    Null texts and null items have no windows; repeated rows fare alike; columns of whatever names come back as they were;
    empty tables drop nothing.
    """
    return _where(docs, lambda x: decontaminate(x, table(spark, sf_dir, "benchmark")), F.lit(True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: a row for each piece of each document.

    Null and empty texts have the end id alone; repeated rows and null ids are packed like any other; an empty table gives an
    empty one.
    """
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_copies", near_copies),
    ("benchmark", benchmark),
    ("packing", packing),
]
#: SQL expresses none of the models; tests/llm/test_pipeline.py holds each stage's decisions against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written and read again before the next; a stage's input goes once its output is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        if i:
            docs = written(docs)
            if before is not None:
                release(before)
            before = docs
        docs = stage(spark, docs, sf_dir)
    return docs
