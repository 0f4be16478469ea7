"""Downstream stability and quality: predictions, token files, logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecstead.sources.text import line_from_end


def disagreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per cent of examples (example_id, pred) on which two models differ; an example that one lacks raises."""
    a, b = first.select("example_id", F.col("pred").alias("p")), second.select("example_id", F.col("pred").alias("q"))
    both = a.join(b, "example_id", "full")
    lacking = F.col("p").isNull() | F.col("q").isNull()
    same = F.when(lacking, F.raise_error(F.lit("the models predict different examples")).cast("boolean")).otherwise(F.col("p") == F.col("q"))
    return both.agg(((1 - F.avg(same.cast("double"))) * 100).alias("disagreement"))


def disagreement_side_by_side(rows: DataFrame, first: str, second: str) -> DataFrame:
    """`disagreement` of two models whose predictions are columns of one row for each example. No shuffle of rows."""
    return rows.agg(((1 - F.avg((F.col(first) == F.col(second)).cast("double"))) * 100).alias("disagreement"))


def ner_disagreement(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per cent of tokens with a gold tag other than O in the first file (line_no, token, gold, pred) that are tagged differently.

    Lines are paired by number; a tagged line that the second file lacks raises. Of the second only line_no and pred are
    used, so it may hold lines of fewer fields (`parse_ner_lines` with fields=3).
    """
    a = first.where(F.col("gold") != "O").select("line_no", F.col("pred").alias("p"))
    both = a.join(second.select("line_no", F.col("pred").alias("q")), "line_no", "left")
    apart = F.when(F.col("q").isNull(), F.raise_error(F.lit("the second file lacks a line")).cast("boolean")).otherwise(F.col("p") != F.col("q"))
    return both.agg((F.avg(apart.cast("double")) * 100).alias("disagreement"))


def tag_disagreement(lines: DataFrame) -> DataFrame:
    """The same of two files that are stored side by side, a row for each token: (gold, first, second). No shuffle of rows."""
    return lines.where(F.col("gold") != "O").agg((F.avg((F.col("first") != F.col("second")).cast("double")) * 100).alias("disagreement"))


def sentiment_quality(logs: DataFrame) -> DataFrame:
    """(path, quality): accuracy in per cent, from the error after `: ` on the second-to-last line; null if it isn't a number."""
    error = F.get(F.split(F.col("line"), ": "), F.lit(1)).try_cast("double")
    return line_from_end(logs, 2).select("path", ((1 - error) * 100).alias("quality"))


def ner_quality(logs: DataFrame) -> DataFrame:
    """(path, quality): micro F1 in per cent, the last token of the seventh line from the end; null for another line."""
    fits = F.col("line").contains("f1-score") & F.col("line").contains("MICRO_AVG")
    score = F.element_at(F.split(F.col("line"), " "), -1).try_cast("double")
    return line_from_end(logs, 7).select("path", F.when(fits, score * 100).alias("quality"))


def complete(quality: DataFrame) -> DataFrame:
    """(path, complete): whether a log could be read to its result."""
    return quality.select("path", F.col("quality").isNotNull().alias("complete"))


def sentence_vectors(sentences: DataFrame, emb: DataFrame) -> DataFrame:
    """(example_id, vec): the mean vector of each sentence's words; words without one are left out, sentences without any too."""
    words = sentences.select("example_id", F.explode(F.split(F.trim("text"), r"\s+")).alias("word"))
    cells = words.join(emb.select("word", "vec"), "word").select("example_id", F.posexplode("vec").alias("at", "x"))
    means = cells.groupBy("example_id", "at").agg(F.avg("x").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"])
    return means.groupBy("example_id").agg(ordered.alias("vec"))


def train_and_predict(train: DataFrame, test: DataFrame, emb: DataFrame, regularization: float = 0.01) -> DataFrame:
    """(example_id, pred): a logistic classifier on mean word vectors, trained on (example_id, text, label)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    inputs = sentence_vectors(train, emb).join(train.select("example_id", F.col("label").cast("double").alias("label")), "example_id")
    model = LogisticRegression(regParam=regularization, maxIter=50).fit(inputs.select(array_to_vector("vec").alias("features"), "label"))
    asked = sentence_vectors(test, emb).select("example_id", array_to_vector("vec").alias("features"))
    return model.transform(asked).select("example_id", F.col("prediction").cast("int").alias("pred"))


def word_similarity(pairs: DataFrame, emb: DataFrame) -> DataFrame:
    """Spearman correlation of human scores (first, second, score) with cosines of the words' vectors."""
    from vecstead.functions.vectors import dot, norm
    from vecstead.operators.stats import spearman_of_many

    a, b = emb.select(F.col("word").alias("first"), F.col("vec").alias("x")), emb.select(F.col("word").alias("second"), F.col("vec").alias("y"))
    both = pairs.join(a, "first").join(b, "second")
    return spearman_of_many(both.select("score", F.try_divide(dot("x", "y"), norm("x") * norm("y")).alias("cosine")), "cosine", "score")

