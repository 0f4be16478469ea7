"""Fine-tuning of word vectors with a classifier: rounds of sparse updates, all as joins and sums by key.

The classifier is logistic on a text's mean vector, so a text's score is a mean of its words' scores, and a word's gradient is
one number times the weights. A round scores the words of its batch, sums the texts' errors back to the words, and moves the
vectors of those words alone; the driver holds the weights. Texts are packed once and meet the scores of their words in blocks:
a block gets each of its words' scores and hands on one number for each. The order of batches follows the data seed, the first weights the
model seed; models that differ in their seeds alone go side by side through the same rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from vecstead.functions.blocks import by_block, flat, how_many, places, shared_out, unpacked
from vecstead.functions.shared import durable
from vecstead.functions.vectors import dot


@dataclass(frozen=True)
class Tuned:
    emb: DataFrame
    weights: np.ndarray
    bias: float


def bags(sentences: DataFrame, emb: DataFrame) -> DataFrame:
    """(example_id, word, share): the share of a text's known words that a word is; texts without a known word are left out."""
    words = sentences.select("example_id", F.explode(F.split(F.trim("text"), r"\s+")).alias("word")).join(emb.select("word").distinct(), "word", "left_semi")
    counts = words.groupBy("example_id", "word").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("example_id").agg(F.sum("n").alias("size"))
    return counts.join(sizes, "example_id").select("example_id", "word", (F.col("n") / F.col("size")).alias("share"))


def gathered(bags: DataFrame) -> DataFrame:
    """(example_id, words, shares) of `bags` (example_id, rank, share): a row for each text."""
    rows = bags.groupBy("example_id").agg(F.collect_list(F.struct(F.col("rank").cast("bigint").alias("rank"), "share")).alias("t"))
    return rows.select("example_id", F.col("t.rank").alias("words"), F.col("t.share").alias("shares"))


def text_bags(sentences: DataFrame, emb: DataFrame) -> DataFrame:
    """(example_id, words, shares): `bags` with a row for each text; words are ranks of `emb`, in which each word stands once.

    A text's words are counted where the text is read, so repeats never move.
    """
    words = sentences.select("example_id", F.split(F.trim("text"), r"\s+").alias("words"))
    schema = StructType([words.schema["example_id"]]).add("word", StringType()).add("n", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, len(whole), 500):
                batch = whole.slice(lo, 500)
                lengths = flat(batch.column(1))[1]
                coded = batch.column(1).flatten().dictionary_encode()
                text = np.repeat(np.arange(len(batch)), lengths)
                size = max(1, len(coded.dictionary))
                found, n = np.unique(text * size + coded.indices.to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(found // size)), coded.dictionary.take(pa.array(found % size)), pa.array(n.astype(np.int32))], names=["example_id", "word", "n"])

    known = words.mapInArrow(run, schema).join(emb.select("word", F.col("rank").cast("bigint").alias("rank")), "word")
    rows = known.groupBy("example_id").agg(F.collect_list(F.struct("rank", "n")).alias("t"), F.sum("n").alias("size"))
    return rows.select("example_id", F.col("t.rank").alias("words"), F.transform("t", lambda x: x["n"] / F.col("size")).alias("shares"))


def labelled(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """`texts` (example_id, words, shares) packed, with the columns of `labels` (example_id, label, ...), written to the shared folder."""
    return durable(shared_out(texts.join(labels, "example_id")))


def _scored(texts: DataFrame, count: int, state: DataFrame, words: int, weights: np.ndarray, biases: np.ndarray, run: Callable, schema: StructType | str, *columns: str) -> DataFrame:
    """`run` of each block of `texts`: `columns`, the ranks named, places, weights, which of the texts each word is in, texts' sizes and chances by each model."""
    own = state.select(F.col("rank").cast("bigint").alias("rank"), F.array(*[dot(F.col("vecs")[i], F.array(*[F.lit(float(x)) for x in w])) for i, w in enumerate(weights)]).alias("vec"))

    def scored(part: pa.RecordBatch, ranks: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
        found, ends, share, counts = unpacked(part.column(0), part.column(2))
        text, at = np.repeat(np.arange(len(part)), np.diff(ends)), places(ranks, found)
        share, text, at = (x[at >= 0] for x in (share, text, at))
        known = np.bincount(text, weights=share, minlength=len(part))
        if counts:
            share = share / known[text]
        chances = [1 / (1 + np.exp(-np.bincount(text, weights=share * scores[at, i], minlength=len(part)) - b)) if len(at) else np.zeros(len(part)) for i, b in enumerate(biases)]
        return run(part.columns[3:], part.column(1), ranks, at, share, text, known > 0, chances)

    return by_block(texts.select("example_id", "words", "weights", *columns), "example_id", how_many(count, words), own, scored, schema)


@dataclass(frozen=True)
class _Side:
    """Models side by side: (rank, word, vecs) with a vector of each model for each word."""

    state: DataFrame
    words: int
    weights: np.ndarray
    biases: np.ndarray


def _side_of(models: list[Tuned]) -> _Side:
    """Models of the same vectors."""
    emb = models[0].emb
    vec = F.col("vec").cast("array<double>")
    return _Side(emb.select("rank", "word", F.array(*[vec] * len(models)).alias("vecs")), emb.count(), np.stack([m.weights for m in models]), np.array([m.bias for m in models]))


def _step(texts: DataFrame, count: int, side: _Side, rate: float) -> _Side:
    """One step of each model down the mean loss of those of `texts` (example_id, words, weights, label, models) whose `models` (array of flags) has it."""
    m, d = side.weights.shape
    names = [f"g{i}" for i in range(m)]

    def run(columns: list, _: pa.Array, ranks: np.ndarray, at: np.ndarray, share: np.ndarray, text: np.ndarray, known: np.ndarray, chances: list[np.ndarray]) -> pa.RecordBatch:
        label = columns[0].to_numpy(zero_copy_only=False)
        theirs = columns[1].flatten().to_numpy(zero_copy_only=False).reshape(-1, m) & known[:, None]
        felt = [np.bincount(at, weights=share * ((chance - label) * theirs[:, i])[text], minlength=len(ranks)) for i, chance in enumerate(chances)]
        # the last row is how many texts each model had
        return pa.RecordBatch.from_arrays([pa.array(np.r_[ranks, -1]), *(pa.array(np.r_[g, float(theirs[:, i].sum())]) for i, g in enumerate(felt))], names=["rank", *names])

    felt = _scored(texts, count, side.state, side.words, side.weights, side.biases, run, "rank bigint, " + ", ".join(f"{g} double" for g in names), "label", "models")
    felt = durable(felt.groupBy("rank").agg(*[F.sum(g).alias(g) for g in names]))
    had = felt.where("rank < 0").first()
    n = np.array([max(1.0, had[g]) if had else 1.0 for g in names])
    felt = felt.where("rank >= 0")
    moved = felt.join(side.state.select("rank", "vecs"), "rank")
    sums = moved.agg(*[F.sum(F.col(g) * F.col("vecs")[i][j]).alias(f"w{i}_{j}") for i, g in enumerate(names) for j in range(d)], *[F.sum(g).alias(f"b{i}") for i, g in enumerate(names)]).first()
    ways = [F.array(*[F.lit(float(x)) for x in w]) for w in side.weights]
    vecs = F.array(*[F.zip_with(F.col("vecs")[i], ways[i], lambda v, w: v - rate / float(n[i]) * F.col(f"g{i}") * w) for i in range(m)])
    state = side.state.join(felt, "rank", "left").select("rank", "word", F.when(F.col("g0").isNull(), F.col("vecs")).otherwise(vecs).alias("vecs"))
    # shares of a text add up to one, so the words' errors add up to the texts'
    slope = np.array([[sums[f"w{i}_{j}"] or 0.0 for j in range(d)] for i in range(m)])
    return _Side(durable(state), side.words, side.weights - rate * slope / n[:, None], side.biases - rate * np.array([sums[f"b{i}"] or 0.0 for i in range(m)]) / n)


def _apart(side: _Side) -> list[Tuned]:
    return [Tuned(side.state.select("rank", "word", F.col("vecs")[i].alias("vec")), w, float(b)) for i, (w, b) in enumerate(zip(side.weights, side.biases))]


def round_of(bag: DataFrame, labels: DataFrame, model: Tuned, rate: float) -> Tuned:
    """One step down the mean loss of the texts of `bag` (example_id, word, share), by weights, bias and the vectors of their words."""
    texts = labelled(gathered(bag.join(model.emb.select("word", "rank"), "word").select("example_id", "rank", "share")), labels)
    return _apart(_step(texts.withColumn("models", F.array(F.lit(True))), texts.count(), _side_of([model]), rate))[0]


def finetuned(sentences: DataFrame, emb: DataFrame, model_seed: int, data_seed: int, rounds: int = 8, batches: int = 4, rate: float = 1.0) -> Tuned:
    """The classifier and the vectors (rank, word, vec) after `rounds` over batches of `sentences` (example_id, text, label) in seeded order.

    Each word and rank stands once in `emb`. Every text is in one batch, by a hash of its id and the data seed.
    """
    texts = labelled(text_bags(sentences, emb), sentences.select("example_id", "label"))
    return _apart(tuned(texts, emb, [(model_seed, data_seed)], rounds, batches, rate))[0]


def tuned(texts: DataFrame, emb: DataFrame, seeds: list[tuple[int, int]], rounds: int = 8, batches: int = 4, rate: float = 1.0) -> _Side:
    """`finetuned` of packed `texts` (example_id, words, weights, label) for each of `seeds` (model, data), side by side.

    A round takes the texts of all models' batches of that round.
    """
    one = emb.select(F.size("vec").alias("d")).first()
    if one is None:
        raise ValueError("no vectors")
    side = _side_of([Tuned(emb, np.random.default_rng(model).normal(size=one.d) * 0.1, 0.0) for model, _ in seeds])
    of = {data: F.pmod(F.xxhash64("example_id", F.lit(data)), F.lit(batches)).cast("int") for _, data in seeds}
    sizes = {tuple(r[f"d{data}"] for data in of): r["n"] for r in texts.groupBy(*[batch.alias(f"d{data}") for data, batch in of.items()]).agg(F.count("*").alias("n")).collect()}
    order = {data: np.random.default_rng(data) for data in of}
    turns = {data: [int(b) for _ in range(-(-rounds // batches)) for b in draw.permutation(batches)][:rounds] for data, draw in order.items()}
    for r in range(rounds):
        now = {data: turns[data][r] for data in of}
        count = sum(n for found, n in sizes.items() if any(b == now[data] for b, data in zip(found, of)))
        if count:
            mine = F.array(*[of[data] == now[data] for _, data in seeds])
            side = _step(texts.withColumn("models", mine).where(F.array_contains("models", True)), count, side, rate)
    return side


def judged(texts: DataFrame, count: int, side: _Side) -> DataFrame:
    """(example_id, pred_1, pred_2, ...) of about `count` packed `texts` (example_id, words, weights) that have a known word, by each model."""
    names = [f"pred_{i + 1}" for i in range(len(side.biases))]

    def run(_: list, ids: pa.Array, ranks: np.ndarray, at: np.ndarray, share: np.ndarray, text: np.ndarray, known: np.ndarray, chances: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.filter(pa.array(known)), *(pa.array((c[known] > 0.5).astype(np.int32)) for c in chances)], names=["example_id", *names])

    schema = StructType([texts.schema["example_id"], *(StructField(c, IntegerType()) for c in names)])
    return _scored(texts, count, side.state, side.words, side.weights, side.biases, run, schema)


def predicted(sentences: DataFrame, model: Tuned) -> DataFrame:
    """(example_id, pred) of texts with a known word."""
    texts = durable(shared_out(text_bags(sentences, model.emb)))
    return judged(texts, texts.count(), _side_of([model])).withColumnRenamed("pred_1", "pred")
