"""Toxicity by class-conditional Kneser-Ney models.

Each class, toxic and ordinary, has an interpolated model of the words after a word. What its counts of pairs leave goes to
its counts of words (by how many words each follows), and what those leave to the counts of both classes together. Discounts
and backoff weights come from both classes, so an expression that is too rare to tell is as likely in either class, and only
what a class repeats tells. A text is scored by its log-likelihoods' difference a word, over the whole text, over its most
toxic stretch and over its few most toxic words, which a long text doesn't dilute, and a logistic curve, fitted on labelled documents that the models were not counted on, turns that into a
probability.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstead.llm.common import append_columns, as_bytes, batch_of, ddl, durable, fold, quoted, table
from vecstead.llm.lm_score import Tokens

#: Bounds of the fit: labelled documents of each class that are sampled for it.
MAX_TOXIC, MAX_ORDINARY = 3_000, 5_000
THRESHOLD = 0.3
#: Discounts of the counts of both classes, of a class's words and of its pairs; how many occurrences of a word the pairs of
#: both classes are worth in each class; and the likelihood of a word that is in no labelled text.
SHARED, WORDS, PAIRS = 0.75, 2.0, 3.0
STRENGTH = 30.0
UNKNOWN = 1e-7
#: Words of a stretch, of the most toxic ones, and texts that are scored at once.
STRETCH, STRONGEST, TOGETHER = 12, 3, 200

_END, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_SPACED = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def read(texts: list[bytes | None]) -> tuple[Tokens, np.ndarray]:
    """The words of the texts, runs of letters, digits and all beyond ASCII in lower case, and the word before each."""
    tokens = Tokens([(x or b"").translate(_SPACED) for x in texts])
    before = np.r_[_START, tokens.hash[:-1]]
    before[tokens.first] = _START
    return tokens, before


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


@dataclass
class Values:
    """Values by hash, and one for hashes that it doesn't hold."""

    keys: np.ndarray
    values: tuple[np.ndarray, ...]
    other: float

    def of(self, hashes: np.ndarray) -> list[np.ndarray]:
        if not len(self.keys):
            return [np.full(len(hashes), self.other) for _ in self.values]
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        known = self.keys[at] == hashes
        return [np.where(known, x[at], self.other) for x in self.values]


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mixed(before * np.uint64(0xBF58476D1CE4E5B9) + word)


@dataclass
class Models:
    """Both classes' models, ordinary first, and the logistic curve."""

    #: Each known word's likelihoods alone, and each pair's discounted shares.
    word: Values
    pair: Values
    #: What the pairs of each word before leave to the word alone.
    backoff: Values
    curve: tuple[float, ...] = ()

    def ratios(self, tokens: Tokens, before: np.ndarray) -> np.ndarray:
        """Toxic minus ordinary log-likelihood of each token; zero for ends."""
        (weight,) = self.backoff.of(before)
        ordinary, toxic = (s + weight * w for s, w in zip(self.pair.of(pair_key(before, tokens.hash)), self.word.of(tokens.hash)))
        return np.where(tokens.hash == _END, 0.0, np.log(toxic) - np.log(ordinary))


def learn_models(before: np.ndarray, word: np.ndarray, counts: tuple[np.ndarray, np.ndarray]) -> Models:
    """From distinct pairs of words (hashes) and how often each class has them."""
    words, at = np.unique(word, return_inverse=True)
    befores, before_at = np.unique(before, return_inverse=True)
    follows = [np.bincount(at, c > 0, minlength=len(words)) for c in counts]  # how many words each word follows
    both = follows[0] + follows[1]
    shared = (np.maximum(both - SHARED, 0) + SHARED * len(words) * UNKNOWN) / both.sum()
    left = 1 - np.maximum(both - WORDS, 0).sum() / both.sum()
    alone = [(1 - left) * (x := np.maximum(f - WORDS, 0)) / max(x.sum(), 1e-9) + left * shared for f in follows]
    kept = [np.maximum(c - PAIRS, 0) for c in counts]
    of_before = [np.bincount(before_at, x, minlength=len(befores)) for x in kept]
    together, total = of_before[0] + of_before[1], np.bincount(before_at, counts[0] + counts[1], minlength=len(befores))
    weight = 1 - together / np.maximum(total, 1)
    drawn = (kept[0] + kept[1]) / np.maximum(together[before_at], 1e-9)
    shares = [(1 - weight)[before_at] * (x + STRENGTH * drawn) / (n[before_at] + STRENGTH) for x, n in zip(kept, of_before)]
    keys = pair_key(before, word)
    some = np.flatnonzero(drawn > 0)
    some = some[np.argsort(keys[some])]
    return Models(Values(words, tuple(alone), left * SHARED * len(words) * UNKNOWN / both.sum()), Values(keys[some], tuple(x[some] for x in shares), 0.0), Values(befores, (weight,), 1.0))


def features(models: Models, texts: list[bytes | None]) -> np.ndarray:
    """For each text the ratio a word, of the whole text and of its most toxic stretch of STRETCH words.

    In stretches a word counts where it first occurs in the text, so that repetition alone makes none toxic.
    """
    return measured(models, texts)[:, :2]


def measured(models: Models, texts: list[bytes | None]) -> np.ndarray:
    """The `features`, and the mean ratio of the STRONGEST most toxic words of each text, each where it first occurs."""
    tokens, before = read(texts)
    ratios, out = models.ratios(tokens, before), np.zeros((len(texts), 3))
    seen = np.lexsort((tokens.hash, tokens.doc))
    new = np.ones(len(seen), dtype=bool)
    new[seen[1:]] = (tokens.hash[seen[1:]] != tokens.hash[seen[:-1]]) | (tokens.doc[seen[1:]] != tokens.doc[seen[:-1]])
    for i, (lo, hi) in enumerate(zip(tokens.first.tolist(), [*tokens.first[1:].tolist(), len(ratios)])):
        own = ratios[lo : hi - 1]  # without the end
        if len(own):
            sums = np.r_[0.0, np.cumsum(np.where(new[lo : hi - 1], own, 0.0))]
            width = min(STRETCH, len(own))
            strongest = np.sort(own[new[lo : hi - 1]])[-STRONGEST:].sum() / STRONGEST
            out[i] = own.sum() / max(STRETCH, len(own)), (sums[width:] - sums[:-width]).max() / STRETCH, strongest
    return out


#: The curve before any labelled document is seen, and how many documents it is worth.
CURVE, WORTH = np.array([5.0, 5.0, 0.0, -6.0]), 2.0


def logistic(x: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by damped Newton steps from CURVE, drawn towards it; the last coefficient is the constant."""
    x, w = np.c_[x, np.ones(len(x))], CURVE.copy()
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = x.T @ (x * (weights * p * (1 - p))[:, None]) + WORTH / 10 * np.eye(len(w))
        step = np.linalg.solve(bend, x.T @ (weights * (labels - p)) - WORTH / 10 * (w - CURVE))
        w = w + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-8:
            break
    return w


#: The columns of what is measured.
MEASURED = ("__whole", "__stretch", "__strongest")


def _pair_counts(rows: DataFrame) -> DataFrame:
    """(before, word, ordinary, toxic): how often each class has each pair of words."""
    schema = {"before": "bigint", "word": "bigint", "ordinary": "bigint", "toxic": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), TOGETHER):
                part = batch.slice(lo, TOGETHER)
                (tokens, before), label = read(as_bytes(part.column(0))), part.column(1).to_numpy()
                inner = np.flatnonzero(tokens.hash != _END)
                toxic = label[tokens.doc[inner]] == 1
                pairs, first, back = np.unique(pair_key(before, tokens.hash)[inner], return_index=True, return_inverse=True)
                counts = [np.bincount(back, x, minlength=len(pairs)).astype(np.int64) for x in (~toxic, toxic)]
                yield batch_of(schema, [before[inner[first]].view(np.int64), tokens.hash[inner[first]].view(np.int64), *counts])

    found = rows.select("__text", "__label").mapInArrow(run, ddl(schema))
    return found.groupBy("before", "word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def learn_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id", most: tuple[int, int] = (MAX_ORDINARY, MAX_TOXIC)) -> Models | None:
    """The models and the curve, from at most `most` labelled documents of each class, drawn by the hash of the id.

    Three quarters of them are counted, the rest set the curve; its constant is corrected for the classes' true shares.
    Null labels, ids and texts are left out; of rows that share an id the least text and label count; without documents
    of both classes there is no model.
    """
    named = labels.select(F.col(quoted(doc_id)).alias("__id"), F.col(quoted(label)).cast("int").alias("__label")).dropna().where("__label in (0, 1)")
    true = {r["__label"]: r["count"] for r in named.groupBy("__label").count().collect()}
    parts = [named.where(F.col("__label") == k).orderBy(F.xxhash64("__id"), "__id").limit(most[k]) for k in (0, 1)]
    rows = docs.select(F.col(quoted(doc_id)).alias("__id"), F.col(quoted(text)).alias("__text")).where("__text is not null")
    rows = rows.join(F.broadcast(parts[0].unionByName(parts[1])), "__id").groupBy("__id").agg(F.min(F.struct("__text", "__label")).alias("x"))
    rows = durable(rows.select("x.__text", "x.__label", (F.pmod(F.xxhash64("__id", F.lit(1)), F.lit(4)) == 0).alias("__held")))
    pairs = _pair_counts(rows.where("not __held")).orderBy("before", "word").toArrow()
    counts = tuple(pairs[x].to_numpy() for x in ("ordinary", "toxic"))
    if not all(x.sum() for x in counts):
        return None
    models = learn_models(*(pairs[x].to_numpy().view(np.uint64) for x in ("before", "word")), counts)
    del pairs, counts
    found = _with_features(rows.where("__held").select("__text", "__label"), "__text", models, ("__text",)).toArrow()
    y = found["__label"].to_numpy().astype(np.float64)
    seen = {k: int((y == k).sum()) for k in (0, 1)}
    if not all(seen.values()):
        return None
    weight = np.array([true[int(k)] / sum(true.values()) / seen[int(k)] for k in y]) * len(y)
    models.curve = tuple(logistic(np.stack([found[x].to_numpy() for x in MEASURED], axis=1), y, weight).tolist())
    return models


def _with_features(rows: DataFrame, text: str, models: Models, drop: tuple[str, ...]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(models)  # bounded by the sampled documents' pairs

    def make() -> Callable:
        def compute(texts):
            raw = as_bytes(texts)
            found = np.concatenate([np.zeros((0, 3)), *(measured(sent.value, raw[lo : lo + TOGETHER]) for lo in range(0, len(raw), TOGETHER))])
            return tuple(found.T)

        return compute

    return append_columns(rows, [text], {x: "double" for x in MEASURED}, make, drop=drop)


def score_toxicity(docs: DataFrame, models: Models | None, text: str = "text", threshold: float = THRESHOLD, drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with score (0 to 1, higher is likelier toxic) and predicted (1 from `threshold` on).

    Null and wordless texts are scored by the constant alone; without a model every score is 0. Equal texts get equal
    scores. Texts of any length are scored whole. Repeated rows each get their row; an empty table gives an empty one;
    columns of `docs` called score or predicted are replaced.
    """
    gone = {"score", "predicted", *(x.lower() for x in drop)}
    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() not in gone]
    if models is None:
        return docs.select(*kept, F.lit(0.0).alias("score"), F.lit(int(0 >= threshold)).alias("predicted"))
    *weights, constant = models.curve
    inner = [f"__{i}" for i in range(len(kept))]
    plain = docs.select(*[c.alias(i) for c, i in zip(kept, inner)], F.col(quoted(text)).alias("__text"))
    found = _with_features(plain, "__text", models, ("__text",))
    score = F.round(1 / (1 + F.exp(-(sum(F.col(x) * w for x, w in zip(MEASURED, weights)) + constant))), 6)
    names = [c for c in docs.columns if c.lower() not in gone]
    return found.select(*[F.col(i).alias(c) for i, c in zip(inner, names)], score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = learn_toxicity(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 4) != 2))
    asked = docs.select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out"))
    return score_toxicity(asked, models, drop=("text",))
