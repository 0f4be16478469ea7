"""Quality by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstead.llm.common import append_columns, as_bytes, fold, quoted, remember, table

#: Bounds of the fit: labelled rows that are sampled for it, terms, latent dimensions.
MAX_LABELLED = 6_000
TERMS = 4096
LATENT = 32
NEIGHBOURS = 25
THRESHOLD = 0.3
#: Documents whose cosines with all labelled vectors are computed at once.
BLOCK = 256

_SPREAD = np.uint32(2654435761)


def recurrences(words: list[bytes]) -> np.ndarray:
    """How far back each word last occurred, in powers of two; 0 where it is new."""
    n = len(words)
    first = np.fromiter(map({}.setdefault, words, range(n)), dtype=np.int64, count=n)
    order = np.argsort(first, kind="stable")
    same = first[order[1:]] == first[order[:-1]]
    gap = np.zeros(n, dtype=np.int64)
    gap[order[1:][same]] = (order[1:] - order[:-1])[same]
    return np.frexp(gap.astype(np.float64))[1]


def term_counts(raw: bytes | None) -> np.ndarray:
    """How often each hashed term occurs in the whole text. Terms are byte pairs, words, and words' recurrences."""
    codes, words = np.frombuffer(raw or b"", dtype=np.uint8).astype(np.uint32), (raw or b"").split()
    spelt = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
    hashed = np.concatenate([codes[:-1] * np.uint32(256) + codes[1:], spelt, recurrences(words).astype(np.uint32) + np.uint32(1 << 24)])
    return np.bincount((hashed * _SPREAD) >> np.uint32(16) & np.uint32(TERMS - 1), minlength=TERMS).astype(np.float32)


@dataclass
class Neighbours:
    """Weights by rarity, the latent space, and the labelled vectors in it (rows of unit length)."""

    rarity: np.ndarray
    space: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, terms: np.ndarray) -> np.ndarray:
        out = unit(terms * self.rarity) @ self.space
        return unit(out)

    def score(self, terms: np.ndarray) -> np.ndarray:
        """The neighbours' mean label by similarity; the mean of all labels for a text without terms."""
        cosines = (self.latent(terms) @ self.vectors.T).round(6)
        nearest = nearest_rows(cosines, min(NEIGHBOURS, cosines.shape[1]))
        weight = np.maximum(np.take_along_axis(cosines, nearest, axis=1), 0.0).astype(np.float64) ** 8
        total = weight.sum(axis=1)
        voted = (weight * self.labels[nearest]).sum(axis=1)
        return np.where(total > 1e-9, voted / np.maximum(total, 1e-9), self.labels.mean())


def nearest_rows(cosines: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k greatest values of each row; of equal ones the first. In the order of the columns."""
    least = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
    above, equal = cosines > least, cosines == least
    taken = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return np.nonzero(taken)[1].reshape(-1, k)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def fit_neighbours(terms: np.ndarray, labels: np.ndarray, latent: int = LATENT, seed: int = 4, spare: bool = True) -> Neighbours:
    """A truncated SVD of the labelled rows by subspace iteration; `terms` has a row for each, and is written over unless spared.

    Rows are weighted a block at a time, so that no second table of their size is held.
    """
    blocks = [slice(lo, lo + BLOCK) for lo in range(0, len(terms), BLOCK)]
    rarity = np.log((1 + len(terms)) / (1 + sum(np.count_nonzero(terms[x], axis=0) for x in blocks))).astype(np.float32) + 0.5
    rows = terms.copy() if spare else terms
    for x in blocks:
        rows[x] = unit(rows[x] * rarity)
    width = min(latent + 16, *rows.shape)
    basis = np.linalg.qr(rows.T @ (rows @ np.random.default_rng(seed).standard_normal((rows.shape[1], width), dtype=np.float32)))[0]
    for _ in range(3):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    right = np.linalg.svd(rows @ basis, full_matrices=False)[2]
    space = (basis @ right.T)[:, :latent].astype(np.float32)
    return Neighbours(rarity, space, unit(rows @ space), labels.astype(np.float64))


def labelled_terms(docs: DataFrame, labels: DataFrame, label: str, limit: int = MAX_LABELLED, text: str = "text", doc_id: str = "doc_id") -> tuple[np.ndarray, np.ndarray]:
    """Terms and labels of at most `limit` labelled documents, drawn by the hash of the id. Null labels, ids and texts are left out.

    Ids are drawn before the join, and rows again after it, so ids that repeat in either table don't pass the bound.
    """
    chosen = labels.select(F.col(quoted(doc_id)).alias("__id"), F.col(quoted(label)).cast("int").alias("__label")).dropna()
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "__label").limit(limit)
    picked = docs.select(F.col(quoted(doc_id)).alias("__id"), F.col(quoted(text)).alias("__text")).where("__text is not null")
    both = picked.join(F.broadcast(chosen), "__id")

    def make() -> Callable:
        def packed(raw: bytes) -> bytes:
            counts = term_counts(raw)
            at = np.flatnonzero(counts)
            return at.astype("<i4").tobytes() + counts[at].astype("<f4").tobytes()

        remember()
        return lambda texts: ([packed(x) for x in as_bytes(texts)],)

    found = append_columns(both, ["__text"], {"__terms": "binary"}, make, drop=("__text",))
    found = found.orderBy(F.xxhash64("__id"), "__id", "__terms", "__label").limit(limit).toArrow()
    terms = np.zeros((len(found), TERMS), dtype=np.float32)
    for i, raw in enumerate(found["__terms"].to_pylist()):
        half = len(raw) // 2
        terms[i, np.frombuffer(raw[:half], dtype="<i4")] = np.frombuffer(raw[half:], dtype="<f4")
    return terms, found["__label"].to_numpy()


def score_quality(docs: DataFrame, model: Neighbours | None, text: str = "text", threshold: float = THRESHOLD, drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from `threshold` on), by exact cosines with every labelled vector.

    Null and empty texts have no terms and get the mean label; without any labelled row (`model` None) every score is 0.5.
    Of equally close labelled rows the first vote, in the order of the hash of their ids. Long texts are counted whole.
    Repeated rows each get their row; an empty table gives an empty one; columns of `docs` called score or predicted are
    replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MAX_LABELLED * LATENT + TERMS * (LATENT + 1) floats

    def make() -> Callable:
        remember()
        neighbours = sent.value

        def compute(texts: pa.Array):
            raw, scores = as_bytes(texts), []
            for lo in range(0, len(raw), BLOCK):
                part = raw[lo : lo + BLOCK]
                # a block has always BLOCK rows, so that equal texts get equal scores wherever they stand
                terms = np.zeros((BLOCK, TERMS), dtype=np.float32)
                for i, x in enumerate(part):
                    terms[i] = term_counts(x)
                scores += ([0.5] * BLOCK if neighbours is None else neighbours.score(terms).round(6).tolist())[: len(part)]
            return scores, [int(x >= threshold) for x in scores]

        return compute

    return append_columns(docs, [text], {"score": "double", "predicted": "int"}, make, drop=drop)


def learn_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", **options) -> Neighbours | None:
    terms, found = labelled_terms(docs, labels, label, **options)
    pa.default_memory_pool().release_unused()
    return fit_neighbours(terms, found, spare=False) if len(found) else None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn_quality(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    asked = docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    return score_quality(asked, model, drop=("text",))
