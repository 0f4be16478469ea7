"""Language identification by hyperdimensional profiles.

Every letter of any script has a random vector of +-1. A trigram's vector binds (multiplies) its letters' vectors, the
first permuted twice and the second once; a text's vector bundles (adds) its trigrams' vectors, and a language's prototype
bundles those of its training texts. The language of the closest prototype by cosine is predicted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstead.llm.common import append_columns, batch_of, ddl, fold, quoted, remember, table

DIMENSIONS = 1024
SEED = 20
#: Bound on learned languages, checked: above the number of languages that have a code, and 80 MB of prototypes.
MAX_LANGUAGES = 20_000
#: Trigram vectors that a Python worker remembers (40 MB), places to look them up, vectors that are added at once, languages
#: that a task holds.
REMEMBERED, PLACES, TOGETHER, HELD = 40_000, 1 << 20, 1024, 2048
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def trigrams(text: str | None) -> np.ndarray:
    """The trigrams of the lower-cased words, each word with a gap (0) before and after; none without a letter.

    A trigram is its three code points, 21 bits each.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbols = np.zeros(len(points) + 2, dtype=np.int64)
    symbols[1:-1] = np.where(_letters()[points], points, 0)
    symbols = symbols[np.r_[True, (symbols[1:] != 0) | (symbols[:-1] != 0)]]
    return symbols[:-2] << 42 | symbols[1:-1] << 21 | symbols[2:]


def _bits(letters: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Random bits of each letter, from a hash of its code point."""
    x = letters.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(seed << 20, (seed << 20) + dimensions // 64, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)


class Profiles:
    """Vectors of trigrams: made when asked for, and a bounded number remembered."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED, remembered: int = REMEMBERED) -> None:
        self.dimensions, self.seed = dimensions, seed
        self.keys, self.row = np.full(PLACES, -1, dtype=np.int64), np.zeros(PLACES, dtype=np.int32)
        self.vectors, self.used = np.empty((remembered, dimensions), dtype=np.int8), 0
        # rows that are added at once; memory that is used again costs much less than new
        self.rows, self.wide = np.empty((TOGETHER, dimensions), dtype=np.int8), np.empty((TOGETHER, dimensions), dtype=np.float32)

    def fresh(self, codes: np.ndarray) -> np.ndarray:
        """Binding +-1 by multiplication is binding their bits by exclusive or."""
        letter = lambda shift: _bits(codes >> shift & 0x1FFFFF, self.dimensions, self.seed)
        bound = letter(0) ^ np.roll(letter(21), 1, axis=1) ^ np.roll(letter(42), 2, axis=1)
        return 1 - 2 * bound.astype(np.int8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The int8 vectors of at most TOGETHER distinct trigrams; valid until the next call."""
        places = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % PLACES
        out = np.take(self.vectors, self.row[places], axis=0, out=self.rows[: len(codes)], mode="clip")
        missing = np.flatnonzero(self.keys[places] != codes)
        if len(missing):
            out[missing] = self.fresh(codes[missing])
            # a free place goes to the first that asks for it; what finds none is made again each time
            place, first = np.unique(places[missing], return_index=True)
            free = np.flatnonzero(self.keys[place] < 0)[: len(self.vectors) - self.used]
            place, first, rows = place[free], first[free], np.arange(self.used, self.used + len(free))
            self.keys[place], self.row[place], self.vectors[rows] = codes[missing[first]], rows, out[missing[first]]
            self.used += len(free)
        return out

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The exact sum of the vectors of distinct trigrams by their counts."""
        total = np.zeros(self.dimensions)
        exact = counts.sum() < 1 << 24  # then every sum is a whole number that a float32 holds
        for lo in range(0, len(codes), TOGETHER):
            rows = self.of(codes[lo : lo + TOGETHER])
            if exact:
                np.copyto(self.wide[: len(rows)], rows)
                total += counts[lo : lo + TOGETHER].astype(np.float32) @ self.wide[: len(rows)]
            else:
                total += counts[lo : lo + TOGETHER].astype(np.float64) @ rows.astype(np.float64)
        return total


def profiles() -> Profiles:
    """One for each Python worker, as long as it serves this operator."""
    return remember(Profiles)


def learn_languages(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """A unit prototype for each non-null language, bundled over all of `docs`.

    Bundling is linear: each task adds up a vector for each language, and Spark adds those, so what moves is independent
    of the number of documents. Null texts and languages teach nothing.
    """
    schema = {"lang": "string", "at": "int", "value": "double"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = profiles(), {}

        def out() -> Iterator[pa.RecordBatch]:
            for name, vector in sums.items():
                yield batch_of(schema, [[name] * len(vector), np.arange(len(vector), dtype=np.int32), vector])
            sums.clear()

        for whole in batches:
            for lo in range(0, len(whole), 500):
                batch, found = whole.slice(lo, 500), {}
                for body, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found.setdefault(name, []).append(trigrams(body))
                for name, parts in found.items():
                    codes, counts = np.unique(np.concatenate(parts), return_counts=True)
                    sums[name] = sums.get(name, 0.0) + vectors.bundle(codes, counts)
                if len(sums) > HELD:
                    yield from out()
        yield from out()

    rows = docs.select(F.col(quoted(text)).alias("text"), F.col(quoted(lang)).cast("string").alias("lang")).where("text is not null and lang is not null")
    # sums of whole numbers are exact, so the order of the tasks doesn't matter
    summed = rows.mapInArrow(run, ddl(schema)).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for row in summed.toLocalIterator():
        if row.lang not in out and len(out) == MAX_LANGUAGES:
            raise ValueError(f"over {MAX_LANGUAGES} languages")
        out.setdefault(row.lang, np.zeros(DIMENSIONS))[row["at"]] = row.value
    return {name: vector / max(np.linalg.norm(vector), 1e-12) for name, vector in sorted(out.items())}


def identify_language(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with lang_pred and score, the cosine with the closest prototype (0 where negative).

    Null, empty and letterless texts, and all texts where nothing was learned, get `und` and 0. Of equally close languages
    the first by name wins. Repeated rows each get their row; an empty table gives an empty one; columns of `docs` called
    lang_pred or score are replaced. Texts of any length are read whole; a long one is bundled in parts.
    """
    names = sorted(prototypes)
    sent = docs.sparkSession.sparkContext.broadcast(np.array([prototypes[x] for x in names], dtype=np.float32))  # at most MAX_LANGUAGES rows

    def make() -> Callable:
        matrix, vectors = sent.value, profiles()

        def one(body: str | None) -> tuple[str, float]:
            codes, counts = np.unique(trigrams(body), return_counts=True)
            if not len(codes) or not names:
                return UNKNOWN, 0.0
            vector = vectors.bundle(codes, counts)
            cosines = (matrix @ (vector / max(float(np.linalg.norm(vector)), 1e-12)).astype(np.float32)).round(6)
            best = int(np.argmax(cosines))
            return names[best], min(1.0, max(0.0, float(cosines[best])))

        def compute(texts: pa.Array):
            found = [one(texts[i].as_py()) for i in range(len(texts))]
            return [x for x, _ in found], [x for _, x in found]

        return compute

    return append_columns(docs, [text], {"lang_pred": "string", "score": "double"}, make, drop=drop)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = learn_languages(docs.where(fold("doc_id", 5) != 0))
    asked = docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    return identify_language(asked, learned, drop=("text",))
