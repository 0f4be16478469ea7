"""One-dimensional k-means codebooks for quantization: exact on a mergeable histogram, all bitrates from one scan.

The histogram counts entries in equal bins of a range found before, with their sums, so each bin has its mean. Bins of tasks
add up in a shuffle. On the sorted bins the least squared error is found by dynamic programming: of the best cuts, those of
longer prefixes never lie earlier, so each level is divided and conquered. Entries of one bin share a level, which costs no
more than what they differ by within the bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecstead.operators.gram import matrix

#: Bins of the histogram.
BINS = 1 << 10


def histogram(emb: DataFrame, bins: int = BINS, column: str = "vec") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, sum, sum of squares) of the entries in equal bins between the least and the largest, without empty bins."""
    ends = emb.agg(F.min(F.array_min(column)).alias("a"), F.max(F.array_max(column)).alias("b")).first()
    if ends.a is None:
        return (np.zeros(0),) * 3
    low, width = float(ends.a), max((float(ends.b) - float(ends.a)) / bins, 1e-300)
    schema = "bin int, n double, total double, squares double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((3, bins))
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                z = matrix(batch.slice(lo, 4096), [0]).reshape(-1)
                at = np.minimum(((z - low) / width).astype(np.int64), bins - 1)
                sums += [np.bincount(at, weights=w, minlength=bins) for w in (np.ones(len(z)), z, z * z)]
        used = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(x[used]) for x in sums)], names=["bin", "n", "total", "squares"])

    rows = emb.select(column).mapInArrow(run, schema).groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")]).orderBy("bin").toArrow()
    return tuple(rows[c].to_numpy() for c in ("n", "total", "squares"))


def least_cuts(n: np.ndarray, total: np.ndarray, squares: np.ndarray, most: int) -> dict[int, tuple[np.ndarray, float]]:
    """For 1, 2, 4, ... up to `most` groups of neighbouring bins: the groups' means and their squared error, which is least."""
    if not len(n):
        return {}
    c, s, q = (np.r_[0.0, np.cumsum(x)] for x in (n, total, squares))
    size = len(n)

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        """Squared error of the bins from i up to, but not at, j."""
        return np.maximum(0.0, q[j] - q[i] - (s[j] - s[i]) ** 2 / np.maximum(c[j] - c[i], 1e-300))

    best = np.r_[0.0, [cost(np.array(0), j) for j in range(1, size + 1)]]
    cuts: list[np.ndarray] = [np.zeros(size + 1, dtype=np.int64)]
    out = {}

    def means(groups: int) -> np.ndarray:
        ends, j = [size], size
        for level in range(groups - 1, 0, -1):
            j = int(cuts[level][j])
            ends.append(j)
        edges = np.unique([0, *ends])
        return (s[edges[1:]] - s[edges[:-1]]) / (c[edges[1:]] - c[edges[:-1]])

    groups = 1
    while True:
        if groups & (groups - 1) == 0:
            out[groups] = (means(groups), float(best[size]))
        if groups >= most:
            return out
        groups += 1
        now, cut = np.full(size + 1, np.inf), np.zeros(size + 1, dtype=np.int64)
        now[0] = 0.0
        todo = [(1, size, 0, size - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(first, min(last, j - 1) + 1)
            ways = best[i] + cost(i, j)
            at = int(np.argmin(ways))
            now[j], cut[j] = ways[at], i[at]
            todo += [(lo, j - 1, first, int(i[at])), (j + 1, hi, int(i[at]), last)]
        best = now
        cuts.append(cut)


def codebooks(emb: DataFrame, bitrates: list[int], bins: int = BINS, column: str = "vec") -> dict[int, np.ndarray]:
    """The ascending levels of each bitrate (at most 2^bits; 8 bits at most), from one scan and the range."""
    if max(bitrates) > 8:
        raise ValueError("codebooks are for 8 bits at most")
    found = least_cuts(*histogram(emb, bins, column), most=2 ** max(bitrates))
    return {b: found[2**b][0] for b in bitrates} if found else {b: np.zeros(1) for b in bitrates}


def to_levels(x: Column | str, levels: np.ndarray) -> Column:
    """Each entry replaced by the nearest level, of two equally near ones the lower: a step for each midpoint, inside the JVM."""
    middle = [float(m) for m in (levels[1:] + levels[:-1]) / 2]
    table, steps = F.array(*[F.lit(float(v)) for v in levels]), F.array(*[F.lit(m) for m in middle]) if middle else None
    if steps is None:
        return F.transform(x, lambda a: F.lit(float(levels[0])))
    return F.transform(x, lambda a: F.element_at(table, (F.size(F.filter(steps, lambda m: m < a)) + 1).cast("int")))


def codebook_errors(emb: DataFrame, bitrates: list[int], bins: int = BINS) -> DataFrame:
    """(bits, levels, squared_error) of `emb` under the codebook of each bitrate, all errors in one more scan."""
    books = codebooks(emb, bitrates, bins)
    spark = emb.sparkSession
    sent = spark.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {b: 0.0 for b in sent.value}
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                z = matrix(batch.slice(lo, 4096), [0]).reshape(-1)
                for b, levels in sent.value.items():
                    at = np.searchsorted((levels[1:] + levels[:-1]) / 2, z, side="left")
                    total[b] += float(np.sum((levels[at] - z) ** 2))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()))], names=["bits", "error"])

    sizes = spark.createDataFrame([(b, len(v)) for b, v in books.items()], "bits int, levels int")
    errors = emb.select("vec").mapInArrow(run, "bits int, error double").groupBy("bits").agg(F.sum("error").alias("squared_error"))
    return sizes.join(errors, "bits")
