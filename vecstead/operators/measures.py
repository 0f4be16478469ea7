"""Distances between two versions of an embedding. Pairs are (rank, word, x, y), as `align.shared` makes them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecstead.functions.shared import durable
from vecstead.functions.vectors import cosine_distance, squared_difference
from vecstead.operators import align
from vecstead.operators.gram import gram, matrix, rotate, triangular
from vecstead.operators.neighbours import PRODUCTS, best_of, unit

#: Singular values under this share of the largest count as zero, as their directions are arbitrary.
RANK_TOLERANCE = 1e-12
#: Numbers of the queries that one pass over the candidates carries.
QUERY_CELLS = 8_000_000


def value(spark, name: str, number: float) -> DataFrame:
    return spark.createDataFrame([(float(number),)], f"{name} double")


def fro_norm(pairs: DataFrame) -> DataFrame:
    """Frobenius norm of the difference; lengths must agree."""
    same = F.when(F.size("x") == F.size("y"), squared_difference("x", "y")).otherwise(F.raise_error(F.lit("dimensions differ")).cast("double"))
    return pairs.agg(F.sqrt(F.sum(same)).alias("fro_norm"))


def pip_loss(pairs: DataFrame) -> float:
    """||XX' - YY'||, without the n x n kernels.

    Equal widths go through D = X - Y and S = X + Y, as ||XX' - YY'||^2 = (tr(D'D S'S) + tr((D'S)^2)) / 2, which is exact
    for near-identical pairs and zero for equal ones.
    """
    return _contrasted(pairs, ["x", "y"])[0]


def _contrasted(df: DataFrame, columns: list[str]) -> tuple[float, list[np.ndarray]]:
    """pip_loss, and the blocks of each column, from one factor."""
    r, sizes = triangular(df, columns, contrast=True)
    edges = np.cumsum([0, *sizes])
    x, y, *rest = (r[:, a:b] for a, b in zip(edges[:-1], edges[1:]))
    if sizes[0] != sizes[1]:
        return float(np.linalg.norm(x @ x.T - y @ y.T)), [x, y, *rest]
    d, s = x, y
    ds = d.T @ s
    loss = float(np.sqrt(max(0.0, (np.sum((d.T @ d) * (s.T @ s)) + np.sum(ds * ds.T)) / 2)))
    return loss, [(s + d) / 2, (s - d) / 2, *rest]


def _basis(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left singular vectors and singular values of a block, without the null directions."""
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    keep = s > RANK_TOLERANCE * max(s.max(initial=0.0), 1e-300)
    return u[:, keep], s[keep]


def _blocks(df: DataFrame, columns: list[str]) -> list[np.ndarray]:
    """The factor's columns for each array column; they span what the array columns span, by an orthogonal map."""
    r, sizes = triangular(df, columns)
    edges = np.cumsum([0, *sizes])
    return [r[:, a:b] for a, b in zip(edges[:-1], edges[1:])]


def eigen_overlap(pairs: DataFrame) -> float:
    """||U_x' U_y||^2 over the larger width; 1 is most stable."""
    return overlap_of(*_blocks(pairs, ["x", "y"]))


def overlap_of(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.linalg.norm(_basis(x)[0].T @ _basis(y)[0]) ** 2 / max(x.shape[1], y.shape[1]))


def weighted_eigen_overlap(pairs: DataFrame, exp: float = 1, normalize: bool = True) -> float:
    """||U_x' U_y S_y^exp||^2, over the sum of S_y^(2 exp) if normalized."""
    x, y = _blocks(pairs, ["x", "y"])
    (u, _), (v, s) = _basis(x), _basis(y)
    found = np.linalg.norm((u.T @ v) * s**exp) ** 2
    return float(found / np.sum(s ** (2 * exp)) if normalize else found)


def eis(quads: DataFrame, exp: float = 3) -> float:
    """Eigenspace instability of x and y against the anchors e and f; 0 is most stable."""
    return eis_of(*_blocks(quads, ["x", "y", "e", "f"]), exp=exp)


def eis_of(x: np.ndarray, y: np.ndarray, *anchors: np.ndarray, exp: float = 3) -> float:
    u1, u2 = _basis(x)[0], _basis(y)[0]
    apart, scale = 0.0, 0.0
    for anchor in anchors:
        v, s = _basis(anchor)
        a, b = (u1.T @ v) * s**exp, (u2.T @ v) * s**exp
        apart += np.sum(a * a) + np.sum(b * b) - 2 * np.sum(b * ((u2.T @ u1) @ a))
        scale += np.sum(s ** (2 * exp))
    return float(apart / scale)


def procrustes(pairs: DataFrame) -> np.ndarray:
    """The orthogonal R that takes x closest to y; it may reflect."""
    g, (x, _) = gram(pairs, ["x", "y"])
    u, _, vt = np.linalg.svd(g[:x, x:])
    return u @ vt


def spectral(quads: DataFrame, exp: float = 3) -> tuple[dict[str, float], np.ndarray]:
    """eis, pip and eigen_overlap of x and y, and the rotation of x onto y, from one factor and so from one pass."""
    loss, (x, y, e, f) = _contrasted(quads, ["x", "y", "e", "f"])
    u, _, vt = np.linalg.svd(x.T @ y)
    return {"eis": eis_of(x, y, e, f, exp=exp), "pip": loss, "eigen_overlap": overlap_of(x, y)}, u @ vt


def align_to(emb: DataFrame, reference: DataFrame) -> DataFrame:
    """`emb` rotated onto `reference`: fitted on the shared words, applied to all rows."""
    return rotate(emb, "vec", procrustes(align.shared(emb, reference)), "vec")


def sem_disp_words(pairs: DataFrame, aligned: bool = True, rotation: np.ndarray | None = None) -> DataFrame:
    """(rank, word, distance): each word's cosine distance, x rotated onto y first if `aligned`; null for zero vectors."""
    if aligned:
        pairs = rotate(pairs, "x", procrustes(pairs) if rotation is None else rotation, "x")
    return pairs.select("rank", "word", cosine_distance("x", "y").alias("distance"))


def sem_disp(pairs: DataFrame, aligned: bool = True, rotation: np.ndarray | None = None) -> DataFrame:
    return sem_disp_words(pairs, aligned, rotation).agg(F.avg("distance").alias("sem_disp"))


def nearest(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, rank, similarity, place): of each query the k candidates of the highest cosine, itself left out, ties by rank.

    Both are (rank, vec). Every task takes the products of its candidates with all queries and keeps k for each, so only
    those meet. Queries are dealt to blocks of about QUERY_CELLS numbers by hash; each block is fetched when its pass
    begins, and where there are several the passes' results are checkpointed between them.
    """
    schema = "query bigint, rank bigint, similarity double"
    spark, asked = candidates.sparkSession, queries.select("rank", "vec")
    cells = asked.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()[0]
    blocks = -(-cells // QUERY_CELLS)

    def one(number: int) -> DataFrame:
        held = asked.where(F.pmod(F.xxhash64("rank"), F.lit(blocks)) == number).orderBy("rank").toArrow().combine_chunks()
        ids = held["rank"].to_numpy()
        sent = spark.sparkContext.broadcast((ids, unit(matrix(pa.RecordBatch.from_arrays([held["vec"].chunk(0)], ["vec"]), [0])) if len(ids) else np.zeros((0, 0))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = sent.value
            if not len(ids):
                return
            held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))  # of all queries: row, rank, similarity
            least = np.full(len(ids), -np.inf)
            step = max(1, PRODUCTS // len(ids))
            for batch in batches:
                for lo in range(0, len(batch), step):
                    part = batch.slice(lo, step)
                    rank = part.column(0).to_numpy()
                    found = vectors @ unit(matrix(part, [1])).T
                    found[ids[:, None] == rank[None, :]] = -np.inf
                    row, near, value = (np.concatenate(x) for x in zip(held, best_of(found, rank, k, least)))
                    order = np.lexsort((near, -value, row))
                    row, near, value = row[order], near[order], value[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    least[row[place == k - 1]] = value[place == k - 1]
                    held = row[place < k], near[place < k], value[place < k]
            yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], names=["query", "rank", "similarity"])

        return candidates.select("rank", "vec").mapInArrow(run, schema)

    if not blocks:
        return spark.createDataFrame([], f"{schema}, place int")
    found = one(0)
    if blocks > 1:
        found = reduce(DataFrame.unionByName, (durable(one(number)) for number in range(blocks)))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "rank"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def draw(ranks: DataFrame, n: int, seed: int = 1234) -> DataFrame:
    """`n` of `ranks` (rank), by the md5 of the rank and the seed."""
    return ranks.select("rank").orderBy(F.md5(F.concat(F.col("rank").cast("string"), F.lit(str(seed)))), "rank").limit(n)


def knn(pairs: DataFrame, nquery: int = 1000, k: int = 5, seed: int = 1234, queries: DataFrame | None = None) -> DataFrame:
    """Mean share of the k nearest neighbours that x and y have in common, over `queries` (rank) or `nquery` drawn by hash."""
    if queries is None:
        queries = draw(pairs, nquery, seed)
    asked = pairs.join(F.broadcast(queries.select("rank")), "rank", "left_semi")
    sides = []
    for side in ("x", "y"):
        found = nearest(pairs.select("rank", F.col(side).alias("vec")), asked.select("rank", F.col(side).alias("vec")), k)
        sides.append(found.groupBy("query").agg(F.collect_set("rank").alias(side)))
    both = sides[0].join(sides[1], "query")
    return both.agg(F.avg(F.size(F.array_intersect("x", "y")) / F.lit(float(k))).alias("knn"))
