"""Approximate nearest neighbours by cosine: the exact search's cells, of which a query asks only the nearest few.

Rows are dealt to the nearest of some pivots, and a query asks the cells of the pivots nearest to it. How many is measured:
for a bounded sample of queries whose exact neighbours are found first, the least number that holds the wanted share of them
is taken, up to all. All rows are indexed. A query moves once to each group of blocks, however many of them it asks, and what
a task hands on is the best k of each query, never pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecstead.functions.shared import durable
from vecstead.operators.gram import matrix
from vecstead.operators.measures import draw, nearest
from vecstead.operators.neighbours import BLOCK, FOUND, _apart, _with_corner, nearest_of_all, pivots_of, unit

#: Cells that a table of few rows has about, rows of such a cell at least, and queries that the choice is made on.
CELLS, LEAST, SAMPLE = 64, 64, 200


def chosen(rows: DataFrame, pivots: np.ndarray, k: int, target: float, sample: int = SAMPLE) -> tuple[int, float]:
    """(probes, share of the sample's exact neighbours they hold): the fewest cells that reach `target`."""
    asked = durable(draw(rows, sample))
    exact = nearest(rows, rows.join(F.broadcast(asked), "rank", "left_semi"), k).select("query", "rank")
    pairs = exact.join(rows.select(F.col("rank").alias("query"), F.col("vec").alias("x")), "query").join(rows.select("rank", F.col("vec").alias("y")), "rank")
    held = pairs.select("x", "y").toArrow().combine_chunks()  # k for each of the sample at most
    if not len(held):
        return 1, 1.0
    (batch,) = held.to_batches()
    x, y = (_apart(_with_corner(unit(matrix(batch, [i]))), pivots) for i in (0, 1))
    there = np.take_along_axis(x, y.argmin(axis=1)[:, None], axis=1)
    needed = np.sort((x < there).sum(axis=1) + 1)  # cells up to the neighbour's own
    probes = int(needed[min(len(needed), int(np.ceil(target * len(needed) - 1e-9))) - 1])
    return probes, float((needed <= probes).mean())


def approximate_nearest(candidates: DataFrame, k: int, queries: DataFrame | None = None, target: float = 0.95) -> DataFrame:
    """(query, rank, similarity, place) of each query's k best among the rows of the cells it asks, itself left out, ties by rank.

    `candidates` are (rank, vec), vectors of one length and ranks distinct; `queries` (rank) are some of them, by default all.
    """
    rows = durable(candidates.select("rank", "vec"))
    n = rows.count()
    if not n:
        return candidates.sparkSession.createDataFrame([], f"{FOUND}, place int")
    block = min(BLOCK, max(LEAST, n // CELLS))
    probes, _ = chosen(rows, pivots_of(rows, n, block), k, target)
    return nearest_of_all(rows, k, queries, block, probes)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, recall): which share of `exact` (query, rank, ...) `found` has."""
    both = exact.select("query", "rank").join(found.select("query", "rank", F.lit(1).alias("hit")), ["query", "rank"], "left")
    return both.agg(F.countDistinct("query").alias("queries"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
