"""Connected components of an edge table: tasks contract their own edges, then large and small stars alternate; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecstead.llm.common import durable, give_back, remember
from vecstead.llm.trie import spanning

#: Edges that a task contracts at once, and about how many it is dealt. So few need one task and no shuffle; more of them meet by stars.
TOGETHER = 250_000


def _forest(edges: pa.Table, roots: bool = False) -> pa.Table:
    """(a, b) for each node of `edges` (a, b), the least of its component, b, only with `roots`."""
    nodes = pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks], edges.schema.field("a").type).combine_chunks().dictionary_encode()
    nodes = nodes.combine_chunks() if isinstance(nodes, pa.ChunkedArray) else nodes
    order, codes = pc.sort_indices(nodes.dictionary), nodes.indices.to_numpy()
    place = np.argsort(order.to_numpy())[codes]
    root = spanning(len(order), place[: len(edges)], place[len(edges) :])
    moved, names = np.flatnonzero(roots | (root != np.arange(len(root)))), nodes.dictionary.take(order)
    return pa.table({"a": names.take(pa.array(moved)), "b": names.take(pa.array(root[moved]))})


def _contracted(edges: DataFrame, together: int, roots: bool = False) -> DataFrame:
    """(a, b): a forest for each task's `edges` (a, b), or for each part of them that leaves over `together` edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember()
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size >= 2 * together:
                forest = _forest(pa.Table.from_batches(held), roots)
                held, size = forest.to_batches(), len(forest)
                if size > together:
                    yield from held
                    held, size = [], 0
        if size:
            yield from _forest(pa.Table.from_batches(held), roots).to_batches()
        give_back()

    return edges.mapInArrow(run, edges.schema)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60, together: int = TOGETHER) -> DataFrame:
    """(node, root) for every node of `edges` (a, b); the root is the component's least node.

    Every task contracts its edges first, so edges that one task holds (twice `together` at most) need no round, shuffle or
    further job of the driver. Of more, each round shortens every path by about half, so `rounds` is far above what any input
    needs; reaching it raises. An empty edge table gives an empty result.
    """
    edges = durable(edges.select("a", "b").where("a <> b"))
    tasks = max(1, edges.count() // together)
    forest = _contracted(edges.coalesce(tasks), together, roots=tasks == 1)
    if tasks > 1:
        stars = _stars(durable(forest), rounds)
        forest = stars.unionByName(stars.select(F.col("b").alias("a"), "b").distinct())
    return forest.toDF("node", "root")


def _stars(edges: DataFrame, rounds: int) -> DataFrame:
    """(a, b) for each node of `edges` (a, b) but the least of its component, which is b."""
    mark = None
    for _ in range(rounds):
        edges = durable(_small_star(_large_star(edges)))
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return edges
        mark = tuple(row)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def forest_roots(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b), in which each b occurs once and a is less: by doubling of the paths."""
    found = durable(links.select(F.col("b").alias("node"), F.col("a").alias("root")))
    while True:
        up = found.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        moved = durable(found.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        if moved.where("moved").isEmpty():
            return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
        found = moved.drop("moved")
