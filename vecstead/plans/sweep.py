"""Sweeps: every measure of every cell of a grid, and so a stability-memory table that this library computes itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecstead.functions.vectors import quantized, section
from vecstead.operators import align, compress, downstream, measures

MEASURES = ("eis", "knn", "sem_disp", "pip", "eigen_overlap")


def measure_row(quads: DataFrame, nquery: int, k: int, queries: DataFrame | None = None) -> dict[str, float]:
    """All measures of one pair with its anchors (rank, word, x, y, e, f): three passes, of which one is for all spectral ones."""
    found, rotation = measures.spectral(quads)
    pairs = quads.select("rank", "word", "x", "y")
    return found | {"knn": measures.knn(pairs, nquery, k, queries=queries).first().knn, "sem_disp": measures.sem_disp(pairs, rotation=rotation).first().sem_disp}


def downstream_row(first: DataFrame, second: DataFrame, tasks: dict[str, tuple[DataFrame, DataFrame]]) -> dict[str, float]:
    """For each task (train, test; example_id, text, label) the disagreement of two versions' models, and the first's accuracy, in per cent."""
    row = {}
    for name, (train, test) in tasks.items():
        models = [downstream.train_and_predict(train, test, emb).persist() for emb in (first, second)]
        row[name] = downstream.disagreement(*models).first().disagreement
        right = models[0].join(test.select("example_id", "label"), "example_id")
        row[f"{name}_quality"] = right.agg(F.avg((F.col("pred") == F.col("label")).cast("double")) * 100).first()[0]
        for model in models:
            model.unpersist()
    return row


def compressed_sweep(
    first: DataFrame,
    second: DataFrame,
    dims: list[int],
    bitrates: list[int],
    n: int = 10_000,
    nquery: int = 1000,
    k: int = 5,
    tasks: dict[str, tuple[DataFrame, DataFrame]] | None = None,
    keep: Callable[[dict], None] | None = None,
) -> DataFrame:
    """(dim, bitrate, space, measures, tasks and their qualities) of two versions cut to their first `dim` entries, aligned and quantized.

    The pair is joined once, on its n commonest shared words, and kept with its vectors for all cells: each cell is columns
    of that table. The cells are few and the driver goes through them; what each collects is of its width.
    """
    base = align.shared(second, first, n).select("rank", "word", F.col("x").alias("e"), F.col("y").alias("f")).persist()
    every = align.shared(second, first).select(F.col("x").alias("e"), F.col("y").alias("f")) if n > 0 else base
    rows = []
    try:
        for dim in dims:
            cut = [section(c, 1, dim).alias(name) for c, name in (("e", "x"), ("f", "y"))]
            rotation = measures.procrustes(every.select(*cut))
            moved = measures.rotate(base.select("*", *cut), "x", rotation, "x").persist()
            old = first.withColumn("vec", section("vec", 1, dim))
            for bits in bitrates:
                bound = compress.best_bound(old, bits)
                quads = moved.select("rank", "word", quantized("x", bits, bound).alias("x"), quantized("y", bits, bound).alias("y"), "e", "f")
                row = {"dim": dim, "bitrate": bits, "space": dim * bits} | measure_row(quads, nquery, k)
                if tasks:
                    row |= downstream_row(*(quads.select("rank", "word", F.col(side).alias("vec")) for side in ("x", "y")), tasks)
                rows.append(row)
                if keep:
                    keep(row)
            moved.unpersist()
    finally:
        base.unpersist()
    names = ["dim", "bitrate", "space", *MEASURES, *[c for t in tasks or {} for c in (t, f"{t}_quality")]]
    return first.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in rows], ", ".join(f"{c} {'int' if c in ('dim', 'bitrate', 'space') else 'double'}" for c in names))
