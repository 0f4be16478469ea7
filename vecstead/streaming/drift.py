"""A drift monitor over a stream, an addition of this engine: windowed moments of values that arrive late by a bounded time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import LongType, StructField, StructType

from vecstead.operators.gram import matrix


def windowed_moments(events: DataFrame, time: str, key: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n, total, squares) in tumbling windows; sums merge, so partial results of a window just add."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    x = F.col(value).cast("double")
    return marked.groupBy(F.window(time, window).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.sum(x * x).alias("squares")).select(F.col("w.start").alias("start"), "key", "n", "total", "squares")


def run_to_end(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """What a finite stream has produced once all of it was read: the last row of each of `keys`.

    Every batch's changed rows are written under its number in `folder`, which also holds the checkpoint, so a batch that
    runs again replaces its own rows. State and rows older than the watermark are dropped.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark, names = stream.sparkSession, [c for c in stream.columns if c not in keys]
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(f"{folder}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("x")).select(*keys, *[F.col("x")[c].alias(c) for c in names]).select(*stream.columns)


# Drift of vectors. The state of a window is the Gram matrix of the differences and sums of two versions' vectors.

_PARTIAL = "start timestamp, end timestamp, n bigint, width int, cells binary"
_DRIFT = "start timestamp, n bigint, pip double, eigen_overlap double"


def _inverse_root(g: np.ndarray) -> np.ndarray:
    """g to the power -1/2 on the directions it has."""
    values, vectors = np.linalg.eigh(g)
    keep = values > 1e-12 * max(values.max(initial=0.0), 1e-300)
    return vectors[:, keep] / np.sqrt(values[keep])


def drift_of(g: np.ndarray) -> tuple[float, float]:
    """The inner-product loss and the eigenspace overlap of x and y from the Gram matrix of [x - y, x + y]."""
    d = len(g) // 2
    dd, ds, ss = g[:d, :d], g[:d, d:], g[d:, d:]
    pip = np.sqrt(max(0.0, (np.sum(dd * ss) + np.sum(ds * ds.T)) / 2))
    xx, yy, xy = (dd + ds + ds.T + ss) / 4, (dd - ds - ds.T + ss) / 4, (ss - dd + ds - ds.T) / 4
    overlap = np.linalg.norm(_inverse_root(xx).T @ xy @ _inverse_root(yy)) ** 2 / d
    return float(pip), float(overlap)


def gram_drift(pairs: DataFrame, window: str, late: str) -> DataFrame:
    """(start, n, pip, eigen_overlap) of each tumbling window of the stream `pairs` (ts, x, y), once the window has ended.

    Tasks reduce a batch to one Gram matrix for each window, so a busy window costs its state a few rows a batch. A window
    ends when events are `late` and a window's length past its end; then its measures come out, its state goes, and later
    rows of it are dropped. Rows that come before that count, whatever their order.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            if not len(batch):
                continue
            x, y = matrix(batch, [2]), matrix(batch, [3])
            z = np.concatenate([x - y, x + y], axis=1)
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            names = list(dict.fromkeys(keys))
            number = {k: i for i, k in enumerate(names)}
            at = np.array([number[k] for k in keys])
            for i, key in enumerate(names):
                part = z[at == i]
                old = held.get(key)
                held[key] = [len(part) + (old[0] if old else 0), part.T @ part + (old[1] if old else 0)]
        rows = [(*k, n, len(g), g.tobytes()) for k, (n, g) in held.items()]
        kinds = [pa.timestamp("us", "UTC"), pa.timestamp("us", "UTC"), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], names=["start", "end", "n", "width", "cells"])

    def merge(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, width, cells = state.get
            state.remove()
            yield pd.DataFrame([(key[0], n, *drift_of(np.frombuffer(cells).reshape(width, width)))], columns=["start", "n", "pip", "eigen_overlap"])
            return
        n, width, total = 0, 0, None
        if state.exists:
            n, width, cells = state.get
            total = np.frombuffer(cells).reshape(width, width)
        for part in rows:
            for m, width, cells in zip(part["n"], part["width"], part["cells"]):
                g = np.frombuffer(cells).reshape(width, width)
                n, total = n + int(m), g if total is None else total + g
        state.update((n, int(width), total.tobytes()))
        state.setTimeoutTimestamp(int(key[1].timestamp() * 1000))

    w = F.window("ts", window)
    parts = pairs.select(w.alias("w"), "x", "y").select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "x", "y").mapInArrow(partial, _PARTIAL)
    # a window's rows have its end for their time, so the stream's time runs ahead of theirs by a window's length at most
    marked = parts.withWatermark("end", f"{late} {window}")
    return marked.groupBy("start", "end").applyInPandasWithState(merge, _DRIFT, "n bigint, width int, cells binary", "append", "EventTimeTimeout")


def ended_windows(stream: DataFrame, folder: str) -> DataFrame:
    """What windows a finite stream has ended once all of it was read; `folder` keeps the rows and the checkpoint, so a later call goes on."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
