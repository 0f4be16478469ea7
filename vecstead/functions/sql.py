"""The measures in `spark.sql`: table functions over table arguments, and views of embeddings.

`gram_parts` reduces each partition of a table of pairs to one row, so a measure of any number of rows is two functions deep:

    SELECT pip, eigen_overlap FROM gram_measures(TABLE(
        SELECT * FROM gram_parts(TABLE(SELECT x, y, rank % 64 AS part FROM pairs) PARTITION BY part)) WITH SINGLE PARTITION)

The last function gets a row for each value of the partitioning column. With anchors e and f it gives `eis` too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

#: Rows that are reduced at once.
HELD = 2048


class GramParts:
    """(n, widths, cells): the triangular factor of [x - y, x + y, e, f] over the rows of a partition."""

    def __init__(self) -> None:
        self.rows: list = []
        self.n, self.widths, self.factor = 0, None, None

    def eval(self, row) -> None:
        fields = row.asDict()
        x, y = np.array(fields["x"], dtype=float), np.array(fields["y"], dtype=float)
        if len(x) != len(y):
            raise ValueError("dimensions differ")
        anchors = [np.array(fields[c], dtype=float) for c in ("e", "f") if fields.get(c) is not None]
        self.widths = [len(x), *map(len, anchors)]
        self.rows.append(np.concatenate([x - y, x + y, *anchors]))
        self.n += 1
        if len(self.rows) == HELD:
            self._reduce()

    def _reduce(self) -> None:
        z = np.stack(self.rows)
        self.factor = np.linalg.qr(z if self.factor is None else np.concatenate([self.factor, z]), mode="r")
        self.rows = []

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            self._reduce()
        if self.factor is not None:
            yield self.n, self.widths, self.factor.tobytes()


class GramMeasures:
    """(n, pip, eigen_overlap, eis) of what `gram_parts` gave; eis is null without anchors."""

    def __init__(self) -> None:
        self.n, self.widths, self.factor = 0, None, None

    def eval(self, row) -> None:
        self.n += row["n"]
        self.widths = list(row["widths"])
        r = np.frombuffer(row["cells"]).reshape(-1, self.widths[0] + sum(self.widths))
        self.factor = r if self.factor is None else np.linalg.qr(np.concatenate([self.factor, r]), mode="r")

    def terminate(self) -> Iterator[tuple]:
        from vecstead.operators.measures import eis_of, overlap_of

        if self.factor is None:
            return
        w = self.widths
        d, s, *anchors = np.split(self.factor, np.cumsum([w[0], *w])[: len(w)], axis=1)
        ds = d.T @ s
        pip = float(np.sqrt(max(0.0, (np.sum((d.T @ d) * (s.T @ s)) + np.sum(ds * ds.T)) / 2)))
        x, y = (s + d) / 2, (s - d) / 2
        yield self.n, pip, overlap_of(x, y), eis_of(x, y, *anchors) if len(anchors) == 2 else None


def register(spark: SparkSession, views: dict[str, DataFrame] | None = None) -> None:
    """Makes the table functions, and `views` by their names, known to `spark.sql`."""
    spark.udtf.register("gram_parts", udtf(GramParts, returnType="n bigint, widths array<int>, cells binary"))
    spark.udtf.register("gram_measures", udtf(GramMeasures, returnType="n bigint, pip double, eigen_overlap double, eis double"))
    for name, rows in (views or {}).items():
        rows.createOrReplaceTempView(name)
