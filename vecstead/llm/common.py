"""What the training-data operators share: tables, folds, checkpoints, and Arrow batches in and out."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType

from vecstead.functions.shared import durable, new_folder, remove  # noqa: F401

#: Rows that are computed at once in a task.
AT_ONCE = 1000
ARROW = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "float": pa.float32(),
    "boolean": pa.bool_(),
    "string": pa.string(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`. A null id counts as the empty text."""
    doc_id = F.col(quoted(doc_id)) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts).cast("int")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def written(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder as a compressed table and read again; the table goes when the program ends, or by `release`."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def release(table: DataFrame) -> None:
    """Deletes what `written` made, once nothing reads it any more."""
    remove(table.sparkSession, table.folder)


_remembered: dict[tuple, Any] = {}


def remember(make: Callable | None = None, *of: Any) -> Any:
    """`make(*of)`, which a Python worker remembers from task to task until a task calls this for something else.

    Workers serve one operator after another and several share an executor's memory, so an operator that remembers nothing calls
    this without `make` in its tasks.
    """
    if (make, of) not in _remembered:
        _remembered.clear()
        give_back()
        _remembered[make, of] = make(*of) if make else None
    return _remembered[make, of]


def give_back() -> None:
    """Gives memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def append_columns(
    df: DataFrame,
    inputs: Sequence[str],
    fields: dict[str, str],
    make: Callable[[], Callable[..., Iterable]],
    drop: Sequence[str] = (),
) -> DataFrame:
    """`df` with the columns `fields` (name to type), computed batch by batch.

    `make()` runs once in each task and returns a function from the input columns' Arrow arrays to one sequence for each
    new column. Input columns in `drop` don't come back. A column of `df` that has a new column's name is replaced.
    """
    gone = {x.lower() for x in (*fields, *drop)}
    kept = [c for c in df.columns if c.lower() not in gone]
    at, extra = [], []
    for name in inputs:
        match = [i for i, c in enumerate(kept) if c.lower() == name.lower()]
        at.append(match[0] if match else len(kept) + len(extra))
        if not match:
            extra.append(F.col(quoted(name)).alias(f"__in{len(extra)}"))
    picked = df.select(*[F.col(quoted(c)) for c in kept], *extra)
    schema = StructType(picked.schema.fields[: len(kept)])
    for name, kind in fields.items():
        schema = schema.add(name, from_arrow_type(ARROW[kind]))
    kinds, width, names = [ARROW[x] for x in fields.values()], len(kept), [*kept, *fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            for lo in range(0, len(whole), AT_ONCE):
                batch = whole.slice(lo, AT_ONCE)
                made = compute(*(batch.column(i) for i in at))
                made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=names)
        give_back()

    return picked.mapInArrow(run, schema)


def as_bytes(texts: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of an Arrow string array."""
    return texts.cast(pa.binary()).to_pylist()


def batch_of(schema: dict[str, str], columns: Sequence[Iterable]) -> pa.RecordBatch:
    arrays = [x if isinstance(x, pa.Array) else pa.array(x, ARROW[k]) for x, k in zip(columns, schema.values(), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=list(schema))


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())
