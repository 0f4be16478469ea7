"""Compression of vectors to short codes: integer codebooks refined by rounds of assignment and averaging.

All arithmetic is in whole numbers, so results don't depend on how rows are dealt. The codebooks are broadcast (PARTS x
ENTRIES x width numbers, whatever the rows); each task computes the distances of its batches by norm expansion and adds up
what falls on each entry; the tasks' sums are merged by a grouped shuffle in each round. Rows are read again in each round
and nothing is kept between rounds but the codebooks, so a lost executor costs its tasks alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstead.llm.common import append_columns, batch_of, ddl, durable, quoted, table, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows that are assigned at once; sums of labels that are broadcast at most, else they are joined by a shuffle.
AT_ONCE, LABELS_SENT = 4096, 100_000


def whole_numbers(vectors: pa.Array, length: int, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors are kept, and floor(scale * x) of those: not null, of that length, all components finite.

    Components so large that a squared distance could pass 64 bits raise.
    """
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keep = (sizes == length) & (sizes > 0)
    keep &= np.bincount(owner, weights=~np.isfinite(flat), minlength=len(sizes)) == 0
    found = np.floor(flat[keep[owner]] * scale).reshape(-1, length) if keep.any() else np.zeros((0, length))
    if found.size and np.abs(found).max() > isqrt((1 << 61) // length):
        raise ValueError("components are too large for exact distances")
    return keep, found.astype(np.int64)


def nearest_entries(z: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) each: the nearest entry of each part's codebook, the first of equals, and its squared distance."""
    parts, _, width = books.shape
    entry, error = np.empty((len(z), parts), dtype=np.int64), np.empty((len(z), parts), dtype=np.int64)
    for p, book in enumerate(books):
        part = z[:, p * width : (p + 1) * width]
        apart = np.sum(part * part, axis=1)[:, None] - 2 * (part @ book.T) + np.sum(book * book, axis=1)[None, :]
        entry[:, p] = np.argmin(apart, axis=1)
        error[:, p] = np.take_along_axis(apart, entry[:, p : p + 1], 1)[:, 0]
    return entry, error


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> np.ndarray | None:
    """(parts, entries, width): the parts of the kept vectors (id, vec) of the smallest ids; None if nothing is kept.

    Rows of one id go by their components, null ids come last. The first kept vector fixes the length; lengths that can't
    be cut into equal parts raise.
    """
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    order = [F.col("id").asc_nulls_last(), "vec"]
    usable = rows.select("id", "vec").where(F.col("vec").isNotNull() & (F.size("vec") > 0) & finite)
    first = usable.orderBy(*order).first()
    if first is None:
        return None
    length = len(first.vec)
    if length % parts:
        raise ValueError(f"vectors of {length} components have no {parts} equal parts")
    held = usable.where(F.size("vec") == length).orderBy(*order).limit(entries).toArrow()["vec"].combine_chunks()
    found = whole_numbers(held, length, scale)[1]
    return np.ascontiguousarray(found.reshape(len(found), parts, -1).swapaxes(0, 1))


def refined(rows: DataFrame, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """One round over `rows` (vec): each entry becomes the floor of the mean of the parts nearest to it; unused ones stay."""
    parts, entries, width = books.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)
    schema = {"part": "int", "entry": "int", "at": "int", "total": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width + 1), dtype=np.int64)  # the last is the count
        for batch in batches:
            for lo in range(0, len(batch), AT_ONCE):
                z = whole_numbers(batch.column(0).slice(lo, AT_ONCE), parts * width, scale)[1]
                chosen = nearest_entries(z, sent.value)[0]
                for p in range(parts):
                    on = (chosen[:, p, None] == np.arange(entries)).astype(np.int64)
                    sums[p, :, :width] += on.T @ z[:, p * width : (p + 1) * width]
                    sums[p, :, width] += on.sum(axis=0)
        at = np.nonzero(sums)
        yield batch_of(schema, [*(x.astype(np.int32) for x in at), sums[at]])

    merged = rows.select("vec").mapInArrow(run, ddl(schema)).groupBy("part", "entry", "at").agg(F.sum("total").alias("total"))
    sums = np.zeros((parts, entries, width + 1), dtype=np.int64)
    for row in merged.collect():  # as many numbers as the codebooks have
        sums[row["part"], row["entry"], row["at"]] = row["total"]
    count = sums[:, :, width:]
    sent.destroy()
    return np.where(count > 0, sums[:, :, :width] // np.maximum(count, 1), books)


def learn_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """The codebooks (parts, entries, width) of `rows` (id, vec) after `rounds`; None if no vector is kept."""
    books = first_books(rows, parts, entries, scale)
    for _ in range(rounds if books is not None else 0):
        books = refined(rows, books, scale)
    return books


def books_text(books: np.ndarray) -> str:
    return ",".join(map(str, books.reshape(-1).tolist()))


def vector_codes(docs: DataFrame, doc_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(doc_id, code, error, label_error, codebooks_sha256) of each kept row of `docs`.

    Rows whose vector is null, empty, or has null or non-finite components are dropped, and so are vectors of another
    length than the kept one of the smallest id, which have no parts to compare. Repeated rows each get their row and count
    each in sums; a null id gets its code, null labels share one label_error. With fewer kept rows than entries, codebooks
    are so much shorter; an empty table gives an empty one. Other columns of `docs`, whatever their names, play no part.
    """
    rows = docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(label)).alias("label"), F.col(quoted(vector)).alias("vec"))
    books = learn_books(rows)
    if books is None:
        return rows.limit(0).select(F.col("id").alias(doc_id), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    sent = docs.sparkSession.sparkContext.broadcast(books)

    def make() -> Callable:
        books = sent.value
        length = books.shape[0] * books.shape[2]

        def compute(vectors: pa.Array):
            keep, z = whole_numbers(vectors, length)
            entry, error = nearest_entries(z, books)
            codes, errors = np.full(len(keep), None, dtype=object), np.zeros(len(keep), dtype=np.int64)
            codes[keep] = [x.tobytes().hex() for x in entry.astype(np.uint8)]
            errors[keep] = error.sum(axis=1)
            return pa.array(codes, pa.string()), errors

        return compute

    coded = written(append_columns(rows, ["vec"], {"code": "string", "error": "bigint"}, make, drop=["vec"]).where(F.col("code").isNotNull()))
    sums = durable(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    if sums.count() <= LABELS_SENT:
        sums = F.broadcast(sums)
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(F.col("id").alias(doc_id), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    steps = [
        """with kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pieces as materialized (
  select vec_id, cast(p as int) as p, list_slice(v, p * (len(v) // 8) + 1, (p + 1) * (len(v) // 8)) as z from kept, range(8) as t(p)),
b0 as materialized (
  select p, cast(row_number() over (partition by p order by vec_id) - 1 as int) as e, z as c from pieces
  qualify row_number() over (partition by p order by vec_id) <= 16)"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(
            f"""d{i} as (
  select vec_id, x.p, e, z, list_sum(list_transform(list_zip(z, c), lambda q: (q[1] - q[2]) * (q[1] - q[2]))) as d from pieces x join b{i} y on x.p = y.p),
a{i} as materialized (
  select vec_id, p, e, z, cast(d as bigint) as d from d{i} qualify row_number() over (partition by vec_id, p order by d, e) = 1)"""
        )
        if i < ROUNDS:
            steps.append(
                f"""s{i} as (
  select p, e, i, sum(cast(z[i] as hugeint)) as s, cast(count(*) as hugeint) as n from a{i}, unnest(range(1, len(z) + 1)) as t(i) group by p, e, i),
m{i} as (
  select p, e, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as c from s{i} group by p, e),
b{i + 1} as materialized (
  select b.p, b.e, coalesce(m.c, b.c) as c from b{i} b left join m{i} m on b.p = m.p and b.e = m.e)"""
            )
    steps.append(
        f"""digest as (
  select sha256(string_agg(cast(c[i] as varchar), ',' order by p, e, i)) as codebooks_sha256 from b{ROUNDS}, unnest(range(1, len(c) + 1)) as t(i)),
coded as materialized (
  select k.vec_id, k.label, string_agg(printf('%02x', a.e), '' order by a.p) as code, cast(sum(a.d) as bigint) as error
  from kept k join a{ROUNDS} a on k.vec_id = a.vec_id group by k.vec_id, k.label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from coded, digest"""
    )
    return ",\n".join(steps[:-1]) + ",\n" + steps[-1]


ORACLE = _oracle()
