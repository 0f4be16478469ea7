"""Near copies of vectors by cosine: spherical-cap filters with structured random product codes, exact verification.

A filter is a random direction, and a vector falls in every filter that it exceeds a threshold in. The directions of a code
are all sums of a short random vector of each half of the rotated space, so the filters that a vector exceeds are
list-decoded from the scores of two small books: only entries that can still reach the threshold with the other half's best
are combined. Two vectors of a high cosine exceed a common filter with a chance that is the same for all such pairs, as
codes are rotated at random; CODES of them miss 0.3 % of the pairs at a cosine of exactly 0.9, and fewer of closer ones.

Equal vectors are merged first. Filters are joined twice: first with 128 sign bits for each vector, which rule out most
vectors of a filter, then with the vectors of those that are left, whose cosines are block products in double precision. A
pair is counted in the first filter that both are left in, so each link counts once, and tasks hand on counts and spanning
forests, never pairs. A filter over MAX_GROUP vectors is cut in chunks and every two chunks meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstead.llm.common import append_columns, batch_of, ddl, durable, quoted, table, written
from vecstead.llm.components import connected_components
from vecstead.llm.trie import _expand, spanning

COSINE = 0.9
#: Independent codes; measured chance of a common filter of a pair at COSINE is a quarter for each. SEED makes directions alike in all tasks.
CODES, SEED = 20, 20
#: Up to how many distinct vectors (the last: any number) a half's book has how many entries, and the threshold in standard
#: deviations of a random direction's score: of simulated pairs at COSINE a quarter exceed a common filter.
TIERS = ((4_000, 32, 2.93), (150_000, 128, 3.56), (3_000_000, 512, 4.03), (100_000_000, 2048, 4.45), (0, 8192, 4.83))
#: Least dimension that codes work in; vectors of fewer components are padded with zeros before they are rotated.
LEAST_WIDTH = 64
#: Sign bits that may differ: a pair at COSINE differs in 18.4 of 128, standard deviation 4.
SIGN_BITS = 42
#: Most vectors of a filter that one task compares at once; rows a task holds before it compares them; hot filters broadcast at most.
MAX_GROUP, AT_ONCE, MOST_SENT = 2048, 50_000, 200_000
#: Groups up to this size are compared together, by distance in the sorted rows.
SMALL = 32


def unit_vectors(vectors: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which vectors can link (not null, zero or empty, all components finite), and each as doubles of length 1, else None."""
    sizes = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    out: list[np.ndarray | None] = []
    for lo, hi in zip((ends - sizes).tolist(), ends.tolist()):
        z = flat[lo:hi]
        top = np.abs(z).max(initial=0.0)
        if not (top > 0 and np.isfinite(top)):
            out.append(None)
            continue
        z = z / top
        out.append(z / np.sqrt(z @ z))
    return np.array([x is not None for x in out], dtype=bool), out


def hadamard(z: np.ndarray) -> np.ndarray:
    """Rows times the orthogonal Hadamard matrix; their length is a power of two."""
    n, d = z.shape
    size = 1
    while size < d:
        z = z.reshape(n, -1, 2, size)
        z = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], axis=2).reshape(n, d)
        size *= 2
    return z / np.sqrt(d)


class Codes:
    """The filters of vectors of `d` components, with books of `entries` and a threshold."""

    def __init__(self, d: int, entries: int, threshold: float, codes: int = CODES):
        self.d, self.entries, self.threshold, self.codes = d, entries, threshold, codes
        self.width = max(LEAST_WIDTH, 1 << (d - 1).bit_length())
        draw = np.random.default_rng([SEED, self.width, entries])
        self.signs = draw.choice([-1.0, 1.0], size=(codes + 2, 3, self.width))
        books = draw.normal(size=(2, entries, self.width // 2))
        self.books = books / np.linalg.norm(books, axis=2, keepdims=True) * np.sqrt(self.width / 2)

    def rotated(self, z: np.ndarray, code: int) -> np.ndarray:
        """Rows turned by signs and Hadamard matrices, three times."""
        for signs in self.signs[code]:
            z = hadamard(z * signs)
        return z

    def padded(self, z: np.ndarray) -> np.ndarray:
        return np.pad(z, ((0, 0), (0, self.width - self.d)))

    def filters(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters that the unit vectors `z` exceed, by list-decoding."""
        z, rows, found, half = self.padded(z), [], [], self.width // 2
        for code in range(self.codes):
            y = self.rotated(z, code)
            one, two = y[:, :half] @ self.books[0].T, y[:, half:] @ self.books[1].T
            row1, entry1 = np.nonzero(one >= self.threshold - two.max(axis=1)[:, None])
            row2, entry2 = np.nonzero(two >= self.threshold - one.max(axis=1)[:, None])
            count = np.bincount(row2, minlength=len(z))
            at, owner = _expand((np.cumsum(count) - count)[row1], count[row1])
            over = one[row1[owner], entry1[owner]] + two[row1[owner], entry2[at]] >= self.threshold
            at, owner = at[over], owner[over]
            rows.append(row1[owner])
            found.append((code * self.entries + entry1[owner]) * self.entries + entry2[at])
        return np.concatenate(rows), np.concatenate(found)

    def sign_bits(self, z: np.ndarray) -> np.ndarray:
        """(rows, 2) words of 64 sign bits of turned coordinates."""
        z = self.padded(z)
        return np.concatenate([np.packbits(self.rotated(z, self.codes + k)[:, :64] > 0, axis=1).view(np.uint64) for k in (0, 1)], axis=1)


@lru_cache(maxsize=8)
def codes_for(d: int, entries: int, threshold: float) -> Codes:
    return Codes(d, entries, threshold)


def tier(rows: int) -> tuple[int, float]:
    """The books' entries and the threshold for so many distinct vectors: filters hold a few unlike vectors each."""
    return next((entries, threshold) for most, entries, threshold in TIERS if rows <= most or not most)


def by_width(found: list[np.ndarray | None], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors) of unit vectors of one length each, at most `most` at once."""
    sizes = np.array([0 if x is None else len(x) for x in found])
    for d in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == d)
        for lo in range(0, len(at), most):
            part = at[lo : lo + most]
            yield part, np.stack([found[i] for i in part])


def filtered(classes: DataFrame, entries: int, threshold: float) -> DataFrame:
    """(filter, id, one, two): each of `classes` (id, vec) in each filter it exceeds, with its sign bits. Lengths don't share filters."""
    schema = {"filter": "bigint", "id": "bigint", "one": "bigint", "two": "bigint"}
    most = max(16, 256_000 // entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, z in by_width(unit_vectors(batch.column(1))[1], most):
                codes = codes_for(z.shape[1], entries, threshold)
                rows, filters = codes.filters(z)
                signs = codes.sign_bits(z).view(np.int64)
                yield batch_of(schema, [filters.astype(np.int64) + (z.shape[1] << 40), ids[at][rows], signs[rows, 0], signs[rows, 1]])

    return classes.select("id", "vec").mapInArrow(run, ddl(schema))


def hot_filters(rows: DataFrame) -> DataFrame:
    """(filter, n) of the filters over MAX_GROUP rows."""
    return durable(rows.groupBy("filter").agg(F.count("*").alias("n")).where(F.col("n") > MAX_GROUP))


def chunked(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """`rows` (filter, id, ...) with meet, chunk and cross: `hot` filters are cut in chunks, and a row goes to each pair of its chunk.

    Where two chunks meet (cross), only rows of different chunks are to be compared.
    """
    found = hot.count()
    if not found:
        return rows.withColumns({"meet": F.lit(0).cast("bigint"), "chunk": F.lit(0), "cross": F.lit(False)})
    rows = rows.join(F.broadcast(hot) if found <= MOST_SENT else hot, "filter", "left")
    chunks = F.coalesce(F.ceil(F.col("n") / (MAX_GROUP // 2)), F.lit(1)).cast("bigint")
    own = F.pmod(F.xxhash64("id"), chunks)
    meets = F.transform(F.sequence(F.lit(0).cast("bigint"), chunks - 1), lambda other: F.struct((F.least(own, other) * chunks + F.greatest(own, other)).alias("meet"), (own != other).alias("cross")))
    return rows.select("*", own.cast("int").alias("chunk"), F.inline(meets)).drop("n")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (equal first two columns, sorted), and the edges of the groups; AT_ONCE rows or one group at a time."""

    def edges(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
        one, two = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        return np.flatnonzero((one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1

    def made(held: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        return rows, np.r_[0, edges(rows), len(rows)]

    held, size = [], 0
    for batch in batches:
        if not len(batch):
            continue
        if held and size + len(batch) > AT_ONCE:
            # whole groups leave together, and the last one waits for the rest of its rows
            rows = pa.Table.from_batches([*held, batch])
            cuts = edges(rows)
            if len(cuts):
                yield made(rows.slice(0, int(cuts[-1])).to_batches())
                held = rows.slice(int(cuts[-1])).to_batches()
                size = sum(map(len, held))
                continue
        held.append(batch)
        size += len(batch)
    if held:
        yield made(held)


def alike_rows(one: np.ndarray, two: np.ndarray, chunk: np.ndarray, cross: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which rows have another in their group that differs in few sign bits; `cross` groups compare chunks with each other alone."""
    n, size = len(one), np.diff(edges)
    out = np.zeros(n, dtype=bool)
    group = np.repeat(np.arange(len(size)), size)
    for apart in range(1, min(SMALL, int(size.max(initial=1)))):
        i = np.flatnonzero((group[apart:] == group[:-apart]) & (size[group[apart:]] <= SMALL))
        j = i + apart
        near = np.bitwise_count(one[i] ^ one[j]).astype(np.int64) + np.bitwise_count(two[i] ^ two[j]) <= SIGN_BITS
        near &= ~cross[i] | (chunk[i] != chunk[j])
        out[i[near]] = out[j[near]] = True
    for g in np.flatnonzero(size > SMALL):
        lo, hi = edges[g], edges[g + 1]
        for at in range(lo, hi, 512):
            part = slice(at, min(at + 512, hi))
            near = np.bitwise_count(one[part, None] ^ one[None, lo:hi]).astype(np.int64) + np.bitwise_count(two[part, None] ^ two[None, lo:hi]) <= SIGN_BITS
            near[np.arange(part.stop - at), np.arange(at - lo, part.stop - lo)] = False
            if cross[lo]:
                near &= chunk[part, None] != chunk[None, lo:hi]
            out[part] |= near.any(axis=1)
            out[lo:hi] |= near.any(axis=0)
    return out


def maybe_linked(rows: DataFrame) -> DataFrame:
    """(id, filters): the filters, ascending, in which a vector of `rows` (filter, id, one, two) may have a link."""
    schema = {"id": "bigint", "filter": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in whole_groups(batches):
            chunk, cross = rows["chunk"].to_numpy(), rows["cross"].to_numpy()
            one, two = rows["one"].to_numpy().view(np.uint64), rows["two"].to_numpy().view(np.uint64)
            found = np.flatnonzero(alike_rows(one, two, chunk, cross, edges))
            yield batch_of(schema, [rows["id"].to_numpy()[found], rows["filter"].to_numpy()[found]])

    dealt = chunked(rows, hot_filters(rows)).select("filter", "meet", "chunk", "cross", "id", "one", "two").repartition("filter", "meet").sortWithinPartitions("filter", "meet")
    return dealt.mapInArrow(run, ddl(schema)).groupBy("id").agg(F.array_sort(F.collect_set("filter")).alias("filters"))


def first_shared(earlier: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For pairs of rows (i, j), whether they share no earlier filter."""
    flat = np.concatenate(earlier) if earlier else np.zeros(0, dtype=np.int64)
    names, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    if not (times > 1).any():
        return np.ones(len(i), dtype=bool)
    kept = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(len(earlier)), [len(x) for x in earlier])
    use = times[code] > 1
    held = np.zeros((len(earlier), int((times > 1).sum())), dtype=np.float32)
    held[owner[use], kept[code[use]]] = 1
    out = np.empty(len(i), dtype=bool)
    for lo in range(0, len(i), 200_000):
        a, b = i[lo : lo + 200_000], j[lo : lo + 200_000]
        rows, at = np.unique(a, return_inverse=True)
        out[lo : lo + 200_000] = (held[rows] @ held.T)[at, b] == 0
    return out


def linked(lists: DataFrame, classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(id, links, root) for groups of `lists` (id, filters): what a class is linked to, each link once, and a class it is reached from."""
    schema = {"id": "bigint", "links": "bigint", "root": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in whole_groups(batches):
            chunk, cross, ids, times = (rows[c].to_numpy() for c in ("chunk", "cross", "id", "times"))
            vectors = unit_vectors(rows["vec"].chunk(0))[1]
            earlier = rows["earlier"].chunk(0)
            starts, flat = earlier.offsets.to_numpy(), earlier.values.to_numpy()
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi - lo < 2:
                    continue
                z = np.stack(vectors[lo:hi])
                near = np.triu(z @ z.T >= cosine, 1)
                part = chunk[lo:hi]
                if cross[lo]:
                    near &= part[:, None] != part[None, :]
                i, j = np.nonzero(near)
                if not len(i):
                    continue
                new = first_shared([flat[starts[k] : starts[k + 1]] for k in range(lo, hi)], i, j)
                i, j = i[new], j[new]
                count, own = np.zeros(hi - lo, dtype=np.int64), times[lo:hi]
                np.add.at(count, i, own[j])
                np.add.at(count, j, own[i])
                root = spanning(hi - lo, i, j)
                at = np.flatnonzero(count)
                yield batch_of(schema, [ids[lo:hi][at], count[at], ids[lo:hi][root[at]]])

    spread = lists.join(classes.select("id", "vec", "times"), "id").select("id", "vec", "times", "filters", F.posexplode("filters").alias("place", "filter"))
    spread = spread.withColumn("earlier", F.slice("filters", F.lit(1), F.col("place"))).drop("filters", "place")
    # counted without the vectors
    counted = lists.select("id", F.explode("filters").alias("filter"))
    dealt = chunked(spread, hot_filters(counted)).select("filter", "meet", "chunk", "cross", "id", "vec", "times", "earlier").repartition("filter", "meet").sortWithinPartitions("filter", "meet")
    return dealt.mapInArrow(run, ddl(schema))


def embedding_links(docs: DataFrame, doc_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(doc_id, n_links, component_id, kept) of each row of `docs`, whose vectors link at a cosine of `cosine` or more.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, and so do vectors of
    different lengths. Repeated rows each get their row and link with each other, as do equal vectors of any ids. A row of a
    null id has its links and its component, of which it never is the name, and is not kept unless it stands alone: then its
    component is null. An empty table gives an empty one. Other columns of `docs`, whatever their names, play no part.
    """
    rows = docs.select(F.col(quoted(doc_id)).alias("name"), F.col(quoted(vector)).alias("vec"))

    def make() -> Callable:
        def compute(vectors: pa.Array):
            keep = unit_vectors(vectors)[0]
            values = vectors.to_pylist()
            return ([xxhash.xxh3_128_digest((np.array(x, dtype=np.float64) + 0.0).tobytes()) if ok else None for x, ok in zip(values, keep)],)

        return compute

    rows = append_columns(rows, ["vec"], {"digest": "binary"}, make)
    names = written(rows.select("name", "digest"))
    groups = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.count("*").alias("times"), F.min("name").alias("least"), F.first("vec").alias("vec"))
    classes = written(groups.withColumn("id", F.monotonically_increasing_id()))
    entries, threshold = tier(classes.count())
    lists = written(maybe_linked(filtered(classes, entries, threshold)))
    found = written(linked(lists, classes, cosine))
    edges = found.where("root <> id").select(F.col("root").alias("a"), F.col("id").alias("b"))
    roots = connected_components(edges)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("id", "digest", "times", "least").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    known = durable(known.select("digest", "least", F.coalesce("root", "id").alias("root"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(least, "root").select("digest", "n_links", "component_id")
    joined = names.where(F.col("digest").isNotNull()).join(known, "digest").select("name", "n_links", "component_id")
    alone = names.where(F.col("digest").isNull()).select("name", F.lit(0).cast("bigint").alias("n_links"), F.col("name").alias("component_id"))
    return joined.unionByName(alone).select(F.col("name").alias(doc_id), "n_links", "component_id", F.coalesce(F.col("name") == F.col("component_id"), F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))


ORACLE = """with recursive kept as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (
  select x.vec_id as a, y.vec_id as b from kept x join kept y on x.vec_id <> y.vec_id and len(x.v) = len(y.v) and list_cosine_similarity(x.v, y.v) >= 0.9),
counts as (select a, count(*) as n from links group by a),
reached(a, b) as (select vec_id, vec_id from embeddings union select reached.a, links.b from reached join links on links.a = reached.b),
named as (select a, min(b) as component_id from reached group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings left join counts on counts.a = vec_id join named on named.a = vec_id"""
