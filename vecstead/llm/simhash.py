"""SimHash near-duplicates: fingerprints of word shingles, linked by a binary trie self-join.

Equal fingerprints are merged first, so copies cost one row. Fingerprints are then dealt to the buckets of several tables;
those of a bucket share a trie path, and the trie join runs in the bucket on all bits. Each task hands on a spanning
forest of its links, never the pairs, and components are found by distributed stars. A bucket over `MAX_BUCKET`
fingerprints is cut in chunks and every two chunks meet in a task of their own, so no task holds an unbounded group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstead.llm.common import append_columns, as_bytes, batch_of, ddl, durable, give_back, quoted, remember, table
from vecstead.llm.components import connected_components
from vecstead.llm.trie import spanning, trie_pairs

SEED = 42
#: Most fingerprints of a bucket that one task joins at once.
MAX_BUCKET = 2048
#: Fingerprints that a task holds before it joins them.
AT_ONCE = 100_000


def shingle_hashes(raw: bytes | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words (A-Z only), repeats included; fewer words make one shingle."""
    found = (raw or b"").lower().split()
    if not found:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(sizes + 1) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip((ends - sizes).tolist(), ends[words - 1 :].tolist())]
    return np.array(hashes, dtype=np.uint64)


def _widened(hashes: np.ndarray, bits: int) -> np.ndarray:
    """(n, bits / 64) hashes: the first column is the hash itself, the others are mixed from it."""
    out = [hashes]
    for i in range(1, bits // 64):
        x = hashes + np.uint64((0x9E3779B97F4A7C15 * i) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(x ^ (x >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprint(hashes: np.ndarray, bits: int = 64) -> bytes:
    """A bit is 1 if it is set in over half the hashes. Big-endian words; all zero without hashes."""
    if not len(hashes):
        return bytes(bits // 8)
    set_in = np.zeros(bits, dtype=np.int64)
    for lo in range(0, len(hashes), 255 * 64):  # of bounded memory; sums of 255 rows fit in a byte
        wide = _widened(hashes[lo : lo + 255 * 64], bits).astype(">u8")
        rows = np.unpackbits(wide.view(np.uint8), axis=1)
        full = len(rows) // 255 * 255
        if full:
            set_in += rows[:full].reshape(-1, 255, bits).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        set_in += rows[full:].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * set_in > len(hashes)).tobytes()


def add_fingerprint(docs: DataFrame, text: str = "text", words: int = 4, bits: int = 64, out: str = "fingerprint", drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with the binary column `out`. Null and wordless texts have the zero fingerprint."""

    def make() -> Callable:
        return lambda texts: ([fingerprint(shingle_hashes(x, words), bits) for x in as_bytes(texts)],)

    return append_columns(docs, [text], {out: "binary"}, make, drop=drop)


@dataclass(frozen=True)
class Tables:
    """Bit positions that make up each table's bucket key."""

    bits: int
    budget: int
    positions: tuple[tuple[int, ...], ...]


def exhaustive_tables(bits: int, budget: int, rows: int) -> Tables:
    """Tables that miss no pair: of `blocks` blocks, at least blocks - budget agree, and each table keys on that many.

    More blocks make longer keys, so buckets stay small as the number of fingerprints grows.
    """
    for blocks in range(budget + 1, budget + 4):
        edges = np.linspace(0, bits, blocks + 1).astype(int)
        parts = [range(a, b) for a, b in zip(edges[:-1], edges[1:])]
        tables = tuple(tuple(i for part in chosen for i in part) for chosen in combinations(parts, blocks - budget))
        if rows >> min(map(len, tables)) < 256:
            break
    return Tables(bits, budget, tables)


def _bucketed(prints: DataFrame, tables: Tables) -> DataFrame:
    """(bucket, print): each fingerprint once for each table. The bucket is the table's number and the key's bits."""
    schema = {"bucket": "bigint", "print": "binary"}
    width = tables.bits // 8
    weights = [(np.array(p), (1 << np.arange(len(p), dtype=np.int64))) for p in tables.positions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                values = batch.column(0).slice(lo, 2000)
                raw = np.frombuffer(b"".join(values.to_pylist()), dtype=np.uint8).reshape(-1, width)
                bits = np.unpackbits(raw, axis=1)
                keys = np.concatenate([(bits[:, p] @ w) + (i << 48) for i, (p, w) in enumerate(weights)])
                yield batch_of(schema, [pa.array(keys), pa.concat_arrays([values] * len(weights))])

    return prints.mapInArrow(run, ddl(schema))


def _chunked(rows: DataFrame) -> DataFrame:
    """(bucket, meet, print): buckets over MAX_BUCKET are cut in chunks, and a fingerprint goes to each pair of its chunk."""
    hot = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > MAX_BUCKET)
    rows = rows.join(hot, "bucket", "left")
    chunks = F.ceil(F.col("n") / (MAX_BUCKET // 2)).cast("int")
    own = F.pmod(F.xxhash64("print"), chunks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), chunks - 1), lambda other: F.least(own, other) * chunks + F.greatest(own, other))
    meet = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(meets)
    return rows.select("bucket", F.explode(meet).alias("meet"), "print")


def fingerprint_links(prints: DataFrame, tables: Tables) -> DataFrame:
    """(a, b): spanning forests of the links between distinct `prints.print` within the tables' budget.

    A task streams its groups, AT_ONCE fingerprints or one group at a time, and hands on a forest for each such part.
    """
    width, budget, schema = tables.bits // 8, tables.budget, {"a": "binary", "b": "binary"}

    def forest(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        bucket, meet = (np.concatenate([b.column(k).to_numpy() for b in rows]) for k in (0, 1))
        raw = np.frombuffer(b"".join(x for b in rows for x in b.column(2).to_pylist()), dtype=np.uint8).reshape(-1, width)
        group = np.unique(np.stack([bucket, meet.astype(np.int64)], axis=1), axis=0, return_inverse=True)[1].reshape(-1)
        same, row_print = np.unique(raw.view(f"V{width}").reshape(-1), return_inverse=True)
        label = np.arange(len(same))
        for i, j in trie_pairs(raw, group, budget):
            # what each block links is merged into the forest so far
            tree = np.flatnonzero(label != np.arange(len(label)))
            label = spanning(len(same), np.r_[row_print[i], tree], np.r_[row_print[j], label[tree]])
        member = np.flatnonzero(label != np.arange(len(label)))
        return batch_of(schema, [[x.tobytes() for x in same[member]], [x.tobytes() for x in same[label[member]]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember()
        held, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            bucket, meet = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            ends = np.flatnonzero((bucket[1:] != bucket[:-1]) | (meet[1:] != meet[:-1])) + 1
            if size + len(batch) > AT_ONCE and len(ends):
                # whole groups leave together, and the last one waits for the rest of its rows
                cut = int(ends[-1])
                yield forest([*held, batch.slice(0, cut)])
                held, size, batch = [], 0, batch.slice(cut)
            held.append(batch)
            size += len(batch)
        if held:
            yield forest(held)
        give_back()

    return _chunked(_bucketed(prints, tables)).repartition("bucket", "meet").sortWithinPartitions("bucket", "meet").mapInArrow(run, ddl(schema))


def print_roots(prints: DataFrame, tables: Tables) -> DataFrame:
    """(print, root) for each distinct `prints.print`: the least fingerprint of its component."""
    roots = durable(connected_components(fingerprint_links(prints.select("print"), tables)))
    return prints.select("print").join(roots.withColumnRenamed("node", "print"), "print", "left").select("print", F.coalesce("root", "print").alias("root"))


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 4, bits: int = 64, budget: int = 4, tables: Tables | None = None) -> DataFrame:
    """One row a document: its id, the binary fingerprint, and component_id, the smallest id that links reach.

    Fingerprints link at `budget` or fewer differing bits; without `tables` no link is missed. Null and wordless texts
    have the zero fingerprint and link like others. Repeated rows each get their row. Null ids get a component too, but
    never name one. An empty table gives an empty one. Other columns of `docs`, whatever their names, play no part.
    """
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    rows = durable(add_fingerprint(rows, words=words, bits=bits, out="print", drop=("text",)))
    prints = durable(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    tables = tables or exhaustive_tables(bits, budget, prints.count())
    linked = prints.join(print_roots(prints, tables), "print")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.select("print", "root").join(named, "root").select("print", "component_id")
    return rows.join(named, "print").select("doc_id", F.col("print").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")
