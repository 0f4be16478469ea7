"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, and a scan of the documents' windows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstead.llm.common import append_columns, as_bytes, durable, quoted, table, written

WINDOW = 10
#: Benchmark text that one broadcast carries (its index takes about ten times that in a worker); more takes further passes.
SHARD_BYTES = 16_000_000

_SPACED = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(raw: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words: runs of digits, letters and all beyond ASCII."""
    return (raw or b"").translate(_SPACED).split()


class Shard:
    """Some items as they travel; the index is built once in each Python worker."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.items, self.window = items, window

    @cached_property
    def index(self) -> Windows:
        return Windows(self.items, self.window)


class Windows:
    """The distinct windows of some items, for each window length: sorted hashes, a place of each, and its items.

    Windows are not copied: a place points into the items' word numbers, which stand one after the other.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW) -> None:
        self.words: dict[bytes, int] = {}
        self.items = [item for item, _ in items]
        parts = []
        for _, raw in items:
            found = words_of(raw)
            parts.append(np.fromiter((self.words.setdefault(w, len(self.words)) for w in found), dtype=np.int32, count=len(found)))
        self.ids = np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)
        lengths = np.array([len(x) for x in parts], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        sizes = np.minimum(lengths, window)
        self.found = {int(size): self._distinct(int(size), starts[sizes == size], lengths[sizes == size], np.flatnonzero(sizes == size)) for size in np.unique(sizes[sizes > 0])}

    def _distinct(self, size: int, starts: np.ndarray, lengths: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, ...]:
        """Hashes, places, and where each window's items begin in the last array. Equal hashes of other words stay apart."""
        times = lengths - size + 1
        first = np.cumsum(times) - times
        at = np.repeat(starts - first, times) + np.arange(times.sum())
        owner = np.repeat(items.astype(np.int32), times)
        hashes = self.rolled(self.ids, at, size)
        order = np.lexsort((owner, hashes))
        hashes, at, owner = hashes[order], at[order], owner[order]
        del order
        new = np.r_[True, hashes[1:] != hashes[:-1]]
        alike = np.flatnonzero(~new)
        for k in range(size):
            new[alike] |= self.ids[at[alike] + k] != self.ids[at[alike - 1] + k]
        window_of = np.cumsum(new) - 1
        kept = np.flatnonzero(new | np.r_[True, owner[1:] != owner[:-1]])  # an item once for each window
        begins = np.searchsorted(window_of[kept], np.arange(window_of[-1] + 2))
        return hashes[new], at[new], begins, owner[kept]

    @staticmethod
    def rolled(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        value = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):
            value = value * _MIX + (ids[at + k] + 1).astype(np.uint64)
        return value

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the ids of the items that occur. Hash hits are verified word by word."""
        hit, items = np.zeros(len(words), dtype=bool), set()
        ids = np.fromiter(map(self.words.get, words, _NEVER), dtype=np.int32, count=len(words))
        known = np.r_[0, np.cumsum(ids >= 0)]
        for size, (hashes, places, begins, owner) in self.found.items():
            at = np.flatnonzero(known[size:] - known[:-size] == size) if len(ids) >= size else ()
            if not len(at):
                continue
            value = self.rolled(ids, at, size)
            low = np.searchsorted(hashes, value)
            some = np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == value)
            at, low, high = at[some], low[some], np.searchsorted(hashes, value[some], side="right")
            seen = np.zeros(0, dtype=np.int64)
            for step in range(int((high - low).max()) if len(at) else 0):  # over 1 only where hashes collide
                here = np.flatnonzero(low + step < high)
                window = low[here] + step
                same = np.ones(len(here), dtype=bool)
                for k in range(size):
                    same &= self.ids[places[window] + k] == ids[at[here] + k]
                for k in range(size):
                    hit[at[here[same]] + k] = True
                seen = np.union1d(seen, window[same])
            for x in seen.tolist():
                items.update(owner[begins[x] : begins[x + 1]].tolist())
        return hit, {self.items[x] for x in items}


class _Never:
    """An endless supply of -1, the number of words that no item has."""

    def __iter__(self):
        while True:
            yield -1


_NEVER = _Never()


def _sharded(benchmark: DataFrame, item_id: str, text: str) -> tuple[DataFrame, list[int]]:
    """(item, body, shard) and the shards that have items: dealt by hash, so that a shard has about SHARD_BYTES at most, or one item."""
    rows = benchmark.select(F.coalesce(F.col(quoted(item_id)).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(quoted(text)), F.lit("")).cast("binary").alias("body"))
    rows = durable(rows.withColumn("size", F.length("body").cast("bigint")))
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    parts = max(1, -(-total // SHARD_BYTES))
    while True:
        dealt = rows.withColumn("shard", F.pmod(F.xxhash64("item", "body"), F.lit(parts)))
        sizes = dealt.groupBy("shard").agg(F.sum("size").alias("size"), F.count_distinct("item", "body").alias("n")).collect()
        if all(r["size"] <= 1.5 * SHARD_BYTES or r.n == 1 for r in sizes):
            return dealt.select("item", "body", "shard").distinct(), sorted(r.shard for r in sizes)
        parts *= 2


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` with n_words, spans (flat array: first word and word after each hit run) and items (array of item ids as strings, sorted).

    A window is `window` consecutive words of an item; a shorter item, unless empty, is one window. Null and wordless
    texts have no words, and null or wordless items no windows; a null item id counts as the empty string, and items that
    share an id count once. Repeated rows each get their row; empty tables give no hits. Columns of `docs` with the
    output's names are replaced. Texts of any length are scanned whole.

    The benchmark is broadcast in shards of about SHARD_BYTES. Each is fetched when its pass over the documents begins, and
    the passes' results are written between them, so a large benchmark costs passes and not memory.
    """
    spark = docs.sparkSession
    fields = {"n_words": "bigint", "spans": "array<bigint>", "items": "array<string>"}
    dealt, shards = _sharded(benchmark, item_id, item_text)
    for number, shard in enumerate(shards or [0]):
        items = [(r["item"], bytes(r.body)) for r in dealt.where(F.col("shard") == shard).orderBy("item", "body").toLocalIterator()]
        sent = spark.sparkContext.broadcast(Shard(items, window))
        del items
        before = ["spans", "items"] if number else []

        def make(sent=sent) -> Callable:
            windows = sent.value.index

            def compute(texts, *earlier):
                earlier = [x.to_pylist() for x in earlier]
                out = []
                for i, raw in enumerate(as_bytes(texts)):
                    words = words_of(raw)
                    hit, names = windows.scan(words)
                    if earlier:
                        for a, b in zip(earlier[0][i][::2], earlier[0][i][1::2]):
                            hit[a:b] = True
                        names |= set(earlier[1][i])
                    out.append((len(words), np.flatnonzero(np.diff(np.r_[False, hit, False])), sorted(names)))
                return [list(x) for x in zip(*out)] or [[], [], []]

            return compute

        if number:
            docs = written(docs).withColumnsRenamed({"spans": "__spans", "items": "__items"})
            last.unpersist()
        docs = append_columns(docs, [text, *(f"__{x}" for x in before)], fields, make, drop=[f"__{x}" for x in before])
        last = sent
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", **options) -> DataFrame:
    """`docs` without what the benchmark contaminates; columns as before.

    `remove="documents"` drops every document with a hit. `remove="spans"` cuts hit words out of the texts, from each run's
    first byte to the last, and leaves one space between what remains; documents without a hit keep their exact text.
    """
    columns = docs.columns
    marked = mark_contamination(docs, benchmark, text, **options)
    if remove == "documents":
        return marked.where(F.size("spans") == 0).select(*[F.col(quoted(c)) for c in columns])

    def make() -> Callable:
        def compute(texts, spans):
            return ([raw if not span else cut_spans(raw.encode(), span).decode() for raw, span in zip(texts.to_pylist(), spans.to_pylist())],)

        return compute

    cut = append_columns(marked.withColumnRenamed(text, "__text"), ["__text", "spans"], {text: "string"}, make)
    return cut.select(*[F.col(quoted(c)) for c in columns])


def cut_spans(raw: bytes, spans: list[int]) -> bytes:
    """`raw` without the words of `spans` (first word, word after, ...)."""
    normal = raw.translate(_SPACED)
    bounds, at = [], 0
    for word in normal.split():
        at = normal.index(word, at)
        bounds.append((at, at + len(word)))
        at += len(word)
    kept, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        kept.append(raw[at : bounds[a][0]].rstrip())
        at = bounds[b - 1][1]
    kept.append(raw[at:].lstrip())
    return b" ".join(x for x in kept if x)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")
    spans = F.col("spans")
    hit = F.aggregate(F.sequence(F.lit(0), F.size(spans) - 1), F.lit(0).cast("bigint"), lambda total, i: total + F.when(i % 2 == 1, F.get(spans, i)).otherwise(-F.get(spans, i)))
    marked = marked.withColumn("n_hit", F.when(F.size(spans) == 0, F.lit(0).cast("bigint")).otherwise(hit))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
