"""Packing of tokenised documents into sequences: first-fit decreasing over a tournament tree, in random groups."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstead.llm.common import AT_ONCE, ddl, durable, give_back, quoted, remember, table

LENGTH = 2048
END = np.array([1], dtype="<u4").tobytes()
#: About so many pieces are packed together; the number of groups follows the number of pieces.
GROUP = 8192
#: Words whose ids a Python worker remembers, about 50 MB.
MEMORY = 250_000

_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


class Ids:
    """Byte-level BPE ids as little-endian unsigned 32-bit bytes, as the tokenizer's `encode(text, add_special_tokens=False)` gives them.

    A text that holds the string of an added token is encoded whole by the tokenizer. Any other has no added token in its
    ids, so the same vocabulary's ranks give them, at half the cost; it is cut at single spaces between non-spaces, where its
    pre-tokens always end, and the ids of common words are remembered.
    """

    def __init__(self, file: str, ranks_file: str, pattern: str) -> None:
        import tiktoken

        self.file = file
        with open(file, encoding="utf-8") as parts:
            self.added = tuple(x["content"] for x in json.load(parts)["added_tokens"])
        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    @cached_property
    def tokenizer(self):
        """Read from its file once a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.file)

    def fresh(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        pieces = text.split(" ")
        if "" in pieces or any(x[0].isspace() or x[-1].isspace() for x in pieces):
            pieces = _INNER_SPACE.split(text)
        first = self.fresh(pieces[0])
        ids = list(map(self.known.get, pieces[1:]))
        if None in ids:
            for i, x in enumerate(ids):
                if x is None:
                    ids[i] = made = self.fresh(" " + pieces[i + 1])
                    if len(self.known) < MEMORY and len(pieces[i + 1]) < 40:
                        self.known[pieces[i + 1]] = made
        return first + b"".join(ids)


def encoder(vocabulary: str) -> Ids:
    """One encoder for each Python worker, as long as it serves this operator. `vocabulary` names a public byte-level BPE that has a
    tokenizer's file and one of ranks."""
    return remember(_read, vocabulary)


def _read(vocabulary: str) -> Ids:
    import public_tokenizers

    return Ids(public_tokenizers.path(f"{vocabulary}.json"), public_tokenizers.path(f"{vocabulary}.tiktoken"), public_tokenizers.PATTERN)


def token_pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = "byte_bpe_50k", length: int = LENGTH) -> DataFrame:
    """A row for each piece of at most `length` ids of each document's ids and end id: doc_id, start, length, ids_crc32,
    doc_tokens, and `deal`, a number for random groups that differs between repeated rows too.

    A null text is empty and has the end id alone.
    """
    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"), F.spark_partition_id().cast("bigint").alias("part"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = {"doc_id": kind, "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "deal": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, done, size = encoder(vocabulary), 0, 4 * length
        for batch in (x.slice(lo, AT_ONCE) for x in batches for lo in range(0, len(x), AT_ONCE)):
            part = batch.column(2)[0].as_py()
            owner, cells = [], []
            for i, body in enumerate(batch.column(1).to_pylist()):
                ids = encode(body or "") + END
                for lo in range(0, len(ids), size):
                    piece = ids[lo : lo + size]
                    owner.append(i)
                    cells.append((lo // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, (part << 40) + done))
                    done += 1
            columns = list(zip(*cells)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in columns)], names=list(schema))
        give_back()

    return rows.mapInArrow(run, ddl(schema))


class Tournament:
    """The first bin with room: a tree over bins, each inner node holding the largest room below it."""

    def __init__(self, bins: int, room: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for `size`, and the room it had."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        had, bin_ = room[at], at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return bin_, had


def first_fit_decreasing(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and offset of each size, none over `length`. Ties keep their order."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
    tree = Tournament(len(sizes), length)
    for i in order.tolist():
        bins[i], had = tree.place(int(sizes[i]))
        offsets[i] = length - had
    return bins, offsets


def pack(pieces: DataFrame, length: int = LENGTH, group: int = GROUP, seed: int = 11) -> DataFrame:
    """`pieces` with sequence_id and offset: first-fit decreasing in random groups of about `group` pieces.

    Full pieces are sequences by themselves already, so only partial ones need a bin; both go through the same packing.
    Groups are drawn by hash from `deal`, which every piece has of its own, so copies of one document spread out.
    """
    groups = max(1, round(pieces.count() / group))
    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = {"doc_id": kind, "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("deal", F.lit(seed)), F.lit(groups)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remember()
        for number, held in _groups(batches):
            bins, offsets = first_fit_decreasing(held["length"].to_numpy(), length)
            columns = [held[c].combine_chunks() for c in list(schema)[:5]]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((number << 32) + bins), pa.array(offsets)], names=list(schema))

    picked = dealt.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal", "group")
    return picked.repartition("group").sortWithinPartitions("group", "deal").mapInArrow(run, ddl(schema))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The groups of rows that come sorted by `group`, one at a time."""
    number, held = None, []
    for batch in batches:
        found = batch.column(6).to_numpy()
        cuts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.empty(0, dtype=np.int64)
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(found)]):
            if number is not None and found[lo] != number:
                yield number, pa.Table.from_batches(held)
                held = []
            number = int(found[lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield number, pa.Table.from_batches(held)


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", vocabulary: str = "byte_bpe_50k", length: int = LENGTH) -> DataFrame:
    """Every document's ids, cut in pieces and packed: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each id lies in exactly one piece. A null or empty text has the end id alone; repeated rows and null ids are packed
    like any other; an empty table gives an empty one; other columns of `docs`, whatever their names, play no part. Pieces
    of equal length are placed in the order of their partition and row; texts of any length are encoded whole.
    """
    return pack(durable(token_pieces(docs, text, doc_id, vocabulary, length)), length)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
