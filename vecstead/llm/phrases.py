"""Phrases of words that go together: frequent n-grams by count-min sketches and an exact second count, scored and subsumed.

Each task counts the n-grams of its texts in a sketch; the tasks' sketches are merged by a shuffle of their cells. A cell's
count is at least that of any n-gram in it, so an n-gram of which one cell stays under the least count is rare, and nothing
frequent is lost. What is sent back to the tasks is a bit for each cell. Words and pairs come first; longer n-grams enter
their sketch only if all their pairs may be frequent, which keeps it sparse. At last the survivors alone are counted, exactly
and by their text. The sketches grow with the texts up to MOST_BITS; in longer corpora cells are fuller, more n-grams
survive to the exact count, and the result is the same.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecstead.llm.common import as_bytes, batch_of, ddl, durable, quoted, table, written

#: Least occurrences of a candidate, its most words, and the rows of a language that are returned.
LEAST, LONGEST, FIRST = 100, 5, 2000
#: Bytes that end a piece, and bytes between words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Rows of a sketch; log2 of its cells at least and at most (a bit for each cell and row is broadcast: 64 MB); n-grams that
#: share a cell on average; and ranges of cells that are merged by themselves.
DEPTH, LEAST_BITS, MOST_BITS, LOAD, RANGES = 2, 16, 28, 16, 256
#: The lengths that share a sketch, in the order of the passes.
PASSES = ((1, 2), (3, 4, 5))
#: Bytes of text that a task holds as words at once; and rows, of languages or counts, that are broadcast at most.
BLOCK, MOST_SENT = 4 << 20, 100_000
#: Counts of phrases that a task gathers before it adds up equal ones; parts of phrases that are merged by themselves, at least.
GATHERED, LEAST_PARTS = 400_000, 64
#: Rows of a language that one task orders at once, and groups that meet in the next step.
ORDERED, FAN = 1 << 16, 32

_KINDS = bytes(2 if x in BREAKS else 1 if x in BLANKS else 0 for x in range(256))
_ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


@dataclass
class Words:
    """The words of some texts: each one's language, piece and code, and the distinct words that codes stand for."""

    lang: np.ndarray
    piece: np.ndarray
    code: np.ndarray
    vocabulary: pa.Array
    hashes: np.ndarray


def words_of(texts: list[bytes], langs: np.ndarray, lang_hashes: np.ndarray) -> Words:
    """The words of `texts`, A-Z lower-cased; `langs` numbers each text's language."""
    joined = b"\n".join(texts).lower()
    kind = np.frombuffer(joined.translate(_KINDS), dtype=np.uint8)
    inside = np.zeros(len(kind) + 2, dtype=np.int8)
    inside[1:-1] = kind == 0
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
    begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
    lang = langs[np.searchsorted(begins, starts, side="right") - 1]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = np.frombuffer(joined, dtype=np.uint8)[kind == 0]
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, found.dictionary.to_pylist()), dtype=np.uint64, count=len(found.dictionary))
    code = found.indices.to_numpy()
    hashes = own[code] + lang_hashes[lang]
    return Words(lang, piece, code, found.dictionary, hashes)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cells(grams: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each n-gram's hash in a row of a sketch of 2^bits cells."""
    return (_mixed(grams * _ODD[row] + np.uint64(row)) >> np.uint64(64 - bits)).astype(np.uint32)


@dataclass
class Frequent:
    """Of a merged sketch, which cells have LEAST or more: a row of bits for each row of the sketch."""

    lengths: tuple[int, ...]
    bits: int
    marks: np.ndarray

    def may_hold(self, grams: np.ndarray) -> np.ndarray:
        out = np.ones(len(grams), dtype=bool)
        for row, marks in enumerate(self.marks):
            at = cells(grams, row, self.bits)
            out &= (marks[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
        return out


def grams_of(words: Words, lengths: tuple[int, ...], known: list[Frequent]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, hashes) of the n-grams within pieces that `known` does not rule out, by themselves or by their pairs."""
    n = len(words.code)
    tests = {length: k for k in known for length in k.lengths}
    pairs = None
    hashes = words.hashes
    for length in range(1, max(lengths) + 1):
        if n < length:
            return
        if length > 1:
            hashes = _mixed(hashes[: n - length + 1]) + words.hashes[length - 1 :]
        alive = np.flatnonzero(words.piece[: n - length + 1] == words.piece[length - 1 :])
        if length > 2 and pairs is not None:
            for i in range(length - 1):
                alive = alive[pairs[alive + i]]
        if length in tests:
            alive = alive[tests[length].may_hold(hashes[alive])]
            if length == 2:
                pairs = np.zeros(n, dtype=bool)
                pairs[alive] = True
        if length in lengths:
            yield length, alive, hashes[alive]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """The words of batches (lang, text) in blocks of about BLOCK bytes, and the languages by number. Long texts are cut between pieces."""
    texts, langs, names, held = [], [], {}, 0

    def made() -> tuple[Words, list[str]]:
        known = list(names)
        hashes = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed=1) for x in known], dtype=np.uint64)
        return words_of(texts, np.array(langs, dtype=np.int32), hashes), known

    for batch in batches:
        for lo in range(0, len(batch), 200):
            part = batch.slice(lo, 200)
            for lang, text in zip(part.column(0).to_pylist(), as_bytes(part.column(1))):
                for piece in cut(text or b"", BLOCK):
                    texts.append(piece)
                    langs.append(names.setdefault(lang, len(names)))
                    held += len(piece)
                    if held >= BLOCK:
                        yield made()
                        texts, langs, names, held = [], [], {}, 0
    if texts:
        yield made()


def cut(text: bytes, size: int) -> Iterator[bytes]:
    """`text` cut after ends of pieces, the first at or past every `size` bytes."""
    lo = 0
    while len(text) - lo > size:
        at = min((x for x in (text.find(bytes([b]), lo + size) for b in BREAKS) if x >= 0), default=-1)
        if at < 0:
            break
        yield text[lo : at + 1]
        lo = at + 1
    yield text[lo:]


def _packed(values: np.ndarray, pack: zstandard.ZstdCompressor) -> bytes:
    """Ascending numbers, repeats included, as compressed differences, byte planes apart."""
    apart = np.diff(values, prepend=np.uint32(0)).astype("<u4")
    return pack.compress(apart.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").reshape(-1), dtype=np.uint32)


def sketch_bits(size: int, lengths: int) -> int:
    """log2 of a sketch's cells for texts of `size` bytes, at about six bytes a word."""
    return min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, size * lengths / (6 * LOAD))))))


def frequent(texts: DataFrame, lengths: tuple[int, ...], bits: int, known: list[Frequent], least: int = LEAST) -> Frequent:
    """The merged sketch of the n-grams of `texts` (lang, text) that `known` doesn't rule out, as bits.

    A task's counts over `least` are cut to it, which changes no bit.
    """
    sent = texts.sparkSession.sparkContext.broadcast(known)
    inner = bits - RANGES.bit_length() + 1
    schema = {"part": "int", "cells": "binary"}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for words, _ in _blocks(batches):
            grams = [hashes for _, _, hashes in grams_of(words, lengths, sent.value)]
            grams = np.concatenate(grams) if grams else np.zeros(0, dtype=np.uint64)
            for row in range(DEPTH):
                at = np.sort(cells(grams, row, bits))
                if len(at) > least:  # of a cell's run, what stands `least` places after an equal is too much
                    at = at[np.r_[np.ones(least, dtype=bool), at[least:] != at[:-least]]]
                edges = np.searchsorted(at, np.arange(RANGES + 1, dtype=np.uint64) << np.uint64(inner))
                parts = [i for i in range(RANGES) if edges[i] < edges[i + 1]]
                inside = at & np.uint32((1 << inner) - 1)
                yield batch_of(schema, [[row * RANGES + i for i in parts], [_packed(inside[edges[i] : edges[i + 1]], pack) for i in parts]])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = None, None

        pack = zstandard.ZstdCompressor(level=1)

        def bits_of(sums: np.ndarray) -> bytes:
            return pack.compress(np.packbits(sums >= least, bitorder="little").tobytes())

        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if at != part:
                    if part is not None:
                        yield batch_of(schema, [[part], [bits_of(sums)]])
                    part, sums = at, np.zeros(1 << inner, dtype=np.int64)
                sums += np.bincount(_unpacked(raw.as_py()), minlength=1 << inner)
        if part is not None:
            yield batch_of(schema, [[part], [bits_of(sums)]])

    rows = texts.mapInArrow(count, ddl(schema)).repartition("part").sortWithinPartitions("part").mapInArrow(merge, ddl(schema))
    marks = np.zeros((DEPTH * RANGES, max(1, (1 << inner) // 8)), dtype=np.uint8)
    found = rows.toArrow()
    for part, raw in zip(found["part"].to_pylist(), found["cells"]):
        marks[part] = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw.as_py()), dtype=np.uint8)
    return Frequent(tuple(lengths), bits, marks.reshape(DEPTH, -1))


def phrase_counts(texts: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, phrase, words, n): the exact count of each phrase of up to `longest` words that occurs `least` times or more.

    Rows of no words have each language's number of all words.
    """
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    known: list[Frequent] = []
    for lengths in PASSES:
        lengths = tuple(x for x in lengths if x <= longest)
        if lengths:
            known = [*known, frequent(texts, lengths, sketch_bits(size, len(lengths)), known, least)]
    sent = texts.sparkSession.sparkContext.broadcast(known)
    schema = {"lang": "string", "phrase": "string", "words": "int", "n": "bigint"}
    packed, parts = {"part": "int", "counts": "binary"}, max(LEAST_PARTS, size // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for words, names in _blocks(batches):
            names = pa.array(names, pa.string())
            totals = np.bincount(words.lang, minlength=len(names))
            held.append(batch_of({"part": "int"} | schema, [[0] * len(names), names, [""] * len(names), [0] * len(names), totals]))
            for length, places, hashes in grams_of(words, tuple(range(1, longest + 1)), sent.value):
                own, first, times = np.unique(hashes, return_index=True, return_counts=True)
                at = places[first]
                texts = [words.vocabulary.take(pa.array(words.code[at + i])) for i in range(length)]
                phrase = pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.large_binary())) if length > 1 else texts[0]
                phrase = phrase.cast(pa.large_string()).cast(pa.string())
                held.append(batch_of({"part": "int"} | schema, [(_mixed(own) % np.uint64(parts)).astype(np.int32), names.take(pa.array(words.lang[at])), phrase, np.full(len(at), length, dtype=np.int32), times]))
                size += len(at)
            if size >= GATHERED:
                held = [_added(pa.Table.from_batches(held), "part")]
                size = len(held[0])
                if size > GATHERED // 2:  # mostly different ones
                    yield _sent_parts(held[0], packed)
                    held, size = [], 0
                else:
                    held = held[0].to_batches()
        if held:
            yield _sent_parts(_added(pa.Table.from_batches(held), "part"), packed)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [], 0

        def frequent_ones() -> Iterator[pa.RecordBatch]:
            sums = _added(pa.concat_tables(held))
            yield from sums.filter(pc.or_(pc.equal(sums["words"], 0), pc.greater_equal(sums["n"], least))).to_batches(max_chunksize=10_000)

        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if at != part:
                    if held:
                        yield from frequent_ones()
                    part, held, size = at, [], 0
                held.append(pa.ipc.open_stream(raw.as_buffer()).read_all())
                size += len(held[-1])
                if size >= GATHERED and len(held) > 1:
                    held = [_added(pa.concat_tables(held))]
                    size = 0
        if held:
            yield from frequent_ones()

    return texts.mapInArrow(run, ddl(packed)).repartition("part").sortWithinPartitions("part").mapInArrow(merge, ddl(schema))


def _added(counts: pa.Table, *keys: str) -> pa.Table:
    """Equal phrases of `counts` in one row each, their counts added up."""
    names = [*keys, "lang", "phrase", "words"]
    sums = counts.group_by(names).aggregate([("n", "sum")])
    return pa.table({name: sums["n_sum" if name == "n" else name] for name in (*names, "n")})


def _sent_parts(counts: pa.Table, schema: dict[str, str]) -> pa.RecordBatch:
    """A row for each part of `counts`: its phrases and counts, compressed."""
    counts = counts.sort_by([("part", "ascending"), ("phrase", "ascending")]).combine_chunks()
    part = counts["part"].to_numpy()
    edges = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
    rows, options = [], pa.ipc.IpcWriteOptions(compression="zstd")
    for lo, hi in zip(edges[:-1], edges[1:]):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, counts.schema.remove(0), options=options) as out:
            out.write_table(counts.slice(lo, hi - lo).drop_columns(["part"]))
        rows.append(sink.getvalue().to_pybytes())
    return batch_of(schema, [part[edges[:-1]], rows])


def _part(first: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("w", F.lit(first) if isinstance(first, int) else first, F.lit(size) if isinstance(size, int) else size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score): each phrase of two or more words by its lowest-scoring cut, the first of equals.

    All parts of a frequent phrase are frequent, so `counts` has them. Products are decimals of 38 digits, so exact.
    """
    totals = counts.where("words = 0").select(F.col("lang").alias("of"), F.col("n").alias("total"))
    if totals.count() <= MOST_SENT:
        totals = F.broadcast(totals)
    phrases = counts.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _part(1, F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    parts = counts.where("words > 0")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    exact = lambda x: F.col(x).cast("decimal(19,0)")
    cuts = cuts.join(totals, F.col("lang") == F.col("of")).withColumns({"above": F.lit(1000).cast("decimal(4,0)") * (exact("a") * exact("total")).cast("decimal(34,0)"), "below": (exact("l") * exact("r")).cast("decimal(38,0)")})
    cuts = cuts.withColumn("score", F.expr("above div below"))
    lowest = F.min(F.struct("score", "k", "l", "r"))
    out = cuts.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), F.first("total").alias("n"), lowest.alias("cut"))
    return out.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def not_subsumed(phrases: DataFrame, share: int = 100) -> DataFrame:
    """`phrases` without those that lie inside a longer one of `share` per cent of their count or more."""
    spans = [(first, size) for size in range(2, LONGEST) for first in range(1, LONGEST - size + 2)]
    inside = F.filter(F.array(*[F.when((F.col("words") > size) & (F.col("words") >= first + size - 1), _part(first, size)) for first, size in spans]), lambda x: x.isNotNull())
    longer = phrases.where("words > 2").select("lang", "a", "words", F.split("phrase", " ").alias("w")).select("lang", "a", F.explode(inside).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    return phrases.join(most, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def first_of_each(phrases: DataFrame, first: int = FIRST) -> DataFrame:
    """`phrases` with their rank in their language, the `first` of each: by score and count descending, then the phrase.

    Slices of a language are cut to the first ones before they meet, so no task orders a whole language.
    """
    order = [F.desc("score"), F.desc("a"), "phrase"]
    slices = -(-phrases.count() // ORDERED)
    while slices > 1:
        part = F.pmod(F.xxhash64("phrase"), F.lit(slices))
        phrases = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("rank") <= first).drop("rank")
        slices = slices // FAN
    return phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= first)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to LONGEST words.

    A null text is empty, a null language is `und`. Repeated rows count each time; ties go by count, then by the phrase's
    bytes. Texts of any length are counted whole; long ones are cut between pieces only. An empty table, or one without a
    frequent phrase, gives an empty one. Other columns of `docs`, whatever their names, play no part. Within a task,
    n-grams are told apart by 64 bits of hash, between tasks by their text.
    """
    texts = docs.select(F.coalesce(F.col(quoted(lang)).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text"))
    counts = written(phrase_counts(texts, LONGEST, least))
    best = durable(not_subsumed(durable(scored(counts))))
    return first_of_each(best, first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""with docs as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
pieces as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as p from docs),
words as materialized (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from pieces),
totals as materialized (select lang, cast(sum(len(w)) as bigint) as n from words group by lang),
grams as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) as phrase from words, range(1, 6) as t(k)),
f as materialized (select lang, k, phrase, count(*) as a from grams group by lang, k, phrase having count(*) >= 100),
cuts as (
  select lang, k, phrase, a, c, array_to_string(list_slice(w, 1, c), ' ') as one, array_to_string(list_slice(w, c + 1, k), ' ') as two
  from (select *, string_split(phrase, ' ') as w, unnest(range(1, k)) as c from f where k > 1)),
scores as (
  select cuts.lang, cuts.k, cuts.phrase, cuts.a, c, x.a as l, y.a as r, n, cast((1000::hugeint * cuts.a * n) // (x.a::hugeint * y.a) as bigint) as score
  from cuts join f x on x.lang = cuts.lang and x.phrase = one join f y on y.lang = cuts.lang and y.phrase = two join totals on totals.lang = cuts.lang),
lowest as materialized (select * from scores qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inside as (
  select lang, a, array_to_string(list_slice(w, i, i + m - 1), ' ') as phrase
  from (select lang, a, k, m, w, unnest(range(1, k - m + 2)) as i from (select lang, a, k, string_split(phrase, ' ') as w, unnest(range(2, k)) as m from f where k > 2))),
most as (select lang, phrase, max(a) as longer from inside group by lang, phrase)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from lowest left join most using (lang, phrase) where longer is null or 100 * longer < 100 * a
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000"""
