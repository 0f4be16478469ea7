"""Language-model scores by online logistic context mixing.

A text is its words (A-Z lower-cased) and an end. Each token is coded by binary decisions: does the word that followed the
word before earlier in the text come again; does a word follow that training texts had after the two words before, after
the one before, anywhere; and, for a new word, the bits of its letters. Every decision is predicted in several hashed
contexts, whose counts start from all training texts and adapt within the text; the predictions are mixed by gated
weights that learn online, and a last stage refines the mixture adaptively (`mixing`). A token's probability sums over
the ways to reach it, so those of all tokens sum to at most one.

Counts of words, pairs and triples of words are gathered over all training texts and grow with them. They are never
broadcast: texts are cut in blocks, each block sends the distinct keys it asks for (and how often training texts have
them) to the key's part, the parts add up, and each block gets its answers back.
"""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from vecstead.llm import mixing
from vecstead.llm.common import ARROW, batch_of, ddl, fold, new_folder, quoted, table, written
from vecstead.llm.mixing import mixed

#: Bytes of text that make a block (or one text), that are hashed at once, and that make a part of the keys.
BLOCK, AT_ONCE, PART = 4_000_000, 1_000_000, 12_000_000
#: Hashed contexts of the word decisions, and after them one for each kind alone. Bits of a letter predictor's slots, least and most; between them they follow the new words.
CONTEXTS, ALONE = (1 << 16) + 4, (1 << 16) + np.arange(4)
SLOT_BITS = (16, 20)
#: Slots of a row when letter counts are added up, and words that are spelled and counted at once.
CHUNK, TOGETHER, COUNTED = 1 << 15, 4_096, 20_000

MATCH, TRIPLE, PAIR, WORD = 3, 2, 1, 0
_ODD = np.uint64(0xD6E8FEB86659FD93)
_END, _START, _BEFORE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA24BAED4963EE407))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LETTER = np.where(_SPACE, 0, np.arange(256) + 1).astype(np.uint64)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=kind)


class Tokens:
    """The tokens of some texts one after the other: a hash of each, its document, and its place in the lower-cased bytes."""

    def __init__(self, texts: list[bytes | None]) -> None:
        parts, held, size = [], [], 0
        self.texts = len(texts)
        self.bytes = np.array([len(x or b"") for x in texts], dtype=np.int64)
        for raw in texts:
            held.append((raw or b"").lower())
            size += len(held[-1])
            if size > AT_ONCE:
                parts.append(self._read(held))
                held, size = [], 0
        parts.append(self._read(held))
        self.bodies = [x[0] for x in parts]
        docs = np.cumsum([0, *(x[4] for x in parts)])
        self.hash, self.begin, self.end = (np.concatenate([x[k] for x in parts]) for k in (1, 2, 3))
        self.doc = np.concatenate([x[5] + d for x, d in zip(parts, docs)]).astype(np.int64)
        self.part = np.repeat(np.arange(len(parts)), [len(x[1]) for x in parts])
        self.first = np.flatnonzero(np.r_[True, self.doc[1:] != self.doc[:-1]]) if len(self.doc) else np.empty(0, dtype=np.int64)
        self.step = np.arange(len(self.doc)) - np.repeat(self.first, np.diff(np.r_[self.first, len(self.doc)]))

    @staticmethod
    def _read(texts: list[bytes]) -> tuple:
        body = b"\n".join(texts) + b"\n" if texts else b""
        codes = np.frombuffer(body, dtype=np.uint8)
        space = _SPACE[codes]
        starts = np.flatnonzero(~space & np.r_[True, space[:-1]]) if len(codes) else np.empty(0, dtype=np.int64)
        ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1 if len(codes) else starts
        edges = np.cumsum([len(x) + 1 for x in texts])
        if len(starts):
            length = ends - starts
            powers = np.full(int(length.max()) + 1, _ODD)
            powers[0] = 1
            powers = np.cumprod(powers)
            place = np.arange(len(codes)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(codes)]))
            sums = np.add.reduceat(_LETTER[codes] * powers[np.minimum(place, len(powers) - 1)], starts)
            hashes = mixed(sums)
        else:
            hashes = np.empty(0, dtype=np.uint64)
        doc = np.searchsorted(edges, starts, side="right")
        where = np.arange(len(texts))
        order = np.argsort(np.r_[2 * doc, 2 * where + 1], kind="stable")  # an end after each text's words
        last = (edges - 1).astype(np.int64)
        return body, np.r_[hashes, np.full(len(texts), _END)][order], np.r_[starts, last][order], np.r_[ends, last][order], len(texts), np.r_[doc, where][order]

    def word(self, i: int) -> bytes:
        return self.bodies[self.part[i]][self.begin[i] : self.end[i]]

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A key of each token alone, with the token before, and with the two before."""
        one, two = np.r_[_START, self.hash[:-1]], np.r_[_BEFORE, _START, self.hash[:-2]][: len(self.hash)]
        one[self.first] = _START
        two[self.first] = _BEFORE
        later = self.first[np.flatnonzero(np.r_[np.diff(self.first), len(self.doc) - self.first[-1]] > 1)] + 1 if len(self.first) else self.first
        two[later] = _START
        pair = mixed(one * _ODD + self.hash)
        return self.hash, pair, mixed((two * _ODD + one) * mixing._SPREAD + self.hash)

    def matches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a bet is laid on each token (that what followed the last occurrence of the token before comes again), whether it is won, and the bets won in a row."""
        n = len(self.hash)
        order = np.lexsort((self.hash, self.doc))
        same = (self.hash[order[1:]] == self.hash[order[:-1]]) & (self.doc[order[1:]] == self.doc[order[:-1]])
        last = np.full(n, -1)
        last[order[1:][same]] = order[:-1][same]
        laid = np.r_[False, last[:-1] >= 0][:n]
        laid[self.first] = False
        won = laid & (self.hash[np.minimum(np.r_[-1, last[:-1]][:n] + 1, n - 1)] == self.hash)
        at = np.arange(n)
        run = at - np.maximum.accumulate(np.where(won, -1, at)) if n else at
        before = np.r_[0, run[:-1]][:n]
        before[self.first] = 0
        return laid, won, before


def _codes(key: np.ndarray, parts: int, order: int) -> np.ndarray:
    """Distinct keys' part and rest in one number. Words keep all 64 bits, so their part is of the highest."""
    if not order:
        return key
    return ((key & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)) << np.uint64(32) | key >> np.uint64(32)


def _part_of(codes: np.ndarray, parts: int, order: int) -> np.ndarray:
    return ((codes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32) if not order else codes >> np.uint64(32)).astype(np.int64)


def _asked(tokens: Tokens, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order: the distinct codes of a block, ascending, and each token's place among them."""
    return [np.unique(_codes(key, parts, order), return_inverse=True) for order, key in enumerate(tokens.keys())]


def _blocks(docs: DataFrame, text: str, learn: Column) -> tuple[DataFrame, int]:
    """(block, body, size): the rows in compressed blocks of about BLOCK bytes of text, as a table bucketed by block; and all bytes.

    The last two columns of a body are the text and whether the row is learned from.
    """
    spark = docs.sparkSession
    rows = docs.withColumns({"__text": F.col(quoted(text)), "__learn": F.coalesce(learn, F.lit(False)), "__part": F.spark_partition_id().cast("bigint")}).drop(text)
    schema = {"block": "bigint", "body": "binary", "size": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, options = 0, pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            if not len(batch):
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 3)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            number = np.cumsum(sizes) // BLOCK
            cuts = np.flatnonzero(np.r_[True, np.diff(number) > 0, True])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(lo, hi - lo)
                sink = pa.BufferOutputStream()
                part = part.select(list(range(part.num_columns - 1)))
                with pa.ipc.new_stream(sink, part.schema, options=options) as stream:
                    stream.write_batch(part)
                yield batch_of(schema, [[(batch.column(batch.num_columns - 1)[0].as_py() << 32) + done], pa.array([sink.getvalue().to_pybytes()], pa.binary()), [int(sizes[lo:hi].sum())]])
                done += 1

    name, folder = f"blocks_{uuid.uuid4().hex}", new_folder(spark, "blocks")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.mapInArrow(run, ddl(schema)).write.option("compression", "none").bucketBy(buckets, "block").sortBy("block").format("parquet").option("path", folder).saveAsTable(name)
    atexit.register(_drop, spark, name)
    blocks = spark.table(name)
    return blocks, blocks.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


def _drop(spark: SparkSession, name: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        spark.sql(f"drop table if exists {name}")


def _body(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(batch.num_columns - 2).cast(pa.binary()).to_pylist()


def _learned(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)


def _answers(blocks: DataFrame, parts: int) -> DataFrame:
    """(block, part, kind, body): for each block and order the counts of its codes; block -1 has words' totals: N, V.

    Each block sends a code once, so a common word or passage makes no large group; a part has about PART bytes of text.
    """
    schema = {"part": "int", "kind": "int", "block": "bigint", "codes": "binary", "counts": "binary"}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = _body(raw.as_py())
                tokens, learned = Tokens(_texts(body)), _learned(body)
                for order, (codes, back) in enumerate(_asked(tokens, parts)):
                    counts = np.bincount(back, learned[tokens.doc], minlength=len(codes)).astype("<u4")
                    part = _part_of(codes, parts, order)
                    cuts = np.flatnonzero(np.r_[True, np.diff(part) > 0, True])
                    rows = [[], [], [], [], []]
                    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                        sent = codes[lo:hi] if not order else (codes[lo:hi] & np.uint64(0xFFFFFFFF)).astype("<u4")
                        for column, x in zip(rows, (int(part[lo]), order, block, _pack(np.diff(sent, prepend=sent.dtype.type(0))), _pack(counts[lo:hi]))):
                            column.append(x)
                    yield batch_of(schema, rows)

    answered = {"block": "bigint", "part": "int", "kind": "int", "body": "binary"}

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part, order), rows in _grouped(batches):
            kind = "<u4" if order else "<u8"
            codes = [np.cumsum(_unpack(x, kind), dtype=kind) for _, x, _ in rows]
            counts = np.concatenate([_unpack(x, "<u4") for _, _, x in rows])
            ends = np.cumsum(list(map(len, codes)))
            distinct, back = np.unique(np.concatenate(codes), return_inverse=True)
            total = np.bincount(back, counts, minlength=len(distinct)).astype(np.int64)
            if not order:
                yield batch_of(answered, [[-1], [part], [order], [np.array([total.sum(), (total > 0).sum()], dtype="<i8").tobytes()]])
            for (block, *_), lo, hi in zip(rows, [0, *ends[:-1].tolist()], ends.tolist()):
                yield batch_of(answered, [[block], [part], [order], [_pack(total[back[lo:hi]].astype("<u8" if not order else "<u4"))]])

    sent = blocks.select("block", "body").mapInArrow(ask, ddl(schema))
    return written(sent.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(answer, ddl(answered)))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[tuple]]]:
    """Rows (part, kind, block, codes, counts) that come sorted, by part and kind, one group at a time."""
    name, held = None, []
    for batch in batches:
        for part, kind, block, codes, counts in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if name is not None and (part, kind) != name:
                yield name, held
                held = []
            name = (part, kind)
            held.append((block, codes, counts))
    if held:
        yield name, held


@dataclass
class Model:
    """What tasks need beside a block's own counts: totals, the contexts' counts, the letters' counts. Of bounded size."""

    total: int
    distinct: int
    texts: int
    parts: int
    contexts: np.ndarray
    letters: np.ndarray
    slot_bits: int

    @cached_property
    def odds(self) -> np.ndarray:
        """What the letters' counts come to; made once in each Python worker."""
        return mixing.letter_table(self.letters)


class Decisions:
    """The word decisions of a block: for each token the counts that bear on it, and the rows of all decisions."""

    def __init__(self, tokens: Tokens, counts: list[np.ndarray], texts: int, left_out: int = 0) -> None:
        """`left_out` of each count is the token's own."""
        word, pair, triple = (c.astype(np.int64) for c in counts)
        first = tokens.first
        before_word, before_pair = np.r_[0, word[:-1]], np.r_[0, pair[:-1]]
        before_word[first], before_pair[first] = texts, 0
        self.word, self.pair, self.triple = (np.maximum(x - left_out, 0) for x in (word, pair, triple))
        self.after_word, self.after_pair = (np.maximum(x - left_out, 0) for x in (before_word, before_pair))
        self.laid, self.won, run = tokens.matches()
        level = np.where(self.won, 4, np.where((self.triple > 0) & (self.after_pair > 0), 3, np.where((self.pair > 0) & (self.after_word > 0), 2, np.where(self.word > 0, 1, 0))))
        one, two = np.r_[5, level[:-1]][: len(level)], np.r_[5, 5, level[:-2]][: len(level)]
        one[first] = 5
        two[first] = 5
        two[np.minimum(first + 1, len(level) - 1)] = 5
        history = one * 6 + two
        bucket = lambda x: np.frexp(x.astype(np.float64))[1]
        state, after_word, after_pair = np.minimum(bucket(run), 6), bucket(self.after_word), bucket(self.after_pair)
        before = np.r_[_START, tokens.hash[:-1]]
        before[first] = _START
        before = (before >> np.uint64(48)).astype(np.int64)
        missed = [~self.won, ~self.won & (level < 3), ~self.won & (level < 2)]
        kinds = (
            (MATCH, self.laid, self.won, (state, history * 8 + state, before)),
            (TRIPLE, (self.after_pair > 0) & missed[0], level == 3, (after_pair, history, (after_pair * 8 + one) * 64 + after_word)),
            (PAIR, (self.after_word > 0) & missed[1], level == 2, (after_word, history, (after_word * 8 + one) * 2 + (after_pair > 0))),
            (WORD, missed[2], level == 1, (history, before, tokens.step.clip(0, 3) * 8 + one)),
        )
        rows = [np.flatnonzero(asked) for _, asked, _, _ in kinds]
        self.token = np.concatenate(rows)
        self.kind = np.repeat([k for k, *_ in kinds], list(map(len, rows)))
        self.bit = np.concatenate([bit[at] for (_, _, bit, _), at in zip(kinds, rows)]).astype(np.float64)
        self.contexts = np.stack([np.concatenate([c[j][at] for (*_, c), at in zip(kinds, rows)]) for j in range(3)], axis=1)

    def slots(self) -> np.ndarray:
        """(rows, 4) hashed contexts of each decision's predictors; the last is of its kind alone."""
        named = self.contexts.astype(np.uint64)
        named *= np.uint64(32)
        named += (self.kind * 4)[:, None].astype(np.uint64) + np.arange(3, dtype=np.uint64)
        return np.c_[(mixed(named) >> np.uint64(48)).astype(np.int64) % (1 << 16), ALONE[self.kind]]

    def chances(self, tokens: Tokens, contexts: np.ndarray) -> np.ndarray:
        """(4, tokens) the mixed and refined chance of each kind's decision; zero where it isn't asked."""
        order = np.lexsort((-self.kind, self.token))
        token, kind, bit, own = self.token[order], self.kind[order], self.bit[order], self.contexts[order]
        doc, slots = tokens.doc[token], self.slots()[order]
        step = np.arange(len(doc)) - np.searchsorted(doc, np.arange(tokens.texts))[doc]
        inputs = np.empty((len(doc), 4))
        for j in range(4):
            zero, one = contexts[slots[:, j]].T
            start = np.clip((one + 0.4) / (zero + one + 0.8), 1e-5, 1 - 1e-5)
            name = (doc * 8 + kind) * (1 << 22) + (own[:, j] if j < 3 else 0)
            inputs[:, j] = 0.3 * mixing.stretch(np.clip(mixing.adapted(name, bit, start), 1e-5, 1 - 1e-5))
            if not j:
                seen = np.minimum(np.frexp(zero + one)[1] // 4, 3)
        p = mixing.mix(doc, step, kind * 4 + seen, inputs, bit, 16)
        p = mixing.refined(doc, kind, np.clip(p, 1e-6, 1 - 1e-6), bit)
        out = np.zeros((4, len(tokens.hash)))
        # a token that a higher kind predicts has its lower ways too, at the kind's mean chance
        for k, open_ in ((TRIPLE, self.after_pair > 0), (PAIR, self.after_word > 0), (WORD, np.ones(len(tokens.hash), dtype=bool))):
            zero, one = contexts[ALONE[k]]
            out[k, open_] = (one + 0.4) / (zero + one + 0.8)
        out[kind, token] = p
        return out


def spelled(tokens: Tokens, new: np.ndarray, model: Model) -> np.ndarray:
    """log10 probabilities of the letters of the tokens `new` (ascending), each text's weights learning as it goes on."""
    out, at = np.empty(len(new)), np.arange(len(new))
    doc_of = tokens.doc[new]
    first = np.searchsorted(doc_of, doc_of)
    long = np.searchsorted(doc_of, doc_of, side="right") - first > TOGETHER
    for lo in np.unique(first[long]):
        rows = at[first == lo]
        out[rows] = _spelled_long(tokens, new[rows], model)
    # others are computed together, about TOGETHER words at once; a text's words stay together, so what is beside it changes nothing
    short = at[~long]
    piece = first[short] // TOGETHER
    cuts = np.flatnonzero(np.r_[True, np.diff(piece) > 0, True]) if len(short) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        part = new[short[lo:hi]]
        owner, bits, inputs = mixing.letter_inputs([tokens.word(i) for i in part.tolist()], model.odds, model.slot_bits)
        doc = tokens.doc[part][owner]
        step = np.arange(len(doc)) - np.searchsorted(doc, np.arange(doc[0], doc[-1] + 1))[doc - doc[0]]
        kind = np.zeros(len(doc), dtype=np.int64)
        p = np.clip(mixing.mix(doc, step, kind, inputs, bits, 1), 1e-6, 1 - 1e-6)
        p = mixing.refined(doc, kind, p, bits)
        out[short[lo:hi]] = np.bincount(owner, np.log10(np.where(bits > 0, p, 1 - p)), minlength=len(part))
    return out


def _spelled_long(tokens: Tokens, new: np.ndarray, model: Model) -> np.ndarray:
    """The same of one text of many new words, TOGETHER at a time: weights and what was shown go on, and rounds stay whole."""
    out, weights, shown = np.zeros(len(new)), np.ones((1, len(mixing.ORDERS))), mixing.Shown()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    done = 0
    for lo in range(0, len(new), TOGETHER):
        owner, bits, inputs = mixing.letter_inputs([tokens.word(i) for i in new[lo : lo + TOGETHER].tolist()], model.odds, model.slot_bits)
        held.append((owner + lo, bits, inputs))
        owner, bits, inputs = (np.concatenate(x) for x in zip(*held))
        ready = len(bits) if lo + TOGETHER >= len(new) else max(0, mixing.whole_rounds(done + len(bits)) - done)
        zero = np.zeros(ready, dtype=np.int64)
        p = np.clip(mixing.mix(zero, done + np.arange(ready), zero, inputs[:ready], bits[:ready], 1, weights), 1e-6, 1 - 1e-6)
        p = shown.refined(p, bits[:ready])
        out += np.bincount(owner[:ready], np.log10(np.where(bits[:ready] > 0, p, 1 - p)), minlength=len(new))
        held, done = [(owner[ready:], bits[ready:], inputs[ready:])], done + ready
    return out


def score_block(tokens: Tokens, answers: list[np.ndarray], model: Model) -> dict[str, np.ndarray]:
    """Each text's n_tokens, n_known, base_score, score and bits_per_byte; `answers` has each order's counts by token."""
    found = Decisions(tokens, answers, model.texts)
    match, triple, pair, word = found.chances(tokens, model.contexts)[[MATCH, TRIPLE, PAIR, WORD]]
    base = (found.word + 1) / (model.total + model.distinct + 1)
    chance = word * found.word / max(1, model.total)
    chance = pair * found.pair / np.maximum(1, found.after_word) + (1 - pair) * chance
    chance = triple * found.triple / np.maximum(1, found.after_pair) + (1 - triple) * chance
    chance = match * found.won + (1 - match) * chance
    log = np.log10(np.clip(chance, 1e-300, 1.0))
    new = np.flatnonzero(found.word == 0)  # to be spelled, unless the bet is won
    letters = spelled(tokens, new, model) + sum(np.log10(1 - x[new]) for x in (word, pair, triple, match))
    log[new] = np.where(found.won[new], np.logaddexp(log[new] * np.log(10), letters * np.log(10)) / np.log(10), letters)
    total = lambda x: np.bincount(tokens.doc, x, minlength=tokens.texts)
    score = total(log)
    return {
        "n_tokens": total(np.ones(len(tokens.hash))).astype(np.int64), "n_known": total(found.word > 0).astype(np.int64),
        "base_score": total(np.log10(base)), "score": score, "bits_per_byte": -score / np.log10(2) / (tokens.bytes + 1),
    }


def _by_block(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """(body, answers) of each block: its compressed rows and the parts' answers."""
    own = answers.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("kind", "part", "body")).alias("answers"))
    return blocks.select("block", "body").join(own, "block", "left").select("body", "answers")


def _read(batch: pa.RecordBatch, i: int, parts: int) -> tuple[pa.RecordBatch, Tokens, list[np.ndarray]]:
    """A block's rows, its tokens, and each order's counts by token."""
    body = _body(batch.column(0)[i].as_py())
    tokens = Tokens(_texts(body))
    by: dict[int, list] = {0: [], 1: [], 2: []}
    for x in batch.column(1)[i].as_py() or []:
        by[x["kind"]].append((x["part"], x["body"]))
    counts = []
    for order, (_, back) in enumerate(_asked(tokens, parts)):
        found = [_unpack(raw, "<u8" if not order else "<u4") for _, raw in sorted(by[order])]
        counts.append(np.concatenate(found)[back] if found else np.zeros(0, dtype=np.int64))
    return body, tokens, counts


def _learn(joined: DataFrame, parts: int, texts: int, slot_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the word decisions' contexts, over every training token as if it had not been counted, and of the letters
    of the words that the training texts have once, which are most like new words. Whole numbers, so no order matters."""
    schema = {"chunk": "int", "cells": "binary"}
    slots = len(mixing.ORDERS) << slot_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, letters = np.zeros((CONTEXTS, 2)), np.zeros((len(mixing.ORDERS), 1 << slot_bits, 2), dtype=np.float32)
        for batch in batches:
            for i in range(len(batch)):
                body, tokens, counts = _read(batch, i, parts)
                learned = _learned(body)
                found = Decisions(tokens, counts, texts, left_out=1)
                keep = learned[tokens.doc[found.token]]
                cells = (found.slots()[keep] * 2 + found.bit[keep].astype(np.int64)[:, None]).reshape(-1)
                contexts += np.bincount(cells, minlength=2 * CONTEXTS).reshape(-1, 2)
                once = np.flatnonzero((counts[0] == 1) & learned[tokens.doc])
                for lo in range(0, len(once), COUNTED):
                    mixing.count_letters([tokens.word(k) for k in once[lo : lo + COUNTED].tolist()], letters, slot_bits)
        for start, cells in ((0, contexts.astype(np.float32)), (1 << 20, letters)):
            cells = cells.reshape(-1, 2)
            for lo in range(0, len(cells), CHUNK):
                if cells[lo : lo + CHUNK].any():
                    yield batch_of(schema, [[start + lo // CHUNK], [_pack(cells[lo : lo + CHUNK])]])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[chunk] = sums.get(chunk, 0.0) + _unpack(cells, "<f4").astype(np.float64)
        for chunk, cells in sums.items():
            yield batch_of(schema, [[chunk], [_pack(cells.astype(np.float32))]])

    contexts, letters = np.zeros((CONTEXTS, 2), dtype=np.float32), np.zeros((slots, 2), dtype=np.float32)
    for row in joined.mapInArrow(count, ddl(schema)).repartition("chunk").mapInArrow(add, ddl(schema)).toLocalIterator():
        cells = _unpack(bytes(row.cells), "<f4").reshape(-1, 2)
        lo, out = (row.chunk * CHUNK, contexts) if row.chunk < 1 << 20 else ((row.chunk - (1 << 20)) * CHUNK, letters)
        out[lo : lo + len(cells)] = cells
    return contexts, letters.reshape(len(mixing.ORDERS), -1, 2)


def score_texts(docs: DataFrame, learn: Column, text: str = "text") -> DataFrame:
    """`docs`, without its text, with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte, learned from the rows where `learn` holds.

    Null and empty texts have the end alone; a null `learn` is false. Where nothing was learned, every bit starts even and
    base_score is 0 for each token. Repeated rows each get their row and count each; an empty table gives an empty one;
    columns of `docs` with the new names are replaced. Texts of any length are read whole. Nothing depends on an order
    among equals. Words are told apart by 64 bits of hash, pairs and triples by 32 bits within a part.
    """
    spark = docs.sparkSession
    fields = {"n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double", "bits_per_byte": "double"}
    kept = [c for c in docs.columns if c.lower() not in {*fields, text.lower()}]
    inner = [f"__{i}" for i in range(len(kept))]
    rows = docs.select(*[F.col(quoted(c)).alias(i) for c, i in zip(kept, inner)], F.col(quoted(text)).alias("__body"), learn.alias("__taught"))
    blocks, size = _blocks(rows, "__body", F.col("__taught"))
    parts = max(4, -(-size // PART))
    answers = _answers(blocks, parts)
    total = distinct = 0
    for row in answers.where("block < 0").toLocalIterator():
        n, v = np.frombuffer(bytes(row.body), dtype="<i8").tolist()
        total, distinct = total + n, distinct + v
    taught = rows.where("__taught").count()
    slot_bits = int(np.clip(np.ceil(np.log2(distinct + 1)) - 4, *SLOT_BITS))
    joined = _by_block(blocks, answers)
    contexts, letters = _learn(joined, parts, taught, slot_bits)
    sent = spark.sparkContext.broadcast(Model(total, distinct, taught, parts, contexts, letters, slot_bits))  # at most 5 * 2^20 letter slots

    schema = rows.select(*inner).schema
    for name, kind in fields.items():
        schema = schema.add(f"__new_{name}", from_arrow_type(ARROW[kind]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for i in range(len(batch)):
                body, tokens, counts = _read(batch, i, model.parts)
                scored = score_block(tokens, counts, model)
                scored["train_tokens"] = np.full(len(body), model.total)
                yield pa.RecordBatch.from_arrays([*body.columns[: len(inner)], *(pa.array(scored[x], ARROW[k]) for x, k in fields.items())], names=schema.names)

    return joined.mapInArrow(run, schema).toDF(*kept, *fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out"))
    return score_texts(docs, ~F.col("held_out"))
