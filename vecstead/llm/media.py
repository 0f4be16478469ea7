"""Media columns: AVI motion-JPEG files in a binary column, their frames, and the shots in them.

`write_avi` stores bytes losslessly. A JPEG's entropy-coded unit is the quantised coefficient, so each byte becomes one:
byte v is the coefficient v if v > 127 and v - 255 otherwise, which are the 256 values of size category 8. With Huffman
tables whose only code is `0` for that category, a coefficient takes nine bits, a block of 64 takes 72 bytes, and a restart
marker after each block keeps the DC term undifferenced. The result is plain baseline JPEG, which any decoder reads.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecstead.llm.common import append_columns, as_bytes, ddl, quoted, table

SIDE = 32
BLOCKS = (SIDE // 8) ** 2
FRAMES_PER_SECOND = 25
#: Shots: a histogram difference over the mean of the last WINDOW plus DEVIATIONS times their deviation, and over LEAST.
WINDOW, DEVIATIONS, LEAST = 8, 2.5, 0.15
BINS = 16


def _zigzag() -> np.ndarray:
    cells = sorted(((i, j) for i in range(8) for j in range(8)), key=lambda c: (c[0] + c[1], c[0] if (c[0] + c[1]) % 2 else c[1]))
    return np.array([8 * i + j for i, j in cells])


ZIGZAG = _zigzag()
_SCALE = 1 << 12
_ANGLES = np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16)
#: The inverse DCT's basis in fixed point, so that every machine gets the same pixels.
BASIS = np.rint(_ANGLES * np.where(np.arange(8)[:, None] == 0, np.sqrt(1 / 8), 0.5) * _SCALE).astype(np.int64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_ONE_CODE = bytes([1]) + bytes(15) + b"\x08"
_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + bytes([1]) * 64)
    + _segment(0xC0, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, b"\x00" + _ONE_CODE)
    + _segment(0xC4, b"\x10" + _ONE_CODE)
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
)
_RESTARTS = np.array([[0xFF, 0xD0 + i % 8] for i in range(BLOCKS)], dtype=np.uint8)


def write_frames(payload: bytes) -> list[bytes]:
    """JPEG frames that hold `payload`; zeros fill the last."""
    room = 64 * BLOCKS
    count = max(1, -(-len(payload) // room))
    values = np.frombuffer(payload + bytes(count * room - len(payload)), dtype=np.uint8).reshape(-1, 64, 1)
    bits = np.zeros((len(values), 64, 9), dtype=np.uint8)
    bits[:, :, 1:] = np.unpackbits(values, axis=2)
    coded = np.packbits(bits.reshape(len(values), -1), axis=1).reshape(count, BLOCKS, 72)
    if not (coded == 0xFF).any():
        marked = np.concatenate([coded, np.broadcast_to(_RESTARTS, (count, BLOCKS, 2))], axis=2).reshape(count, -1)
        return [_HEAD + x[:-2].tobytes() + b"\xff\xd9" for x in marked]
    out = []
    for frame in coded:  # a 0xFF byte is followed by a zero
        parts = [x.tobytes().replace(b"\xff", b"\xff\x00") + m.tobytes() for x, m in zip(frame, _RESTARTS)]
        out.append(_HEAD + b"".join(parts)[:-2] + b"\xff\xd9")
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + bytes(len(body) % 2)


def write_avi(payload: bytes, frames_per_second: int = FRAMES_PER_SECOND) -> bytes:
    """A RIFF AVI file of motion-JPEG frames with an index; the payload's length is in a chunk of its own."""
    frames = write_frames(payload)
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // frames_per_second, 0, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, frames_per_second, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    index, at = [], 4
    for frame in frames:
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(frame)))
        at += 8 + len(frame) + len(frame) % 2
    movi = _chunk(b"LIST", b"movi" + b"".join(_chunk(b"00dc", x) for x in frames))
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"plen", struct.pack("<Q", len(payload))) + movi + _chunk(b"idx1", b"".join(index)))


@dataclass
class Avi:
    frames: list[bytes]
    microseconds: int
    payload_bytes: int | None


def _chunks(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = struct.unpack_from("<I", raw, at + 4)[0]
        yield raw[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def read_avi(raw: bytes) -> Avi:
    """Frames by the idx1 index, or, without one, in the movi list's order."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    microseconds, length, movi, index = 1_000_000 // FRAMES_PER_SECOND, None, None, None
    for name, lo, hi in _chunks(raw, 12, len(raw)):
        if name == b"LIST" and raw[lo : lo + 4] == b"hdrl":
            for inner, a, _ in _chunks(raw, lo + 4, hi):
                if inner == b"avih":
                    microseconds = struct.unpack_from("<I", raw, a)[0]
        elif name == b"LIST" and raw[lo : lo + 4] == b"movi":
            movi = (lo, hi)
        elif name == b"plen":
            length = struct.unpack_from("<Q", raw, lo)[0]
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", raw, a) for a in range(lo, hi - 15, 16)]
    if movi is None:
        raise ValueError("the AVI file has no movi list")
    if index is None:
        frames = [raw[a:b] for name, a, b in _chunks(raw, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    else:
        base = 0 if index and index[0][2] >= movi[0] else movi[0]  # offsets count from the list or from the file
        frames = [raw[base + at + 8 : base + at + 8 + size] for name, _, at, size in index if name[2:] in (b"dc", b"db")]
    return Avi(frames, microseconds, length)


def _huffman(body: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol."""
    out, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(body[length - 1]):
            out[length, code] = body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, raw: bytes) -> None:
        self.bits, self.at = np.unpackbits(np.frombuffer(raw.replace(b"\xff\x00", b"\xff"), dtype=np.uint8)).tolist(), 0

    def take(self, n: int) -> int:
        out = 0
        for bit in self.bits[self.at : self.at + n]:
            out = 2 * out + bit
        self.at += n
        return out

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = 2 * code + self.bits[self.at]
            self.at += 1
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("a code that no Huffman table has")

    def value(self, size: int) -> int:
        raw = self.take(size)
        return raw if not size or raw >> (size - 1) else raw - (1 << size) + 1


def decode_luma(jpeg: bytes) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Of a baseline JPEG's first component: coefficients (blocks, 64) in zigzag order, the quantisers, and blocks down and across."""
    quantisers, tables, restart, parts, order = {}, {}, 0, [], []
    at, height, width = 2, 0, 0
    while at < len(jpeg):
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantisers[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + count]
                body = body[17 + count :]
        elif marker in (0xC0, 0xC1):
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF:
            raise ValueError("only baseline frames are decoded")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            order = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            break
    end = jpeg.rindex(b"\xff\xd9")
    data = jpeg[at:end]
    quantiser = quantisers[parts[0][3]]
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    down, across = -(-height // (8 * most_v)), -(-width // (8 * most_h))
    fixed = len(parts) == 1 and restart == 1 and tables.get(0x00) == _ONE_CODE and tables.get(0x10) == _ONE_CODE
    if fixed and len(data) == 74 * down * across - 2:
        rows = np.frombuffer(data + b"\xff\xd0", dtype=np.uint8).reshape(-1, 74)
        bits = np.unpackbits(rows[:, :72], axis=1).reshape(len(rows), 64, 9)
        if (rows[:, 72] == 0xFF).all() and not bits[:, :, 0].any():
            values = np.packbits(bits[:, :, 1:], axis=2).reshape(len(rows), 64).astype(np.int64)
            return np.where(values > 127, values, values - 255), quantiser, (down, across)
    return _decode_scan(data, restart, parts, order, {k: _huffman(v) for k, v in tables.items()}, down, across), quantiser, (down * parts[0][2], across * parts[0][1])


def _decode_scan(data: bytes, restart: int, parts: list, order: list, tables: dict, down: int, across: int) -> np.ndarray:
    """The first component's coefficients, block by block through the Huffman codes."""
    pieces, at, lo = [], 0, 0
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        if 0xD0 <= data[at + 1] <= 0xD7:
            pieces.append(data[lo:at])
            lo = at + 2
        at += 2
    pieces.append(data[lo:])
    _, h, v, _ = parts[0]
    out, done = np.zeros((down * v, across * h, 64), dtype=np.int64), 0
    for piece in pieces:
        bits, last = _Bits(piece), [0] * len(parts)
        for _ in range(min(restart or down * across, down * across - done)):
            row, column = divmod(done, across)
            for k, (part, (_, dc, ac)) in enumerate(zip(parts, order)):
                for y in range(part[2]):
                    for x in range(part[1]):
                        block = np.zeros(64, dtype=np.int64)
                        last[k] += bits.value(bits.symbol(tables[dc]))
                        block[0], i = last[k], 1
                        while i < 64:
                            symbol = bits.symbol(tables[16 + ac])
                            run, size = symbol >> 4, symbol & 15
                            if not size and run < 15:
                                break
                            i += run
                            if size:
                                block[i] = bits.value(size)
                            i += 1
                        if not k:
                            out[row * v + y, column * h + x] = block
            done += 1
    return out.reshape(-1, 64)


def pixels(coefficients: np.ndarray, quantiser: np.ndarray) -> np.ndarray:
    """(blocks, 64) samples 0 to 255 by the inverse DCT in fixed point."""
    natural = np.empty_like(coefficients)
    natural[:, ZIGZAG] = coefficients * quantiser
    out = BASIS.T @ natural.reshape(-1, 8, 8) @ BASIS
    return np.clip(((out + (_SCALE * _SCALE // 2)) // (_SCALE * _SCALE)) + 128, 0, 255).reshape(-1, 64)


def stored_bytes(coefficients: np.ndarray) -> bytes:
    """The bytes that `write_frames` made these coefficients from."""
    return np.where(coefficients < 0, coefficients + 255, coefficients).astype(np.uint8).tobytes()


def shots(histograms: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames [first, after) between cuts, from differences of successive histograms (rows that sum to one)."""
    apart = np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2 if len(histograms) > 1 else np.empty(0)
    starts, since = [0], 0
    for i, x in enumerate(apart):
        seen = apart[max(since, i - WINDOW) : i]
        if x > LEAST and (not len(seen) or x > seen.mean() + DEVIATIONS * seen.std()) and (len(seen) >= 2 or x > 0.5):
            starts.append(i + 1)
            since = i + 1
    return list(zip(starts, [*starts[1:], len(histograms)]))


@dataclass
class Media:
    payload: bytes | None
    clips: list[tuple[int, int, int, int, float]]  # first frame, frame after, start and end in ms, mean luma


def read_media(raw: bytes) -> Media:
    """Decodes every frame: the stored bytes, if `write_avi` made the file, and the timed clips."""
    avi = read_avi(raw)
    decoded = [decode_luma(x) for x in avi.frames]
    if not decoded:
        return Media(b"" if avi.payload_bytes is not None else None, [])
    payload = None
    if avi.payload_bytes is not None:
        payload = stored_bytes(np.concatenate([c for c, _, _ in decoded]))[: avi.payload_bytes]
    planes = [pixels(c, q) for c, q, _ in decoded]
    counts = np.array([np.bincount((x // (256 // BINS)).reshape(-1), minlength=BINS) for x in planes])
    means = [float(x.mean()) for x in planes]
    clips = []
    for a, b in shots(counts / counts.sum(axis=1, keepdims=True)):
        clips.append((a, b, a * avi.microseconds // 1000, b * avi.microseconds // 1000, round(sum(means[a:b]) / (b - a), 3)))
    return Media(payload, clips)


def padded(raw: bytes | None) -> bytes:
    """`raw` with zeros up to a positive multiple of 64 bytes."""
    raw = raw or b""
    return raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def store_media(docs: DataFrame, text: str = "text", media: str = "media", drop: tuple[str, ...] = ()) -> DataFrame:
    """`docs` with n_bytes of the text's UTF-8 and, in `media`, the AVI file that holds those bytes padded with zeros.

    A null text is empty and takes one block. Repeated rows each get their row; an empty table gives an empty one; columns
    of `docs` with the new names are replaced.
    """

    def make() -> Callable:
        def compute(texts):
            raw = [x or b"" for x in as_bytes(texts)]
            return [len(x) for x in raw], [write_avi(padded(x)) for x in raw]

        return compute

    return append_columns(docs, [text], {"n_bytes": "bigint", media: "binary"}, make, drop=drop)


def describe_media(media: DataFrame, column: str = "media", drop: tuple[str, ...] = ()) -> DataFrame:
    """`media` with what the stored file holds, read back: payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes),
    media_bytes, media_sha256 and feature: each shot as `first frame-frame after:mean luma`.

    A null file gives nulls; a foreign file, which has no payload, gives nulls for the payload.
    """
    fields = {"payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "feature": "string"}

    def one(raw: bytes | None) -> tuple:
        if raw is None:
            return (None,) * 6
        found = read_media(raw)
        stored = (None,) * 3 if (p := found.payload) is None else (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        return *stored, len(raw), hashlib.sha256(raw).hexdigest(), ";".join(f"{a}-{b}:{luma:.3f}" for a, b, _, _, luma in found.clips)

    def make() -> Callable:
        return lambda files: [list(x) for x in zip(*map(one, files.to_pylist()))] or [[]] * 6

    return append_columns(media, [column], fields, make, drop=drop)


def clip_rows(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row for each shot of each file: key, clip, first_frame, last_frame, start_ms, end_ms, mean_luma. Null files have none."""
    rows = media.select(F.col(quoted(key)).alias("key"), F.col(quoted(column)).alias("media"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = {"key": kind, "clip": "int", "first_frame": "int", "last_frame": "int", "start_ms": "bigint", "end_ms": "bigint", "mean_luma": "double"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, cells = [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                for n, (a, b, start, end, luma) in enumerate(read_media(raw).clips if raw is not None else ()):
                    owner.append(i)
                    cells.append((n, a, b - 1, start, end, luma))
            kinds = [pa.int32()] * 3 + [pa.int64()] * 2 + [pa.float64()]
            columns = [pa.array(x, k) for x, k in zip(list(zip(*cells)) or [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *columns], names=list(schema))

    return rows.mapInArrow(run, ddl(schema)).withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return describe_media(store_media(docs, drop=("text",)), drop=("media",))


def clips_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clips of every document's file."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return clip_rows(store_media(docs, drop=("text",)))
