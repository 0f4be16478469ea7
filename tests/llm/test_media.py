import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from vecstead.llm import media

TEXTS = [(1, "hello"), (2, ""), (3, None), (4, "é" * 5000), (5, "hello"), (6, "\x00\x7f" * 40), (7, "long text " * 40_000)]


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1023, 1024, 1025, 70_000])
def test_round_trip(size):
    raw = np.random.default_rng(size).integers(0, 256, size).astype(np.uint8).tobytes()
    found = media.read_media(media.write_avi(raw))
    assert found.payload == raw
    assert found.clips[0][0] == 0 and found.clips[-1][1] == max(1, -(-size // 1024))


def test_every_byte_survives_and_both_decoders_agree():
    raw = bytes(range(256)) * 8 + b"\xff" * 1024
    for frame in media.write_frames(raw):
        fast, _, size = media.decode_luma(frame)
        data = frame[frame.index(b"\xff\xda") + 10 : -2]
        codes = media._huffman(media._ONE_CODE)
        slow = media._decode_scan(data, 1, [(1, 1, 1, 0)], [(1, 0, 0)], {0: codes, 16: codes}, *size)
        np.testing.assert_array_equal(fast, slow)


def test_query_equals_brute_force(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in media.query(spark, str(tmp_path)).collect()}
    assert len(got) == len(TEXTS)
    for doc_id, text in TEXTS:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = media.write_avi(payload)
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
    assert got[1].feature == got[5].feature and got[2].feature == got[3].feature


def test_edges(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "1 as media", "2 as feature")
    stored = media.store_media(docs)
    assert media.describe_media(stored).count() == len(TEXTS)
    assert media.store_media(docs.limit(0)).count() == 0
    assert media.describe_media(stored.selectExpr("doc_id", "cast(null as binary) as media").limit(1)).first().payload_sha256 is None
    clips = media.clip_rows(stored).collect()
    assert {r.doc_id for r in clips} == {i for i, _ in TEXTS} and all(r.end_ms > r.start_ms for r in clips)


def test_shots_are_cut_where_histograms_jump():
    rng = np.random.default_rng(1)
    rows = []
    for level in (2, 9, 14):
        part = np.zeros((20, 16))
        part[:, level] = 1
        rows.append(part + rng.random((20, 16)) * 0.01)
    rows = np.concatenate(rows)
    assert media.shots(rows / rows.sum(axis=1, keepdims=True)) == [(0, 20), (20, 40), (40, 60)]
    assert media.shots(rows[:1]) == [(0, 1)]


def test_files_without_an_index_and_foreign_files():
    raw = media.write_avi(bytes(3000))
    at = raw.index(b"idx1")
    cut = raw[:4] + struct.pack("<I", at - 8) + raw[8:at]
    assert media.read_avi(cut).frames == media.read_avi(raw).frames
    with pytest.raises(ValueError):
        media.read_avi(io.BytesIO(b"RIFFxxxxWAVE").read())


def test_clips_of_every_document(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = media.clips_query(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in TEXTS}
    for doc_id, text in TEXTS:
        raw = (text or "").encode()
        found = media.read_media(media.write_avi(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw)))).clips
        own = sorted((r.clip, r.first_frame, r.last_frame, r.start_ms, r.end_ms) for r in got if r.doc_id == doc_id)
        assert own == [(n, a, b - 1, start, end) for n, (a, b, start, end, _) in enumerate(found)]
