import zlib
from collections import defaultdict

import numpy as np
from hypothesis import example, given, settings
from hypothesis import strategies as st

from vecstead.llm import packing

SCHEMA = "doc_id long, text string"
TEXTS = [None, "", " ", "a", "Hello world", "two  spaces\n\nand\u00a0more \x1c x ", "l'été d'où — 12 345,6 %%% x's 'S", "word " * 9000, "a" * 5000, "<|endoftext|>", "a <|endoftext|> b", "word<|endoftext|>word <|endoftext|>", "<|endoftext| > x", "日本語 テキスト 🙂"]


def reference_ids(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    reader = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*reader.encode(text or "", add_special_tokens=False).ids, 1]


def test_every_id_in_one_piece(spark, tmp_path):
    rows = list(enumerate(TEXTS * 3))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.query(spark, str(tmp_path)).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, text in rows:
        ids = reference_ids(text)
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            part = np.array(ids[at : at + r.length], dtype="<u4")
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(part.tobytes()))
            at += r.length
        assert at == len(ids)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.LENGTH


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sS1 .\n\t\x85\u00a0\u2003é日"), max_size=40))
@example("a <|endoftext|> b")
@example("a<|endoftext|><|endoftext|>  b")
def test_ids_equal_the_tokenizer(text):
    encode = packing.encoder("byte_bpe_50k")
    assert np.frombuffer(encode(text) + packing.END, dtype="<u4").tolist() == reference_ids(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
def test_first_fit_decreasing(sizes):
    bins, offsets = packing.first_fit_decreasing(np.array(sizes), 20)
    room = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(20)
        assert (bins[i], offsets[i]) == (b, 20 - room[b])
        room[b] -= sizes[i]


def test_empty_repeated_and_null_rows(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, "a b", 1), (1, "a b", 1), (None, None, 1)], f"{SCHEMA}, offset int")
    got = packing.pack_documents(rows).collect()
    assert sorted(r.length for r in got) == [1, 3, 3] and len({(r.sequence_id, r.offset) for r in got}) == 3


def test_partitions_are_packed_group_by_group(spark):
    rows = spark.createDataFrame([(i, "a " * (1 + i * 37 % 400)) for i in range(300)], SCHEMA).repartition(5)
    got = packing.pack(packing.durable(packing.token_pieces(rows)), group=20).collect()
    assert len(got) == 300 and len({r.sequence_id >> 32 for r in got}) > 5
    used = defaultdict(int)
    for r in got:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= packing.LENGTH
