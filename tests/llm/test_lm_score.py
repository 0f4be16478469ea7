import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstead.llm import lm_score, mixing


def texts():
    rng = np.random.default_rng(8)
    words = [f"w{chr(97 + i % 26)}{i}" for i in range(120)]
    rows = [(i, " ".join(rng.choice(words, 30)) + (f" rare{i}" if i % 3 == 0 else ""), "ab"[i % 2]) for i in range(150)]
    return rows + [(200, None, "a"), (201, "", None), (202, " \n", "a"), (203, "Wa0 WA0 É É", None), (204, "wa0 " * 3000, "b"), (0, rows[0][1], "a")]


def brute(rows):
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    rest = lambda i: zlib.crc32(str(i).encode()) % 7
    counts = Counter(w for i, t, _ in rows if rest(i) != 2 for w in words(t))
    total, size = sum(counts.values()), len(counts)
    for i, t, _ in rows:
        found = words(t)
        base = sum(math.log10((counts[w] + 1) / (total + size + 1)) for w in found)
        yield i, rest(i) == 2, len(found), sum(counts[w] > 0 for w in found), total, round(base, 6)


def scored(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return lm_score.query(spark, str(folder)).collect()


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    rows = texts()
    first = scored(spark, tmp_path / "a", rows)
    monkeypatch.setattr(lm_score, "BLOCK", 3_000)  # many blocks and parts
    monkeypatch.setattr(lm_score, "PART", 2_000)
    other = scored(spark, tmp_path / "b", rows)
    for got in (first, other):
        # base_score sums N + V + 1, as its denominator has N + 1 * (V + 1)
        assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(brute(rows))
        assert all(r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0 for r in got)
        again = [r.score for r in got if r.doc_id == 0]
        assert again[0] == pytest.approx(again[1], abs=1e-9)
    # how texts are dealt to blocks and parts changes nothing
    assert sorted((r.doc_id, round(r.score, 6)) for r in first) == sorted((r.doc_id, round(r.score, 6)) for r in other)


def test_scores_beat_the_base_and_know_copies(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("x", "yy", "zzz", "wx", "oo")]
    held = [i for i in range(700) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, " ".join(rng.choice(words, 60)), None) for i in range(700)]
    copies = held[:20]
    taught = next(i for i in range(700) if i not in held)
    for k in copies:  # a held-out text whose copy is taught
        rows[k] = (k, rows[taught][1], None)
    got = {r.doc_id: r for r in scored(spark, tmp_path, rows)}
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
    others = [got[i].score / got[i].n_tokens for i in held if i not in copies]
    assert min(got[i].score / got[i].n_tokens for i in copies) > max(others)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, True), (1, "a b", 5, 6, None)], "doc_id long, text string, score int, word int, learn boolean")
    rows = lm_score.score_texts(docs, F.col("learn")).collect()
    assert all(r.score < 0 and r.word == 6 and r.n_known == 3 and r.train_tokens == 3 for r in rows) and len(rows) == 2
    assert [r.n_known for r in lm_score.score_texts(docs, F.lit(False)).collect()] == [0, 0]
    assert lm_score.score_texts(docs.limit(0), F.col("learn")).count() == 0


def test_tokens_equal_a_split():
    raw = [b"Ab  c\x0b\xc3\x89 ab", None, b"", b"\x1c \x85x\n", b"long" * 5000, b"a b a b a c"]
    tokens = lm_score.Tokens(raw)
    want = [(i, w) for i, x in enumerate(raw) for w in [*(x or b"").lower().split(), b""]]
    assert [(int(d), tokens.word(k)) for k, d in enumerate(tokens.doc)] == want
    assert len(set(zip(tokens.hash.tolist(), [w for _, w in want]))) == len({w for _, w in want})
    one, pair, triple = tokens.keys()
    full = [[None, None, *[w for d, w in want if d == i]] for i in range(len(raw))]
    for keys, n in ((one, 1), (pair, 2), (triple, 3)):
        grams = [tuple(x[k - n + 1 : k + 1]) for x in full for k in range(2, len(x))]
        assert len(set(zip(keys.tolist(), grams))) == len(set(grams)) == len(set(keys.tolist()))


def test_matches_by_hand():
    laid, won, run = (x.tolist() for x in lm_score.Tokens([b"b a", b"a b a b a c"]).matches())
    assert laid[3:] == [False, False, False, True, True, True, False]
    assert won[3:] == [False, False, False, True, True, False, False]
    assert run[6:9] == [0, 1, 2]


def test_adaptive_parts_equal_slow_loops():
    rng = np.random.default_rng(1)
    n = 700
    sequence = np.sort(rng.integers(0, 4, n))
    step = np.concatenate([np.arange((sequence == k).sum()) for k in range(4)])
    gate, bits = rng.integers(0, 3, n), (rng.random(n) < 0.3).astype(float)
    inputs = rng.normal(0, 1, (n, 2))
    keys = sequence * 10 + rng.integers(0, 3, n)
    got = mixing.adapted(keys, bits, np.full(n, 0.4))
    seen = Counter(), Counter()
    for i in range(n):
        assert got[i] == pytest.approx((0.4 * mixing.WORTH + seen[1][keys[i]]) / (mixing.WORTH + seen[0][keys[i]]))
        seen[0][keys[i]] += 1
        seen[1][keys[i]] += bits[i]
    got, at = mixing.mix(sequence, step, gate, inputs, bits, 3), {}
    for s in range(4):
        weights, rows, size = np.ones((3, 2)), np.flatnonzero(sequence == s).tolist(), mixing.FIRST
        while rows:
            part, rows, size, moved = rows[:size], rows[size:], size * 2, np.zeros((3, 2))
            for i in part:
                at[i] = 1 / (1 + math.exp(-float(weights[gate[i]] @ inputs[i])))
                moved[gate[i]] += mixing.RATE * (bits[i] - at[i]) * inputs[i]
            weights += np.clip(moved, -0.3, 0.3)
    assert got == pytest.approx([at[i] for i in range(n)])


def model_of(taught):
    tokens = lm_score.Tokens(taught)
    counts = [Counter(x.tolist()) for x in tokens.keys()]
    letters = np.zeros((len(mixing.ORDERS), 1 << 16, 2), dtype=np.float32)
    mixing.count_letters(sorted({w for x in taught for w in x.split()}), letters, 16)
    contexts = np.random.default_rng(0).integers(0, 9, (lm_score.CONTEXTS, 2)).astype(np.float32)
    return lm_score.Model(len(tokens.hash), len(counts[0]), len(taught), 4, contexts, letters, 16), counts


def test_chances_of_all_texts_sum_to_at_most_one():
    model, counts = model_of([b"a b c a b", b"b a", b"c c c a"])
    inner = [b"a", b"b", b"c", *(bytes([x]) for x in range(256) if not lm_score._SPACE[x] and x not in b"abcABC")]
    begin = b"a b a "
    texts = [begin + w for w in inner]
    answers = [np.array([c[k] for k in keys.tolist()]) for c, keys in zip(counts, lm_score.Tokens(texts).keys())]
    scores = lm_score.score_block(lm_score.Tokens(texts), answers, model)["score"]
    assert 0 < (10.0**scores).sum() < 1


def test_letters_of_a_word_sum_to_one():
    model, _ = model_of([b"ab abc b zz"])
    tokens = lm_score.Tokens([bytes([c]) for c in range(256) if not lm_score._SPACE[c] and not 65 <= c <= 90])
    chances = 10 ** lm_score.spelled(tokens, np.flatnonzero(tokens.end > tokens.begin), model)
    assert 0 < chances.sum() < 1  # the other words begin with these letters


def test_long_texts_are_spelled_without_a_restart(monkeypatch):
    model, _ = model_of([b"ab abc b zz the of"])
    draw = np.random.default_rng(2)
    words = [bytes(draw.integers(97, 105, size=draw.integers(2, 7)).astype(np.uint8)) for _ in range(1500)]
    texts = [b"x y", b" ".join(words), b"ab q"]
    tokens = lm_score.Tokens(texts)
    new = np.flatnonzero(tokens.end > tokens.begin)
    whole = lm_score.spelled(tokens, new, model)
    for together in (7, 300, 1499):
        monkeypatch.setattr(lm_score, "TOGETHER", together)
        assert lm_score.spelled(tokens, new, model) == pytest.approx(whole, abs=1e-9)
