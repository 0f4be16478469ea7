"""Phrases against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from vecstead.llm import phrases
from vecstead.llm.phrases import collocations

SCHEMA = "text string, lang string, phrase string, n int"


def slow(rows, least, first=2000, share=100):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    total, count = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    frequent = {key: n for key, n in count.items() if len(key[1]) > 1 and n >= least}
    out = {}
    for (lang, w), a in frequent.items():
        cuts = [(1000 * a * total[lang] // (count[lang, w[:k]] * count[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = lambda x, y: len(y) > len(x) and any(y[i : i + len(x)] == x for i in range(len(y) - len(x) + 1))
        if not any(m == lang and inside(w, x) and 100 * n >= share * a for (m, x), n in frequent.items()):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), count[lang, w[:k]], count[lang, w[k:]]))
    found = []
    for lang, rows in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:first], 1):
            found.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(found)


def found(spark, rows, least, first=2000):
    out = collocations(spark.createDataFrame([(t, lang, "x", 1) for t, lang in rows], SCHEMA).repartition(3), least=least, first=first)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in out.collect())


def corpus(seed, rows=60):
    draw = random.Random(seed)
    words = ["Alpha", "beta", "BETA", "é", "日本", "x y", "'", "a", "b", "the", "the", "the", "of"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "!", "\n", "\r\n", "\x0b"]
    return [("".join(draw.choice(words) + draw.choice(ends) for _ in range(draw.choice([0, 1, 5, 300]))), draw.choice(["en", "en", "de", None, ""])) for _ in range(rows)]


def test_equals_plain_counting(spark):
    rows = [*corpus(3), (None, "en"), ("", None), ("a a a a a a a a a a", "en"), ("   ", "fr"), ("...", "fr")]
    assert found(spark, rows, 8) == slow(rows, 8)
    rows *= 2  # repeated rows count each time
    assert found(spark, rows, 20) == slow(rows, 20)


def test_ties_and_first_rows(spark, monkeypatch):
    rows = [("q w. e r. t y. u i. o p. " * 9, "en"), ("z x c v b n " * 9, "de")]
    expected = slow(rows, 5, 3)
    assert found(spark, rows, 5, 3) == expected
    monkeypatch.setattr(phrases, "ORDERED", 2)  # a language in slices
    monkeypatch.setattr(phrases, "FAN", 2)
    assert found(spark, rows, 5, 3) == expected


def test_long_texts_are_cut_between_pieces_only(spark, monkeypatch):
    text = "".join(random.Random(5).choice(["one two three. ", "four, five six ", "six seven\n"]) for _ in range(400))
    monkeypatch.setattr(phrases, "BLOCK", 100)
    assert b"".join(phrases.cut(text.encode(), 100)) == text.encode()
    assert list(phrases.cut(b"no end at all " * 50, 100)) == [b"no end at all " * 50]
    assert found(spark, [(text, "en"), ("one two " * 200, "en")], 30) == slow([(text, "en"), ("one two " * 200, "en")], 30)


def test_full_sketches_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LEAST_BITS", 11)
    monkeypatch.setattr(phrases, "MOST_BITS", 11)
    rows = corpus(7, 40)
    assert found(spark, rows, 6) == slow(rows, 6)


def test_packed_cells_come_back():
    import zstandard

    for values in ([], [0], [0, 0, 5, 5, 5, 900], sorted(random.Random(1).choices(range(1 << 20), k=5000))):
        at = np.array(values, dtype=np.uint32)
        assert phrases._unpacked(phrases._packed(at, zstandard.ZstdCompressor())).tolist() == values


def test_empty_tables(spark):
    assert found(spark, [], 2) == []
    assert found(spark, [(None, None), ("", "en"), ("once only", "en")], 2) == []
