import math
from collections import Counter

import numpy as np
import pytest

from vecstead.llm import toxicity
from vecstead.llm.toxicity import PAIRS, SHARED, STRENGTH, STRETCH, UNKNOWN, WORDS, features, learn_models, learn_toxicity, pair_key, read, score_toxicity

TEXTS = [("the cat sat on the mat", 0), ("You utter CLOWN, you!", 1), ("the dog and the cat", 0), ("you utter clown you fool", 1), ("an utter clown, you utter clown", 1), ("you utter clown", 1), ("the cat sat on the dog", 0), ("the cat sat", 0), ("the cat sat still", 0), ("the Cat.sat", 0)]


def words_of(text):
    return "".join(c.lower() if c.isalnum() else " " for c in text).split()


class Slow:
    """The models word by word."""

    def __init__(self, texts):
        self.pairs = [Counter(), Counter()]
        for text, label in texts:
            words = words_of(text)
            self.pairs[label].update(zip([None, *words], words))
        self.follows = [Counter(w for _, w in p) for p in self.pairs]
        self.kept = [{k: max(n - PAIRS, 0) for k, n in p.items()} for p in self.pairs]

    def alone(self, word, k):
        total = sum(sum(f.values()) for f in self.follows)
        both = self.follows[0] + self.follows[1]
        left = 1 - sum(max(n - WORDS, 0) for n in both.values()) / total
        shared = (max(both[word] - SHARED, 0) + SHARED * len(both) * UNKNOWN) / total
        own = {w: max(n - WORDS, 0) for w, n in self.follows[k].items()}
        return (1 - left) * own.get(word, 0) / max(sum(own.values()), 1e-9) + left * shared

    def likelihood(self, before, word, k):
        after = lambda counts: sum(n for (b, _), n in counts.items() if b == before)
        total, kept = sum(map(after, self.pairs)), sum(map(after, self.kept))
        weight = 1 - kept / max(total, 1)
        drawn = sum(x.get((before, word), 0) for x in self.kept) / max(kept, 1e-9)
        share = (1 - weight) * (self.kept[k].get((before, word), 0) + STRENGTH * drawn) / (after(self.kept[k]) + STRENGTH)
        return share + weight * self.alone(word, k)


def arrays(texts):
    tokens, before = read([t.encode() for t, _ in texts])
    label = np.array([k for _, k in texts])[tokens.doc]
    inner = np.flatnonzero(tokens.hash != toxicity._END)
    _, first, back = np.unique(pair_key(before, tokens.hash)[inner], return_index=True, return_inverse=True)
    return before[inner[first]], tokens.hash[inner[first]], tuple(np.bincount(back, label[inner] == k) for k in (0, 1))


def test_likelihoods_equal_a_slow_model():
    models, slow = learn_models(*arrays(TEXTS)), Slow(TEXTS)
    for text in ("the cat sat", "you utter clown", "clown cat you the unknown words the", "", "!"):
        tokens, before = read([text.encode()])
        words = words_of(text)
        want = [math.log(slow.likelihood(b, w, 1)) - math.log(slow.likelihood(b, w, 0)) for b, w in zip([None, *words], words)]
        assert models.ratios(tokens, before)[:-1] == pytest.approx(want)
        sums = [sum(x if w not in words[:j] else 0 for j, (x, w) in enumerate(zip(want, words)) if i <= j < i + STRETCH) for i in range(max(1, len(words) - STRETCH + 1))]
        assert features(models, [text.encode()])[0] == pytest.approx([sum(want) / max(STRETCH, len(words)), max(sums) / STRETCH])


def test_likelihoods_sum_to_at_most_one():
    slow = Slow(TEXTS)
    for before in (None, "the", "utter", "unseen"):
        for k in (0, 1):
            assert 0 < sum(slow.likelihood(before, w, k) for w in slow.follows[0] | slow.follows[1]) < 1 + 1e-9


def labelled(spark, n=400):
    rng = np.random.default_rng(4)
    words = [f"{a}{b}" for a in "bcdfghklmnp" for b in ("a", "e", "io", "un", "al", "est")]
    toxic = rng.random(n) < 0.3
    rows = []
    for i in range(n):
        body = rng.choice(words, int(rng.integers(20, 200))).tolist()
        if toxic[i]:
            for k in rng.integers(0, len(body), 3):
                body.insert(int(k), str(rng.choice(["clown", "moron!!", "dirty rat"])))
        rows.append((i, " ".join(body), int(toxic[i])))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int"), toxic


def test_held_out_texts_are_told_apart(spark):
    rows, toxic = labelled(spark)
    models = learn_toxicity(rows.drop("toxic"), rows.where("doc_id < 300").drop("text"))
    got = score_toxicity(rows.where("doc_id >= 300"), models).collect()
    assert sum(r.predicted == toxic[r.doc_id] for r in got) >= 0.95 * len(got)
    assert all(r.predicted == (r.score >= toxicity.THRESHOLD) and 0 <= r.score <= 1 for r in got)


def test_odd_rows_and_clashing_columns(spark):
    rows, _ = labelled(spark)
    models = learn_toxicity(rows.drop("toxic"), rows.drop("text"))
    long = "word " * 30_000 + "clown moron"
    odd = spark.createDataFrame([(1, None, 5, 6), (2, "", 5, 6), (3, " !? ", 5, 6), (None, long, 5, 6), (4, "clown moron", 5, 6), (4, "clown moron", 5, 6)], "doc_id long, text string, score int, __text int")
    got = score_toxicity(odd, models).collect()
    assert len(got) == 6 and got[0].score == got[1].score == got[2].score and got[4] == got[5] and got[4].predicted == 1
    assert got[0]["__text"] == 6 and all(0 <= r.score <= 1 for r in got)
    assert score_toxicity(odd.limit(0), models).count() == 0


def test_labels_that_teach_nothing(spark):
    rows, _ = labelled(spark, 40)
    for labels in (rows.drop("text").limit(0), rows.drop("text").where("toxic = 0"), rows.selectExpr("doc_id", "cast(null as int) as toxic")):
        assert learn_toxicity(rows.drop("toxic"), labels) is None
    assert {(r.score, r.predicted) for r in score_toxicity(rows, None).collect()} == {(0.0, 0)}


def test_repeated_ids_count_once(spark):
    rows, _ = labelled(spark, 200)
    once = learn_toxicity(rows.drop("toxic"), rows.drop("text"))
    twice = learn_toxicity(rows.drop("toxic").union(rows.drop("toxic")), rows.drop("text"))
    assert once.curve == twice.curve and once.pair.keys.tolist() == twice.pair.keys.tolist()


def test_most_toxic_words_are_not_diluted():
    """The third measure is the mean of the most toxic distinct words, however long the rest of the text is."""
    models, slow = learn_models(*arrays(TEXTS)), Slow(TEXTS)
    ratio = lambda b, w: math.log(slow.likelihood(b, w, 1)) - math.log(slow.likelihood(b, w, 0))
    found = []
    for n in (3, 3000):
        words = ["you", "utter", "clown", *["the", "cat"] * n, "utter", "clown"]
        first = [ratio(b, w) for i, (b, w) in enumerate(zip([None, *words], words)) if w not in words[:i]]
        row = toxicity.measured(models, [" ".join(words).encode()])[0]
        assert row[2] == pytest.approx(sum(sorted(first)[-toxicity.STRONGEST :]) / toxicity.STRONGEST)
        found.append(row)
    assert found[0][2] == found[1][2] and found[1][0] < found[0][0]
    assert toxicity.measured(models, [b"", None]).tolist() == [[0.0] * 3] * 2
