import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstead.llm.language_id import DIMENSIONS, SEED, UNKNOWN, Profiles, _bits, identify_language, learn_languages, trigrams
from vecstead.llm.quality import NEIGHBOURS, TERMS, fit_neighbours, labelled_terms, learn_quality, recurrences, score_quality

ROWS = [(i, ("the cat and the dog " if i % 2 else "el gato y los perros ") * 5 + f"n{i}", "en" if i % 2 else "es", 7, 8) for i in range(40)]
ODD = [(90, None, None, 7, 8), (91, "", "en", 7, 8), (92, "12 34 !", None, 7, 8), (None, "the dog and the cat", None, 7, 8), (93, "los gatos " * 20_000, "es", 7, 8), (0, *ROWS[0][1:])]
SCHEMA = "doc_id long, text string, lang string, score int, predicted int"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS + ODD, SCHEMA)


def test_language_of_odd_rows_and_clashing_columns(docs):
    got = {(r.doc_id, r.text): r for r in identify_language(docs.drop("lang"), learn_languages(docs)).collect()}
    assert len(got) == len(ROWS) + len(ODD) - 1  # one row is repeated
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(got[i, t].lang_pred == lang for i, t, lang, *_ in ROWS)
    assert [got[x[:2]].lang_pred for x in ODD[:5]] == [UNKNOWN, UNKNOWN, UNKNOWN, "en", "es"]


def test_language_of_empty_tables(docs):
    assert identify_language(docs.limit(0), learn_languages(docs)).count() == 0
    assert identify_language(docs, learn_languages(docs.limit(0))).where(f"lang_pred != '{UNKNOWN}'").count() == 0


def test_quality_of_odd_rows_and_empty_tables(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = learn_quality(docs, labels)
    got = score_quality(docs, model).collect()
    assert len(got) == len(ROWS) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    score = {r.text: r.score for r in got}
    assert score[ROWS[1][1]] > score[ROWS[0][1]]
    assert score_quality(docs.limit(0), model).count() == 0
    assert score_quality(docs, learn_quality(docs, labels.limit(0))).count() == len(got)


def naive_vector(text):
    """A bundle of trigrams one by one, from the letters' vectors."""
    bits = lambda letter: 1 - 2 * _bits(np.array([letter]), DIMENSIONS, SEED)[0].astype(int)
    total = np.zeros(DIMENSIONS)
    letters = [ord(c) if c.isalpha() else 0 for c in text.lower()]
    padded = [0, *letters, 0]
    padded = [c for i, c in enumerate(padded) if i == 0 or c or padded[i - 1]]
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        total += np.roll(bits(a), 2) * np.roll(bits(b), 1) * bits(c)
    return total


@pytest.mark.parametrize("remembered", [3, 40_000])
def test_bundles_equal_a_naive_bundle(remembered):
    profiles = Profiles(remembered=remembered)
    for text in ("the cat, and the dog!", "Ünïcode ÄÖ 日本語 日本", "a", "Ωμέγα ωμέγα", "x " * 3000):
        for _ in range(2):
            codes, counts = np.unique(trigrams(text), return_counts=True)
            assert profiles.bundle(codes, counts).tolist() == naive_vector(text).tolist()
    assert len(trigrams("12 ! 3")) == len(trigrams("")) == len(trigrams(None)) == 0


def test_ties_go_to_the_first_language_by_name(docs):
    same = docs.withColumn("lang", F.explode(F.array(F.lit("zz"), F.lit("aa"))))
    assert {r.lang_pred for r in identify_language(docs, learn_languages(same)).collect()} == {"aa", UNKNOWN}


def test_scripts_are_told_apart(spark):
    rows = [(i, (["русский язык и слова", "ελληνική γλώσσα και λέξεις", "日本語の文章です", "the english words"][i % 4] + " ") * 3, str(i % 4)) for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert all(r.lang_pred == r.lang for r in identify_language(docs, learn_languages(docs)).withColumnRenamed("score", "s").collect())


def test_neighbours_equal_brute_force():
    rng = np.random.default_rng(2)
    terms = rng.integers(0, 4, (60, TERMS)).astype(np.float32)
    terms[40:] = terms[:20]  # exact copies tie
    labels = rng.integers(0, 2, 60)
    model = fit_neighbours(terms, labels, latent=8)
    asked = rng.integers(0, 4, (30, TERMS)).astype(np.float32)
    got = model.score(asked)
    cosines = (model.latent(asked) @ model.vectors.T).round(6)
    for i in range(30):
        best = sorted(range(60), key=lambda j: (-cosines[i, j], j))[:NEIGHBOURS]
        weight = [max(0.0, float(cosines[i, j])) ** 8 for j in best]
        assert abs(got[i] - sum(w * labels[j] for w, j in zip(weight, best)) / sum(weight)) < 1e-6


def test_recurrences_by_hand():
    assert recurrences([b"a", b"a", b"b", b"a", b"c", b"d", b"b"]).tolist() == [0, 1, 0, 2, 0, 0, 3]


def test_labelled_rows_stay_within_the_bound(spark):
    docs = spark.createDataFrame([(i % 5, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)] * 3, "doc_id long, quality int")
    terms, found = labelled_terms(docs, labels, "quality", limit=7)
    assert terms.shape == (7, TERMS) and len(found) == 7


def test_quality_is_learned_for_held_out_texts(spark):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("a", "e", "io", "un", "al")]
    good = lambda: " ".join(rng.choice(words, 80))
    bad = lambda k: [lambda: " ".join(w for w in rng.choice(words, 6) for _ in range(20)), lambda: good().upper() + " !!", lambda: good().replace(" ", "$$$ ")][k % 3]()
    rows = [(i, good() if i % 2 else bad(i // 2), i % 2) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    taught = table.where("doc_id < 200")
    got = score_quality(table.where("doc_id >= 200"), learn_quality(taught.drop("quality"), taught.drop("text"))).collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.9 * len(got)


def test_fit_holds_one_table_of_terms():
    rng = np.random.default_rng(6)
    terms = rng.poisson(0.1, (3000, TERMS)).astype(np.float32)
    labels, kept = rng.integers(0, 2, 3000), terms.copy()
    model = fit_neighbours(terms, labels)
    assert np.array_equal(terms, kept)
    tracemalloc.start()
    other = fit_neighbours(terms, labels, spare=False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 0.6 * terms.nbytes
    assert np.array_equal(model.rarity, other.rarity) and np.array_equal(model.vectors, other.vectors)
