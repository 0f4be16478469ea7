"""Classifiers of all cells, fine-tuning, approximate neighbours and the SQL functions against numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from vecstead.functions import blocks, sql
from vecstead.operators import approximate, finetune, measures, neighbours
from vecstead.plans import cells, tasks


def emb_of(spark, z):
    return spark.createDataFrame([(i, f"w{i}", v.tolist()) for i, v in enumerate(z)], "rank bigint, word string, vec array<double>")


def test_one_round_of_fine_tuning_equals_numpy(spark):
    draw = np.random.default_rng(0)
    z = draw.normal(size=(6, 3))
    texts = ["w0 w1 w1", "w2", "w3 unknown w0 w4", "unknown", "  w1 w2 "]
    label = np.array([1, 0, 1, 1, 0])
    lines = spark.createDataFrame([(i, t, int(y)) for i, (t, y) in enumerate(zip(texts, label))], "example_id int, text string, label int")
    emb = emb_of(spark, z)
    bag = finetune.bags(lines, emb)
    share = np.zeros((5, 6))
    for i, t in enumerate(texts):
        words = [int(w[1:]) for w in t.split() if w != "unknown"]
        for w in words:
            share[i, w] += 1 / len(words)
    assert {(r.example_id, r.word): pytest.approx(r.share) for r in bag.collect()} == {(i, f"w{w}"): share[i, w] for i, w in zip(*np.nonzero(share))}
    w, b = draw.normal(size=3), 0.3
    used = share.sum(axis=1) > 0
    error = np.where(used, 1 / (1 + np.exp(-(share @ z @ w + b))) - label, 0) / used.sum()
    tuned = finetune.round_of(bag, lines.select("example_id", F.col("label").cast("double").alias("label")), finetune.Tuned(emb, w, b), 0.7)
    assert tuned.weights == pytest.approx(w - 0.7 * (share.T @ error) @ z) and tuned.bias == pytest.approx(b - 0.7 * error.sum())
    got = np.array([r.vec for r in tuned.emb.orderBy("rank").collect()])
    assert got == pytest.approx(z - 0.7 * np.outer(share.T @ error, w))


def test_fine_tuning_learns_and_follows_its_seeds(spark):
    draw = np.random.default_rng(1)
    z = draw.normal(size=(8, 4)) * 0.1
    lines = spark.createDataFrame([(i, " ".join(f"w{w}" for w in draw.integers(4, size=5) + 4 * (i % 2)), i % 2) for i in range(40)], "example_id int, text string, label int")
    emb = emb_of(spark, z)
    one, same, other = (finetune.finetuned(lines, emb, m, d, rounds=6, batches=2, rate=10.0) for m, d in ((1, 1), (1, 1), (2, 1)))
    assert one.weights == pytest.approx(same.weights) and not np.allclose(one.weights, other.weights)
    pred = {r.example_id: r.pred for r in finetune.predicted(lines, one).collect()}
    assert np.mean([pred[i] == i % 2 for i in range(40)]) > 0.95


def test_classifiers_of_all_cells_equal_one_by_one(spark):
    draw = np.random.default_rng(2)
    n, d = 20, 3
    vectors = draw.normal(size=(2, 4, n, d))
    quads = spark.createDataFrame([(s, i, *[vectors[s, k, i].tolist() for k in range(4)]) for s in (0, 1) for i in range(n)], "seed int, rank bigint, " + ", ".join(f"{c} array<double>" for c in "xyef"))
    share = draw.random(size=(60, n)) * (draw.random(size=(60, n)) < 0.3)
    share[:, 0] += 0.1
    share /= share.sum(axis=1, keepdims=True)
    label = (share @ vectors[0, 1, :, 0] > 0).astype(int)
    bags = spark.createDataFrame([(int(i), int(w), float(share[i, w])) for i, w in zip(*np.nonzero(share))], "example_id bigint, rank bigint, share double").repartition(3)
    labels = spark.createDataFrame([(i, int(y), i % 2 == 0) for i, y in enumerate(label)], "example_id bigint, label int, train boolean")
    found = {(r.seed, r.dim, r.bitrate): r for r in tasks.cell_tasks(bags, labels, quads, [2, 3], [2, 32], regularization=1e-3, rounds=200, aligned=False, adaptive=False).collect()}
    assert len(found) == 8
    for (seed, dim, bits), r in found.items():
        x, y = vectors[seed, 0][:, :dim], vectors[seed, 1][:, :dim]
        bound = np.abs(y).max()
        preds = []
        for v in (x, y):
            z = np.c_[share @ cells.quantized_array(v, bits, bound), np.ones(60)]
            a, w = z[::2], np.zeros(dim + 1)
            for _ in range(200):  # Newton's steps
                p = 1 / (1 + np.exp(-a @ w))
                g, h = (p - label[::2]) @ a / 30 + 1e-3 * w, (a * (p * (1 - p))[:, None]).T @ a / 30 + 1e-3 * np.eye(dim + 1)
                w = w - np.linalg.solve(h, g)
            preds.append(z[1::2] @ w > 0)
        assert r.examples == 30
        assert abs(r.disagreement - 100 * np.mean(preds[0] != preds[1])) <= 100 / 30 + 1e-9
        assert abs(r.quality - 100 * np.mean(preds[0] == label[1::2])) <= 100 / 30 + 1e-9


def test_approximate_neighbours_reach_their_recall(spark, monkeypatch):
    monkeypatch.setattr(approximate, "BLOCK", 40)  # large buckets are cut
    draw = np.random.default_rng(3)
    z = draw.normal(size=(12, 16))[draw.integers(12, size=600)] + 0.7 * draw.normal(size=(600, 16))
    z[300:420] = z[300] + 0.01 * draw.normal(size=(120, 16))  # a hot bucket
    emb = emb_of(spark, z)
    exact = neighbours.nearest_of_all(emb, 5)
    row = approximate.recall(approximate.approximate_nearest(emb, 5), exact).first()
    assert row.queries == 600 and row.recall >= 0.9
    some = emb.where("rank % 10 = 0").select("rank")
    found = approximate.approximate_nearest(emb, 5, some, target=1.0)
    assert {r["query"] for r in found.select("query").distinct().collect()} == set(range(0, 600, 10))
    assert approximate.approximate_nearest(emb.limit(0), 5).count() == 0


def test_approximate_queries_move_once_to_a_group(spark, monkeypatch):
    """A few vectors move for each row, however many cells are asked, and fewer cells are asked than there are."""
    draw, moved, dealt = np.random.default_rng(8), [], DataFrame.repartition

    def counted(rows, *by):
        moved.append(rows.count())
        return dealt(rows, *by)

    for n in (1000, 4000):
        z = draw.normal(size=(40, 24))[draw.integers(40, size=n)] + 0.3 * draw.normal(size=(n, 24))
        emb = emb_of(spark, z)
        moved.clear()
        with monkeypatch.context() as patch:
            patch.setattr(DataFrame, "repartition", counted)
            found = approximate.approximate_nearest(emb, 5)
        assert found.select("query").distinct().count() == n
        assert max(moved) <= 5 * n
        pivots = neighbours.pivots_of(emb, n, n // 64)
        probes, share = approximate.chosen(emb, pivots, 5, 0.95)
        assert share >= 0.95 and probes < 0.8 * len(pivots)


def test_sql_functions(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(50, 3))
    pairs = spark.createDataFrame([(i, f"w{i}", *(v.tolist() for v in (x[i], x[i] + 0.1 * draw.normal(size=3), draw.normal(size=2), draw.normal(size=2)))) for i in range(50)], "rank bigint, word string, x array<double>, y array<double>, e array<double>, f array<double>")
    sql.register(spark, {"some_pairs": pairs, "bare_pairs": pairs.drop("e", "f")})
    ask = "SELECT * FROM gram_measures(TABLE(SELECT * FROM gram_parts(TABLE(SELECT *, rank % 7 AS part FROM {}) PARTITION BY part)) WITH SINGLE PARTITION)"
    row = spark.sql(ask.format("some_pairs")).first()
    assert row.n == 50 and row.pip == pytest.approx(measures.pip_loss(pairs)) and row.eigen_overlap == pytest.approx(measures.eigen_overlap(pairs)) and row.eis == pytest.approx(measures.eis(pairs))
    assert spark.sql(ask.format("bare_pairs")).first().eis is None


def test_texts_meet_each_word_of_a_block_once(spark):
    """`text_bags` holds what `bags` does in a row for each text, and a block gets a word's vectors once, however many texts name it."""
    draw = np.random.default_rng(6)
    emb = emb_of(spark, draw.normal(size=(9, 3)))
    lines = spark.createDataFrame([(i, " ".join(f"w{w}" for w in draw.integers(12, size=20)), i % 2) for i in range(50)], "example_id int, text string, label int")
    texts = finetune.text_bags(lines, emb)
    got = {(r.example_id, f"w{w}"): pytest.approx(s) for r in texts.collect() for w, s in zip(r.words, r.shares)}
    assert got == {(r.example_id, r.word): r.share for r in finetune.bags(lines, emb).collect()}
    quads = spark.createDataFrame([(s, i, [1.0 * i, 2.0]) for s in (1, 2) for i in range(9)], "seed int, rank bigint, x array<double>")
    rows = blocks.meeting(blocks.in_blocks(texts, "example_id", 10), quads.select("rank", F.col("seed").alias("kind"), F.col("x").alias("vec"))).collect()
    n = len({r.block for r in rows})
    assert n > 1 and sum(r.is_text for r in rows) == 50 and sum(not r.is_text for r in rows) <= n * 9 * 2


def test_packed_texts_move_once_and_meet_their_words(spark):
    """Blocks hold all texts and each of their words' vectors once; texts are shuffled once, and means of counts leave unknown words out."""
    draw = np.random.default_rng(9)
    rows = [(i, draw.integers(12, size=draw.integers(1, 30)).tolist() if i else [11, 11], i % 2 == 0) for i in range(90)]
    lines = spark.createDataFrame([(i, w, t, 1) for i, w, t in rows] + [(99, None, True, 1)], "example_id bigint, words array<int>, train boolean, label int").repartition(3)
    texts = blocks.counted(lines)
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "rank bigint, vec array<float>")

    def run(part, ranks, vecs):
        words, ends, weights, counts = blocks.unpacked(part.column(0), part.column(4))
        n, lacking = int(weights.sum()), int(weights[blocks.places(ranks, words) < 0].sum())
        assert counts and (vecs[:, 0] == ranks).all() and len(set(ranks)) == len(ranks)
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (len(part), n, lacking, len(ranks))], names=["texts", "words", "lacking", "named"])

    found = blocks.by_block(texts.select("example_id", "words", "train", "label", "weights"), "example_id", 5, vectors, run, "texts long, words long, lacking long, named long")
    got = found.collect()
    want = [w for _, ws, _ in rows for w in ws]
    assert len(got) == 5 and [sum(r[k] for r in got) for k in range(3)] == [90, len(want), sum(w > 9 for w in want)] and max(r.named for r in got) <= 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan
    quads = spark.createDataFrame([(s, i, *[[float(s), float(i)]] * 4) for s in (1, 2) for i in range(10) if s == 1 or i < 9], "seed int, rank bigint, " + ", ".join(f"{c} array<double>" for c in "xyef"))
    cell = [cells.Cell(1, 2, 32), cells.Cell(2, 1, 32)]
    means = tasks.cell_means(texts, 90, quads, cell, ({}, dict.fromkeys(cell, 1.0))).collect()
    for seed, most in ((1, 10), (2, 9)):
        own = [[w for w in ws if w < most] for _, ws, _ in rows]
        want = sorted([np.mean(w) for w in own if w])
        assert sorted(r.vec[-1] for r in means if r.seed == seed) == pytest.approx(want if seed == 1 else [2.0] * len(want)) and {len(r.vec) for r in means if r.seed == seed} == {4 if seed == 1 else 2}


def test_texts_are_packed_like_split_and_crc32(spark):
    odd = ["", "  ", "\n", " \n ", "\na b", "a b\n", "\t\n a\x0b\x0cb\r\n", "é ü  y", "a\x1cb c\x85d", "x " * 700, None]
    lines = spark.createDataFrame(list(enumerate(odd)), "example_id int, text string")
    ranks = lines.selectExpr("example_id", r"transform(split(trim(text), '\\s+'), w -> pmod(crc32(w), 50)) as words")
    for df in (blocks.counted(lines, 50), blocks.counted(ranks)):
        got = {r.example_id: sorted(np.repeat(np.frombuffer(r.words, np.int32), list(r.weights)).tolist()) for r in df.collect()}
        assert got == {r.example_id: sorted(r.words) for r in ranks.where("words is not null").collect()} and len(got) == 10


def test_models_side_by_side_equal_each_alone(spark, monkeypatch):
    """Models of several seeds take the same rounds in one pass each, and predict what each does alone; texts without a known word have no say."""
    draw = np.random.default_rng(4)
    emb = emb_of(spark, draw.normal(size=(8, 4)) * 0.1)
    rows = [(i, draw.integers(11, size=6).tolist() if i else [9, 10], i % 2) for i in range(60)]
    texts = finetune.durable(blocks.counted(spark.createDataFrame(rows, "example_id int, words array<int>, label int").repartition(3)))
    seeds = [(1, 1), (2, 1), (1, 2)]
    steps, step = [], finetune._step
    monkeypatch.setattr(finetune, "_step", lambda *a: steps.append(1) or step(*a))
    side = finetune.tuned(texts, emb, seeds, rounds=3, batches=2, rate=10.0)
    assert len(steps) == 3
    preds = {r.example_id: r for r in finetune.judged(texts, 60, side).collect()}
    assert set(preds) == {i for i, w, _ in rows if min(w) < 8} and 0 not in preds
    for k, seed in enumerate(seeds):
        alone = finetune.tuned(texts, emb, [seed], rounds=3, batches=2, rate=10.0)
        assert side.weights[k] == pytest.approx(alone.weights[0]) and side.biases[k] == pytest.approx(alone.biases[0])
        assert all(r.pred_1 == preds[r.example_id][1 + k] for r in finetune.judged(texts, 60, alone).collect())
    # the same by the path of shares
    lines = spark.createDataFrame([(i, " ".join(f"w{x}" for x in w), y) for i, w, y in rows], "example_id int, text string, label int")
    one = finetune.finetuned(lines, emb, 1, 2, rounds=3, batches=2, rate=10.0)
    assert one.weights == pytest.approx(side.weights[2]) and one.bias == pytest.approx(side.biases[2])
