import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstead.functions import vectors as V
from vecstead.operators import align, compress, measures
from vecstead.operators.gram import gram, triangular
from vecstead.sources import text

PAIR = (["river", "stone"], [[0.5, -1, 2], [4, 1, -3]])


def rows(emb, column="vec"):
    return [r[column] for r in emb.orderBy("rank").collect()]


def lines(spark, *body):
    return spark.createDataFrame(list(enumerate(body)), "line_no bigint, line string")


def random_pair(spark, n=200, x=12, y=12, seed=0, parts=3):
    rng = np.random.default_rng(seed)
    a, b = rng.standard_normal((n, x)), rng.standard_normal((n, y))
    df = spark.createDataFrame([(i, str(i), a[i].tolist(), b[i].tolist()) for i in range(n)], "rank bigint, word string, x array<double>, y array<double>")
    return df.repartition(parts), a, b


@pytest.mark.parametrize("header", [False, True])
def test_round_trip(spark, tmp_path, header):
    emb = text.from_arrays(spark, PAIR[1], PAIR[0])
    text.write_embedding(emb, f"{tmp_path}/emb", header)
    back = text.read_embedding(spark, f"{tmp_path}/emb")
    assert [tuple(r) for r in back.orderBy("rank").collect()] == [tuple(r) for r in emb.orderBy("rank").collect()]


def test_arrays_need_each_other(spark):
    with pytest.raises(ValueError):
        text.from_arrays(spark, [[1.0]], None)


def test_words_with_spaces_and_the_one_dimensional_trap(spark):
    got = text.parse_embedding_lines(lines(spark, "a 1.0 2.0 ", "new york 3.0 4.0", " 5.0 6.0", "7.0 8.0")).orderBy("rank").collect()
    assert [(r.rank, r.word, r.vec) for r in got] == [(0, "a", [1, 2]), (1, "new york", [3, 4]), (2, "", [5, 6]), (3, "", [7, 8])]
    assert [r.word for r in text.parse_embedding_lines(lines(spark, "a 1.0", "b 2.0")).collect()] == ["b"]
    with pytest.raises(Exception, match="too few"):
        text.parse_embedding_lines(lines(spark, "a 1.0 2.0 3.0", "b 4.0")).collect()


def test_vocabularies(spark):
    body = lines(spark, "the 5", "bad", "of  7", "the 9")
    assert [r.word for r in text.parse_vocab_words(body).orderBy("line_no").collect()] == ["the", "of", "the"]
    assert {r.word: r.cnt for r in text.parse_vocab_counts(body.where("line <> 'bad'")).collect()} == {"the": 9, "of": 7}
    with pytest.raises(Exception, match="not a word"):
        text.parse_vocab_counts(body).collect()


def procrustes(a, b):
    u, _, vt = np.linalg.svd(a.T @ b)
    return u @ vt


def test_align_on_the_same_and_on_part_of_the_vocabulary(spark):
    base = text.from_arrays(spark, PAIR[1], PAIR[0])
    for vocab, vecs in ((["river", "stone"], [[1, 2, -2], [0.5, 6, 1]]), (["stone", "cloud", "river"], [[2, -7, 1], [1, 1, 8], [-3, 0.25, 2]])):
        moved = measures.align_to(text.from_arrays(spark, vecs, vocab), base)
        fit = np.array([vecs[vocab.index(w)] for w in PAIR[0]], dtype=float)
        assert np.allclose(np.linalg.norm(np.array(rows(moved)), axis=1), np.linalg.norm(vecs, axis=1))
        want = fit @ procrustes(fit, np.array(PAIR[1], dtype=float))
        got = np.array(rows(moved))[[vocab.index(w) for w in PAIR[0]]]
        assert np.isclose(np.linalg.norm(got - PAIR[1]), np.linalg.norm(want - PAIR[1]))


def test_subembedding(spark):
    emb = text.from_arrays(spark, [[2, 9], [8, 1], [5, 5], [7, 3]], ["river", "stone", "cloud", "leaf"])
    got = align.subembedding(emb, ["leaf", "stone", "leaf"]).orderBy("pos").collect()
    assert [r.vec for r in got] == [[7, 3], [8, 1], [7, 3]]
    with pytest.raises(TypeError):
        align.subembedding(emb, ("river",))
    with pytest.raises(Exception, match="missing word"):
        align.subembedding(emb, ["ocean"]).collect()


def test_lookups(spark):
    emb = text.from_arrays(spark, [[1, 2], [3, 4], [5, 6]], ["a", "b", "a"])
    words = spark.createDataFrame([("a",), ("z",)], "word string")
    assert [r.word for r in align.out_of_vocabulary(words, emb).collect()] == ["z"]
    assert [r.word for r in align.in_vocabulary(words, emb).collect()] == ["a"]
    assert {r.word: r.vec for r in align.represent(words, emb, 2).collect()} == {"a": [5, 6], "z": [0, 0]}  # the last of a repeated word


def test_shared_vocabulary(spark):
    a = text.from_arrays(spark, [[1.0], [2.0], [3.0]], ["x", "y", "z"])
    b = text.from_arrays(spark, [[4.0], [5.0], [6.0]], ["z", "y", "w"])
    assert [r.word for r in align.shared(a, b, 1).collect()] == ["y"]
    assert align.shared(a, b, 10).count() == 2 and align.shared(a, b).count() == 2
    assert {r.word for r in align.shared(a, b, 2, random=True).collect()} == {"y", "z"}
    with pytest.raises(ValueError):
        align.shared(a, b, 3, random=True)
    with pytest.raises(Exception, match="missing word"):
        align.with_anchors(a, b, a, a).collect()


def test_normalize_keeps_zero(spark):
    emb = text.from_arrays(spark, [[3.0, 4.0], [0.0, 0.0]], ["a", "b"])
    assert rows(align.normalize(emb)) == [[0.6, 0.8], [0.0, 0.0]]


def test_summaries(spark):
    pairs, a, b = random_pair(spark, parts=40)
    z = np.concatenate([a, b], axis=1)
    g, widths = gram(pairs, ["x", "y"])
    assert widths == [12, 12] and np.allclose(g, z.T @ z)
    r, widths = triangular(pairs, ["x", "y"])
    assert widths == [12, 12] and r.shape == (24, 24) and np.allclose(r.T @ r, z.T @ z)
    for summary in (gram, triangular):
        with pytest.raises(ValueError, match="no rows"):
            summary(pairs.limit(0), ["x", "y"])


def test_one_pass_gives_all_spectral_measures(spark):
    pairs, a, b = random_pair(spark)
    quads = pairs.withColumns({"e": F.reverse("x"), "f": F.slice("y", 1, 9)})
    found, rotation = measures.spectral(quads)
    assert np.isclose(found["pip"], measures.pip_loss(pairs)) and np.isclose(found["eis"], measures.eis(quads)) and np.isclose(found["eigen_overlap"], measures.eigen_overlap(pairs))
    assert np.allclose(rotation, procrustes(a, b))


@pytest.mark.parametrize("y", [12, 10])
def test_measures_against_numpy(spark, y):
    pairs, a, b = random_pair(spark, y=y)
    assert np.isclose(measures.pip_loss(pairs), np.linalg.norm(a @ a.T - b @ b.T))
    (u, _, _), (v, s, _) = np.linalg.svd(a, full_matrices=False), np.linalg.svd(b, full_matrices=False)
    assert np.isclose(measures.eigen_overlap(pairs), np.linalg.norm(u.T @ v) ** 2 / 12)
    for exp in (1, 2.5):
        assert np.isclose(measures.weighted_eigen_overlap(pairs, exp), np.linalg.norm((u.T @ v) * s**exp) ** 2 / np.sum(s ** (2 * exp)))
    if y == 12:
        assert np.isclose(measures.fro_norm(pairs).first().fro_norm, np.linalg.norm(a - b))
        moved = a @ procrustes(a, b)
        cos = np.sum(moved * b, axis=1) / np.linalg.norm(moved, axis=1) / np.linalg.norm(b, axis=1)
        assert np.isclose(measures.sem_disp(pairs).first().sem_disp, 1 - cos.mean())


def test_eis_against_its_definition(spark):
    rng = np.random.default_rng(1)
    x, y, e, f = (rng.standard_normal((150, d)) for d in (8, 6, 9, 7))
    quads = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist(), e[i].tolist(), f[i].tolist()) for i in range(150)], "rank bigint, x array<double>, y array<double>, e array<double>, f array<double>")
    p, q = (np.linalg.svd(m, full_matrices=False)[0] for m in (x, y))
    p, q = p @ p.T, q @ q.T
    up = down = 0.0
    for anchor in (e, f):
        u, s, _ = np.linalg.svd(anchor, full_matrices=False)
        sigma = (u * s**6) @ u.T
        up, down = up + np.trace((p + q - 2 * q @ p) @ sigma), down + np.trace(sigma)
    assert np.isclose(measures.eis(quads), up / down)


def test_identical_pairs(spark):
    pairs, a, _ = random_pair(spark)
    same = pairs.withColumn("y", F.col("x"))
    assert measures.pip_loss(same) == 0 and measures.fro_norm(same).first().fro_norm == 0
    assert np.isclose(measures.eigen_overlap(same), 1) and abs(measures.sem_disp(same).first().sem_disp) < 1e-12
    assert measures.knn(same, 20, 3).first().knn == 1
    assert abs(measures.eis(same.withColumns({"e": F.col("x"), "f": F.col("x")}))) < 1e-12
    near = pairs.withColumn("y", F.transform("x", lambda v: v + 1e-9))
    d, s = np.full_like(a, 1e-9), 2 * a + 1e-9
    want = np.sqrt((np.sum((d.T @ d) * (s.T @ s)) + np.sum((d.T @ s) * (d.T @ s).T)) / 2)
    assert np.isclose(measures.pip_loss(near), want, rtol=1e-5)


def test_rank_deficient_matrices_have_an_answer(spark):
    pairs, _, _ = random_pair(spark)
    flat = pairs.withColumn("x", F.concat("x", "x"))
    assert 0 <= measures.eigen_overlap(flat) <= 1


def test_zero_vectors_are_left_out_of_the_mean(spark):
    pairs = spark.createDataFrame([(0, "a", [1.0, 0.0], [0.0, 1.0]), (1, "b", [0.0, 0.0], [1.0, 1.0])], "rank bigint, word string, x array<double>, y array<double>")
    assert measures.sem_disp(pairs, aligned=False).first().sem_disp == 1


def test_neighbours_ties_copies_and_passes(spark, monkeypatch):
    vecs = [[1, 0], [1, 0], [1, 0], [0, 1], [1, 1]]
    emb = text.from_arrays(spark, vecs, list("abcde")).repartition(3)
    monkeypatch.setattr(measures, "QUERY_CELLS", 2)
    got = measures.nearest(emb, emb, 2).orderBy("query", "place").collect()
    assert [(r["query"], r["rank"]) for r in got] == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1), (3, 4), (3, 0), (4, 0), (4, 1)]
    assert measures.nearest(emb, emb.limit(0), 2).count() == 0


def test_quantization(spark):
    rng = np.random.default_rng(2)
    emb = text.from_arrays(spark, rng.standard_normal((300, 6)).tolist(), [str(i) for i in range(300)])
    for bits in (1, 2, 4):
        levels = {round(v, 9) for x in rows(compress.quantize(emb, bits, 1.0)) for v in x}
        assert len(levels) <= 2**bits and max(map(abs, levels)) <= 1
    errors = [compress.squared_error(emb, b, compress.best_bound(emb, b)).first().squared_error for b in (1, 2, 4, 8)]
    assert errors == sorted(errors, reverse=True)
    assert rows(compress.quantize(emb, 32)) == rows(emb)
    best = compress.best_bound(emb, 1)
    others = [compress.squared_error(emb, 1, r).first().squared_error for r in (0.4, 1.2, 3.0)]
    assert compress.squared_error(emb, 1, best).first().squared_error <= min(others)
    assert rows(compress.quantize(emb.withColumn("vec", F.array(F.lit(0.0))), 2))[0] == [0.0]


def test_compress_aligns_to_its_base(spark):
    pairs, a, b = random_pair(spark, n=60, x=4, y=4)
    x, y = (pairs.select("rank", "word", F.col(c).alias("vec")) for c in "xy")
    moved = a @ procrustes(a, b)
    assert np.allclose(np.array(rows(compress.compress(x, 32, y))), moved)
    got = np.array(rows(compress.compress(x, 2, y)))
    bound = compress.best_bound(y, 2)  # the base's, not its own
    step = 2 * bound / 3
    assert not np.isclose(bound, compress.best_bound(x, 2))
    assert np.allclose(got, np.floor((np.clip(moved, -bound, bound) + bound) / step + 0.5) * step - bound)


def test_quantized_tables_by_bitrate(spark, tmp_path):
    pairs, a, b = random_pair(spark, n=60, x=4, y=4)
    x, y = (pairs.select("rank", "word", F.col(c).alias("vec")) for c in "xy")
    compress.write_quantized(x, [2, 32], f"{tmp_path}/q", base=y)
    assert np.allclose(rows(compress.read_quantized(spark, f"{tmp_path}/q", 32)), a @ procrustes(a, b))
    assert rows(compress.read_quantized(spark, f"{tmp_path}/q", 2)) == rows(compress.compress(x, 2, y))
    assert compress.read_quantized(spark, f"{tmp_path}/q").groupBy("bitrate").count().count() == 2
    found = {(r.dim, r.bits): r.squared_error for r in compress.squared_errors(x, [2, 4], [1, 4]).collect()}
    assert len(found) == 4 and np.isclose(found[4, 4], compress.squared_error(x, 4, compress.largest(x)).first().squared_error)


def test_anchor_bundles(spark, tmp_path):
    a = text.from_arrays(spark, [[1.0, 2], [2.0, 1], [3.0, 3]], ["x", "y", "z"])
    b = text.from_arrays(spark, [[4.0, 1], [5.0, 2], [6.0, 3]], ["z", "y", "w"])
    align.write_anchors(align.anchor_bundle(a, b), f"{tmp_path}/anchors")
    bundle = align.read_anchors(spark, f"{tmp_path}/anchors")
    assert [tuple(r) for r in bundle.orderBy("rank").collect()] == [(1, "y", [2, 1], [5, 2]), (2, "z", [3, 3], [4, 1])]
    assert {(r.word, tuple(r.x), tuple(r.e)) for r in align.with_bundle(b, a, bundle).collect()} == {("y", (5, 2), (2, 1)), ("z", (4, 1), (3, 3))}


def test_missing_anchor_words_raise_whatever_is_selected(spark):
    a = text.from_arrays(spark, [[1.0], [2.0]], ["x", "y"])
    with pytest.raises(Exception, match="missing word"):
        align.with_anchors(a, a.limit(1), a, a).select("f").collect()


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    (tmp_path / "long.txt").write_text("".join(f"line {i}\n" for i in range(20_000)))
    (tmp_path / "short.txt").write_text("one\ntwo\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = text.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 20_002 and all(r.line == f"line {r.line_no}" for r in got if r.path.endswith("long.txt"))


def test_vector_expressions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0])], "x array<double>, y array<double>").select(V.dot("x", "y").alias("d"), V.norm("x").alias("n"), V.cosine_distance("x", "y").alias("c"), V.section("x", 2, 1).alias("s")).first()
    assert (row.d, row.n, round(row.c, 12), row.s) == (24.0, 5.0, 0.04, [4.0])
