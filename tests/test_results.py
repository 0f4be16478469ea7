import itertools

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from vecstead.operators import downstream, stats
from vecstead.plans import grid
from vecstead.sources import text
from vecstead.streaming import drift

DS = ["la_sst", "la_mr"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    cells = itertools.product(("mc", "glove"), (1234, 1235), (25, 50, 100), (1, 2, 4))
    rows = [Row(algo=a, seed=s, dim=d, bitrate=b, space=d * b, eis=float(rng.integers(0, 6)), knn=float(rng.integers(0, 6)), la_sst=float(rng.integers(0, 9)), la_mr=float(rng.normal())) for a, s, d, b in cells]
    return spark.createDataFrame(rows), rows


def pick(values, highest):
    return int(np.argmax(values) if highest else np.argmin(values))


@pytest.mark.parametrize(("budget", "same"), [(None, False), (100, False), (None, True), (1, False)])
def test_selection(table, budget, same):
    df, rows = table
    got = {(r.algo, r.seed, r.metric, r.task): r for r in stats.selection(df, ["eis", "knn"], DS, budget, same).collect()}
    for algo, seed, m, t in itertools.product(("mc", "glove"), (1234, 1235), ("eis", "knn"), DS):
        own = [r for r in rows if (r.algo, r.seed) == (algo, seed)]
        pairs = [(a, b) for a, b in itertools.combinations(own, 2) if (budget is None or max(a.space, b.space) <= budget) and (not same or a.space == b.space)]
        wrong = [abs(a[t] - b[t]) for a, b in pairs if pick([a[m], b[m]], m == "knn") != pick([a[t], b[t]], False)]
        if not pairs:
            assert (got[algo, seed, m, t].pairs, got[algo, seed, m, t].error, got[algo, seed, m, t].robustness) == (0, None, None)
            continue
        r = got[algo, seed, m, t]
        assert (r.pairs, r.error, r.robustness) == (len(pairs), pytest.approx(len(wrong) / len(pairs)), pytest.approx(max(wrong, default=0)))


def test_oracle_gaps(table):
    df, rows = table
    got = {(r.algo, r.space, r.seed, r.metric, r.task): r.gap for r in stats.oracle_gaps(df, ["eis", "knn"], DS).collect()}
    want = {}
    for (algo, space, seed), own in itertools.groupby(sorted(rows, key=lambda r: (r.algo, r.space, r.seed, r.dim, r.bitrate)), key=lambda r: (r.algo, r.space, r.seed)):
        own = list(own)
        if len(own) > 1:
            for m, t in itertools.product(["eis", "knn", "baseline_fp", "baseline_lp"], DS):
                column = "bitrate" if "baseline" in m else m
                want[algo, space, seed, m, t] = own[pick([r[column] for r in own], m in ("knn", "baseline_fp"))][t] - min(r[t] for r in own)
    assert got == pytest.approx(want)


def average_ranks(x):
    x = np.array(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


def test_spearman_with_ties_and_missing_values(spark, table):
    df, rows = table
    got = {(r.metric, r.task): r.rho for r in stats.spearman(df, ["eis", "knn"], DS).collect()}
    for m, t in got:
        x = [1 - r[m] if m == "knn" else r[m] for r in rows]
        assert got[m, t] == pytest.approx(np.corrcoef(average_ranks(x), average_ranks([r[t] for r in rows]))[0, 1])
    some = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (None, 9.0), (float("nan"), 0.0)], "eis double, t double")
    assert stats.spearman(some, ["eis"], ["t"]).first().rho == pytest.approx(0.5)


@pytest.mark.parametrize(("over", "other"), [("space", None), ("bitrate", "dim"), ("dim", "bitrate")])
def test_fit_trend(table, over, other):
    df, rows = table
    got = stats.fit_trend(df, DS, over, 300).collect()
    own = [r for r in rows if r.space < 300]
    groups = sorted({(r.algo, t, r[other] if other else 0) for r in own for t in DS})
    x = np.zeros((len(own) * len(DS), 1 + len(groups)))
    y = np.zeros(len(x))
    for i, (r, t) in enumerate(itertools.product(own, DS)):
        x[i, 0], x[i, 1 + groups.index((r.algo, t, r[other] if other else 0))], y[i] = np.log2(r[over]), 1, r[t]
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    assert all(r.slope == pytest.approx(want[0]) for r in got)
    assert {(r.algo, r.task, r.level): r.intercept for r in got} == pytest.approx(dict(zip(groups, want[1:])))


def test_gather_and_summary(table):
    df, rows = table
    keys = ["algo", "seed", "dim", "bitrate", "space"]
    parts = {c: df.select(*keys, F.col(c).alias("value")) for c in ("eis", "la_sst")}
    parts["eis"] = parts["eis"].where("dim <> 25")
    got = stats.gather(parts, keys)
    assert got.count() == sum(r.dim != 25 for r in rows)
    one = stats.summary(df, ["algo", "dim"], ["eis"]).where("algo = 'mc' and dim = 25").first()
    own = [r.eis for r in rows if (r.algo, r.dim) == ("mc", 25)]
    assert (one.eis_mean, one.eis_std) == (pytest.approx(np.mean(own)), pytest.approx(np.std(own, ddof=1)))


def test_votes_and_plots(table):
    df, rows = table
    got = {r.metric: r for r in stats.votes(df, ["eis", "knn"], F.col("dim") == 25, F.col("dim") == 100).collect()}
    for m, r in got.items():
        a, b = (round(np.mean([x[m] for x in rows if x.dim == d]), 3) for d in (25, 100))
        assert (r.first, r.second, r.vote) == (pytest.approx(a), pytest.approx(b), "second" if (b > a if m == "knn" else b < a) else "first")
    assert stats.plot_series(df, "dim", "dim", "knn").count() == 3
    assert stats.plot_against(df, "bitrate", "knn", DS).count() == 9 * len(DS)


def test_results_files_keep_dotted_columns(spark, tmp_path):
    df = spark.createDataFrame([("mc", 1234, 0.5, 0.1)], ["algo", "seed", "anchor_eigen_overlap_3.0_top_10000", "pip_top_10000"])
    text.write_results(df, f"{tmp_path}/r")
    back = text.read_results(spark, f"{tmp_path}/r")
    assert back.columns == ["algo", "seed", "eis", "pip"] and back.first().eis == 0.5


def test_disagreement(spark):
    a = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 1)], "example_id bigint, pred int")
    b = spark.createDataFrame([(3, 0), (2, 1), (1, 0), (0, 1)], "example_id bigint, pred int")
    assert downstream.disagreement(a, b).first().disagreement == 25
    with pytest.raises(Exception, match="different examples"):
        downstream.disagreement(a, b.limit(2)).collect()


def test_ner_disagreement(spark):
    one = ["EU B-ORG B-ORG 0.9", "rejects O O 0.9", "", "German B-MISC B-PER 0.9", "too short O", "Peter B-PER B-PER 0.9"]
    two = [*one[:3], "German B-MISC B-MISC 0.8", *one[4:]]
    files = [text.parse_ner_lines(spark.createDataFrame(list(enumerate(x)), "line_no bigint, line string")) for x in (one, two)]
    assert downstream.ner_disagreement(*files).first().disagreement == pytest.approx(100 / 3)
    # of the second file three fields are enough, and a tagged line that it lacks raises
    short = spark.createDataFrame([(0, "EU B-ORG B-ORG"), (3, "German B-MISC B-PER"), (5, "Peter B-PER O")], "line_no bigint, line string")
    assert downstream.ner_disagreement(files[0], text.parse_ner_lines(short, fields=3)).first().disagreement == pytest.approx(100 / 3)
    with pytest.raises(Exception, match="lacks a line"):
        downstream.ner_disagreement(files[0], files[1].where("line_no > 0")).collect()


def test_result_store_and_prediction_files(spark, tmp_path):
    keys = "seed int, dim int, lr double, bitrate int, compress_type string, space int, value double"
    cells = [(1, 25, 0.1, b, "uniform", 25 * b) for b in (1, 2)]
    for algo in ("a", "b"):
        for metric, add in (("x_3.0", 0.0), ("y", 10.0)):
            text.store_result(spark.createDataFrame([(*c, add + c[3]) for c in cells], keys), f"{tmp_path}/store", algo, metric)
    text.store_result(spark.createDataFrame([(*cells[0], 7.0)], keys), f"{tmp_path}/store", "b", "y")
    assert text.read_store(spark, f"{tmp_path}/store").count() == 7
    wide = text.gather_store(spark, f"{tmp_path}/store", ["x_3.0", "y"]).collect()
    assert {(r.algo, r.bitrate, r["x_3.0"], r.y) for r in wide} == {("a", 1, 1.0, 11.0), ("a", 2, 2.0, 12.0), ("b", 1, 1.0, 7.0)}
    run = spark.createDataFrame([(1, 0), (2, 1)], "example_id bigint, pred int")
    text.write_predictions(run, text.prediction_paths(str(tmp_path), "run")[0])
    paths = text.prediction_paths(str(tmp_path), "run", validation=True)
    assert text.missing_artifacts(spark, paths) == paths[:1] and text.read_predictions(spark, paths).count() == 2
    series = spark.createDataFrame([(0.5, 1.0, 0.1), (0.25, 2.0, None)], "x double, y double, yerr double")
    text.write_figure(series, f"{tmp_path}/figure")
    assert {tuple(r) for r in text.read_figure(spark, f"{tmp_path}/figure").collect()} == {(0.5, 1.0, 0.1), (0.25, 2.0, None)}


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("start\ntest error: 0.25\ndone\n")
    (tmp_path / "b.log").write_text("start\nstopped\ndone\n")
    logs = text.numbered_lines(spark, str(tmp_path))
    quality = downstream.sentiment_quality(logs)
    assert {r.path[-5:]: r.quality for r in quality.collect()} == {"a.log": 75.0, "b.log": None}
    assert {r.path[-5:]: r.complete for r in downstream.complete(quality).collect()} == {"a.log": True, "b.log": False}
    ner = spark.createDataFrame([("n", i, line) for i, line in enumerate(["MICRO_AVG: acc 0.8 - f1-score 0.91", *["x"] * 6])], "path string, line_no bigint, line string")
    assert downstream.ner_quality(ner).first().quality == pytest.approx(91)


def test_predictions_fall_back_to_the_other_name(spark, tmp_path):
    spark.createDataFrame([("m", 0, 1)], "model_key string, example_id bigint, pred int").write.parquet(f"{tmp_path}/new")
    assert text.read_predictions(spark, [f"{tmp_path}/old", f"{tmp_path}/new"]).count() == 1
    with pytest.raises(FileNotFoundError):
        text.read_predictions(spark, [f"{tmp_path}/old"])


def test_classifier_and_word_similarity(spark):
    emb = text.from_arrays(spark, [[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.1, 0.9]], ["good", "fine", "bad", "poor"])
    train = spark.createDataFrame([(0, "good fine", 1), (1, "bad poor", 0), (2, "fine good good", 1), (3, "poor", 0)], "example_id bigint, text string, label int")
    got = downstream.train_and_predict(train, train, emb)
    assert {r.example_id: r.pred for r in got.collect()} == {0: 1, 1: 0, 2: 1, 3: 0}
    pairs = spark.createDataFrame([("good", "fine", 9.0), ("good", "poor", 2.0), ("good", "bad", 1.0)], "first string, second string, score double")
    assert downstream.word_similarity(pairs, emb).first().rho == pytest.approx(1)


def test_tags():
    assert grid.measure_tag("eis", exp=3.0, truncate=10000) == "eis_3.0_top_10000"
    assert grid.measure_tag("knn", truncate=10000, nneighbors=5) == "knn_top_10000_nquery_1000_nn_5"
    assert grid.measure_tag("pred", "la", "sst", tag="no_emb_norm", validation=True) == "la_sst_no_emb_norm_val"
    assert grid.measure_tag("quality", "la", "sst") == "la_sst_quality"
    assert grid.file_tag("pip_top_10000", 25, "uniform", wiki=True) == "pip_top_10000_dim_25_uniform_wiki"


def test_late_events_are_left_out_of_a_stream(spark, tmp_path):
    import os
    from datetime import datetime

    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    batches = [[at(3), at(3, 20)], [at(22)], [at(22, 5)], [at(21, 30), at(3, 40), at(22, 10)], [at(4)]]  # a batch's late rows are told by the watermark two before
    for i, times in enumerate(batches):
        spark.createDataFrame([(t, "k", 2.0) for t in times], "ts timestamp, key string, value double").coalesce(1).write.parquet(f"{tmp_path}/in{i}")
        for part in (tmp_path / f"in{i}").glob("*.parquet"):
            os.utime(part, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema("ts timestamp, key string, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    got = drift.run_to_end(drift.windowed_moments(stream, "ts", "key", "value"), ["start", "key"], f"{tmp_path}/out").collect()
    # the rows of 03:40 and 04:00 come 18 hours late at a watermark of two; the one of 21:30 is in time
    assert {(r.start.hour, r.n, r.total, r.squares) for r in got} == {(3, 2, 4.0, 8.0), (21, 1, 2.0, 4.0), (22, 3, 6.0, 12.0)}
