"""Folders of embedding files: round trips, odd files, and commits that are whole or nothing; k-means codebooks; drift of a stream."""

from __future__ import annotations

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstead.operators import codebooks, measures
from vecstead.sources import text
from vecstead.sources.folder import file_name, name_fields, read_folder, write_folder
from vecstead.streaming import drift

SCHEMA = "seed int, dim int, bitrate int, rank bigint, word string, vec array<double>"


def test_files_with_their_own_headers_and_widths(spark, tmp_path):
    (tmp_path / "mc_wiki.txt_2017_seed_1234_dim_2_br_4.txt").write_text("3 2\na 1 2\nb c 3 -4.5\n  5 6 \n")
    (tmp_path / "plain.txt").write_text("x 1 2 3\ny 4 5 6\n")
    (tmp_path / "empty_seed_1.txt").write_text("")
    (tmp_path / "_hidden.txt").write_text("z 1\n")
    rows = {(r.file, r["rank"]): r for r in read_folder(spark, str(tmp_path)).collect()}
    assert len(rows) == 5
    first = rows["mc_wiki.txt_2017_seed_1234_dim_2_br_4.txt", 1]
    assert (first.seed, first.dim, first.bitrate, first.word, first.vec) == (1234, 2, 4, "b c", [3.0, -4.5])
    assert rows["plain.txt", 1].vec == [4.0, 5.0, 6.0] and rows["plain.txt", 0].seed is None
    for name in ("mc_wiki.txt_2017_seed_1234_dim_2_br_4.txt", "plain.txt"):  # as the reader of one file has it
        single = {(r["rank"], r.word): r.vec for r in text.read_embedding(spark, str(tmp_path / name)).collect()}
        assert single == {(k[1], r.word): r.vec for k, r in rows.items() if k[0] == name}
    (tmp_path / "short.txt").write_text("a 1 2 3\nb 1\n")
    with pytest.raises(Exception, match="too few numbers"):
        read_folder(spark, str(tmp_path)).collect()


def test_round_trip_splits_and_overwrite(spark, tmp_path):
    rows = [(s, d, None if d == 3 else 8, i, f"w{i}", [round(float(x), 6) for x in np.random.default_rng([s, d, i]).normal(size=d)]) for s in (1, 2) for d in (2, 3) for i in range(5)]
    embs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    path = str(tmp_path / "out")
    write_folder(embs, path, stem="a", header=True)
    found = read_folder(spark, path, split=100)
    assert found.rdd.getNumPartitions() > 1
    assert sorted(tuple(r)[1:] for r in found.collect()) == sorted(rows, key=lambda r: (r[0], r[1], r[3]))
    assert (tmp_path / "out" / "a_seed_1_dim_2_br_8.txt").read_text().startswith("5 2\nw0 ")
    with pytest.raises(Exception, match="stand there already"):
        write_folder(embs.limit(1), path, stem="a")
    write_folder(embs.where("seed = 1 and dim = 2"), path, stem="a", mode="overwrite")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["a_seed_1_dim_2_br_8.txt"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    embs = spark.range(6).select(F.lit(1).alias("seed"), F.col("id").cast("int").alias("dim"), F.lit(1).alias("bitrate"), F.col("id").alias("rank"), F.lit("w").alias("word"), F.when(F.col("id") == 5, F.raise_error(F.lit("stop")).cast("array<double>")).otherwise(F.array(F.lit(1.0))).alias("vec"))
    with pytest.raises(Exception, match="stop"):
        write_folder(embs, path)
    assert not (tmp_path / "out").exists() or not [p for p in (tmp_path / "out").rglob("*.txt") if "_writing" not in str(p)]


def test_names():
    assert name_fields("a_seed_12_dim_3_br_1.txt") == {"seed": 12, "dim": 3, "bitrate": 1} and name_fields("xseed_1dim.txt") == {"seed": None, "dim": None, "bitrate": None}
    assert name_fields(file_name("e", 5, None, 2)) == {"seed": 5, "dim": None, "bitrate": 2}


@pytest.mark.parametrize("seed", range(4))
def test_cuts_equal_brute_force(seed):
    draw = np.random.default_rng(seed)
    x = np.sort(draw.normal(size=9)) if seed else np.array([1.0, 1, 1, 2, 2, 9, 9, 9, 9])
    n = draw.integers(1, 4, size=9).astype(float)
    found = codebooks.least_cuts(n, n * x, n * x * x, 4)
    for groups, (levels, error) in found.items():
        least = np.inf
        for cut in itertools.combinations(range(1, 9), groups - 1):
            parts = np.split(np.arange(9), cut)
            least = min(least, sum(np.sum(n[p] * (x[p] - np.average(x[p], weights=n[p])) ** 2) for p in parts))
        assert error == pytest.approx(least, abs=1e-9)
        assert np.sum(n * np.min((x[:, None] - levels[None, :]) ** 2, axis=1)) == pytest.approx(least, abs=1e-9)


def test_codebooks_beat_uniform_levels(spark):
    draw = np.random.default_rng(7)
    rows = [(i, f"w{i}", (draw.normal(size=6) * draw.choice([0.1, 1, 5])).tolist()) for i in range(200)]
    emb = spark.createDataFrame(rows, "rank bigint, word string, vec array<double>").repartition(3)
    from vecstead.operators import compress

    uniform = {r.bits: r.squared_error for r in compress.squared_errors(emb, [6], [1, 2, 4, 8]).collect()}
    own = {r.bits: r.squared_error for r in codebooks.codebook_errors(emb, [1, 2, 4, 8]).collect()}
    assert all(own[b] <= uniform[b] for b in own)
    levels = codebooks.codebooks(emb, [2])[2]
    assert len(levels) == 4
    moved = emb.withColumn("q", codebooks.to_levels("vec", levels))
    assert moved.select(F.sum(F.expr("aggregate(zip_with(vec, q, (a, b) -> (a - b) * (a - b)), 0D, (x, y) -> x + y)"))).first()[0] == pytest.approx(own[2])
    same = spark.createDataFrame([(0, "a", [2.0, 2.0])], "rank bigint, word string, vec array<double>")
    assert codebooks.codebooks(same, [1])[1].tolist() == [2.0]
    assert codebooks.codebooks(same.limit(0), [1])[1].tolist() == [0.0]


def test_streamed_drift_equals_the_batch_after_late_rows_and_a_restart(spark, tmp_path):
    draw = np.random.default_rng(8)
    at = lambda hour: datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc) + datetime.timedelta(hours=hour)
    schema = "ts timestamp, x array<double>, y array<double>"
    kept = []

    def land(name, hours, counts=True):
        rows = [(at(h), draw.normal(size=3).tolist(), draw.normal(size=3).tolist()) for h in hours]
        kept.extend(rows if counts else [])
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        return {r.start.replace(tzinfo=None): r for r in drift.ended_windows(drift.gram_drift(stream, "2 hours", "1 hour"), f"{tmp_path}/out").collect()}

    land("a", [0.1, 0.5, 1.9, 2.5, 0.7, 3.0, 3.5])
    run()
    land("b", [1.5, 2.2, 3.9, 4.5, 5.0, 5.5])  # the first is late and in time
    run()
    land("c", [30.0, 30.5])  # all windows but the last end
    run()
    land("d", [0.2, 5.1], counts=False)  # too late
    found = run()
    rows = spark.createDataFrame(kept, schema).withColumn("start", F.window("ts", "2 hours").start)
    starts = sorted({r.start for r in rows.collect()})[:-1]
    assert len(found) == len(starts) == 3
    for start in starts:
        part = rows.where(F.col("start") == F.lit(start)).select(F.monotonically_increasing_id().alias("rank"), F.lit("w").alias("word"), "x", "y")
        r = found[start.replace(tzinfo=None)]
        assert r.n == part.count() and r.pip == pytest.approx(measures.pip_loss(part)) and r.eigen_overlap == pytest.approx(measures.eigen_overlap(part))
