"""Codes of vectors against plain Python."""

from __future__ import annotations

import hashlib
import math
import random

from pyspark.sql import types as T

from vecstead.llm.vector_codes import vector_codes

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("Code", T.StringType()), T.StructField("vec", T.StringType())])


def slow(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    width = len(first[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def assign(v):
        out = []
        for p in range(parts):
            apart = [sum((a - b) ** 2 for a, b in zip(cut(v, p), entry)) for entry in books[p]]
            out.append((apart.index(min(apart)), min(apart)))
        return out

    for _ in range(rounds):
        chosen = [(v, assign(v)) for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                on = [cut(v, p) for v, a in chosen if a[p][0] == e]
                if on:
                    books[p][e] = [sum(x) // len(on) for x in zip(*on)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    out = [(i, "".join(f"{e:02x}" for e, _ in assign(v)), sum(d for _, d in assign(v)), label) for i, v, label in kept]
    totals = {}
    for _, _, error, label in out:
        totals[label] = totals.get(label, 0) + error
    return sorted([(i, code, error, totals[label], digest) for i, code, error, label in out], key=str)


def found(spark, rows):
    out = vector_codes(spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows], SCHEMA).repartition(3))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted([tuple(r) for r in out.collect()], key=str)


def single(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def rows_of(n, seed, width=16):
    draw = random.Random(seed)
    return [(i * 3, [single(draw.gauss(0, 0.3)) for _ in range(width)], draw.choice([None, 1, 2, 2, 2])) for i in range(n)]


def test_equals_plain_python_with_odd_rows(spark):
    rows = rows_of(60, 1)
    rows += rows[:5]  # repeated rows
    rows += [(1, None, 1), (2, [0.1, None] + [0.0] * 14, 1), (4, [math.nan] + [0.0] * 15, 1), (5, [math.inf] + [0.0] * 15, None), (7, [], 2), (None, [0.25] * 16, None), (8, [0.25] * 16, 1), (10, [0.25] * 16, 1)]
    assert found(spark, rows) == slow(rows)


def test_fewer_rows_than_entries_ties_and_empty_tables(spark):
    rows = [(i, [float(i % 2)] * 8, 1) for i in range(5)]
    assert found(spark, rows) == slow(rows)
    assert found(spark, []) == [] and found(spark, [(1, None, 1), (2, [math.nan] * 8, 1)]) == []
    assert vector_codes(spark.createDataFrame([], SCHEMA)).dtypes == [("vec_id", "bigint"), ("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")]


def test_other_lengths_are_dropped(spark):
    rows = rows_of(20, 2)
    assert found(spark, [*rows, (500, [1.0] * 8, 1), (501, [1.0] * 24, 1)]) == slow(rows)
