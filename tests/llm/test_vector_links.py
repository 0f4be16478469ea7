"""Links of vectors against brute force."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import types as T

from vecstead.llm import vector_links
from vecstead.llm.vector_links import CODES, Codes, embedding_links, tier

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("id", T.StringType()), T.StructField("n_links", T.StringType())])


def slow(rows, cosine=0.9):
    use = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], dtype=float) / np.max(np.abs(rows[i][1])) for i in use}
    unit = {i: z / np.linalg.norm(z) for i, z in unit.items()}
    links = {i: {j for j in use if j != i and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine} if i in unit else set() for i in range(len(rows))}
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        names = [rows[j][0] for j in seen if rows[j][0] is not None]
        component = min(names) if names else None
        out.append((rows[i][0], len(links[i]), component, component is not None and component == rows[i][0]))
    return sorted(out, key=str)


def found(spark, rows):
    out = embedding_links(spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA).repartition(3))
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted([tuple(r) for r in out.collect()], key=str)


def clustered(n, d, seed, spread=0.25):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(max(2, n // 12), d))
    return [(int(i), (centres[draw.integers(len(centres))] * draw.choice([1, 1, 5]) + spread * draw.normal(size=d) * draw.choice([0.2, 0.6, 1])).tolist()) for i in draw.permutation(n)]


def test_equals_brute_force_with_odd_rows(spark):
    rows = clustered(300, 64, 1)
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), rows[5], (None, rows[7][1]), (None, [1.0] + [0.0] * 63)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [math.nan] + [1.0] * 63), (2004, [None] + [1.0] * 63), (2005, [math.inf] + [1.0] * 63), (2006, [1.0] * 32), (2007, [1.0] * 32), (2008, [1e-200] * 64), (2009, [1e200] * 64)]
    assert found(spark, rows) == slow(rows)


def test_narrow_vectors_and_hot_filters(spark, monkeypatch):
    rows = clustered(200, 5, 2) + clustered(60, 1, 3)
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    expected = slow(rows)
    assert found(spark, rows) == expected
    monkeypatch.setattr(vector_links, "MAX_GROUP", 8)  # nearly every filter is cut in chunks
    assert found(spark, rows) == expected
    monkeypatch.setattr(vector_links, "SMALL", 2)
    monkeypatch.setattr(vector_links, "AT_ONCE", 40)
    assert found(spark, rows) == expected


def test_empty_tables(spark):
    assert found(spark, []) == [] and found(spark, [(3, None)]) == [(3, 0, 3, True)]


def test_list_decoding_finds_every_filter():
    draw = np.random.default_rng(4)
    z = draw.normal(size=(40, 64))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    codes = Codes(64, 16, 2.2, codes=3)
    rows, filters = codes.filters(z)
    expected = set()
    for code in range(3):
        y = codes.rotated(z, code)
        scores = (y[:, :32] @ codes.books[0].T)[:, :, None] + (y[:, 32:] @ codes.books[1].T)[:, None, :]
        expected |= {(int(i), (code * 16 + int(a)) * 16 + int(b)) for i, a, b in zip(*np.nonzero(scores >= 2.2))}
    assert set(zip(rows.tolist(), filters.tolist())) == expected and len(rows) == len(expected)


def test_pairs_at_the_threshold_share_a_filter():
    draw = np.random.default_rng(5)
    for rows, d in ((4_000, 64), (100_000, 64), (100_000, 200), (100_000, 3)):
        x = draw.normal(size=(600, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        apart = draw.normal(size=(600, d))
        apart -= np.sum(apart * x, axis=1, keepdims=True) * x
        y = 0.9 * x + math.sqrt(1 - 0.81) * apart / np.linalg.norm(apart, axis=1, keepdims=True)
        codes = Codes(d, *tier(rows))
        assert codes.codes == CODES
        (i, f), (j, g) = codes.filters(x), codes.filters(y)
        both = set(zip(i.tolist(), f.tolist())) & set(zip(j.tolist(), g.tolist()))
        assert len({i for i, _ in both}) >= 594
