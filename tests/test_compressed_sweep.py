import os

import numpy as np
import pytest

from vecstead.operators import compress
from vecstead.plans import catalog, sweep

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def levels(z, bits, bound):
    step = 2 * bound / (2**bits - 1)
    return np.floor((np.clip(z, -bound, bound) + bound) / step + 0.5) * step - bound


def test_sweep_sees_all_words_and_equals_numpy(spark):
    rows = catalog.embedding(spark, DATA).orderBy("rank").collect()
    z = np.array([r.vec for r in rows])
    old, new = z[:, :32], z[:, 32:]
    got = {(r.dim, r.bitrate): r for r in catalog.QUERIES["compressed_sweep"](spark, DATA).collect()}
    assert set(got) == {(8, 1), (8, 4), (32, 1), (32, 4)}
    for (dim, bits), r in got.items():
        u, _, vt = np.linalg.svd(new[:, :dim].T @ old[:, :dim])
        first = catalog.embedding(spark, DATA, 1, dim)
        bound = compress.best_bound(first, bits)
        x, y = levels(new[:, :dim] @ u @ vt, bits, bound), levels(old[:, :dim], bits, bound)
        assert np.isclose(r.pip, np.linalg.norm(x @ x.T - y @ y.T), rtol=1e-6)
        p, q = (np.linalg.svd(m, full_matrices=False)[0] for m in (x, y))
        assert np.isclose(r.eigen_overlap, np.linalg.norm(p.T @ q) ** 2 / dim)
        up = down = 0.0
        for anchor in (new, old):
            v, s, _ = np.linalg.svd(anchor, full_matrices=False)
            a, b = (p.T @ v) * s**3, (q.T @ v) * s**3
            up, down = up + np.sum(a * a) + np.sum(b * b) - 2 * np.sum(b * ((q.T @ p) @ a)), down + np.sum(s**6)
        assert np.isclose(r.eis, up / down)
        assert 0 <= r.knn <= 1 and r.space == dim * bits


def test_sweep_with_tasks_has_the_whole_table(spark):
    emb = [catalog._named_by_words(spark, DATA, k) for k in (1, 33)]
    lines = catalog._sentences(spark, DATA)
    seen = []
    row = sweep.compressed_sweep(*emb, [8], [4], n=-1, nquery=20, tasks={"t": (lines, lines)}, keep=seen.append).first()
    assert 0 <= row.t <= 100 and 0 <= row.t_quality <= 100 and seen[0]["t"] == row.t
