import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vecstead.llm import simhash, trie
from vecstead.llm.components import connected_components, forest_roots

SCHEMA = "doc_id long, text string"


def brute_print(text, words=4):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, budget):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def some_texts():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "  \t\n", "one", "Two words", "ça et là\x0bÉ", "x y z w " * 3000]
    for _ in range(25):
        base = list(rng.choice(vocabulary, 400))
        texts.append(" ".join(base))
        for _ in range(3):
            changed = list(base)
            for at in rng.integers(0, 400, int(rng.integers(0, 4))):
                changed[at] = "new"
            texts.append(" ".join(changed))
    return texts + texts[:12]


def test_query_equals_brute_force(spark, tmp_path):
    rows = list(enumerate(some_texts()))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in simhash.query(spark, str(tmp_path)).collect()}
    prints = [brute_print(t) for _, t in rows]
    assert [got[i].fingerprint for i, _ in rows] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i, _ in rows] == brute_components(prints, 4)


def test_empty_repeated_and_null_rows(spark):
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d e", 9), (1, "a b c d e", 9), (None, "a b c d e", 9), (None, None, 9)]
    got = simhash.simhash_components(spark.createDataFrame(rows, f"{SCHEMA}, component_id int")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 1), (1, 1), (1, 1)]


@pytest.mark.parametrize("budget", [0, 4, 9])
def test_trie_pairs_equal_brute_force(budget):
    rng = np.random.default_rng(budget)
    prints = np.unique(rng.integers(0, 4, (300, 8)).astype(np.uint8), axis=0)
    bucket = rng.integers(0, 3, len(prints))
    got = {tuple(sorted(p)) for i, j in trie.trie_pairs(prints, bucket, budget, at_once=500) for p in zip(i.tolist(), j.tolist())}
    apart = np.unpackbits(prints[:, None] ^ prints[None], axis=2).sum(2)
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if bucket[i] == bucket[j] and apart[i, j] <= budget}
    assert got == want


@pytest.mark.parametrize("rows", [10, 10_000_000, 10_000_000_000])
def test_exhaustive_tables_miss_no_pair(rows):
    tables = simhash.exhaustive_tables(64, 4, rows)
    rng = np.random.default_rng(1)
    for _ in range(500):
        changed = set(rng.choice(64, 4, replace=False).tolist())
        assert any(not changed & set(p) for p in tables.positions)


def test_hot_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_BUCKET", 16)
    monkeypatch.setattr(simhash, "AT_ONCE", 40)
    rng = np.random.default_rng(5)
    base = np.zeros((200, 8), dtype=np.uint8)
    base[np.arange(200), rng.integers(5, 8, 200)] = rng.integers(0, 256, 200)
    base = np.unique(base, axis=0)
    prints = spark.createDataFrame([(bytearray(x.tobytes()),) for x in base], "print binary")
    roots = connected_components(simhash.fingerprint_links(prints, simhash.exhaustive_tables(64, 4, 200))).collect()
    want = brute_components([int.from_bytes(x.tobytes(), "big") for x in base], 4)
    assert len(roots) - len({bytes(r.root) for r in roots}) == len(want) - len(set(want))


def test_components_of_a_long_path(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in connected_components(edges).collect()} == {(i, 0) for i in range(201)}


@pytest.mark.parametrize("kind", ["long", "binary"])
@pytest.mark.parametrize("together", [7, 60, 10_000])
def test_components_in_tasks_and_by_stars(spark, kind, together):
    pairs = [(int(a), int(b)) for a, b in np.random.default_rng(together).integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(500, 560)]
    root = {x: x for p in pairs for x in p}
    while any(root[a] != root[b] for a, b in pairs):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(5)
    if kind == "binary":
        edges = edges.select(*[F.encode(F.lpad(F.col(c).cast("string"), 4, "0"), "utf-8").alias(c) for c in "ab"])
    got = [(int(r.node), int(r.root)) for r in connected_components(edges, together=together).collect()]
    # a node whose only edge is to itself has no row
    assert sorted(got) == sorted((x, y) for x, y in root.items() if any(x in p and p[0] != p[1] for p in pairs))
    assert connected_components(edges.limit(0), together=together).count() == 0


def test_few_edges_take_few_jobs(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    spark.sparkContext.setJobGroup("components", "")
    try:
        assert connected_components(edges).count() == 201
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("components")) < 8


def test_roots_of_a_forest(spark):
    rng = np.random.default_rng(3)
    parent = {b: int(rng.integers(0, b)) for b in range(1, 120) if b % 7} | {b: b - 1 for b in range(200, 260)}
    links = spark.createDataFrame(list((a, b) for b, a in parent.items()), "a long, b long")
    want = {}
    for node in {*parent, *parent.values()}:
        at = node
        while at in parent:
            at = parent[at]
        want[node] = at
    got = forest_roots(links).collect()
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert forest_roots(links.limit(0)).count() == 0
