import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from vecstead.llm import common, components, language_id, near_copies, packing


def corpus(seed, bases=60):
    """Texts with copies that have a few words changed, lines that many texts share, and odd rows."""
    rng = np.random.default_rng(seed)
    draw = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    line, texts = draw(14), []
    for _ in range(bases):
        base = draw(int(rng.integers(30, 300))) + (line if rng.random() < 0.5 else [])
        texts.append(base)
        for _ in range(6):
            copy = list(base if rng.random() < 0.7 else texts[-1])
            for k in rng.integers(0, len(copy), int(rng.integers(1, 2 + len(copy) // 25))):
                copy[k] = f"n{rng.integers(0, 10**6)}"
            texts.append(copy)
    odd = [None, "", " ", "one two", "ONE  two", "a b c d e", "a b c d f"]
    return [(i, t) for i, t in enumerate([" ".join(x) for x in texts] + odd)]


def brute(rows, similarity=0.8):
    def shingles(text):
        found = (text or "").lower().split()
        return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))} if found else set()

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for i in range(len(rows)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if not union or len(sets[i] & sets[j]) / union >= similarity:
                links += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in range(len(rows)) if find(i) == i}, links


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("often", [5, 1 << 30])
def test_recall_is_whole(spark, monkeypatch, seed, often):
    monkeypatch.setattr(near_copies, "OFTEN", often)
    rows = corpus(seed)
    want, links = brute(rows)
    assert links > 200
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in near_copies.drop_near_copies(docs).collect()} == want


def test_pairs_at_the_threshold(spark):
    """Pairs whose similarity is 0.8 exactly, and just below: all of the first are found, none of the second."""
    rows = []
    for i in range(200):
        words = [f"t{i}x{k}" for k in range(40)]
        rows.append((3 * i, " ".join(words[:36])))  # 32 shingles
        rows.append((3 * i + 1, " ".join(words)))  # 36 shingles, 32 shared: 0.889
        rows.append((3 * i + 2, " ".join(words[9:])))  # 27 of 36: 0.75, and 23 of 36 of the other
    for i in range(200):
        words = [f"u{i}x{k}" for k in range(44)]
        rows += [(1000 + 2 * i, " ".join(words)), (1001 + 2 * i, " ".join(words[:36]))]  # 32 of 40: 0.8
    want, _ = brute(rows)
    got = {r.doc_id for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {rows[i][0] for i in want} and len(got) == 600


def test_columns_nulls_and_empty_table(spark):
    rows = [(None, "a b c", 1), (5, "a b c", 2), (5, "A b c", 3), (None, None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, Text string, row int").coalesce(1)
    assert sorted(near_copies.drop_near_copies(docs).collect(), key=str) == sorted([docs.collect()[1], docs.collect()[3]], key=str)
    empty = near_copies.drop_near_copies(docs.limit(0))
    assert empty.columns == docs.columns and empty.count() == 0


def test_hot_groups_and_parity(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MEMBERS", 5)
    monkeypatch.setattr(near_copies, "MOST_SENT", 3)  # joined by a shuffle
    monkeypatch.setattr(near_copies, "CROWDED", 0)  # trees meet by hubs first
    rows = corpus(3, bases=10)
    base = rows[0][1].split()
    for i in range(60):  # one large group
        rows.append((1000 + i, " ".join([*base, *[f"z{i}"] * (1 + i % 3)])))
    want, _ = brute(rows)
    assert {r.doc_id for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    rng = np.random.default_rng(0)
    for _ in range(50):
        x, y = (np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(2))
        y = np.unique(np.r_[x[: int(rng.integers(0, 300))], y[:40]])
        apart = sum(bin(int(a) & (2**64 - 1)).count("1") for a in near_copies.parity(x) ^ near_copies.parity(y))
        assert apart <= len(np.setxor1d(x, y))


def test_trie_join_links_first(spark):
    """Rows of close fingerprints are connected by the SimHash operator's join before any shingle is joined, as brute force connects them."""
    rng = np.random.default_rng(5)
    prints = []
    for _ in range(40):
        base = int(rng.integers(0, 2**63))
        prints += [base, base, base ^ 0b1011, base ^ (1 << 40), base ^ 0b11111]
    rows = [(i, x.to_bytes(8, "big")) for i, x in enumerate(prints)]
    pairs = near_copies.simhash_pairs(spark.createDataFrame(rows, "row long, print binary")).collect()
    assert all(r.a < r.b for r in pairs) and len({tuple(r) for r in pairs}) == len(pairs)

    def roots(links):
        root = list(range(len(rows)))
        for a, b in links:
            low, high = sorted((root[a], root[b]))
            root = [low if x == high else x for x in root]
        return root

    close = [(i, j) for i in range(len(rows)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= 4]
    assert roots((r.a, r.b) for r in pairs) == roots(close)


@pytest.mark.parametrize("changed", [0.1, 0.4])
def test_pairs_meet_about_once(spark, monkeypatch, changed):
    """Rows that share many shingles make a row of the last join each pair, not each shingle, and none is lost that shares enough."""
    rng = np.random.default_rng(7)
    sets = [np.unique(np.r_[np.flatnonzero(rng.random(80) > changed) if i % 4 else np.arange(100, 140)]) for i in range(60)]
    rows = [(int(t), i, 5 * len(s)) for i, s in enumerate(sets) for t in s]
    prefixes = spark.createDataFrame(rows, "token bigint, row bigint, size int")
    merged = near_copies._merged(prefixes).persist()
    assert sum(r.weight for r in merged.collect()) == len(rows)
    assert merged.where("token >= 100").select("token").distinct().count() == 1  # the same rows share them
    left = merged.withColumn("root", F.col("row") % 50)
    marks = spark.createDataFrame([(i, [0] * near_copies.PARITY) for i in range(60)], "row bigint, bits array<bigint>")
    pairs = near_copies._meeting(left, marks, 0.8)
    alike = {(i, j): len(np.intersect1d(sets[i], sets[j])) for j in range(60) for i in range(j) if i % 50 != j % 50 and min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j]))}
    assert {(r.a, r.b) for r in pairs.collect()} == {p for p, n in alike.items() if n}
    with monkeypatch.context() as m:
        m.setattr(DataFrame, "distinct", lambda x: x)
        made = near_copies._meeting(left, marks, 0.8).count()
    assert made <= 2.5 * pairs.count() and made < 0.1 * sum(alike.values())
    want = {(r.a, r.b) for r in pairs.collect() if alike[r.a, r.b] >= r.least}
    assert {tuple(r) for r in near_copies._sharing(pairs, left).collect()} == want


def test_a_dense_group_verifies_few_pairs(spark, monkeypatch):
    """Where rows of a group are similar to some others only, a few pairs of each row come first and those inside a tree then drop out; the result is brute force's."""
    rng, rows = np.random.default_rng(11), []
    for i in range(150):  # each loses 7 of 116 shingles, and two are similar if 2 of these are the same
        words, k = [f"b{k}" for k in range(120)], int(rng.integers(4, 114))
        words[k], words[k + 2] = f"x{i}", f"y{i}"
        rows.append((i, " ".join(words)))
    want, links = brute(rows)
    assert len(want) < 20 and 500 < links < 10_000
    met, verified = [], []
    meeting, sharing = near_copies._meeting, near_copies._sharing
    monkeypatch.setattr(near_copies, "ROUNDS", 0)
    monkeypatch.setattr(near_copies, "FIRST", 2)
    monkeypatch.setattr(near_copies, "CROWDED", 1)
    monkeypatch.setattr(near_copies, "_meeting", lambda *a: met.append((out := meeting(*a)).count()) or out)
    monkeypatch.setattr(near_copies, "_sharing", lambda pairs, left: verified.append(pairs.count()) or sharing(pairs, left))
    assert {r.doc_id for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert met[0] > 500 and len(verified) == 2 and sum(verified) < 0.6 * met[0], (met, verified)


def test_first_pairs_and_pairs_between_trees(spark):
    pairs = spark.createDataFrame([(a, b, 7) for b in range(30) for a in range(b)], "a long, b long, least int")
    few = [tuple(r) for r in near_copies._few(pairs).collect()]
    assert len(few) == len(set(few)) and all(a < b and least == 7 for a, b, least in few)
    assert all(1 <= sum(x[1] == b for x in few) <= near_copies.FIRST for b in range(1, 30))
    roots = spark.createDataFrame([(i, i % 3) for i in range(20)], "row long, root long")
    tree = lambda i: i % 3 if i < 20 else i
    got = {tuple(r) for r in near_copies._between(pairs, roots).collect()}
    assert got == {(a, b, 7) for b in range(30) for a in range(b) if tree(a) != tree(b)}


def test_a_worker_remembers_one_operator_only():
    """What the language and packing operators keep in a Python worker goes once the worker serves another operator."""
    first = language_id.profiles()
    assert language_id.profiles() is first
    encode = packing.encoder("byte_bpe_50k")
    assert packing.encoder("byte_bpe_50k") is encode and "tokenizer" not in vars(encode)
    assert list(common._remembered.values()) == [encode]

    class Edges:
        """Stands for a table and runs a task's function here."""

        schema = None

        def mapInArrow(self, run, schema):
            return [x for b in run(iter([pa.record_batch({"a": [2], "b": [1]})])) for x in b.to_pylist()]

    assert components._contracted(Edges(), 10) == [{"a": 2, "b": 1}]
    assert list(common._remembered.values()) == [None]
