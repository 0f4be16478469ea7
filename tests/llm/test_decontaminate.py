import hashlib
import re

import numpy as np

from vecstead.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = {}
    windows = []
    for item, text in items:
        w = words(text)
        n = min(10, len(w))
        windows += [(item, w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)]
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit |= set(range(i, i + len(x)))
                    found.add(str(item))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def cases():
    rng = np.random.default_rng(2)
    vocabulary = ["the", "of", "Ää", "x1", "É", "q", "zz", "ñ"]
    items = [(i, " ".join(rng.choice(vocabulary, int(n)))) for i, n in enumerate([0, 1, 3, 9, 10, 11, 30, 30, 12])]
    items += [(10, items[6][1]), (2, items[7][1]), (11, None), (12, "?!")]
    docs = [None, "", "...", "THE-of", items[6][1].upper(), items[5][1] + "\n" + items[6][1][:60]]
    for _ in range(30):
        body = list(rng.choice([*vocabulary, "other", "none"], 80))
        body[20:20] = items[int(rng.integers(2, 9))][1].split()
        docs.append(" ".join(body))
    docs.append("filler " * 20_000 + items[8][1])
    return list(enumerate(docs)), items


def write(spark, folder, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {r.doc_id: tuple(r)[1:] for r in decontaminate.query(spark, str(folder)).collect()}


def test_query_equals_brute_force(spark, tmp_path):
    docs, items = cases()
    assert write(spark, tmp_path, docs, items) == brute(docs, items)


def test_shards_give_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 100)
    docs, items = cases()
    assert write(spark, tmp_path, docs, items) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, None, None)], "doc_id long, text string, spans int")
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.mark_contamination(docs, none).collect()
    assert [(r.n_words, r.spans, r["items"]) for r in got] == [(2, [], []), (2, [], []), (0, [], [])]
    assert decontaminate.mark_contamination(docs.limit(0), none).count() == 0


def test_removal(spark):
    docs = spark.createDataFrame([(1, "Keep, one two three! rest"), (2, "clean  text"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three"), (None, None)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.decontaminate(docs, items).collect()] == [(2, "clean  text"), (3, None)]
    spans = decontaminate.decontaminate(docs, items, remove="spans").collect()
    assert [tuple(r) for r in spans] == [(1, "Keep, ! rest"), (2, "clean  text"), (3, None)]
