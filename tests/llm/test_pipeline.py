"""The stages of the pipeline, each against a brute-force version of its decisions, and odd rows through all of them."""

import zlib

import numpy as np
import pytest

import corpus_pipeline
from vecstead.llm.language_id import UNKNOWN, identify_language, learn_languages
from vecstead.llm.quality import learn_quality, score_quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __text string, score double"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "__text", "score"]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(7)
    stems = {lang: [f"{a}{b}{c}" for a in letters for b in "aeio" for c in ends] for lang, letters, ends in (("en", "bdfgh", ("t", "nd", "s", "ing")), ("es", "lmrpv", ("o", "ar", "es", "ado")))}
    text = lambda lang: " ".join(rng.choice(stems[lang], 80))
    rows, labels = [], []
    for i in range(160):
        lang = ("en", "es")[i % 2]
        body = text(lang) if i % 4 else " ".join(w for w in rng.choice(stems[lang], 5) for _ in range(16))
        rows.append((i, body, lang, "s", len(body), "x", 0.5))
        labels.append((i, int(i % 4 > 0), 0))
    bodies = {i: r[1] for i, r in enumerate(rows)}
    item = " ".join(bodies[1].split()[10:30])
    extra = {
        200: bodies[5] + " " + "end", 201: bodies[5], 202: bodies[7].upper(),  # copies
        203: text("en")[:200] + " " + item + " " + text("en")[:200],  # a benchmark passage
        204: "123 456 --", 205: "", 206: None, 207: text("es") + " " + text("es"), 208: bodies[9] + " " + text("es"), 210: (text("en") + " ") * 300,
    }
    rows += [(i, t, None, "s", len(t or ""), None, None) for i, t in extra.items()]
    rows += [(None, text("en"), "en", "s", 1, "x", 0.5), rows[3]]
    place = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def staged(spark, folder, upto):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:upto]:
        docs = corpus_pipeline.written(stage(spark, docs, folder))
    return docs


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def test_stages_decide_as_brute_force(spark, folder):
    docs = [staged(spark, folder, k) for k in range(5)]
    kept = [sorted((tuple(r) for r in d.collect()), key=str) for d in docs]
    assert all(d.columns == COLUMNS for d in docs)
    # quality: what the operator scores under its threshold goes
    model = learn_quality(docs[0], spark.read.parquet(f"{folder}/labels.parquet").where("crc32(cast(doc_id as string)) % 5 <> 0"))
    scored = {(r.doc_id, r.text) for r in score_quality(docs[0].drop("score"), model).where("score >= 0.3").collect()}
    assert kept[1] == [r for r in kept[0] if r[:2] in scored]
    assert len(kept[0]) - len(kept[1]) >= 20  # most of the repeated words
    assert all(r in kept[1] for r in kept[0] if r[0] is not None and r[0] < 160 and r[0] % 4)  # clean ones stay
    # language: no letter, or like no language
    learned = learn_languages(docs[1].where("crc32(coalesce(cast(doc_id as string), '')) % 5 <> 0"))
    judged = {(r.doc_id, r.text): r for r in identify_language(docs[1].drop("score"), learned).collect()}
    fits = lambda r: judged[r[:2]].lang_pred != UNKNOWN and (judged[r[:2]].score >= corpus_pipeline.LEAST_COSINE or len(r[1]) < corpus_pipeline.LEAST_CHARACTERS)
    assert kept[2] == [r for r in kept[1] if fits(r)] and not {204, 205, 206} & {r[0] for r in kept[2]}
    # near copies: the least id of each group of the links' graph
    rows = sorted(kept[2], key=lambda r: (r[0] is None, r[0] or 0))
    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert kept[3] == sorted({r for i, r in enumerate(rows) if root[i] == i}, key=str)
    assert not {200, 201, 202} & {r[0] for r in kept[3]}
    # benchmark: no document with a window of ten words of an item
    items = [" ".join(r.text.split()[i : i + 10]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text for i in range(len(r.text.split()) - 9)]
    assert kept[4] == [r for r in kept[3] if not any(f" {x} " in f" {' '.join(r[1].lower().split())} " for x in items)]
    assert not {1, 203} & {r[0] for r in kept[4]}
    # packing: every id of every document that is left, once
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in kept[4]}
    total = {r.doc_id: r.doc_tokens for r in pieces}
    assert sum(r.length for r in pieces) == sum(total.values())


def test_empty_tables_pass_through(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    spark.read.parquet(f"{folder}/documents.parquet").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    nothing_learned = staged(spark, str(tmp_path), 1)
    assert nothing_learned.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_stages_are_named_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_copies", "benchmark", "packing"]
