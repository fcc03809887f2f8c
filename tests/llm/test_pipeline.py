"""The pipeline's stages on small tables, each against plain code."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as pipeline
from foliant.llm import decontaminate, exact, quality, simhash
from tests_llm_helpers import alnum, plain_fingerprint_classes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    good = lambda seed, n=60: " ".join(f"word{(seed * 7919 + k * k) % 997}" for k in range(n)).capitalize() + "."
    docs = [(k, good(k), "en", "s", 1) for k in range(40)] + [(100 + k, good(k), "en", "s", 1) for k in range(5)]
    docs += [(200 + k, "*** ".join(good(k).upper().split()) + "!!", "en", "s", 1) for k in range(60)] + [(300, None, "en", "s", 0), (301, good(3) + " x", "en", "s", 1)]
    docs += [(1000 + k, good(1000 + k, 40 + k % 30), "en", "s", 1) for k in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, good(7)), (1, "no such thing")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(k, 1, 0) for k in range(30)] + [(1000 + k, 1, 0) for k in range(150)] + [(200 + k, 0, 0) for k in range(35)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    stage = dict(pipeline.STAGES)
    good = stage["quality"](spark, docs, folder)
    assert good.columns == docs.columns
    model = quality.fit_quality(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = {d for d, t in rows.items() if model.score(quality.features(t)[None])[0] >= quality.THRESHOLD}
    assert {r["doc_id"] for r in good.collect()} == kept and set(range(40)) <= kept
    exact = {r["doc_id"] for r in stage["exact_dedup"](spark, docs, folder).collect()}
    last = {}
    for d, t in sorted(rows.items()):
        last[t or ""] = d
    assert exact == set(last.values())
    near = {r["doc_id"] for r in stage["near_dedup"](spark, docs, folder).collect()}
    assert near == set(plain_fingerprint_classes({d: simhash.fingerprint(t) for d, t in rows.items()}).values())
    clean = {r["doc_id"] for r in stage["decontamination"](spark, docs, folder).collect()}
    item = alnum(rows[7])
    assert clean == {d for d, t in rows.items() if not any(alnum(t)[k : k + 13] == item[j : j + 13] for k in range(len(alnum(t)) - 12) for j in range(len(item) - 12))}


def test_run(spark, folder):
    out = pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in out}
    assert 7 not in ids and 107 not in ids and not ids & set(range(200, 260))
    assert all(r["offset"] + r["length"] <= 4096 for r in out)
    # Every token of every document left is there once, as the tokenizer itself gives it.
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    tokens = {d: [*whole.encode(text[d] or "", add_special_tokens=False).ids, 1] for d in ids}
    pieces = {d: sorted((r["start"], r["length"], r["ids_crc32"]) for r in out if r["doc_id"] == d) for d in ids}
    for d, given in tokens.items():
        assert pieces[d] == [(k, len(given[k : k + 4096]), zlib.crc32(np.array(given[k : k + 4096], "<u4").tobytes())) for k in range(0, len(given), 4096)]


def test_decided_by_row(spark):
    """Clean rows stay beside bad ones of the same id, null ids too."""
    say = lambda seed: " ".join(f"word{(seed * 7919 + k * k) % 997}" for k in range(60))
    rows = [(1, say(1)), (None, say(1)), (None, say(2)), (None, say(3)), (None, say(3)), (5, say(1)), (5, say(4)), (9, say(5)), (None, None), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    key = lambda x: (x[0] or 0, x[1] or "")
    left = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=key)
    without = lambda *gone: sorted((r for r in rows if r not in gone), key=key)
    each_once = without((1, say(1)), (None, say(1)), (None, None))
    each_once.remove((None, say(3)))
    assert left(exact.drop_exact_duplicates(docs)) == each_once
    each_near = [(1, say(1)), (None, say(2)), (None, say(3)), (5, say(4)), (9, say(5)), (9, None)]
    assert left(simhash.drop_near_duplicates(docs)) == sorted(each_near, key=key)
    items = spark.createDataFrame([(1, say(1)), (2, say(3))], "item_id long, text string")
    for limit in (decontaminate.BROADCAST_CHARS, 0):
        assert left(decontaminate.drop_contaminated(docs, items, broadcast_chars=limit)) == without((1, say(1)), (5, say(1)), (None, say(1)), (None, say(3)))


def test_quality_by_row(spark, folder):
    """A column score is the rows' own; a bad text goes though a good one has its id."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("IF(doc_id = 210, 5, IF(doc_id IN (6, 211), NULL, doc_id)) AS doc_id", "text", "0.1D AS score")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    rows = [(r["doc_id"], r["text"], r["score"]) for r in docs.collect()]
    want = [r for r in rows if model.score(quality.features(r[1])[None])[0] >= quality.THRESHOLD]
    got = [tuple(r) for r in quality.keep_quality(docs, labels).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len({r[1] for r in rows if r[0] in (None, 5)} - {r[1] for r in got}) == 2


def test_no_documents(spark, folder, tmp_path):
    """Every stage answers an empty table by an empty one of its columns."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        got = stage(spark, docs, folder)
        assert got.count() == 0 and (name == "packing" or got.columns == docs.columns)
