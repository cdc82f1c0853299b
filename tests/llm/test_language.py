from __future__ import annotations

import random
import zlib

from glyphweave.llm.language import Classifier, fit, identify, keep_told, learn

WORDS = {"en": "the and of with that from this house water street".split(), "de": "der und mit das von diese haus wasser strasse nicht".split(), "fr": "le et avec que dans cette maison eau rue pas".split()}
SCHEMA = "doc_id long, text string, lang string, score double, held_out int"


def texts(n, seed):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(15, 80))), lang, 0.1, 1) for k in range(n) for lang in [rng.choice(sorted(WORDS))]]


def test_held_out_accuracy(spark):
    rows = texts(900, 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    content = learn(docs)
    assert sorted(content) == ["de", "en", "fr"]
    lang = {r[0]: r[2] for r in rows}
    got = identify(docs, content).collect()
    assert len(got) == 900
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


def test_prediction_ignores_labels_and_ids(spark):
    rows = texts(200, 2)
    docs = spark.createDataFrame(rows, SCHEMA)
    content = learn(docs)
    one = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs, content).collect()}
    other = spark.createDataFrame([(i + 10_000, t, "xx", 9.0, 0) for i, t, *_ in rows], SCHEMA)
    assert {r.doc_id - 10_000: (r.lang_pred, r.score) for r in identify(other, content).collect()} == one


def test_nulls_and_texts_without_letters(spark):
    content = learn(spark.createDataFrame([*texts(200, 3), (900, None, "en", 0.0, 0), (901, "x", None, 0.0, 0)], SCHEMA))
    rows = [(1, None), (2, ""), (3, "12 34 -- !"), (None, "the and of with that from this house"), (4, "der und mit das " * 50_000), (4, "der und mit das " * 50_000)]
    got = identify(spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA), content).collect()
    assert sorted((r.doc_id or 0, r.lang_pred, r.accepted) for r in got) == [(0, "en", True), (1, "und", False), (2, "und", False), (3, "und", False), (4, "de", True), (4, "de", True)]
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_nothing_learned_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert learn(empty) == {}
    assert Classifier({})("some words") == ("und", 0.0, False)
    assert identify(empty, {}).count() == 0


def test_kept_rows_have_all_columns(spark):
    docs = spark.createDataFrame([*texts(60, 4), (70, "123", "en", 0.0, 1), (71, None, "en", 0.0, 1)], SCHEMA)
    kept = keep_told(docs, learn(docs))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(60))


def test_as_many_languages_as_the_bound_allows(spark):
    """The labels with most distinct texts are learned."""
    rows = [(k, f"word{k} " * 9, f"l{k % 9 if k % 9 < 3 else k % 30}", 0.1, 1) for k in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert len(fit(docs)) > 3 and sorted(fit(docs, languages=3)) == ["l0", "l1", "l2"]
