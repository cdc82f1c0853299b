from __future__ import annotations

import random
import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from glyphweave.llm.common import shared_dir
from glyphweave.llm.fingerprint import fingerprints
from glyphweave.llm.language import Classifier, learn

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EN = "the and of with that from this house water street people every morning under bridge"
DE = "der und mit das von diese haus wasser strasse nicht leute jeden morgen unter bruecke"


def corpus():
    rng = random.Random(3)
    rows = []
    for k in range(120):
        lang, words = (("en", EN), ("de", DE))[k % 2]
        rows.append((k, " ".join(rng.choice(words.split()) + rng.choice(["", "", "s", "en"]) for _ in range(60)), lang))
    base = rows[0][1]
    rows += [(200, base, "en"), (201, base, "en"), (202, base + " tail", "en"), (203, "12345 !!", "en"), (204, None, "en"), (205, "", "de"), (206, "the house with mail a.b@c.org and 10.0.0.1 of the water " + EN, "en"), (None, rows[1][1], "de")]
    return rows


def test_stages(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA)
    out = {}
    now = docs
    for name, step in cp.STAGES:
        now = step(spark, now, "")
        now.write.parquet(path := f"{shared_dir(spark)}/t-{name}-{id(rows)}")
        now = spark.read.parquet(path)
        out[name] = now
        if name != "packing":
            assert now.columns == docs.columns
    told = {r.doc_id for r in out["language"].collect()}
    assert not {203, 204, 205} & told and {k for k in range(120)} <= told and None in told
    exact = [r.doc_id for r in out["exact"].collect()]
    assert 201 in exact and 0 not in exact and 200 not in exact and 1 in exact and None not in exact
    near = {r.doc_id for r in out["near"].collect()}
    assert len({201, 202} & near) >= 1 and near <= set(exact)
    text = {r.doc_id: r.text for r in out["private"].collect()}
    assert set(text) == near and "[email] and [ip] of" in text[206]
    assert all(t == dict((i, t) for i, t, _ in rows)[i] for i, t in text.items() if i not in (206,))
    pieces = out["packing"].collect()
    assert {p.doc_id for p in pieces} == near


def test_redaction_of_overlapping_spans(spark):
    text = "é 0123456789 abc"
    df = spark.createDataFrame([(text, "email:2:6,ip:4:8,phone:13:16"), (text, "card:0:16")], "text string, _spans string")
    assert [r[0] for r in df.select(cp._redacted("_spans")).collect()] == ["é [email]6789 [phone]", "[card]"]


def test_run_is_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(re.match(rf"op{n}_", x) for x in names) for n in range(1, 11))
    assert set(entry.oracle_sql()) <= names


def plain_run(rows, content):
    """What run() must leave, row by row: (doc_id, text). rows: doc_id, text."""
    judge = Classifier(content)
    rows = [(i, t) for i, t in rows if judge(t)[2]]
    best = {}
    for k, (i, t) in enumerate(rows):
        rank = (i is not None, i or 0, -k)
        if t not in best or rank > best[t][0]:
            best[t] = (rank, k)
    rows = [rows[k] for k in sorted(k for _, k in best.values())]
    prints = [int(x) for x in fingerprints([t for _, t in rows])]
    group = list(range(len(rows)))

    def root(k):
        while group[k] != k:
            k = group[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                group[root(a)] = root(b)
    kept = {}
    for k, (i, _) in enumerate(rows):
        rank = (i is None, i or 0, k)
        if root(k) not in kept or rank < kept[root(k)][0]:
            kept[root(k)] = (rank, k)
    rows = [rows[k] for _, k in kept.values()]
    clean = lambda t: re.sub(r"[a-z]+@[a-z]+[.]org", "[email]", re.sub(r"10[.]0[.]0[.]\d+", "[ip]", t))
    return [(i, clean(t)) for i, t in rows]


def plain_pieces(rows):
    """Of every document its id, number of tokens and the checksum of all of them."""
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    out = []
    for i, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        out.append((-1 if i is None else i, len(ids), ids))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_run_against_a_plain_version(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(i, t, lang) for i, t, lang in corpus() if i != 206]
    for k in range(20):
        i, t, lang = rng.choice(rows[:120])
        rows.append((300 + k, t + rng.choice(["", " ", " tail", " bob@mail.org here", f" 10.0.0.{k} there"]), lang))
    rows += [(400, ("the house of water " * 9 + "and the bridge ") * 300, "en"), (None, rows[2][1], "en"), (5, rows[5][1], "de")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, 2) for i, t, lang in rows], SCHEMA + ", _row int, _spans int").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    content = learn(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    read = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    left = plain_run(read, content)
    got = cp.run(spark, str(tmp_path)).collect()
    by_doc = {}
    for p in sorted(got, key=lambda p: p.start):
        by_doc.setdefault(-1 if p.doc_id is None else p.doc_id, []).append(p)
    want = plain_pieces(left)
    assert sorted(by_doc) == sorted(i for i, _, _ in want)
    for i, n, ids in want:
        pieces = by_doc[i]
        assert {p.doc_tokens for p in pieces} == {n} and sum(p.length for p in pieces) == n
        assert all(p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[p.start : p.start + p.length])) for p in pieces)
    assert any("[email]" in t for _, t in left) or any("[ip]" in t for _, t in left)


def test_run_on_an_empty_table_leaves_nothing_but_its_result(spark, tmp_path):
    from pathlib import Path

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    root = Path(shared_dir(spark)) / "glyphweave"
    before = set(root.iterdir()) if root.exists() else set()
    assert cp.run(spark, str(tmp_path)).count() == 0
    assert [p.name.split("-")[:2] for p in set(root.iterdir()) - before] == [["pipeline", "packing"]]


def test_two_pipelines_side_by_side(spark, tmp_path):
    """Stages of two pipelines take turns; neither removes what the other still reads."""
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in corpus()], SCHEMA)
    one, two = (cp.exact(spark, docs, f"{tmp_path}/{k}") for k in (1, 2))
    assert one.count() == two.count() > 0


def test_workers_take_few_rows_in_hand():
    import pyarrow as pa

    from glyphweave.llm import common, language

    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array([f"text {k}" for k in range(600)])], ["doc_id", "text"])
    assert [b.num_rows for b in common.few(iter([batch, batch.slice(0, 3)]))] == [256, 256, 88, 3]
    content = {"a": b"text one two three " * 20, "b": b"ganz andere worte " * 20}
    made = list(language._classify(content)(iter([pa.RecordBatch.from_arrays([batch.column(0), pa.array([True] * 600), batch.column(1)], ["doc_id", "held_out", "text"])])))
    assert [b.num_rows for b in made] == [256, 256, 88]
    assert pa.Table.from_batches(made)["doc_id"].to_pylist() == list(range(600))
