from __future__ import annotations

import hashlib
import random
import re

import pytest

from glyphweave.llm.pii import KINDS, find_private

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]


def plain(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(BASE[k], text or "") if valid(k, m.group())]


def compare(spark, texts):
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, spans string, base string")
    got = {r.doc_id: r for r in find_private(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want = plain(t)
        assert got[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, got[k].spans)
        assert [got[k][f"n_{n}"] for n in KINDS] == [sum(w.startswith(n) for w in want) for n in KINDS]
        assert set(want) <= set(got[k].spans.split(",")) | {""}
    return got


CASES = [
    None, "", "a@b.c", "a@b.c_d@e.f x@y@z.w .@-.- a@b", "é a@b.co 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.002.003.0004 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112",
    "+1 (743) 555-3824 +49 30 123 +12345678 +1-----2 +1 (", "x4111111111111111y 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1 2 3 4 5 6 7 8@a.b 9.9.9.9", "😀 a@b.c 😀😀 10.0.0.1", "\n10.0.0.1\n10.0.0.1", "1" * 500 + "." + "2" * 400 + ".3.4",
]


def test_base_spans(spark):
    compare(spark, CASES)


def test_base_spans_of_any_text(spark):
    rng = random.Random(11)
    compare(spark, ["".join(rng.choice("a1209.@+-_() é\n%") for _ in range(rng.randrange(90))) for _ in range(1500)])


def test_long_texts(spark):
    compare(spark, ["1" * 3000, "a" * 3000 + "@", "@a.b" * 600, " ".join(f"10.0.{k % 256}.{k % 200} u{k}@x.org" for k in range(1500)), "a@" + "b." * 3000 + "c", "+" + "1 " * 3000])


def test_very_long_texts_take_linear_time(spark):
    """The plain patterns would take hours on these; what they hold is known."""
    texts = ["1" * 400_000, "a" * 400_000 + "@", "+" + "1 " * 200_000, "a@" + "b." * 200_000 + "c", "10.0.0.1 " * 30_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone) for r in find_private(docs).collect()}
    assert got == {0: (0, 0, 0, 0), 1: (0, 0, 0, 0), 2: (0, 0, 0, 0), 3: (1, 0, 0, 0), 4: (0, 30_000, 0, 0)}


def letter(words, value):
    return f"Some words go here. {words} {value} and then it ends."


@pytest.fixture(scope="module")
def mail(spark):
    texts = [letter("reach me at", f"+1 555 {200 + k} {1000 + k}") for k in range(12)]
    texts += [letter("log entry from", f"10.1.2.{k}") for k in range(12)]
    texts += [letter("of the", v) for k in range(8) for v in (f"10.9.9.{k}", f"user{k}@mail.org", f"+44 20 7946 {1000 + k}")]
    texts += [letter("reach me at", "555-0199"), letter("reach me at", "room 12"), letter("of the", "555-0123"), letter("log entry from", "fe80::1:2:3"), "555-0177 stands alone", letter("see also", "555-0199")]
    return compare(spark, texts), texts


def spans_of(result, texts, k):
    return [texts[k][int(a) : int(b)] for _, a, b in (x.split(":") for x in result[k].spans.split(",") if x)]


def test_patterns_discover_unseen_identifiers(mail):
    result, texts = mail
    n = len(texts)
    assert result[n - 6].n_found == 1 and spans_of(result, texts, n - 6) == ["555-0199"] and result[n - 6].spans.startswith("phone:")
    assert result[n - 3].n_found == 1 and spans_of(result, texts, n - 3) == ["fe80::1:2:3"] and result[n - 3].spans.startswith("ip:")


def test_mixed_or_unsupported_contexts_discover_nothing(mail):
    result, texts = mail
    n = len(texts)
    assert [result[k].n_found for k in (n - 5, n - 4, n - 2)] == [0, 0, 0]
    assert all(result[k].n_found == 0 for k in range(n - 6))


def test_rows_of_any_id(spark):
    docs = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "10.0.0.1"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.spans) for r in find_private(docs).collect())
    assert got == [(0, "ip:0:8"), (1, "email:0:5"), (1, "email:0:5"), (2, "")]
    assert find_private(docs.filter("false")).count() == 0


def test_secrets_are_seeded_and_discovered(spark):
    rng = random.Random(3)
    token = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    texts = [f"{'lorem ipsum ' * (k % 4)}token = \"{token()}\" dolor{k}." for k in range(9)]
    texts += ['amet token = "sk-live-4eC39HqLyjWDarjtT1zdp7dc" and so on', 'amet token = "none" and so', 'commit 12 "sk-live-4eC39HqLyjWDarjtT1zdp7dd" here', f"checksum {token()} alone"]
    result = compare(spark, texts)
    assert all(result[k].n_secret == 1 and len(spans_of(result, texts, k)[0]) == 40 for k in range(9))
    assert spans_of(result, texts, 9) == ["sk-live-4eC39HqLyjWDarjtT1zdp7dc"]
    assert [result[k].n_found for k in (10, 11, 12)] == [0, 0, 0]


def test_identifiers_in_a_row_of_numbers_and_after_long_words(spark):
    """A word of a long run is a candidate of its own, and a word of any length is a context."""
    texts = [f"row {k} of id{k} entry 10.4.{k}.7 end" for k in range(9)]
    texts += ["entry 2001:db8::7 77 88 99 11 22 33 44 55 end", f"{'x' * 300} 10.5.0.1", *(f"{'x' * 300} 10.5.0.{k}" for k in range(2, 9)), f"{'x' * 300} fe80::3:4"]
    result = compare(spark, texts)
    assert spans_of(result, texts, 9) == ["2001:db8::7"] and spans_of(result, texts, len(texts) - 1) == ["fe80::3:4"]


def test_rounds_go_on_until_nothing_changes(spark):
    """Each value believed makes the next pattern trusted: a chain longer than a fixed number of rounds would reach."""
    texts = [f"w0 10.0.{k}.1" for k in range(12)]
    for step in range(6):
        values = [f"fe80::{step}:{k}" for k in range(8)]
        texts += [f"w{step} {v}" for v in values for _ in range(2)] + [f"w{step + 1} {v}" for v in values]
    result = compare(spark, texts)
    assert all(r.n_found == 1 for k, r in result.items() if k >= 12)


def test_a_pattern_and_a_value_that_most_rows_share(spark, monkeypatch):
    monkeypatch.setattr("glyphweave.llm.common.HOT_SHARE", 1_000_000)
    texts = [f"call +1 555 300 {1000 + k}" for k in range(3000)] + ["call 555-0199"] * 1200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = find_private(docs)
    assert found.filter("n_found = 1 AND n_phone = 0").count() == 1200 and found.filter("n_phone = 1 AND n_found = 0").count() == 3000
