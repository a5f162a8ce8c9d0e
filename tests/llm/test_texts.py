"""Consistent form, words, counts, distinctive terms."""

import math
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import codepoints as C
from quillon.llm.consistent_form import consistent_form
from quillon.llm.distinctive import distinctive_terms, log_factorial, log_upper_tail
from quillon.llm.tales import one_row_per_tale
from quillon.llm.term_counts import term_counts

WORD = r"[\p{L}\p{M}\p{Nd}‌‍]+"
ALPHABET = "aeZ 'оеВΑονñẹ́́̄­​‌‍⁠﻿  　ＡｂЖц，！ｋकष्ा़\n1½१📚ß"


def brute(s: str) -> str:
    out = []
    for i, ch in enumerate(s):
        if ord(ch) in C.INVISIBLE:
            if ord(ch) in C.JOINERS and 0 < i < len(s) - 1 and all(0x900 <= ord(x) < 0x980 for x in (s[i - 1], s[i + 1])):
                out.append(ch)
        elif ord(ch) in C.SPACES:
            out.append(" ")
        else:
            out.append(unicodedata.normalize("NFKC", ch) if unicodedata.decomposition(ch).startswith("<wide>") else ch)

    def latin(m):
        return "".join(C.LOOKALIKES.get(c, c) for c in m[0]) if regex.search(r"\p{Latin}", m[0]) else m[0]

    s = regex.sub(WORD, latin, "".join(out))
    return regex.sub(r"\p{L}\p{M}+", lambda m: unicodedata.normalize("NFC", m[0]), s)


texts = st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=30)), min_size=1, max_size=8)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_consistent_form_agrees_with_brute_force(rows):
    cps, off = C.decode(pa.array(rows, pa.string()))
    new, new_off, changed = C.consistent(cps, off)
    got = C.encode(new, new_off).to_pylist()
    assert got == [brute(r or "") for r in rows] and changed.tolist() == [brute(r or "") != (r or "") for r in rows]


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_agree_with_brute_force(rows):
    w = C.Words(pa.array(rows, pa.string()))
    got = list(zip(w.row.tolist(), w.strings(np.arange(len(w.hash))).to_pylist()))
    assert got == [(i, x) for i, r in enumerate(rows) for x in regex.findall(WORD, brute(r or "").lower())]
    assert len({h for h in w.hash.tolist()}) == len({x for _, x in got})
    grams, first = w.grams(2)
    assert len(grams) == sum(max(0, c - 1) for c in w.counts().tolist()) and len(first) == len(grams)


def test_round_trip():
    rows = ["", None, "a\n", "नमस्ते 👨‍👩‍👧", "é", "x" * 5000]
    cps, off = C.decode(pa.array(rows))
    assert C.encode(cps, off, np.array([r is None for r in rows])).to_pylist() == rows
    assert [b - a for a, b in C.chunks(pa.array(rows), limit=10)] == [3, 1, 1, 1] and list(C.chunks(pa.array([], pa.string()))) == []
    assert C.Words(pa.array([], pa.string())).counts().tolist() == []


def test_consistent_form_rows(spark):
    rows = [(1, "ｏne", None, "x"), (1, "ｏne", None, "x"), (2, "", "plain", "x"), (None, "lіon", "क्‍ष a‍b", "x")]
    df = spark.createDataFrame(rows, "doc_seq bigint, title string, raw_text string, text string")
    got = sorted(consistent_form(df, "doc_seq", ["title", "raw_text"]).collect(), key=str)
    assert len(got) == 8 and sum(r.changed for r in got) == 4
    changed = consistent_form(df, "doc_seq", ["title", "raw_text"], changed_only=True).collect()
    assert sorted((str(r.doc_seq), r.field, r.text) for r in changed) == [("1", "title", "one"), ("1", "title", "one"), ("None", "raw_text", "क्‍ष ab"), ("None", "title", "lion")]
    assert consistent_form(df.limit(0), "doc_seq", ["title"]).count() == 0


TALES = [("a", 1, "One", "lion lion lion tiger"), ("a", 5, "One", "lion lion lion tiger"), ("b", 2, "Two", "tiger Tiger bear"), ("c", 3, None, None), ("d", 4, "", " "), (None, 6, "x", "y"), ("e", None, "x", "y")]
SCHEMA = "tale_id string, doc_seq bigint, title string, raw_text string"


def test_one_row_per_tale(spark):
    df = spark.createDataFrame(TALES, SCHEMA)
    for most in (0, 100):
        assert sorted(r.tale_id for r in one_row_per_tale(df, "raw_text", broadcast_rows=most).collect()) == ["a", "b", "c", "d"]
    assert one_row_per_tale(df.limit(0), "raw_text").count() == 0


@pytest.mark.parametrize("share", [1e-4, 0.3, 2.0])
def test_term_counts(spark, share):
    df = one_row_per_tale(spark.createDataFrame(TALES, SCHEMA), "raw_text")
    got = {r.term: (r.occurrences, r.texts, r.mark) for r in term_counts(df, ["raw_text"], share, rare_below=2, common_above=0.5).collect()}
    assert got == {"lion": (3, 1, "rare"), "tiger": (3, 2, "common"), "bear": (1, 1, "rare")}
    assert term_counts(df.limit(0), ["raw_text"], share).count() == 0


def test_log_factorial_and_tail():
    m = np.array([0, 1, 5, 1000, 1023, 1024, 5000, 10**7])
    assert np.allclose(log_factorial(m), [math.lgamma(v + 1) for v in m.tolist()], rtol=1e-13)
    rng = np.random.default_rng(7)
    for _ in range(500):
        total = int(rng.integers(1, 500))
        cf, n = int(rng.integers(1, total + 1)), int(rng.integers(1, total + 1))
        k = int(rng.integers(1, min(cf, n) + 1))
        exact = sum(math.comb(cf, i) * math.comb(total - cf, n - i) for i in range(k, min(cf, n) + 1)) / math.comb(total, n)
        assert math.exp(log_upper_tail([k], [n], [cf], total)[0]) == pytest.approx(exact, rel=1e-9)
    assert log_upper_tail([40], [100_000], [50], 10**9)[0] < -300 and log_upper_tail([1], [10], [10**8], 10**9)[0] > -1


@pytest.mark.parametrize("share", [1e-4, 0.2, 2.0])
def test_distinctive_terms(spark, share):
    words = [["lion"] * 4 + ["the"] * 5, ["the"] * 9 + ["bear"], ["the", "lion", "tiger", "tiger", "tiger"], []]
    df = spark.createDataFrame([(str(i), " ".join(w[:2]), " ".join(w[2:]), 1.0) for i, w in enumerate(words)], "tale_id string, title string, raw_text string, score double")
    rows = {(r.tale_id, r.term): r for r in distinctive_terms(df, ["title", "raw_text"], share=share).collect()}
    counts = [Counter(w) for w in words]
    cf, total = Counter(x for w in words for x in w), sum(map(len, words))
    assert rows.keys() == {(str(i), t) for i, c in enumerate(counts) for t in c}
    p = {k: math.exp(log_upper_tail([r.tf], [r.n], [cf[k[1]]], total)[0]) for k, r in rows.items()}
    order = sorted(p.values())
    for k, r in rows.items():
        q = min(1.0, min(len(p) * x / sum(y <= x + 1e-12 for y in order) for x in order if x >= p[k] - 1e-12))
        assert r.log_p == pytest.approx(math.log(p[k]), abs=1e-9) and r.score == pytest.approx(-math.log(q), abs=0.021)
        assert (r.tf, r.occurrences, r.texts) == (counts[int(k[0])][k[1]], cf[k[1]], sum(k[1] in c for c in counts))
    few = distinctive_terms(df, ["title", "raw_text"], min_tf=3, max_texts=1, share=share).collect()
    assert [(r.tale_id, r.term) for r in few] == [("2", "tiger")]
    best = {i: min((p[k], k[1]) for k in p if k[0] == i)[1] for i in "012"}
    assert {r.tale_id: r.term for r in distinctive_terms(df, ["title", "raw_text"], top=1, share=share).collect()} == best
    assert distinctive_terms(df.limit(0), ["title"]).count() == 0
