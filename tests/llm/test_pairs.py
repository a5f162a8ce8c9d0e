"""Near duplicates, shared spans, leakage, canonical values."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import near_duplicates as N
from quillon.llm.canonical import canonical_ids
from quillon.llm.leakage import leaks
from quillon.llm.shared_spans import shared_amounts, shared_spans

VOCABULARY = [f"w{i}" for i in range(60)]


def grams(text, n):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def edited(words, rng):
    words = list(words)
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(len(words))
        words[i : i + rng.randint(0, 2)] = rng.choices(VOCABULARY, k=rng.randint(0, 2))
    if rng.random() < 0.3:
        i = rng.randrange(len(words))
        words = words[i:] + words[:i]
    return words


@pytest.fixture(scope="module")
def edits(spark):
    rng = random.Random(5)
    rows = [("none", None), ("empty", ""), ("short", "w1 w2"), ("tiny1", "a b c"), ("tiny2", "a b c"), ("tiny3", "a b c d")]
    for base in range(25):
        words = rng.choices(VOCABULARY, k=rng.choice([4, 8, 15, 30, 70, 150]))
        rows += [(f"{base}-{i}", " ".join(edited(words, rng))) for i in range(rng.randint(1, 4))]
    rows += [rows[10], (None, "a b c"), (rows[10][0], rows[10][1])]
    return rows, spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "tale_id string, raw_text string, name string, size int")


@pytest.mark.parametrize(("n", "p", "q", "x", "hot"), [(3, 1, 2, None, N.HOT_SETS), (3, 1, 2, 40, N.HOT_SETS), (3, 1, 2, 1, 3), (3, 1, 2, None, 2), (5, 4, 5, None, N.HOT_SETS), (1, 1, 1, None, N.HOT_SETS)])
def test_near_duplicates_agree_with_brute_force(spark, edits, monkeypatch, n, p, q, x, hot):
    if x:
        monkeypatch.setattr(N, "boundary", lambda *a: x)
    rows, df = edits
    sets = {k: grams(t, n) for k, t in rows if k and grams(t, n)}
    exact = {(a, b) for a in sets for b in sets if a < b and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b])}
    found = N.near_duplicates(df, "tale_id", "raw_text", n, p, q, hot)
    assert {(r.a, r.b) for r in found.pairs().collect()} == exact
    label = {k: k for k in sets}
    for _ in sets:
        for a, b in exact:
            label[a] = label[b] = min(label[a], label[b])
    groups = found.groups().collect()
    assert {r.key: r.group_id for r in groups} == label
    assert all(r.copies == sum(sets[k] == sets[r.key] for k in sets) for r in groups)
    assert all(r.links == len({frozenset(sets[k]) for k in sets if k != r.key and sets[k] != sets[r.key] and ((k, r.key) in exact or (r.key, k) in exact)}) for r in groups)


def test_near_duplicates_of_nothing(spark, edits):
    found = N.near_duplicates(edits[1].limit(0), "tale_id", "raw_text")
    assert found.pairs().count() == 0 and found.groups().count() == 0
    with pytest.raises(ValueError):
        N.near_duplicates(edits[1], "tale_id", "raw_text", p=1, q=3)


@pytest.mark.parametrize("t", [N.Threshold(1, 2), N.Threshold(4, 5), N.Threshold(2, 3)])
def test_sets_alike_meet_often_enough(t):
    """The hardest cases: as few common grams as the threshold allows, at every size and with any counts."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.choice([1, 2, 3, 4, 7, 8, 16, 31, 33, 64, 100, 180]))
        m = int(rng.integers(t.smallest(n), n * t.q // t.p + 1))
        need = int(t.need(n, m))
        if m < 1 or need > min(n, m):
            continue
        pool = np.unique(rng.integers(0, 2**44, 2 * (n + m)).astype(np.uint64))
        rng.shuffle(pool)
        s = N._Sets.__new__(N._Sets)
        s.grams = np.concatenate([np.sort(pool[:n]), np.sort(np.concatenate([pool[:need], pool[n : n + m - need]]))])
        s.row, s.size = np.repeat([0, 1], [n, m]), np.array([n, m])
        s.name = N.mix(np.arange(2).astype(np.uint64))
        rarity = N._rarity(rng.integers(1, 5, N.FEWEST_SLOTS))
        for x in (1 << 40, 20, 1):
            small, listed = N._keys(s, t, rarity, x, np.zeros(2, bool), N.split_into(np.ones(1), N.HOT_SETS))
            who, keys = small if max(n, m) <= x else listed[:2]
            common = len(set(keys[who == 0].tolist()) & set(keys[who == 1].tolist()))
            full = max(n, m) <= x and N._common_subsets(t, N._class(np.array([min(n, m)])))[0] == N.COMMON
            assert common >= (N.COMMON - N.DROPPED if full else 1)


def test_boundary_weighs_costs():
    t, counts = N.Threshold(1, 2), np.full(1000, 50)
    assert N.boundary(t, np.array([10, 20]), np.array([1000, 1000]), counts) >= 20
    assert N.boundary(t, np.array([10, 100_000]), np.array([1000, 1]), np.ones(10**6)) < 100_000
    assert N.split_into(np.full(9, 10**6), 1000)[80] == 1 < N.split_into(np.full(9, 10), 1000)[80]  # 2^20 sets
    assert N.slots(10**6) == N.FEWEST_SLOTS and N.FEWEST_SLOTS < N.slots(12 * 10**9) <= N.slots(10**14) == N.MOST_SLOTS


def spans_by_hand(texts, least):
    """Maximal spans of each text that another one has, from the furthest stop of every start."""
    out = {}
    for k, t in texts.items():
        others = [u for j, u in texts.items() if j[0] != k[0]]
        stop, spans = 0, set()
        for i in range(len(t) - least + 1):
            e = max(stop, i)
            while e < len(t) and any(t[i : e + 1] in u for u in others):
                e += 1
            if e > stop and e - i >= least:
                spans.add((i, e))
            stop = max(stop, e)
        if spans:
            out[k] = spans
    return out


def amount(spans):
    return len({i for a, b in spans for i in range(a, b)})


@pytest.mark.parametrize(("hot", "bits"), [(1000, 28), (1, 28), (0, 28), (1000, 4)])
def test_shared_spans_agree_with_brute_force(spark, hot, bits):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("abcé \n👧", k=n))
    passages = [word(n) for n in (19, 20, 21, 45, 60, 400)]
    texts = {(str(i), 0): word(rng.randint(0, 40)) + rng.choice(passages) + word(rng.randint(0, 40)) for i in range(40)}
    for i in range(30):  # parts of one long passage, and two passages one behind the other
        c, d = sorted(rng.sample(range(400), 2))
        texts[f"p{i}", 0] = word(rng.randint(0, 9)) + passages[5][c:d] + word(rng.randint(0, 3)) + passages[5][rng.randint(0, 300) :][:60]
    texts |= {("same1", 0): "z" * 50, ("same2", 0): "z" * 30, ("own", 0): "qrst" * 30, ("short", 0): passages[0], ("edge", 0): passages[3][:20], ("empty", 0): ""}
    texts |= {("7", 1): word(5) + passages[4], ("7", 2): passages[5][100:]}  # other texts of a tale
    rows = [(k, t, "Credit line, told by many" if i % 3 == 0 else None, "x") for i, ((k, _), t) in enumerate(texts.items())]
    rows += [rows[0], ("none", None, None, "x"), (None, passages[4], None, "x")]
    df = spark.createDataFrame(rows, "tale_id string, raw_text string, translator string, size string")
    spans = shared_spans(df, {"raw_text": 20, "translator": 10}, hot, bits)
    found = {}
    for r in spans.where("field = 'raw_text'").collect():
        found.setdefault((r.tale_id, r.record), set()).add((r.start, r.stop))
    expected = spans_by_hand(texts, 20)
    assert sorted((k, sorted(v)) for (k, _), v in found.items()) == sorted((k, sorted(v)) for (k, _), v in expected.items())
    got = shared_amounts(spans).collect()
    assert {r.tale_id: (r.shared, r.spans, r.size) for r in got if r.field == "raw_text"} == {
        k: tuple(map(sum, zip(*((amount(v), len(v), len(texts[j])) for j, v in expected.items() if j[0] == k)))) for k, _ in expected
    }
    assert {r.tale_id: r.shared for r in got if r.field == "translator"} == {k: 25 for i, (k, _) in enumerate(texts) if i % 3 == 0}
    assert shared_spans(df.limit(0), {"raw_text": 20}).count() == 0


def test_long_copies_are_one_span(spark):
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefgh ", k=9000))
    df = spark.createDataFrame([("a", "xyz" + long[:2000]), ("b", long[:2000] + "!"), ("c", long[1000:]), ("d", long[1500:])], "tale_id string, raw_text string")
    got = sorted((r.tale_id, r.start, r.stop) for r in shared_spans(df, {"raw_text": 150}).collect())
    assert got == [("a", 3, 2003), ("b", 0, 2000), ("c", 0, 1000), ("c", 500, 8000), ("d", 0, 7500)]


def test_rows_of_one_tale_share_nothing(spark):
    df = spark.createDataFrame([("a", "x" * 99), ("a", "x" * 99)], "tale_id string, raw_text string")
    assert shared_spans(df, {"raw_text": 20}).count() == 0


@pytest.mark.parametrize("block", [16_000_000, 60])
def test_leaks(spark, block):
    items = [(1, "One two, three four five six"), (2, "Short item"), (3, None), (4, "..."), (5, "ONE two three FOUR five six"), (None, "one two three four")]
    docs = [(1, "so: one—two three\nfour!"), (2, "one two three and four"), (3, "a short ITEM here"), (4, None), (5, ""), (6, "two thr­ee fоur five"), (6, "two three four five"), (7, "item short"), (8, "then two three four five short item now")]
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, item_id int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in leaks(d, b, 4, block_bytes=block).collect())
    assert got == [(1, 1), (1, 5), (3, 2), (6, 1), (6, 1), (6, 5), (6, 5), (8, 1), (8, 2), (8, 5)]  # a repeated document gives rows again
    cut = sorted((r.doc_id, r.text, r.removed_words) for r in leaks(d, b, 4, cut=True, block_bytes=block).collect())
    assert cut == [(1, "so: !", 4), (3, "a here", 2), (6, "", 4), (6, "", 4), (8, "then now", 6)]
    assert leaks(d.limit(0), b, 4).count() == 0 and leaks(d, b.limit(0), 4).count() == 0


LISTED = [
    (1, "region", "Rasofend Coast", []), (2, "region", "Upper Gaijeshith", []), (3, "region", "Lower Gaijeshith", None), (4, "region", "Vale of Hugrafon", ["Old Kozotres"]), (5, "region", "Douthavas Coast", []),
    (6, "region", "Tulahem", []), (7, "source", "Groubobarn Collection, First Series", []), (8, "source", "Groubobarn Collection, Second Series", []), (9, "source", "The Grenaher Papers", []), (10, "source", "Torestin Manuscript", []),
    (11, "source", "The Fesokral Papers", []), (12, "source", "Dinaihar Manuscript", []), (13, "source", "The Brizajith Papers", []), (14, "source", "Bridradraim Manuscript", []), (15, "region", "Shofashan Coast", []), (16, "region", "Upper Grakosisk", []),
    (17, "region", "Lower Grakosisk", []), (18, "region", "Upper Hepaigrol", []), (19, "region", "Lower Hepaigrol", []), (20, "source", "Grusizok Collection, First Series", []), (21, "source", "Grusizok Collection, Second Series", []),
    (22, "source", "Negobrom Collection, First Series", []), (23, "source", "Negobrom Collection, Second Series", []), (24, "region", "Vale of Letepin", []), (25, "region", "Vale of Runitus", []),
]
CASES = [
    ("rasofend coast", 1), ("Rasof. Coast", 1), ("Coast (Rasofend)", 1), ("Rasophénd-Coast?", 1), ("Rasofedn  Coast, 2nd copy", 1), ("Rasofend", 1), ("prob. Rasofend Coast; see notes", 1), ("Rasofend Coast", None), ("Gaijeshith", 0),
    ("Lwr Gaijeshith", 3), ("Upper Gaeejeschit", 2), ("old kozzotres", 4), ("V. of Hugrafon", 4), ("Duthawas Coast", 5), ("[Tulahem]", 6), ("The Grenaher Papers", 0), ("unknown", 0), ("?", 0), (" \t", None), (None, None), ("", None), ("Isle of Sikridur", 0), ("Upper Rasofend", 0),
]
SOURCES = [("Groubobarn Coll. ser. 2", 8), ("Grubobarn Collection, First Series", 7), ("Groubobarn Collection", 0), ("Groubobarn Collection (II)", 8), ("Torestin MS", 10), ("the greanher papers", 9), ("Tulahem", 0)]


def test_canonical_ids(spark):
    listed = spark.createDataFrame(LISTED, "value_id bigint, field string, canonical string, also_known_as array<string>")
    rows = [(i, v, SOURCES[i][0] if i < len(SOURCES) else None, 0) for i, (v, _) in enumerate(CASES)]
    df = spark.createDataFrame([*rows, rows[0], (None, "Tulahem.", None, 0)], "doc_seq bigint, region string, source string, value_id int")
    got = [(r.doc_seq, r.field, r.value_id) for r in canonical_ids(df, listed, ["region", "source"]).collect()]
    expected = [(i, "region", x) for i, (_, x) in enumerate(CASES) if x is not None] + [(i, "source", x) for i, (_, x) in enumerate(SOURCES)]
    expected += [(0, "region", 1), (0, "source", 8), (None, "region", 6)]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert canonical_ids(df.limit(0), listed, ["region"]).count() == 0
    assert {r.value_id for r in canonical_ids(df, listed.limit(0), ["region"]).collect()} == {0}


ALIKE = [
    (1, "region", "Bora Bora", []), (2, "region", "Bora", []), (3, "region", "Tula Tulan", []), (4, "region", "Upper Gaijeshith", []), (5, "region", "Lower Gaijeshith", []), (6, "region", "Greater Gaijeshith", ["Old Kozotres"]),
    (7, "region", "Upper Hepaigrol", []), (8, "region", "Lower Hepaigrol", []), (9, "region", "Greater Hepaigrol", None), (10, "region", "Upper Kusk", []), (11, "region", "Lower Kusk", []), (12, "region", "Greater Kuskas", []),
    (13, "region", "Karin Karen Karan", []), (14, "region", "Tulas Tulat Tulav", []), (15, "region", "Tulat Zulan Tulab", []),
]


@pytest.mark.parametrize(
    "cases",
    [
        [("bora bora", 1), ("Bora-bora", 1), ("bora", 2), ("bora bora bora", 0)],  # a name may have a word twice
        [("upper gaijeshith", 4), ("Lwr Gaijeshit", 5), ("Greater HEPAIGROL", 9), ("upper kusk", 10), ("upper", 0), ("gaijeshith", 0), ("Upper Lower", 0), ("Upper Lower Gaijeshith", 0)],  # names of general words
        [("tula tulam", 3), ("Karin Karyn Karen", 13), ("tulat tulan tulas", 14), ("karen karen karen karen", 0)],  # words nearest to the same word
    ],
)
def test_canonical_ids_of_words_alike(spark, cases):
    listed = spark.createDataFrame(ALIKE, "value_id bigint, field string, canonical string, also_known_as array<string>")
    got = canonical_ids(spark.createDataFrame(cases, "region string, expected int"), listed, ["region"], key="region").collect()
    assert {r.region: r.value_id for r in got} == dict(cases) and len(got) == len(cases)


def test_packed_keys_come_back():
    names, sizes = np.array([5, 6, 7], np.uint64), np.array([3, 4, 5])
    who, keys = np.array([0, 2, 2, 1]), np.array([1 << 40, 2 << 40, 3, 2**64 - 1], np.uint64)
    for places in (None, np.array([9, 8, 7, 6])):
        got = []
        for _, data in N._pack(names, sizes, who, keys, places, 3):
            k, n, s, p = N._unpack(data, places is not None)
            got += list(zip(k.tolist(), n.tolist(), s.tolist(), p.tolist() if places is not None else [None] * len(k)))
        assert sorted(got, key=str) == sorted([(int(k) & 0xFFFFFFFF, int(names[w]), int(sizes[w]), None if places is None else int(places[i])) for i, (w, k) in enumerate(zip(who, keys.tolist()))], key=str)
    assert pa.array([1]).to_pylist() == [1]
