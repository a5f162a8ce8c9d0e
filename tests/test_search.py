import math
from collections import Counter

import pytest
from conftest import TALES, corpus, cosine
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.functions.text import query_tokens
from quillon.operators.bm25 import bm25_search
from quillon.operators.boolean import And, BooleanParseError, Not, Or, Term, boolean_search, matched_stems, parse, upper_operators
from quillon.operators import divergence as dv
from quillon.operators.divergence import divergence, nearest_variants, symmetric
from quillon.operators.feedback import local_rerank, pseudo_feedback, rocchio
from quillon.operators.index import build_index
from quillon.operators.vsm import vsm_search

SETS = [
    ("hammer AND bell OR bread", "BC"), ("bell OR bread AND NOT hammer", "ABC"), ("(bell OR bread) AND NOT hammer", "AC"), ("hammer bread", ""), ("hammer AND bread", ""), ("(hammer)(bread)", ""),
    ("(hammer)(bell)", "B"), ("hammer NOT bell", "D"), ("hammer AND NOT bell", "D"), ("NOT bell", "CD"), ("NOT NOT bell", "AB"), ("not bell", "CD"), ("hammer and bell", "B"), ("bell-bread", ""), ("zebra OR bread", "C"),
]


def found(df):
    return [(r.doc_id, r.score) for r in df.collect()]


@pytest.mark.parametrize(("query", "ids"), SETS)
def test_boolean_sets(tiny, query, ids):
    assert sorted(i for i, _ in found(boolean_search(tiny, query))) == list(ids)


@pytest.mark.parametrize(
    ("query", "message"),
    [("hammer AND (bell", "Missing closing"), ("hammer AND", "end of boolean expression"), ("OR hammer", "unexpected position"), ("the AND bell", "stopwords"), ("hammer)", "Unexpected token"), ("", "end of boolean expression"), ("NOT", "end of boolean"), ("(", "end of boolean"), ("()", "stopwords")],
)
def test_boolean_errors(query, message):
    with pytest.raises(BooleanParseError, match=message):
        parse(query)


def test_boolean_tree():
    a, b, c = (Term((x,)) for x in ("aa", "bb", "cc"))
    assert parse("aa OR bb cc") == Or((a, And((b, c)))) and parse("NOT (aa OR bb) cc") == And((Not(Or((a, b))), c))
    assert upper_operators("a And b and not c") == "a And b AND NOT c" and matched_stems("(aa OR NOT bb) aa") == ["aa", "bb"]


words = st.sampled_from(["bell", "hammer", "bread"])
trees = st.recursive(words, lambda t: st.one_of(st.tuples(st.just("NOT"), t), st.tuples(t, st.sampled_from(["AND", "OR"]), t)), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(trees)
def test_boolean_parser_agrees_with_sets(tree):
    docs = {t: {i for i, title, body in TALES if t in query_tokens(f"{title} {body}")} for t in ("bell", "hammer", "bread")}

    def text(t):
        return t if isinstance(t, str) else f"({' '.join(x if x in ('AND', 'OR', 'NOT') else text(x) for x in t)})"

    def truth(t):
        if isinstance(t, str):
            return docs[t]
        if t[0] == "NOT":
            return set("ABCD") - truth(t[1])
        return truth(t[0]) & truth(t[2]) if t[1] == "AND" else truth(t[0]) | truth(t[2])

    def holds(n):
        if isinstance(n, Term):
            return set.intersection(*(docs[s] for s in n.stems))
        if isinstance(n, Not):
            return set("ABCD") - holds(n.inner)
        parts = [holds(p) for p in n.parts]
        return set.union(*parts) if isinstance(n, Or) else set.intersection(*parts)

    assert holds(parse(text(tree))) == truth(tree)


def test_boolean_ranking_and_filters(spark, tiny, by_hand):
    assert found(boolean_search(tiny, "bell OR hammer")) == by_hand.boolean(["bell", "hammer"])
    assert found(boolean_search(tiny, "bell OR bread", {"region": "Nowhere"})) == []
    assert boolean_search(tiny, "bell OR bread").where("doc_id = 'C'").first().terms_matched == ["bread"]


def test_vsm_by_hand(tiny, by_hand):
    for words_ in (["hammer"], ["hammer", "bell"], ["smith", "smith", "bread"]):
        query = " ".join(words_)
        assert found(vsm_search(tiny, query)) == by_hand.vsm(words_) != []
        assert found(vsm_search(tiny, query, title_weight=0.35, body_weight=0.65)) == by_hand.vsm(words_, 0.35, 0.65)
        assert found(vsm_search(tiny, query, 1)) == by_hand.vsm(words_)[:1]


def test_vsm_zones_and_edges(spark):
    index = build_index(corpus(spark, [("X", "jackal", "something plain"), ("Y", "something plain", "jackal")]))
    assert [i for i, _ in found(vsm_search(index, "jackal"))] == ["X", "Y"]
    assert [(i, s > 0) for i, s in found(vsm_search(index, "jackal", title_weight=0, body_weight=1))] == [("Y", True), ("X", False)]
    for query in ("the of", "zebra", ""):
        assert found(vsm_search(index, query)) == [] and found(bm25_search(index, query)) == []
    one = build_index(corpus(spark, [("X", "cat", "catalog")]))
    assert found(vsm_search(one, "cat"))[0][1] > 0 and found(vsm_search(one, "log")) == []
    empty = build_index(corpus(spark, [("X", "cat", "x")]).limit(0))
    assert found(vsm_search(empty, "cat")) == [] and found(bm25_search(empty, "cat")) == []


def test_vsm_expansions(spark):
    index = build_index(corpus(spark, [("V", "", "clever fox"), ("W", "", "cunning fox"), ("Z", "", "slow bear")]))
    rows = vsm_search(index, "clever", expansions={"cunning": 0.3, "absent": 0.9}).collect()
    assert [(r.doc_id, r.terms_matched, r.expansions_matched) for r in rows] == [("V", ["clever"], []), ("W", ["cunning"], ["cunning"])]
    again = vsm_search(index, "clever cunning", expansions={"cunning": 0.3}).collect()
    assert again[0].score == again[1].score


def test_filters(spark):
    meta = {"A": {"region": "Kashmir Valley", "tradition": "Jataka", "source_collection": "Old Book"}, "B": {"region": "Bengal", "tradition": "Old Lore", "source_collection": "x"}}
    index = build_index(corpus(spark, [("A", "lion", "a"), ("B", "lion", "b")], **meta))
    assert [i for i, _ in found(vsm_search(index, "lion", collection="old"))] == ["A", "B"]
    assert [i for i, _ in found(bm25_search(index, "lion", collection="old"))] == ["A"]
    assert [i for i, _ in found(vsm_search(index, "lion", region="BENG"))] == ["B"]
    assert [i for i, _ in found(bm25_search(index, "lion", region="BENG"))] == ["B"]


def test_bm25_by_hand(tiny, by_hand):
    for words_ in (["hammer"], ["bell", "hammer"], ["river", "bread"]):
        query = " ".join(words_)
        assert found(bm25_search(tiny, query)) == by_hand.bm25(words_) != []
        assert found(bm25_search(tiny, query, title_boost=3.0, k1=1.1, b=0.4)) == by_hand.bm25(words_, 1.1, 0.4, 3.0)
    assert bm25_search(tiny, "bell hammer hammer").where("doc_id = 'B'").first().terms_matched == ["bell", "hammer"]


def test_feedback_by_hand(spark, tiny, by_hand):
    assert found(rocchio(tiny, "hammer", ["B"], ["A"])) == by_hand.rocchio(["hammer"], ["B"], ["A"])
    assert found(rocchio(tiny, "hammer", ["B", "B", "D"], ["C"], alpha=0.5, gamma=0.9)) == by_hand.rocchio(["hammer"], ["B", "B", "D"], ["C"], alpha=0.5, gamma=0.9)
    first = [i for i, _ in by_hand.vsm(["hammer"])[:3]]
    assert found(pseudo_feedback(tiny, "hammer")) == by_hand.rocchio(["hammer"], first, [])
    assert found(pseudo_feedback(tiny, "zebra")) == [] and found(rocchio(tiny, "zebra", [], [])) == []
    half = found(rocchio(tiny, "hammer", ["B", "nobody"], []))
    assert half == by_hand.rocchio(["hammer"], ["B", "nobody"], []) != found(rocchio(tiny, "hammer", ["B"], []))
    top = bm25_search(tiny, "bell hammer")
    last = [i for i, _ in found(top)][-1]
    moved = {r.doc_id: r.score for r in local_rerank(top, [last], ["B"]).collect()}
    before = dict(found(top))
    assert moved == {i: pytest.approx(x + (0.15 if i == last else -0.2 if i == "B" else 0)) for i, x in before.items()}


def test_divergence_by_hand(tiny, by_hand):
    d = divergence(tiny, "t")
    pairs = [("A", "B"), ("A", "C"), ("A", "D"), ("B", "C"), ("B", "D"), ("C", "D")]
    cosines = {(a, b): cosine(by_hand.plain(a), by_hand.plain(b)) for a, b in pairs}
    alike = {(a, b): len(set(by_hand.tf[a]) & set(by_hand.tf[b])) / len(set(by_hand.tf[a]) | set(by_hand.tf[b])) for a, b in pairs}
    rows = {(r.doc_a, r.doc_b): (r.cosine, r.jaccard, r.overlap) for r in d.matrix.collect()}
    assert rows == {p: (round(cosines[p], 4), round(alike[p], 4), round(100 * alike[p], 2)) for p in pairs}
    s = d.summary.first()
    least = min(pairs, key=lambda p: (round(cosines[p], 4), p))
    most = min(pairs, key=lambda p: (-round(cosines[p], 4), p))
    assert (s.similar_a, s.similar_b, s.divergent_a, s.divergent_b, s.pairs) == (*most, *least, 6)
    assert s.mean == pytest.approx(sum(cosines.values()) / 6, abs=1e-4)
    near = {(r.doc_id, r.place): (r.other, r.cosine) for r in nearest_variants(tiny, "T", 1).collect()}
    best = {a: max((round(x, 6), {*p} - {a}) for p, x in cosines.items() if a in p and x > 0) for a in "ABD"}
    assert near == {(a, 1): (*other, x) for a, (x, other) in best.items()}
    both = symmetric(d.matrix).collect()
    assert len(both) == 12 and {r.heat for r in both} == {"high" if x > 0.5 else "mid" if x > 0.25 else "low" for x in cosines.values()}
    weights = {w: sum(by_hand.plain(i).get(w, 0) for i in "ABCD") / 4 for w in by_hand.df}
    expected = sorted(((-round(x, 6), w) for w, x in weights.items()))[:20]
    assert [(r.term, r.weight) for r in d.centroid_terms.collect()] == [(w, -x) for x, w in expected] and divergence(tiny, "none") is None


def test_divergence_of_one(spark):
    s = divergence(build_index(corpus(spark, [("A", "bread", "x")])), "T").summary.first()
    assert (s.pairs, s.mean, s.least, s.greatest, s.similar_a) == (0, 0, 0, 0, None)


@pytest.fixture(scope="module")
def many(spark):
    """Sixty variants of one type, the same text among them again and again, one without terms, with their terms."""
    words = "ash birch cedar elm fir hazel ivy larch maple oak pine rowan spruce teak willow yew".split()
    tales = [(f"V{i * 7 % 60:02}", words[i % 16], " ".join(words[j] for j in range(16) if (i % 29) * 37 % (j + 3) < 2)) for i in range(59)] + [("V99", "", "")]
    return build_index(corpus(spark, tales)), {i: {*t.split(), *b.split()} for i, t, b in tales}, [i for i, _, _ in tales]


def test_divergence_in_blocks(many, monkeypatch):
    index, terms, order = many
    exact = {r.doc_id: {} for r in index.registry.collect()}
    for r in index.document_vector(*order).collect():
        exact[r.doc_id][r.term] = r.weight
    pairs = {(a, b): (cosine(exact[a], exact[b]), len(terms[a] & terms[b]) / max(1, len(terms[a] | terms[b]))) for k, a in enumerate(order) for b in order[k + 1 :]}
    for block in (9, 100):
        monkeypatch.setattr(dv, "BLOCK", block)
        matrix = dv.matrix(index, "t")
        rows = {(r.doc_a, r.doc_b): (r.cosine, r.jaccard, r.overlap) for r in matrix.collect()}
        assert len(rows) == 60 * 59 / 2 and rows == {p: (round(c, 4), pytest.approx(j, abs=6e-5), pytest.approx(100 * j, abs=6e-3)) for p, (c, j) in pairs.items()}
        most, least = (min(pairs, key=lambda p: (f * round(pairs[p][0], 4), order.index(p[0]), order.index(p[1]))) for f in (-1, 1))
        found = dv.summary(index, "t").first()
        assert (found.pairs, found.similar_a, found.similar_b, found.divergent_a, found.divergent_b) == (len(pairs), *most, *least)
        heats = Counter((i, "high" if round(c, 4) > 0.5 else "mid" if round(c, 4) > 0.25 else "low") for p, (c, _) in pairs.items() for i in p)
        assert {(r.doc_a, r.heat): r.pairs for r in dv.heat_counts(index, "t").collect()} == heats
        near = {i: sorted((-round(c, 6), *({*p} - {i})) for p, (c, _) in pairs.items() if i in p and c > 0)[:3] for i in order}
        got = {(r.doc_id, r.place): (-r.cosine, r.other) for r in nearest_variants(index, "t", 3).collect()}
        assert got == {(i, k + 1): x for i in order for k, x in enumerate(near[i])}
        assert "Join" not in matrix._jdf.queryExecution().executedPlan().toString().replace("BroadcastHashJoin", "")


def test_scores_are_cosines(tiny):
    for query in ("bell", "hammer smith", "bread bell winter"):
        assert all(0 <= s <= 1.000001 for _, s in found(vsm_search(tiny, query)))
    assert math.isclose(found(rocchio(tiny, "bell", ["A"], []))[0][1], 0.9, abs_tol=0.1) and found(rocchio(tiny, "bell", ["A"], []))[0][0] == "A"


def test_plans_stay_in_the_engine(tiny):
    for df in (bm25_search(tiny, "bell"), vsm_search(tiny, "bell"), boolean_search(tiny, "bell OR bread")):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan
    plan = bm25_search(tiny, "bell")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "PushedFilters: [" in plan and "positions" not in plan.split("Physical Plan")[1]
