import tracemalloc

import pyarrow as pa
import pytest
from conftest import corpus

from quillon.operators.evaluation import Queries, _scored, all_terms_places, batch_all_terms, batch_cosine, best_mode, current, evaluate, judgments, macro_average, metrics, phantoms, pivoted, plain_weights, read_qrels, retrieve, rounded
from quillon.operators.index import build_index
from quillon.operators.language import batch_entities, parse_question, strip_fillers
from quillon.operators.spelling import correct_terms, corrections

VOCABULARY = "jackal lion tiger forest king queen well bread beast crow deer crane monkey turtle merchant".split()


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame([(w,) for w in VOCABULARY], "term string")


def test_corrections(spark, vocabulary):
    asked = ["welp", "quene", "brest", "jo", "42", "zzzzzzzz", "jackel", "forst", "lion", "crome", "jackel"]
    rows = {r.term: (r.correction, r.distance) for r in corrections(spark.createDataFrame([(w,) for w in asked], "term string"), vocabulary).collect()}
    assert rows == {"welp": ("well", 1), "quene": ("queen", 2), "jackel": ("jackal", 1), "forst": ("forest", 1)}


def test_corrections_are_complete(spark, vocabulary):
    import itertools
    import random

    random.seed(3)
    asked = {"".join(random.choice("abeklnorst") for _ in range(random.randint(3, 6))) for _ in range(150)} | {w[:i] + c + w[i + 1 :] for w in VOCABULARY[:6] for i in range(len(w)) for c in "ax"}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    expected = {}
    for w in asked - set(VOCABULARY):
        near = sorted((distance(w, v), v) for v in VOCABULARY)
        best = [v for d, v in near if d == near[0][0]]
        if near[0][0] == 1 or (near[0][0] == 2 and len(best) == 1):
            expected[w] = best[0]
    got = {r.term: r.correction for r in corrections(spark.createDataFrame([(w,) for w in asked], "term string"), vocabulary).collect()}
    assert got == expected and list(itertools.islice(got, 1))


def test_correct_terms(tiny):
    assert correct_terms(tiny, ["hammar", "bell", "hammar", "bred"]) == {"hammar": "hammer", "bred": "bread"} and correct_terms(tiny, []) == {}


def test_fillers():
    assert strip_fillers("find me all tales about lion") == "lion" and strip_fillers("jackal please lion") == "jackal lion"
    assert strip_fillers("stories about lion") == "stories about lion" and strip_fillers("tell me about kings in the corpus") == "kings"


def test_questions():
    q = parse_question("Find tales about Baital Pachisi from Punjab, ATU 910")
    assert q.mode == "vsm" and q.traditions == ("Vikramaditya",) and q.filters == {"tradition": "Vikramaditya", "region": "Punjab", "tale_type": "ATU-91"}
    assert parse_question("atu-910", anchored_types=True).types == ("ATU-910",)
    assert parse_question("jackal but not lion").structured == "jackal  NOT  lion"
    assert parse_question("either king or queen").mode == "boolean" and parse_question("lion (tiger)").mode == "boolean"
    assert parse_question("lion AND tiger").structured == "lion AND tiger" and parse_question("lion and tiger").mode == "vsm"


def test_batch_entities_agree(spark):
    asked = ["Find tales about Baital Pachisi from Punjab, ATU 910", "jackal but not lion", "", None, "show me all stories in Bengal", "both lion and tiger", "lion please (x)", "which tales involve akbar"]
    rows = batch_entities(spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, query_text string")).orderBy("i").collect()
    for r, q in zip(rows, asked):
        one = parse_question(q or "")
        assert (r.mode, r.tradition, r.region, r.tale_type) == (one.mode, one.filters.get("tradition"), one.filters.get("region"), one.filters.get("tale_type"))


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_metrics(spark):
    results = frame(spark, [("m", "q", d, i) for i, d in enumerate(["x", "a", "y", "b"], 1)], "mode string, query_id string, doc_id string, rank int")
    judged = frame(spark, [("q", "a", 3), ("q", "b", 1), ("q", "c", 1), ("q", "y", 0)], "query_id string, doc_id string, grade int")
    ids = frame(spark, [("q",), ("none",)], "query_id string")
    rows = {r.query_id: r for r in rounded(metrics(results, judged, ids, ("m",), (1, 2, 5))).collect()}
    r = rows["q"]
    assert (r.p_1, r.p_2, r.p_5, r.precision, r.recall, r.f1) == (0, 0.5, 0.4, 0.5, 0.6667, 0.5714) and r.ap == round((1 / 2 + 2 / 4) / 3, 4)
    assert all(v == 0 for k, v in rows["none"].asDict().items() if k not in ("mode", "query_id"))
    perfect = metrics(frame(spark, [("m", "q", "a", 1), ("m", "q", "b", 2), ("m", "q", "c", 3)], "mode string, query_id string, doc_id string, rank int"), judged, ids, ("m",)).where("query_id = 'q'").first()
    assert perfect.ndcg == 1 and perfect.ap == 1


def test_evaluation(spark, tmp_path):
    index = build_index(corpus(spark, [("A", "Kite weather", "the kite would not rise"), ("B", "Otter with kite", "an otter held that kite"), ("C", "Mill", "a mill stood")]))
    path = tmp_path / "q.json"
    path.write_text('{"qrels": [{"query_id": "1", "query_text": "otter kite", "judgments": [{"tale_id": "B", "relevance_score": 3}, {"tale_id": "Z", "relevance_score": 2}]}, {"query_id": "2", "query_text": "mill", "judgments": [{"tale_id": "Z", "relevance_score": 1}]}]}')
    qrels = read_qrels(spark, str(path))
    assert qrels.count() == 2
    assert sorted(map(tuple, phantoms(qrels, index).collect())) == [("1", 1), ("2", 1)]
    twice = spark.sql("SELECT '1' AS query_id, 'x' AS query_text, array(named_struct('tale_id', 'B', 'relevance_score', 2, 'notes', ''), named_struct('tale_id', 'B', 'relevance_score', 0, 'notes', '')) AS judgments, 2 AS created_at UNION ALL SELECT '1', 'y', array(), 1")
    assert [r.query_text for r in current(twice).collect()] == ["x"]
    assert [(r.grade, r.relevant) for r in judgments(current(twice)).collect()] == [(0, True)]
    per_query = evaluate(index, qrels)
    rows = {(r.mode, r.query_id): r for r in per_query.collect()}
    assert len(rows) == 8 and all(rows[m, "1"].ap == 1 for m in ("boolean", "vsm", "bm25", "vsm_rocchio")) and rows["bm25", "2"].ap == 0
    assert {r.map for r in macro_average(per_query).collect()} == {0.5} and best_mode(macro_average(per_query)).first().mode == "bm25"
    assert pivoted(per_query).where("query_id = '1'").first().vsm_ndcg == 1
    assert evaluate(index, qrels, ("bm25",), ["2"]).count() == 1 and retrieve(index, qrels.limit(0).selectExpr("query_id", "query_text AS term", "1L AS qtf"), ("other",)).count() == 0


@pytest.mark.parametrize("block", [2000, 1])
def test_long_queries_in_blocks(tiny, by_hand, block):
    vectors = [("q1", w, x) for w, x in by_hand.plain("A").items()] + [("q2", w, x) for w, x in by_hand.plain("D").items()] + [("q3", "absent", 1.0)]
    df = tiny.registry.sparkSession.createDataFrame(vectors, "query_id string, term string, q double")
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in batch_cosine(tiny, df, 2, block).collect()}
    expected = {}
    for q, i in (("q1", "A"), ("q2", "D")):
        found = sorted((-round(x, 6), j) for j, x in by_hand.cosines(by_hand.plain(i), by_hand.plain).items())
        expected |= {(q, k + 1): (j, -x) for k, (x, j) in enumerate(found[:2])}
    assert got == expected
    assert batch_cosine(tiny, df.limit(0), 2).count() == 0


def test_places_of_judged_documents(spark, tiny):
    """As the whole ranking has them, ties included; more would be shuffled if all documents were."""
    rows = [(f"D{i:02}", "lamp", "the lamp of a king " * (1 + i % 3)) for i in range(40)]
    index = build_index(corpus(spark, rows))
    queries = spark.createDataFrame([("a", "lamp", 1), ("b", "lamp", 1), ("b", "king", 1), ("c", "lamp", 1), ("c", "none", 1), ("d", "king", 2)], "query_id string, term string, qtf bigint")
    judged = spark.createDataFrame([(q, f"D{i:02}") for q in "abc" for i in (0, 7, 8, 39)] + [("a", "D99")], "query_id string, doc_id string")
    full = {(r.query_id, r.doc_id): r["rank"] for r in batch_all_terms(index, queries).collect()}
    got = all_terms_places(index, queries, judged).collect()
    assert {(r.query_id, r.doc_id): r["rank"] for r in got if r.doc_id} == {k: full[k] for k in map(tuple, judged.collect()) if k in full}
    assert {q: sum(r.times for r in got if r.query_id == q) for q in "abcd"} == {"a": 40, "b": 40, "c": 0, "d": 40} and len(got) == 8 + 3


def test_many_queries_in_bounded_memory():
    """Queries and documents that share all their terms: the products of 3,000 with 3,000 by 60 terms are 540 million."""
    n, terms = 3_000, [f"t{i}" for i in range(60)]
    lists = pa.array([[{"term": t, "tf": 1 + i % 5, "tf_title": 0, "tf_body": 1 + i % 5, "df": n} for t in terms] for i in range(n)])
    batch = pa.RecordBatch.from_arrays([pa.array([f"D{i:04}" for i in range(n)]), lists], ["doc_id", "terms"])
    m = Queries.of(pa.table({"query_id": [f"Q{i:04}" for i in range(n) for _ in terms], "term": terms * n, "q": [1.0] * (60 * n)}))
    tracemalloc.start()
    (out,) = _scored([batch], m, lambda *x: plain_weights(*x, n, 60.0), 20, True, False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 700e6 and len(out) == 20 * n and set(out.column(2).to_pylist()) == {1.0} and set(out.column(1).to_pylist()) == {f"D{i:04}" for i in range(20)}
