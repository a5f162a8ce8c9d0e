import math

import pytest
from conftest import TALES, corpus
from pyspark.sql import functions as F

from quillon.functions.text import analyze, content_tokens, query_tokens, snippet, tokens
from quillon.operators import index as ix
from quillon.operators.lexicon import build_lexicon, expansions, lemmas_of, synonym_seed


def run(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "words"),
    [("lion's den", ["lion", "den"]), ("lion’s den", ["lion", "den"]), ("dogs' bones", ["dogs", "bones"]), ("don't panic", ["dont", "panic"]), ("well-deep", ["well", "deep"]), ("a1 b_c été x", ["x"]), ("", []), (None, [])],
)
def test_tokens(spark, text, words):
    assert run(spark, tokens, text) == words
    if text is not None:
        assert query_tokens(text) == run(spark, analyze, text)


@pytest.mark.parametrize("word", ["king", "well", "day", "lion", "jackal"])
def test_stopwords(spark, word):
    assert run(spark, analyze, f"the {word} said") == [word]
    assert run(spark, analyze, "the a an of in upon") == []
    assert spark.range(1).select(content_tokens(F.array(F.lit("b"), F.lit("go"), F.lit("go")))).first()[0] == ["go", "go"]


def test_snippet(spark):
    assert run(spark, snippet, "x" * 200) == "x" * 200
    assert run(spark, snippet, "x" * 201) == "x" * 200 + "…"


def test_lemmas(spark, lexicon):
    assert lemmas_of(lexicon, ["hammers", "lifted", "feet", "bell"]) == ["hammer", "lift", "foot", "bell"]
    forms = spark.createDataFrame([(w,) for w in ("jackals", "tricked", "feet", "stories", "sleeping", "glass", "prowls")], "form string")
    words = spark.createDataFrame([(w,) for w in ("jackal", "trick", "foot", "story", "sleep", "glass", "prowl")], "lemma string")
    assert dict(map(tuple, build_lexicon(forms, words).collect())) == {"jackals": "jackal", "tricked": "trick", "feet": "foot", "stories": "story", "sleeping": "sleep", "prowls": "prowl"}


def test_expansions(spark):
    seed = synonym_seed(spark)
    vocabulary = spark.createDataFrame([("cunning",), ("wood",)], "term string")
    assert expansions(seed, ["forest", "clever", "forest"]) == {"forest": ["wood"], "clever": ["cunning", "shrewd"]}
    assert expansions(seed, ["clever", "king"], vocabulary) == {"clever": ["cunning"]}
    assert expansions(seed, ["clever", "cunning"]) == {"clever": ["shrewd"]}
    assert expansions(seed, ["clever"], max_per_term=1) == {"clever": ["cunning"]}
    assert expansions(seed.limit(0), ["clever"]) == {} and expansions(seed, []) == {}


def test_postings(tiny, by_hand):
    rows = {(r.term, r.doc_id): r for r in tiny.postings.collect()}
    assert {k: (r.tf_title, r.tf_body, r.df) for k, r in rows.items()} == {(w, i): (t[w], b[w], by_hand.df[w]) for i, (t, b) in by_hand.zones.items() for w in t | b}
    assert rows["bell", "A"].title_positions == [1] and rows["bell", "A"].body_positions == [4]
    assert rows["hammer", "B"].positions == [1, 4] and rows["cross", "A"].positions == [6]
    assert {r.term: r.df for r in tiny.term_stats.collect()} == by_hand.df
    assert tiny.n_docs == 4 and tiny.avgdl == by_hand.avgdl
    assert tiny.document_frequencies(["bell", "zebra"]) == {"bell": 2}
    assert [r.term for r in ix.top_terms(tiny, 2).collect()] == ["bell", "hammer"]
    vectors = {(r.doc_id, r.term): r.weight for r in tiny.document_vector("A", "C", "none").collect()}
    assert vectors == {(i, w): pytest.approx(x) for i in "AC" for w, x in by_hand.plain(i).items()}


def test_registry_reads(tiny, by_hand):
    assert ix.variants(tiny, "t").count() == 4
    assert [tuple(r) for r in ix.tale_types(tiny).collect()] == [("T", 4)]
    sizes = {"tokens": sum(c.total() for c in by_hand.tf.values()), "terms": len(by_hand.df), "postings": sum(by_hand.df.values())}
    assert ix.status(tiny).first().asDict() == {"documents": 4, "tale_types": 1, "traditions": 1, "regions": 1, **sizes}


def test_store(spark, tmp_path, lexicon):
    docs, path = corpus(spark, TALES), f"file://{tmp_path}/index"
    assert ix.load(spark, path) is None
    built = ix.open_or_build(spark, path, docs, lexicon)
    again = ix.load(spark, path, docs)
    assert again.fingerprint == built.fingerprint and again.n_docs == 4 and again.postings.count() == built.postings.count()
    changed = corpus(spark, [*TALES[:3], ("D", "Hammer of frost", "Another smith.")])
    assert ix.load(spark, path, changed) is None
    assert ix.open_or_build(spark, path, changed).fingerprint != built.fingerprint
    assert not ix.is_stale(None, "x") and not ix.is_stale("x", None) and ix.is_stale("x", "y")


def test_partitions_do_not_matter(spark, lexicon, tiny):
    docs = corpus(spark, TALES)
    again = ix.build_index(docs.orderBy(F.desc("tale_id")).repartition(3), lexicon)
    assert sorted(map(str, again.postings.collect())) == sorted(map(str, tiny.postings.collect())) and again.fingerprint == tiny.fingerprint


def test_empty_documents_and_index(spark):
    some = ix.build_index(corpus(spark, [("A", "", ""), ("B", "lion", "")]))
    assert (some.n_docs, some.n_with_tokens, some.avgdl) == (2, 1, 1.0)
    none = ix.build_index(corpus(spark, [("A", "x", "x")]).limit(0))
    assert none.n_docs == 0 and none.fingerprint is None and none.avgdl == 1.0


def test_norms(tiny, by_hand):
    for weights, vector in (((), by_hand.plain), ((2.0, 1.0), lambda i: by_hand.zoned(i, 2, 1)), ((0.0, 3.0), lambda i: by_hand.zoned(i, 0, 3))):
        norms = {r.doc_id: r.norm for r in tiny.norms(*weights).collect()}
        assert norms == {i: pytest.approx(math.sqrt(sum(x * x for x in vector(i).values()))) for i in "ABCD"}


def test_index_is_known_by_its_files(spark, tmp_path, lexicon):
    corpus(spark, TALES).write.parquet(f"{tmp_path}/tales")
    rows, path = spark.read.parquet(f"{tmp_path}/tales"), f"file://{tmp_path}/index"
    ix.open_or_build(spark, path, rows, lexicon)
    stored = ix.load(spark, path)
    assert stored.snapshot is not None and stored.snapshot == ix.snapshot(spark.read.parquet(f"{tmp_path}/tales")) != ix.snapshot(rows.limit(3))
    assert ix.load(spark, path, rows) is not None and ix.load(spark, path, rows.repartition(2)) is not None and ix.load(spark, path, rows.limit(3)) is None


def test_scans_of_terms_and_documents_are_filtered(tiny):
    for df, column in ((tiny.of_terms(["bell"]), "term"), (tiny.of_documents(["A"]), "doc_id")):
        plan = df._jdf.queryExecution().toString()
        assert f"EqualTo({column}," in plan or f"In({column}," in plan
