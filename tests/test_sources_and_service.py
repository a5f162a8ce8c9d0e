import json
import subprocess
import sys
from pathlib import Path

import pytest
from conftest import TALES, corpus

from quillon import build
from quillon.operators import catalog
from quillon.operators.boolean import BooleanParseError
from quillon.operators.lexicon import synonym_seed
from quillon.plans.checkpoints import checkpointed, released
from quillon.plans.service import Engine
from quillon.sources import corpus as src
from quillon.streaming import ingest


def test_read_and_accept(spark, tmp_path):
    rows = [{"tale_id": "b", "title": "T", "raw_text": "x", "region": "R"}, {"tale_id": "a", "title": "T", "raw_text": None}, {"tale_id": "c", "raw_text": "x"}]
    (tmp_path / "many.json").write_text(json.dumps(rows))
    (tmp_path / "one.json").write_text(json.dumps(rows[0], indent=1))
    many = src.read_json(spark, str(tmp_path / "many.json"))
    assert [(r.doc_seq, r.tale_id) for r in many.orderBy("doc_seq").collect()] == [(0, "b"), (1, "a"), (2, "c")]
    assert src.read_json(spark, str(tmp_path / "one.json")).count() == 1
    both = src.read_json(spark, [str(tmp_path / "one.json"), str(tmp_path / "many.json")])
    assert [(r.doc_seq, r.tale_id) for r in both.orderBy("doc_seq").collect()] == [(0, "b"), (1, "a"), (2, "c"), (3, "b")]  # files by name
    plain = src.with_sequence(spark.createDataFrame([(x,) for x in "badcfe"], "tale_id string").repartition(1).repartition(3, "tale_id"))
    assert sorted(r.doc_seq for r in plain.collect()) == [0, 1, 2, 3, 4, 5]
    accepted = src.accept(many)
    kept = accepted.rows.first()
    assert (kept.tale_id, kept.region, kept.tradition, kept.tale_type, kept.translator) == ("b", "R", "Unknown", "UNKNOWN", "")
    assert accepted.stats() == {"documents_ingested": 1, "skipped": 2, "errors": ["missing fields: raw_text (1 rows)", "missing fields: title (1 rows)"]}


def test_latest_and_upsert(spark):
    rows = spark.createDataFrame([("a", 1, None, "x"), ("a", 2, 5, "y"), ("b", 3, 1, "z"), (None, 4, 9, "n"), ("a", 5, 5, "w")], "tale_id string, doc_seq int, updated_at int, v string")
    assert sorted((r.tale_id, r.v) for r in src.latest(rows).collect()) == [("a", "w"), ("b", "z")]
    old, new = rows.where("doc_seq IN (2, 3)"), rows.where("doc_seq = 5")
    assert sorted(r.v for r in src.upsert(old, new).collect()) == ["w", "z"]
    with pytest.raises(ValueError):
        src.insert(old, new, "tale_id")
    with pytest.raises(KeyError):
        src.update(old, new.withColumn("tale_id", new.v), "tale_id")
    assert src.update(old, new, "tale_id").count() == 2 and src.insert(rows.where("doc_seq = 3"), new, "tale_id").count() == 2


def test_fingerprint(spark):
    rows = corpus(spark, TALES)
    assert src.fingerprint(rows) == src.fingerprint(rows.repartition(3)) != src.fingerprint(rows.limit(3))
    assert src.fingerprint(rows) != src.fingerprint(rows.unionAll(rows)) and src.fingerprint(rows.limit(0)) is None


def test_catalog(spark, tmp_path):
    tales = corpus(spark, TALES, A={"tradition": "Cycle of X", "region": "Coast"}, B={"tradition": "the cycle"}).selectExpr("*", "timestamp_seconds(doc_seq) AS created_at")
    assert [r.tale_id for r in catalog.list_tales(tales, tradition="^cycle").collect()] == ["A"] and "raw_text" not in catalog.list_tales(tales).columns
    rows, n = catalog.page(tales, 1, 2)
    assert ([r.tale_id for r in rows.collect()], n) == (["C", "B"], 4)
    with pytest.raises(LookupError):
        catalog.by_key(tales, "tale_id", "Z")
    assert catalog.variants_of(tales, "t").count() == 0 and catalog.variants_of(tales, "T").count() == 4
    types = spark.createDataFrame([("T", "ATU-1", "The Bell", None), ("U", "ATU-0", None, "a bell")], "tale_type_id string, atu_code string, canonical_title string, description string")
    assert [r.tale_type_id for r in catalog.browse_types(tales, types, "bell").collect()] == ["U", "T"]
    assert [r.tale_type_id for r in catalog.browse_types(tales, types, "bell", "CYCLE").collect()] == ["T"]
    results = spark.createDataFrame([("1", "T", "Unknown Region"), ("", "T", ""), ("2", " ", "")], "doc_id string, title string, region string")
    assert [tuple(r) for r in catalog.clean_results(results).collect()] == [("1", "T", "")]
    log = spark.createDataFrame([(1, "vsm", 5.0, 1, 1), (1, "vsm", 5.0, 1, 2), (2, "vsm", -1.0, 2, 2), (3, "bm25", None, 3, 3)], "log_id long, query_mode string, execution_time_ms double, created_at int, received_at int")
    assert [r.log_id for r in catalog.latest_log(log, 2).collect()] == [3, 2]
    assert sorted(map(tuple, catalog.latency_by_mode(log).collect())) == [("bm25", 1, 0, None, None), ("vsm", 2, 1, 5.0, 5.0)]
    catalog.append_log(log, f"{tmp_path}/log")
    catalog.append_log(log, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 8
    with pytest.raises(ValueError):
        catalog.append_log(log.replace("bm25", "other"), f"{tmp_path}/log")


@pytest.fixture(scope="module")
def engine(spark, tiny, lexicon):
    return Engine(tiny, lexicon, synonym_seed(spark))


def test_engine_searches(engine, by_hand):
    assert engine.search_boolean("hammers AND NOT bell")["results"][0]["doc_id"] == "D"
    assert engine.search_vsm("hammer")["results"][0]["score"] == by_hand.vsm(["hammer"], 0.35, 0.65)[0][1] and engine.search_vsm("hammar", auto_correct=True)["corrections"] == {"hammar": "hammer"}
    assert engine.search_bm25("hammer")["results"][0]["engine"] == "bm25"
    with pytest.raises(ValueError):
        engine.search_vsm("hammer", zone_weights={"title": -1})
    with pytest.raises(BooleanParseError):
        engine.search_boolean("the")
    assert engine.feedback("hammer", ["B"], ["A"])["results"][0]["score"] == by_hand.rocchio(["hammer"], ["B"], ["A"])[0][1] and engine.pseudo_feedback("hammer")["total"] == len(by_hand.rocchio(["hammer"], ["B", "D"], []))


def test_engine_questions(engine):
    assert engine.search_question("hammer but not bell")["mode"] == "nl_query"
    assert engine.search_question("bell with bread AND hammer but not zebra")["mode"] == "vsm_fallback"
    found = engine.search_question("find tales about bell", auto_correct=True)
    assert found["mode"] == "nl_query" and found["parsed"].normalized == "bell" and found["total"] == 2
    assert engine.search_question("shrewd hammer", expand_synonyms=True)["synonyms_applied"] == {}
    assert engine.search_question("hammer from Punjab")["total"] == 0


def test_engine_reports(spark, engine):
    assert engine.tale_types() == [{"tale_type": "T", "variants": 4}] and len(engine.variants("t")) == 4 and engine.divergence("T")["summary"]["pairs"] == 6
    for call in (engine.variants, engine.divergence):
        with pytest.raises(LookupError):
            call("none")
    assert engine.status()["documents"] == 4 and engine.health(corpus(spark, TALES))["index_stale"] is False and engine.health(corpus(spark, TALES[:2]))["index_stale"]


def test_build_command(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps([{"tale_id": i, "title": t, "raw_text": b} for i, t, b in TALES]))
    again = corpus(spark, [("A", "Later bell", "fable"), ("A", "New bell", "fable")]).selectExpr("*", "timestamp_seconds(9 - doc_seq) AS updated_at")
    again.write.parquet(f"{tmp_path}/t")
    assert build.main(["--index", f"file://{tmp_path}/x", "--report"]) == 1
    assert build.main(["--corpus", f"{tmp_path}/c.json", "--corpus", f"{tmp_path}/t", "--index", f"file://{tmp_path}/x"]) == 0
    assert build.main(["--index", f"file://{tmp_path}/x", "--report"]) == 0
    assert "'documents_ingested': 4" in capsys.readouterr().out
    title = lambda *sources: {r.tale_id: r.title for r in build.ingest(spark, [f"{tmp_path}/{x}" for x in sources])[0].rows.collect()}["A"]
    assert (title("c.json", "t"), title("t", "c.json"), title("t")) == ("Later bell", TALES[0][1], "Later bell")
    assert build.ingest(spark, [f"{tmp_path}/no.json"]) == (None, [f"corpus not found: {tmp_path}/no.json"])
    assert Engine.rebuild(spark, f"file://{tmp_path}/y", [f"{tmp_path}/no.json", f"{tmp_path}/t"])["errors"] == [f"corpus not found: {tmp_path}/no.json"]


def test_tables_are_released(spark):
    there = lambda df: all(Path(f.removeprefix("file://")).exists() for f in df.inputFiles())
    kept = checkpointed(spark.range(3))
    with released(spark):
        gone = checkpointed(spark.range(5))
        files = gone.inputFiles()
        assert gone.count() == 5 and there(gone) and files
    assert not any(Path(f.removeprefix("file://")).exists() for f in files) and there(kept) and kept.count() == 3


def test_engine_log_and_samples(spark, tiny, lexicon, tmp_path):
    engine = Engine(tiny, lexicon, log_path=f"{tmp_path}/log")
    engine.search_boolean("hammer", limit=1), engine.search_vsm("hammer"), engine.search_bm25("hammer"), engine.search_question("tales about hammer"), engine.pseudo_feedback("hammer"), engine.feedback("hammer", ["B"], [])
    log = spark.read.parquet(f"{tmp_path}/log").collect()
    assert sorted(r.query_mode for r in log) == sorted(catalog.QUERY_MODES) and all(r.execution_time_ms > 0 for r in log)
    assert [r.feedback_applied.relevant_ids for r in log if r.feedback_applied] == [["B"]]
    page = engine.search_boolean("hammer OR bell", skip=1, limit=1)
    assert page["total"] == 3 and len(page["results"]) == 1
    assert len(engine.evaluate()["per_query"]) == 20 and len(engine.evaluate(modes=("bm25",), query_ids=["Q-01"])["per_query"]) == 1
    with pytest.raises(FileNotFoundError):
        engine.evaluate(f"{tmp_path}/none.json")
    with pytest.raises(ValueError):
        engine.evaluate(modes=("other",))


def test_streams(spark, tmp_path):
    rows = corpus(spark, TALES)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    seen = []
    stream = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    ingest.ingest_tales(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", lambda t: seen.append(t.count())).awaitTermination()
    corpus(spark, [("A", "Changed", "x"), ("E", "New", "y"), ("F", None, "z")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.ingest_tales(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", lambda t: seen.append(t.count())).awaitTermination()
    assert seen == [4, 5] and ingest.tales_at(spark, f"{tmp_path}/out").where("tale_id = 'A'").first().title == "Changed"
    corpus(spark, [("A", "Once more", "x")]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    ingest.ingest_tales(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", compact_every=3).awaitTermination()
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == ["base=2"]
    assert {r.tale_id: r.title for r in ingest.tales_at(spark, f"{tmp_path}/out").collect()}["A"] == "Once more" and ingest.tales_at(spark, f"{tmp_path}/out").count() == 5


def test_streamed_counts(spark, tmp_path):
    log = spark.sql("SELECT id AS log_id, timestamp_seconds(3600000 + id * 1000) AS created_at, 'vsm' AS query_mode FROM range(10) UNION ALL SELECT 3, timestamp_seconds(3603000), 'vsm'")
    log.write.parquet(f"{tmp_path}/log")
    counts = ingest.run_once(ingest.log_counts(ingest.log_stream(spark, f"{tmp_path}/log", log.schema)))
    assert sorted(r.requests for r in counts.collect()) == [2, 4, 4]
    (tmp_path / "none").mkdir()
    assert ingest.run_once(ingest.log_counts(ingest.log_stream(spark, f"{tmp_path}/none", log.schema))).count() == 0


def test_core_without_the_optional_subpackage():
    root = Path(__file__).parents[1]
    code = "import sys; sys.modules['quillon.llm'] = None; import __spark_entry__ as e; assert 'bm25_topk' in e.queries() and not any(n.startswith('p1_') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    for path in (root / "quillon").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quillon.llm" not in path.read_text(), path
