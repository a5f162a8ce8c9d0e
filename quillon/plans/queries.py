"""Named queries over the test tables, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import STOPWORDS, analyze
from quillon.operators import bm25, boolean, catalog, divergence, evaluation, feedback, language, lexicon, spelling, vsm
from quillon.operators import index as ix
from quillon import build
from quillon.plans.checkpoints import checkpointed, shared_folder
from quillon.plans.service import Engine
from quillon.sources import corpus as src
from quillon.sources.tables import table
from quillon.streaming import ingest

_opened: dict[tuple, ix.Index] = {}
_lexicons: dict[tuple, DataFrame] = {}

QUERY = "jackal and the famine of the merchant"
TYPE = "tt-0018"


def tales(spark: SparkSession, d: str) -> DataFrame:
    """Accepted tales, the latest row of each tale_id."""
    return src.accept(src.latest(table(spark, d, "tales"))).rows


def index(spark: SparkSession, d: str) -> ix.Index:
    """The index of a directory's tales, built once in an application."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _opened:
        _opened[key] = ix.build_index(tales(spark, d))
    return _opened[key]


def lexicon_of(spark: SparkSession, d: str) -> DataFrame:
    """(form, lemma) by the rules of endings, with the collection's own words as the dictionary."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _lexicons:
        words = index(spark, d).term_stats.select("term")
        _lexicons[key] = checkpointed(lexicon.build_lexicon(words.withColumnRenamed("term", "form"), words.withColumnRenamed("term", "lemma")))
    return _lexicons[key]


def lemma_index(spark: SparkSession, d: str) -> ix.Index:
    """The index by lemmas, built once in an application."""
    key = (spark.sparkContext.applicationId, d, "lemmas")
    if key not in _opened:
        _opened[key] = ix.build_index(tales(spark, d), lexicon_of(spark, d))
    return _opened[key]


def engine(spark: SparkSession, d: str) -> Engine:
    return Engine(index(spark, d))


def lemma_engine(spark: SparkSession, d: str) -> Engine:
    return Engine(lemma_index(spark, d), lexicon_of(spark, d))


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/quillon-query-{uuid.uuid4().hex}"


def as_json_files(spark: SparkSession, d: str) -> str:
    """The tales as JSON files of about a thousand, an array in each, in ingest order by name."""
    path = f"{new_folder(spark)}.json"
    rows = table(spark, d, "tales").select(F.format_string("%012d", F.floor(F.col("doc_seq") / 1000)).alias("block"), F.struct("doc_seq", F.struct(*src.FIELDS).alias("tale")).alias("r"))
    arrays = rows.groupBy("block").agg(F.to_json(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["tale"])).alias("value"))
    arrays.write.partitionBy("block").text(path)
    return path


def searched(spark: SparkSession, answer: dict) -> DataFrame:
    """Results of one search of the engine, at most its top_k."""
    return spark.createDataFrame([(answer["mode"], r["doc_id"], r["score"]) for r in answer["results"]], "mode string, doc_id string, score double")


def reloaded(spark: SparkSession, d: str) -> ix.Index:
    """The index saved, and opened from its files."""
    path = new_folder(spark)
    ix.save(index(spark, d), path)
    return ix.load(spark, path, tales(spark, d))


def synonyms(spark: SparkSession, d: str) -> DataFrame:
    """A table of synonyms in the form of the lexicon, from the motifs of the tale types: what stands before a noun, by place and type."""
    motifs = table(spark, d, "tale_types").select("tale_type_id", F.posexplode("key_motifs").alias("synset_rank", "motif")).where("motif IS NOT NULL")
    word = F.split("motif", " ")
    number = F.regexp_extract("tale_type_id", r"(\d+)$", 1).cast("int")
    return motifs.where(F.size(word) == 2).select(word[1].alias("term"), F.lit("n").alias("pos"), "synset_rank", number.alias("lemma_rank"), word[0].alias("synonym"))


def expanded(spark: SparkSession, d: str) -> DataFrame:
    found = lexicon.expansions(synonyms(spark, d), list(NOUNS), index(spark, d).term_stats)
    return spark.createDataFrame([(t, k, w) for t, ws in found.items() for k, w in enumerate(ws)], "term string, place int, synonym string")


def parse_outcomes(spark: SparkSession) -> DataFrame:
    def outcome(q: str) -> str:
        try:
            return str(len(boolean.matched_stems(q))) if boolean.parse(q) else ""
        except boolean.BooleanParseError as e:
            return str(e)

    return spark.createDataFrame([(q, outcome(q)) for q in BROKEN], "query string, outcome string")


def appended_log(spark: SparkSession, d: str) -> DataFrame:
    """The log's entries of known kinds, added to a new log in two lots."""
    path, log = new_folder(spark), catalog.delivered_once(table(spark, d, "query_log")).where(F.col("query_mode").isin(*catalog.QUERY_MODES))
    for late in (False, True):
        catalog.append_log(log.where((F.col("received_at") > F.col("created_at")) == F.lit(late)), path)
    return spark.read.parquet(path)


def staleness(spark: SparkSession, d: str) -> DataFrame:
    """Whether a stored index opens for the corpus it was built from, for the same rows in other files, and for fewer rows."""
    path, rows = new_folder(spark), tales(spark, d)
    ix.save(index(spark, d), path)
    cases = {"same": rows, "copied": checkpointed(rows), "fewer": rows.where("tradition <> 'Unknown'")}
    return spark.createDataFrame([(k, ix.load(spark, path, v) is not None) for k, v in cases.items()], "corpus string, opens boolean")


def rebuilt(spark: SparkSession, d: str) -> DataFrame:
    stats = Engine.rebuild(spark, new_folder(spark), [f"{d}/tales.parquet", f"{d}/none.json"])
    return spark.createDataFrame([(stats["documents_ingested"], stats["skipped"], stats["terms_indexed"], len(stats["errors"]))], "documents bigint, skipped bigint, terms bigint, errors int")


def renamed(spark: SparkSession, d: str) -> DataFrame:
    """Tales without a tradition updated with one, and one new tale inserted."""
    rows = src.latest(table(spark, d, "tales")).select("tale_id", "region", "tradition")
    changed = rows.where("tradition IS NULL").withColumn("tradition", F.lit("of no tradition"))
    new = spark.createDataFrame([("NEW-1", None, "new")], rows.schema)
    return src.insert(src.update(rows, changed, "tale_id"), new, "tale_id")


NOUNS = ("deer", "road", "king", "tail", "thief", "lamp")
BROKEN = ("jackal AND (lamp", "jackal AND", "OR jackal", "the AND lamp", "jackal)", "", "NOT", "(jackal lamp) NOT king")
QUESTIONS = {"nl_boolean": "find tales about jackal but not lamp", "nl_fallback": "jackal but not the jackal and merchant", "nl_vsm": "tell me about the famine of the merchant"}


def joined(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


def scores(rows: DataFrame, *extra: str) -> DataFrame:
    return rows.select("doc_id", "score", *extra)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "bm25_topk": lambda s, d: scores(bm25.bm25_search(index(s, d), QUERY)),
    "bm25_params_filters": lambda s, d: scores(bm25.bm25_search(index(s, d), QUERY, 20, k1=1.2, b=0.5, title_boost=3.0, collection="papers", region="coast")),
    "bm25_terms_matched": lambda s, d: bm25.bm25_search(index(s, d), QUERY, 25).select("doc_id", joined("terms_matched")),
    "vsm_topk": lambda s, d: scores(vsm.vsm_search(index(s, d), QUERY)),
    "vsm_zone_weights": lambda s, d: scores(vsm.vsm_search(index(s, d), QUERY, 20, 0.35, 0.65)),
    "vsm_filters": lambda s, d: scores(vsm.vsm_search(index(s, d), QUERY, 20, collection="fables", region="uplands")),
    "vsm_expansion": lambda s, d: vsm.vsm_search(index(s, d), QUERY, 20, expansions={"drought": 0.3, "trader": 0.3, "famine": 0.9}).select("doc_id", "score", joined("terms_matched"), joined("expansions_matched")),
    "boolean_and": lambda s, d: scores(boolean.boolean_search(index(s, d), "jackal and famine")),
    "boolean_or": lambda s, d: scores(boolean.boolean_search(index(s, d), "jackal OR crocodile")),
    "boolean_not": lambda s, d: scores(boolean.boolean_search(index(s, d), "NOT lamp")),
    "boolean_nested": lambda s, d: scores(boolean.boolean_search(index(s, d), "(jackal OR lion) AND NOT (lamp famine) OR one-eyed crocodile")),
    "boolean_juxtaposed": lambda s, d: scores(boolean.boolean_search(index(s, d), "jackal NOT lamp (merchant OR king)")),
    "boolean_filtered": lambda s, d: scores(boolean.boolean_search(index(s, d), "lamp", {"region": "coast", "tradition": "cycle"})),
    "rocchio_explicit": lambda s, d: scores(feedback.rocchio(index(s, d), QUERY, judged(s, d, 0), judged(s, d, 1))),
    "prf": lambda s, d: scores(feedback.pseudo_feedback(index(s, d), QUERY)),
    "doc_norms": lambda s, d: index(s, d).norms(2.0, 1.0).select("doc_id", F.round("norm", 6).alias("norm")),
    "doc_norms_plain": lambda s, d: index(s, d).norms().select("doc_id", F.round("norm", 6).alias("norm")),
    "document_vector": lambda s, d: index(s, d).document_vector(*judged(s, d, 0)).select("doc_id", "term", F.round("weight", 6).alias("weight")),
    "tokenize_tales": lambda s, d: tales(s, d).select(F.col("tale_id").alias("doc_id"), F.array_join(analyze(F.col("title")), " ").alias("title"), F.array_join(analyze(F.col("raw_text")), " ").alias("body")),
    "postings_build": lambda s, d: index(s, d).postings.select("term", "doc_id", "tf", "tf_title", "tf_body", "df", joined("positions")),
    "zone_positions": lambda s, d: index(s, d).postings.select("term", "doc_id", joined("title_positions"), joined("body_positions")),
    "term_stats": lambda s, d: index(s, d).term_stats,
    "postings_of_terms": lambda s, d: index(s, d).of_terms(["jackal", "famine"]).select("term", "doc_id", "tf"),
    "top_terms_cf": lambda s, d: ix.top_terms(index(s, d)),
    "doc_registry_snippets": lambda s, d: index(s, d).registry.select("doc_id", "title", "tale_type", "region", "tradition", "source_collection", "translator", "collection_era", "token_count", "snippet"),
    "tale_type_registry": lambda s, d: ix.tale_types(index(s, d)),
    "largest_tale_type": lambda s, d: catalog.largest_type(ix.tale_types(index(s, d))),
    "variants_by_type": lambda s, d: ix.variants(index(s, d), TYPE).select("doc_id", "title"),
    "documents_by_tradition": lambda s, d: ix.counts_by(index(s, d), "tradition"),
    "index_status": lambda s, d: ix.status(index(s, d)),
    "corpus_fingerprint": lambda s, d: s.createDataFrame([(src.fingerprint(tales(s, d)),)], "fingerprint string"),
    "rejected_rows": lambda s, d: src.accept(src.latest(table(s, d, "tales"))).rejected.groupBy("reason").agg(F.count("*").alias("rows")),
    "upsert_latest": lambda s, d: src.latest(table(s, d, "tales")).select("tale_id", "doc_seq", "region"),
    "upsert_tales": lambda s, d: upserted(s, d).select("tale_id", "doc_seq"),
    "eval_per_query": lambda s, d: evaluation.rounded(evaluation.evaluate(index(s, d), table(s, d, "qrels"))),
    "eval_summary": lambda s, d: evaluation.macro_average(evaluation.evaluate(index(s, d), table(s, d, "qrels"))),
    "eval_pivot": lambda s, d: evaluation.pivoted(evaluation.rounded(evaluation.evaluate(index(s, d), table(s, d, "qrels")))),
    "eval_best_mode": lambda s, d: evaluation.best_mode(evaluation.macro_average(evaluation.evaluate(index(s, d), table(s, d, "qrels")))).select("mode", "map"),
    "phantom_qrels": lambda s, d: evaluation.phantoms(evaluation.current(table(s, d, "qrels")), index(s, d)),
    "qrels_current": lambda s, d: evaluation.current(table(s, d, "qrels")).select("query_id", "query_text", F.size("judgments").alias("judgments")),
    "judgments": lambda s, d: evaluation.judgments(evaluation.current(table(s, d, "qrels"))).select("query_id", "doc_id", "grade", F.col("relevant").cast("int").alias("relevant")),
    "divergence_matrix": lambda s, d: divergence.matrix(index(s, d), TYPE).select("doc_a", "doc_b", "cosine", "jaccard", "overlap"),
    "divergence_summary": lambda s, d: divergence.summary(index(s, d), TYPE),
    "divergence_heat": lambda s, d: divergence.heat_counts(index(s, d), TYPE),
    "divergence_nearest": lambda s, d: divergence.nearest_variants(index(s, d), TYPE).select("doc_id", "other", "cosine", "place"),
    "centroid_top_terms": lambda s, d: divergence.centroid_terms(index(s, d), TYPE),
    "spelling_corrections": lambda s, d: spelling.corrections(log_terms(s, d), index(s, d).term_stats),
    "nl_batch_entities": lambda s, d: language.batch_entities(table(s, d, "query_log")).select("log_id", "mode", "tradition", "region", "tale_type"),
    "synonym_expansion": expanded,
    "lexicon_lemmas": lexicon_of,
    "lemma_postings": lambda s, d: lemma_index(s, d).postings.select("term", "doc_id", "tf", "tf_title", "df", joined("positions")),
    "lemma_bm25": lambda s, d: searched(s, lemma_engine(s, d).search_bm25("the stolen lamp was found")),
    "lemma_vsm": lambda s, d: searched(s, lemma_engine(s, d).search_vsm("the stolen lamp was found")),
    "nl_boolean": lambda s, d: searched(s, engine(s, d).search_question(QUESTIONS["nl_boolean"])),
    "nl_fallback": lambda s, d: searched(s, engine(s, d).search_question(QUESTIONS["nl_fallback"])),
    "nl_vsm": lambda s, d: searched(s, engine(s, d).search_question(QUESTIONS["nl_vsm"])),
    "corrected_queries": lambda s, d: spelling.correct_queries(table(s, d, "query_log").select("log_id", "received_at", "query_text"), index(s, d).term_stats, analyze(F.col("query_text"))).where("corrected IS NOT NULL").select("query_text", "corrected").distinct(),
    "nl_corrected": lambda s, d: searched(s, engine(s, d).search_question("find tales about jackel and merchnt", auto_correct=True)),
    "api_boolean": lambda s, d: searched(s, engine(s, d).search_boolean("jackal OR crocodile", skip=5, limit=10)),
    "api_bm25": lambda s, d: searched(s, engine(s, d).search_bm25(QUERY, 20, 1.2, 0.5, 3.0, "papers", "coast")),
    "api_vsm": lambda s, d: searched(s, engine(s, d).search_vsm(QUERY, 20)),
    "api_feedback": lambda s, d: searched(s, engine(s, d).feedback(QUERY, judged(s, d, 0), judged(s, d, 1))),
    "api_prf": lambda s, d: searched(s, engine(s, d).pseudo_feedback(QUERY)),
    "sample_phantoms": lambda s, d: evaluation.phantoms(evaluation.sample_qrels(s), index(s, d)),
    "index_staleness": staleness,
    "index_rebuilt": rebuilt,
    "updated_tales": renamed,
    "boolean_matched": lambda s, d: boolean.boolean_search(index(s, d), "jackal OR NOT (lamp famine)").select("doc_id", joined("terms_matched")),
    "boolean_errors": lambda s, d: parse_outcomes(s),
    "local_rerank": lambda s, d: feedback.local_rerank(bm25.bm25_search(index(s, d), QUERY, 20), judged(s, d, 0), judged(s, d, 1)).select("doc_id", F.round("score", 6).alias("score")),
    "index_reloaded": lambda s, d: scores(bm25.bm25_search(reloaded(s, d), QUERY)),
    "engine_health": lambda s, d: s.createDataFrame([engine(s, d).health(tales(s, d))], "status string, documents bigint, index_stale boolean"),
    "eval_judged_subset": lambda s, d: evaluation.rounded(evaluation.evaluate(index(s, d), table(s, d, "qrels"), query_ids=["Q-0000002", "Q-0000003"])),
    "log_appended": lambda s, d: appended_log(s, d).groupBy("query_mode").agg(F.count("*").alias("entries"), F.countDistinct("log_id").alias("ids")),
    "json_ingest": lambda s, d: src.accept(src.latest(src.read_json(s, as_json_files(s, d)), "tale_id", "doc_seq")).rows.select("doc_seq", "tale_id", "title", "region", "tradition"),
    "build_two_sources": lambda s, d: build.ingest(s, [as_json_files(s, d), f"{d}/tales.parquet"])[0].rows.select("tale_id", "region", "tradition", "source_collection"),
    "metadata_list_regex": lambda s, d: catalog.list_tales(table(s, d, "tales"), tradition="^riddles|cycle$", region="coast").select("doc_seq", "tale_id", "tradition", "region"),
    "metadata_page": lambda s, d: catalog.page(catalog.list_tales(table(s, d, "tales"), tradition="cycle"), 20, 20)[0].select("doc_seq", "tale_id"),
    "tale_by_id": lambda s, d: catalog.by_key(tales(s, d), "tale_id", first_tale(s, d)).select("tale_id", "title", "tale_type"),
    "tale_types_list": lambda s, d: catalog.list_types(table(s, d, "tale_types")).select("tale_type_id", "atu_code", "canonical_title"),
    "variants_of_type": lambda s, d: catalog.variants_of(table(s, d, "tales"), "TT-0018").select("doc_seq", "tale_id", "tradition"),
    "qrels_list": lambda s, d: catalog.list_qrels(table(s, d, "qrels")).select("query_id", "query_text", F.size("judgments").alias("judgments")),
    "browse_types": lambda s, d: catalog.browse_types(table(s, d, "tales"), table(s, d, "tale_types"), "the", "cycle").select("tale_type_id"),
    "clean_results": lambda s, d: catalog.clean_results(bm25.bm25_search(index(s, d), QUERY, 50)).select("doc_id", "title", "region", "tradition"),
    "query_log_latest": lambda s, d: catalog.latest_log(table(s, d, "query_log")).select("log_id", "query_text", "query_mode"),
    "query_log_latency": lambda s, d: catalog.latency_by_mode(table(s, d, "query_log")),
    "query_log_delivered_once": lambda s, d: catalog.delivered_once(table(s, d, "query_log")).select("log_id", "session_id", "query_mode", F.unix_micros("received_at").alias("received")),
    "streamed_log_counts": lambda s, d: ingest.run_once(ingest.log_counts(ingest.log_stream(s, f"{d}/query_log.parquet*", table(s, d, "query_log").schema))).select(F.unix_micros("start").alias("start"), "query_mode", "requests"),
}


def judged(spark: SparkSession, d: str, part: int) -> list[str]:
    """Three documents for feedback: the first by id (0), or the next (1)."""
    rows = index(spark, d).of_terms(["jackal"]).where("tf_body > 0").select("doc_id").orderBy("doc_id").offset(3 * part).limit(3).collect()
    return [r.doc_id for r in rows]


def first_tale(spark: SparkSession, d: str) -> str:
    return table(spark, d, "tales").agg(F.min("tale_id")).first()[0]


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """Later entries of tales put in place of earlier ones: rows that repeat a tale_id, over the first rows."""
    rows = table(spark, d, "tales").where("tale_id IS NOT NULL")
    first = rows.join(rows.groupBy("tale_id").agg(F.min("doc_seq").alias("doc_seq")), ["tale_id", "doc_seq"], "left_semi")
    later = src.latest(rows.join(first.select("doc_seq"), "doc_seq", "left_anti"))
    return src.upsert(first, later)


def log_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_log").select(F.explode(analyze(F.col("query_text"))).alias("term")).distinct()


# --- the same as SQL --------------------------------------------------------

_STOPS = ", ".join(f"'{w}'" for w in STOPWORDS)


def _terms(x: str) -> str:
    return (
        f"list_filter(regexp_extract_all(replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[''’]s([^\\p{{L}}\\p{{N}}_]|$)', '\\1', 'g'), "
        f"'[''’]([\\p{{L}}\\p{{N}}_])', '\\1', 'g'), '-', ' '), '[\\p{{L}}\\p{{N}}_]+'), "
        f"lambda w: regexp_full_match(w, '[a-z]+') AND length(w) > 1 AND w NOT IN ({_STOPS}))"
    )


BASE = f"""WITH last AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tale_id ORDER BY updated_at DESC NULLS LAST, doc_seq DESC) AS rn FROM tales WHERE tale_id IS NOT NULL) WHERE rn = 1),
corpus AS (SELECT tale_id AS doc_id, doc_seq, title, raw_text, coalesce(tale_type, 'UNKNOWN') AS tale_type, coalesce(region, 'Unknown Region') AS region,
    coalesce(tradition, 'Unknown') AS tradition, coalesce(source_collection, '') AS source_collection, coalesce(translator, '') AS translator, coalesce(collection_era, '') AS collection_era
  FROM last WHERE title IS NOT NULL AND raw_text IS NOT NULL),
toks AS (SELECT *, {_terms('title')} AS tt, {_terms('raw_text')} AS bt FROM corpus),
reg AS (SELECT *, len(tt) + len(bt) AS token_count FROM toks),
occ AS (SELECT doc_id, doc_seq, len(tt) AS nt, unnest(list_concat(tt, bt)) AS term, unnest(range(len(tt) + len(bt))) AS pos FROM toks),
pairs AS (SELECT term, doc_id, doc_seq, count(*) AS tf, count(*) FILTER (pos < nt) AS tf_title, count(*) FILTER (pos >= nt) AS tf_body, list_sort(list(pos)) AS positions, any_value(nt) AS nt FROM occ GROUP BY term, doc_id, doc_seq),
dfs AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM pairs GROUP BY term),
tot AS (SELECT count(*)::DOUBLE AS n, sum(token_count)::DOUBLE / count(*) FILTER (token_count > 0) AS avgdl FROM reg),
post AS (SELECT p.*, d.df, tot.n, tot.avgdl, ln(1 + tot.n / d.df) AS idf, ln(1 + (tot.n - d.df + 0.5) / (d.df + 0.5)) AS bidf,
    1 + ln(p.tf) AS st, CASE WHEN tf_title > 0 THEN 1 + ln(tf_title) ELSE 0 END AS s_title, CASE WHEN tf_body > 0 THEN 1 + ln(tf_body) ELSE 0 END AS s_body
  FROM pairs p JOIN dfs d USING (term) CROSS JOIN tot)
"""


def _q(sql: str, *ctes: str) -> str:
    return BASE + "".join(f", {c}\n" for c in ctes) + sql


def _asked(*terms: str) -> str:
    values = ", ".join(f"({i}, '{t}', {terms.count(t)})" for i, t in enumerate(dict.fromkeys(terms)))
    return f"qt AS (SELECT * FROM (VALUES {values}) t(ord, term, qtf))"


_TERMS = _asked("jackal", "famine", "merchant")


def _asking(ctes: tuple[str, ...], *terms: str) -> tuple[str, ...]:
    """The same steps for other terms."""
    return (_asked(*terms), *ctes[1:])


def _vsm(title: float, body: float, k: int, where: str = "TRUE", extra: str = "") -> tuple[str, ...]:
    return (
        _TERMS,
        f"qv AS (SELECT ord, term, (1 + ln(qtf)) * ln(1 + n / df) AS q FROM qt JOIN dfs USING (term) CROSS JOIN tot {extra})",
        f"norms AS (SELECT doc_id, sqrt(sum(power(({title} * s_title + {body} * s_body) * idf, 2))) AS norm FROM post GROUP BY doc_id HAVING sum(power(({title} * s_title + {body} * s_body) * idf, 2)) > 0)",
        "ql_ AS (SELECT sqrt(sum(q * q)) AS qn FROM qv)",
        f"""vsm AS (SELECT p.doc_id, sum(q * ({title} * s_title + {body} * s_body) * idf) / (any_value(qn) * any_value(norm)) AS exact, min(ord) AS first, any_value(r.doc_seq) AS doc_seq,
          array_to_string(list(p.term ORDER BY ord), ',') AS terms_matched, list(p.term) AS terms
        FROM post p JOIN qv USING (term) JOIN norms USING (doc_id) JOIN reg r USING (doc_id) CROSS JOIN ql_ WHERE {where} GROUP BY p.doc_id ORDER BY round(exact, 10) DESC, first, doc_seq LIMIT {k})""",
    )


def _bm25(k1: float, b: float, boost: float, k: int, where: str = "TRUE") -> tuple[str, ...]:
    return (
        _TERMS,
        f"""bm AS (SELECT p.doc_id, sum(bidf * (tf_body + {boost} * tf_title) * ({k1} + 1) / (tf_body + {boost} * tf_title + {k1} * (1 - {b} + {b} * r.token_count / avgdl))) AS exact, min(ord) AS first,
          any_value(r.doc_seq) AS doc_seq, array_to_string(list(p.term ORDER BY p.term), ',') AS terms_matched
        FROM post p JOIN qt USING (term) JOIN reg r USING (doc_id) WHERE {where} GROUP BY p.doc_id ORDER BY round(exact, 10) DESC, first, doc_seq LIMIT {k})""",
    )


def _boolean(stems: list[str], holds: str, where: str = "TRUE") -> str:
    flags = ", ".join(f"coalesce(bool_or(p.term = '{t}'), FALSE) AS {t}_" for t in stems)
    listed = ", ".join(f"'{t}'" for t in stems)
    return _q(
        f"SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM hits WHERE {holds}",
        f"hits AS (SELECT r.doc_id, {flags}, sum(st * idf) AS score FROM reg r LEFT JOIN (SELECT * FROM post WHERE term IN ({listed})) p USING (doc_id) WHERE {where} GROUP BY r.doc_id)",
    )


_JUDGED = "ids AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM post WHERE term = 'jackal' AND tf_body > 0)"
_PLAIN = "pn AS (SELECT doc_id, sqrt(sum(power(st * idf, 2))) AS norm FROM post GROUP BY doc_id)"


def _rerank(relevant: str, gamma: str | None) -> tuple[str, ...]:
    non = f"UNION ALL SELECT term, -0.15 * sum(st * idf) / 3 FROM post WHERE doc_id IN ({gamma}) GROUP BY term" if gamma else ""
    return (
        f"""qm AS (SELECT term, sum(w) AS q FROM (
          SELECT term, (1 + ln(qtf)) * ln(1 + n / df) AS w FROM qt JOIN dfs USING (term) CROSS JOIN tot
          UNION ALL SELECT term, 0.75 * sum(st * idf) / 3 FROM post WHERE doc_id IN ({relevant}) GROUP BY term {non}) GROUP BY term HAVING sum(w) > 0)""",
        _PLAIN,
        "qn_ AS (SELECT sqrt(sum(q * q)) AS qn FROM qm)",
        "re AS (SELECT doc_id, sum(q * st * idf) / (any_value(qn) * any_value(norm)) AS exact FROM post JOIN qm USING (term) JOIN pn USING (doc_id) CROSS JOIN qn_ GROUP BY doc_id ORDER BY round(exact, 10) DESC, doc_id DESC LIMIT 10)",
    )


_CURRENT = "cq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY created_at DESC NULLS LAST) AS k FROM qrels) WHERE k = 1)"
_ROWS = "jr AS (SELECT query_id, place, j.tale_id AS doc_id, j.relevance_score AS grade FROM (SELECT query_id, unnest(judgments) AS j, unnest(range(len(judgments))) AS place FROM cq) WHERE j.relevance_score BETWEEN 0 AND 3 AND j.tale_id IS NOT NULL)"
_GRADES = "jd AS (SELECT query_id, doc_id, arg_max(grade, place) AS grade, bool_or(grade >= 1) AS rel FROM jr GROUP BY ALL)"
_EVAL = (
    _CURRENT,
    "qs AS (SELECT DISTINCT query_id FROM cq)",
    f"qe AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_terms('query_text')}) AS term FROM cq) GROUP BY ALL)",
    _ROWS,
    _GRADES,
    "jk AS (SELECT jd.* FROM jd JOIN reg USING (doc_id))",
    _PLAIN,
    "zn AS (SELECT doc_id, sqrt(sum(power((2 * s_title + s_body) * idf, 2))) AS norm FROM post GROUP BY doc_id)",
    "wq AS (SELECT query_id, term, (1 + ln(qtf)) * ln(1 + n / df) AS q FROM qe JOIN dfs USING (term) CROSS JOIN tot)",
    "nq AS (SELECT query_id, sqrt(sum(q * q)) AS qn FROM wq GROUP BY query_id)",
    "v AS (SELECT query_id, doc_id, round(sum(q * (2 * s_title + s_body) * idf) / (any_value(qn) * any_value(norm)), 6) AS score FROM post JOIN wq USING (term) JOIN nq USING (query_id) JOIN zn USING (doc_id) GROUP BY ALL)",
    "vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM v)",
    "bq AS (SELECT query_id, doc_id, round(sum(bidf * (tf_body + 1.5 * tf_title) * 2.5 / (tf_body + 1.5 * tf_title + 1.5 * (0.25 + 0.75 * token_count / avgdl))), 6) AS score FROM post JOIN qe USING (term) JOIN (SELECT doc_id, token_count FROM reg) USING (doc_id) GROUP BY ALL)",
    "ba AS (SELECT query_id, doc_id, round(sum(st * idf), 6) AS score FROM post JOIN qe USING (term) GROUP BY ALL HAVING count(*) = any_value((SELECT count(*) FROM qe q2 WHERE q2.query_id = qe.query_id)))",
    "fb AS (SELECT query_id, doc_id, count(*) OVER (PARTITION BY query_id) AS m FROM vr WHERE rank <= 3)",
    "qm AS (SELECT query_id, term, sum(w) AS q FROM (SELECT query_id, term, q AS w FROM wq WHERE query_id IN (SELECT query_id FROM fb) UNION ALL SELECT query_id, term, 0.75 * st * idf / m FROM post JOIN fb USING (doc_id)) GROUP BY ALL)",
    "nm AS (SELECT query_id, sqrt(sum(q * q)) AS qn FROM qm GROUP BY query_id)",
    "rq AS (SELECT query_id, doc_id, round(sum(q * st * idf) / (any_value(qn) * any_value(norm)), 6) AS score FROM post JOIN qm USING (term) JOIN nm USING (query_id) JOIN pn USING (doc_id) GROUP BY ALL)",
    """runs AS (SELECT *, row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT 'vsm' AS mode, query_id, doc_id, score FROM v UNION ALL SELECT 'bm25', * FROM bq UNION ALL SELECT 'boolean', * FROM ba UNION ALL SELECT 'vsm_rocchio', * FROM rq))""",
    "gr AS (SELECT r.*, grade, CASE WHEN rel THEN 1 ELSE 0 END AS hit FROM runs r LEFT JOIN jk USING (query_id, doc_id) WHERE rank <= 20 OR mode = 'boolean')",
    "gh AS (SELECT *, sum(hit) OVER (PARTITION BY mode, query_id ORDER BY rank) AS hits FROM gr)",
    """sm AS (SELECT mode, query_id, count(*) AS found, sum(hit) AS hit, sum(CASE WHEN hit = 1 THEN hits / rank ELSE 0 END) AS ap, sum(CASE WHEN rank <= 10 AND grade IS NOT NULL THEN (power(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg,
        sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) AS h5, sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) AS h10 FROM gh GROUP BY mode, query_id)""",
    """idl AS (SELECT query_id, sum(CASE WHEN k <= 10 THEN (power(2, grade) - 1) / log2(k + 1) ELSE 0 END) AS ideal, count(*) FILTER (rel) AS relevant
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS k FROM jk) GROUP BY query_id)""",
    """pq AS (SELECT mode, query_id, coalesce(found, 0) AS found, coalesce(hit, 0) AS hit, coalesce(ap, 0) AS ap, coalesce(dcg, 0) AS dcg, coalesce(h5, 0) AS h5, coalesce(h10, 0) AS h10, coalesce(ideal, 0) AS ideal, coalesce(relevant, 0) AS relevant,
        CASE WHEN found > 0 THEN hit / found ELSE 0 END AS pr, CASE WHEN relevant > 0 AND hit > 0 THEN hit / relevant ELSE 0 END AS rc
        FROM qs CROSS JOIN (VALUES ('boolean'), ('vsm'), ('bm25'), ('vsm_rocchio')) m(mode) LEFT JOIN sm USING (mode, query_id) LEFT JOIN idl USING (query_id))""",
    """ex AS (SELECT mode, query_id, h5 / 5 AS p_5, h10 / 10 AS p_10, pr AS "precision", rc AS recall, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1,
        CASE WHEN relevant > 0 THEN ap / relevant ELSE 0 END AS ap, CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END AS ndcg FROM pq)""",
    'ev AS (SELECT mode, query_id, round(p_5, 4) AS p_5, round(p_10, 4) AS p_10, round("precision", 4) AS "precision", round(recall, 4) AS recall, round(f1, 4) AS f1, round(ap, 4) AS ap, round(ndcg, 4) AS ndcg FROM ex)',
)
_SUMMARY = 'su AS (SELECT mode, count(*) AS queries, round(avg(p_5), 4) AS p_5, round(avg(p_10), 4) AS p_10, round(avg("precision"), 4) AS "precision", round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1, round(avg(ap), 4) AS map, round(avg(ndcg), 4) AS ndcg FROM ex GROUP BY mode)'
_DIV = (
    f"dv AS (SELECT doc_id, doc_seq FROM reg WHERE lower(tale_type) = '{TYPE}')",
    "dw AS (SELECT doc_id, term, st * idf AS w FROM post WHERE doc_id IN (SELECT doc_id FROM dv))",
    "dn AS (SELECT dv.doc_id, dv.doc_seq, coalesce(sqrt(sum(w * w)), 0) AS norm, count(term) AS t FROM dv LEFT JOIN dw USING (doc_id) GROUP BY ALL)",
    "ds AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, sum(a.w * b.w) AS dot, count(*) AS shared FROM dw a JOIN dw b ON a.term = b.term AND a.doc_id <> b.doc_id GROUP BY ALL)",
    """dp AS (SELECT a.doc_seq AS seq_a, b.doc_seq AS seq_b, a.doc_id AS doc_a, b.doc_id AS doc_b, CASE WHEN a.norm * b.norm > 0 THEN coalesce(dot, 0) / (a.norm * b.norm) ELSE 0 END AS cosine,
        CASE WHEN a.t + b.t - coalesce(shared, 0) > 0 THEN coalesce(shared, 0) / (a.t + b.t - coalesce(shared, 0)) ELSE 0 END AS jaccard
      FROM dn a JOIN dn b ON a.doc_seq < b.doc_seq LEFT JOIN ds ON ds.doc_a = a.doc_id AND ds.doc_b = b.doc_id)""",
)


def _entities() -> str:
    text = "lower(trim(coalesce(query_text, '')))"
    for i, pattern in enumerate(language.FILLERS):
        text = f"trim(regexp_replace({text}, '{pattern}', '{'' if i < 3 else ' '}', 'g'))"
    text = f"regexp_replace({text}, '\\s{{2,}}', ' ', 'g')"
    case = lambda pairs: "CASE " + " ".join(f"WHEN {a} THEN '{b}'" for a, b in pairs) + " END"
    return f"""WITH q AS (SELECT log_id, coalesce(query_text, '') AS raw, {text} AS t FROM query_log)
      SELECT log_id, CASE WHEN regexp_matches(t, '{"|".join(language.CONNECTIVES)}') OR regexp_matches(raw, '\\b(AND|OR|NOT)\\b') OR regexp_matches(raw, '\\([^)]+\\)') THEN 'boolean' ELSE 'vsm' END AS mode,
        {case((f"contains(t, '{k}')", v) for k, v in language.TRADITIONS.items())} AS tradition, {case((f"contains(t, '{k}')", v) for k, v in language.REGIONS.items())} AS region,
        {case((f"regexp_matches(t, 'atu[\\s-]?{n}')", f"ATU-{n}") for n in language.TYPE_NUMBERS)} AS tale_type FROM q"""


_NEAR = (
    f"lt AS (SELECT DISTINCT term FROM (SELECT unnest({_terms('query_text')}) AS term FROM query_log) WHERE length(term) >= 3 AND term NOT IN (SELECT term FROM dfs))",
    "near AS (SELECT lt.term, d.term AS word, levenshtein(lt.term, d.term) AS distance FROM lt JOIN dfs d ON abs(length(lt.term) - length(d.term)) <= 2 WHERE levenshtein(lt.term, d.term) <= 2)",
)


#: The columns of the accepted tales, by name, and what is hashed of them.
_DIGEST = sorted([*((c, c) for c in src.FIELDS if c != "tale_id"), ("tale_id", "doc_id"), ("doc_seq", "doc_seq::VARCHAR"), *((c, f"epoch_us({c})::VARCHAR") for c in ("created_at", "updated_at"))])


def _detached(source: str, endings) -> str:
    """Forms that the endings make of a word, the word itself first."""
    made = ", ".join(f"CASE WHEN ends_with({source}, '{a}') AND length({source}) > {len(a)} THEN left({source}, -{len(a)}) || '{b}' END" for a, b in endings)
    return f"[{source}, {made}]"


_LEXICON = (
    f"nc AS (SELECT term AS form, unnest({_detached('term', lexicon.NOUN_ENDINGS)}) AS lemma, unnest(range({len(lexicon.NOUN_ENDINGS) + 1})) AS k FROM dfs)",
    "no AS (SELECT form, arg_min(lemma, k) AS noun FROM nc WHERE lemma IN (SELECT term FROM dfs) GROUP BY form)",
    f"vc AS (SELECT form, unnest({_detached('noun', lexicon.VERB_ENDINGS)}) AS lemma, unnest(range({len(lexicon.VERB_ENDINGS) + 1})) AS k FROM no)",
    "ve AS (SELECT form, arg_min(lemma, k) AS verb FROM vc WHERE lemma IN (SELECT term FROM dfs) GROUP BY form)",
    "ir AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in lexicon.IRREGULAR.items()) + ") t(form, irregular))",
    "lexi AS (SELECT form, coalesce(irregular, verb) AS lemma FROM ve LEFT JOIN ir USING (form) WHERE coalesce(irregular, verb) <> form)",
)
#: The base again, with the terms of the occurrences replaced by their lemmas.
_TAIL = BASE[BASE.index("pairs AS") :]
LEMMA_BASE = (
    BASE[: BASE.index("pairs AS")] + "dfs0 AS (SELECT term, count(DISTINCT doc_id) AS df FROM occ GROUP BY term), " + ", ".join(_LEXICON).replace("dfs", "dfs0")
    + ", occ2 AS (SELECT doc_id, doc_seq, nt, coalesce(lemma, term) AS term, pos FROM occ LEFT JOIN lexi ON lexi.form = occ.term), " + _TAIL.replace("FROM occ GROUP", "FROM occ2 GROUP")
)

ORACLES: dict[str, str] = {
    "bm25_topk": _q("SELECT doc_id, round(exact, 6) AS score FROM bm", *_bm25(1.5, 0.75, 1.5, 10)),
    "bm25_params_filters": _q("SELECT doc_id, round(exact, 6) AS score FROM bm", *_bm25(1.2, 0.5, 3.0, 20, "contains(lower(source_collection), 'papers') AND contains(lower(region), 'coast')")),
    "bm25_terms_matched": _q("SELECT doc_id, terms_matched FROM bm", *_bm25(1.5, 0.75, 1.5, 25)),
    "vsm_topk": _q("SELECT doc_id, round(exact, 6) AS score FROM vsm", *_vsm(2.0, 1.0, 10)),
    "vsm_zone_weights": _q("SELECT doc_id, round(exact, 6) AS score FROM vsm", *_vsm(0.35, 0.65, 20)),
    "vsm_filters": _q("SELECT doc_id, round(exact, 6) AS score FROM vsm", *_vsm(2.0, 1.0, 20, "(contains(lower(source_collection), 'fables') OR contains(lower(tradition), 'fables')) AND contains(lower(region), 'uplands')")),
    "vsm_expansion": _q(
        "SELECT doc_id, round(exact, 6) AS score, terms_matched, array_to_string(list_sort(list_filter(terms, lambda x: x IN ('drought', 'trader', 'famine'))), ',') AS expansions_matched FROM vsm",
        *_vsm(2.0, 1.0, 20, extra="UNION ALL SELECT 3 + k, e.term, 0.3 * ln(1 + n / df) FROM (VALUES (0, 'drought'), (1, 'trader')) e(k, term) JOIN dfs USING (term) CROSS JOIN tot"),
    ),
    "boolean_and": _boolean(["jackal", "famine"], "jackal_ AND famine_"),
    "boolean_or": _boolean(["jackal", "crocodile"], "jackal_ OR crocodile_"),
    "boolean_not": _boolean(["lamp"], "NOT lamp_"),
    "boolean_nested": _boolean(["jackal", "lion", "lamp", "famine", "one", "eyed", "crocodile"], "(jackal_ OR lion_) AND NOT (lamp_ AND famine_) OR one_ AND eyed_ AND crocodile_"),
    "boolean_juxtaposed": _boolean(["jackal", "lamp", "merchant", "king"], "jackal_ AND NOT lamp_ AND (merchant_ OR king_)"),
    "boolean_filtered": _boolean(["lamp"], "lamp_", "contains(lower(region), 'coast') AND contains(lower(tradition), 'cycle')"),
    "rocchio_explicit": _q("SELECT doc_id, round(exact, 6) AS score FROM re", _TERMS, _JUDGED, *_rerank("SELECT doc_id FROM ids WHERE k <= 3", "SELECT doc_id FROM ids WHERE k BETWEEN 4 AND 6")),
    "prf": _q("SELECT doc_id, round(exact, 6) AS score FROM re", *_vsm(2.0, 1.0, 3), *_rerank("SELECT doc_id FROM vsm", None)),
    "doc_norms": _q("SELECT doc_id, round(sqrt(sum(power((2 * s_title + s_body) * idf, 2))), 6) AS norm FROM post GROUP BY doc_id"),
    "doc_norms_plain": _q("SELECT doc_id, round(norm, 6) AS norm FROM pn", _PLAIN),
    "document_vector": _q("SELECT doc_id, term, round(st * idf, 6) AS weight FROM post WHERE doc_id IN (SELECT doc_id FROM ids WHERE k <= 3)", _JUDGED),
    "tokenize_tales": _q("SELECT doc_id, array_to_string(tt, ' ') AS title, array_to_string(bt, ' ') AS body FROM toks"),
    "postings_build": _q("SELECT term, doc_id, tf::INT AS tf, tf_title::INT AS tf_title, tf_body::INT AS tf_body, df::INT AS df, array_to_string(positions, ',') AS positions FROM post"),
    "zone_positions": _q("SELECT term, doc_id, array_to_string(list_filter(positions, lambda x: x < nt), ',') AS title_positions, array_to_string(list_filter(positions, lambda x: x >= nt), ',') AS body_positions FROM post"),
    "term_stats": _q("SELECT term, df, cf FROM dfs"),
    "postings_of_terms": _q("SELECT term, doc_id, tf::INT AS tf FROM post WHERE term IN ('jackal', 'famine')"),
    "top_terms_cf": _q("SELECT term, df, cf FROM dfs ORDER BY cf DESC, term LIMIT 20"),
    "doc_registry_snippets": _q("SELECT doc_id, title, tale_type, region, tradition, source_collection, translator, collection_era, token_count::INT AS token_count, CASE WHEN length(raw_text) > 200 THEN substr(raw_text, 1, 200) || '…' ELSE raw_text END AS snippet FROM reg"),
    "tale_type_registry": _q("SELECT CASE WHEN tale_type = '' THEN 'UNKNOWN' ELSE tale_type END AS tale_type, count(*) AS variants FROM reg GROUP BY 1"),
    "largest_tale_type": _q("SELECT CASE WHEN tale_type = '' THEN 'UNKNOWN' ELSE tale_type END AS tale_type, count(*) AS variants FROM reg GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"),
    "variants_by_type": _q(f"SELECT doc_id, title FROM reg WHERE lower(tale_type) = '{TYPE}'"),
    "documents_by_tradition": _q("SELECT tradition, count(*) AS documents FROM reg GROUP BY 1"),
    "index_status": _q("SELECT (SELECT count(*) FROM reg) AS documents, (SELECT sum(token_count)::BIGINT FROM reg) AS tokens, (SELECT count(DISTINCT tale_type) FROM reg) AS tale_types, (SELECT count(DISTINCT tradition) FROM reg) AS traditions, (SELECT count(DISTINCT region) FROM reg) AS regions, (SELECT count(*) FROM dfs) AS terms, (SELECT count(*) FROM post) AS postings"),
    "rejected_rows": BASE + "SELECT 'missing fields: ' || concat_ws(', ', CASE WHEN title IS NULL THEN 'title' END, CASE WHEN raw_text IS NULL THEN 'raw_text' END) AS reason, count(*) AS rows FROM last WHERE title IS NULL OR raw_text IS NULL GROUP BY 1",
    "upsert_latest": BASE + "SELECT tale_id, doc_seq, region FROM last",
    "upsert_tales": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY tale_id ORDER BY doc_seq) AS k FROM tales WHERE tale_id IS NOT NULL) SELECT tale_id, arg_max(doc_seq, CASE WHEN k = 1 THEN NULL ELSE p END) AS doc_seq FROM (SELECT *, row_number() OVER (PARTITION BY tale_id, k > 1 ORDER BY updated_at NULLS FIRST, doc_seq) AS p FROM r) GROUP BY tale_id HAVING count(*) > 1 UNION ALL SELECT tale_id, min(doc_seq) FROM r GROUP BY tale_id HAVING count(*) = 1",
    "eval_per_query": _q("SELECT * FROM ev", *_EVAL),
    "eval_summary": _q("SELECT * FROM su", *_EVAL, _SUMMARY),
    "eval_pivot": _q("SELECT query_id, " + ", ".join(f"max({m}) FILTER (mode = '{mode}') AS {mode}_{m}" for mode in evaluation.MODES for m in ("ap", "ndcg")) + " FROM ev GROUP BY query_id", *_EVAL),
    "eval_best_mode": _q("SELECT mode, map FROM su ORDER BY map DESC, mode LIMIT 1", *_EVAL, _SUMMARY),
    "phantom_qrels": _q("SELECT query_id, count(*) AS dropped FROM jr WHERE doc_id NOT IN (SELECT doc_id FROM reg) GROUP BY query_id", _CURRENT, _ROWS),
    "qrels_current": _q("SELECT query_id, query_text, len(judgments)::INT AS judgments FROM cq", _CURRENT),
    "judgments": _q("SELECT query_id, doc_id, grade, rel::INT AS relevant FROM jd", _CURRENT, _ROWS, _GRADES),
    "divergence_matrix": _q("SELECT doc_a, doc_b, round(cosine, 4) AS cosine, round(jaccard, 4) AS jaccard, round(100 * jaccard, 2) AS overlap FROM dp", *_DIV),
    "divergence_summary": _q("SELECT count(*) AS pairs, round(avg(cosine), 4) AS mean, round(min(cosine), 4) AS least, round(max(cosine), 4) AS greatest, first(doc_a ORDER BY round(cosine, 4) DESC, seq_a, seq_b) AS similar_a, first(doc_b ORDER BY round(cosine, 4) DESC, seq_a, seq_b) AS similar_b, first(doc_a ORDER BY round(cosine, 4), seq_a, seq_b) AS divergent_a, first(doc_b ORDER BY round(cosine, 4), seq_a, seq_b) AS divergent_b FROM dp", *_DIV),
    "divergence_heat": _q("SELECT doc_a, heat, count(*) AS pairs FROM (SELECT doc_a, CASE WHEN round(cosine, 4) > 0.5 THEN 'high' WHEN round(cosine, 4) > 0.25 THEN 'mid' ELSE 'low' END AS heat FROM (SELECT doc_a, cosine FROM dp UNION ALL SELECT doc_b, cosine FROM dp)) GROUP BY ALL", *_DIV),
    "divergence_nearest": _q("SELECT * FROM (SELECT doc_id, other, cosine, row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, other)::INT AS place FROM (SELECT doc_a AS doc_id, doc_b AS other, round(cosine, 6) AS cosine FROM dp UNION ALL SELECT doc_b, doc_a, round(cosine, 6) FROM dp) WHERE cosine > 0) WHERE place <= 5", *_DIV),
    "centroid_top_terms": _q("SELECT term, round(sum(w) / (SELECT count(*) FROM dv), 6) AS weight FROM dw GROUP BY term ORDER BY weight DESC, term LIMIT 20", *_DIV[:2]),
    "spelling_corrections": _q(
        "SELECT term, min(word) AS correction, any_value(distance)::INT AS distance FROM (SELECT *, min(distance) OVER (PARTITION BY term) AS least FROM near) WHERE distance = least GROUP BY term HAVING any_value(distance) < 2 OR count(*) = 1",
        *_NEAR,
    ),
    "nl_batch_entities": _entities(),
    "metadata_list_regex": "SELECT doc_seq, tale_id, tradition, region FROM tales WHERE regexp_matches(tradition, '(?i)^riddles|cycle$') AND regexp_matches(region, '(?i)coast')",
    "metadata_page": "SELECT doc_seq, tale_id FROM tales WHERE regexp_matches(tradition, '(?i)cycle') ORDER BY created_at DESC NULLS LAST, doc_seq DESC LIMIT 20 OFFSET 20",
    "tale_by_id": BASE + "SELECT doc_id AS tale_id, title, tale_type FROM corpus WHERE doc_id = (SELECT min(tale_id) FROM tales)",
    "synonym_expansion": _q(
        f"""SELECT term, (row_number() OVER (PARTITION BY term ORDER BY k) - 1)::INT AS place, synonym FROM kept WHERE k <= 3 AND synonym NOT IN ({', '.join(f"'{x}'" for x in NOUNS)}) AND synonym IN (SELECT term FROM dfs)""",
        "mo AS (SELECT tale_type_id, unnest(key_motifs) AS motif, unnest(range(len(key_motifs))) AS synset FROM tale_types)",
        "sy AS (SELECT split_part(motif, ' ', 2) AS term, split_part(motif, ' ', 1) AS synonym, min((synset, regexp_extract(tale_type_id, '(\\d+)$', 1)::INT)) AS place FROM mo WHERE synset < 3 AND len(string_split(motif, ' ')) = 2 AND regexp_full_match(lower(split_part(motif, ' ', 1)), '[a-z]+') GROUP BY 1, 2)",
        f"""kept AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY place, synonym) AS k FROM sy WHERE term IN ({', '.join(f"'{x}'" for x in NOUNS)}) AND term <> synonym)""",
    ),
    "lexicon_lemmas": _q("SELECT form, lemma FROM lexi", *_LEXICON),
    "lemma_postings": LEMMA_BASE + "SELECT term, doc_id, tf::INT AS tf, tf_title::INT AS tf_title, df::INT AS df, array_to_string(positions, ',') AS positions FROM post",
    "lemma_bm25": LEMMA_BASE + ", ".join(["", *_asking(_bm25(1.5, 0.75, 1.5, 10), "steal", "lamp", "find")]) + " SELECT 'bm25' AS mode, doc_id, round(exact, 6) AS score FROM bm",
    "lemma_vsm": LEMMA_BASE + ", ".join(["", *_asking(_vsm(0.35, 0.65, 10), "steal", "lamp", "find")]) + " SELECT 'vsm' AS mode, doc_id, round(exact, 6) AS score FROM vsm",
    "nl_boolean": "SELECT 'nl_query' AS mode, doc_id, score FROM (" + _boolean(["jackal", "lamp"], "jackal_ AND NOT lamp_") + ") ORDER BY score DESC, doc_id LIMIT 10",
    "nl_fallback": _q("SELECT 'vsm_fallback' AS mode, doc_id, round(exact, 6) AS score FROM vsm", *_asking(_vsm(2.0, 1.0, 10), "jackal", "jackal", "merchant")),
    "nl_vsm": _q("SELECT 'nl_query' AS mode, doc_id, round(exact, 6) AS score FROM vsm", *_asking(_vsm(2.0, 1.0, 10), "famine", "merchant")),
    "corrected_queries": _q(
        "SELECT DISTINCT query_text, corrected FROM (SELECT query_text, string_agg(coalesce(correction, term), ' ' ORDER BY place) AS corrected, count(correction) AS changes FROM lw LEFT JOIN co USING (term) GROUP BY query_text) WHERE changes > 0",
        *_NEAR,
        "co AS (SELECT term, min(word) AS correction FROM (SELECT *, min(distance) OVER (PARTITION BY term) AS least FROM near) WHERE distance = least GROUP BY term HAVING any_value(distance) < 2 OR count(*) = 1)",
        f"lw AS (SELECT query_text, unnest({_terms('query_text')}) AS term, unnest(range(len({_terms('query_text')}))) AS place FROM (SELECT DISTINCT query_text FROM query_log))",
    ),
    "nl_corrected": _q("SELECT 'nl_query' AS mode, doc_id, round(exact, 6) AS score FROM vsm", *_asking(_vsm(2.0, 1.0, 10), "jackal", "merchant")),
    "api_boolean": "SELECT 'boolean' AS mode, doc_id, score FROM (" + _boolean(["jackal", "crocodile"], "jackal_ OR crocodile_") + ") ORDER BY score DESC, doc_id LIMIT 10 OFFSET 5",
    "api_bm25": _q("SELECT 'bm25' AS mode, doc_id, round(exact, 6) AS score FROM bm", *_bm25(1.2, 0.5, 3.0, 20, "contains(lower(source_collection), 'papers') AND contains(lower(region), 'coast')")),
    "api_vsm": _q("SELECT 'vsm' AS mode, doc_id, round(exact, 6) AS score FROM vsm", *_vsm(0.35, 0.65, 20)),
    "api_feedback": _q("SELECT 'rocchio' AS mode, doc_id, round(exact, 6) AS score FROM re", _TERMS, _JUDGED, *_rerank("SELECT doc_id FROM ids WHERE k <= 3", "SELECT doc_id FROM ids WHERE k BETWEEN 4 AND 6")),
    "api_prf": _q("SELECT 'prf' AS mode, doc_id, round(exact, 6) AS score FROM re", *_vsm(2.0, 1.0, 3), *_rerank("SELECT doc_id FROM vsm", None)),
    "sample_phantoms": "SELECT * FROM (VALUES ('Q-01', 4::BIGINT), ('Q-02', 5), ('Q-03', 6), ('Q-04', 3), ('Q-05', 3)) t(query_id, dropped)",
    "index_staleness": "SELECT * FROM (VALUES ('same', TRUE), ('copied', TRUE), ('fewer', FALSE)) t(corpus, opens)",
    "index_rebuilt": _q("SELECT (SELECT count(*) FROM reg) AS documents, (SELECT count(*) FROM last WHERE title IS NULL OR raw_text IS NULL) AS skipped, (SELECT count(*) FROM dfs) AS terms, (SELECT 1 + count(DISTINCT (title IS NULL, raw_text IS NULL)) FROM last WHERE title IS NULL OR raw_text IS NULL)::INT AS errors"),
    "updated_tales": BASE + "SELECT tale_id, region, coalesce(tradition, 'of no tradition') AS tradition FROM last UNION ALL SELECT 'NEW-1', NULL, 'new'",
    "corpus_fingerprint": _q(
        "SELECT sha256(concat_ws('-', count(*), " + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::UBIGINT)::VARCHAR" for i in range(4)) + ")) AS fingerprint FROM di",
        "di AS (SELECT sha256(concat_ws(chr(31), " + ", ".join(f"'{c}=' || coalesce(':' || {x}, '')" for c, x in _DIGEST) + ")) AS h FROM corpus JOIN (SELECT tale_id, created_at, updated_at FROM last) ON tale_id = doc_id)",
    ),
    "boolean_matched": _q(
        "SELECT r.doc_id, coalesce(array_to_string(list_sort(list(p.term) FILTER (p.term IS NOT NULL)), ','), '') AS terms_matched FROM reg r LEFT JOIN (SELECT * FROM post WHERE term IN ('jackal', 'lamp', 'famine')) p USING (doc_id) GROUP BY r.doc_id HAVING coalesce(bool_or(term = 'jackal'), FALSE) OR NOT (coalesce(bool_or(term = 'lamp'), FALSE) AND coalesce(bool_or(term = 'famine'), FALSE))"
    ),
    "boolean_errors": "SELECT * FROM (VALUES ('jackal AND (lamp', 'Missing closing parenthesis ' || chr(39) || ')' || chr(39)), ('jackal AND', 'Unexpected end of boolean expression'), ('OR jackal', 'Operator ''OR'' in unexpected position'), ('the AND lamp', 'Query term ''the'' consists only of stopwords — it cannot be matched'), ('jackal)', 'Unexpected token: '')'' — check operator placement or parentheses'), ('', 'Unexpected end of boolean expression'), ('NOT', 'Unexpected end of boolean expression'), ('(jackal lamp) NOT king', '3')) t(query, outcome)",
    "local_rerank": _q("SELECT doc_id, round(round(exact, 6) + CASE WHEN doc_id IN (SELECT doc_id FROM ids WHERE k <= 3) THEN 0.15 WHEN doc_id IN (SELECT doc_id FROM ids WHERE k BETWEEN 4 AND 6) THEN -0.2 ELSE 0 END, 6) AS score FROM bm", *_bm25(1.5, 0.75, 1.5, 20), _JUDGED),
    "index_reloaded": _q("SELECT doc_id, round(exact, 6) AS score FROM bm", *_bm25(1.5, 0.75, 1.5, 10)),
    "engine_health": _q("SELECT 'ok' AS status, count(*) AS documents, FALSE AS index_stale FROM reg"),
    "eval_judged_subset": _q("SELECT * FROM ev WHERE query_id IN ('Q-0000002', 'Q-0000003')", *_EVAL),
    "log_appended": "SELECT query_mode, count(*) AS entries, count(DISTINCT log_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY received_at, created_at) AS k FROM query_log) WHERE k = 1 AND query_mode IN ('boolean', 'vsm', 'bm25', 'nl_query', 'feedback', 'prf') AND received_at IS NOT NULL AND created_at IS NOT NULL GROUP BY query_mode",
    "json_ingest": "WITH n AS (SELECT *, row_number() OVER (ORDER BY doc_seq) - 1 AS place FROM tales), l AS (SELECT *, row_number() OVER (PARTITION BY tale_id ORDER BY place DESC) AS k FROM n WHERE tale_id IS NOT NULL) SELECT place AS doc_seq, tale_id, title, coalesce(region, 'Unknown Region') AS region, coalesce(tradition, 'Unknown') AS tradition FROM l WHERE k = 1 AND title IS NOT NULL AND raw_text IS NOT NULL",
    "build_two_sources": BASE + "SELECT doc_id AS tale_id, region, tradition, source_collection FROM corpus",
    "tale_types_list": "SELECT tale_type_id, atu_code, canonical_title FROM tale_types",
    "variants_of_type": "SELECT doc_seq, tale_id, tradition FROM tales WHERE tale_type = 'TT-0018'",
    "qrels_list": "SELECT query_id, query_text, len(judgments)::INT AS judgments FROM qrels",
    "browse_types": "SELECT tale_type_id FROM tale_types WHERE (contains(lower(coalesce(canonical_title, '')), 'the') OR contains(lower(coalesce(atu_code, '')), 'the') OR contains(lower(coalesce(description, '')), 'the')) AND tale_type_id IN (SELECT tale_type FROM tales WHERE contains(lower(tradition), 'cycle'))",
    "clean_results": _q("SELECT doc_id, title, CASE WHEN starts_with(lower(region), 'unknown') THEN '' ELSE region END AS region, CASE WHEN starts_with(lower(tradition), 'unknown') THEN '' ELSE tradition END AS tradition FROM bm JOIN reg USING (doc_id) WHERE trim(title) <> ''", *_bm25(1.5, 0.75, 1.5, 50)),
    "query_log_latest": "SELECT log_id, query_text, query_mode FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY received_at, created_at) AS k FROM query_log) WHERE k = 1 ORDER BY created_at DESC NULLS LAST, log_id DESC LIMIT 50",
    "query_log_latency": "SELECT query_mode, count(*) AS requests, count(*) FILTER (execution_time_ms >= 0) AS timed, round(avg(execution_time_ms) FILTER (execution_time_ms >= 0), 3) AS mean_ms, max(execution_time_ms) FILTER (execution_time_ms >= 0) AS slowest_ms FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY received_at, created_at) AS k FROM query_log) WHERE k = 1 GROUP BY query_mode",
    "query_log_delivered_once": "SELECT log_id, session_id, query_mode, epoch_us(received_at) AS received FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY received_at, created_at) AS k FROM query_log) WHERE k = 1",
    "streamed_log_counts": "SELECT epoch_us(date_trunc('hour', created_at)) AS start, query_mode, count(DISTINCT log_id) AS requests FROM query_log WHERE created_at IS NOT NULL GROUP BY ALL",
}
