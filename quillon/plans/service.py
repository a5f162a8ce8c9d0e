"""A thin facade: the engine's searches and reports as dictionaries."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from quillon import build
from quillon.functions.text import query_tokens
from quillon.operators import bm25, boolean, catalog, evaluation, lexicon, spelling, vsm
from quillon.operators import divergence as dv
from quillon.operators import feedback as rf
from quillon.operators import index as ix
from quillon.operators.language import parse_question
from quillon.plans.checkpoints import checkpointed
from quillon.sources import corpus as src

#: Zone weights of the facade's cosine search, where the engine's own are 2 and 1.
TITLE_WEIGHT, BODY_WEIGHT = 0.35, 0.65
#: Rows of a page where a search has no top_k.
PAGE = 1000


def _rows(df: DataFrame) -> list[dict]:
    """Results of one request, bounded by its top_k or its page."""
    return [r.asDict(recursive=True) for r in df.collect()]


@dataclass
class Engine:
    """Searches over one index; ``lexicon`` (form, lemma) and ``synonyms`` are optional tables."""

    index: ix.Index
    lexicon: DataFrame | None = None
    synonyms: DataFrame | None = None
    #: Folder of the query log; each search adds an entry with its time.
    log_path: str | None = None
    _lemmas: dict[str, str] = field(default_factory=dict)

    @classmethod
    def open(cls, spark: SparkSession, path: str, corpus: DataFrame, lexicon: DataFrame | None = None, synonyms: DataFrame | None = None) -> Engine:
        """The stored index, or a new one if there is none or the corpus has changed."""
        return cls(ix.open_or_build(spark, path, corpus, lexicon), lexicon, synonyms)

    def analyze(self, text: str) -> list[str]:
        words = query_tokens(text)
        unknown = [w for w in dict.fromkeys(words) if w not in self._lemmas]
        if self.lexicon is not None and unknown:
            self._lemmas.update(zip(unknown, lexicon.lemmas_of(self.lexicon, unknown)))
        return [self._lemmas.get(w, w) for w in words]

    @cached_property
    def spark(self) -> SparkSession:
        return self.index.registry.sparkSession

    def _corrected(self, query: str, auto_correct: bool) -> tuple[str, dict[str, str]]:
        terms = self.analyze(query)
        fixed = spelling.correct_terms(self.index, terms) if auto_correct else {}
        return (" ".join(fixed.get(t, t) for t in terms) if fixed else query), fixed

    def _log(self, mode: str, query: str, began: float, relevant: list[str] | None = None, non_relevant: list[str] | None = None) -> None:
        if self.log_path:
            given = None if relevant is None else (relevant, non_relevant or [])
            row = (uuid.uuid4().int >> 65, query, mode, given, (time.perf_counter() - began) * 1000, datetime.now(timezone.utc))
            catalog.append_log(self.spark.createDataFrame([row], catalog.LOG_SCHEMA), self.log_path)

    @classmethod
    def rebuild(cls, spark: SparkSession, path: str, sources: list[str]) -> dict:
        """Builds the stored index anew from JSON files and tables."""
        return build.rebuild(spark, sources, path)

    def search_boolean(self, query: str, filters: dict[str, str] | None = None, skip: int = 0, limit: int = PAGE) -> dict:
        """A page of the documents for which the query holds, and the number of all."""
        began = time.perf_counter()
        rows = boolean.boolean_search(self.index, query, filters, self.analyze)
        out = {"mode": "boolean", "query": query, "total": rows.count(), "results": _rows(rows.offset(skip).limit(limit))}
        self._log("boolean", query, began)
        return out

    def search_vsm(self, query: str, top_k: int = 10, collection_filter: str | None = None, region_filter: str | None = None, zone_weights: dict[str, float] | None = None, auto_correct: bool = False) -> dict:
        weights = {"title": TITLE_WEIGHT, "body": BODY_WEIGHT} | (zone_weights or {})
        if any(not isinstance(w, int | float) or w < 0 for w in weights.values()):
            raise ValueError("zone weights must be numbers of 0 or more")
        began = time.perf_counter()
        used, fixed = self._corrected(query, auto_correct)
        rows = vsm.vsm_search(self.index, used, top_k, weights["title"], weights["body"], collection_filter, region_filter, analyzer=self.analyze)
        results = [r | {"zone_weights": weights} for r in _rows(rows)]
        self._log("vsm", query, began)
        return {"mode": "vsm", "query": query, "corrections": fixed, "total": len(results), "results": results}

    def search_bm25(self, query: str, top_k: int = 10, k1: float = bm25.K1, b: float = bm25.B, title_boost: float = bm25.TITLE_BOOST, collection_filter: str | None = None, region_filter: str | None = None, auto_correct: bool = False) -> dict:
        began = time.perf_counter()
        used, fixed = self._corrected(query, auto_correct)
        rows = bm25.bm25_search(self.index, used, top_k, k1, b, title_boost, collection_filter, region_filter, self.analyze)
        extra = {"engine": "bm25", "bm25_params": {"k1": k1, "b": b, "title_boost": title_boost}}
        results = [r | extra for r in _rows(rows)]
        self._log("bm25", query, began)
        return {"mode": "bm25", "query": query, "corrections": fixed, "total": len(results), "results": results}

    def search_question(self, query: str, top_k: int = 10, expand_synonyms: bool = False, expansion_weight: float = 0.3, max_expansions: int = 3, auto_correct: bool = False, strict_filters: bool = False) -> dict:
        """A question in plain words: Boolean if it reads so and finds something, else a cosine search with the names found as filters.

        ``strict_filters`` applies the filters to Boolean results, too.
        """
        began = time.perf_counter()
        parsed = parse_question(query, self.analyze)
        out = {"query": query, "parsed": parsed, "corrections": {}, "synonyms_applied": {}}
        if parsed.mode == "boolean":
            try:
                filters = {k: v for k, v in parsed.filters.items() if k != "tale_type"} if strict_filters else None
                results = _rows(boolean.boolean_search(self.index, parsed.structured, filters, self.analyze).limit(top_k))
            except boolean.BooleanParseError:
                results = []
            if results:
                self._log("nl_query", query, began)
                return out | {"mode": "nl_query", "total": len(results), "results": results}
        terms, applied = list(parsed.terms), {}
        if expand_synonyms and parsed.mode == "vsm" and self.synonyms is not None:
            applied = lexicon.expansions(self.synonyms, terms, self.index.term_stats, max_per_term=max_expansions)
        fixed = spelling.correct_terms(self.index, terms) if auto_correct and parsed.mode == "vsm" else {}
        used = " ".join(fixed.get(t, t) for t in terms)
        weight = min(1.0, max(0.0, expansion_weight))
        rows = vsm.vsm_search(
            self.index, used, top_k, collection=parsed.filters.get("tradition"), region=parsed.filters.get("region"),
            expansions={s: weight for ws in applied.values() for s in ws}, analyzer=self.analyze,
        )
        results = _rows(rows)
        self._log("nl_query", query, began)
        mode = "vsm_fallback" if parsed.mode == "boolean" else "nl_query"
        return out | {"mode": mode, "corrections": fixed, "synonyms_applied": {fixed.get(t, t): ws for t, ws in applied.items()}, "total": len(results), "results": results}

    def feedback(self, query: str, relevant_ids: list[str], non_relevant_ids: list[str], top_k: int = 10, alpha: float = rf.ALPHA, beta: float = rf.BETA, gamma: float = rf.GAMMA) -> dict:
        began = time.perf_counter()
        results = _rows(rf.rocchio(self.index, query, relevant_ids, non_relevant_ids, top_k, alpha, beta, gamma, self.analyze))
        self._log("feedback", query, began, relevant_ids, non_relevant_ids)
        return {"mode": "rocchio", "query": query, "alpha": alpha, "beta": beta, "gamma": gamma, "total": len(results), "results": results}

    def pseudo_feedback(self, query: str, top_k: int = 10, prf_k: int = 3, beta: float = rf.BETA) -> dict:
        began = time.perf_counter()
        results = _rows(rf.pseudo_feedback(self.index, query, top_k, prf_k, beta, self.analyze))
        self._log("prf", query, began)
        return {"mode": "prf", "query": query, "prf_k": prf_k, "beta": beta, "total": len(results), "results": results}

    def evaluate(self, qrels: DataFrame | str | None = None, modes: tuple[str, ...] = evaluation.MODES, query_ids: list[str] | None = None) -> dict:
        """Metrics over judged queries: a table, a JSON file (FileNotFoundError if it is not there), or the sample; an unknown mode is an error."""
        if unknown := [m for m in modes if m not in evaluation.MODES]:
            raise ValueError(f"unknown modes: {unknown}")
        if isinstance(qrels, str):
            try:
                qrels = evaluation.read_qrels(self.spark, qrels)
            except AnalysisException as e:
                raise FileNotFoundError(f"qrels file not found: {qrels}") from e
        per_query = checkpointed(evaluation.evaluate(self.index, evaluation.sample_qrels(self.spark) if qrels is None else qrels, modes, query_ids))
        return {"summary": _rows(evaluation.macro_average(per_query)), "per_query": _rows(evaluation.rounded(per_query))}

    def tale_types(self) -> list[dict]:
        return _rows(ix.tale_types(self.index))

    def variants(self, tale_type: str, skip: int = 0, limit: int = PAGE) -> list[dict]:
        rows = _rows(ix.variants(self.index, tale_type).orderBy("doc_seq").offset(skip).limit(limit))
        if not rows:
            raise LookupError(f"no variants of {tale_type!r}")
        return rows

    def divergence(self, tale_type: str) -> dict:
        """The report of one type; its variants and its pairs stay tables."""
        found = dv.divergence(self.index, tale_type)
        if found is None:
            raise LookupError(f"no variants of {tale_type!r}")
        return {"variants": found.variants, "matrix": found.matrix, "centroid_top_terms": _rows(found.centroid_terms), "summary": _rows(found.summary)[0]}

    def status(self) -> dict:
        return _rows(ix.status(self.index))[0]

    def health(self, corpus: DataFrame | None = None) -> dict:
        """Sizes, and whether the index is older than ``corpus``."""
        stale = corpus is not None and ix.is_stale(self.index.fingerprint, src.fingerprint(corpus))
        return {"status": "ok", "documents": self.index.n_docs, "index_stale": stale}
