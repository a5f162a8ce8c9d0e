"""Lemmas and synonyms from tables that the user supplies.

The dictionaries themselves are data and not part of the library: lemmas need a table of dictionary
words (or the collection's own vocabulary), synonyms a table of synsets.  Small seeds serve as examples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Irregular forms, and (ending, replacement) of nouns and of verbs in the order they are tried.
IRREGULAR = {
    "feet": "foot", "teeth": "tooth", "geese": "goose", "mice": "mouse", "men": "man", "women": "woman", "children": "child", "oxen": "ox",
    "wolves": "wolf", "thieves": "thief", "wives": "wife", "lives": "life", "leaves": "leaf", "went": "go", "gone": "go", "ran": "run", "told": "tell",
    "saw": "see", "came": "come", "took": "take", "gave": "give", "found": "find", "fell": "fall", "ate": "eat", "stole": "steal", "stolen": "steal",
}
NOUN_ENDINGS = (("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))
VERB_ENDINGS = (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", ""))
SYNONYM_SEED = (("clever", "a", 0, 0, "cunning"), ("clever", "a", 0, 1, "shrewd"), ("king", "n", 0, 0, "monarch"), ("forest", "n", 0, 0, "wood"), ("thief", "n", 0, 0, "robber"))
SYNONYM_SCHEMA = "term string, pos string, synset_rank int, lemma_rank int, synonym string"


def _detached(forms: DataFrame, source: str, endings, dictionary: DataFrame) -> DataFrame:
    """(form, lemma) by the first ending whose detached form is a dictionary word; a dictionary word stays itself."""
    word = F.col(source)
    tries = [F.struct(F.lit(0).alias("k"), word.alias("lemma"))]
    tries += [
        F.when(word.endswith(a) & (F.length(word) > len(a)), F.struct(F.lit(k + 1).alias("k"), F.concat(word.substr(F.lit(1), F.length(word) - len(a)), F.lit(b)).alias("lemma")))
        for k, (a, b) in enumerate(endings)
    ]
    options = forms.select("form", F.explode(F.array_compact(F.array(*tries))).alias("t")).select("form", "t.k", "t.lemma")
    good = options.join(dictionary, "lemma", "left_semi")
    return good.groupBy("form").agg(F.min_by("lemma", F.struct("k", "lemma")).alias("found"))


def build_lexicon(forms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(form, lemma) of the ``forms`` (form) whose lemma differs: as a noun first, then that as a verb.

    ``dictionary`` (lemma) holds the words a lemma must be; forms out of it that no rule brings into it stay
    as they are.
    """
    spark = forms.sparkSession
    irregular = spark.createDataFrame(list(IRREGULAR.items()), "form string, irregular string")
    base = forms.select("form").distinct()
    nouns = base.join(_detached(base, "form", NOUN_ENDINGS, dictionary), "form", "left").withColumn("noun", F.coalesce("found", "form")).drop("found")
    verbs = nouns.join(_detached(nouns, "noun", VERB_ENDINGS, dictionary), "form", "left").join(F.broadcast(irregular), "form", "left")
    return verbs.select("form", F.coalesce("irregular", "found", "noun").alias("lemma")).where("lemma <> form")


def lemmas_of(lexicon: DataFrame, words: list[str]) -> list[str]:
    """Lemmas of a query's words."""
    found = {r.form: r.lemma for r in lexicon.where(F.col("form").isin(words)).collect()} if words else {}
    return [found.get(w, w) for w in words]


def synonym_seed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SYNONYM_SEED), SYNONYM_SCHEMA)


def expansions(synonyms: DataFrame, terms: list[str], vocabulary: DataFrame | None = None, max_synsets: int = 3, max_per_term: int = 3) -> dict[str, list[str]]:
    """Synonyms of each term: of its first part of speech (noun, adjective, verb), of the first synsets, single words only.

    The cap for a term comes before the filter by ``vocabulary`` (term); words of the query are never added.
    An empty table gives none.
    """
    if not terms:
        return {}
    rank = F.expr("CASE pos WHEN 'n' THEN 0 WHEN 'a' THEN 1 WHEN 'v' THEN 2 END")
    rows = synonyms.where(F.col("term").isin(terms)).withColumn("p", rank).where("p IS NOT NULL")
    rows = rows.withColumn("first", F.min("p").over(Window.partitionBy("term"))).where("p = first AND synset_rank < %d" % max_synsets)
    rows = rows.withColumn("synonym", F.lower("synonym")).where("synonym RLIKE '^[a-z]+$' AND synonym <> term")
    place = F.struct("synset_rank", "lemma_rank", "synonym")
    once = rows.groupBy("term", "synonym").agg(F.min(place).alias("place"))
    kept = once.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy("place"))).where(F.col("k") <= max_per_term)
    kept = kept.where(~F.col("synonym").isin(terms))
    if vocabulary is not None:
        kept = kept.join(vocabulary.select(F.col("term").alias("synonym")), "synonym", "left_semi")
    out: dict[str, list[str]] = {}
    for r in kept.orderBy("term", "k").collect():
        out.setdefault(r.term, []).append(r.synonym)
    return {t: out[t] for t in dict.fromkeys(terms) if t in out}
