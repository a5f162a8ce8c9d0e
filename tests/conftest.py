import math
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))

TALES = [
    ("A", "The ferry bell", "The ferryman rang his bell; nobody crossed."),
    ("B", "Bell and hammer", "A smith lifted her hammer over the bell."),
    ("C", "Winter bread", "Snow lay deep, bread was dear."),
    ("D", "Hammer of frost", "One smith borrowed a hammer and the river froze over."),
]
LEMMAS = [("crossed", "cross"), ("lifted", "lift"), ("borrowed", "borrow"), ("froze", "freeze"), ("hammers", "hammer"), ("feet", "foot")]


class ByHand:
    """The rankings of a few tales from the formulas, term by term."""

    def __init__(self, tales, lemmas):
        from quillon.functions.text import query_tokens

        lemma = dict(lemmas)
        self.zones = {i: tuple(Counter(lemma.get(w, w) for w in query_tokens(x)) for x in (title, body)) for i, title, body in tales}
        self.tf = {i: t + b for i, (t, b) in self.zones.items()}
        self.df = Counter(w for c in self.tf.values() for w in c)
        self.n = len(tales)
        self.avgdl = sum(c.total() for c in self.tf.values()) / self.n

    def idf(self, w):
        return math.log(1 + self.n / self.df[w])

    def plain(self, i):
        return {w: damped(n) * self.idf(w) for w, n in self.tf[i].items()}

    def zoned(self, i, title, body):
        t, b = self.zones[i]
        return {w: (title * damped(t[w]) + body * damped(b[w])) * self.idf(w) for w in self.tf[i]}

    def boolean(self, words):
        """Documents with one of the words, by the sum of their weights, then by id."""
        found = {i: sum(v for w, v in self.plain(i).items() if w in words) for i in self.tf if any(w in c for w in words for c in [self.tf[i]])}
        return [(i, round(x, 6)) for i, x in sorted(found.items(), key=lambda p: (-round(p[1], 10), p[0]))]

    def cosines(self, query, vector):
        return {i: cosine(query, vector(i)) for i in self.tf if any(w in query for w in self.tf[i])}

    def vsm(self, words, title=2.0, body=1.0):
        query = {w: damped(words.count(w)) * self.idf(w) for w in words if w in self.df}
        found = self.cosines(query, lambda i: self.zoned(i, title, body))
        order = sorted(found, key=lambda i: (-round(found[i], 10), min(list(query).index(w) for w in query if w in self.tf[i]), i))
        return [(i, round(found[i], 6)) for i in order]

    def bm25(self, words, k1=1.5, b=0.75, boost=1.5):
        out = {}
        for i, (t, body) in self.zones.items():
            own = [w for w in dict.fromkeys(words) if w in self.tf[i]]
            if own:
                scale = k1 * (1 - b + b * self.tf[i].total() / self.avgdl)
                tf = {w: body[w] + boost * t[w] for w in own}
                out[i] = (sum(math.log(1 + (self.n - self.df[w] + 0.5) / (self.df[w] + 0.5)) * tf[w] * (k1 + 1) / (tf[w] + scale) for w in own), min(words.index(w) for w in own))
        return [(i, round(out[i][0], 6)) for i in sorted(out, key=lambda i: (-round(out[i][0], 10), out[i][1], i))]

    def rocchio(self, words, relevant, non_relevant, alpha=1.0, beta=0.75, gamma=0.15):
        query = Counter({w: alpha * damped(words.count(w)) * self.idf(w) for w in words if w in self.df})
        for ids, factor in ((relevant, beta), (non_relevant, -gamma)):
            for i in ids:
                for w, x in (self.plain(i) if i in self.tf else {}).items():
                    query[w] += factor * x / len(ids)
        query = {w: x for w, x in query.items() if x > 0}
        found = self.cosines(query, self.plain)
        return [(i, round(found[i], 6)) for i in sorted(sorted(found, reverse=True), key=lambda i: -round(found[i], 10))]


def damped(n):
    return 1 + math.log(n) if n else 0.0


def cosine(a, b):
    product = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return sum(x * b[w] for w, x in a.items() if w in b) / product if product else 0.0


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def corpus(spark, rows, **extra):
    """Tales (id, title, body) in this order; ``extra`` gives metadata by id."""
    names = ("tale_type", "region", "tradition", "source_collection", "translator", "collection_era")
    data = [(k, i, t, b, *(extra.get(i, {}).get(n, "T" if n == "tale_type" else "") for n in names)) for k, (i, t, b) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_seq bigint, tale_id string, title string, raw_text string, " + ", ".join(f"{n} string" for n in names))


@pytest.fixture(scope="session")
def lexicon(spark):
    return spark.createDataFrame(LEMMAS, "form string, lemma string")


@pytest.fixture(scope="session")
def tiny(spark, lexicon):
    from quillon.operators.index import build_index

    return build_index(corpus(spark, TALES), lexicon)


@pytest.fixture(scope="session")
def by_hand():
    return ByHand(TALES, LEMMAS)
