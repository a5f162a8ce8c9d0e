"""Problem 9: keyword-stuffed and link-list pages.

One pass over the texts gives each document six features: three densities (characters in list-like segments,
list marks, characters in links), repetition and entropy of its words, and the share of function words.
Within each language (told from the text, as the stored code is often wrong) a robust centre and scatter are
fitted to all documents by concentration steps, starting from medians and median deviations; all of
these are aggregations over the small feature table.

A document is spam if it is an outlier in the direction of spam: its squared Mahalanobis distance from the
prose of its language is beyond a chi-squared bound, and the part of it that points to a page of nothing but
heaps (all characters in lists, no function words) takes it more than half the way there.  The densities
of a page that is partly prose mix in proportion, so that half the way is half of the text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.codepoints import DEVA, LATIN, LETTER, TOP, Words, chunks, classes, mix
from quillon.plans.checkpoints import checkpointed

# Frequent function words by language. Words that also serve as list or shop words are left out.
FUNCTION_WORDS = {
    "en": "the a an and or but nor of to in on at by for from with without as into upon under over near between through until while when "
    "where who whose whom which that this these those it its he she his her him they them their we our us i my me is are was were be been "
    "had has have did do does not no never so if then there yet though because said before after neither both either than such some "
    "every all out up beyond around along behind across what why how did didn t s would could should may might must shall will can",
    "fr": "le la les l un une des du de d et ou où mais donc or ni car à au aux en dans sur sous par pour sans avec près puis après "
    "derrière devant que qui dont ce cette ces il elle ils elles on nous vous je tu me te se sa son ses leur leurs mon ma mes ne pas plus "
    "est était sont a ont avait fut être avoir si comme quand y m c n s qu entre vers chez très",
    "hi": "ने को का की के में से पर और फिर तब मगर एक उस इस वह यह वे ये था थी थे है हैं हो कि जो तो भी ही नहीं तक लिए साथ कर गया आया दिया लिया कहा पूछा देखा",
}
FEATURES = ("listed", "marks", "links", "repetition", "entropy", "function_words")
#: What a page of nothing but heaps has of the features that are shares of the text; the others are not known beforehand.
HEAP = {"listed": 1.0, "function_words": 0.0}
#: Chi-squared with six degrees of freedom exceeds this with probability 0.001.
BOUND = 22.46
#: Share of the way from prose to a heap beyond which a page is spam.
HALF = 0.5
#: Spread that is added to that of each feature: shares of a text of some thirty words are no finer.
LEAST_SPREAD = 0.03
STEPS = 3
#: Bins of the distance, by its logarithm, in which a concentration step adds up moments.
DISTANCE_BINS = 400
LANGUAGES = ("en", "fr", "hi", "other")
LIST_MARKS = tuple(map(ord, ",;|/#<>[]()*_=:•·"))
ENDS = tuple(map(ord, ".!?।…"))
BREAKS = (10, 13, 0x85, 0x2028, 0x2029)


# Bits of the table that the signs are looked up in.
BLANK, BREAK, END, SOFT, MARK, COMMA, WESTERN, DEVANAGARI, ALPHABETIC = (1 << i for i in range(9))


@lru_cache(None)
def signs() -> np.ndarray:
    out = np.zeros(TOP, np.uint16)
    out[(classes() & LETTER) > 0] |= ALPHABETIC
    out[(classes() & LATIN) > 0] |= WESTERN
    out[(classes() & (DEVA | LETTER)) == DEVA | LETTER] |= DEVANAGARI
    for bit, cps in ((BLANK | SOFT, (32, 9, *BREAKS)), (BREAK, BREAKS), (END, ENDS), (SOFT, map(ord, "\"'”’»)]")), (MARK, LIST_MARKS), (COMMA, map(ord, ",;|/"))):
        out[list(cps)] |= bit
    return out


def _word_hashes(words: str) -> np.ndarray:
    return np.unique(Words(pa.array(words.split())).hash)


class _Lexicon:
    made = None

    def __init__(self):
        self.of = {k: _word_hashes(v) for k, v in FUNCTION_WORDS.items()}

    @classmethod
    def get(cls) -> _Lexicon:
        cls.made = cls.made or cls()
        return cls.made


def _within(sorted_hashes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    i = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    return sorted_hashes[i] == hashes


def _features(w: Words) -> dict[str, np.ndarray]:
    """Language, number of words and features of each row of a chunk."""
    lex = _Lexicon.get()
    cps, off, rows = w.cps, w.off, w.rows
    n = len(cps)
    bits = signs()[cps]
    row_of = np.repeat(np.arange(rows, dtype=np.int32), np.diff(off))
    ink = bits & BLANK == 0
    chars = np.bincount(row_of[ink], minlength=rows)
    en, fr, hi = (_within(lex.of[k], w.hash) for k in ("en", "fr", "hi"))
    words = np.bincount(w.row, minlength=rows)
    deva = np.bincount(row_of[bits & DEVANAGARI > 0], minlength=rows)
    latin = np.bincount(row_of[bits & WESTERN > 0], minlength=rows)
    n_en, n_fr = (np.bincount(w.row[x], minlength=rows) for x in (en, fr))
    letters = np.bincount(row_of[bits & ALPHABETIC > 0], minlength=rows)
    language = np.where(2 * (deva + latin) < letters, 3, np.where(deva > latin, 2, np.where(n_fr > n_en, 1, 0)))
    # Segments: cut at line breaks and behind sentence ends that white space or a closing mark follows.
    end = bits & END > 0
    soft = bits & SOFT > 0
    cut = bits & BREAK > 0
    cut[:-1] |= end[:-1] & soft[1:]
    begin = np.zeros(n, bool)
    begin[1:] = cut[:-1]
    begin[off[:-1]] = True
    seg = np.cumsum(begin, dtype=np.int32) - 1
    segs = int(seg[-1]) + 1 if n else 0
    seg_row = row_of[begin]
    seg_chars = np.bincount(seg[ink], minlength=segs)
    word_seg = seg[w.source]
    seg_words = np.bincount(word_seg, minlength=segs)
    per_language = np.select([language[w.row] == 2, language[w.row] == 1], [hi, fr | en], en | fr)
    seg_function = np.bincount(word_seg[per_language], minlength=segs)
    # Links: runs of ink with "://", "](" or "<...>" with a slash; hash tags: runs that begin with "#".
    run = ink.copy()
    run[1:] &= ~ink[:-1] | (row_of[1:] != row_of[:-1])
    run_of = np.cumsum(run, dtype=np.int32) - 1
    runs = int(run.sum())
    is_link = np.zeros(runs, bool)
    pair = np.flatnonzero(((cps[:-1] == 93) & (cps[1:] == 40)) | ((cps[:-1] == 47) & (cps[1:] == 47))) if n else np.zeros(0, int)
    is_link[run_of[pair]] = True
    angle = np.flatnonzero(run & (cps == 60))
    slash = np.zeros(runs, bool)
    slash[run_of[np.flatnonzero(cps == 47)]] = True
    is_link[run_of[angle]] |= slash[run_of[angle]]
    www = np.flatnonzero(run[:-3] & (cps[:-3] == 119) & (cps[1:-2] == 119) & (cps[2:-1] == 119) & (cps[3:] == 46)) if n > 3 else np.zeros(0, int)
    is_link[run_of[www]] = True
    is_tag = np.zeros(runs, bool)
    is_tag[run_of[np.flatnonzero(run & (cps == 35))]] = True
    run_start = np.flatnonzero(run)
    seg_runs = np.bincount(seg[run_start], minlength=segs)
    seg_links = np.bincount(seg[run_start[is_link]], minlength=segs)
    seg_tags = np.bincount(seg[run_start[is_tag]], minlength=segs)
    run_chars = np.diff(np.append(np.flatnonzero(run), n)) if runs else np.zeros(0)
    link_chars = np.bincount(row_of[np.flatnonzero(run)[is_link]], run_chars[is_link], minlength=rows)
    seg_commas = np.bincount(seg[bits & COMMA > 0], minlength=segs)
    seg_ended = np.bincount(seg[end], minlength=segs) > 0
    seg_latin = np.bincount(seg[bits & WESTERN > 0], minlength=segs)
    seg_deva = np.bincount(seg[bits & DEVANAGARI > 0], minlength=segs)
    seg_letters = np.bincount(seg[bits & ALPHABETIC > 0], minlength=segs)
    with np.errstate(divide="ignore", invalid="ignore"):
        function = seg_function / np.maximum(seg_words, 1)
        unlisted = (seg_deva > seg_latin) | (2 * (seg_deva + seg_latin) < seg_letters)  # scripts whose sentences need no function word of the tables
        lists = (seg_commas >= 3) & (seg_words <= 3.2 * (seg_commas + 1))
        western = ~unlisted & (seg_words >= 2) & ((function < 0.08) | (lists & (function < 0.15)))
        eastern = unlisted & (seg_words >= 3) & (lists | (~seg_ended & ((seg_words > 16) | (seg_latin > 0.1 * (seg_letters - seg_latin)))))
        linked = (seg_links > 0) & (function < 0.2) | (seg_links > 0.3 * seg_runs)
        tagged = (seg_tags >= 3) & (seg_tags > 0.4 * seg_runs)
    heap = western | eastern | linked | tagged
    listed = np.bincount(seg_row[heap], seg_chars[heap], minlength=rows) / np.maximum(chars, 1)
    marks = np.bincount(row_of[bits & MARK > 0], minlength=rows)
    salt = mix(np.arange(rows).astype(np.uint64))
    _, first, count = np.unique(w.hash ^ salt[w.row], return_index=True, return_counts=True)
    owner = w.row[first]
    entropy = -np.bincount(owner, count / words[owner] * np.log(count / words[owner]), minlength=rows)
    two, first = w.grams(2)
    all_two = np.bincount(w.row[first], minlength=rows)
    distinct_two = w.row[first[np.unique(two ^ salt[w.row[first]], return_index=True)[1]]]
    repetition = 1 - np.bincount(distinct_two, minlength=rows) / np.maximum(all_two, 1)
    return {
        "language": language, "words": words, "listed": listed,
        "marks": marks / np.maximum(chars, 1), "links": link_chars / np.maximum(chars, 1), "repetition": np.where(all_two > 0, repetition, 0.0),
        "entropy": entropy / np.log(np.maximum(words, 2)), "function_words": np.bincount(seg_row, seg_function, minlength=rows) / np.maximum(words, 1),
    }


def features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, language, words, features...) of every row; texts without a word have zero everywhere."""
    names = [key, "language", "words", *FEATURES]
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a, b in chunks(batch.column(1)):
                got = _features(Words(batch.column(1).slice(a, b - a)))
                own = [pa.array(np.array(LANGUAGES, object)[got["language"]], pa.string()), pa.array(got["words"], pa.int64())]
                own += [pa.array(np.nan_to_num(got[c].astype(float))) for c in FEATURES]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *own], names)

    doubles = ", ".join(f"{c} double" for c in FEATURES)
    return df.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, language string, words bigint, {doubles}")


@dataclass(frozen=True)
class Prose:
    """Robust centre and inverse scatter of the features of one language."""

    centre: np.ndarray
    inverse: np.ndarray

    def to_heap(self) -> np.ndarray:
        """From the centre to a page of nothing but heaps."""
        return np.array([HEAP[c] - self.centre[i] if c in HEAP else 0.0 for i, c in enumerate(FEATURES)])


def fit(table: DataFrame) -> dict[str, Prose]:
    """The prose of each language in a table of features; every step is one aggregation over all rows."""
    rows = table.where("words > 0")
    floor = np.diag(np.full(len(FEATURES), LEAST_SPREAD**2))
    middle = {r.language: np.array([r[c] for c in FEATURES]) for r in rows.groupBy("language").agg(*(F.percentile_approx(c, 0.5, 1000).alias(c) for c in FEATURES)).collect()}
    away = [F.percentile_approx(F.abs(F.col(c) - _pick({k: v[i] for k, v in middle.items()})), 0.5, 1000).alias(c) for i, c in enumerate(FEATURES)]
    prose = {r.language: Prose(middle[r.language], np.linalg.inv(np.diag(np.square([1.4826 * r[c] for c in FEATURES])) + floor)) for r in rows.groupBy("language").agg(*away).collect()}
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    for _ in range(STEPS):  # concentration: mean and covariance of the nearer half
        ln = F.log10(F.greatest(_distance(prose), F.lit(1e-6)))
        bin_ = F.least(F.floor((ln + 6) * (DISTANCE_BINS / 12)), F.lit(DISTANCE_BINS - 1)).alias("bin")
        sums = [F.sum(z).alias(f"s{i}") for i, z in enumerate(_away(prose))]
        z = _away(prose)
        products = [F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i, j in pairs]
        bins: dict[str, list] = {}
        for r in rows.groupBy("language", bin_).agg(F.count("*").alias("n"), *sums, *products).orderBy("language", "bin").collect():  # at most DISTANCE_BINS rows a language
            bins.setdefault(r.language, []).append(r)
        for language, own in bins.items():
            ends = np.cumsum([r.n for r in own])
            own = own[: int(np.searchsorted(ends, ends[-1] / 2)) + 1]
            n = sum(r.n for r in own)
            mean = np.array([sum(r[f"s{i}"] for r in own) / n for i in range(len(FEATURES))])
            square = np.zeros((len(FEATURES), len(FEATURES)))
            for i, j in pairs:
                square[i, j] = square[j, i] = sum(r[f"p{i}_{j}"] for r in own) / n
            # The nearer half of a normal sample in six dimensions has about 0.55 of its scatter.
            prose[language] = Prose(prose[language].centre + mean, np.linalg.inv((square - np.outer(mean, mean)) / 0.55 + floor))
    return prose


def _pick(values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, v in values.items():
        out = F.when(F.col("language") == k, F.lit(float(v))).otherwise(out)
    return out


def _away(prose: dict[str, Prose]) -> list[Column]:
    return [F.col(c) - _pick({k: p.centre[i] for k, p in prose.items()}) for i, c in enumerate(FEATURES)]


def _distance(prose: dict[str, Prose]) -> Column:
    """Squared Mahalanobis distance from the prose of the row's language."""
    z = _away(prose)
    total = F.lit(0.0)
    for i in range(len(z)):
        for j in range(i, len(z)):
            total = total + z[i] * z[j] * _pick({k: p.inverse[i, j] * (1 if i == j else 2) for k, p in prose.items()})
    return total


def _leaning(prose: dict[str, Prose]) -> Column:
    """How much of the way from prose to a heap the row is, in the metric of the prose's scatter."""
    total = F.lit(0.0)
    weights = {k: p.inverse @ p.to_heap() / (p.to_heap() @ p.inverse @ p.to_heap()) for k, p in prose.items()}
    for i, z in enumerate(_away(prose)):
        total = total + z * _pick({k: w[i] for k, w in weights.items()})
    return total


def spam_scores(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, language, words, features..., distance, leaning, spam) of every row of ``df``.

    ``spam``: the document is an outlier among the texts of its language (``distance`` beyond ``BOUND``) and
    more than half the way to a page of nothing but heaps (``leaning`` beyond ``HALF``).  Null, empty and blank
    texts are never spam; repeated rows are judged alike; a language with few or equal documents has the
    least spread; texts mostly in other scripts form a language of their own, without function words; an empty
    table gives no rows.
    """
    table = checkpointed(features(df, key, text))
    prose = fit(table)
    scored = table.withColumn("distance", _distance(prose)).withColumn("leaning", _leaning(prose))
    return scored.withColumn("spam", (F.col("words") > 0) & (F.col("distance") > BOUND) & (F.col("leaning") > HALF))
