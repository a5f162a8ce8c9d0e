"""Text analysis as Column expressions, and the same rules for query strings at the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stopwords (forms without an apostrophe) and the additions for tales.
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them "
    "their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing "
    "a an the and but if or because as until while of at by for with about against between into through during before after above below to "
    "from up down in out on off over under again further then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn hasn "
    "haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()
TALE_STOPWORDS = "said upon also did knew seen thus therefore replied amongst thereof".split()
STOPWORDS = tuple(sorted({*ENGLISH_STOPWORDS, *TALE_STOPWORDS}))
SNIPPET = 200


def tokens(text: Column) -> Column:
    """Lower-case words of the letters a to z; words with any other letter, digit or underscore are left out whole.

    A possessive 's or a closing apostrophe inside a word is dropped, a hyphen separates.  Null gives an empty array.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    low = F.regexp_replace(low, r"['’](?:s(?![\p{L}\p{N}_])|(?=[\p{L}\p{N}_]))", "")
    low = F.replace(low, F.lit("-"), F.lit(" "))
    return F.filter(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: x.rlike("^[a-z]+$"))


def content_tokens(words: Column) -> Column:
    """Without stopwords and single letters, order and repetition kept."""
    return F.filter(words, lambda x: (F.length(x) > 1) & ~x.isin(*STOPWORDS))


def analyze(text: Column) -> Column:
    """Tokens of a text without stopwords."""
    return content_tokens(tokens(text))


def query_tokens(text: str) -> list[str]:
    """:func:`analyze` for one string."""
    low = re.sub(r"['’]s?\b", "", text.lower()).replace("-", " ")
    words = [w for w in re.findall(r"\w+", low) if re.fullmatch("[a-z]+", w)]
    return [w for w in words if len(w) > 1 and w not in STOPWORDS]


def snippet(text: Column, size: int = SNIPPET) -> Column:
    """The first characters of a text, with an ellipsis if there are more."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def contains_ignoring_case(column: Column, part: str) -> Column:
    return F.contains(F.lower(column), F.lit(part.lower()))
