"""Rules that turn a question in plain words into a search."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import query_tokens

# Names by which traditions and regions are known, type codes, filler phrases and connectives.
TRADITIONS = {
    "panchatantra": "Panchatantra", "hitopadesha": "Hitopadesha", "hitopadesa": "Hitopadesha", "jataka": "Jataka", "vikramaditya": "Vikramaditya",
    "baital pachisi": "Vikramaditya", "baital": "Vikramaditya", "birbal": "Birbal-Akbar", "akbar": "Birbal-Akbar", "tenali": "Tenali Raman",
    "tenali raman": "Tenali Raman", "puranic": "Puranic/Mythological", "ramayana": "Puranic/Mythological", "mahabharata": "Puranic/Mythological",
}
REGIONS = {
    "kashmir": "Kashmir", "punjab": "Punjab", "bengal": "Bengal", "odisha": "Odisha", "magadha": "Magadha", "ujjain": "Ujjain", "andhra": "Andhra Pradesh",
    "karnataka": "Karnataka", "south india": "South India", "north india": "North India",
}
TYPE_NUMBERS = ("122", "91", "910", "545", "1430", "157", "2040", "610", "217")
FILLERS = (
    r"^(find|show|search for|give me|list|display)\s+(me\s+)?(all\s+)?(tales?|stories?|texts?|variants?)?\s*(about|on|regarding|from|in|with|where)?\s*",
    r"^(which|what)\s+(tales?|stories?)\s+(involve|feature|contain|include|are about)\s*",
    r"^tell me about\s*",
    r"\s*please\s*",
    r"\s*in the corpus\s*",
)
CONNECTIVES = (r"\bbut not\b", r"\band not\b", r"\bor else\b", r"\beither\b.*?\bor\b", r"\bboth\b.*?\band\b")


@dataclass(frozen=True)
class Question:
    mode: str
    original: str
    normalized: str
    structured: str
    terms: tuple[str, ...]
    traditions: tuple[str, ...] = ()
    regions: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    expansions: dict = field(default_factory=dict)

    @property
    def filters(self) -> dict[str, str]:
        """The first name found of each kind."""
        found = {"tradition": self.traditions, "region": self.regions, "tale_type": self.types}
        return {k: v[0] for k, v in found.items() if v}


def strip_fillers(text: str) -> str:
    """Without filler phrases; those inside the text leave one space."""
    for i, pattern in enumerate(FILLERS):
        text = re.sub(pattern, "" if i < 3 else " ", text, flags=re.IGNORECASE).strip()
    return re.sub(r"\s{2,}", " ", text)


def _names(text: str, lexicon: dict[str, str]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(name for key, name in lexicon.items() if key in text))


def _type_pattern(number: str, anchored: bool) -> str:
    return rf"atu[\s-]?{number}" + (r"(?!\d)" if anchored else "")


def parse_question(query: str, analyzer: Callable[[str], list[str]] = query_tokens, anchored_types: bool = False) -> Question:
    """Mode, terms and names of a question.

    It is Boolean if it has an upper-case operator or brackets, or a phrase such as "but not" or "either ... or"; such
    phrases become operators, and then "and" and "or" do, too.  ``anchored_types`` keeps a type's number from
    being the beginning of a longer one.
    """
    text = strip_fillers(query.strip().lower())
    types = tuple(f"ATU-{n}" for n in TYPE_NUMBERS if re.search(_type_pattern(n, anchored_types), text))
    explicit = bool(re.search(r"\b(AND|OR|NOT)\b", query) or re.search(r"\([^)]+\)", query))
    implicit = any(re.search(p, text) for p in CONNECTIVES)
    structured = text
    if implicit:
        for pattern, by in ((r"\b(but|and) not\b", " NOT "), (r"\bboth\b", ""), (r"\band\b", " AND "), (r"\bor\b", " OR ")):
            structured = re.sub(pattern, by, structured)
    elif explicit:
        structured = query
    terms = tuple(analyzer(text))
    return Question("boolean" if explicit or implicit else "vsm", query, " ".join(terms), structured.strip(), terms, _names(text, TRADITIONS), _names(text, REGIONS), types)


def batch_entities(queries: DataFrame, column: str = "query_text") -> DataFrame:
    """``queries`` with ``mode``, ``tradition``, ``region`` and ``tale_type`` as found in each question (null: none), without a Python loop."""
    raw = F.coalesce(F.col(column), F.lit(""))

    def stripped(x: F.Column) -> F.Column:
        return F.regexp_replace(x, r"^\s+|\s+$", "")

    text = stripped(F.lower(raw))
    for i, pattern in enumerate(FILLERS):
        text = stripped(F.regexp_replace(text, pattern, "" if i < 3 else " "))
    text = F.regexp_replace(text, r"\s{2,}", " ")

    def first(pairs):
        return F.coalesce(*(F.when(test, F.lit(name)) for test, name in pairs))

    implicit = text.rlike("|".join(CONNECTIVES))
    explicit = raw.rlike(r"\b(AND|OR|NOT)\b") | raw.rlike(r"\([^)]+\)")
    return queries.select(
        "*", F.when(implicit | explicit, "boolean").otherwise("vsm").alias("mode"), first((F.contains(text, F.lit(k)), v) for k, v in TRADITIONS.items()).alias("tradition"),
        first((F.contains(text, F.lit(k)), v) for k, v in REGIONS.items()).alias("region"),
        first((text.rlike(_type_pattern(n, False)), f"ATU-{n}") for n in TYPE_NUMBERS).alias("tale_type"),
    )
