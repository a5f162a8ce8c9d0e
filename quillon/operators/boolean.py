"""Boolean retrieval: a query language compiled to one filter over the registry."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import contains_ignoring_case, query_tokens
from quillon.functions.weights import plain
from quillon.operators.index import Index

Analyzer = Callable[[str], list[str]]


class BooleanParseError(Exception):
    """A query that cannot be parsed."""


# What a token of a query is, and the messages of errors.
TOKEN = r"[()]|[^\s()]+"
ONLY_STOPWORDS = "Query term {!r} consists only of stopwords — it cannot be matched"
MISPLACED = "Operator {!r} in unexpected position"
UNEXPECTED = "Unexpected token: {!r} — check operator placement or parentheses"
ENDED = "Unexpected end of boolean expression"
UNCLOSED = "Missing closing parenthesis ')'"


@dataclass(frozen=True)
class Term:
    stems: tuple[str, ...]


@dataclass(frozen=True)
class Not:
    inner: object


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


def parse(query: str, analyzer: Analyzer = query_tokens):
    """Syntax tree; NOT binds closer than AND, AND (also unwritten, between neighbours) closer than OR.

    Works off a list of tokens with a stack of open brackets, each with its finished alternatives, its
    current conjunction and the number of NOTs that wait for an operand.
    """
    stack = [([], [], 0)]  # alternatives, conjunction, NOTs
    wants = True  # whether an operand must come

    def operand(node):
        nonlocal wants
        alternatives, conjunction, nots = stack[-1]
        for _ in range(nots):
            node = Not(node)
        conjunction.append(node)
        stack[-1] = (alternatives, conjunction, 0)
        wants = False

    def closed(frame):
        alternatives, conjunction, _ = frame
        parts = [*alternatives, And(tuple(conjunction)) if len(conjunction) > 1 else conjunction[0]]
        return Or(tuple(parts)) if len(parts) > 1 else parts[0]

    for token in re.findall(TOKEN, query):
        if token == "(":
            stack.append(([], [], 0))
            wants = True
        elif token == "NOT":
            alternatives, conjunction, nots = stack[-1]
            stack[-1] = (alternatives, conjunction, nots + 1)
            wants = True
        elif token in ("AND", "OR", ")") and wants:
            if token == ")":
                raise BooleanParseError(ONLY_STOPWORDS.format(token))
            raise BooleanParseError(MISPLACED.format(token))
        elif token == "AND":
            wants = True
        elif token == "OR":
            alternatives, conjunction, _ = stack[-1]
            stack[-1] = ([*alternatives, And(tuple(conjunction)) if len(conjunction) > 1 else conjunction[0]], [], 0)
            wants = True
        elif token == ")":
            if len(stack) == 1:
                raise BooleanParseError(UNEXPECTED.format(token))
            operand(closed(stack.pop()))
        else:
            stems = tuple(analyzer(token))
            if not stems:
                raise BooleanParseError(ONLY_STOPWORDS.format(token))
            operand(Term(stems))
    if wants:
        raise BooleanParseError(ENDED)
    if len(stack) > 1:
        raise BooleanParseError(UNCLOSED)
    return closed(stack[0])


def condition(node, flags: dict[str, Column]) -> Column:
    """The tree as one expression over a flag for each stem."""
    if isinstance(node, Not):
        return ~condition(node.inner, flags)
    parts = [flags[s] for s in node.stems] if isinstance(node, Term) else [condition(p, flags) for p in node.parts]
    out = parts[0]
    for p in parts[1:]:
        out = (out | p) if isinstance(node, Or) else (out & p)
    return out


def upper_operators(query: str) -> str:
    """Lower-case and, or, not as operators; other spellings stay words."""
    return re.sub(r"\b(and|or|not)\b", lambda m: m[0].upper(), query)


def matched_stems(query: str, analyzer: Analyzer = query_tokens) -> list[str]:
    """Stems of all words of a query, operators aside (negated words count)."""
    words = [w for w in re.findall(r"[^\s()]+", query) if w.upper() not in ("AND", "OR", "NOT")]
    return list(dict.fromkeys(s for w in words for s in analyzer(w)))


def boolean_search(index: Index, query: str, filters: dict[str, str] | None = None, analyzer: Analyzer = query_tokens) -> DataFrame:
    """All documents for which the query holds, with ``score`` and ``terms_matched``, by score and doc_id.

    One aggregation over the stems' postings, one left join with the registry; NOT holds for documents
    without tokens, too.  ``filters`` takes region and tradition (substrings, any case).
    """
    query = upper_operators(query)
    tree = parse(query, analyzer)
    stems = matched_stems(query, analyzer)
    flag = {s: f"has_{i}" for i, s in enumerate(stems)}
    hits = index.of_terms(stems).groupBy("doc_id").agg(
        *(F.max(F.col("term") == s).alias(flag[s]) for s in stems), F.sum(plain(index.n_docs)).alias("score"), F.array_sort(F.collect_set("term")).alias("terms_matched")
    )
    rows = index.registry
    for name in ("region", "tradition"):
        if filters and filters.get(name):
            rows = rows.where(contains_ignoring_case(F.col(name), filters[name]))
    joined = rows.join(hits, "doc_id", "left")
    holds = condition(tree, {s: F.coalesce(F.col(c), F.lit(False)) for s, c in flag.items()})
    score = F.round(F.coalesce("score", F.lit(0.0)), 6)
    terms = F.coalesce("terms_matched", F.array().cast("array<string>"))
    found = joined.where(holds).withColumn("_exact", F.coalesce("score", F.lit(0.0))).withColumn("score", score).withColumn("terms_matched", terms)
    return found.orderBy(F.desc(F.round("_exact", 10)), "doc_id").drop("_exact", *flag.values())
