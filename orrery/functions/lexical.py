"""Lexical features: term frequencies of a vocabulary of tokens and of token pairs, of unit length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors

UNIGRAMS, BIGRAMS = 50, 15

# The terms of the unigram places, in order ("set" has two places).
VOCABULARY = [
    "function", "class", "const", "let", "var", "return", "async", "await", "import", "export", "default", "module", "require", "if", "else", "for",
    "while", "switch", "case", "break", "continue", "try", "catch", "throw", "finally", "string", "number", "boolean", "array", "object", "null",
    "undefined", "true", "false", "map", "set", "list", "dict", "this", "self", "new", "constructor", "extends", "super", "static", "private",
    "public", "protected", "get", "set",
]

# The pairs of the bigram places, in order.
BIGRAM_VOCABULARY = [
    "async_await", "async_function", "await_promise", "try_catch", "catch_error", "throw_error", "throw_new", "if_else", "else_if", "for_loop",
    "while_loop", "return_value", "return_null", "return_false", "return_true",
]


def tokens(text: Column) -> Column:
    """Words of two ASCII letters or more; camel case and underscores split, lower case."""
    split = F.translate(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "_", " ")
    return F.regexp_extract_all(F.lower(split), F.lit(r"\b[a-zA-Z]{2,}\b"), 0)


def bigrams(toks: Column) -> Column:
    def pairs(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.zip_with(F.slice(t, 1, n), F.slice(t, 2, n), lambda a, b: F.concat_ws("_", a, b))

    return vectors.let(toks, pairs)


def _fitted(terms: list[str] | None, default: list[str], width: int, filler: str) -> list[str]:
    terms = list(default if terms is None else terms)[:width]
    return terms + [f"{filler}_{i}" for i in range(len(terms), width)]


def _frequencies(items: Column, vocabulary: list[str]) -> Column:
    """The share of each term; items is computed once for all terms, which are counted among those that are terms at all."""
    terms = F.array(*[F.lit(t) for t in vocabulary])
    share = lambda known, n, t: F.size(F.filter(known, lambda w: w == t)) / n
    known = lambda x: F.filter(x, lambda w: w.isin(vocabulary))
    return vectors.let(items, lambda x: vectors.let(known(x), lambda k: F.transform(terms, lambda t: share(k, F.greatest(F.size(x), F.lit(1)), t))))


def features(text: Column, vocabulary: list[str] | None = None, bigram_vocabulary: list[str] | None = None) -> Column:
    """65 places: 50 terms, then 15 pairs; shorter vocabularies are filled, longer ones cut."""
    one = _fitted(vocabulary, VOCABULARY, UNIGRAMS, "term")
    two = _fitted(bigram_vocabulary, BIGRAM_VOCABULARY, BIGRAMS, "bigram")
    return vectors.normalised(vectors.let(tokens(text), lambda t: F.concat(_frequencies(t, one), _frequencies(bigrams(t), two))))


def build_vocabulary(docs: DataFrame, text_col: str = "text", n: int = UNIGRAMS + BIGRAMS) -> DataFrame:
    """(term, n): the most frequent tokens of a corpus; ties by term."""
    words = docs.select(F.explode(tokens(F.col(text_col))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)


def term_scores(vector: Column, vocabulary: list[str] | None = None) -> Column:
    """map<term, score>; of a term with several places, the last counts."""
    last = {t: i for i, t in enumerate(_fitted(vocabulary, VOCABULARY, UNIGRAMS, "term"))}
    keys, places = F.array(*[F.lit(t) for t in last]), F.array(*[F.lit(i) for i in last.values()])
    return vectors.let(vector, lambda v: F.map_from_arrays(keys, F.transform(places, lambda i: F.get(v, i))))


def top_terms(vector: Column, n: int = 10, vocabulary: list[str] | None = None) -> Column:
    """The n best (score, term), best first; ties by term."""
    pairs = F.transform(F.map_entries(term_scores(vector, vocabulary)), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("term")))
    best = F.slice(F.array_sort(pairs), 1, n)
    return F.transform(best, lambda p: F.struct(p["term"].alias("term"), (-p["minus"]).alias("score")))
