"""Structural features: 16 capped counts and ratios of a source text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx
from . import vectors

# Names of the places, in order.
NAMES = [
    "loc_normalized", "num_functions", "num_classes", "num_imports", "avg_indent", "comment_ratio", "cyclomatic_estimate", "export_count",
    "halstead_vocabulary", "halstead_volume", "halstead_difficulty", "halstead_effort", "halstead_bugs", "import_diversity", "export_ratio",
    "coupling_estimate",
]

# The patterns that the counts are made of.
FUNCTIONS = [
    r"\bfunction\s+\w+\s*\(",
    r"\bfunction\s*\(",
    r"(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\(",
    r"(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?function",
    r"\bdef\s+\w+\s*\(",
    r"\basync\s+def\s+\w+\s*\(",
    r"=>\s*\{",
]
CLASSES = [r"\bclass\s+\w+"]
IMPORTS = [r"\bimport\s+", r"\brequire\s*\(", r"\bfrom\s+['\"]", r"\bfrom\s+\w+\s+import"]
COMMENTS = [r"(?m)//.*$", r"(?m)#.*$", r"/\*[\s\S]*?\*/", r'"""[\s\S]*?"""', r"'''[\s\S]*?'''"]
DECISIONS = [r"\bif\b", r"\belse\b", r"\belif\b", r"\bfor\b", r"\bwhile\b", r"\bswitch\b", r"\bcase\b", r"\bcatch\b", r"\btry\b", r"&&", r"\|\|", r"\?.*:"]
EXPORTS = [r"\bexport\s+", r"\bexports\.", r"\bmodule\.exports", r"__all__\s*="]
SOURCES = [
    r"from\s+['\"]([^'\"]+)['\"]",
    r"require\s*\(\s*['\"]([^'\"]+)['\"]\s*\)",
    r"(?m)^\s*import\s+(\w+)",
    r"(?m)^\s*from\s+(\w+)",
]
DEFINITIONS = [r"\bfunction\s+\w+\s*\(", r"\bdef\s+\w+\s*\(", r"(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?\(", r"\bclass\s+\w+"]
EXPORTED = [
    r"\bexport\s+(?:default\s+)?(?:function|class|const|let|var)",
    r"\bexport\s*\{",
    r"\bexports\.\w+\s*=",
    r"\bmodule\.exports\s*=",
    r"__all__\s*=",
]
# Patterns of operators, and words that are no operands.
OPERATORS = [
    r"\+\+", "--", r"\+", "-", r"\*", "/", "%", r"\*\*", "===", "!==", "==", "!=", ">=", "<=", ">", "<", "&&", r"\|\|", "!", "&", r"\|", r"\^", "~",
    "<<", ">>", r"\+=", "-=", r"\*=", "/=", "%=", "=", r"\?", ":", r"\.", ",", ";", r"\(", r"\)", r"\[", r"\]", r"\{", r"\}", r"\bif\b", r"\belse\b",
    r"\bfor\b", r"\bwhile\b", r"\breturn\b", r"\bfunction\b", r"\bdef\b", r"\bclass\b", r"\btry\b", r"\bcatch\b", r"\bthrow\b", r"\braise\b",
    r"\bimport\b", r"\bfrom\b", r"\bexport\b",
]
NOT_OPERANDS = [
    "if", "else", "for", "while", "return", "function", "def", "class", "try", "catch", "throw", "raise", "import", "from", "export", "const", "let",
    "var", "in", "of", "and", "or", "not", "True", "False", "None", "true", "false", "null", "undefined",
]
#: What a line that isn't blank begins with, and what is in no sign of OPERATORS.
INDENT, NO_SIGNS = r"(?m)^([^\S\n]*)\S", r"[^-+*/%=!<>&|^~?:.,;()\[\]{}]+"
IDENTIFIER, NUMBER = r"\b[a-zA-Z_][a-zA-Z0-9_]*\b", r"\b\d+\.?\d*\b"
#: Comments and strings go in this order; strings leave their quotes.
STRIPPED = [
    (r'"""[\s\S]*?"""', ""),
    (r"'''[\s\S]*?'''", ""),
    (r"/\*[\s\S]*?\*/", ""),
    (r"(?m)//.*$", ""),
    (r"(?m)#.*$", ""),
    (r'"[^"\\]*(?:\\.[^"\\]*)*"', '""'),
    (r"'[^'\\]*(?:\\.[^'\\]*)*'", "''"),
    (r"`[^`\\]*(?:\\.[^`\\]*)*`", "``"),
]


def _capped(x: Column, most: float) -> Column:
    return F.least(x / F.lit(most), F.lit(1.0))


def average_indent(text: Column) -> Column:
    """Mean indent of lines that aren't blank, by four spaces and four levels."""

    def mean(indents: Column) -> Column:
        n = F.size(indents)
        return F.when(n > 0, F.least(tx.length_of(indents) / 4.0 / F.greatest(n, F.lit(1)) / 4.0, F.lit(1.0))).otherwise(F.lit(0.0))

    return vectors.let(tx.extract(text, INDENT, 1), mean)


def comment_ratio(text: Column) -> Column:
    found = None
    for p in COMMENTS:
        n = tx.length_of(tx.extract(text, p, 0))
        found = n if found is None else found + n
    return F.least(found / F.greatest(F.length(text), F.lit(1)), F.lit(1.0))


def stripped(text: Column) -> Column:
    return tx.replace_all(text, STRIPPED)


def operands(text: Column, words: Column) -> Column:
    """Of a text and its identifiers."""
    return F.concat(F.filter(words, lambda x: ~x.isin(NOT_OPERANDS)), tx.extract(text, NUMBER, 0))


def decisions(text: Column) -> Column:
    """Matches of all DECISIONS: keywords are counted among the text's words."""
    words, others = _keywords(DECISIONS)
    return F.size(F.filter(tx.extract(text, tx.WORD, 0), lambda x: x.isin(words))) + tx.counts(text, others)


def _keywords(patterns: list[str]) -> tuple[list[str], list[str]]:
    """The keywords w of patterns `\\bw\\b`, and the other patterns."""
    found = [re.fullmatch(r"\\b(\w+)\\b", p) for p in patterns]
    return [m[1] for m in found if m], [p for p, m in zip(patterns, found, strict=True) if not m]


def halstead(n1: Column, n2: Column, big1: Column, big2: Column) -> list[Column]:
    """Vocabulary, volume, difficulty, effort and bugs; zeros without operators or operands."""
    some = (n1 > 0) & (n2 > 0)
    volume = (big1 + big2) * F.log2((n1 + n2).cast("double"))
    difficulty = (n1 / F.lit(2.0)) * (big2 / F.greatest(n2, F.lit(1)))
    values = [_capped(n1 + n2, 200.0), _capped(volume, 10000.0), _capped(difficulty, 50.0), _capped(difficulty * volume, 500000.0), _capped(volume / 3000.0, 5.0)]
    return [F.when(some, v).otherwise(F.lit(0.0)) for v in values]


def import_sources(text: Column) -> Column:
    """Distinct sources of import statements."""
    return F.array_distinct(F.concat(*[tx.extract(text, p, 1) for p in SOURCES]))


def coupling(text: Column) -> list[Column]:
    """Import diversity, export ratio and coupling estimate."""
    sources = import_sources(text)
    n = F.size(sources)
    outside = F.size(F.filter(sources, lambda s: ~s.startswith(".")))
    diversity = _capped(n, 20.0)
    defined, exported = tx.counts(text, DEFINITIONS), tx.counts(text, EXPORTED)
    ratio = F.when(defined > 0, F.least(exported / F.greatest(defined, F.lit(1)), F.lit(1.0))).otherwise(F.when(exported == 0, F.lit(0.0)).otherwise(F.lit(1.0)))
    return [diversity, ratio, diversity * 0.6 + (outside / F.greatest(n, F.lit(1))) * 0.4]


def _halstead_of(clean: Column) -> Column:
    words, signs = _keywords(OPERATORS)  # signs are plain texts
    bare = F.regexp_replace(clean, NO_SIGNS, " ")

    def measures(c: Column, named: Column) -> Column:
        known, used = F.filter(named, lambda x: x.isin(words)), operands(clean, named)
        n1 = F.size(F.filter(c, lambda x: x > 0)) + F.size(F.array_distinct(known))
        big1 = F.aggregate(c, F.lit(0), lambda s, x: s + x) + F.size(known)
        return vectors.let(used, lambda u: F.array(*halstead(n1, F.size(F.array_distinct(u)), big1, F.size(u))))

    counts = vectors.let(bare, lambda b: F.array(*[tx.occurrences(b, re.sub(r"\\(.)", r"\1", p)) for p in signs]))
    return vectors.let(counts, lambda c: vectors.let(tx.extract(clean, IDENTIFIER, 0), lambda named: measures(c, named)))


def features(text: Column) -> Column:
    """The 16 places; stripped text, operands and counts are computed once each."""
    loc = F.size(tx.lines(text))
    basic = F.array(
        _capped(loc, 500.0),
        _capped(tx.counts(text, FUNCTIONS), 20.0),
        _capped(tx.counts(text, CLASSES), 10.0),
        _capped(tx.counts(text, IMPORTS), 30.0),
        average_indent(text),
        comment_ratio(text),
        F.least(decisions(text) / F.greatest(loc, F.lit(1)) * 5.0, F.lit(1.0)),
        _capped(tx.counts(text, EXPORTS), 15.0),
    )
    return F.concat(basic, vectors.let(stripped(text), _halstead_of), F.array(*coupling(text)))
