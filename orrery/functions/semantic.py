"""Semantic features: the share of each domain's keywords. Domains are a parameter."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx
from . import vectors

# The default domains, in order, and their keywords.
DOMAINS = {
    "auth": [
        "login", "logout", "password", "token", "session", "auth", "authenticate", "authorize", "jwt", "credential", "user", "permission", "role",
        "access", "security", "encrypt", "decrypt", "hash", "salt", "oauth", "sso", "2fa", "mfa", "verify", "signin", "signup",
    ],
    "db": [
        "query", "select", "insert", "update", "delete", "database", "model", "schema", "table", "column", "row", "migration", "seed", "sql",
        "nosql", "mongo", "postgres", "mysql", "redis", "orm", "repository", "entity", "transaction", "commit", "rollback", "index", "foreign",
        "primary", "constraint",
    ],
    "api": [
        "route", "router", "endpoint", "request", "response", "http", "rest", "graphql", "controller", "handler", "middleware", "get", "post", "put",
        "patch", "delete", "api", "fetch", "axios", "cors", "header", "body", "param", "query", "status", "json", "webhook", "socket", "websocket",
    ],
    "ui": [
        "render", "component", "view", "style", "css", "scss", "click", "button", "form", "input", "modal", "dialog", "menu", "nav", "layout",
        "page", "screen", "widget", "element", "dom", "html", "jsx", "tsx", "template", "props", "state", "hook", "effect", "ref", "context",
        "redux", "store",
    ],
    "util": [
        "helper", "util", "utils", "format", "parse", "convert", "transform", "validate", "sanitize", "escape", "encode", "decode", "serialize",
        "deserialize", "stringify", "clone", "merge", "deep", "flatten", "chunk", "debounce", "throttle", "memoize", "cache", "logger", "log",
        "error", "config", "constant", "enum",
    ],
}


def keyword_pattern(words: list[str]) -> str:
    """One alternation for a domain: keywords are whole words, so they can't overlap."""
    return r"\b(?:" + "|".join(re.escape(w.lower()) for w in words) + r")\b"


def features(text: Column, domains: dict[str, list[str]] | None = None) -> Column:
    """A distribution over the domains; even if no keyword occurs."""
    domains = DOMAINS if domains is None else domains
    low = F.lower(text)
    plain = {d: [w.lower() for w in words] for d, words in domains.items() if all(re.fullmatch(r"[a-z0-9_]+", w.lower()) for w in words)}
    every = sorted({w for words in plain.values() for w in words})

    def score(d: str, found: Column) -> Column:
        if not domains[d]:
            return F.lit(0.0)
        n = F.size(F.filter(found, lambda x: x.isin(plain[d]))) if d in plain else tx.count(low, keyword_pattern(domains[d]))
        return n.cast("double")

    known = F.filter(tx.extract(low, tx.WORD, 0), lambda x: x.isin(every)) if every else F.array()
    scores = vectors.let(known, lambda found: F.array(*[score(d, found) for d in domains]))
    even = F.array(*[F.lit(1.0 / len(domains)) for _ in domains])
    shares = lambda s, t: F.when(t > 0, F.transform(s, lambda x: x / t)).otherwise(even)
    return vectors.let(scores, lambda s: vectors.let(vectors.total(s), lambda t: shares(s, t)))


def dominant_domain(vector: Column, domains: dict[str, list[str]] | None = None) -> Column:
    """The first domain of the largest share."""
    return vectors.argmax_name(list(DOMAINS if domains is None else domains), vector)


def distribution(vector: Column, domains: dict[str, list[str]] | None = None) -> Column:
    """map<domain, share>."""
    return F.map_from_arrays(F.array(*[F.lit(d) for d in (DOMAINS if domains is None else domains)]), vector)
