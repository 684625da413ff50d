"""The corpus queries against their SQL, and the pipeline's decisions, on the smallest tables."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import licences, license_scan, oracle, queries

TABLES = ["documents", "benchmark", "labels"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    want, got = duck.execute(oracle.oracle_sql()[name]).df(), queries.queries()[name](spark, sf_dir).toPandas()
    cols = sorted(want.columns)
    order = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    assert cols == sorted(got.columns) and len(want) == len(got)
    assert (order(want) == order(got)).all().all()


def test_language_is_right_on_held_out_documents(spark, sf_dir):
    got = queries.op4_language_id(spark, sf_dir).toPandas().merge(queries.table(spark, sf_dir, "documents").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95


def test_quality_agrees_with_labels(spark, sf_dir):
    got = queries.op10_quality(spark, sf_dir).toPandas().merge(queries.acceptable(queries.table(spark, sf_dir, "labels")).toPandas(), on="doc_id")
    assert (got[got.good == 1].quality_keep).mean() > 0.95


def low(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def test_license_query_by_brute_force(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op3_license_scan(spark, sf_dir).collect()}
    for d in queries.table(spark, sf_dir, "documents").collect():
        w, r = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(d["text"])), got[d["doc_id"]]
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        first, last = (min(places)[0], max(places)[0]) if places else (None, None)
        base = {label for _, label in places}
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(places), first, last, ",".join(sorted(base)))
        text = f" {' '.join(w)} "
        whole = {label for label, t in licences.TEXTS if f" {' '.join(re.findall('[a-z0-9]+', low(t)))} " in text}
        assert base | whole <= set(r["labels"].split(",")) | ({""} if not r["labels"] else set())
        assert 0 <= r["score"] <= 1 and (r["score"] == 1 or not base | whole)


def test_bpe_and_length_queries_by_the_library(spark, sf_dir):
    import base64

    import public_tokenizers as tokenizers
    import tiktoken

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths, sha = [], lambda b: hashlib.sha256(b).hexdigest()
    got = {r["doc_id"]: r for r in queries.op1_byte_bpe(spark, sf_dir).collect()}
    for d in queries.table(spark, sf_dir, "documents").collect():
        ids, r = enc.encode_ordinary(d["text"] or ""), got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((d["text"] or "").encode()))
        lengths.append(len(ids))
    sums = {r["context_limit"]: r for r in queries.op5_token_counts(spark, sf_dir).collect()}
    assert set(sums) == set(lengths)
    for c, r in sums.items():
        assert (r["n_docs"], r["docs_above"], r["tokens_above"], r["truncated_total"]) == (lengths.count(c), sum(n > c for n in lengths), sum(n for n in lengths if n > c), sum(min(n, c) for n in lengths))


def test_pipeline_by_brute_force(spark, sf_dir):
    """Ids that each stage keeps and the digests of run(), in plain Python; what the classifier rejects is taken from its operator."""
    found = queries.op10_quality(spark, sf_dir).where("quality_keep").select("doc_id").collect()
    left = {r["doc_id"]: r["text"] or "" for r in queries.table(spark, sf_dir, "documents").collect()}
    left = {r["doc_id"]: left[r["doc_id"]] for r in found}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
    left = {i: left[i] for i in first.values()}
    sets = {}
    for i, t in left.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in left}

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(left)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((up(a), up(b)))
                root[y] = x
    left = {i: t for i, t in left.items() if up(i) == i}
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {tuple(w[k : k + min(10, len(w))]) for r in queries.table(spark, sf_dir, "benchmark").collect() if (w := cut(r["text"])) for k in range(len(w) - min(10, len(w)) + 1)}
    clean = lambda w: not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    left = {i: t for i, t in left.items() if clean(cut(t))}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(left) and len(left) > 50
    assert {i: r["decoded_sha256"] for i, r in got.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items()}


def test_stages_of_odd_rows(spark, docs, empty, sf_dir):
    """Nulls, empty and long texts, ties, repeats and columns of clashing names pass every stage; an empty table gives none."""
    wide = docs.withColumns({c: F.lit(c) for c in ("_id", "_rid", "_text", "_again", "_meta", "meta", "row")})
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, wide, sf_dir)
        assert got.columns == wide.columns or name == "byte-level bpe"
        assert 0 < got.count() <= docs.count()
        assert stage(spark, empty, sf_dir).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    columns, left = docs.columns, docs.count()
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.shared_table(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns, name
        assert docs.join(before, "doc_id", "left_anti").count() == 0
        assert docs.count() <= left
        left = docs.count()
        again = stage(spark, docs, sf_dir).count() if name != "quality classifier" else left
        assert again == left, name  # nothing is left for a second run
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == left and "n_tokens" in last.columns
