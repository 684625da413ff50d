"""The corpus operators against brute force in plain Python, with the cases of the contract."""

import base64
import hashlib
import re
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import bpe, components, decontaminate, exact_dedup, language_id, licences, license_scan, ngram_join, quality, substring_dedup, suffix_dedup, token_histogram
from orrery.llm import textkernel as tk

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def sha(b):
    return hashlib.sha256(b).hexdigest()


# ---- op 1 and 5


@pytest.fixture(scope="module")
def reference_encoder():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab thé ñ\t\n\r\x0b\x1c\x85  1٣²'sl日本한😀​.!_-~\0", max_size=60))
def test_bpe_equals_the_library(text):
    import tiktoken

    global _ENC, _LIB
    if "_ENC" not in globals():
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
        _LIB = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _ENC = bpe.Encoder(PATH, P.PATTERN, remember=50)
    out = array("i")
    _ENC.encode(text, out)
    assert out.tolist() == _LIB.encode_ordinary(text)


def test_bpe_of_one_long_match(reference_encoder):
    text = "abcdefgh" * 5000
    out = array("i")
    bpe.Encoder(PATH, P.PATTERN).encode(text, out)
    assert out.tolist() == reference_encoder.encode_ordinary(text)


def test_bpe_round_trip(docs, reference_encoder):
    want = {i: reference_encoder.encode_ordinary(t or "") for i, t in texts(docs)}
    two = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH)
    one = bpe.round_trip(docs, PATH, P.PATTERN)
    for got in (one, two):
        for r in got.collect():
            assert r["token_ids"] == want[r["doc_id"]]
    for r in two.collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.count(docs, PATH, P.PATTERN).collect()} == {i: len(x) for i, x in want.items()}
    with pytest.raises(ValueError):
        bpe.encode(docs, PATH, P.PATTERN, out_col="lang")


def test_token_histogram(spark):
    lengths = [0, 3, 3, 7, 2000, 5000, 5000, None]
    got = token_histogram.suffix_sums(token_histogram.histogram(spark.createDataFrame([(n,) for n in lengths], "n_tokens bigint")), block=4)
    n = [x or 0 for x in lengths]
    assert got.count() == 5
    for r in got.collect():
        c = r["context_limit"]
        assert r["truncated_total"] == sum(min(x, c) for x in n)
        assert r["docs_above"] == sum(x > c for x in n) and r["tokens_above"] == sum(x for x in n if x > c)
        assert (r["n_docs"], r["tokens_total"], r["quantile"]) == (n.count(c), sum(n), pytest.approx(sum(x <= c for x in n) / len(n)))
    assert token_histogram.truncated_total(got, 100).first()["truncated_total"] == sum(min(x, 100) for x in n)
    assert token_histogram.quantile(got, 0.5).first()["length"] == 3
    none = token_histogram.suffix_sums(token_histogram.histogram(spark.createDataFrame([], "n_tokens bigint")))
    assert none.count() == 0 and token_histogram.truncated_total(none, 5).first()["truncated_total"] == 0


def test_tokens_of_no_rows_and_of_rows_that_repeat(docs, empty):
    assert bpe.round_trip(empty, PATH, P.PATTERN).count() == bpe.count(empty, PATH, P.PATTERN).count() == 0
    got = bpe.count(docs.select("doc_id", "text", "n", "token"), PATH, P.PATTERN)
    assert got.columns == ["doc_id", "text", "n", "token", "n_tokens"] and got.where("doc_id = 2").distinct().count() == 1
    hist = token_histogram.histogram(got.withColumn("n_docs", F.lit(7)))
    assert hist.agg(F.sum("n_docs")).first()[0] == docs.count()


# ---- op 2


def shingle_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return set() if not w else {tuple(w)} if len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_components(rows, n, percent):
    sets, comp = {}, {i: i for i, _ in rows}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t, n))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for a, sa in flat:
        for b, sb in flat:
            if 100 * len(sa & sb) >= percent * len(sa | sb):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def test_jaccard_join(docs, empty):
    got = ngram_join.jaccard_components(docs, n=4, percent=85)
    want = brute_components(texts(docs), 4, 85)
    assert got.count() == docs.count()
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want
    assert ngram_join.jaccard_components(empty).count() == 0
    kept = ngram_join.drop_near_copies(docs, n=4, percent=85)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, c in want.items() if i == c}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join_of_mutants(spark, seed):
    """Chains of near copies, common passages, short texts: every link of brute force."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 4000)}"
    line = [word() for _ in range(14)]
    rows = []
    for b in range(12):
        base = [word() for _ in range(int(rng.integers(8, 160)))]
        for _ in range(int(rng.integers(1, 14))):
            base = list(base)  # each copy is of the last one
            for _ in range(int(rng.integers(0, 4))):
                base[int(rng.integers(0, len(base)))] = word()
            rows.append((len(rows) + 1, " ".join((line if b % 2 else []) + base)))
    for _ in range(30):
        rows.append((len(rows) + 1, " ".join(line + [word() for _ in range(int(rng.integers(0, 5)))])))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), n=4, percent=85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == brute_components(rows, 4, 85)


def near_groups(spark):
    """Documents of two components each that share a passage, so that only the matrix can tell them apart."""
    rng = np.random.default_rng(5)
    rows = []
    for b in range(30):
        common = [f"c{b}_{i}" for i in range(160)]
        for v in range(6):  # similarity of about 0.5 between the two halves, 0.9 within each
            base = common + [f"v{b}_{v % 2}_{i}" for i in range(80)]
            base[165 + 9 * v] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows) + 1, " ".join(base)))
    return rows


def test_groups_are_skipped_by_the_bound_and_links_come_from_opened_ones(spark):
    rows = near_groups(spark)
    texts_ = spark.createDataFrame([(i, t) for i, t in rows], "_id bigint, text string")
    order = ngram_join.Order(ngram_join.frequent_tokens(texts_, 4, True))
    table = ngram_join.prefixes(texts_, 4, 85, True, order).select(F.col("n_shingles").alias("n"), "prefix")
    tokens = ngram_join.shared_table(ngram_join.open_documents(texts_, 4, 85, True, order, ngram_join.shared_tokens(table, 85, 20)), "tokens")
    open_ = ngram_join.still_open(tokens.select("doc", "n", "keys", "prefix").withColumn("component", F.col("doc")), 85)  # no group has been opened for its own members
    groups = ngram_join.shared_table(ngram_join.grouped(open_, 85, group=2), "groups")
    met = ngram_join.shared_table(ngram_join.met_groups(groups, 85), "met")
    found = ngram_join.opened(met, ngram_join.matrix(groups, tokens), 85)
    assert 0 < found.count() < met.count()  # the bound leaves some closed
    pairs = {tuple(sorted(p)) for p in ngram_join.candidates(found, 85).select("u", "v").toPandas().itertuples(index=False, name=None)}
    sets = {i: shingle_set(t, 4) for i, t in rows}
    group_of = dict(groups.select("doc", "grp").toPandas().itertuples(index=False, name=None))
    links = {(a, b) for a in sets for b in sets if a < b and group_of[a] != group_of[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}
    assert links and links <= pairs


def test_jaccard_join_of_halves_and_of_ids_that_repeat(spark):
    rows = near_groups(spark)
    rows += [(500, rows[0][1]), (500, rows[40][1]), (None, rows[0][1]), (None, "a b c d e f g")]  # one id, texts of two components
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = ngram_join.jaccard_components(df, n=4, percent=85)
    want = brute_components([r for r in rows if r[0] is not None], 4, 85)
    assert {r["doc_id"]: r["component_id"] for r in got.where("doc_id is not null").collect()} == want
    assert {r["component_id"] for r in got.where("doc_id is null").collect()} == {1, None}
    kept = ngram_join.drop_near_copies(df.withColumn("_rid", F.lit(1)).withColumn("row", F.lit(2)), n=4, percent=85)
    assert kept.columns == ["doc_id", "text", "_rid", "row"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [i for i, c in want.items() if i == c] + [None, None]))


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101)], "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in components.components(e).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}


# ---- op 3


def test_license_places(docs):
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for i, t in texts(docs):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
        want = [(label, k) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert got[i]["n_words"] == len(w)
        assert sorted((x["label"], x["start"]) for x in got[i]["phrase_places"]) == sorted(want)


def test_license_chain_and_phrases_within_notices(spark):
    gpl = next(t for label, t in licences.TEXTS if t.startswith("This work is licensed under the GNU"))
    mit = next(t for label, t in licences.TEXTS if label == "mit")
    permission, warranty = mit.split("\n")[0], mit.split("\n")[-1]
    cut = permission.replace("free of charge", "FREE -- and no charge").replace("furnished to do so", "given")
    rows = [(1, "foo " + gpl + " bar"), (2, cut), (3, "a gnu general public zoo"), (4, "released under the MIT License apache license version 2"), (5, "the the mit license"), (6, "# " + warranty.replace("\n", "\n# ")), (7, mit + " x " + mit)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("label", F.lit("l"))
    got = {r["doc_id"]: r for r in license_scan.scan(docs.unionByName(docs)).collect()}  # rows that repeat
    whole = [x for x in got[1]["notice_spans"] if x["label"] == "gpl-3" and x["cover"] == 1.0]
    assert (whole[0]["start"], whole[0]["end"]) == (1, 13)
    assert got[2]["notice_spans"] and 0 < max(x["cover"] for x in got[2]["notice_spans"] if x["label"] == "mit")
    assert not [x for x in got[3]["notice_spans"] if x["cover"] >= license_scan.MIN_COVER]
    assert [(x["label"], x["start"]) for x in got[4]["phrase_places"]] == [("mit", 1), ("apache-2", 5)]
    assert not got[5]["phrase_places"]
    assert max(x["cover"] for x in got[6]["notice_spans"] if x["label"] == "mit") == 1.0  # the body without the opening
    assert [x["start"] for x in got[7]["notice_spans"] if x["label"] == "mit" and x["cover"] == 1.0][0] == 0
    assert license_scan.scan(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.integers(0, 3), max_size=30))
def test_matching_statistics(templates, text):
    a = license_scan.Automaton.of(templates)
    runs = {tuple(t[i:j]) for t in templates for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    state, length = 0, 0
    for i, c in enumerate(text):
        while state and c not in a.next[state]:
            state, length = a.link[state], a.length[a.link[state]]
        state = a.next[state].get(c, 0)
        length = length + 1 if state else 0
        assert length == max((n for n in range(i + 2) if n == 0 or tuple(text[i + 1 - n : i + 1]) in runs), default=0)


# ---- op 4


def test_language_id(spark):
    rng = np.random.default_rng(3)
    letters = {"aa": "abcdef ", "bb": "ghijkl ", "cc": "éèabgh "}
    rows = [(i, "".join(rng.choice(list(letters[lang]), 80)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    train = spark.createDataFrame(rows[:120], "doc_id bigint, text string, lang string")
    model = language_id.train(train, "lang", "text", F.xxhash64("doc_id"), per_lang=20, n_landmarks=12)
    more = [(1000, None, "aa"), (1001, "", "aa"), (1002, "123 !?", "aa"), (1003, "abc" * 40_000, "aa")]
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(rows[120:] + more, "doc_id bigint, text string, lang string"), model).collect()}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang in rows[120:]]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert language_id.train(train.limit(0), "lang", "text", F.xxhash64("doc_id")) is None
    assert language_id.predict(train.select("doc_id", "text"), None).first()["lang_pred"] == "und"


def brute_grams(text, order=4):
    b = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in text.encode())
    return {b[i : i + k] for k in range(1, order + 1) for i in range(len(b) - k + 1)}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet="aBcé日 1\0", max_size=20), min_size=1, max_size=6))
def test_kernel_by_brute_force(items):
    raw = [t.encode() for t in items]
    found, first = language_id.grams(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64), 4)
    sets = [brute_grams(t) for t in items]
    assert [b - a for a, b in zip(first[:-1], first[1:])] == [len(s) for s in sets]
    k = language_id.Landmarks([found[a:b] for a, b in zip(first[:-1], first[1:])][:3]).kernel(found, first, step=2)
    want = [[len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b))) for b in sets[:3]] for a in sets]
    assert np.allclose(k, want, atol=1e-6)


def test_language_scores_by_brute_force(spark):
    """The whole sample as landmarks: Nystroem's map is the kernel itself, and scores are of plain kernel ridge regression."""
    rng = np.random.default_rng(8)
    letters = {"aa": "abcdef ", "bb": "defghi ", "cc": "éèabgh "}
    rows = [(i, "".join(rng.choice(list(letters[lang]), 12)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.train(df, "lang", "text", F.col("doc_id"), n_landmarks=36, ridge=0.5)
    sets = [brute_grams(t) for _, t, _ in rows]
    k = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    y = np.array([[1.0 if lang == name else -1.0 for name in sorted(letters)] for _, _, lang in rows])
    mid = np.eye(36) - 1 / 36
    want = y.mean(axis=0) + mid @ k @ mid @ np.linalg.solve(mid @ k @ mid + 0.5 * np.eye(36), y - y.mean(axis=0))
    got = {r["doc_id"]: r for r in language_id.predict(df.withColumn("lang", F.lit("x")), model).collect()}
    for i in range(36):
        assert got[i]["lang_pred"] == sorted(letters)[want[i].argmax()] and got[i]["score"] == pytest.approx(np.clip((want[i].max() + 1) / 2, 0, 1), abs=1e-3)


def test_language_sample_is_bounded(spark):
    """Rows without id, rows that repeat and many languages; columns of clashing names."""
    rows = [(None, f"text {i % 700}", "aa") for i in range(2000)] + [(5, "one", "bb")] * 500 + [(i, f"t{i}", f"l{i % 40}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language_id.sample_rows(df, "lang", "text", F.xxhash64("doc_id"), 20, 200).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in got} == {"aa": 4, "bb": 1} | {f"l{i}": 4 for i in range(40)}
    model = language_id.train(df, "lang", "text", F.xxhash64("doc_id"), sample=200)
    wide = df.limit(3).withColumns({c: F.lit(c) for c in ("_letter", "letter", "c0", "rank")})
    out = language_id.predict(wide, model)
    assert out.columns == ["doc_id", "lang", "_letter", "letter", "c0", "rank", "lang_pred", "score"] and out.count() == 3


# ---- op 6 and 7


def brute_bytes(rows, length):
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for k in range(len(b) - length + 1):
                w = b[k : k + length]
                first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if i is not None and first[b[k : k + length]] < i:
                gone[k : k + length] = [True] * length
        out.append((i, len(b), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), sha(bytes(c for c, g in zip(b, gone) if not g))))
    return sorted(out, key=str)


def test_suffix_dedup(docs, empty):
    got = suffix_dedup.suffix_dedup(docs)
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["removed"]), sha(bytes(r["kept"]))) for r in got.collect()), key=str)
    assert found == brute_bytes(texts(docs), 50)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_suffix_dedup_of_pasted_passages(spark, seed):
    rng = np.random.default_rng(seed)
    pool = "".join(rng.choice(list("abcdé \n"), 2000))
    rows = []
    for i in range(40):
        parts = []
        for _ in range(int(rng.integers(0, 6))):
            a, n = int(rng.integers(0, 1900)), int(rng.integers(1, 140))
            parts.append(pool[a : a + n] if rng.random() < 0.6 else "".join(rng.choice(list("xyz"), n)))
        rows.append((i if i % 13 else None, "".join(parts) * int(rng.integers(1, 3))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for flush, refined in ((200_000, 20_000), (300, 50)):
        got = suffix_dedup.suffix_dedup(df, flush=flush, refined=refined).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["removed"]), sha(bytes(r["kept"]))) for r in got), key=str) == brute_bytes(rows, 50)


def brute_words(rows, window):
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, (i, k)), (i, k))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k : k + window])] < (i, k):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_substring_dedup(docs, empty):
    got = substring_dedup.substring_dedup(docs)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_words(texts(docs), 20)
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_of_pasted_passages(spark, seed):
    rng = np.random.default_rng(seed)
    pool = [f"w{rng.integers(0, 50)}" for _ in range(600)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(int(rng.integers(0, 6))):
            a, n = int(rng.integers(0, 560)), int(rng.integers(1, 60))
            w += pool[a : a + n] if rng.random() < 0.6 else [f"u{rng.integers(0, 10**6)}" for _ in range(n)]
        rows.append((i if i % 13 else None, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    for flush, bits in ((1_500_000, 29), (100, 16)):
        got = substring_dedup.substring_dedup(df, flush=flush, max_bits=bits)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute_words(rows, 20)


# ---- op 8


def test_exact_dedup(docs, empty):
    rows = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in texts(docs)]
    for capacity in (4096, 2):
        got = exact_dedup.exact_dedup(docs, bucket_capacity=capacity).collect()
        assert len(got) == len(rows)
        for r in got:
            same = [i for i, t in rows if sha(t.encode()) == r["text_sha256"]]
            assert r["doc_id"] in same and r["keep_id"] == min(same) and r["group_size"] == len(same)
        assert sum(r["kept"] for r in got) == len({t for _, t in rows})
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len({t for _, t in rows})


def test_drop_copies_keeps_columns_of_clashing_names(spark):
    rows = [(1, "a b", "keepme", 1), (2, "a  b", "x", 2), (None, "a b", "y", 3), (3, None, "z", 4), (3, "", "u", 5), (None, "only", "v", 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _again string, _row int")
    wide = df.withColumns({c: F.lit(c) for c in ("_rid", "_sha", "_id", "_key", "_norm", "_whole", "first", "owner", "link")})
    for capacity in (4096, 1):
        kept = exact_dedup.drop_copies(wide, bucket_capacity=capacity)
        assert kept.columns == wide.columns
        got = {r["_row"]: r["_again"] for r in kept.collect()}
        assert got[1] == "keepme" and got[6] == "v" and len(got) == 3 and (4 in got) != (5 in got)


def test_rows_come_from_the_directory(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"t{i % 40}") for i in range(120)], "doc_id bigint, text string")
    assert exact_dedup.exact_dedup(df, bucket_capacity=4).count() == 120
    whole = exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: (d := whole(*a)).join(d.select(F.max("prefix").alias("prefix")), "prefix", "left_anti").select(d.columns))
    assert exact_dedup.exact_dedup(df, bucket_capacity=4).count() < 120  # a bucket that the directory lacks


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("_key"))
    d = exact_dedup.directory(keys, 50).collect()
    assert sum(r["n"] for r in d) == 1000 and max(r["n"] for r in d) <= 50
    assert len({r["depth"] for r in d}) > 1  # some buckets needed more bits than others
    assert all(r["depth"] < 24 for r in d)


def test_texts_of_one_key_are_chained(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    got = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["keep_id"] for r in got} == {1: 1, 2: 2, 3: 1}


# ---- op 9


def brute_hits(rows, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = cut(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, hit, names = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    names |= windows[tuple(w[k : k + n])]
        out.append((i, len(w), len(hit), sorted(names)))
    return sorted(out, key=str)


def test_decontaminate(spark, docs, empty):
    items = [(1, " ".join(f"w{i}" for i in range(12, 40))), (2, None), (3, ""), (4, "two words"), (5, "v3 V4 v5, v6"), (6, "w50 w51 w52 w53 w54 w55 w56 w57 w58 w59"), (7, " ".join(f"w{i}" for i in range(12, 22))), (8, "mit-license"), (9, "v3 v4 v5 v6 v7"), (None, "w1 w2")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, n_words string")
    wide = docs.withColumns({c: F.lit(1) for c in ("_text", "_id", "_th", "item", "spans", "fp")})
    got = decontaminate.decontaminate(wide, bench)
    assert got.columns[: len(wide.columns)] == wide.columns
    found = sorted(((r["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["hit_spans"]), list(r["hit_items"])) for r in got.collect()), key=str)
    assert found == brute_hits(texts(docs), items[:-1])
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert all(not r["hit_items"] for r in decontaminate.decontaminate(docs, bench.limit(0)).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_decontaminate_pasted_passages(spark, seed):
    """Few different words, so that windows, fingerprints and their surroundings often agree in part."""
    rng = np.random.default_rng(seed)
    items = [(i, " ".join(f"w{rng.integers(0, 12)}" for _ in range(int(rng.integers(0, 40))))) for i in range(25)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(int(rng.integers(0, 5))):
            x = items[int(rng.integers(0, len(items)))][1].split()
            a = int(rng.integers(0, len(x) + 1))
            w += x[a : a + int(rng.integers(1, 25))] + [f"w{rng.integers(0, 12)}" for _ in range(int(rng.integers(0, 6)))]
        rows.append((i if i % 11 else None, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    found = sorted(((r["doc_id"], r["n_words"], sum(x["end"] - x["start"] for x in r["hit_spans"]), list(r["hit_items"])) for r in got), key=str)
    assert found == brute_hits(rows, items)


# ---- op 10


def test_quality(spark, empty):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = [f"w{rng.integers(0, 300)}" for _ in range(40)] if not bad else ["BUY!!!" if rng.random() < 0.5 else f"w{rng.integers(0, 300)}" for _ in range(40)]
        rows.append((i, " ".join(words), "en", "spam" if bad and rng.random() < 0.7 else "site", 200))
        if i < 400:
            labels.append((i, int(not bad)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    lab = spark.createDataFrame(labels + [(1, None), (None, 1), (10_000, 0)], "doc_id bigint, good int")
    model = quality.train(df, lab, labelled=300, pool=100)
    got = {r["doc_id"]: r["quality_keep"] for r in quality.classify(df, model).collect()}
    assert np.mean([got[i] == bool(i % 4) for i in range(400, 600)]) > 0.97
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "xx", "new", -5)], df.schema)
    assert quality.classify(odd, model).count() == 2
    assert quality.train(df, lab.where("good = 1")) is None
    assert quality.classify(df, None).where("quality_keep").count() == 600
    assert quality.classify(empty, model).count() == 0


# ---- kernels


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 20), st.integers(1, 6)), max_size=20))
def test_merged_intervals(spans):
    g, s, n = (np.array([x[i] for x in spans], np.int64) for i in range(3))
    start, end, group = tk.merged(s, s + n, g)
    want = {(gg, p) for gg, a, m in spans for p in range(a, a + m)}
    assert {(int(gg), p) for a, b, gg in zip(start, end, group) for p in range(a, b)} == want
    assert all(group[i] != group[i + 1] or end[i] < start[i + 1] for i in range(len(start) - 1))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\x0b\né1-", max_size=12), max_size=6))
def test_words(items):
    raw = [t.encode() for t in items]
    w = tk.Words(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64), tk.NOT_SPACE)
    got = [[] for _ in items]
    for a, b, d in zip(w.start, w.end, w.doc):
        got[d].append(w.data[a:b].tobytes())
    assert got == [r.split() for r in raw]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab\0", min_size=30, max_size=30), min_size=1, max_size=25))
def test_refined_order_of_suffixes(items):
    rows = np.frombuffer("".join(items).encode(), np.uint8).reshape(len(items), 30)
    for c, order in suffix_dedup.refine(rows):
        tails = [bytes(rows[i, c:]) for i in order]
        assert tails == sorted(tails) and sorted(order.tolist()) == list(range(len(items)))


def test_surroundings_are_told_apart_by_bytes(monkeypatch):
    """Rows whose hashes are all equal: each follows only an equal row."""
    monkeypatch.setattr(suffix_dedup, "_row_hash", lambda rows: np.zeros(len(rows), np.uint64))
    rng = np.random.default_rng(9)
    rows = rng.integers(0, 2, (60, 4)).astype(np.uint8)
    same = np.zeros(60, np.uint8)
    order, lead = suffix_dedup._merge_equal(same.astype(np.uint64), rows, same, same, rng.integers(0, 9, 60))
    assert (rows[order] == rows[lead]).all()


def test_words_made_to_collide(spark):
    """A Thue-Morse word and its complement have equal sums under any polynomial hash modulo 2**64."""
    from orrery.llm import ngram_join, substring_dedup

    bits = [bin(i).count("1") % 2 for i in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    head = " ".join(f"w{i}" for i in range(19))
    df = spark.createDataFrame([(1, f"{head} {one}"), (2, f"{head} {two}")], "doc_id bigint, text string")
    assert [r["n_removed"] for r in substring_dedup.substring_dedup(df, window=20).orderBy("doc_id").collect()] == [0, 0]
    df = spark.createDataFrame([(1, f"x y z {one}"), (2, f"x y z {two}")], "doc_id bigint, text string")
    assert [r["component_id"] for r in ngram_join.jaccard_components(df, n=4, percent=85).orderBy("doc_id").collect()] == [1, 2]
