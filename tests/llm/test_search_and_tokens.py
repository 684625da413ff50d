"""Ranked search, trie BPE and alignment against SQL, the tokenizers' own libraries and plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as tokenizers
import pytest

from orrery.llm import alignment, oracle, queries, ranked_search, trie_bpe

BYTE, PIECE = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'s", "'ll", "é", "日", "😀", "0", "12", "<|endoftext|>", "<|endof", "<s>", "<0x41>", "\x00", "\x1c", "\x85", "▁", "aaaa", "....", "ÃÂÃÂ", "​", "�", "Ａ", "ࢋ", "\U0001df2b"]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(7)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randint(0, 0x250), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(20)) for _ in range(1000)]
    return [*texts, "", " ", "a ", "x" * 20_000, " " * 5000, "ab" * 9999, "\n" * 3000 + "x", "under" * 4000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTE)


def test_trie_encodes_as_the_library(odd, library):
    enc, dec = trie_bpe.Encoder(BYTE), trie_bpe.Decoder(BYTE)
    for text, got in zip(odd, enc.encode(odd), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want
        assert dec.text(got) == library.decode(want, skip_special_tokens=False)
    assert enc.encode([None, ""]) == [b"", b""]


def test_pairs_of_tokens_are_judged_as_merging_does():
    v, rng = trie_bpe.Vocabulary(BYTE), random.Random(3)
    for top in (600, 5000, 50_256):
        for _ in range(4000):
            a, b = rng.randrange(top), rng.randrange(top)
            assert v.apart(a, b) == (v.by_merging(v.bytes[a] + v.bytes[b]) == [a, b])


def test_generations_of_known_words_change_nothing(odd):
    small, large = trie_bpe.Encoder(BYTE, remember=5), trie_bpe.Encoder(BYTE)
    for i in range(0, 300, 10):
        assert small.encode(odd[i : i + 10]) == large.encode(odd[i : i + 10])


def test_decode_of_any_ids(spark, library):
    lists = [[], None, [50256], [172, 241], [0, 50255, 50256, 220]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "k int, token_ids array<int>")
    got = {r["k"]: r["decoded"] for r in trie_bpe.decode(df, BYTE).collect()}
    assert got == {i: library.decode(x or [], skip_special_tokens=False) for i, x in enumerate(lists)}
    with pytest.raises(Exception, match="unknown id"):
        trie_bpe.decode(spark.createDataFrame([([70_000],)], "token_ids array<int>"), BYTE).collect()


def test_trie_query_by_the_library(spark, sf_dir, library):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = {r["doc_id"]: r for r in queries.op12_trie_bpe(spark, sf_dir).collect()}
    for d in queries.table(spark, sf_dir, "documents").collect():
        ids, r = library.encode(d["text"] or "", add_special_tokens=False).ids, got[d["doc_id"]]
        want = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want


def test_trie_of_odd_rows(spark, docs, empty):
    coded = trie_bpe.encode(docs, BYTE)
    back = trie_bpe.decode(coded, BYTE)
    assert all(r["decoded"] == (r["text"] or "") for r in back.collect()) and back.count() == docs.count()
    packed = trie_bpe.round_trip(docs, BYTE)
    assert packed.columns == [*(c for c in docs.columns if c != "text"), "packed_ids", "decoded"]
    assert trie_bpe.round_trip(empty, BYTE).count() == trie_bpe.encode(empty, BYTE).count() == 0
    with pytest.raises(ValueError, match="exist"):
        trie_bpe.round_trip(docs, BYTE, ids_col="kept")


def aligned_by_hand(text, hf, sp):
    """Tokens, groups and links of one text, by byte ranges in plain loops."""
    letters = trie_bpe.byte_letters()
    none = (0, 0, 0, "", Counter())
    if not text:
        return none
    a, b = hf.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    raw_a = [bytes(letters[c] for c in hf.id_to_token(i)) for i in a]
    raw_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
        return none
    end_a, end_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
    groups, i, j = [], 0, 0
    for cut in sorted(set(end_a) & set(end_b)):
        n, m = i, j
        while i < len(a) and end_a[i] <= cut:
            i += 1
        while j < len(b) and end_b[j] <= cut:
            j += 1
        groups.append(",".join(map(str, a[n:i])) + "|" + ",".join(map(str, b[m:j])))
    links, i = Counter(), 0
    for j, (e, x) in enumerate(zip(end_b, raw_b, strict=True)):
        while end_a[i] <= e - len(x):
            i += 1
        k = i
        while k < len(a) and end_a[k] - len(raw_a[k]) < e:
            links[a[k], b[j]] += 1
            k += 1
    return len(a), len(b), len(groups), ";".join(groups), links


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(BYTE)
    hf.encode_special_tokens = True
    return hf, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def check_alignment(rows, aligned, both):
    """aligned: rows of weigh() by key; rows: (key, text)."""
    want = {k: aligned_by_hand(t, *both) for k, t in rows}
    count, top = Counter(), {}
    for w in want.values():
        count.update(w[4])
    for (_, b), n in count.items():
        top[b] = max(n, top.get(b, 0))
    for k, (n_a, n_b, n_groups, groups, links) in want.items():
        best = sum(n for (a, b), n in links.items() if count[a, b] == top[b])
        digest = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
        r = aligned[k]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) == (n_a, n_b, n_groups, sum(links.values()), digest), k
        assert (r["n_best"], r["count_sum"]) == (best, sum(n * count[p] for p, n in links.items())), k


def test_alignment_query_by_hand(spark, sf_dir, both):
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf_dir, "documents").collect()]
    check_alignment(rows, {r["doc_id"]: r for r in queries.op13_alignment(spark, sf_dir).collect()}, both)


@pytest.mark.parametrize("frequent", [0, 50, 1 << 20])
def test_alignment_of_odd_texts(spark, odd, both, frequent):
    """With all, some and none of the pairs in the broadcast table."""
    rows = list(enumerate([None, *odd[:400], *odd[-8:]]))
    df = spark.createDataFrame(rows, "k int, text string").repartition(3)
    aligned, counts = alignment.tables(df, BYTE, PIECE)
    check_alignment(rows, {r["k"]: r for r in alignment.weigh(aligned, counts, frequent).collect()}, both)


def test_alignment_of_odd_rows(spark, docs, empty):
    found = alignment.align(docs, BYTE, PIECE)
    assert found.count() == docs.count() and set(docs.columns) - {"text"} < set(found.columns)
    aligned, counts = alignment.tables(empty, BYTE, PIECE)
    assert alignment.weigh(aligned, counts).count() == counts.count() == 0
    with pytest.raises(ValueError, match="exist"):
        alignment.align(docs.withColumnRenamed("kept", "n_a"), BYTE, PIECE)


def ranked_by_hand(docs, items, k):
    """docs: (id, text); items: (id, text)."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(cut(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // n_terms if b else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 20 * m)) for w in words if b[w])
            if score:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1) if item is not None]
    return Counter(out)


def as_rows(df):
    return Counter((r[0], r[1], r[2], r[3]) for r in df.collect())


def test_ranked_query_by_hand(spark, sf_dir):
    docs, items = (queries.table(spark, sf_dir, t).collect() for t in ("documents", "benchmark"))
    want = ranked_by_hand([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items], 50)
    assert as_rows(queries.op11_ranked_search(spark, sf_dir)) == want


@pytest.mark.parametrize("k", [1, 3, 40])
def test_ranked_search_of_ties_and_long_lists(spark, k, monkeypatch):
    """Many blocks, many equal scores, hot terms, queries of one and of many terms."""
    rng = random.Random(k)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(40)], k=rng.randint(0, 60)))) for i in range(600)]
    items = [(1, "w0"), (2, "w1 W2 w39"), (3, " ".join(words)), (4, "nothing"), (5, None), (None, "w1"), (6, "w5 w6"), (6, "w7")]
    ix = ranked_search.index(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7))
    assert as_rows(ranked_search.search(ix, spark.createDataFrame(items, "item_id bigint, text string"), k)) == ranked_by_hand(docs, items, k)
    ix.drop()


def test_ranked_search_of_odd_rows(spark, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(1, "W3 w4 été x"), (2, "two words mit")]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert as_rows(ranked_search.search(ranked_search.index(docs), asked, 5)) == ranked_by_hand(rows, items, 5)
    nameless = docs.selectExpr("cast(null as bigint) doc_id", "text").unionByName(docs.select("doc_id", "text"))
    assert as_rows(ranked_search.search(ranked_search.index(nameless), asked, 9)) == ranked_by_hand([(None, t) for _, t in rows] + rows, items, 9)
    assert ranked_search.search(ranked_search.index(empty), asked).count() == 0
    assert ranked_search.search(ranked_search.index(docs), asked.limit(0)).count() == 0


def test_ranked_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = Counter(con.execute(oracle.RANKED).fetchall())
    assert as_rows(queries.op11_ranked_search(spark, sf_dir)) == want
