"""Alignment of two tokenizers: groups of tokens between shared cuts, links of overlapping tokens, corpus-wide counts.

The bytes of a chunk of texts are positions of packed bitsets. Each tokenizer sets the bit of each byte at which one of its
tokens ends. Their AND has the cuts that both share. A rank directory (running popcounts of words of 64 bits)
gives the number of token ends before a byte, so each cut maps to a range of tokens on either side, and the two
ranges between neighbouring cuts are a group. Links are expanded from ranks too: a token of B over bytes [s, e) overlaps the A tokens from
rank(s) up to rank(e - 1).

Corpus-wide counts of linked pairs are summed before and after one shuffle. The most frequent pairs, a bounded number, are
looked up in a broadcast table; links of the other pairs meet their counts in a join, in which no key is frequent.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from . import trie_bpe
from .shared import shared_table, tune

#: Pairs whose counts are broadcast at most, 12 bytes each.
FREQUENT = 1 << 20
#: Texts are aligned in chunks of so many bytes.
CHUNK_BYTES = 1 << 20
_SPACE = "▁"
#: Finds a space after another white space and before one, or at the end: there a segment's end may be within a match of A's pattern.
_RUN = re.compile(r"[^\S ] (?!\S)").search


class Pieces:
    """Encodes by a sentencepiece model.

    Where the model leaves texts as they are and no piece has a space after another letter, no merge crosses from a
    letter to a space, so that the spaces before a word and the word are encoded by themselves. Else whole texts are.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(n)]
        byte = [re.fullmatch(r"<0x([0-9A-F]{2})>", p) if self.model.is_byte(i) else None for i, p in enumerate(pieces)]
        raw = [bytes([int(b[1], 16)]) if b else p.replace(_SPACE, " ").encode() for p, b in zip(pieces, byte, strict=True)]
        self.table, self.lengths = pa.array(raw, pa.binary()), np.array(list(map(len, raw)), np.int64)
        self.space = self.model.piece_to_id(_SPACE)
        apart = all(_SPACE not in p.lstrip(_SPACE) for p in pieces) and self.model.encode("  ÄＡ  b ", out_type=str)[0].startswith(_SPACE)
        plain = self.model.decode(self.model.encode("  ÄＡ  b ")) == "  ÄＡ  b "
        self.split = re.compile(" +[^ ]*").findall if apart and plain else None

    def encode(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment, packed; its first space is the one that the model adds."""
        return [array("I", ids or [self.space]).tobytes() for ids in self.model.encode([x[1:] for x in segments], num_threads=1)]


class Segments:
    """Cuts texts into segments at which both tokenizers' tokens end, and keeps both sides' ids of recent segments.

    A segment is a run of spaces and what follows up to the next one, or a whole text where side B needs it or a run of other white space meets spaces.
    """

    def __init__(self, a: trie_bpe.Encoder, b: Pieces, remember: int = 150_000, longest: int = 64):
        self.a, self.b, self.remember, self.longest = a, b, remember, longest
        # the number of A's ids, A's ids and B's ids; two generations: what the older one is asked for moves to the younger
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def cut(self, texts: list[str]) -> list[list[str]]:
        """The segments of each text, with a space before it."""
        split = self.b.split
        return [[] if not t else [f" {t}"] if split is None or _RUN(t) else split(" " + t) for t in texts]

    def learn(self, segments: set[str]) -> None:
        """Encode the segments that aren't known, each once."""
        if len(self.known) >= self.remember:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = segments - known.keys()
        for x in new & older.keys():
            known[x] = older[x]
        new = list(new - older.keys())
        long = [x for x in new if len(x) > self.longest]
        short = [x for x in new if len(x) <= self.longest] if long else new
        if self.a.newer("".join(short)):
            long, short = new, []
        words = list(map(self.a.split, short))
        self.a.learn(set().union(*words))
        get = self.a.known.__getitem__
        packed = [b"".join(map(get, w)) for w in words] + self.a.encode(long)
        new = short + long
        for x, a, b in zip(new, packed, self.b.encode(new), strict=True):
            known[x] = (len(a) // 4).to_bytes(4, "little") + a + b

    def encode(self, cut: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides, one text after the other, and the texts' numbers of ids."""
        distinct = set().union(*cut)
        self.learn(distinct)
        packed = list(map(self.known.__getitem__, distinct))
        for x in [x for x in distinct if len(x) > self.longest]:  # a long segment is as a rule met once
            del self.known[x]
        flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
        first = _starts(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)
        n_a = flat[first[:-1]]
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        bounds = _starts(np.array(list(map(len, cut)), np.int64))
        at = np.fromiter(map(number.__getitem__, chain.from_iterable(cut)), np.int64, int(bounds[-1]))
        ids, counts = [], []
        for start, size in ((first[:-1] + 1, n_a), (first[:-1] + 1 + n_a, np.diff(first) - 1 - n_a)):
            n = size[at]
            ids.append(flat[ranges(start[at], n)])
            counts.append(np.diff(_starts(n)[bounds]))
        return ids, counts


class Cuts:
    """A packed bitset of the bytes at which tokens end, with a rank directory."""

    def __init__(self, ends: np.ndarray, n: int):
        bits = np.zeros((n + 64) // 64 * 64, bool)
        bits[ends - 1] = True
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)

    @classmethod
    def both(cls, a: Cuts, b: Cuts) -> Cuts:
        out = cls.__new__(cls)
        out.words = a.words & b.words
        return out

    def directory(self) -> Cuts:
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))]
        return self

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of token ends at or before byte offset `at`: set bits below bit `at`."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below).astype(np.int64)

    def select(self) -> np.ndarray:
        """The byte offsets of all ends, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little")) + 1


def _joined(table: pa.Array, ids: np.ndarray) -> np.ndarray:
    """The ids' bytes one after the other."""
    if not len(ids):
        return np.zeros(0, np.uint8)
    taken = table.take(pa.array(ids.astype(np.int32)))
    off = np.frombuffer(taken.buffers()[1], np.int32)
    return np.frombuffer(taken.buffers()[2], np.uint8)[off[0] : off[len(taken)]]


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(counts)].astype(np.int64)


def ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (counts[i] of them) for each i."""
    total = _starts(counts)
    return np.arange(total[-1]) + np.repeat(first - total[:-1], counts)


class Aligner:
    """Aligns chunks of texts; one for each worker process."""

    def __init__(self, path_a: str, path_b: str):
        self.b, self.decoder = Pieces(path_b), trie_bpe.Decoder(path_a)
        self.segments = Segments(trie_bpe.Encoder(path_a, special=False, remember=100_000), self.b)
        names = [[str(i).encode() for i in range(n)] for n in (self.decoder.width, len(self.b.lengths))]
        #: Decimal ids with what follows them in a group: A's "," or "|", B's "," or ";".
        self.names = pa.array([n + end for side, ends in zip(names, ((b",", b"|"), (b",", b";")), strict=True) for end in ends for n in side], pa.binary())
        self.name_lengths = np.array([len(x) for x in self.names.to_pylist()], np.int64)

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of both sides, tokens of each text, and bytes of each: none for texts that aren't given back."""
        want = [f" {t}".encode() if t else b"" for t in texts]
        cut = self.segments.cut(texts)
        while True:
            ids, counts = self.segments.encode(cut)
            joined = [_joined(t, i) for t, i in zip((self.decoder.table, self.b.table), ids, strict=True)]
            lengths = [t[i] for t, i in zip((self.decoder.lengths, self.b.lengths), ids, strict=True)]
            bounds = [_starts(x)[_starts(c)] for x, c in zip(lengths, counts, strict=True)]
            off, whole = _starts(np.array(list(map(len, want)))), np.frombuffer(b"".join(want), np.uint8)
            if all(np.array_equal(x, off) for x in bounds) and all(np.array_equal(x, whole) for x in joined):
                return *ids, *counts, *lengths, off
            bad = [i for i, w in enumerate(want) if any(j[x[i] : x[i + 1]].tobytes() != w for j, x in zip(joined, bounds, strict=True))]
            for i in bad:
                want[i], cut[i] = b"", []

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        a, b, n_a, n_b, len_a, len_b, off = self.tokens(texts)
        end_a, end_b = np.cumsum(len_a), np.cumsum(len_b)
        bits_a, bits_b = Cuts(end_a, int(off[-1])).directory(), Cuts(end_b, int(off[-1])).directory()
        shared = Cuts.both(bits_a, bits_b)
        cut = np.r_[0, shared.select()]
        rank_a, rank_b = bits_a.rank(cut), bits_b.rank(cut)  # tokens before each cut: a group is between two
        groups_at = shared.directory().rank(off)
        low, high = bits_a.rank(end_b - len_b), bits_a.rank(end_b - 1)
        per_b = high - low + 1
        left, right = ranges(low, per_b), np.repeat(np.arange(len(b)), per_b)
        link_at = _starts(per_b)[_starts(n_b)]
        # groups as text: the A tokens of a group, then its B tokens
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[rank_a[1:] - 1] = last_b[rank_b[1:] - 1] = 1
        group_a, group_b = np.diff(rank_a), np.diff(rank_b)
        place_a = np.arange(len(a)) + np.repeat(rank_b[:-1], group_a)
        place_b = np.arange(len(b)) + np.repeat(rank_a[1:], group_b)
        order = np.empty(len(a) + len(b), np.int64)
        order[place_a] = a + last_a * self.decoder.width
        order[place_b] = b + last_b * len(self.b.lengths) + 2 * self.decoder.width
        text_at = _starts(self.name_lengths[order])[_starts(n_a) + _starts(n_b)]
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(groups_at), "n_links": np.diff(link_at), "names": _joined(self.names, order), "text_at": text_at, "link_a": a[left], "link_b": b[right], "link_at": link_at}


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    key = (path_a, path_b)
    if key not in _aligners:
        _aligners[key] = Aligner(path_a, path_b)
    return _aligners[key]


def _runs(doc: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (doc, pair), sorted, with their counts. Pairs are below 2**40."""
    order = np.lexsort((pair, doc)) if len(doc) and int(doc[-1]) >= 1 << 23 else np.argsort(doc << np.int64(40) | pair, kind="stable")
    doc, pair = doc[order], pair[order]
    at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])]) if len(doc) else np.zeros(0, np.int64)
    return doc[at], pair[at], np.diff(np.r_[at, len(doc)])


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def align(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text") -> DataFrame:
    """`docs` without `text_col`, with n_a, n_b, n_groups, n_links (long), groups (`a1,a2|b1;a3|b2,b3` in binary), and the
    distinct linked pairs of each text: pairs (the differences of sorted a * 2^20 + b, as 64-bit integers) and times (32-bit).

    Null and empty texts, and texts that the bytes of either side's tokens don't give back, have no tokens, groups or links. Rows that repeat
    are aligned each by itself; an empty table gives none; other columns are kept, but those names must be free. Narrow: no shuffle.
    """
    tune(docs.sparkSession)
    longs = ["n_a", "n_b", "n_groups", "n_links"]
    fields = [*(T.StructField(n, T.LongType(), False) for n in longs), *(T.StructField(n, T.BinaryType(), False) for n in ("groups", "pairs", "times"))]
    rest = [f for f in docs.schema.fields if f.name != text_col]
    if taken := {f.name for f in rest} & {f.name for f in fields}:
        raise ValueError(f"columns {sorted(taken)} exist already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        if max(own.decoder.width, len(own.b.lengths)) >= 1 << 20:
            raise ValueError("vocabularies have at most 2^20 ids")
        for part in tk.chunks(batches, text_col, CHUNK_BYTES):
            x = own.align(part.column(text_col).fill_null("").to_pylist())
            n = part.num_rows
            doc, pair, times = _runs(np.repeat(np.arange(n), x["n_links"]), x["link_a"] << 20 | x["link_b"])
            at = np.searchsorted(doc, np.arange(n + 1))
            first = np.zeros(len(pair), bool)
            first[at[:-1][at[:-1] < at[1:]]] = True
            step = np.where(first, pair, pair - np.r_[0, pair[:-1]])
            text = np.c_[x["text_at"][:-1], np.maximum(x["text_at"][:-1], x["text_at"][1:] - 1)]  # without the last ";"
            names = x["names"].tobytes()
            keep = [(f.name, c) for f, c in zip(part.schema, part.columns, strict=True) if f.name != text_col]
            columns = [*(c for _, c in keep), *(pa.array(x[k], pa.int64()) for k in longs), pa.array([names[i:j] for i, j in text.tolist()], pa.binary()), _binary(step, at), _binary(times.astype(np.int32), at)]
            yield pa.RecordBatch.from_arrays(columns, names=[*(n for n, _ in keep), *longs, "groups", "pairs", "times"])

    return docs.mapInArrow(run, T.StructType([*rest, *fields]))


def _unpacked(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and times of each distinct pair of a batch of align()'s rows."""
    step, at = tk.column(part, "pairs")
    times, _ = tk.column(part, "times")
    step, times, at = np.frombuffer(step.tobytes(), np.int64), np.frombuffer(times.tobytes(), np.int32).astype(np.int64), at // 8
    row = np.repeat(np.arange(part.num_rows), np.diff(at))
    total = np.r_[0, np.cumsum(step)]
    return row, total[1:] - np.repeat(total[at[:-1]], np.diff(at)), times


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many links of the whole corpus hold each pair of ids. Summed in each task, then by one shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            _, pair, times = _unpacked(batch)
            pairs, back = np.unique(np.r_[pairs, pair], return_inverse=True)
            counts = np.bincount(back, np.r_[counts, times], len(pairs)).astype(np.int64)
            if len(pairs) > 4 * FREQUENT:  # bounds the task's memory; the shuffle sums the parts
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])
                pairs, counts = pairs[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], names=["pair", "n"])

    return aligned.select("pairs", "times").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def weigh(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """`aligned` (a written table of align()'s rows) without pairs and times, with n_best, the links whose pair is the most
    counted one of its B id, ties included, and count_sum, the sum of the links' counts.

    counts: a written table of pair_counts(). The `frequent` pairs of the highest counts are broadcast; others are joined.
    """
    b = F.expr("pair & 1048575")
    best = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # at most one row an id of B
    marked = shared_table(counts.withColumn("b", b).join(F.broadcast(best), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("top")), "pair-counts")
    head = marked.orderBy(F.desc("n"), "pair").limit(frequent).toArrow().sort_by("pair")
    table = aligned.sparkSession.sparkContext.broadcast(tuple(head.column(c).to_numpy() for c in ("pair", "n", "top")))
    every = marked.count() <= frequent
    rest = [f for f in aligned.schema.fields if f.name not in ("pairs", "times")]
    fields = [T.StructField("n_best", T.LongType(), False), T.StructField("count_sum", T.LongType(), False)]
    missed = T.StructField("_missed", T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())])), False)
    key = T.StructField("_row", T.LongType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, top = table.value
        for batch in batches:
            row, pair, times = _unpacked(batch)
            at = np.minimum(np.searchsorted(pairs, pair), max(len(pairs) - 1, 0))
            hit = pairs[at] == pair if len(pairs) else np.zeros(len(pair), bool)
            sums, good = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, row[hit], times[hit] * n[at[hit]])
            np.add.at(good, row[hit], times[hit] * top[at[hit]])
            lists = pa.ListArray.from_arrays(
                pa.array(_starts(np.bincount(row[~hit], minlength=batch.num_rows)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(pair[~hit]), pa.array(times[~hit])], names=["pair", "times"])
            )
            keep = [c for f, c in zip(batch.schema, batch.columns, strict=True) if f.name not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(good), pa.array(sums), lists], names=[f.name for f in (*rest, *(() if every else (key,)), *fields, missed)])

    if every:
        return aligned.mapInArrow(run, T.StructType([*rest, *fields, missed])).drop("_missed")
    numbered = aligned.withColumn("_row", F.monotonically_increasing_id())
    found = shared_table(numbered.mapInArrow(run, T.StructType([*rest, key, *fields, missed])), "links")
    late = found.select("_row", F.inline("_missed")).join(marked, "pair").groupBy("_row")
    late = late.agg(F.sum(F.col("times") * F.col("top").cast("long")).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    out = found.drop("_missed").join(late, "_row", "left")
    return out.select(*(F.col(f"`{f.name}`") for f in rest), *((F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("n_best", "_best"), ("count_sum", "_sum"))))


def tables(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", digest: str = "groups_sha256") -> tuple[DataFrame, DataFrame]:
    """align() with a digest in place of the groups, and pair_counts() of it, both written."""
    out = align(docs, path_a, path_b, text_col)
    names = [F.col(f"`{c}`") for c in out.columns if c != "groups"]
    aligned = shared_table(out.select(*names, F.when(F.octet_length("groups") > 0, F.sha2("groups", 256)).otherwise("").alias(digest)), "aligned")
    return aligned, shared_table(pair_counts(aligned), "pairs")

