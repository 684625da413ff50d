"""Byte-level BPE by a depth-first walk of a trie of words, and decoding.

A text is cut into words by the tokenizer's pattern. The distinct words of a chunk that
aren't known yet are put into a trie. The state of a node is the last token of the
encoding of the prefix that ends there. It follows from the states above it: of the tokens
that the prefix ends with, only one goes on from the state of the node where it begins, that
is, the pair of both tokens is what their joined bytes are encoded to. (A sequence of tokens
is an encoding where each two neighbours are.) So a prefix that words share is
encoded once, whatever the number of words below it, and a word's ids are read by going back
from its node, token by token.

The merges are those of the file, by the ranks of pairs; they serve to judge pairs of
tokens only, and each judgement is remembered in a bounded table.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textkernel as tk
from .shared import tune

NEVER = 1 << 60

#: Bytes of text whose words are in one trie; more share more prefixes.
CHUNK_BYTES = 4 << 20

#: Letters and numbers that came after Unicode 16.0, as ranges: the tokenizer's library doesn't know them, newer versions of the regex module do. Fixed values.
NEWER = """558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF
18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF
1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"""

#: What the pre-tokenizer of byte-level files splits by, where they name no pattern. A fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the file's tokens: printable bytes stand for themselves, the others follow U+00FF in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and added tokens of a tokenizer file of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("normalizer", "post_processor") if spec.get(k)] + [k for k in ("single_word", "lstrip", "rstrip", "normalized") if any(t[k] for t in added)]
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or odd:
            raise ValueError(f"not a plain byte-level BPE: {model['type']}, {before.get('type')}, {odd}")
        letters = byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        self.bytes = {i: t for t, i in self.ids.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {(model["vocab"][a], model["vocab"][b]): (rank, model["vocab"][a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in added}
        self.width = max([*self.bytes, *self.special.values()]) + 1
        self.single = [self.ids[bytes([b])] for b in range(256)]
        #: Lengths of the tokens that end with these two bytes, in order.
        ends: dict[bytes, set[int]] = {}
        for t in self.ids:
            if len(t) > 1:
                ends.setdefault(t[-2:], set()).add(len(t))
        self.ends = {k: tuple(sorted(v)) for k, v in ends.items()}

        made = {new: (pair, rank) for pair, (rank, new) in self.merges.items()}
        #: The tokens at each token's right (left) edge from its last (first) byte to itself, each with the rank of the merge that takes it up.
        self.right = {t: self._edge(t, made, 1) for t in self.bytes}
        self.left = {t: self._edge(t, made, 0) for t in self.bytes}

    @staticmethod
    def _edge(token: int, made: dict[int, tuple[tuple[int, int], int]], side: int) -> list[tuple[int, int]]:
        out = [(token, NEVER)]
        while token in made:
            pair, rank = made[token]
            token = pair[side]
            out.append((token, rank))
        return out[::-1]

    def by_merging(self, raw: bytes) -> list[int]:
        """The encoding of a few bytes by its definition: the pair of least rank first, leftmost among equals."""
        out = [self.ids[raw[i : i + 1]] for i in range(len(raw))]
        while found := [(self.merges[p][0], i) for i, p in enumerate(zip(out, out[1:], strict=False)) if p in self.merges]:
            i = min(found)[1]
            out[i : i + 2] = [self.merges[out[i], out[i + 1]][1]]
        return out

    def apart(self, a: int, b: int) -> bool:
        """Whether no merge joins the bytes of tokens a and b across the border between them, each token being the encoding of its bytes.

        While a and b come about, their tokens at the border are those of a's right and b's left edge. Such a pair
        stays until a merge of its own side takes one of them up; it is joined if its own merge comes before that. Of equal ranks the left one is first.
        """
        right, left, merges = self.right[a], self.left[b], self.merges
        i = j = 0
        while True:
            x, until_x = right[i]
            y, until_y = left[j]
            if (x, y) in merges:
                rank = merges[x, y][0]
                if rank < until_x and rank <= until_y:
                    return False
            if until_x == until_y == NEVER:
                return True
            if until_x <= until_y:
                i += 1
            else:
                j += 1


class Trie:
    """Words in depth-first order: sorted, each with the length of the prefix that it shares with the word before.

    That is the trie, node by node: the walk goes back to the last shared node and on through the word's own
    ones. Only the states of the path to the current node are held, so memory is that of the words.
    """

    def __init__(self, words: Iterator[bytes]):
        self.words = sorted(words)

    def shared(self) -> Iterator[tuple[bytes, int]]:
        last = b""
        for word in self.words:
            most = min(len(last), len(word))
            n, near = 0, min(most, 32)
            while n < near and word[n] == last[n]:
                n += 1
            if n == 32:  # in halves: words may be as long as a text
                high = most
                while n < high:
                    mid = (n + high + 1) // 2
                    if word[n:mid] == last[n:mid]:
                        n = mid
                    else:
                        high = mid - 1
            yield word, n
            last = word


def _wide(text: str) -> bool:
    """Whether the text has letters beyond U+00FF."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return True
    return False


class Encoder:
    """Encodes words by the trie and keeps the ids of recent words, each as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, special: bool = True, remember: int = 300_000, longest: int = 64):
        import regex

        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(PATTERN).findall
        newer = "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in NEWER.split())
        self.newer = regex.compile(f"[{newer}]").search
        self.exact = regex.compile("(?V1)" + PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^\\s[\\p{{L}}\\p{{N}}--[{newer}]]]").replace(r"\p{L}+", f"[\\p{{L}}--[{newer}]]+").replace(r"\p{N}+", f"[\\p{{N}}--[{newer}]]+")).findall
        contents = sorted(self.vocabulary.special, key=len, reverse=True) if special else []
        self.added = re.compile("(" + "|".join(map(re.escape, contents)) + ")") if contents else None
        self.remember, self.longest = remember, longest
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.follows: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def judged(self, key: int, before: int, token: int) -> bool:
        """Whether `token` may follow `before`: both are what their joined bytes are encoded to."""
        v = self.vocabulary
        if len(self.follows) > 1_000_000:
            self.follows.clear()
        out = self.follows[key] = self.first(token) and v.apart(before, token)
        return out

    def first(self, token: int) -> bool:
        out = self.alone.get(token)
        if out is None:
            out = self.alone[token] = self.vocabulary.by_merging(self.vocabulary.bytes[token]) == [token]
        return out

    def words(self, trie: Trie) -> Iterator[tuple[bytes, bytes]]:
        """Each word with its ids, in the order of the trie."""
        v = self.vocabulary
        ids, ends, width, raw, follows, judged, first, single = v.ids.get, v.ends.get, v.width, v.bytes, self.follows, self.judged, self.first, v.single
        state = [-1]  # of the path's nodes, by depth
        for word, depth in trie.shared():
            del state[depth + 1 :]
            for d in range(depth + 1, len(word) + 1):
                token, before = single[word[d - 1]], state[d - 1]
                if before >= 0:
                    key = before * width + token
                    ok = follows.get(key)
                    if not (ok or ok is None and judged(key, before, token)):
                        for length in ends(word[d - 2 : d], ()):
                            token = ids(word[d - length : d]) if length <= d else None
                            if token is None:
                                continue
                            before = state[d - length]
                            if before < 0:
                                if first(token):
                                    break
                                continue
                            key = before * width + token
                            ok = follows.get(key)
                            if ok or ok is None and judged(key, before, token):
                                break
                        else:
                            raise ValueError(f"no token ends the encoding of {word[:d][-40:]!r}")
                state.append(token)
            out, d = [], len(word)
            while d:
                token = state[d]
                out.append(token)
                d -= len(raw[token])
            out.reverse()
            yield word, array("I", out).tobytes()

    def learn(self, words: set[str]) -> None:
        """Encode the words that aren't known. Two generations: what the older one is asked for moves to the younger."""
        if len(self.known) >= self.remember:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = words - known.keys()
        if older:
            for w in new & older.keys():
                known[w] = older[w]
            new -= older.keys()
        by_bytes = {w.encode(): w for w in new}
        for raw, packed in self.words(Trie(by_bytes)):
            known[by_bytes[raw]] = packed

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text: b"" for null."""
        cut, words = [], set()
        for text in texts:
            parts = [] if not text else self.added.split(text) if self.added and any(t in text for t in self.vocabulary.special) else [text]
            split = self.exact if text and _wide(text) and self.newer(text) else self.split
            parts = [p if i % 2 else split(p) for i, p in enumerate(parts)]
            for p in parts[::2]:
                words.update(p)
            cut.append(parts)
        self.learn(words)
        get, special = self.known.__getitem__, self.vocabulary.special
        out = [b"".join(b"".join(map(get, p)) if not i % 2 else np.uint32(special[p]).tobytes() for i, p in enumerate(parts)) for parts in cut]
        for w in words:  # a long word is as a rule met once
            if len(w) > self.longest:
                del self.known[w]
        return out


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special: bool = True) -> Encoder:
    """One encoder for each worker process."""
    key = (path, special)
    if key not in _encoders:
        _encoders[key] = Encoder(path, special)
    return _encoders[key]


class Decoder:
    """Bytes and texts of ids."""

    def __init__(self, path: str):
        v = Vocabulary(path)
        letters = byte_letters()
        self.width = v.width
        added = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in v.special.items()}
        known = v.bytes | added
        self.table = pa.array([known.get(i) for i in range(v.width)], pa.binary())
        self.lengths = np.array([len(known.get(i, b"")) for i in range(v.width)], np.int64)

    def raw(self, ids: np.ndarray) -> bytes:
        """The ids' bytes, one after the other. An unknown id is an error."""
        if len(ids) and int(ids.max()) >= self.width:
            raise ValueError("unknown id")
        taken = self.table.take(pa.array(ids.astype(np.int32)))
        if taken.null_count:
            raise ValueError("unknown id")
        return b"" if not len(ids) else bytes(memoryview(taken.buffers()[2])[: int(self.lengths[ids].sum())])

    def text(self, packed: bytes | None) -> str:
        return self.raw(np.frombuffer(packed or b"", "<u4")).decode("utf-8", "replace")


def _schema(df: DataFrame, *fields: T.StructField, without: str | None = None) -> T.StructType:
    rest = [f for f in df.schema.fields if f.name != without]
    if taken := {f.name for f in rest} & {f.name for f in fields}:
        raise ValueError(f"columns {sorted(taken)} exist already")
    return T.StructType([*rest, *fields])


def round_trip(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "packed_ids", out_col: str = "decoded") -> DataFrame:
    """`docs` without `text_col`, with the ids of each whole text, as little-endian unsigned 32-bit integers, and the text that they decode to.

    Strings of added tokens are those tokens, as in the tokenizer's own library. Null and empty texts have no ids
    and decode to the empty text; rows that repeat are encoded each by itself; an empty table gives none; other columns are
    kept whatever their names, but `ids_col` and `out_col` must be free. Narrow: no shuffle.
    """
    tune(docs.sparkSession)
    schema = _schema(docs, T.StructField(ids_col, T.BinaryType(), False), T.StructField(out_col, T.StringType(), False), without=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = encoder(path), Decoder(path)
        for part in tk.chunks(batches, text_col, CHUNK_BYTES):
            packed = enc.encode(part.column(text_col).to_pylist())
            keep = [(f.name, c) for f, c in zip(part.schema, part.columns, strict=True) if f.name != text_col]
            columns = [*(c for _, c in keep), pa.array(packed, pa.binary()), pa.array([dec.text(p) for p in packed], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(n for n, _ in keep), ids_col, out_col])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """`docs` with the ids of each whole text as array<int>; odd rows as in round_trip()."""
    tune(docs.sparkSession)
    schema = _schema(docs, T.StructField(out_col, T.ArrayType(T.IntegerType(), False), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for part in tk.chunks(batches, text_col, CHUNK_BYTES):
            packed = enc.encode(part.column(text_col).to_pylist())
            ends = np.cumsum([0, *(len(p) // 4 for p in packed)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4")))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*part.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """`tokens` with the text that each list of ids stands for; bytes that are no UTF-8 become U+FFFD. A null list gives the empty text; an unknown id is an error."""
    tune(tokens.sparkSession)
    schema = _schema(tokens, T.StructField(out_col, T.StringType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [dec.raw(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out_col])

    return tokens.mapInArrow(run, schema)
