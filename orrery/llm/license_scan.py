"""License scan by matching statistics over a generalised suffix automaton.

The templates' words form one automaton that accepts every run of words of every
template. A file's words are streamed through it: after each word the state
and a length tell the longest run of words, ending there, that some template
contains (the matching statistics). From these come

* places of phrases: a phrase stands where its last word's state has the phrase
  among its suffixes and the length reaches the phrase's;
* matches: runs that can't be longer, of at least `min_match` words, each with its
  spans in the templates. Matches of a template chain in order of both file and
  template, and a chain that covers enough of the template labels the file.

Templates are a parameter. The automaton's size is linear in theirs, and it is
built once for each worker. Words that no template has reset the automaton, so
only runs of template words reach the Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textkernel as tk
from .licences import TEXTS
from .shared import tune

#: Phrases and the labels they give.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Share of a notice's words that a chain must cover for its label.
MIN_COVER = 0.75


def words_of(text: str) -> list[bytes]:
    data = np.frombuffer(text.encode(), np.uint8)
    w = tk.Words(data, np.array([0, len(data)]), tk.ALNUM, lower=True)
    return [w.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]


@dataclass
class Automaton:
    """Generalised suffix automaton over word ids; `places` are (template, end) of each state."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    places: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.places.append([])
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
        cur, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
        return cur

    @classmethod
    def of(cls, templates: list[list[int]]) -> Automaton:
        self = cls()
        for words in templates:
            last = 0
            for c in words:
                last = self._extend(last, c)
        for t, words in enumerate(templates):
            state = 0
            for i, c in enumerate(words):
                state = self.next[state][c]
                self.places[state].append((t, i + 1))
        # a state's runs end wherever those of the states that link to it do
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.places[self.link[s]].extend(self.places[s])
        self.places = [sorted(set(p)) for p in self.places]
        return self


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: list[tuple[str, str]], min_match: int):
        self.phrase_words = [words_of(p) for p in phrases]
        self.phrase_labels = list(phrases.values())
        self.notices = [(label, words_of(text)) for label, text in notices]
        every = [*self.phrase_words, *(w for _, w in self.notices)]
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for words in every for w in words}))}
        self.automaton = Automaton.of([[self.vocabulary[w] for w in words] for words in every])
        n = len(self.phrase_words)
        a = self.automaton
        # phrases that are suffixes of a state's runs, as (phrase, words): those of its link, and its own
        own: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.phrase_words):
            state = 0
            for w in words:
                state = a.next[state][self.vocabulary[w]]
            own.setdefault(state, []).append((t, len(words)))
        self.ends: list[list[tuple[int, int]]] = [[] for _ in a.next]
        for s in sorted(range(1, len(a.next)), key=a.length.__getitem__):
            self.ends[s] = self.ends[a.link[s]] + own.get(s, [])
        self.spans = [[(t - n, e) for t, e in p if t >= n] for p in a.places]
        self.min_match = min_match
        self.shortest = min([*(len(p) for p in self.phrase_words), min_match])
        keys = b"".join(self.vocabulary)
        offs = np.r_[0, np.cumsum([len(w) for w in self.vocabulary])]
        w = tk.Words(np.frombuffer(keys, np.uint8), offs, np.ones(256, bool))
        self.hashes = np.sort(w.hashes())

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Phrase places (phrase, start) and long matches (start, words, state) of a run of words."""
        a, state, length = self.automaton, 0, 0
        nxt, link, longest = a.next, a.link, a.length
        phrases, matches = [], []
        for i, c in enumerate(words):
            before, had = state, length
            while state and c not in nxt[state]:
                state = link[state]
                length = longest[state]
            state = nxt[state].get(c, 0)
            length = length + 1 if state else 0
            if had >= self.min_match and length != had + 1:
                matches.append((i - had, had, before))
            # a state's shorter runs may lack the phrase's first words
            phrases.extend((t, i + 1 - e) for t, e in self.ends[state] if e <= length)
        if length >= self.min_match:
            matches.append((len(words) - length, length, state))
        return phrases, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, covered share) of the best chain of each notice in a file."""
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for start, length, state in matches:
            for t, end in self.spans[state]:
                if end >= length:
                    by.setdefault(t, []).append((start, start + length, end - length, end))
        out = []
        for t, spans in by.items():
            total = len(self.notices[t][1])
            spans.sort()
            # within reach of each other in the file, in order in the template
            best: list[tuple[int, int]] = []
            recent: list[int] = []
            for i, (s, e, ts, te) in enumerate(spans):
                score, first = te - ts, s
                recent = [j for j in recent if spans[j][1] + total >= s]
                for j in recent:
                    if spans[j][1] <= s and spans[j][3] <= ts and best[j][0] + te - ts > score:
                        score, first = best[j][0] + te - ts, best[j][1]
                best.append((score, first))
                # a span with no larger score and no later use than another one needn't be kept
                recent = [j for j in recent if not (spans[j][3] >= te and best[j][0] <= score)] + [i]
            top = max(range(len(best)), key=lambda i: best[i][0])
            out.append((self.notices[t][0], best[top][1], spans[top][1], min(1.0, best[top][0] / total)))
        return sorted(out)


_scanners: dict[str, Scanner] = {}


def scan(
    docs: DataFrame,
    text_col: str = "text",
    phrases: dict[str, str] | None = None,
    notices: list[tuple[str, str]] | None = None,
    min_match: int = 4,
) -> DataFrame:
    """`docs` without `text_col`, with n_words, phrase_places array<struct<label, start>> and
    notice_spans array<struct<label, start, end, cover>> (word spans of the file, cover from 0 to 1).

    Null and empty texts have no words. Whole texts are read; nothing is shuffled. A notice's best chain
    is returned whatever its cover; MIN_COVER is a fair limit. Of chains that cover as much, the first in the file is. Rows that repeat
    are scanned each by itself; the new columns must not be columns of `docs`, other names don't matter.
    """
    tune(docs.sparkSession)
    phrases = PHRASES if phrases is None else phrases
    notices = TEXTS if notices is None else notices
    key = repr((phrases, notices, min_match))
    place = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType())]))
    span = T.ArrayType(
        T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("cover", T.DoubleType())])
    )
    rest = [f for f in docs.schema.fields if f.name != text_col]
    if {"n_words", "phrase_places", "notice_spans"} & {f.name for f in rest}:
        raise ValueError("a column of the result exists already")
    schema = T.StructType([*rest, T.StructField("n_words", T.LongType()), T.StructField("phrase_places", place), T.StructField("notice_spans", span)])
    place_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))
    span_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _scanners:
            _scanners[key] = Scanner(phrases, notices, min_match)
        sc = _scanners[key]
        for part in tk.chunks(batches, text_col):
            data, off = tk.column(part, text_col)
            w = tk.Words(data, off, tk.ALNUM, lower=True)
            h = w.hashes()
            known = np.zeros(len(h), bool)
            if len(h):
                at = np.minimum(np.searchsorted(sc.hashes, h), len(sc.hashes) - 1)
                known = sc.hashes[at] == h
            places: list[list] = [[] for _ in range(part.num_rows)]
            matches: list[list] = [[] for _ in range(part.num_rows)]
            # maximal runs of template words within a document
            edge = np.flatnonzero(np.diff(np.r_[0, known.view(np.int8), 0]))
            starts, ends = edge[::2], edge[1::2]
            cuts = w.first[1:-1]
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s < sc.shortest:
                    continue
                inner = cuts[np.searchsorted(cuts, s, "right") : np.searchsorted(cuts, e, "left")].tolist()
                for a, b in zip([s, *inner], [*inner, e], strict=True):
                    if b - a < sc.shortest:
                        continue
                    doc = int(w.doc[a])
                    base = a - int(w.first[doc])
                    # a word whose hash alone is a template word's resets the automaton
                    ids = [sc.vocabulary.get(w.data[i:j].tobytes(), -1) for i, j in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]
                    found, long = sc.stream(ids)
                    places[doc] += [{"label": sc.phrase_labels[t], "start": base + i} for t, i in found]
                    matches[doc] += [(base + i, n, state) for i, n, state in long]
            spans = [[dict(zip(("label", "start", "end", "cover"), x, strict=True)) for x in sc.chains(m)] if m else [] for m in matches]
            keep = [c for c, f in zip(part.columns, part.schema, strict=True) if f.name != text_col]
            names = [f.name for f in part.schema if f.name != text_col]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(w.counts(), pa.int64()), pa.array(places, place_type), pa.array(spans, span_type)], names=[*names, "n_words", "phrase_places", "notice_spans"]
            )

    return docs.mapInArrow(run, schema)
