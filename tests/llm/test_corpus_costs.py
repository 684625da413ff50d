"""Work that an operator must not do: seconds are compared with those of plain steps on the same rows."""

import time
import tracemalloc
from array import array

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import alignment, bpe, quality, suffix_dedup, trie_bpe

MULTI, JSON, PIECES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
_LENGTHS, _ENCODER, _OWN, _PLAIN = bpe.lengths(MULTI, P.PATTERN), bpe.encoder(MULTI, P.PATTERN), alignment.Aligner(JSON, PIECES), trie_bpe.Encoder(JSON, special=False)
TEXTS = st.text(st.one_of(st.sampled_from("ab's  \n\t\r\x0b\x1c\xa0\u3000 1.,é日"), st.characters(exclude_categories=["Cs"])), max_size=40)


def invented(n: int, seed: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("aeinrstuoldhbc"), rng.integers(4, 16))) for _ in range(n))


def seconds(f, turns: int = 3) -> float:
    out = []
    for _ in range(turns):
        began = time.thread_time()
        f()
        out.append(time.thread_time() - began)
    return min(out)


def test_refinement_takes_less_than_sorting_each_place():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 110, (7000, 80)).astype(np.uint8)[rng.integers(0, 7000, 20_000)]
    rows[rng.integers(0, 20_000, 10_000), rng.integers(0, 80, 10_000)] = 65

    def sorted_by_eight_bytes():
        for c in range(73):
            np.argsort(np.ascontiguousarray(rows[:, c : c + 8]).view(">u8").ravel().astype(np.uint64), kind="stable")

    assert seconds(lambda: list(suffix_dedup.refine(rows))) < 0.5 * seconds(sorted_by_eight_bytes)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_lengths_are_those_of_the_ids(text):
    out = array("i")
    _ENCODER.encode(text, out)
    assert _LENGTHS.of(text) == len(out)
    assert bpe.merged_length(text.encode() * 3, _LENGTHS.ranks) == len(bpe.merge(text.encode() * 3, _LENGTHS.ranks) if text else [])


def test_lengths_of_new_words_take_less_than_their_ids():
    text = invented(4000, 5)

    made, counted = bpe.Encoder(MULTI, P.PATTERN), bpe.Lengths(MULTI, P.PATTERN)

    def ids():
        made.known.clear()
        made.encode(text, array("i"))

    def lengths():
        counted.clear()
        counted.of(text)

    assert seconds(lengths) < 0.6 * seconds(ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_ids_of_segments_are_those_of_texts(texts):
    segments = _OWN.segments
    ids, counts = segments.encode(segments.cut(texts))
    want = [_PLAIN.encode([f" {t}" if t else None for t in texts]), [np.array(x, np.uint32).tobytes() for x in _OWN.b.model.encode(texts)]]
    for got, n, side in zip(ids, counts, want, strict=True):
        assert got.astype("<u4").tobytes() == b"".join(side) and n.tolist() == [len(x) // 4 for x in side]


def test_segments_that_are_known_are_not_split_again():
    """The pattern of side A is looked for in new segments only."""
    own = alignment.Aligner(JSON, PIECES)
    texts = [invented(300, 6), "a few other words"]
    first = own.align(texts)
    seen = []
    own.segments.a.split, split = lambda s: seen.append(s) or split(s), own.segments.a.split
    again = own.align([texts[0], "a few other words once"])
    assert seen == [" once"]
    assert np.array_equal(first["link_a"][: first["link_at"][1]], again["link_a"][: again["link_at"][1]])


def test_samples_are_held_by_their_ones():
    """A fit's rows take the driver less than a float for each of their columns, and give the weights of the whole matrix."""
    rng = np.random.default_rng(8)
    dense = rng.random((4000, 1284)) < 0.03
    packed = [r.tobytes() for r in np.packbits(dense, axis=1)]
    y = (dense[:, :40].sum(axis=1) > 1).astype(float)
    tracemalloc.start()
    x = quality.Ones.of(packed, 1284)
    b, c = quality.logistic(x, y, np.ones(4000), 2e-4, turns=5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4000 * 1284
    want, at = quality.logistic(dense.astype(float), y, np.ones(4000), 2e-4, turns=5)
    assert np.allclose(b, want) and np.isclose(c, at)
    some = np.array([7, 3, 900])
    for got, full in ((x.take(some), dense[some]), (x.take(some).above(x), np.r_[dense[some], dense])):
        whole = np.zeros(got.shape, bool)
        whole[got.row, got.col] = True
        assert np.array_equal(whole, full)
