"""Language identification by string kernels.

The kernel is the normalised blended-spectrum presence kernel: the number of byte n-grams
of orders 1 to `order` that two texts share, over the root of the product of
their numbers. N-grams are told apart by their bytes, not by hashes. A Nystroem map spans the
kernel by landmarks of the training sample, one-versus-rest kernel ridge regression
gives the weights, and documents are scored by batched matrix products: a batch's presence
matrix, over the landmarks' n-grams that it has, times the landmarks', normalised, times the weights.

The model is fitted on a bounded sample (`per_lang` training rows a language, and `sample` in all, the
least by a hash of the id); every document is scored over its whole text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .shared import tune

#: Letters are lower-cased, other ASCII is white space; no byte is 0.
_FOLD = np.where(tk.LOWER >= 128, tk.LOWER, np.where((tk.LOWER >= 97) & (tk.LOWER <= 122), tk.LOWER, 32)).astype(np.uint8)
#: Bytes of n-grams at most: they are numbers of 32 bits.
LONGEST = 4


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each document, in order, and where each document's begin."""
    n = len(offsets) - 1
    text = _FOLD[data].astype(np.uint64)
    doc = np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(32), np.diff(offsets))
    parts, gram = [], np.zeros(len(text), np.uint64)
    for k in range(1, order + 1):
        m = len(text) - k + 1
        if m <= 0:
            break
        gram = gram[:m] | text[k - 1 :] << np.uint64(8 * (k - 1))
        parts.append((doc[:m] | gram)[doc[:m] == doc[k - 1 :]])
    every = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    every.sort()
    every = every[np.r_[True, every[1:] != every[:-1]]] if len(every) else every
    return every.astype(np.uint32), np.searchsorted(every, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))


class Landmarks:
    """Texts that span the kernel: their n-grams, and which landmark has which."""

    def __init__(self, sets: list[np.ndarray]):
        self.grams = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint32)
        self.size = np.array([len(s) for s in sets])
        has = np.zeros((len(self.grams), len(sets)), bool)
        for i, s in enumerate(sets):
            has[np.searchsorted(self.grams, s), i] = True
        self.n, self.packed = len(sets), np.packbits(has, axis=1)

    def kernel(self, found: np.ndarray, first: np.ndarray, step: int = 64) -> np.ndarray:
        """Kernel values: documents, given by grams(), x landmarks."""
        n = len(first) - 1
        size = np.diff(first)
        row = np.repeat(np.arange(n), size)
        at = np.minimum(np.searchsorted(self.grams, found), max(0, len(self.grams) - 1))
        hit = self.grams[at] == found if len(self.grams) else np.zeros(len(found), bool)
        row, at = row[hit], at[hit]
        cut = np.searchsorted(row, np.arange(0, n + step, step))
        out = np.zeros((n, self.n), np.float32)
        for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
            if j > i:
                used, col = np.unique(at[i:j], return_inverse=True)
                presence = np.zeros((min(step, n - b * step), len(used)), np.float32)
                presence[row[i:j] - b * step, col] = 1
                out[b * step : b * step + step] = presence @ np.unpackbits(self.packed[used], axis=1)[:, : self.n].astype(np.float32)
        return out / np.sqrt(np.maximum(1, size)[:, None] * np.maximum(1, self.size)[None, :])


class Model:
    def __init__(self, langs: list[str], landmarks: Landmarks, weights: np.ndarray, bias: np.ndarray, order: int):
        self.langs, self.landmarks, self.weights, self.bias, self.order = langs, landmarks, weights, bias, order

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One-versus-rest scores: documents x languages, about -1 to 1."""
        return self.landmarks.kernel(*grams(data, offsets, self.order)) @ self.weights + self.bias


def fit(langs: np.ndarray, sets: list[np.ndarray], n_landmarks: int, ridge: float, order: int) -> Model:
    """Nystroem features of the sample's n-gram sets, and ridge regression of each language against the rest."""
    names = sorted(set(langs.tolist()))
    turn = np.zeros(len(langs), np.int64)  # landmarks are dealt evenly to the languages, one each at least
    for name in names:
        at = np.flatnonzero(langs == name)
        turn[at] = np.arange(len(at))
    marks = np.lexsort((langs, turn))[: max(n_landmarks, len(names))]
    landmarks = Landmarks([sets[i] for i in marks])
    k = landmarks.kernel(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])]).astype(float)
    value, vector = np.linalg.eigh(k[marks])
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    phi = k @ root
    mean = phi.mean(axis=0)
    y = np.where(langs[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # each language weighs the same
    w = (1 / np.array([np.sum(langs == lang) for lang in langs]))[:, None]
    w = w * len(langs) / w.sum()
    centre = phi - mean
    beta = np.linalg.solve(centre.T @ (w * centre) + ridge * np.eye(len(mean)), centre.T @ (w * (y - np.average(y, axis=0, weights=w[:, 0]))))
    bias = np.average(y, axis=0, weights=w[:, 0]) - mean @ beta
    return Model(names, landmarks, root @ beta, bias, order)


def sample_rows(docs: DataFrame, lang_col: str, text_col: str, rank: Column, per_lang: int, sample: int) -> DataFrame:
    """lang, rank, text: `per_lang` rows of each language, or `sample` over the number of languages if that is less, of least
    rank. Rows that repeat rank and text are one; rows of one rank go by a hash of the text."""
    text = F.col(f"`{text_col}`")
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & text.isNotNull())
    rows = rows.select(F.col(f"`{lang_col}`").alias("lang"), F.struct(rank.alias("rank"), F.xxhash64(text).alias("hash")).alias("key"), text.alias("text"))
    langs = rows.agg(F.count_distinct("lang")).first()[0]
    most = max(1, min(per_lang, sample // max(1, langs)))
    first = Window.partitionBy("lang").orderBy("key")
    # dense ranks, so that repeats neither fill the sample nor enlarge it
    last = rows.select("lang", "key").withColumn("i", F.dense_rank().over(first)).where(F.col("i") <= most).groupBy("lang").agg(F.max("key").alias("last"))
    chosen = rows.join(F.broadcast(last), "lang").where("key <= last")  # a row a language
    return chosen.groupBy("lang", "key").agg(F.min("text").alias("text")).select("lang", "key.rank", "text")


def train(docs: DataFrame, lang_col: str, text_col: str, rank: Column, per_lang: int = 250, sample: int = 4000, n_landmarks: int = 128, ridge: float = 1.0, order: int = 4) -> Model | None:
    """A model of the rows of `docs` with a language and a text; None without such rows.

    The sample is bounded by `per_lang` and `sample` rows (and one a language), whatever repeats or ties. Other columns
    of `docs` aren't read.
    """
    if not 1 <= order <= LONGEST:
        raise ValueError(f"order must be 1 to {LONGEST}")
    tune(docs.sparkSession)
    chosen = sample_rows(docs, lang_col, text_col, rank, per_lang, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tk.chunks(batches, "text"):
            found, first = grams(*tk.column(part, "text"), order)
            sets = [found[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("rank"), pa.array(sets, pa.binary())], names=["lang", "rank", "grams"])

    got = chosen.mapInArrow(run, "lang string, rank bigint, grams binary").toArrow().sort_by([("lang", "ascending"), ("rank", "ascending"), ("grams", "ascending")])
    if not got.num_rows:
        return None
    return fit(np.array(got["lang"].to_pylist(), dtype=object), [np.frombuffer(b, np.uint32) for b in got["grams"].to_pylist()], n_landmarks, ridge, order)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """`docs` without `text_col`, with lang_pred and score (0 to 1).

    `und` and 0 where the text is null or has no letter, and everywhere if nothing was learned. Ties go to
    the first language by name. lang_pred and score must not be columns of `docs`; other names don't matter, and rows that
    repeat are scored each by itself.
    """
    spark = docs.sparkSession
    tune(spark)
    rest = [f for f in docs.schema.fields if f.name != text_col]
    if {"lang_pred", "score"} & {f.name for f in rest}:
        raise ValueError("a column of the result exists already")
    shared = spark.sparkContext.broadcast(pickle.dumps(model))  # the landmarks' n-grams and the weights
    names = [f"c{i}" for i in range(len(rest))]
    text = F.col(f"`{text_col}`")
    inner = docs.select(*[F.col(f"`{f.name}`").alias(n) for f, n in zip(rest, names, strict=True)], text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model | None = pickle.loads(shared.value)
        for part in tk.chunks(batches, "text"):
            letter = part.column("letter").to_numpy(zero_copy_only=False).astype(bool)
            found, score = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
            if m is not None and letter.any():
                s = m.scores(*tk.column(part, "text"))
                best = s.argmax(axis=1)
                found = np.where(letter, np.array(m.langs, object)[best], "und")
                score = np.where(letter, np.clip((s[np.arange(len(s)), best] + 1) / 2, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found.tolist(), pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    fields = [T.StructField(n, f.dataType, f.nullable) for f, n in zip(rest, names, strict=True)]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return inner.mapInArrow(run, schema).toDF(*[f.name for f in rest], "lang_pred", "score")
