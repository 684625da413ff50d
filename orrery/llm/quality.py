"""Quality classifier by co-training.

Two views of a document: its text (words that tell, and the text's shape) and the
page's metadata (source, language, stated length). Each view has a logistic model. In
each round both views score the whole unlabelled table; rows on which a view's calibrated probability is
near 0 or 1 are pseudo-labelled by it, and the other view is fitted again on its labelled rows and a sample of these.
Then both views are calibrated on labelled rows kept aside, combined there, and every document is scored.

Quality and freedom of toxicity are two targets, each with models, score and limit of its own. A limit
is where the shares of both classes that are judged wrongly have the least sum, over all labelled rows
outside of the fit.

Words are counted over all labelled rows and shapes over all documents, in the cluster. Only the fits are on bounded samples of
labelled rows: `labelled` of the given labels, and `pool` pseudo-labelled rows for each view, class and round, the
least by a hash of the id.
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
from .shared import dropped, shared_table, tune

#: Shape features, in order.
SHAPE = ["upper", "digit", "symbol", "distinct_words", "same_word_next", "word_length", "distinct_lines", "pipes", "words", "lower_start"]
_UPPER, _DIGIT, _SYMBOL = np.zeros(256), np.zeros(256), np.zeros(256)
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_LINE = np.ones(256, bool)
_LINE[10] = False


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    s = np.r_[0, np.cumsum(values)]
    return s[offsets[1:]] - s[offsets[:-1]]


def _distinct(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])] if len(h) else np.zeros(0, bool)
    return np.bincount(d[fresh], minlength=n)


def features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes (lower-cased letters and digits) and their documents, and the shape matrix of a chunk."""
    data, off = tk.column(part, "text")
    n = part.num_rows
    size = np.maximum(1, np.diff(off))
    words = tk.Words(data, off, tk.ALNUM, lower=True)
    h, count = words.hashes(), words.counts()
    w = np.maximum(1, count)
    raw = tk.Words(data, off, _LINE)
    next_same = np.bincount(words.doc[:-1][(h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])], minlength=n) if len(h) else np.zeros(n)
    lines = np.maximum(1, raw.counts())
    lower_start = np.bincount(words.doc, weights=(data[words.start] >= 97) & (data[words.start] <= 122), minlength=n) if len(h) else np.zeros(n)
    shape = np.stack(
        [
            _sums(_UPPER[data], off) / size,
            _sums(_DIGIT[data], off) / size,
            _sums(_SYMBOL[data], off) / size,
            _distinct(h, words.doc, n) / w,
            next_same / w,
            np.bincount(words.doc, weights=words.end - words.start, minlength=n) / w if len(h) else np.zeros(n),
            _distinct(raw.hashes(), raw.doc, n) / lines,
            _sums(data == 124, off) / w,
            np.log1p(count),
            lower_start / w,
        ],
        axis=1,
    )
    return h, words.doc, shape


def _bins(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Column of the one-hot bin of each value: one row of edges a feature."""
    return np.stack([np.searchsorted(e, v, "right") + i * (len(e) + 1) for i, (e, v) in enumerate(zip(edges, values.T, strict=True))], axis=1)


class Ones:
    """A matrix of 0 and 1 by the places of its ones: the driver's samples take some bytes for each feature that a row has."""

    def __init__(self, row: np.ndarray, col: np.ndarray, shape: tuple[int, int]):
        self.row, self.col, self.shape = row, col, shape

    @classmethod
    def of(cls, rows: list[bytes], width: int) -> Ones:
        """Of packed rows, a few at a time."""
        found = [np.zeros((2, 0), np.int32)]
        for at in range(0, len(rows), 256):
            packed = np.frombuffer(b"".join(rows[at : at + 256]), np.uint8).reshape(-1, -(-width // 8))
            found.append(np.stack(np.nonzero(np.unpackbits(packed, axis=1)[:, :width])).astype(np.int32) + np.array([[at], [0]], np.int32))
        return cls(*np.concatenate(found, axis=1), (len(rows), width))

    def take(self, rows: np.ndarray) -> Ones:
        """Different rows, in their order here."""
        place = np.full(self.shape[0], -1, np.int32)
        place[rows] = np.arange(len(rows))
        row = place[self.row]
        return Ones(row[row >= 0], self.col[row >= 0], (len(rows), self.shape[1]))

    def above(self, other: Ones) -> Ones:
        return Ones(np.r_[self.row, other.row + np.int32(self.shape[0])], np.r_[self.col, other.col], (self.shape[0] + other.shape[0], self.shape[1]))

    @property
    def T(self) -> Ones:
        return Ones(self.col, self.row, self.shape[::-1])

    def __matmul__(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=v[self.col], minlength=self.shape[0])

    def astype(self, kind: type) -> np.ndarray:
        """The whole matrix."""
        out = np.zeros(self.shape, kind)
        out[self.row, self.col] = 1
        return out

    def squares(self) -> np.ndarray:
        """The sum of squares of each row."""
        return np.bincount(self.row, minlength=self.shape[0]).astype(float)


def logistic(x: np.ndarray | Ones, y: np.ndarray, w: np.ndarray, ridge: float, turns: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps; each class weighs the same."""
    w = w * np.where(y > 0.5, 0.5 / max(1e-9, (w * (y > 0.5)).sum()), 0.5 / max(1e-9, (w * (y <= 0.5)).sum()))
    lip = 0.25 * float(w @ (x.squares() if isinstance(x, Ones) else np.einsum("ij,ij->i", x, x))) + 0.25 + ridge
    step = 1 / min(lip, 0.25 * _top(x, w) + 0.25 + ridge)
    b, c, pb, pc, t = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 1.0
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ pb + pc, -30, 30)))
        g = w * (p - y)
        nb, nc = pb - step * (x.T @ g + ridge * pb), pc - step * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pb, pc = nb + (t - 1) / nt * (nb - b), nc + (t - 1) / nt * (nc - c)
        b, c, t = nb, nc, nt
    return b, float(c)


def _top(x: np.ndarray | Ones, w: np.ndarray) -> float:
    """Largest eigenvalue of x' diag(w) x, a little over."""
    v = np.ones(x.shape[1]) / np.sqrt(max(1, x.shape[1]))
    top = 1.0
    for _ in range(30):
        u = x.T @ (w * (x @ v))
        top = float(np.linalg.norm(u)) or 1.0
        v = u / top
    return 1.1 * top + 1e-6


def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    b, c = logistic(np.asarray(s, float)[:, None], y, np.ones(len(y)), 1e-4)
    return float(b[0]), c


def _prob(s: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


class Frame:
    """Columns of both views: words and bins of the shape; hashed places of the metadata."""

    META = 1024

    def __init__(self, vocabulary: np.ndarray, edges: np.ndarray):
        self.vocabulary, self.edges = np.sort(vocabulary), edges
        self.widths = (len(vocabulary) + len(SHAPE) * (edges.shape[1] + 1), self.META)

    def text_columns(self, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(document, column) of the text view's features that are present."""
        h, doc, shape = features(part)
        row, col = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(h) and len(self.vocabulary):
            at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
            hit = self.vocabulary[at] == h
            pair = np.unique(doc[hit] * len(self.vocabulary) + at[hit])
            row, col = pair // len(self.vocabulary), pair % len(self.vocabulary)
        bins = _bins(shape, self.edges) + len(self.vocabulary)
        return np.r_[row, np.repeat(np.arange(part.num_rows), bins.shape[1])], np.r_[col, bins.ravel()]

    def columns(self, part: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        """(document, column) of both views; the metadata arrive as hashed places."""
        lists = part.column("meta")
        places = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        return [self.text_columns(part), places]


class Model:
    """Weights, calibration and limit of one target."""

    def __init__(self, fitted: list, scale: list, both: tuple):
        self.fitted, self.scale, self.both, self.limit = fitted, scale, both, 0.5

    def scores(self, raw: list[np.ndarray]) -> list[np.ndarray]:
        """Calibrated scores of the text view, the metadata view and both, from raw scores."""
        at = [s * r + c for (s, c), r in zip(self.scale, raw, strict=True)]
        return [_prob(at[0]), _prob(at[1]), _prob(np.stack(at, axis=1) @ self.both[0] + self.both[1])]

    def of_columns(self, found: list[tuple[np.ndarray, np.ndarray]], n: int) -> list[np.ndarray]:
        # metadata columns may hash to one place, which counts once
        found = [found[0], tuple(np.unique(np.stack(found[1]), axis=1))]
        return self.scores([np.bincount(row, weights=b[col], minlength=n) + c for (row, col), (b, c) in zip(found, self.fitted, strict=True)])

    def of_rows(self, x: list[np.ndarray]) -> list[np.ndarray]:
        return self.scores([v @ b + c for v, (b, c) in zip(x, self.fitted, strict=True)])


class Quality:
    """The frame and a model for each target that has one."""

    def __init__(self, frame: Frame, models: dict[str, Model]):
        self.frame, self.models = frame, models


#: What is judged: 1 is right for both. A target without rows of both classes has no model.
TARGETS = ["good", "clean"]
#: Bins of a score from 0 to 1, for limits.
BINS = 1 << 16
#: Rows of each class by which the shares are smoothed.
FEW = 100
#: Labelled ids that are broadcast at most; beyond, texts are shuffled to them.
NARROW = 1 << 20


def _meta(docs: DataFrame, columns: list[str]):
    """array<int> of hashed metadata: each column's value, and the length's power of two for numbers."""
    kinds = dict(docs.dtypes)
    out = []
    for c in columns:
        v = F.col(f"`{c}`")
        if kinds[c] in ("bigint", "int", "smallint", "double", "float"):
            v = F.floor(F.log2(F.greatest(v.cast("double"), F.lit(0.0)) + 1))
        out.append(F.pmod(F.xxhash64(F.lit(c), F.coalesce(v.cast("string"), F.lit("\0"))), F.lit(Frame.META)).cast("int"))
    return F.array(*out) if out else F.expr("cast(array() as array<int>)")


def _known(labels: DataFrame, id_col: str) -> DataFrame:
    """_id, good and clean (0/1 or null), a row an id."""
    toxic = F.col("toxic") if "toxic" in labels.columns else F.lit(None).cast("int")
    rows = labels.groupBy(F.col(f"`{id_col}`").cast("long").alias("_id")).agg(F.min("good").cast("int").alias("good"), (1 - F.max(toxic)).cast("int").alias("clean"))
    return rows.where("_id is not null and (good is not null or clean is not null)")


def statistics(rows: DataFrame, flush: int = 500_000) -> DataFrame:
    """Counts over `rows` (text, good, clean), as kind, key and n1..n4. Kind 0: labelled documents that have a word (key), by
    good 1 and 0, clean 1 and 0. Kind 1: documents in a cell of a shape feature (key: feature * 2**16 + cell). Kind 2: all labelled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, total = [], 0, np.zeros(4, np.int64)
        cells = np.zeros((len(SHAPE), 1 << 16), np.int64)

        def out(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind), pa.int32()), pa.array(key, pa.int64()), *(pa.array(c, pa.int64()) for c in n)], names=["kind", "key", "n1", "n2", "n3", "n4"])

        def words() -> pa.RecordBatch:
            h, marks = (np.concatenate(x) for x in zip(*held, strict=True))
            key, at = np.unique(h, return_inverse=True)
            return out(0, key.view(np.int64), [np.bincount(at, weights=marks >> i & 1, minlength=len(key)).astype(np.int64) for i in range(4)])

        for part in tk.chunks(batches, "text"):
            h, doc, shape = features(part)
            for i, v in enumerate(shape.T):
                cells[i] += np.bincount(_cell(v), minlength=1 << 16)
            mark = np.zeros(part.num_rows, np.uint8)
            for i, (target, value) in enumerate((t, v) for t in TARGETS for v in (1, 0)):
                mark |= (part.column(target).fill_null(-1).to_numpy(zero_copy_only=False) == value).astype(np.uint8) << i
            total += [int((mark >> i & 1).sum()) for i in range(4)]
            some = mark[doc] > 0 if len(h) else np.zeros(0, bool)
            if some.any():
                order = np.lexsort((h[some], doc[some]))
                hs, ds = h[some][order], doc[some][order]
                fresh = np.r_[True, (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])]
                held.append((hs[fresh], mark[ds[fresh]]))
                size += int(fresh.sum())
            if size >= flush:
                yield words()
                held, size = [], 0
        if size:
            yield words()
        feature, cell = np.nonzero(cells)
        yield out(1, feature.astype(np.int64) << 16 | cell, [cells[feature, cell]] + [np.zeros(len(cell), np.int64)] * 3)
        yield out(2, np.zeros(1, np.int64), total[:, None])

    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(1, 5)]
    return rows.mapInArrow(run, "kind int, key bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint").groupBy("kind", "key").agg(*sums)


def _cell(v: np.ndarray) -> np.ndarray:
    """The upper half of a float of 32 bits: in order for values from 0."""
    return (np.maximum(v, 0).astype(np.float32).view(np.uint32) >> 16).astype(np.int64)


def _likelihood(a: Column, b: Column, of_a: int, of_b: int) -> Column:
    """Log likelihood ratio (G) of a word's presence in two classes against one share in both."""
    share = (a + b) / (of_a + of_b)
    part = lambda seen, want: F.when(seen > 0, seen * F.log(seen / want)).otherwise(F.lit(0.0))
    return 2 * (part(a, of_a * share) + part(b, of_b * share) + part(of_a - a, of_a * (1 - share)) + part(of_b - b, of_b * (1 - share)))


def _frame(counts: DataFrame, words: int) -> Frame | None:
    """The words with the surest odds of each target, and edges at even shares of all documents' shapes."""
    total = counts.where("kind = 2").first()
    if total is None:
        return None
    chosen = []
    for a, b in (("n1", "n2"), ("n3", "n4")):
        if min(total[a], total[b]) == 0:
            continue
        tell = counts.where(f"kind = 0 and {a} + {b} >= 3").select("key", _likelihood(F.col(a), F.col(b), total[a], total[b]).alias("g")).where("g > 11")
        chosen.append(tell.orderBy(F.desc("g"), "key").limit(words).toArrow()["key"].to_numpy().view(np.uint64))
    shape = counts.where("kind = 1").select("key", "n1").toArrow().sort_by("key")  # at most 2**16 cells a feature
    key, n = shape["key"].to_numpy(), shape["n1"].to_numpy()
    edges = np.zeros((len(SHAPE), 25))
    for i in range(len(SHAPE)):
        mine = key >> 16 == i
        value = ((key[mine] & 0xFFFF).astype(np.uint32) << 16).view(np.float32)
        share = np.cumsum(n[mine]) / max(1, n[mine].sum())
        edges[i] = value[np.minimum(np.searchsorted(share, np.linspace(0.02, 0.98, 25)), len(value) - 1)] if len(value) else 0
    return Frame(np.unique(np.concatenate(chosen)) if chosen else np.zeros(0, np.uint64), edges)


def _ones(table: pa.Table, widths: tuple[int, int]) -> list[Ones]:
    """The rows' features in both views."""
    return [Ones.of(table[name].to_pylist(), width) for name, width in zip(("x0", "x1"), widths, strict=True)]


def _unpacked(batch: pa.RecordBatch, widths: tuple[int, int]) -> list[np.ndarray]:
    """The rows' features in both views, as float32 matrices."""
    out = []
    for name, width in zip(("x0", "x1"), widths, strict=True):
        rows = batch[name].to_pylist()
        packed = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -(-width // 8))
        out.append(np.unpackbits(packed, axis=1)[:, :width].astype(np.float32))
    return out


def feature_rows(rows: DataFrame, frame: Frame) -> DataFrame:
    """_id, good, clean, x0, x1: labels and packed features of `rows` (_id, text, meta, good, clean), one row an id; rows
    without one are left out."""
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(frame))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fr: Frame = pickle.loads(shared.value)
        for part in tk.chunks(batches, "text"):
            out = [part.column(c) for c in ("_id", *TARGETS)]
            for (row, col), width in zip(fr.columns(part), fr.widths, strict=True):
                x = np.zeros((part.num_rows, width), bool)
                x[row, col] = True
                out.append(pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=["_id", *TARGETS, "x0", "x1"])

    made = rows.where("_id is not null").mapInArrow(run, "_id bigint, good int, clean int, x0 binary, x1 binary")
    return made.groupBy("_id").agg(F.min(F.struct(*TARGETS, "x0", "x1")).alias("x")).select("_id", "x.*")


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: tuple[str, ...] = ("source", "lang", "n_chars"),
    labelled: int = 5000,
    pool: int = 1000,
    words: int = 512,
    rounds: int = 2,
    confident: float = 0.97,
    ridge: float = 2e-4,
) -> Quality | None:
    """Models by target from `labels` (id, good 0/1, and toxic 0/1 if known); None unless both classes of one are labelled.

    Labels of one id are combined: it is good, or not toxic, if all say so. Ids that `docs` lacks, and null labels, don't count.
    Of rows that repeat an id, all count in the statistics and one in the fits. Texts may be null, empty or of any length.
    """
    spark = docs.sparkSession
    tune(spark)
    known = shared_table(_known(labels, id_col), "labels")
    told = F.broadcast(known) if known.count() <= NARROW else known
    text = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), _meta(docs, [c for c in meta_cols if c in docs.columns]).alias("meta")
    )
    text = text.join(told, "_id", "left")
    counts = shared_table(statistics(text.select("text", *TARGETS)), "counts")
    frame = _frame(counts, words)
    if frame is None:
        return None
    rows = shared_table(feature_rows(text, frame), "features")
    models, taken = {}, set()
    for target in TARGETS:
        found = cotrain(rows, target, frame, labelled, pool, rounds, confident, ridge)
        if found is not None:
            models[target], fitted = found
            taken |= fitted
    if models:
        _set_limits(models, rows, taken, frame)
    dropped(counts, rows, known)
    tk.released()
    return Quality(frame, models) if models else None


def cotrain(rows: DataFrame, target: str, frame: Frame, labelled: int, pool: int, rounds: int, confident: float, ridge: float) -> tuple[Model, set[int]] | None:
    """A model of `target`, and the ids of labels it is fitted on; None without both classes. `rows` are of feature_rows()."""
    told = rows.where(F.col(target).isNotNull())
    ids = told.select("_id", F.col(target).alias("y")).orderBy(F.xxhash64("_id", F.lit(77)), "_id").limit(labelled)
    got = told.select("_id", "x0", "x1").join(F.broadcast(ids), "_id").toArrow().sort_by("_id")  # `labelled` rows at most
    y = got["y"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return None
    x = _ones(got, frame.widths)
    fold = tk.mix(got["_id"].to_numpy().view(np.uint64) + np.uint64(5)) % np.uint64(4) == 0
    kept, fit = np.flatnonzero(fold), np.flatnonzero(~fold)
    if min(len(set(y[kept])), len(set(y[fit]))) < 2:
        kept = fit = np.arange(len(y))
    free = rows.where(F.col(target).isNull()).select("_id", "x0", "x1")
    pseudo = [(p.take(fit[:0]), np.zeros(0)) for p in x]  # for each view, from the other one
    for turn in range(rounds + 1):
        fitted = []
        for v in (0, 1):
            extra, label = pseudo[v]
            w = np.r_[np.ones(len(fit)), np.full(len(label), 0.5)]
            fitted.append(logistic(x[v].take(fit).above(extra), np.r_[y[fit], label], w, ridge))
        raw = [x[v] @ fitted[v][0] + fitted[v][1] for v in (0, 1)]
        scale = [_platt(raw[v][kept], y[kept]) for v in (0, 1)]
        if turn < rounds:
            pseudo = _pseudo_labelled(free, Model(fitted, scale, (np.zeros(2), 0.0)), frame, (turn + 1) * pool, confident)
    both = np.stack([scale[v][0] * raw[v] + scale[v][1] for v in (0, 1)], axis=1)
    return Model(fitted, scale, logistic(both[kept], y[kept], np.ones(len(kept)), 1e-4)), set(got["_id"].to_numpy()[fit].tolist())


def _pseudo_labelled(free: DataFrame, model: Model, frame: Frame, most: int, confident: float) -> list[tuple[Ones, np.ndarray]]:
    """For each view the features and labels of rows on which the other one is sure: of all `free` rows, `most` a class."""
    shared = free.sparkSession.sparkContext.broadcast(pickle.dumps((model, frame.widths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, widths = pickle.loads(shared.value)
        for batch in batches:
            p = m.of_rows(_unpacked(batch, widths)) if batch.num_rows else []
            for v in range(len(p) and 2):
                sure = np.flatnonzero((p[v] >= confident) | (p[v] <= 1 - confident))
                columns = [batch.column("_id").take(pa.array(sure)), pa.array(np.full(len(sure), 1 - v), pa.int32()), pa.array((p[v][sure] > 0.5).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "view", "y"])

    every = shared_table(free.mapInArrow(run, "_id bigint, view int, y int").withColumn("h", F.xxhash64("_id", F.lit(78))), "sure")
    # hashes are even: about 2 * most rows of a class are below this share, and then the least are taken
    size = every.groupBy("view", "y").agg(F.least(F.lit(1.0), F.lit(2.0 * most + 100) / F.count("*")).alias("share"))  # 4 rows
    low = every.join(F.broadcast(size), ["view", "y"]).where(F.col("h") <= F.lit(-(2.0**63)) + F.col("share") * F.lit(2.0**64))
    first = Window.partitionBy("view", "y").orderBy("h", "_id")
    chosen = shared_table(low.withColumn("r", F.row_number().over(first)).where(F.col("r") <= most).select("_id", "view", "y"), "chosen")
    got = free.join(F.broadcast(chosen), "_id").toArrow().sort_by([("view", "ascending"), ("_id", "ascending")])  # 4 * most rows at most
    dropped(every, chosen)
    x = _ones(got, frame.widths)
    view, y = got["view"].to_numpy(), got["y"].to_numpy().astype(float)
    return [(x[v].take(np.flatnonzero(view == v)), y[view == v]) for v in (0, 1)]


def _set_limits(models: dict[str, Model], rows: DataFrame, taken: set[int], frame: Frame) -> None:
    """Limits from all labelled rows that are not `taken` for a fit.

    Each class weighs the same, as in the fit, so neither is traded for the other.
    """
    spark = rows.sparkSession
    used = F.broadcast(spark.createDataFrame([(i,) for i in sorted(taken)], "_id bigint"))
    outside = rows.where(F.coalesce(*TARGETS).isNotNull()).join(used, "_id", "left_anti")
    shared = spark.sparkContext.broadcast(pickle.dumps((models, frame.widths)))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, widths = pickle.loads(shared.value)
        for batch in batches:
            if batch.num_rows:
                x = _unpacked(batch, widths)
                for t, one in m.items():
                    at = np.minimum(BINS - 1, one.of_rows(x)[2] * BINS).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(at)), batch.column(t), pa.array(at)], names=["target", "label", "at"])

    counts = outside.mapInArrow(bins, "target string, label int, at int").where("label is not null").groupBy("target", "label", "at").agg(F.count("*").alias("n")).toArrow()
    of = np.array(counts["target"].to_pylist(), object)
    label, at, number = (counts[c].to_numpy() for c in ("label", "at", "n"))
    for target, model in models.items():
        n = np.zeros((2, BINS), np.int64)
        mine = of == target
        n[label[mine], at[mine]] = number[mine]
        model.limit = _limit(n)


def _limit(n: np.ndarray) -> float:
    """Limit from the numbers of wrong (row 0) and right rows in each bin of the score.

    The shares are smoothed by FEW rows of each class, wrong ones spread evenly below 0.5 and right ones above: few rows
    leave the limit near 0.5, that point of a calibrated score, and many decide it. One rule at every size.
    """
    t = np.arange(BINS + 1) / BINS
    below = np.c_[np.zeros((2, 1), np.int64), np.cumsum(n, axis=1)]
    wrong = (n[0].sum() - below[0] + FEW * np.clip(1 - 2 * t, 0, 1)) / (n[0].sum() + FEW)
    errors = wrong + (below[1] + FEW * np.clip(2 * t - 1, 0, 1)) / (n[1].sum() + FEW)
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    return float(best[np.argmin(np.abs(best - BINS / 2))]) / BINS  # of equal ones the nearest to 0.5


def classify(docs: DataFrame, model: Quality | None, text_col: str = "text", meta_cols: tuple[str, ...] = ("source", "lang", "n_chars")) -> DataFrame:
    """`docs` with text_score, meta_score (calibrated, 0 to 1), quality_score, toxic_score and quality_keep.

    A document is kept if its quality reaches the limit and its freedom of toxicity (1 - toxic_score) the other limit.
    A null text counts as empty and null metadata as a value of its own. Without a model scores are 1, and toxic_score 0.
    Nothing is shuffled. Rows that repeat an id are scored each by itself. The new columns must not be columns of `docs`;
    other names don't matter.
    """
    new = ["text_score", "meta_score", "quality_score", "toxic_score", "quality_keep"]
    if set(new) & set(docs.columns):
        raise ValueError("a column of the result exists already")
    spark = docs.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(pickle.dumps(model))
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], _meta(docs, [c for c in meta_cols if c in docs.columns]).alias("meta"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Quality | None = pickle.loads(shared.value)
        for part in tk.chunks(batches, text):
            n = part.num_rows
            keep, got = np.ones(n, bool), {t: [np.ones(n)] * 3 for t in TARGETS}
            if m is not None:
                found = m.frame.columns(pa.RecordBatch.from_arrays([part.column(text), part.column("meta")], names=["text", "meta"]))
                for t, one in m.models.items():
                    got[t] = one.of_columns(found, n)
                    keep &= got[t][2] >= one.limit
            cols = [*got["good"], 1 - got["clean"][2]]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(c, pa.float64()) for c in cols), pa.array(keep, pa.bool_())], names=[*names, *new])

    fields = [T.StructField(c, f.dataType, f.nullable) for c, f in zip(names, docs.schema.fields, strict=True)]
    schema = T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in new[:-1]), T.StructField(new[-1], T.BooleanType())])
    return inner.mapInArrow(run, schema).toDF(*docs.columns, *new)
