"""N-gram Jaccard join with a token-group matrix.

A document's tokens are its distinct word shingles. The join finds the connected
components of "Jaccard similarity at least t", and loses no link between
different sets.

1. Documents with equal sets are one node: a copy group moves as one row.
2. Tokens have one order for all: those that are frequent in some task come last, the
   others by hash. Two sets that link share l tokens among the first n - ceil(t n) + l of
   each (prefix filter); l grows with the smaller set. A merged sketch of prefix tokens and sizes drops
   what no other set of a near size shares, and documents that are left with too few tokens.
3. Similar documents are partitioned into groups by the least hash of their tokens. A group is
   opened for its own members first, each against one of them, which takes a step a document however large
   a group of near copies is. There is a partition for each seed; what links is joined into components.
4. The matrix: documents that still share tokens with other components are dealt into bounded groups of similar ones.
   The matrix has a column for each group, the union of its members' tokens, as large as that is. A document is a query of the
   groups of other components with which its own group shares l prefix tokens. The tokens it shares
   with a column bound its overlap with each member; only groups that reach the least overlap are opened.
5. Members of opened groups are compared, by sizes and prefixes and then exactly, and the components are final.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketch
from . import textkernel as tk
from .components import components
from .shared import dropped, shared_table, tune

#: Documents and tokens of a group, about.
GROUP, GROUP_TOKENS = 64, 4096
#: Rows of the table of frequent tokens at most (16 MiB). It sets the order of tokens only.
FREQUENT = 1 << 20
#: Ids that are broadcast at most; beyond, texts are shuffled to them.
IDS = 1 << 20
#: Seeds of the partitions into groups of similar documents.
SEEDS = (11, 12, 13)


def shingles(part: pa.RecordBatch, n: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a chunk's texts, sorted by document and hash; their documents; first of each document."""
    data, off = tk.column(part, "text")
    words = tk.Words(data, off, tk.NOT_SPACE, lower)
    h = words.hashes()
    counts = words.counts()
    at = words.runs(n)
    keys, docs = (tk.windows(h, n)[at], words.doc[at]) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    few = np.flatnonzero((counts > 0) & (counts < n))
    if len(few):  # the whole sequence
        whole = np.zeros(len(few), np.uint64)
        for m in range(1, n):
            i = np.flatnonzero(counts[few] == m)
            if len(i):
                whole[i] = tk.windows(h, m, seed=m)[words.first[few[i]]]
        keys, docs = np.r_[keys, whole], np.r_[docs, few]
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])] if len(keys) else np.zeros(0, bool)
    keys, docs = keys[fresh], docs[fresh]
    return keys, docs, np.searchsorted(docs, np.arange(part.num_rows + 1))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return tk.chunks(batches, "text")


def frequent_tokens(docs: DataFrame, n: int, lower: bool, flush: int = 500_000, share: float = 0.002, least: int = 8) -> DataFrame:
    """(token, n): tokens that at least `least` documents and a `share` of them have, where so many
    tokens are looked at together. There are at most 1 / share times the mean set size of them in one look."""

    def counted(held: list[np.ndarray], n_docs: int) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        many = counts >= max(least, share * n_docs)
        return pa.RecordBatch.from_arrays([pa.array(keys[many].view(np.int64), pa.int64()), pa.array(counts[many], pa.int64())], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n_docs = [], 0, 0
        for part in _slices(batches):
            keys, _, _ = shingles(part, n, lower)
            held.append(keys)
            size += len(keys)
            n_docs += part.num_rows
            if size >= flush:
                yield counted(held, n_docs)
                held, size, n_docs = [], 0, 0
        if size:
            yield counted(held, n_docs)

    return docs.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def depth(n, percent: int):
    """Tokens that two prefixes must share, for the smaller set's size (a number, an array or a Column)."""
    extra = n * (100 - percent) / 200
    return 1 + (F.floor(extra) if isinstance(n, Column) else np.floor(extra).astype(np.int64))


class Order:
    """The order of tokens: frequent ones last, the others by hash; and the prefixes that it gives."""

    def __init__(self, frequent: DataFrame):
        rows = frequent.orderBy(F.col("n").desc(), "token").limit(FREQUENT).select("token", "n").toArrow()
        token = rows["token"].to_numpy().view(np.uint64)
        order = np.argsort(token)
        self.shared = frequent.sparkSession.sparkContext.broadcast((token[order].tobytes(), rows["n"].to_numpy()[order].astype(np.uint32).tobytes()))
        del rows, token, order
        tk.released()

    def prefixes(self, keys: np.ndarray, docs: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of each document's prefix, and their number."""
        known, often = np.frombuffer(self.shared.value[0], np.uint64), np.frombuffer(self.shared.value[1], np.uint32)
        size = np.diff(first)
        weight = np.zeros(len(keys), np.uint32)
        if len(known) and len(keys):
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            weight = np.where(known[at] == keys, often[at], 0).astype(np.uint32)
        order = np.lexsort((keys, weight, docs))
        take = np.minimum(size, size - -(-percent * size // 100) + depth(size, percent))
        place = np.arange(len(keys)) - np.repeat(first[:-1], size)
        return keys[order][place < np.repeat(take, size)], take


def _lists(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32), pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _signature(keys: np.ndarray, first: np.ndarray) -> list[pa.Array]:
    """128 bits of each document's set."""
    out = []
    for seed in (np.uint64(0x517CC1B727220A95), np.uint64(0xA0761D6478BD642F)):
        s = np.r_[np.uint64(0), np.cumsum(tk.mix(keys ^ seed))]
        out.append(pa.array((s[first[1:]] - s[first[:-1]]).view(np.int64), pa.int64()))
    return out


def prefixes(docs: DataFrame, n: int, percent: int, lower: bool, tokens: Order) -> DataFrame:
    """_id, n_shingles, sig_a, sig_b (of the set), prefix array<bigint>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            keys, docs_, first = shingles(part, n, lower)
            prefix, take = tokens.prefixes(keys, docs_, first, percent)
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(np.diff(first), pa.int64()), *_signature(keys, first), _lists(prefix, take)], names=["_id", "n_shingles", "sig_a", "sig_b", "prefix"])

    return docs.mapInArrow(run, "_id bigint, n_shingles bigint, sig_a bigint, sig_b bigint, prefix array<bigint>")


def _narrow(ids: DataFrame) -> DataFrame:
    """A written table of a few numbers a row: broadcast if it is small, else left to a shuffle."""
    return F.broadcast(ids) if ids.count() <= IDS else ids


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc is in the written table `ids`."""
    return docs.join(_narrow(ids), "doc", "left_semi")


def _but(docs: DataFrame, follow: DataFrame) -> DataFrame:
    """Rows of `docs` but for those of a set that follows another id's."""
    return docs.join(_narrow(follow), ["doc", "sig_a", "sig_b"], "left_anti")


def _classes(n: np.ndarray, percent: int) -> np.ndarray:
    """Classes of sizes: sets that link are of one class or of neighbouring ones."""
    return np.floor(np.log(np.maximum(1, n)) / (np.log(100.0 / percent) * 1.001)).astype(np.int64) if percent < 100 else n.astype(np.int64)


def _pair_keys(token: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of tokens with their set's class of size and the one below, and with it and the one above."""
    key = lambda c: tk.mix(token + (c + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F))
    return key(level), key(level + np.uint64(1))


def shared_tokens(own: DataFrame, percent: int, max_bits: int) -> sketch.Repeated:
    """Sketch of the prefix tokens of the sets `own` (n, prefix), by classes of size."""
    total = own.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0))).first()[0]
    bits = sketch.bits_for(2 * total, load=0.5, max_bits=max_bits)

    def keys(part: pa.RecordBatch) -> np.ndarray:
        lists = part.column("prefix")
        level = np.repeat(_classes(part.column("n").to_numpy(zero_copy_only=False), percent), lists.value_lengths().to_numpy(zero_copy_only=False))
        return np.concatenate(_pair_keys(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), level.astype(np.uint64)))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from (b for b in batches if b.num_rows)
        finally:
            tk.released()

    return sketch.Repeated(sketch.build(own, keys, slices, bits), bits)


def open_documents(docs: DataFrame, n: int, percent: int, lower: bool, tokens: Order, repeated: sketch.Repeated) -> DataFrame:
    """doc, n, sig_a, sig_b, keys (the least hash of the set by each seed), prefix, tokens (the set): of the rows of `docs`, those that may share enough prefix tokens with a set of a
    near size, and of their prefix tokens those that such a set may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            keys, docs_, first = shingles(part, n, lower)
            size = np.diff(first)
            prefix, take = tokens.prefixes(keys, docs_, first, percent)
            row = np.repeat(np.arange(part.num_rows), take)
            below, above = _pair_keys(prefix, _classes(size, percent)[row].astype(np.uint64))
            some = repeated.maybe(below) | repeated.maybe(above)
            count = np.bincount(row[some], minlength=part.num_rows)
            stay = (count >= depth(-(-percent * size // 100), percent)) & (size > 0) & part.column("_id").is_valid().to_numpy(zero_copy_only=False)
            ids = part.column("_id").filter(pa.array(stay))
            lists = [_lists(prefix[some & stay[row]], count[stay]), _lists(keys[stay[docs_]], size[stay])]
            sig = [c.filter(pa.array(stay)) for c in _signature(keys, first)]
            some = np.flatnonzero(stay)
            least = [np.minimum.reduceat(tk.mix(keys * np.uint64(2 * s + 1)), first[:-1][size > 0])[np.cumsum(size > 0)[some] - 1] if len(some) else np.zeros(0, np.uint64) for s in SEEDS]
            groups = _lists(np.stack(least, axis=1).ravel(), np.full(len(some), len(SEEDS)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(size[stay], pa.int64()), *sig, groups, *lists], names=["doc", "n", "sig_a", "sig_b", "keys", "prefix", "tokens"])

    return docs.mapInArrow(run, "doc bigint, n bigint, sig_a bigint, sig_b bigint, keys array<bigint>, prefix array<bigint>, tokens array<bigint>")


def _sizes_fit(a: Column, low: Column, high: Column, percent: int) -> Column:
    """A set of size a can link with one of a size from low to high."""
    return (100 * a >= percent * low) & (100 * high >= percent * a)


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("long")


def _linked(a: Column, b: Column, percent: int) -> Column:
    both = _shared(a, b)
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def _exact(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (u, v), those of which the sets link. u should be of few documents: their sets go to the others'."""
    pairs = shared_table(pairs.distinct(), "pairs")
    ends = shared_table(pairs.select(F.col("u").alias("doc")).distinct(), "ends")
    a = _only(sets, ends).select(F.col("doc").alias("u"), F.col("tokens").alias("a"))
    b = sets.select(F.col("doc").alias("v"), F.col("tokens").alias("b")).join(_narrow(pairs), "v")
    both = _shared(F.col("a"), F.col("b"))
    found = b.join(a, "u").where(100 * both >= percent * (F.size("a") + F.size("b") - both))
    found = shared_table(found.select("u", "v").distinct(), "links")
    dropped(pairs, ends)
    return found


def own_group_links(rows: DataFrame, sets: DataFrame, percent: int, turn: int) -> DataFrame:
    """Links (u, v) of the documents `rows` (doc, n, keys, prefix, component) to one member of their group of similar ones, where
    that is of another component. Sets of similarity s are in one group with a chance of s. The member is one whose
    prefix others share most: an original rather than a changed copy."""
    member = rows.select("doc", "n", "prefix", "component", F.col("keys")[turn].alias("key"))
    most = F.max(F.struct((F.size("prefix") * 1000 / F.col("n")).cast("int").alias("s"), F.xxhash64("doc", F.lit(turn)).alias("h"), F.col("doc"), F.col("n"))).alias("c")
    names = member.select("key", "doc", "n", "component", "prefix").groupBy("key").agg(most, F.min("component").alias("c0"), F.max("component").alias("c1"))
    names = shared_table(names.where("c0 <> c1").select("key", F.col("c.doc").alias("doc"), F.col("c.n").alias("n")), "centres")
    centre = member.join(_narrow(names), ["key", "doc", "n"], "left_semi").select("key", F.col("doc").alias("u"), F.col("n").alias("m"), F.col("prefix").alias("p"), F.col("component").alias("c"))
    fits = (F.col("component") != F.col("c")) & _sizes_fit(F.col("n"), F.col("m"), F.col("m"), percent)
    enough = _shared(F.col("prefix"), F.col("p")) >= depth(F.least("n", "m"), percent)
    found = _exact(member.join(centre, "key").where(fits & enough).select("u", F.col("doc").alias("v")), sets, percent)
    dropped(names)
    return found


def still_open(rows: DataFrame, percent: int) -> DataFrame:
    """Of `rows` (doc, n, keys, prefix, component), those that share enough prefix tokens with other components; only such tokens stay."""
    flat = rows.select("doc", "n", "component", F.col("keys")[0].alias("key"), F.explode("prefix").alias("token"))
    between = flat.groupBy("token").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("token")
    kept = flat.join(between, "token").groupBy("doc", "n", "component", "key").agg(F.collect_list("token").alias("prefix"))  # of one document
    return kept.where(F.size("prefix") >= depth(F.ceil(percent * F.col("n") / 100), percent))


def grouped(rows: DataFrame, percent: int, group: int = GROUP) -> DataFrame:
    """`rows` (doc, n, prefix, component, key) with grp: groups of about `group` documents and GROUP_TOKENS tokens. Members of a large
    component are together, others by their key: the least hash of the set."""
    sized = rows.groupBy("component").agg(F.count("*").alias("size"))
    to = F.when(F.col("size") >= group, F.xxhash64(F.lit(0), "component")).otherwise(F.xxhash64(F.lit(1), "key"))
    keyed = rows.join(sized, "component").select("doc", "n", "prefix", "component", to.alias("key"))
    many = keyed.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / group), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("k"))
    return keyed.join(many, "key").select("doc", "n", "prefix", "component", F.xxhash64("key", F.pmod(F.xxhash64("doc"), F.col("k"))).alias("grp"))


def met_groups(groups: DataFrame, percent: int) -> DataFrame:
    """(q_grp, grp, low, high, c1): pairs of groups that share enough prefix tokens and are near in size. A pair of
    components is asked about from the smaller one's side."""
    extent = groups.groupBy("grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    matrix = groups.select("grp", F.explode("prefix").alias("token")).distinct().join(extent, "grp")
    asks = matrix.select("token", *[F.col(c).alias(f"q_{c}") for c in ("grp", "low", "high", "c0")])
    sizes = (100 * F.col("q_high") >= percent * F.col("low")) & (100 * F.col("high") >= percent * F.col("q_low"))
    met = asks.join(matrix, "token").where((F.col("q_c0") < F.col("c1")) & sizes).groupBy("q_grp", "grp", "q_low", "low", "high", "c1").agg(F.count("*").alias("c"))
    return met.where(F.col("c") >= depth(F.least("q_low", "low"), percent)).select("q_grp", "grp", "low", "high", "c1")


def _short(tokens: Column) -> Column:
    """The distinct values of 16 bits of tokens: what they lack of another set's, the set lacks too."""
    return F.array_distinct(F.transform(tokens, lambda x: (x.bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("smallint")))


def _lacks(a: Column, b: Column) -> Column:
    """So many tokens of a, at least, aren't in b."""
    return F.size(F.array_except(a, b)).cast("long")


def matrix(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(grp, column, members): the union of each group's members' tokens, by 16 bits of each, and the members
    (doc, n, component, prefix, short)."""
    ids = shared_table(groups.select("doc").distinct(), "members")
    short = _only(sets, ids).select("doc", "n", _short(F.col("tokens")).alias("short"))
    rows = groups.join(short, ["doc", "n"])
    one = F.struct("doc", "n", "component", "prefix", "short")
    return rows.groupBy("grp").agg(F.array_distinct(F.flatten(F.collect_list("short"))).alias("column"), F.collect_list(one).alias("members"))  # of a bounded group


def opened(met: DataFrame, columns: DataFrame, percent: int) -> DataFrame:
    """(q_grp, grp, queries, members): of pairs of groups that met, the members of the one that open the other: those whose bound of the
    overlap reaches what a link with the group's smallest member that is near in size takes. Closed groups are left out."""
    q = columns.select(F.col("grp").alias("q_grp"), F.col("members").alias("asking"))
    pairs = met.join(q, "q_grp").join(columns, "grp")

    def opens(x: Column) -> Column:
        bound = x["n"] - _lacks(x["short"], F.col("column"))
        least = percent * (x["n"] + F.greatest(F.col("low"), F.ceil(percent * x["n"] / 100)))
        return (x["component"] < F.col("c1")) & _sizes_fit(x["n"], F.col("low"), F.col("high"), percent) & ((100 + percent) * bound >= least)

    return pairs.select("q_grp", "grp", F.filter("asking", opens).alias("queries"), "members").where(F.size("queries") > 0)


def candidates(open_: DataFrame, percent: int) -> DataFrame:
    """(u, v, a, b, s): queries and members of the groups they open that may link, their components, and how likely."""

    def most(q: Column, x: Column) -> Column:
        return F.least(q["n"] - _lacks(q["short"], x["short"]), x["n"] - _lacks(x["short"], q["short"]))

    def may(q: Column, x: Column) -> Column:
        fits = (q["component"] < x["component"]) & _sizes_fit(q["n"], x["n"], x["n"], percent)
        enough = _shared(q["prefix"], x["prefix"]) >= depth(F.least(q["n"], x["n"]), percent)
        return fits & enough & (100 * most(q, x) >= percent * (q["n"] + x["n"] - most(q, x)))

    def pair(q: Column, x: Column) -> Column:
        return F.struct(q["doc"].alias("u"), x["doc"].alias("v"), q["component"].alias("a"), x["component"].alias("b"), most(q, x).alias("s"))

    found = F.flatten(F.transform("queries", lambda q: F.transform(F.filter("members", lambda x: may(q, x)), lambda x: pair(q, x))))
    return open_.select(F.explode(found).alias("x")).select("x.*").distinct()


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    percent: int = 80,
    lower: bool = True,
    group: int = GROUP,
    max_bits: int = sketch.MAX_BITS,
) -> DataFrame:
    """id, n_shingles, component_id of each row.

    Two documents link when 100 * |A & B| >= percent * |A | B| for their sets of n-word shingles; a document of
    fewer words has its whole sequence as one shingle. Null and empty texts have no shingle and link with
    nothing. component_id is the smallest id reachable; a row without an id has the component of the equal
    sets with an id, else null. Rows that repeat an id are one document, with the links of all its texts.
    Other columns of `docs` aren't read.
    """
    tune(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    tokens = Order(frequent_tokens(rows, n, lower))
    table = shared_table(prefixes(rows, n, percent, lower, tokens), "prefixes")
    equal = shared_table(table.where("n_shingles > 0").groupBy("sig_a", "sig_b").agg(F.min("_id").alias("doc")), "sets")
    follow = table.select(F.col("_id").alias("id"), "sig_a", "sig_b").join(equal, ["sig_a", "sig_b"]).where("id <> doc").select(F.col("id").alias("doc"), "sig_a", "sig_b")
    follow = shared_table(follow.distinct(), "copies")  # ids with a set that has a smaller id too
    alone = lambda df: _but(df, follow)
    own = alone(table.where("n_shingles > 0 and _id is not null").select(F.col("_id").alias("doc"), F.col("n_shingles").alias("n"), "prefix", "sig_a", "sig_b"))
    repeated = shared_tokens(own.select("n", "prefix"), percent, max_bits)
    sets = shared_table(alone(open_documents(rows, n, percent, lower, tokens, repeated)).select("doc", "n", "keys", "prefix", "tokens"), "open")
    dropped(follow)
    repeated.drop()
    tokens.shared.destroy()

    # a group's own members, in several partitions
    some = sets.drop("tokens")
    links = own_group_links(some.withColumn("component", F.col("doc")), sets, percent, 0)
    comp = shared_table(components(links), "components")
    for turn in range(1, len(SEEDS)):
        links = links.unionByName(own_group_links(_labelled(some, comp), sets, percent, turn))
        last, comp = comp, shared_table(components(links), "components")
        dropped(last)

    # the matrix of what is open
    groups = shared_table(grouped(still_open(_labelled(some, comp), percent), percent, group), "groups")
    met = shared_table(met_groups(groups, percent), "met")
    columns = shared_table(matrix(groups, sets), "matrix")
    pairs = shared_table(candidates(opened(met, columns, percent), percent), "candidates")
    # one pair of each two components first: where it links, the others needn't be compared
    best = pairs.groupBy("a", "b").agg(F.max(F.struct("s", "u", "v")).alias("x")).select("x.u", "x.v")
    found = _exact(best, sets, percent)
    now = shared_table(components(found.select("u", "v").join(pairs, ["u", "v"]).select(F.col("a").alias("u"), F.col("b").alias("v"))), "joined")
    end = lambda c: now.select(F.col("node").alias(c), F.col("component").alias(f"{c}_now"))
    rest = pairs.join(end("a"), "a", "left").join(end("b"), "b", "left").where("coalesce(a_now, a) <> coalesce(b_now, b)")
    found = found.unionByName(_exact(rest.join(best, ["u", "v"], "left_anti").select("u", "v"), sets, percent))
    comp = shared_table(components(links.unionByName(found).unionByName(_same_id(table, equal))), "components")
    dropped(pairs, now)
    dropped(sets, groups, met, columns)

    # copies of a set follow their node
    named = equal.join(comp.withColumnRenamed("node", "doc"), "doc", "left").select("sig_a", "sig_b", F.coalesce("component", "doc").alias("component"))
    out = table.select("_id", "n_shingles", "sig_a", "sig_b").join(named, ["sig_a", "sig_b"], "left")
    alone = F.col("n_shingles") == 0
    return out.select(F.col("_id").alias(id_col), "n_shingles", F.when(alone, F.col("_id")).otherwise(F.col("component")).alias("component_id"))


def _same_id(table: DataFrame, equal: DataFrame) -> DataFrame:
    """(u, v): an id that repeats with other sets, and the nodes of these sets."""
    sigs = [f(s) for s in ("sig_a", "sig_b") for f in (F.min, F.max)]
    ids = table.where("n_shingles > 0 and _id is not null").groupBy("_id").agg(*[c.alias(f"s{i}") for i, c in enumerate(sigs)]).where("s0 <> s1 or s2 <> s3").select("_id")
    return table.select("_id", "sig_a", "sig_b").join(ids, "_id").join(equal, ["sig_a", "sig_b"]).select(F.col("_id").alias("u"), F.col("doc").alias("v"))


def _labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """`rows` with the component of each doc: itself where it has no link."""
    return rows.join(comp.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one document of each component; columns as before. Documents without a shingle stay.

    The one that stays is of the component's smallest id; of rows that repeat it, all stay. Rows without an id stay.
    """
    found = jaccard_components(docs, id_col, text_col, **options)
    gone = shared_table(found.where(F.col(id_col) != F.col("component_id")).select(F.struct(F.col(id_col).cast("long").alias("x")).alias("id")).distinct(), "gone")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col(f"`{id_col}`").cast("long").alias("x")).alias("id"))
    few = gone.count() <= IDS
    return whole.join(F.broadcast(gone) if few else gone, "id", "left_anti").select("row.*")
