"""Exact deduplication by an extendible-hash index on shared files.

Only DataFrame functions are used. The index maps a 64-bit key of the
normalised text to chains of rows:

1. Entries (row number, id, key, normalised text) are written to the shared folder, and their keys are counted.
2. The directory starts with one bucket. While a bucket has more keys than its capacity it is split
   in two by the next bit of the key, which doubles the directory. This is done on a histogram of
   the keys, so that each text goes to its last bucket at once. The capacity grows with the number of
   keys beyond SLOTS buckets of the least one, so that the directory is bounded.
3. The directory's slot of an entry's key gives its bucket, and the bucket's place in the key space its owner. An owner
   task has a range of keys. It sorts each bucket by key and text: texts of one key are compared byte by byte and form
   the links of the key's chain. Each row of the index has its bucket, link, the link's first row and number of rows.
4. A key with more rows than a bucket's capacity can't be split. Such rows are first aggregated by key and text, in part before
   they are shuffled, and look their link up.

What no slot leads to isn't found: the result's rows are those of the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, partitions, shared_table

#: Bits of the key that a directory may use at most, and buckets that it is made for at most.
MAX_DEPTH, SLOTS = 20, 1 << 16
#: Keys or links that are broadcast at most.
NARROW = 1 << 20


def normalised(text: Column) -> Column:
    """Null as empty, each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, bucket_capacity: int, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Buckets (depth, prefix, n) such that none holds more than `bucket_capacity` rows of `keys`
    (column `_key`), unless `max_depth` bits can't tell them apart. They partition the key space that is used."""
    hist = shared_table(keys.groupBy(_prefix(F.col("_key"), max_depth).alias("p")).agg(F.count("*").alias("n")), "histogram")
    cells = lambda d: hist.groupBy(F.shiftrightunsigned("p", max_depth - d).alias("prefix")).agg(F.sum("n").alias("n")).select(F.lit(d).alias("depth"), "prefix", "n")
    whole = hist.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("prefix"), "n")
    levels, most = [whole], whole.first()["n"]
    while most > bucket_capacity and len(levels) <= max_depth:  # one doubling a turn
        levels.append(cells(len(levels)))
        most = levels[-1].agg(F.max("n")).first()[0]
    done = None
    for d, here in enumerate(levels):
        fits = here if d == len(levels) - 1 else here.where(F.col("n") <= bucket_capacity)
        if d:  # the parent was overfull, else this is a part of a bucket
            parent = levels[d - 1].where(F.col("n") > bucket_capacity).select(F.col("prefix").alias("up"))
            fits = fits.join(F.broadcast(parent), F.shiftrightunsigned(fits["prefix"], 1) == parent["up"], "left_semi")  # at most 2**max_depth
        done = fits if done is None else done.unionByName(fits)
    return done


def _entries(docs: DataFrame, id_col: str, text_col: str, *others: Column) -> DataFrame:
    norm = docs.select(F.col(f"`{id_col}`").alias("_id"), normalised(F.col(f"`{text_col}`")).alias("_norm"), *others)
    return shared_table(norm.select("*", F.xxhash64("_norm").alias("_key"), F.monotonically_increasing_id().alias("_row")), "entries")


def _narrow(df: DataFrame) -> DataFrame:
    """Broadcast a written table if it is small, else leave the join to a shuffle."""
    return F.broadcast(df) if df.count() <= NARROW else df


def build_index(entries: DataFrame, bucket_capacity: int = 4096, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The index of `entries`, a row for each: depth and prefix of its bucket, _key, link (its text's place in the key's
    chain), _row, _id, first (_id and _row of the link's first row), group_size and text_sha256."""
    spark = entries.sparkSession
    keys = shared_table(entries.groupBy("_key").agg(F.count("*").alias("n")), "keys")
    capacity = max(bucket_capacity, -(-keys.count() // SLOTS))
    buckets = shared_table(directory(keys.select("_key"), capacity, max_depth), "directory")
    depth = buckets.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    start = F.expr(f"shiftleft(prefix, {depth} - depth)")
    slots = buckets.select("depth", "prefix", start.alias("start"), F.explode(F.sequence(start, F.expr(f"shiftleft(prefix + 1, {depth} - depth) - 1"))).alias("slot"))
    addressed = entries.join(F.broadcast(slots), _prefix(F.col("_key"), depth) == F.col("slot")).drop("slot")  # at most 2**max_depth slots
    where = ["depth", "prefix", "_key"]
    first = F.struct(F.col("_id").isNull().alias("no_id"), "_id", "_row")

    hot = shared_table(keys.where(F.col("n") > capacity).select("_key"), "hot")
    several = hot.count()
    cold = addressed.join(_narrow(hot), "_key", "left_anti") if several else addressed
    n = partitions(spark)
    owned = cold.withColumn("owner", F.floor(F.col("start") * n / (1 << depth)).cast("int")).repartitionById(n, F.col("owner"))
    chain = Window.partitionBy("owner", *where).orderBy("_norm")
    link = Window.partitionBy("owner", *where, "_norm")
    columns = [*where, "link", "_row", "_id", "first", "group_size", "text_sha256"]
    out = owned.select("*", F.min(first).over(link).alias("first"), F.count("*").over(link).alias("group_size"), F.dense_rank().over(chain).alias("link"))  # one sort
    out = out.withColumn("text_sha256", F.sha2("_norm", 256)).select(*columns)
    if several:
        rows = addressed.join(_narrow(hot), "_key", "left_semi")
        links = rows.groupBy(*where, "_norm").agg(F.min(first).alias("first"), F.count("*").alias("group_size"))
        links = links.withColumn("link", F.dense_rank().over(Window.partitionBy(*where).orderBy("_norm")))  # different texts of one key
        links = shared_table(links.select(*where, "link", "first", "group_size", F.sha2("_norm", 256).alias("text_sha256")), "links")
        looked = rows.select("*", F.sha2("_norm", 256).alias("text_sha256")).drop("_norm").join(_narrow(links), [*where, "text_sha256"])
        out = out.unionByName(looked.select(*columns))
    index = shared_table(out, "index")
    dropped(keys, buckets, hot)
    return index


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 4096) -> DataFrame:
    """A row for each row of `docs`: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are. Null text counts as empty. keep_id is the
    smallest id of the equal texts; ids that are null are larger than all others. Of rows that repeat
    the kept id with an equal text, one is marked kept. No row is dropped; an empty table gives none.
    Columns of `docs` other than the two named are not read, whatever their names.
    """
    entries = _entries(docs, id_col, text_col)
    index = build_index(entries, bucket_capacity)
    dropped(entries)
    return index.select(
        F.col("_id").alias(id_col), F.col("first._id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("_row") == F.col("first._row")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 4096) -> DataFrame:
    """`docs` without the rows whose text equals that of a kept row; columns as before, whatever their names.

    One row of each text stays, also of rows that repeat id and text.
    """
    entries = _entries(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole"))
    index = build_index(entries.drop("_whole"), bucket_capacity)
    gone = shared_table(index.where(F.col("_row") != F.col("first._row")).select("_row"), "gone")
    return entries.join(_narrow(gone), "_row", "left_anti").select("_whole.*")
