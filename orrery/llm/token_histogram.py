"""Exact length histogram: totals, quantiles and truncated totals for every context limit.

Documents are aggregated by encoded length, which leaves one row for each
length that occurs. Suffix sums over the lengths (documents and tokens of all
lengths above) then answer, for a limit c: the total of min(length, c), the
documents that fit, those cut, and the quantile that c is.

The sums go by blocks of lengths: within a block by a window, across blocks by
the blocks' totals. No task holds all lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_table

BLOCK = 1024


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """A row for each length: its number of documents. Null lengths count as 0."""
    n = F.coalesce(F.col(length_col), F.lit(0)).cast("long")
    return lengths.groupBy(n.alias("context_limit")).agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """For each length of a histogram as context limit: n_docs of that length, docs_above and
    tokens_above (of longer documents), docs_total, tokens_total, truncated_total (the tokens that
    remain when each document is cut to the limit), docs_fit and quantile (share of documents that fit)."""
    hist = shared_table(hist, "histogram")
    h = hist.withColumn("_b", F.floor(F.col("context_limit") / F.lit(block)).cast("long"))
    tokens: Column = F.col("n_docs") * F.col("context_limit")
    inner = Window.partitionBy("_b").orderBy(F.col("context_limit").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = h.select("*", F.coalesce(F.sum("n_docs").over(inner), F.lit(0)).alias("_d"), F.coalesce(F.sum(tokens).over(inner), F.lit(0)).alias("_t"))
    # one row for each `block` lengths: as many as the longest document's tokens over `block`
    blocks = h.groupBy("_b").agg(F.sum("n_docs").alias("bd"), F.sum(tokens).alias("bt"))
    above = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        "_b",
        F.coalesce(F.sum("bd").over(above), F.lit(0)).alias("bd"),
        F.coalesce(F.sum("bt").over(above), F.lit(0)).alias("bt"),
        F.sum("bd").over(every).alias("docs_total"),
        F.sum("bt").over(every).alias("tokens_total"),
    )
    out = rows.join(blocks, "_b")
    docs_above, tokens_above = F.col("_d") + F.col("bd"), F.col("_t") + F.col("bt")
    return out.select(
        "context_limit",
        "n_docs",
        docs_above.alias("docs_above"),
        tokens_above.alias("tokens_above"),
        (F.col("docs_total") - docs_above).alias("docs_fit"),
        ((F.col("docs_total") - docs_above) / F.col("docs_total")).alias("quantile"),
        (F.col("tokens_total") - tokens_above + docs_above * F.col("context_limit")).alias("truncated_total"),
        "docs_total",
        "tokens_total",
    )


def truncated_total(sums: DataFrame, limit: int) -> DataFrame:
    """Answer for any limit, a length that occurs or not: tokens left when documents are cut to `limit`,
    and the documents that fit. One row; zeros where there is no document."""
    n, at = F.col("n_docs"), F.col("context_limit")
    return sums.agg(
        F.coalesce(F.sum(n * F.least(at, F.lit(limit))), F.lit(0)).alias("truncated_total"),
        F.coalesce(F.sum(F.when(at <= limit, n)), F.lit(0)).alias("docs_fit"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The least length that at least a share q of the documents don't exceed; null without documents."""
    return sums.where(F.col("docs_fit") >= F.lit(q) * F.col("docs_total")).agg(F.min("context_limit").alias("length"))
