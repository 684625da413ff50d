"""The corpus pipeline: filters of a training corpus, then its token ids.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written and
read again as the next stage's `docs`. All but the last return the columns of
`documents`, and keep other columns whatever their names.

Null texts count as empty: the classifier scores them by their metadata, exact dedup keeps
one of them, they are near nothing and hold no benchmark item, and have no token. Rows that repeat id and
text are one after exact dedup; rows that repeat an id with other texts are one
document to the n-gram join. Rows without an id are never near copies. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orrery.llm import decontaminate as contamination
from orrery.llm import exact_dedup, ngram_join, quality, queries
from orrery.llm.shared import dropped, shared_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier rejects."""
    model = quality.train(docs, queries.judged(queries.table(spark, sf_dir, "labels")))
    return quality.classify(docs, model).where("quality_keep").select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one of the smallest id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar texts (five words, 0.8), the one of the smallest id stays."""
    return ngram_join.drop_near_copies(docs, n=5, percent=80)


def benchmark_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a window of a benchmark item."""
    found = contamination.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))
    return found.where("size(hit_items) = 0").select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each whole text, checked by decoding: counts and digests in place of the text."""
    return queries.tokenised(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", exact_copies),
    ("n-gram jaccard join", near_copies),
    ("benchmark decontamination", benchmark_texts),
    ("byte-level bpe", token_ids),
]

#: The quality classifier and the BPE have no SQL; tests/llm/test_corpus_queries.py holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = shared_table(stage(spark, docs, sf_dir), f"stage{i}")
        if last is not None:
            dropped(last)
        last = docs
    return docs
