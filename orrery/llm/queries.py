"""Queries of the operators in this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontaminate, exact_dedup, language_id, license_scan, ngram_join, quality, ranked_search, substring_dedup, suffix_dedup, token_histogram, trie_bpe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def tokenised(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes; the ids are decoded again."""
    path, pattern = _vocabulary()
    coded = bpe.round_trip(docs, path, pattern, text_col)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return coded.select(
        *rest,
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("token_ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and bytes of every whole text. Null and empty texts have no ids; rows that repeat are encoded each by itself; an empty table gives none."""
    return tokenised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of similar documents (four words, 0.85). Null and empty texts link with nothing; rows that repeat an id are one document."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and chains of licence texts in every whole text. Null and empty texts have no words; ties go to the chain that is first in the file."""
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    start, base = F.col("phrase_places.start"), F.array_sort(F.array_distinct("phrase_places.label"))
    chained = F.filter("notice_spans", lambda x: x["cover"] >= license_scan.MIN_COVER)["label"]
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrase_places").cast("long").alias("n_base"),
        F.array_min(start).alias("first_word"),
        F.array_max(start).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, chained)), ",").alias("labels"),
        F.when(F.size("phrase_places") > 0, 1.0).otherwise(F.coalesce(F.array_max("notice_spans.cover"), F.lit(0.0))).alias("score"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text by a model of the rows that are not held out. Null and empty texts are und; a null id is never held out."""
    docs = table(spark, sf_dir, "documents")
    crc = F.crc32(F.col("doc_id").cast("string"))
    held_out = F.coalesce(crc % 4 == 2, F.lit(False))
    model = language_id.train(docs.where(~held_out), "lang", "text", F.xxhash64("doc_id"))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histogram of encoded lengths and its suffix sums. Null and empty texts have length 0; an empty table gives no row."""
    path, pattern = _vocabulary()
    counted = bpe.count(table(spark, sf_dir, "documents").select("text"), path, pattern)
    return token_histogram.suffix_sums(token_histogram.histogram(counted.select("n_tokens")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes left of every whole text. Null counts as empty; rows without an id lose nothing; rows that repeat an id are one document."""
    cut = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), length=50)
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every whole text. Null has no words; rows without an id lose nothing; rows that repeat id and text are treated alike."""
    cut = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), window=20)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every row. Null counts as empty; null ids are the largest; of rows that repeat an id one is kept."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every whole text. Null has no words; null items count for nothing; rows that repeat have their own text's hits."""
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def acceptable(labels: DataFrame) -> DataFrame:
    """A document is good where it is labelled as of quality and not as toxic; null where quality is."""
    return labels.select("doc_id", F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when(F.col("quality").isNotNull(), 0).alias("good"))


def judged(labels: DataFrame) -> DataFrame:
    """Labels of both targets of the quality classifier: good (of quality) and toxic."""
    return labels.select("doc_id", F.col("quality").alias("good"), "toxic")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and decision on every whole text. Null counts as empty; rows that repeat are scored alike; without labels all are kept."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, judged(table(spark, sf_dir, "labels")))
    return quality.classify(docs, model).drop("text", "lang", "source", "n_chars")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of the highest scores for each benchmark item, over all whole texts. Null texts have no terms; rows that repeat an id are documents by themselves; equal scores are by id."""
    return ranked_search.search(ranked_search.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), k=50)


def op12_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and text of every whole text. Null and empty texts have no ids; rows that repeat are encoded each by itself; an empty table gives none."""
    import public_tokenizers

    coded = trie_bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    n = (F.octet_length("packed_ids") / 4).cast("long")
    return coded.select("doc_id", n.alias("n_tokens"), F.sha2("packed_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers in every whole text, with corpus-wide counts. Null and empty texts have no tokens; rows that repeat are aligned each by itself."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned, counts = alignment.tables(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    found = alignment.weigh(aligned, counts)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op3_license_scan": op3_license_scan,
        "op4_language_id": op4_language_id,
        "op5_token_counts": op5_token_counts,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_decontaminate": op9_decontaminate,
        "op10_quality": op10_quality,
        "op11_ranked_search": op11_ranked_search,
        "op12_trie_bpe": op12_trie_bpe,
        "op13_alignment": op13_alignment,
    }
