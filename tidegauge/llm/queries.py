"""The queries over these operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .decontaminate import decontaminate, positional_index, proximity_matches
from .image_copies import drawn_images, image_copies
from .jaccard_join import jaccard_groups
from .licenses import license_matches
from .line_dedup import apply_keep_bitmaps, line_keep_bitmaps
from .packing import pack
from .quality import fit_quality, grade_documents
from .runtime import stored
from .sharding import byte_shards
from .token_counts import count_tokens
from .warc import fixity, layout, records

#: Vocabulary files come from this package, where it is installed.
WORD_TOKENIZER, PIECE_MODEL = "word_bpe_49k.json", "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
GRADES = 3


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def graded(labels: DataFrame) -> DataFrame:
    """0: poor; 1: good prose that is toxic; 2: good and clean."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.cast("long").alias("grade"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), vocabulary_path(WORD_TOKENIZER), capacity=2048, end_id=0)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(_table(spark, sf_dir, "documents"), vocabulary_path(PIECE_MODEL))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC records, audited against a replica in which the pages of a rule have a damaged byte."""
    pages = _table(spark, sf_dir, "pages")
    damaged = F.when((F.col("page_id") % 101 == 7) & (F.length("html") > 0), F.overlay("html", F.lit("~"), F.lit(1))).otherwise(F.col("html"))
    return fixity(layout(records(pages)), layout(records(pages.withColumn("html", damaged)))).withColumnRenamed("key", "page_id")


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures drawn from all vectors and an edited copy of each, grouped by their local descriptors."""
    found = image_copies(drawn_images(_table(spark, sf_dir, "embeddings")), id_col="image_id")
    return found.select("image_id", F.expr("image_id div 2").alias("vec_id"), (F.col("image_id") % 2 == 1).alias("edited"), "component_id", "n_links")


def op5_byte_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = byte_shards(_table(spark, sf_dir, "documents"), shards=40, overhead=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_matches(docs, threshold=0.9).groupBy("doc_id").agg(F.count("*").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.max("dice").alias("best_dice"))
    out = docs.select("doc_id").join(found, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.round(F.coalesce("best_dice", F.lit(0.0)), 6).alias("best_dice"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    kept = apply_keep_bitmaps(docs, line_keep_bitmaps(docs, min_docs=10, min_chars=1))
    return kept.withColumnRenamed("kept", "kept_sha256")


def quality_grades(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, expected_grade, p_at_least_1, p_at_least_2, keep) for every document."""
    model = fit_quality(docs, graded(labels), levels=GRADES)
    found = grade_documents(docs, model)
    best = F.col("tails")[GRADES - 2]
    return found.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_at_least_1"), best.alias("p_at_least_2"), (best >= 0.5).alias("keep"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_grades(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=10)
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold all words of a benchmark item close together, in any order."""
    index = stored(positional_index(_table(spark, sf_dir, "documents")), "postings")
    return proximity_matches(index, _table(spark, sf_dir, "benchmark"), slack=10).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_best_fit_packing, op2_token_counts, op3_warc_fixity, op4_image_copies, op5_byte_sharding,
        op6_license_scan, op7_ngram_jaccard_join, op8_line_dedup, op9_quality_classifier, op10_benchmark_decontamination,
    )
    return {f.__name__: f for f in (*ops, benchmark_proximity)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_warc_fixity": oracle.WARC_AUDIT,
        "op6_license_scan": oracle.LICENSES,
        "op7_ngram_jaccard_join": oracle.JACCARD,
        "op8_line_dedup": oracle.LINE_DEDUP,
        "op10_benchmark_decontamination": oracle.DECONTAMINATION,
    }
