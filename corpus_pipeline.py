"""The corpus pipeline: quality, repeated lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; all but the last return the
columns of ``documents``. ``run`` writes each stage's result to the shared folder and reads it for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.decontaminate import without_leaks
from tidegauge.llm.jaccard_join import one_of_each_group
from tidegauge.llm.line_dedup import drop_lines, line_keep_bitmaps
from tidegauge.llm.packing import pack
from tidegauge.llm.quality import fit_quality, select_documents
from tidegauge.llm.queries import GRADES, WORD_TOKENIZER, graded, vocabulary_path
from tidegauge.llm.runtime import stored

#: Tokenizers, hashing and a fitted model: no SQL gives these rows; the stages are tested against plain Python.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is below one half go: junk, toxic prose, blank texts.

    Null, empty and blank texts go; rows are judged by their text alone, so null ids and repeated rows are judged like
    others. Without rated documents nothing is known against a text with words, and it stays. Other columns pass.
    """
    model = fit_quality(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")), levels=GRADES)
    return select_documents(docs, model, tail=GRADES - 1)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents go everywhere; ``n_chars`` follows the text. No document goes.

    Null texts stay null. A document is an id with a text: repeated rows count once, rows without an id
    count by their text. An empty table gives no rows; columns of any other name pass unchanged.
    """
    kept = drop_lines(docs, line_keep_bitmaps(docs, min_docs=10, min_chars=1))
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least id stays; see ``one_of_each_group``.

    Rows of one id with unlike texts are different documents; texts without words stay. An empty table gives no rows.
    """
    return one_of_each_group(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a word inside any benchmark window go. Rows are judged by their text alone; null texts stay."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, and their places in sequences of 2048 tokens.

    Null texts are empty documents of one end mark; null ids and repeated rows are packed like others.
    """
    return pack(docs, vocabulary_path(WORD_TOKENIZER), capacity=2048, end_id=0)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
