"""Training-data pipeline over the table `documents`: each stage works on all that the stage before it kept.

run() writes what a stage returns as Parquet in the shared folder and reads it again for the next one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepanel.llm import ngram_join, quality_pu, sentencepiece_sa, substring_dedup, token_store, wu_manber
from tidepanel.llm.store import cut, free_name

#: Near copies in the pipeline: five-word shingles, Jaccard similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = quality_pu.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_pu.score_quality(docs, model).where("predicted = 1").select(docs.columns)


#: Rows of a file at most.
FILE_ROWS = 1 << 40


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """docs with a number for each row, the same in every job however the tables are split: place of the file among all
    files by path, and of the row in its file. Tables that do not come from files are written first.

    The broadcast has one row for each file, of which the driver holds the list anyway.
    """
    path, index = free_name(docs, "file_path"), free_name(docs, "row_index")
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(index))
    except AnalysisException:
        return cut(docs.withColumn(row, F.monotonically_increasing_id()))
    files = rows.select(F.col(path).alias("file")).distinct().withColumn("n", F.row_number().over(Window.orderBy("file")).cast("long") - 1)
    met = rows.join(F.broadcast(files), F.col(path) == F.col("file"))
    return met.select(*docs.columns, (F.col("n") * FILE_ROWS + F.col(index)).alias(row))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest doc_id (nulls last), one row of repeated ones.

    The join works on row numbers, so that another text under the same doc_id stays.
    """
    row = free_name(docs, "row")
    rows = numbered(docs, row)
    groups = ngram_join.jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"), PERCENT, SHINGLE)
    groups = groups.select((F.col("doc_id") + 0).alias("member"), "component_id").join(rows.select("doc_id", row), F.col("member") == F.col(row))
    groups = cut(groups.select("component_id", "member", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "member").alias("place")))
    first = groups.groupBy("component_id").agg(F.min("place").alias("first")).select(F.col("first.member").alias("stays"))
    gone = groups.join(first, F.col("member") == F.col("stays"), "left_anti").select("member")
    return rows.join(gone, F.col(row) == F.col("member"), "left_anti").drop(row)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the words of passages that occurred earlier; n_chars follows the text."""
    cleaned = substring_dedup.dedup_passages(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = wu_manber.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("not contaminated").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_ids, ids and whether decoding gives the text back."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    back = sentencepiece_sa.sentencepiece_encode(docs, model, decoded="decoded")
    return back.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_passages", benchmark_passages), ("encoded", encoded)]

#: No SQL can state the classifier, so the whole is tested against a brute-force version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = token_store.store_path(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            schema = docs.schema
            docs.write.parquet(f"{base}/{k}-{name}")
            docs = spark.read.schema(schema).parquet(f"{base}/{k}-{name}")
    return docs
