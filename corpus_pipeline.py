"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark items, token ids.

Every stage is written as Parquet in the shared folder and read again by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hirelake.llm import bpe, decontaminate, jaccard, quality, suffix
from hirelake.llm.tables import newest, scratch, written
from hirelake.sources.shared import delete


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score under 0.3."""
    return quality.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group linked by five-word shingles at a Jaccard of 0.8 or more.

    Rows without a doc_id stay; rows that repeat one all stay or go together.
    """
    groups = jaccard.link_similar(docs, size=5, percent=80)
    gone = groups.where("doc_id != component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of 100 bytes and more that also start earlier; a document of which nothing is left goes."""
    return suffix.strip_repeated_bytes(docs, length=100).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold 0.8 or more of the five-word shingles of a benchmark item."""
    found = decontaminate.find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=5, percent=80)
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def byte_pair_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether the ids decode to the text."""
    import public_tokenizers

    out = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_pair_encoding),
]
#: SQL can't express the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Of the tables written on the way only the last stage's input is left."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            keep.append(newest())
        if last:
            delete(spark, last)
        last = keep[0]
    return STAGES[-1][1](spark, docs, sf_dir)
