"""Readers of the base tables and of seed lists, and the writer of table versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import totals_by_source
from ..operators.joins import merge_writer
from .shared import delete

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def load_tables(spark: SparkSession, path: str, names: list[str] | None = None, columns: dict[str, list[str]] | None = None, where: dict[str, Column | str] | None = None) -> dict[str, DataFrame]:
    """The named tables under a folder, each with the columns and the filter asked for.

    Both reach the Parquet scan: other columns are not read, and row groups that can't hold a match are skipped. A table
    that is asked for and isn't there is an error.
    """
    out = {}
    for name in TABLES if names is None else names:
        rows = spark.read.parquet(f"{path}/{name}.parquet")
        rows = rows.where(where[name]) if where and name in where else rows
        out[name] = rows.select(*columns[name]) if columns and name in columns else rows
    return out


def enriched_postings(jobs: DataFrame, descriptions: DataFrame) -> DataFrame:
    """All columns of postings with their description (job_id, description); null where there is none.

    The wide texts are joined last, on the id alone. Several descriptions of a posting give several rows.
    """
    text = descriptions.where("job_id IS NOT NULL").select(F.col("job_id").alias("_job"), "description")
    return jobs.drop("description").join(text, F.col("id") == F.col("_job"), "left").drop("_job")


def seeds_from_json(texts: DataFrame, col: str = "value") -> DataFrame:
    """(ats, slug, careers_url, probe_url) of texts that each hold a JSON list of seeds; what is no list gives none."""
    parsed = F.from_json(F.col(col), "ARRAY<STRUCT<ats: STRING, slug: STRING, careers_url: STRING, probe_url: STRING>>")
    return texts.select(F.explode(parsed).alias("s")).select("s.*").where("ats IS NOT NULL AND slug IS NOT NULL")


def seeds_from_sql(texts: DataFrame, col: str = "value") -> DataFrame:
    """The same from texts of SQL, out of each tuple of four quoted values."""
    one = r"\(\s*'([^']+)'\s*,\s*'([^']+)'\s*,\s*'([^']+)'\s*,\s*'([^']+)'\s*\)"
    parts = [F.regexp_extract_all(F.col(col), F.lit(one), F.lit(i)).alias(c) for i, c in enumerate(("ats", "slug", "careers_url", "probe_url"), 1)]
    return texts.select(F.explode(F.arrays_zip(*parts)).alias("s")).select("s.*")


def write_version(df: DataFrame, path: str, keep: int = 2) -> int:
    """Writes a table as its next version under path, and deletes all but the newest ``keep``; readers see whole versions.

    A version is a folder, complete once it has its success mark; a writer that dies leaves none.
    """
    spark = df.sparkSession
    versions = _versions(spark, path)
    number = max(versions, default=0) + 1
    df.write.mode("overwrite").parquet(f"{path}/version={number}")
    for old in sorted([*versions, number])[:-keep]:
        delete(spark, f"{path}/version={old}")
    return number


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A table's version, the newest if none is named."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no version of a table under {path}")
    return spark.read.parquet(f"{path}/version={max(versions) if number is None else number}")


def merge_version(path: str, batch: DataFrame, keys: list[str], update_cols: list[str]) -> int:
    """Inserts or updates a batch by key into the newest version of a table, as its next version.

    Where there is none yet, the batch is the first. Rows that repeat a key in the batch would repeat in the table.
    """
    spark = batch.sparkSession
    known = _versions(spark, path)
    return write_version(merge_writer(read_version(spark, path, max(known)), batch, keys, update_cols) if known else batch, path)


def snapshot_totals(companies: DataFrame, jobs: DataFrame, path: str, as_of: str) -> DataFrame:
    """Writes the totals of each source (with those new in 1, 7 and 30 days) as the next version, and reads it back.

    Readers of the newest version see the old totals until the new ones are whole.
    """
    write_version(totals_by_source(companies, jobs, as_of), path)
    return read_version(companies.sparkSession, path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(root) if fs.exists(hadoop.Path(f.getPath(), "_SUCCESS"))]
    return [int(n.split("=")[1]) for n in names if n.startswith("version=")]
