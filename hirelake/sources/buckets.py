"""Tables in buckets by key: a merge rewrites only the buckets that it touches, a log of changes rewrites none.

A version is a manifest, path/_versions/N: a JSON text that names for each bucket the folders which hold its rows, the
oldest first. Data folders are never changed once written, and a manifest appears whole by a rename that fails where
another writer took the number, so a reader sees one version or the next, and a writer that dies leaves folders that no
manifest names. A row of a later folder stands for the row of its key in an earlier one; rows know their folder's number.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import delete, empty

BUCKET, SEQ = "_bucket", "_seq"


class Conflict(RuntimeError):
    """Another writer made the version that this one was about to make."""


class BucketTable:
    """A table of one row a key, dealt into buckets by a hash of some of its key columns.

    ``buckets`` bounds both a version's manifest (a short text a bucket) and what a merge of few keys rewrites (the table's
    size by the number of buckets); choose it so that a bucket is some hundred MB. A hot value of ``bucket_by`` makes one
    bucket large, which is then written as several files. Null keys are values like any other.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType | str, buckets: int = 64, bucket_by: list[str] | None = None):
        self.spark, self.path, self.keys, self.bucket_by, self.buckets = spark, path.rstrip("/"), keys, bucket_by or keys, buckets
        self.schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)

    # --- versions

    def _fs(self, name: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root, fs = self._fs("_versions")
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(root) if f.getPath().getName().isdigit()) if fs.exists(root) else []

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the newest, if none is named) consists of; that of a table without versions is empty."""
        known = self.versions()
        if not known:
            return {"version": 0, "parts": {}, "note": {}}
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{known[-1] if version is None else version}", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> dict:
        target, fs = self._fs(f"_versions/{manifest['version']}")
        draft, _ = self._fs(f"_versions/.{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        options = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)  # none: an existing target is an error
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), sc._jsc.hadoopConfiguration()).rename(draft, target, options)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(f"version {manifest['version']} of {self.path} is another writer's") from e
            raise
        return manifest

    # --- rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast(self.schema[c].dataType) for c in self.bucket_by]), F.lit(self.buckets)).cast("int")

    def touched(self, batch: DataFrame) -> list[int]:
        """The buckets of a batch's keys, of which there are ``buckets`` at most."""
        return sorted(r[0] for r in batch.select(self.bucket().alias(BUCKET)).distinct().collect())

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets; buckets with a log of changes are put together by key."""
        parts = {b: dirs for b, dirs in self.manifest(version)["parts"].items() if only is None or int(b) in only}
        plain = [f"{d}/{BUCKET}={b}" for b, dirs in parts.items() if len(dirs) == 1 for d in dirs]
        logged = [f"{d}/{BUCKET}={b}" for b, dirs in parts.items() if len(dirs) > 1 for d in dirs]
        rows = [self._files(plain).select(*self.schema.names)] if plain else []
        if logged:
            rows.append(self._newest(self._files(logged)))
        return reduce(DataFrame.unionByName, rows) if rows else empty(self.spark, self.schema)

    def _newest(self, log: DataFrame) -> DataFrame:
        """The newest row of each key.

        A folder holds a key once, so that a task has next to nothing to put together before the shuffle: rows are dealt by
        key first and sorted once. Keys stay the columns that they were grouped by, so a join on them deals no rows again.
        """
        rest = [c for c in self.schema.names if c not in self.keys]
        if not rest:
            return log.select(*self.schema.names).distinct()
        newest = log.repartition(*self.keys).groupBy(*self.keys).agg(F.max_by(F.struct(*rest), SEQ).alias("_row"))
        return newest.select(*[F.col("_row")[c].alias(c) if c in rest else c for c in self.schema.names])

    def _files(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(SEQ, T.LongType())])).parquet(*[f"{self.path}/data/{n}" for n in names])

    def _write(self, rows: DataFrame, version: int) -> tuple[str, list[int]]:
        """Writes rows as a new folder; a bucket is one file, or several if it is large. Returns the folder and its buckets."""
        name = f"{version}-{uuid.uuid4().hex[:12]}"
        dealt = rows.select(*self.schema.names, F.lit(version).cast("long").alias(SEQ), self.bucket().alias(BUCKET))
        self.spark.sql(f"SELECT /*+ REBALANCE({BUCKET}) */ * FROM {{rows}}", rows=dealt).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        root, fs = self._fs(f"data/{name}")
        return name, sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(root) if f.getPath().getName().startswith(f"{BUCKET}="))

    # --- changes

    def merge(self, batch: DataFrame, update_cols: list[str] | None = None, note: dict | None = None) -> dict:
        """Inserts or updates a batch (one row a key) by rewriting the buckets of its keys; returns the new manifest.

        Columns that are not updated stay, and are null in new rows. An empty batch makes no version.
        """
        before = self.manifest()
        touched = self.touched(batch)
        if not touched:
            return before
        fields = update_cols if update_cols is not None else [c for c in self.schema.names if c not in self.keys]
        kind = {c: self.schema[c].dataType for c in self.schema.names}
        old = self.read(before["version"] or None, touched).select(*self.keys, F.struct(*self.schema.names).alias("_old"))
        new = batch.select(*[F.col(c).cast(kind[c]).alias(c) for c in self.keys], F.struct(F.lit(True).alias("_in"), *[F.col(c).cast(kind[c]).alias(c) for c in fields]).alias("_new"))
        both = old.unionByName(new, allowMissingColumns=True).repartition(*self.keys).groupBy(*self.keys).agg(F.any_value("_old", True).alias("_old"), F.any_value("_new", True).alias("_new"))
        value = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col("_old")[c]) if c in fields else F.col("_old")[c]
        merged = both.select(*[F.col(c) if c in self.keys else value(c).alias(c) for c in self.schema.names])
        return self._put(before, merged, touched, note, replace=True)

    def append(self, changes: DataFrame, note: dict | None = None) -> dict:
        """Adds whole rows (one a key) as the newest of their keys, rewriting nothing; returns the new manifest."""
        return self._put(self.manifest(), changes, None, note, replace=False)

    def compact(self, most: int, note: dict | None = None) -> dict:
        """Rewrites the buckets that consist of more than some folders as one folder each."""
        before = self.manifest()
        long = [int(b) for b, dirs in before["parts"].items() if len(dirs) > most]
        return self._put(before, self.read(before["version"], long), long, note, replace=True) if long else before

    def _put(self, before: dict, rows: DataFrame, touched: list[int] | None, note: dict | None, replace: bool) -> dict:
        version = before["version"] + 1
        name, found = self._write(rows, version)
        parts = dict(before["parts"])
        for b in map(str, found):
            parts[b] = [name] if replace else [*parts.get(b, []), name]
        for b in map(str, touched or []):
            if replace and int(b) not in found:
                parts.pop(b, None)
        return self._commit({"version": version, "parts": parts, "note": {**before["note"], **(note or {})}})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes manifests but the newest few, and the data folders that none of these names. No writer may be at work."""
        known = self.versions()
        used = {d for v in known[-keep:] for dirs in self.manifest(v)["parts"].values() for d in dirs}
        for v in known[:-keep]:
            delete(self.spark, f"{self.path}/_versions/{v}")
        root, fs = self._fs("data")
        unused = [n for n in (f.getPath().getName() for f in fs.listStatus(root)) if n not in used] if fs.exists(root) else []
        for n in unused:
            delete(self.spark, f"{self.path}/data/{n}")
        return unused
