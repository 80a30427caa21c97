"""Keyed upserts and per-repository isolation of graph tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def latest(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last write per key; an aggregate, so versions of a hot key combine before the shuffle. Of writes with equal order
    the greatest row counts, whatever order they come in."""
    others = [order, *[c for c in rows.columns if c not in (*keys, order)]]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*rows.columns)


def upsert(table: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    return latest(table.unionByName(new), keys, order)


def write(table: DataFrame, path: str, partition: str = "repo_id") -> None:
    """Overwrite only the partitions present in ``table``."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def upsert_batches(path: str, keys: Sequence[str], order: str, partition: str = "repo_id"):
    """``foreachBatch`` function that merges every micro-batch into ``path``."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark: SparkSession = batch.sparkSession
        staged = f"{path}.staged/{batch_id}"
        batch.limit(0).write.mode("ignore").partitionBy(partition).parquet(path)  # an empty table before the first batch
        old = spark.read.schema(batch.schema).parquet(path)
        old = old.join(batch.select(partition).distinct(), partition, "left_semi")
        rows = upsert(old, batch, keys, order)
        # read and overwrite of one path must not meet in one plan
        rows.write.mode("overwrite").parquet(staged)
        write(spark.read.schema(rows.schema).parquet(staged), path, partition)

    return merge


class VersionedTable:
    """A keyed table whose rows lie in buckets of the keys' hash, each written anew only when a batch touches it.

    ``data/batch=n/bucket=b`` holds a bucket as batch n left it; the manifest of a batch names the batch of every bucket.
    Readers take the newest manifest, a single file that appears at once, so they never see half a batch. Rows of a
    replaced bucket stay on disk until :meth:`old_folders` are removed.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], order: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.order, self.buckets = spark, path, schema, list(keys), order, buckets
        self._stored = T.StructType([*schema.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())])
        spark.createDataFrame([], "bucket int, batch long").write.mode("ignore").parquet(f"{path}/manifest/version=-1")

    def _manifest(self, before: int | None = None) -> DataFrame:
        shape = "bucket int, batch long, version long"
        every = self.spark.read.schema(shape).option("basePath", f"{self.path}/manifest").parquet(f"{self.path}/manifest/version=*")
        every = every if before is None else every.where(F.col("version") < before)
        newest = every.agg(F.max("version")).first()[0]
        return every.where(F.col("version") == F.lit(newest)).select("bucket", "batch")

    def _rows(self, places: DataFrame) -> DataFrame:
        """Rows of the given (bucket, batch) places; the folder names prune the scan."""
        found = [(r.batch, r.bucket) for r in places.collect()]  # at most one row per bucket
        if not found:
            return self.spark.createDataFrame([], self._stored)
        folders = [f"{self.path}/data/batch={batch}/bucket={bucket}" for batch, bucket in found]
        return self.spark.read.schema(self._stored).option("basePath", f"{self.path}/data").parquet(*folders)

    def read(self) -> DataFrame:
        return self._rows(self._manifest()).select(*self.schema.names)

    def places(self) -> DataFrame:
        """(bucket, batch): the batch that wrote each bucket last."""
        return self._manifest()

    def old_folders(self) -> list[str]:
        """Folders of buckets that the newest manifest does not name; remove them when no reader of an older one is left."""
        kept = {(r.batch, r.bucket) for r in self._manifest().collect()}
        shape = "batch long, bucket int"
        every = self.spark.read.schema(self._stored).parquet(f"{self.path}/data").select("batch", "bucket").distinct() if kept else self.spark.createDataFrame([], shape)
        return sorted(f"{self.path}/data/batch={r.batch}/bucket={r.bucket}" for r in every.collect() if (r.batch, r.bucket) not in kept)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Upserts a batch. A batch that is merged again after a failure starts from the manifest before it and replaces its own files."""
        home, self.spark = self.spark, batch.sparkSession  # a stream's batches have a session of their own
        try:
            bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
            new = batch.select(*self.schema.names).withColumn("bucket", bucket)
            touched = new.select("bucket").distinct()
            before = self._manifest(number)
            old = self._rows(before.join(touched, "bucket", "left_semi")).select(*self.schema.names, "bucket")
            rows = latest(old.unionByName(new), ["bucket", *self.keys], self.order)
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={number}")
            after = before.join(touched, "bucket", "left_anti").unionByName(touched.withColumn("batch", F.lit(number).cast("long")))
            after.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={number}")  # at most one row per bucket
        finally:
            self.spark = home


def repositories(table: DataFrame) -> DataFrame:
    return table.select("repo_id").distinct()


def without_repository(table: DataFrame, repo_id: str) -> DataFrame:
    return table.filter(F.col("repo_id") != repo_id)


def lookup(nodes: DataFrame, by: str, value) -> DataFrame:
    """Rows of a node table (functions, classes, modules) by id, name, module or file, in file and line order."""
    order = [c for c in ("file_path", "start_line") if c in nodes.columns]
    found = nodes.filter(F.col(by) == value)
    return found.orderBy(*order) if order else found


def modules_of(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(module, files, functions, classes) of functions and classes (module, file_path): the module table of a repository."""
    rows = functions.select("module", "file_path", F.lit(1).alias("f"), F.lit(0).alias("c")).unionByName(classes.select("module", "file_path", F.lit(0).alias("f"), F.lit(1).alias("c")))
    per_file = rows.groupBy("module", "file_path").agg(F.sum("f").alias("f"), F.sum("c").alias("c"))
    return per_file.groupBy("module").agg(F.count("*").alias("files"), F.sum("f").alias("functions"), F.sum("c").alias("classes"))


def language_stats(files: DataFrame) -> DataFrame:
    """(language, file_count, line_count) of files(path, loc)."""
    from edgeloom.functions.paths import language

    return files.groupBy(language(F.col("path")).alias("language")).agg(
        F.count("*").alias("file_count"), F.sum("loc").alias("line_count")
    )
