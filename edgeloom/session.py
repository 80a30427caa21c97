"""Session defaults and the shared scratch area used to cut lineage.

Iterative operators (reachability, peeling, components) write each round as a
parquet table and read it back. Written rounds survive the loss of executors,
give Catalyst real sizes for its next join choice, and keep every plan short.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", app: str = "edgeloom") -> SparkSession:
    """Session for tests and the benchmark; a cluster passes its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


class Scratch:
    """One operator run's folder below the checkpoint root."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/edgeloom-{label}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/{name}")
        return self.read(name, df)

    def save_counted(
        self, df: DataFrame, name: str, which: Column | None = None, partition_by: tuple[str, ...] = ()
    ) -> tuple[DataFrame, int]:
        """Save and count rows (those where ``which`` holds) in the same job."""
        seen = Observation()
        n = F.count(F.lit(1)) if which is None else F.count_if(which)
        table = self.save(df.observe(seen, n.alias("n")), name, partition_by)
        return table, seen.get["n"]

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def read_many(self, names: list[str], like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*[f"{self.root}/{n}" for n in names])
