"""The session, the limits and the shared workspace that operators use."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Engine:
    """What every relation, variable and iteration is built with.

    ``max_iterations`` bounds the rounds of iterations made without a bound of their own;
    ``workers`` is the number of variables whose rounds are submitted at once. A round's
    candidates are looked for in ``probe_from`` or more known tuples by a scan that probes
    the candidates, if these are at most ``probe_most``; else both are shuffled. Derived
    batches are written under ``spark.checkpoint.dir``, which all executors share, so an
    executor can be lost at any time; a local folder is made only where that is unset and
    the master is local, and a cluster without the setting is refused. ``fold_at`` batches of
    one size class of a variable are folded into one.
    """

    def __init__(self, spark: SparkSession, max_iterations: int | None = None, workers: int = 4, probe_from: int = 5_000_000, probe_most: int = 500_000, fold_at: int = 16):
        self.spark, self.max_iterations, self.workers = spark, max_iterations, workers
        self.probe_from, self.probe_most, self.fold_at = probe_from, probe_most, fold_at
        folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not folder:
            if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="deltaloom-")
            spark.sparkContext.setCheckpointDir(folder)
        self.root = f"{folder.rstrip('/')}/deltaloom-{uuid.uuid4().hex}"

    def write(self, df: DataFrame) -> tuple[str, int]:
        """Write a batch and count it in the same job: (path, rows)."""
        path, found = self.write_counted(df)
        return path, found["n"]

    def write_counted(self, df: DataFrame, **measures: Column) -> tuple[str, dict]:
        """Write a batch with its number of rows, ``n``, and more aggregates of it, in the same job."""
        path, seen = f"{self.root}/{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in measures.items()]).write.parquet(path)
        return path, seen.get

    def read(self, paths: list[str], schema: StructType) -> DataFrame:
        """All batches as one scan, however many there are."""
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def remove(self, paths: list[str]) -> None:
        """Delete batches that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
