"""Durable intermediate tables.

A stage boundary is a Parquet table in the folder that the cluster names in
``spark.checkpoint.dir``: it survives lost executors, unlike shuffle files or
local checkpoints.  Where the setting is absent a local master (tests, notebooks)
uses and sets a folder of its machine; any other one refuses.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[tempfile.TemporaryDirectory] = []
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or one of our own if none is set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own:
        _own.append(tempfile.TemporaryDirectory(prefix="pondera-"))
        sc.setCheckpointDir(_own[0].name)
    return f"file://{_own[0].name}"


def spread(rows: DataFrame) -> DataFrame:
    """A plain scan with fewer tasks than the cluster has cores, dealt out to all of them.

    A small file of one row group is one task, however heavy the work on its rows.
    Larger scans, and plans with an exchange of their own, are left as they are.
    """
    query = rows._jdf.queryExecution()
    if "Exchange" in query.executedPlan().toString():
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if 0 < query.toRdd().getNumPartitions() < cores else rows


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


class Scratch:
    """Named tables of one operator call, in a folder no other call uses."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, *, batch_rows: int = 0, **options: str) -> DataFrame:
        """Write the rows and return them as read back, with no lineage behind them.

        Shuffle files of the write are removed as it ends: the table replaces them.
        ``batch_rows`` bounds Arrow batches where rows are large.
        """
        conf = self.spark.conf
        own = {_CLEAN: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {})
        before = {k: conf.get(k, None) for k in own}
        try:
            for k, v in own.items():
                conf.set(k, v)
            df.write.mode("errorifexists").options(**options).parquet(f"{self.root}/{name}")
        finally:
            for k, v in before.items():
                conf.unset(k) if v is None else conf.set(k, v)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
