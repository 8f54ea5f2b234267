"""Access to the parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


class Tables:
    """``Tables(spark, folder).orders`` is the lazily read ``orders.parquet``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def spread(self, name: str) -> DataFrame:
        """The table over at least as many partitions as there are cores.

        Only a table read in fewer splits is redistributed, so large tables never pay a shuffle for it.
        Meant for work that spends its time on the processor: text, JSON, Arrow kernels.
        """
        table = getattr(self, name)
        cores = self.spark.sparkContext.defaultParallelism
        return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)
