"""Progress of resumable steps as an append-only table (step, key, item)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "step string, key string, item string"


class Progress:
    """What has been done. Only finished work is written, each append to a folder of its own,
    so that writers at the same time do not meet."""

    def __init__(self, spark: SparkSession, path: str, step: str):
        self.spark, self.path, self.step = spark, path, step

    def all(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def done(self) -> DataFrame:
        return self.all().where(F.col("step") == self.step).select("key", "item").distinct()

    def todo(self, wanted: DataFrame) -> DataFrame:
        """Rows of (key, item, ..) that have not been done."""
        return wanted.join(self.done(), ["key", "item"], "left_anti")

    def append(self, finished: DataFrame) -> None:
        finished.select(F.lit(self.step).alias("step"), "key", "item").write.parquet(f"{self.path}/{uuid.uuid4().hex}")

    def __len__(self) -> int:
        return self.done().count()
