"""Resumable batches: what has arrived since the last run, once, by a stream that ends."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new(spark: SparkSession, source: str, schema: str | StructType, work: Callable[[DataFrame], DataFrame], target: str, state: str, files_each: int | None = None) -> int:
    """Runs ``work`` over the files that no earlier run has seen and appends to ``target``.

    The checkpoint in ``state`` is the record of progress. A batch that was cut short runs
    again and writes its own folder anew, so nothing is there twice. Returns the batches.
    """
    reader = spark.readStream.schema(schema).format("parquet")
    if files_each:
        reader = reader.option("maxFilesPerTrigger", files_each)
    ran: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        ran.append(number)

    query = reader.load(source).writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(ran)
