"""What the corpus operators share: reading tables, Arrow batches, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import tidemark
from tidemark.functions.lineage import checkpoint, release, setting  # noqa: F401

# Functions go to the workers as a whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(tidemark)

#: Rows of one Arrow batch handed to Python: bounds a worker's memory when texts are long.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of at most BATCH_ROWS rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(b.slice(at, BATCH_ROWS) for b in batches for at in range(0, max(1, b.num_rows), BATCH_ROWS))

    return df.mapInArrow(run, schema)


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one struct ``row``: what travels with it cannot clash."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the width that the operators deal work out to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
