"""Arrow functions that executors can run without a copy of this package."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame

import tidemark

cloudpickle.register_pickle_by_value(tidemark)


def map_pandas(df: DataFrame, fn, schema: str) -> DataFrame:
    return df.mapInPandas(fn, schema)
