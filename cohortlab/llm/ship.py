"""Functions that run in Python workers travel with the job: executors need no installation."""
from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def by_value(module: str) -> None:
    """Have everything defined in ``module`` pickled by value."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def map_batches(df: DataFrame, run, schema: StructType) -> DataFrame:
    """``mapInArrow`` with a function from Arrow batches to lists of arrays. Columns are numbered
    on the way, so any names will do."""
    safe = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    names = safe.names

    def named(batches):
        import pyarrow as pa

        for arrays in run(batches):
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return numbered.mapInArrow(named, safe).toDF(*schema.names)
