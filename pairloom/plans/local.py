"""Small tables that the driver holds, made without Python on the executors.

``createDataFrame`` of a list turns its rows into Spark's in Python workers, which are a
daemon and workers of their own beside those of Arrow functions, and which stay.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """``rows`` as a table of ``schema`` (DDL); structs are tuples in the order of their fields, or None."""
    fields = StructType.fromDDL(schema).fields
    arrays = [pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(fields)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=[f.name for f in fields]), StructType(fields))
