"""Per-row results of array code as a struct column, by an Arrow-batched UDF."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StructType


def add_struct(df: DataFrame, col: str, name: str, schema: str, run: Callable[[pa.Array], dict[str, np.ndarray]]) -> DataFrame:
    """``df`` with ``name``: run(column of a batch) gives one array per field of ``schema``, in its order."""
    kind = StructType.fromDDL(schema)
    to = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32()}

    @arrow_udf(kind)
    def apply(column: pa.Array) -> pa.Array:
        got = run(column)
        return pa.StructArray.from_arrays([got[f.name] if isinstance(got[f.name], pa.Array) else
                                           pa.array(np.asarray(got[f.name]), type=to[f.dataType.simpleString()]) for f in kind.fields],
                                          fields=[pa.field(f.name, to[f.dataType.simpleString()]) for f in kind.fields])

    return df.withColumn(name, apply(F.col(f"`{col}`")))
