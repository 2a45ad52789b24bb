"""The fitted feature plan applied unchanged to a file stream (stateless, no watermark).

``FeaturePlanModel.transform`` is one projection of literals, so the same plan object serves batch
and streaming DataFrames; the check is stream output == batch output on the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabml.operators.features import FeaturePlanModel


def stream_score(spark: SparkSession, source_dir: str, schema, model: FeaturePlanModel, out_dir: str,
                 checkpoint: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Run the stream until the files present now are processed (``availableNow``); returns the sink read back."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))
    q = (model.transform(stream).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_dir)
