"""R2: live run status from streams of history events and of model calls.

``foreachBatch`` per micro-batch of one source:
1. write the batch to a folder of its own (``events/batch_id=N``, one partition a bucket), replacing what an earlier try of the
   batch left there (the event folders are the source of truth);
2. merge the batch's per-run partial aggregates into the stored status of the buckets it touched. Only the batch's own folder is opened.
   Every status field is mergeable (counts, tokens and decimal costs add up; "last event" and "latest data-agent verdict"
   are maxima of (ts, seq, value) structs), so a batch costs its own rows plus the status rows of
   its buckets, never the whole history.

Retries: each bucket's status rows carry the last batch they absorbed (``upto_batch``); a retried
batch skips buckets it already updated. A bucket without status rows (new, or a partition lost in
a crash) is rebuilt from its earlier events. The merged rows are checkpointed (reliably, to
``spark.checkpoint.dir``) before they replace the status partitions they were read from.

History and trace are two sources with marks of their own, so either may be replayed, lag or run ahead; a run's public status joins
the two tables on its id.

State lives in tables, not in the state store: bounded by the number of runs, restartable, and a
late event is simply merged. (A streaming ``groupBy(run_id)`` would keep every key forever; a
watermark does not expire non-windowed keys.)
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tabml.operators.runs import call_costs, event_type
from tabml.session import ensure_checkpoint_dir

BUCKETS = 16   # status partitions: a batch rewrites the status rows of the buckets it touches
_KEYS = ["bucket", "run_id"]


def partial_status(history: DataFrame) -> DataFrame:
    """Mergeable per-run parts: events, last (ts, seq, event), loop-backs, latest data_agent proceed
    verdict as (ts, seq, flag)."""
    is_dp = (F.col("stage") == "data_agent") & F.col("event").contains("proceed=")
    return history.groupBy(*_KEYS).agg(
        F.count(F.lit(1)).alias("n_events"),
        F.max(F.struct("ts", "seq", "event")).alias("last"),
        F.count(F.when(F.col("event").contains("fail ->"), 1)).alias("loop_backs"),
        F.max(F.when(is_dp, F.struct("ts", "seq", F.col("event").contains("proceed=True").alias("flag")))).alias("dp"))


def merge_status(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*_KEYS).agg(F.sum("n_events").alias("n_events"), F.max("last").alias("last"),
                                     F.sum("loop_backs").alias("loop_backs"), F.max("dp").alias("dp"))


def partial_calls(trace: DataFrame) -> DataFrame:
    """Mergeable per-run sums of model calls: number, tokens, cost (exact decimals)."""
    return call_costs(trace).groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n_calls"), F.sum(F.col("total_tokens").cast("decimal(38,0)")).alias("tokens"),
                                                 F.sum(F.col("cost").cast("decimal(38,6)")).alias("cost"))


def merge_calls(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*_KEYS).agg(F.sum("n_calls").alias("n_calls"), F.sum("tokens").cast("decimal(38,0)").alias("tokens"),
                                     F.sum("cost").cast("decimal(38,6)").alias("cost"))


@dataclass(frozen=True)
class Source:
    """What a stream contributes: mergeable parts of a batch, and their merge."""

    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]


HISTORY, TRACE = Source(partial_status, merge_status), Source(partial_calls, merge_calls)


def public_status(parts: DataFrame) -> DataFrame:
    """Per run: events, last event and its type, loop-backs, latest data_agent proceed flag."""
    return (parts.select(*_KEYS, "n_events", F.col("last.event").alias("last_event"), "loop_backs",
                         F.col("dp.flag").alias("data_proceed"))
            .withColumn("last_type", event_type(F.col("last_event"))))


def status_of(history: DataFrame) -> DataFrame:
    """The whole-history aggregate (what the incremental table must equal)."""
    return public_status(partial_status(history))


def _bucket(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("run_id"), F.lit(buckets)).cast("int"))


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:   # nothing written yet
        return None


def make_batch_writer(root: str, buckets: int = BUCKETS, source: Source = HISTORY):
    events_path = os.path.join(root, "events")
    status_path = os.path.join(root, "status")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        ensure_checkpoint_dir(spark)
        own = os.path.join(events_path, f"batch_id={batch_id}")
        rows = _bucket(batch, buckets)
        rows.write.mode("overwrite").partitionBy("bucket").parquet(own)
        mine = spark.read.schema(rows.schema).parquet(own)          # this batch's files only
        touched = [r[0] for r in mine.select("bucket").distinct().collect()]   # at most `buckets` values
        if not touched:
            return
        stored = _read(spark, status_path)
        old = stored.where(F.col("bucket").isin(*touched)) if stored is not None else None
        seen = ({r["bucket"]: r["upto"] for r in old.groupBy("bucket").agg(F.max("upto_batch").alias("upto")).collect()}
                if old is not None else {})
        todo = [k for k in touched if seen.get(k, -1) < batch_id]   # a retry skips buckets already merged
        if not todo:
            return
        present = [k for k in todo if k in seen]
        missing = [k for k in todo if k not in seen]
        parts = source.partial(mine.where(F.col("bucket").isin(*todo)))
        if present:
            parts = parts.unionByName(old.where(F.col("bucket").isin(*present)).select(*parts.columns))
        if missing and batch_id > 0:   # new bucket, or status lost: rebuild from the bucket's earlier events
            schema = StructType([*rows.schema.fields, StructField("batch_id", LongType())])
            earlier = spark.read.schema(schema).option("basePath", events_path).parquet(events_path)
            parts = parts.unionByName(source.partial(earlier.where(F.col("bucket").isin(*missing) & (F.col("batch_id") < batch_id))))
        merged = source.merge(parts).withColumn("upto_batch", F.lit(batch_id).cast("long"))
        merged = merged.checkpoint(eager=True)   # read the old rows fully before replacing their files
        (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(status_path))
    return write_batch


def _start(spark: SparkSession, source_dir: str, schema, root: str, checkpoint: str, max_files: int, source: Source):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)
    return (stream.writeStream.foreachBatch(make_batch_writer(root, source=source)).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stream_run_status(spark: SparkSession, source_dir: str, schema, root: str, checkpoint: str,
                      max_files_per_trigger: int = 1) -> DataFrame:
    """Process the history files present now, batch by batch; returns the status table."""
    _start(spark, source_dir, schema, root, checkpoint, max_files_per_trigger, HISTORY).awaitTermination()
    return public_status(spark.read.parquet(os.path.join(root, "status")))


def live_status(spark: SparkSession, root: str) -> DataFrame:
    """Per run of either source: the public status of its history and the sums of its model calls (null and 0 where it has none)."""
    history, trace = (_read(spark, os.path.join(root, name, "status")) for name in ("history", "trace"))
    empty = "bucket int, run_id string"
    if history is None:
        history = spark.createDataFrame([], f"{empty}, n_events long, last struct<ts:timestamp,seq:bigint,event:string>, loop_backs long, "
                                            "dp struct<ts:timestamp,seq:bigint,flag:boolean>")
    if trace is None:
        trace = spark.createDataFrame([], f"{empty}, n_calls long, tokens decimal(38,0), cost decimal(38,6)")
    both = public_status(history).drop("bucket").join(trace.select("run_id", "n_calls", "tokens", "cost"), "run_id", "full")
    zero = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)).alias(c)
    return both.select("run_id", zero("n_events", "long"), "last_event", "last_type", zero("loop_backs", "long"), "data_proceed",
                       zero("n_calls", "long"), zero("tokens", "long").alias("total_tokens"), zero("cost", "double").alias("total_cost_usd"))


def stream_live_status(spark: SparkSession, history_dir: str, history_schema, trace_dir: str, trace_schema, root: str,
                       checkpoint: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Process the history and trace files present now, as two streams side by side; returns the joined status."""
    started = [_start(spark, src, schema, os.path.join(root, name), os.path.join(checkpoint, name), max_files_per_trigger, source)
               for name, src, schema, source in (("history", history_dir, history_schema, HISTORY), ("trace", trace_dir, trace_schema, TRACE))]
    for q in started:
        q.awaitTermination()
    return live_status(spark, root)
