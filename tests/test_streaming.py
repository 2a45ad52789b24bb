"""Streaming invariants: stream == batch, and replaying the same files in 1 or many micro-batches
gives the same status table; a retried batch id replaces its own output."""

from pyspark.sql import functions as F

from tabml.session import scratch_path
from tabml.sources import runviews as RV
from tabml.streaming import status as ST


def _status(spark, staged, files_per_trigger):
    st = ST.stream_run_status(spark, staged, spark.read.parquet(staged).schema, scratch_path(spark, "st"),
                              scratch_path(spark, "st-ckpt"), max_files_per_trigger=files_per_trigger)
    return sorted(tuple(r) for r in st.select("run_id", "n_events", "last_event", "loop_backs").collect())


def test_replay_one_or_many_batches(spark, sf):
    staged = scratch_path(spark, "hist")
    RV.history(spark, sf).repartition(5, "seq").write.parquet(staged)
    many = _status(spark, staged, 1)
    one = _status(spark, staged, 100)
    batch = ST.status_of(ST._bucket(RV.history(spark, sf))).select("run_id", "n_events", "last_event", "loop_backs")
    assert many == one == sorted(tuple(r) for r in batch.collect())


def test_retried_batch_replaces_itself(spark, sf):
    root = scratch_path(spark, "retry")
    write = ST.make_batch_writer(root)
    h = RV.history(spark, sf)
    write(h, 0)
    write(h, 0)   # the same batch again (a retry)
    events = spark.read.parquet(root + "/events")
    assert events.count() == h.count()
    st = spark.read.parquet(root + "/status")
    assert st.agg(F.sum("n_events")).first()[0] == h.count()


def test_incremental_merge_with_retry_equals_whole_history(spark, sf):
    root = scratch_path(spark, "incr")
    write = ST.make_batch_writer(root)
    h = RV.history(spark, sf)
    first, second = h.where(F.col("seq") % 2 == 0), h.where(F.col("seq") % 2 == 1)
    write(first, 0)
    write(second, 1)
    write(second, 1)   # a retried batch: every bucket already absorbed it
    got = ST.public_status(spark.read.parquet(root + "/status"))
    want = ST.status_of(ST._bucket(h))
    cols = ["run_id", "n_events", "last_event", "loop_backs", "data_proceed", "last_type"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(tuple(r) for r in want.select(*cols).collect())


def test_two_sources_in_any_order_with_replays(spark, sf):
    """History and model calls merged batch by batch, some of them twice, one source ahead of the other."""
    from tabml.operators import runs as RU
    root = scratch_path(spark, "two")
    h, t = RV.history(spark, sf), RV.trace(spark, sf).where("run_id <> 'run-3'")
    write_h, write_t = ST.make_batch_writer(root + "/history"), ST.make_batch_writer(root + "/trace", source=ST.TRACE)
    for k in range(3):
        write_t(t.where(F.col("seq") % 3 == k), k)
        if k == 1:
            write_t(t.where(F.col("seq") % 3 == k), k)   # again
    assert ST.live_status(spark, root).where("n_events > 0").count() == 0   # calls only so far
    for k in range(2):
        write_h(h.where(F.col("seq") % 2 == k), k)
    write_h(h.where(F.col("seq") % 2 == 1), 1)
    got = {r["run_id"]: (r["n_events"], r["last_event"], r["n_calls"], r["total_tokens"], round(r["total_cost_usd"], 9)) for r in ST.live_status(spark, root).collect()}
    calls = {r["run_id"]: (r["total_tokens"], round(r["total_cost_usd"], 9)) for r in RU.trace_totals(t).collect()}
    n = {r["run_id"]: r["count"] for r in t.groupBy("run_id").count().collect()}
    want = {r["run_id"]: (r["n_events"], r["last_event"], n.get(r["run_id"], 0), *calls.get(r["run_id"], (0, 0.0)))
            for r in ST.status_of(ST._bucket(h)).collect()}
    assert got == want and got["run-3"][2:] == (0, 0, 0.0)


def test_lost_status_partition_is_rebuilt(spark, sf):
    import glob
    import shutil
    root = scratch_path(spark, "lost")
    write = ST.make_batch_writer(root, buckets=2)
    h = RV.history(spark, sf)
    for k in range(2):
        write(h.where(F.col("seq") % 3 == k), k)
    for d in glob.glob(root.replace("file:", "") + "/status/bucket=1"):
        shutil.rmtree(d)
    write(h.where(F.col("seq") % 3 == 2), 2)
    assert spark.read.parquet(root + "/status").agg(F.sum("n_events")).first()[0] == h.count()
