"""Inputs on which earlier versions were wrong."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tabml.operators import metrics as M
from tabml.operators import stats
from tabml.operators.features import _vocabularies
from tabml.operators.profile import apply_fills, mode_fills
from tabml.operators.runs import metric_delta, parse_param
from tabml.reports import HistoryEntry, PipelineRun, TraceEntry
from tabml.session import scratch_path
from tabml.sources import runstore as RS
from tabml.sources.files import scan_csv
from tabml.sources.runstore import parse_param_value
from tabml.spec import ProblemSpec


def test_csv_as_people_write_it(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a.b,t,n,f\n1,30D,1,"say ""hi"""\n2,60D,2.5,"two\nlines"\n3,5F\n')
    df = scan_csv(spark, str(tmp_path / "a.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "string"]
    assert [tuple(r) for r in df.collect()] == [(1, "30D", 1.0, 'say "hi"'), (2, "60D", 2.5, "two\nlines"), (3, "5F", None, None)]


def test_fill_of_integers_and_booleans(spark):
    df = spark.createDataFrame([(1, True), (None, None), (4, True)], "x int, b boolean")
    assert [tuple(r) for r in apply_fills(df, {"x": 2.5, **mode_fills(df, ["b"])}).collect()] == [(1.0, True), (2.5, True), (4.0, True)]


PARAMS = {"5d": "str", "nan": "str", "inf": "str", "1e3": "float", "1.5": "float", "7": "int", "-3": "int", "1" * 20: "int", "e": "str"}


def test_parameter_rule_in_both_forms(spark):
    df = spark.createDataFrame([(t,) for t in PARAMS], "t string").select("t", *parse_param(F.col("t")))
    for r in df.collect():
        want = parse_param_value(r.t)
        assert r.value_type == PARAMS[r.t] == type(want).__name__
        got = r.int_value if r.int_value is not None else r.float_value if r.float_value is not None else r.text_value
        assert str(got) == str(want)


def test_distinct_count_is_exact_beyond_ten_thousand(spark):
    df = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("c"))
    assert _vocabularies(df, ["c"])[0] == {"c": 20_000}


def test_metrics_of_many_classes(spark):
    df = spark.range(300).select(F.col("id").alias("y"), (F.col("id") - F.col("id") % 2).alias("p"))
    got = M.macro_values(df, "y", "p")
    assert got["accuracy"] == pytest.approx(0.5) and got["recall"] == pytest.approx(0.5) and got["precision"] == pytest.approx(0.25)


def test_delta_does_not_depend_on_row_order(spark):
    rows = [("r", 0.8, 0.7), ("r", 0.8, 0.9)]
    for order in (rows, rows[::-1]):
        assert metric_delta(spark.createDataFrame(order, "run_id string, threshold double, score double")).first()["delta"] == pytest.approx(0.1)


def _run(run_id, n):
    return PipelineRun(run_id, ProblemSpec("classification", "y", "f1", 0.8, "builtin:orders_status"), status="done",
                       history=[HistoryEntry(f"2024-01-01T00:00:0{i}", "s", f"{run_id}-{i}") for i in range(n)],
                       trace=[TraceEntry("a", "m", 1, 2, 3, 1.0, 0.5, "2024-01-02T00:00:00")])


def test_store_keeps_all_concurrent_writers_of_one_bucket(spark):
    root = scratch_path(spark, "threads")
    ids = [r["r"] for r in spark.range(2000).select(F.concat(F.lit("r"), "id").alias("r")).where(RS._bucket_of(F.col("r")) == 0).limit(9).collect()]
    RS.persist_run_state(spark, root, _run(ids[0], 3))
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda r: RS.persist_run_state(spark, root, _run(r, 2)), ids[1:]))
    for name, schema, each in (("runs", RS.RUNS_SCHEMA, 1), ("history", RS.HISTORY_SCHEMA, 2), ("trace", RS.TRACE_SCHEMA, 1)):
        got = {r["run_id"]: r["count"] for r in RS._read(spark, root, name, schema).groupBy("run_id").count().collect()}
        assert got == {r: each for r in ids} | ({ids[0]: 3} if name == "history" else {})
    assert RS.load_run_state(spark, root, ids[4]).trace[0].timestamp == "2024-01-02T00:00:00"


def test_store_write_costs_its_own_rows_and_compaction_drops_the_rest(spark):
    root = scratch_path(spark, "append")
    for i in range(2):
        RS.persist_run_state(spark, root, _run(f"x{i}", 3))
    before = set(RS._files(spark, f"{root}/history"))
    RS.persist_run_state(spark, root, _run("x0", 1))
    added = set(RS._files(spark, f"{root}/history")) - before
    assert before <= set(RS._files(spark, f"{root}/history")) and len(added) == 1
    assert RS._raw(spark, root, "history", RS.HISTORY_SCHEMA).count() == 7
    want = [("x0", "x0-0")] + [("x1", f"x1-{i}") for i in range(3)]
    for _ in range(2):
        assert sorted(map(tuple, RS._read(spark, root, "history", RS.HISTORY_SCHEMA).select("run_id", "event").collect())) == want
        RS.compact(spark, root)
        assert RS._raw(spark, root, "history", RS.HISTORY_SCHEMA).count() == 4
    RS.persist_run_state(spark, root, _run("x1", 0))
    assert RS.load_run_state(spark, root, "x1").history == [] and len(RS.load_run_state(spark, root, "x0").history) == 1
    uncommitted = RS._raw(spark, root, "history", RS.HISTORY_SCHEMA).withColumn("version", F.lit("9"))
    uncommitted.write.mode("append").partitionBy("run_bucket").parquet(f"{root}/history")   # a writer that died before its commit
    assert RS._read(spark, root, "history", RS.HISTORY_SCHEMA).count() == 1


def test_rank_search_with_infinities_gathers_little(spark, monkeypatch):
    monkeypatch.setattr(stats, "HIST_BUCKETS", 16)
    monkeypatch.setattr(stats, "FINAL_RANGE_ROWS", 20)
    inf = float("inf")
    values = [-inf, -inf, -1.7e308, 1.7e308, inf] + [float(i * i) for i in range(2000)] + [-2.0 ** -i for i in range(0, 1000, 7)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    gathered, collect = [], type(df).collect

    def counted(frame):
        rows = collect(frame)
        gathered.append(len(rows))
        return rows
    monkeypatch.setattr(type(df), "collect", counted)
    ks = [0, 1, 2, 3, 70, 1000, len(values) - 2, len(values) - 1]
    got = stats.kth_smallest(df, [("x", k) for k in ks], {"x": (-inf, inf)})
    assert [got["x", k] for k in ks] == [sorted(values)[k] for k in ks]
    assert max(gathered) <= 20 * len(ks)
