"""J1, S7, F11 in bulk: whole run documents, their JSON, and the relational tables, for every run of a store at once.

A document has the shape of ``PipelineRun``; its Spark type is derived from the report classes (``spark_type``), and so are the JSON
text, its reading back, the flattening into leaves and the tables. Children (history, trace, trials) are aggregated per run into arrays in
their stored order, so every join is one row a run on ``run_id``; all parts come from one set of committed versions. A document is
one row: it is as large as the run's own log.

Absent and empty differ: a section that was never written is null; an empty list of a present section is an empty array.
"""

from __future__ import annotations

import dataclasses
import types
import typing

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DataType, DoubleType, LongType, MapType, NumericType, StringType, StructField, StructType,
                               TimestampNTZType, TimestampType)

from tabml import reports as R
from tabml.session import scratch_path
from tabml.sources import runstore as RS
from tabml.spec import ProblemSpec

# ---------------------------------------------------------------- types

_SCALARS = {int: LongType(), float: DoubleType(), str: StringType(), bool: BooleanType(), typing.Any: StringType()}


def spark_type(hint) -> DataType:
    """Spark type of a report class or of the hint of one of its fields. Untyped map values (parameters) are kept as text."""
    if hint in _SCALARS:
        return _SCALARS[hint]
    if dataclasses.is_dataclass(hint):
        hints = typing.get_type_hints(hint)
        return StructType([StructField(f.name, spark_type(ProblemSpec if (hint, f.name) == (R.PipelineRun, "problem_spec") else hints[f.name]))
                           for f in dataclasses.fields(hint)])
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        (only,) = [a for a in args if a is not type(None)]
        return spark_type(only)
    if origin is list:
        return ArrayType(spark_type(args[0]))
    if origin is dict:
        return MapType(StringType(), spark_type(args[1]))
    raise TypeError(f"no Spark type for {hint!r}")


#: run_id, problem_spec, status, loop_count, the four reports, history, trace.
DOCUMENT = spark_type(R.PipelineRun)


def _as(kind: DataType, have: DataType, c: Column) -> Column:
    """Column ``c`` of type ``have`` in the shape of ``kind``: fields by name (missing ones null), entry lists as maps."""
    if isinstance(kind, StructType):
        names = {f.name: f.dataType for f in have.fields}
        made = F.struct(*[(_as(f.dataType, names[f.name], c[f.name]) if f.name in names else F.lit(None).cast(f.dataType)).alias(f.name)
                          for f in kind.fields])
        return F.when(c.isNotNull(), made)
    if isinstance(kind, MapType) and isinstance(have, ArrayType):
        return F.map_from_entries(c).cast(kind)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: _as(kind.elementType, have.elementType, x))
    return c.cast(kind)


# ---------------------------------------------------------------- documents of a store

def _in_force(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The four stored tables, all under one reading of the commits."""
    schemas = {"runs": RS.RUNS_SCHEMA, "history": RS.HISTORY_SCHEMA, "trace": RS.TRACE_SCHEMA, "trials": RS.TRIALS_SCHEMA}
    heads = RS._heads(spark, root).checkpoint()
    out = {}
    for name, schema in schemas.items():
        empty = spark.createDataFrame([], schema)
        raw = RS._raw(spark, root, name, schema)
        mine = heads.where(F.col("part") == name).select("run_id", "version")
        out[name] = empty if raw is None else raw.join(RS.broadcast_if_small(mine), ["run_id", "version"], "left_semi").select(*empty.columns)
    return out


def _listed(rows: DataFrame, order: str, fields: list[Column], name: str) -> DataFrame:
    """(run_id, name): the fields of a run's rows as an array in the order of ``order``."""
    entry = F.struct(F.col(order).alias("__at"), F.struct(*fields).alias("x"))
    ordered = F.array_sort(F.collect_list(entry), lambda a, b: F.when(a["__at"] < b["__at"], -1).when(a["__at"] > b["__at"], 1).otherwise(0))
    return rows.groupBy("run_id").agg(F.transform(ordered, lambda e: e["x"]).alias(name))


def run_documents(spark: SparkSession, root: str) -> DataFrame:
    """One row per run: the fields of ``DOCUMENT``, created_at and updated_at, and the totals of its trace. A run without rows in ``runs`` has no document."""
    t = _in_force(spark, root)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    history = _listed(t["history"], "seq", [stamp.alias("timestamp"), F.col("stage"), F.col("event")], "history")
    entry = DOCUMENT["trace"].dataType.elementType
    trace = t["trace"].withColumn("timestamp", stamp)
    totals = trace.groupBy("run_id").agg(F.round(F.sum("estimated_cost_usd"), 6).alias("total_cost_usd"), F.sum("total_tokens").alias("total_tokens"))
    trace = _listed(trace, "seq", [F.col(f.name).cast(f.dataType).alias(f.name) for f in entry.fields], "trace")
    trials = _listed(t["trials"], "trial_number", [F.col("trial_number"), F.col("params"), F.col("score")], "search_history")
    runs, have = t["runs"], t["runs"].schema
    wide = runs.join(history, "run_id", "left").join(trace, "run_id", "left").join(trials, "run_id", "left").join(totals, "run_id", "left")
    spec, flat = DOCUMENT["problem_spec"].dataType, have["spec"].dataType
    limits = spec["constraints"].dataType
    nested = F.struct(*[(F.struct(*[F.col("spec")[f.name].cast(f.dataType).alias(f.name) for f in limits.fields]) if f.name == "constraints"
                         else _as(f.dataType, flat[f.name].dataType, F.col("spec")[f.name])).alias(f.name) for f in spec.fields])
    none = lambda kind: F.array().cast(kind)
    tuning = DOCUMENT["tuning_result"].dataType
    stored = have["tuning_result"].dataType
    tuned = F.when(F.col("tuning_result").isNotNull(), F.struct(*[
        (F.coalesce(_as(f.dataType, wide.schema["search_history"].dataType, F.col("search_history")), none(f.dataType)) if f.name == "search_history"
         else _as(f.dataType, stored[f.name].dataType, F.col("tuning_result")[f.name])).alias(f.name) for f in tuning.fields]))
    made = {"problem_spec": nested, "tuning_result": tuned, "history": F.coalesce("history", none(DOCUMENT["history"].dataType)),
            "trace": F.coalesce("trace", none(DOCUMENT["trace"].dataType))}
    cols = [(made[f.name] if f.name in made else _as(f.dataType, have[f.name].dataType, F.col(f.name))).alias(f.name) for f in DOCUMENT.fields]
    return wide.select(*cols, "created_at", "updated_at", F.coalesce("total_cost_usd", F.lit(0.0)).alias("total_cost_usd"),
                       F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"))


# ---------------------------------------------------------------- JSON

def documents_json(docs: DataFrame) -> DataFrame:
    """(run_id, json): each document as JSON text; absent sections are left out, empty lists stay."""
    return docs.select("run_id", F.to_json(F.struct(*[f.name for f in DOCUMENT.fields])).alias("json"))


def documents_from_json(texts: DataFrame, json_col: str = "json") -> DataFrame:
    """The documents of JSON texts, as columns. Unknown fields are ignored, missing ones are null (lists of events empty). A text
    that is no JSON object, or has no run_id, gives no document: its columns are all null but ``invalid``, which holds the text."""
    kind = StructType([*DOCUMENT.fields, StructField("__broken", StringType())])
    doc = texts.select(F.from_json(F.col(json_col), kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__broken"}).alias("d"),
                       F.col(json_col).alias("__text"))
    fine = F.col("d").isNotNull() & F.col("d.__broken").isNull() & F.col("d.run_id").isNotNull()
    lists = {"history", "trace"}
    cols = [F.when(fine, F.coalesce(F.col("d")[f.name], F.array().cast(f.dataType)) if f.name in lists else F.col("d")[f.name]).alias(f.name)
            for f in DOCUMENT.fields]
    return doc.select(*cols, F.when(~fine, F.col("__text")).alias("invalid"))


def write_documents(root: str, docs: DataFrame) -> None:
    """S6 in bulk from documents: each run is replaced as ``persist_run_state`` would, except that absent sections are not kept."""
    spark = docs.sparkSession
    have = spark.createDataFrame([], RS.RUNS_SCHEMA).schema
    time = lambda c: F.to_timestamp(c)
    spec = F.struct(*[F.coalesce(F.col("problem_spec")[f.name] if f.name in DOCUMENT["problem_spec"].dataType.names
                                 else F.col("problem_spec.constraints")[f.name]).cast(f.dataType).alias(f.name) for f in have["spec"].dataType.fields])

    def section(name: str) -> Column:
        kind = have[name].dataType
        doc = DOCUMENT[name].dataType

        def field(f: StructField) -> Column:
            c = F.col(name)[f.name]
            if isinstance(doc[f.name].dataType, MapType) and isinstance(f.dataType, ArrayType):
                c = F.transform(F.map_entries(c), lambda e: F.struct(*[e[k].alias(n) for k, n in zip(("key", "value"), f.dataType.elementType.names)]))
            return c.cast(f.dataType).alias(f.name)
        return F.when(F.col(name).isNotNull(), F.struct(*[field(f) for f in kind.fields])).alias(name)

    runs = docs.select("run_id", "status", F.col("loop_count").cast("int").alias("loop_count"),
                       time(F.array_min(F.transform("history", lambda h: h["timestamp"]))).alias("created_at"),
                       time(F.array_max(F.transform("history", lambda h: h["timestamp"]))).alias("updated_at"), spec.alias("spec"),
                       *[section(s) for s in RS.SECTIONS])
    rows = lambda c: docs.select("run_id", F.posexplode(c).alias("seq", "x")).select("run_id", F.col("seq").cast("long").alias("seq"), "x.*")
    history = rows("history").select("run_id", "seq", time("timestamp").alias("ts"), "stage", "event")
    trace = rows("trace").withColumn("ts", time("timestamp")).select(*spark.createDataFrame([], RS.TRACE_SCHEMA).columns)
    trials = rows("tuning_result.search_history").select("run_id", F.col("trial_number").cast("int").alias("trial_number"), "params", "score")
    RS.write_runs_frame(root, runs, history, trace, trials)


# ---------------------------------------------------------------- leaves

#: Lists of a document that grow with the run's log and its search. Their entries are taken apart one by one.
LONG_LISTS = ("history", "trace", "tuning_result.search_history")


def _list_type(kind: DataType, path: str) -> DataType | None:
    for name in path.split("."):
        if not isinstance(kind, StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return kind if isinstance(kind, ArrayType) else None


def leaves(docs: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, path, text, number): every value inside the columns of ``docs``, one row each, by its path (``a.b[0].c``; map entries by
    key). Booleans and numbers are in ``number``, other values in ``text``. A list or map that is present has a row ``path#`` with its length.

    A document's leaves are never one array: the entries of ``LONG_LISTS`` are rows of their own before they are walked. The documents are written once
    for that, so they are put together once and each list is read alone."""
    long = {p: kind for p in LONG_LISTS if (kind := _list_type(docs.schema, p)) is not None}
    if long:
        path = scratch_path(docs.sparkSession, "documents")
        docs.write.parquet(path)
        docs = docs.sparkSession.read.schema(docs.schema).parquet(path)
    empty = "array<struct<path:string,text:string,number:double>>"

    def one(path: Column, text: Column | None, number: Column | None) -> Column:
        return F.array(F.struct(path.alias("path"), (F.lit(None).cast("string") if text is None else text).alias("text"),
                                (F.lit(None).cast("double") if number is None else number).alias("number")))

    def walk(c: Column, kind: DataType, path: Column, name: str = "") -> Column:
        if isinstance(kind, StructType):
            got = F.concat(*[walk(c[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}")), name and f"{name}.{f.name}") for f in kind.fields])
        elif name in long:
            got = one(F.concat(path, F.lit("#")), None, F.size(c).cast("double"))
        elif isinstance(kind, ArrayType):
            inner = F.transform(c, lambda x, i: walk(x, kind.elementType, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            got = F.concat(one(F.concat(path, F.lit("#")), None, F.size(c).cast("double")), F.flatten(inner))
        elif isinstance(kind, MapType):
            inner = F.transform(F.map_entries(c), lambda e: walk(e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"])))
            got = F.concat(one(F.concat(path, F.lit("#")), None, F.size(c).cast("double")), F.flatten(inner))
        elif isinstance(kind, (NumericType, BooleanType)):
            got = one(path, None, c.cast("double"))
        elif isinstance(kind, (TimestampType, TimestampNTZType)):
            got = one(path, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), None)
        else:
            got = one(path, c.cast("string"), None)
        return F.when(c.isNotNull(), got).otherwise(F.array().cast(empty))

    every = F.concat(*[walk(F.col(f"`{f.name}`"), f.dataType, F.lit(f.name), f.name) for f in docs.schema.fields if f.name != key])
    out = docs.select(F.col(key), F.explode(every).alias("leaf"))
    for p, kind in long.items():
        entries = docs.select(F.col(key), F.posexplode(p).alias("__at", "__x"))
        entry = walk(F.col("__x"), kind.elementType, F.concat(F.lit(f"{p}["), F.col("__at").cast("string"), F.lit("]")))
        out = out.unionByName(entries.select(F.col(key), F.explode(entry).alias("leaf")))
    return out.select(key, "leaf.*")


# ---------------------------------------------------------------- relational tables

#: The relational tables. Of a section: the section, its scalar fields.
SECTION_TABLES = {
    "data_profiles": ("data_profile", ("row_count", "column_count", "blocking_issue")),
    "eda_reports": ("eda_report", ("target_distribution_notes",)),
    "tuning_results": ("tuning_result", ("best_cv_score", "metric_optimized", "search_budget_used", "search_budget_total", "convergence_notes", "converged")),
    "evaluation_reports": ("evaluation_report", ("metric_optimized", "metric_value", "metric_threshold", "pass_fail", "model_artifact_path")),
    "failure_analyses": ("evaluation_report.failure_analysis", ("summary", "recommended_next_step")),
}
#: Fixed values. Of a list, map or matrix: the sections' fields (with the kind that tells two of them apart), the columns of an entry.
ENTRY_TABLES = {
    "column_schemas": ([("data_profile.column_schema", None)], ("name", "dtype", "missing_pct", "is_target")),
    "cleaning_actions": ([("data_profile.cleaning_actions_taken", None)], ("column", "action", "rationale")),
    "class_balance_entries": ([("data_profile.class_balance", None)], ("class_label", "proportion")),
    "data_profile_warnings": ([("data_profile.warnings", None)], ("warning_text",)),
    "outlier_flags": ([("data_profile.outlier_flags", None)], ("column_name",)),
    "feature_correlations": ([("eda_report.correlation_summary", None)], ("feature_name", "correlation")),
    "feature_decisions": ([("eda_report.engineered_features", "engineered"), ("eda_report.dropped_features", "dropped")], ("name", "rationale")),
    "leakage_warnings": ([("eda_report.leakage_warnings", None)], ("warning_text",)),
    "data_quality_warnings": ([("eda_report.data_quality_warnings", None)], ("warning_text",)),
    "final_feature_names": ([("eda_report.final_feature_names", None)], ("feature_name",)),
    "tuning_best_params": ([("tuning_result.best_params", None)], ("param_name", "param_value")),
    "test_metric_entries": ([("evaluation_report.test_metrics", None)], ("metric_name", "value")),
    "residual_summary_entries": ([("evaluation_report.residual_summary", None)], ("key", "value")),
    "confusion_matrix_cells": ([("evaluation_report.confusion_matrix", None)], ("row_idx", "col_idx", "count")),
}
LIMITS = tuple(f.name for f in DOCUMENT["problem_spec"].dataType["constraints"].dataType.fields)
TABLES = ("runs", "problem_specs", "pipeline_constraints", "history_entries", "trace_entries", "trial_records", "trial_record_params",
          *SECTION_TABLES, *ENTRY_TABLES)


def _entries(runs: DataFrame, path: str, columns: tuple[str, ...]) -> DataFrame:
    """(run_id, ord, columns): one row per entry, as the field's type asks: struct fields, a plain value, key and value, or matrix cells
    (ord is then the row's, as row_idx)."""
    kind = runs.select(path).schema[0].dataType
    if isinstance(kind, MapType):
        runs = runs.select("run_id", F.array_sort(F.map_entries(path)).alias("__list"))  # by key: a map has no order of its own
    else:
        runs = runs.select("run_id", F.col(path).alias("__list"))
    kind = runs.schema["__list"].dataType.elementType
    rows = runs.select("run_id", F.posexplode("__list").alias("ord", "x"))
    if isinstance(kind, StructType):
        return rows.select("run_id", "ord", *[F.col("x")[f.name].alias(c) for f, c in zip(kind.fields, columns)])
    if isinstance(kind, ArrayType):
        return rows.select("run_id", F.col("ord").alias(columns[0]), F.posexplode("x").alias(*columns[1:]))
    return rows.select("run_id", "ord", F.col("x").alias(columns[0]))


def run_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The relational tables of a store, by name, keyed by run_id (and ord, seq or trial_number for lists). A table has rows of present sections only."""
    runs = RS._read(spark, root, "runs", RS.RUNS_SCHEMA)
    trials = RS._read(spark, root, "trials", RS.TRIALS_SCHEMA)
    plain = [f.name for f in runs.schema["spec"].dataType.fields if f.name not in LIMITS]
    out = {"runs": runs.select("run_id", "status", "loop_count", "created_at", "updated_at"),
           "problem_specs": runs.select("run_id", *[f"spec.{c}" for c in plain]),
           "pipeline_constraints": runs.select("run_id", *[f"spec.{c}" for c in LIMITS]),
           "history_entries": RS._read(spark, root, "history", RS.HISTORY_SCHEMA),
           "trace_entries": RS._read(spark, root, "trace", RS.TRACE_SCHEMA),
           "trial_records": trials,
           "trial_record_params": trials.select("run_id", "trial_number", F.explode("params").alias("param_name", "param_value"))}
    for name, (section, fields) in SECTION_TABLES.items():
        out[name] = runs.where(F.col(section).isNotNull()).select("run_id", *[f"{section}.{c}" for c in fields])
    for name, (sources, columns) in ENTRY_TABLES.items():
        for path, kind in sources:
            rows = _entries(runs, path, columns)
            rows = rows if kind is None else rows.withColumn("kind", F.lit(kind))
            out[name] = out[name].unionByName(rows) if name in out else rows
    return {name: out[name] for name in TABLES}


def decision_counts(spark: SparkSession, root: str) -> DataFrame:
    """Per run the number of final features, of engineered and dropped ones and of cleaning actions; null where the section is absent."""
    runs = RS._read(spark, root, "runs", RS.RUNS_SCHEMA)
    n = lambda c: F.when(F.col(c).isNotNull(), F.size(c))
    return runs.select("run_id", n("eda_report.final_feature_names").alias("n_kept"), n("eda_report.engineered_features").alias("n_engineered"),
                       n("eda_report.dropped_features").alias("n_dropped"), n("data_profile.cleaning_actions_taken").alias("n_actions"))
