"""Run-store inputs derived from the data folder: runs, history and trace from ``events``
(run = user), trials from ``part`` (run = part size). One SQL text serves Spark (``spark.sql`` with
DataFrame arguments) and the DuckDB oracle (plain table names), so both read identical inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabml.sources.views import table

STAGE_CASE = """CASE event_type WHEN 'signup' THEN 'data_agent' WHEN 'view' THEN 'feature_agent'
       WHEN 'click' THEN 'tuning_agent' WHEN 'purchase' THEN 'training_agent' ELSE 'orchestrator' END"""

HISTORY_SQL = f"""SELECT concat('run-', CAST(user_id AS STRING)) AS run_id, event_id AS seq, ts, {STAGE_CASE} AS stage,
  CASE event_type
    WHEN 'signup' THEN CASE WHEN value >= 50 THEN 'proceed=True' ELSE 'proceed=False' END
    WHEN 'view' THEN CASE WHEN value >= 50 THEN 'proceed=True' ELSE 'proceed=False' END
    WHEN 'click' THEN CASE WHEN value >= 100 THEN 'proceed=True'
                      ELSE 'note: TuningAgent flagged concerns but pipeline continues to Training' END
    WHEN 'purchase' THEN CASE WHEN value >= 200 THEN 'run passed — pipeline complete'
         ELSE concat('fail -> recommended_next_step=',
                     CASE CAST(floor(value) AS BIGINT) % 3 WHEN 0 THEN 'revisit_features'
                          WHEN 1 THEN 'expand_hyperparam_search' ELSE 'insufficient_data' END,
                     ' (TrainingAgent agrees: True), loop_count=1') END
    ELSE CASE WHEN value < 20 THEN 'skipping feature_agent — resuming from tuning, features unchanged'
              ELSE concat('escalated: ', props) END
  END AS event
FROM {{events}}"""

TRACE_SQL = f"""SELECT concat('run-', CAST(user_id AS STRING)) AS run_id, event_id AS seq, ts, {STAGE_CASE} AS agent,
  CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'gpt-4o-mini' ELSE 'gpt-4o' END AS model,
  CAST(floor(value * 10) AS BIGINT) AS prompt_tokens, CAST(floor(value) AS BIGINT) AS completion_tokens,
  CAST(floor(value * 10) AS BIGINT) + CAST(floor(value) AS BIGINT) AS total_tokens
FROM {{events}}"""

# Trial numbers are positions inside a run (p_partkey order). No task sorts a whole run: keys are cut
# into cells of 4,096 consecutive keys; a run's cell offsets are running sums over its (small) cell
# counts, and rows are ranked only inside their (run, cell).
TRIALS_SQL = """SELECT concat('run-', CAST(p.p_size AS STRING)) AS run_id,
  CAST(o.off + row_number() OVER (PARTITION BY p.p_size, p.cell ORDER BY p.p_partkey) - 1 AS INT) AS trial_number,
  round(p.p_retailprice / 2100, 4) AS score,
  CAST(50 + p.p_partkey % 251 AS INT) AS n_estimators, CAST(2 + p.p_partkey % 19 AS INT) AS max_depth,
  CAST(2 + p.p_partkey % 9 AS INT) AS min_samples_split
FROM (SELECT p_partkey, p_size, p_retailprice, CAST(floor(p_partkey / 4096) AS BIGINT) AS cell FROM {part}) p
JOIN (SELECT p_size, cell,
        COALESCE(sum(n) OVER (PARTITION BY p_size ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM (SELECT p_size, CAST(floor(p_partkey / 4096) AS BIGINT) AS cell, count(*) AS n FROM {part}
            GROUP BY p_size, CAST(floor(p_partkey / 4096) AS BIGINT)) c) o
  ON o.p_size = p.p_size AND o.cell = p.cell"""

RUNS_SQL = """SELECT run_id, created_at, updated_at, loop_count, task_type, data_source, success_metric,
  metric_threshold, metric_value, max_loop_backs, max_tuning_trials,
  CASE WHEN escalations > 0 THEN 'escalated'
       WHEN (success_metric = 'f1' AND metric_value >= metric_threshold)
         OR (success_metric = 'rmse' AND metric_value <= metric_threshold) THEN 'done'
       ELSE 'evaluated' END AS status
FROM (SELECT concat('run-', CAST(user_id AS STRING)) AS run_id, min(ts) AS created_at, max(ts) AS updated_at,
        CAST(count(CASE WHEN event_type = 'purchase' AND value < 200 THEN 1 END) AS INT) AS loop_count,
        CASE WHEN user_id % 2 = 0 THEN 'classification' ELSE 'regression' END AS task_type,
        CASE user_id % 3 WHEN 0 THEN 'builtin:orders_status'
             WHEN 1 THEN concat('uploads/user_', CAST(user_id AS STRING), '.csv')
             ELSE 'sample_data/customers.parquet' END AS data_source,
        CASE WHEN user_id % 2 = 0 THEN 'f1' ELSE 'rmse' END AS success_metric,
        CAST(CASE WHEN user_id % 2 = 0 THEN 0.8 ELSE 100.0 END AS DOUBLE) AS metric_threshold,
        CASE WHEN user_id % 2 = 0 THEN round(avg(value) / 250, 4) ELSE round(avg(value), 4) END AS metric_value,
        CAST(3 + user_id % 3 AS INT) AS max_loop_backs,
        CAST(CASE WHEN user_id % 5 = 0 THEN NULL ELSE 25 + user_id % 50 END AS INT) AS max_tuning_trials,
        count(CASE WHEN event_type = 'error' AND value >= 300 THEN 1 END) AS escalations
      FROM {events} GROUP BY user_id) t"""


# Report sections of the derived runs: one row per (run, event type) and the lists made of them.
_TYPES = """SELECT concat('run-', CAST(user_id AS STRING)) AS run_id, user_id, event_type, count(*) AS n,
  count(CASE WHEN value < 10 THEN 1 END) AS low, round(avg(value), 4) AS mean, max(value) AS top FROM {events} GROUP BY user_id, event_type"""
_AT = "CAST(row_number() OVER (PARTITION BY run_id ORDER BY event_type) - 1 AS INT) AS ord"
_PROFILED, _EXPLORED = "user_id % 7 <> 0", "user_id % 7 > 1"   # runs that got as far as this section
SECTION_SQL = {
    "profile": f"""SELECT run_id, CAST(sum(n) AS BIGINT) AS row_count, CAST(count(*) AS INT) AS column_count,
  CASE WHEN sum(low) = 0 THEN 'no gaps' END AS blocking_issue FROM ty WHERE {_PROFILED} GROUP BY run_id""",
    "column_schema": f"""SELECT run_id, {_AT}, event_type AS name, CASE WHEN top >= 300 THEN 'double' ELSE 'bigint' END AS dtype,
  round(CAST(100 AS DOUBLE) * low / n, 2) AS missing_pct, event_type = 'purchase' AS is_target FROM ty WHERE {_PROFILED}""",
    "cleaning_actions_taken": f"""SELECT run_id, {_AT}, event_type AS col, 'median_imputation' AS action,
  concat(CAST(low AS STRING), ' gaps') AS rationale FROM ty WHERE {_PROFILED} AND low > 2""",
    "class_balance": f"""SELECT run_id, {_AT}, event_type AS label, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY run_id), 4) AS share
  FROM ty WHERE {_PROFILED} AND user_id % 2 = 0""",
    "warnings": f"SELECT run_id, {_AT}, concat('few rows of ', event_type) AS v FROM ty WHERE {_PROFILED} AND n < 12",
    "outlier_flags": f"SELECT run_id, {_AT}, event_type AS v FROM ty WHERE {_PROFILED} AND top >= 300",
    "eda": f"SELECT run_id, concat(CAST(count(*) AS STRING), ' types') AS notes FROM ty WHERE {_EXPLORED} GROUP BY run_id",
    "correlation_summary": f"SELECT run_id, {_AT}, event_type AS feature, round(mean / 497, 4) AS corr FROM ty WHERE {_EXPLORED}",
    "engineered_features": f"""SELECT run_id, {_AT}, concat(event_type, '__x') AS name, 'product' AS rationale FROM ty
  WHERE {_EXPLORED} AND n >= 12""",
    "dropped_features": f"SELECT run_id, {_AT}, event_type AS name, 'few rows' AS rationale FROM ty WHERE {_EXPLORED} AND n < 12",
    "leakage_warnings": f"SELECT run_id, {_AT}, event_type AS v FROM ty WHERE {_EXPLORED} AND top >= 400",
    "data_quality_warnings": f"SELECT run_id, {_AT}, concat(event_type, ' has gaps') AS v FROM ty WHERE {_EXPLORED} AND low >= 3",
    "final_feature_names": f"SELECT run_id, {_AT}, concat(event_type, '__x') AS v FROM ty WHERE {_EXPLORED} AND n >= 12",
}
# Confusion counts of the classification runs, residuals of the others.
MATRIX_SQL = """SELECT concat('run-', CAST(user_id AS STRING)) AS run_id,
  count(CASE WHEN value < 100 AND event_type <> 'purchase' THEN 1 END) AS tn, count(CASE WHEN value < 100 AND event_type = 'purchase' THEN 1 END) AS fp,
  count(CASE WHEN value >= 100 AND event_type <> 'purchase' THEN 1 END) AS fn, count(CASE WHEN value >= 100 AND event_type = 'purchase' THEN 1 END) AS tp
FROM {events} WHERE user_id % 2 = 0 GROUP BY user_id"""
RESIDUAL_SQL = """SELECT concat('run-', CAST(user_id AS STRING)) AS run_id, round(avg(value), 4) AS mean, max(value) AS top
FROM {events} WHERE user_id % 2 = 1 GROUP BY user_id"""


def types(spark: SparkSession, sf: str) -> DataFrame:
    """One row per (run, event type): what the sections are made of."""
    return spark.sql(_TYPES, events=table(spark, sf, "events"))


def section(types: DataFrame, name: str) -> DataFrame:
    return types.sparkSession.sql(f"WITH ty AS (SELECT * FROM {{types}}) {SECTION_SQL[name]}", types=types)


def spark_form(sql: str) -> str:
    return sql


def duck_form(sql: str) -> str:
    return sql.replace("{events}", "events").replace("{part}", "part")


TYPES_CTE = ("ty", duck_form(_TYPES))


def history(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(HISTORY_SQL, events=table(spark, sf, "events"))


def trace(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(TRACE_SQL, events=table(spark, sf, "events"))


def trials(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(TRIALS_SQL, part=table(spark, sf, "part"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(RUNS_SQL, events=table(spark, sf, "events"))
