"""Evaluation metrics as aggregates over (label, prediction[, score]) columns.

Everything is reduced early: a confusion table has classes x classes rows, so per-class
arithmetic happens on a small table. AUC orders distinct scores with a range-partitioned sort;
no step sorts all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from tabml import spec as S
from tabml.session import ensure_checkpoint_dir


def _g(group: list[str] | None) -> list[str]:
    return list(group or [])


SMALL_TABLE_ROWS = 100_000
MAX_MATRIX_CLASSES = 10_000   # a zero-filled matrix has classes^2 cells; labels per group are checked below this


LABEL_METRICS = ("accuracy", "f1", "precision", "recall")   # of labels and predictions alone, so rows may come counted


def pair_counts(df: DataFrame, label: str, pred: str, group: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """The only pass over the rows: (group..., actual, predicted, n) with map-side combine. ``weight``: how many rows a row stands for.

    The result has groups x classes x classes rows; it is materialized once (as a local table when it
    has at most SMALL_TABLE_ROWS rows, else persisted) so every later use reads it, not the rows."""
    g = _g(group)
    counts = df.groupBy(*g, F.col(label).alias("actual"), F.col(pred).alias("predicted")).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))
    rows = counts.limit(SMALL_TABLE_ROWS + 1).collect()
    if len(rows) <= SMALL_TABLE_ROWS:
        out = df.sparkSession.createDataFrame(rows, counts.schema)
        out._tabml_rows = rows  # the same small table, already on the driver
        return out
    from pyspark import StorageLevel
    return counts.persist(StorageLevel.MEMORY_AND_DISK)


def label_union(counts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Labels present in actual or predicted (per group), from the small count table."""
    g = _g(group)
    return (counts.select(*g, F.col("actual").alias("lbl")).unionByName(counts.select(*g, F.col("predicted").alias("lbl")))
            .where(F.col("lbl").isNotNull()).distinct())


def confusion_cells(df: DataFrame, label: str, pred: str, group: list[str] | None = None,
                    counts: DataFrame | None = None) -> DataFrame:
    """A17 as cells: (group..., actual, predicted, row_idx, col_idx, count); labels = sorted union of both
    sides; zero-filled. One partial aggregate over the rows; the grid is built on the label table."""
    g = _g(group)
    counts = counts if counts is not None else pair_counts(df, label, pred, group)
    labels = label_union(counts, group)
    widest = labels.groupBy(*g).count().agg(F.max("count")).first()[0] or 0
    if widest > MAX_MATRIX_CLASSES:
        raise ValueError(f"{widest} classes: too many for a confusion matrix (limit {MAX_MATRIX_CLASSES})")
    # per group: the sorted label list (bounded above); per (group, actual): predicted -> n
    labs = labels.groupBy(*g).agg(F.array_sort(F.collect_list("lbl")).alias("labs"))
    known = counts.where(F.col("actual").isNotNull() & F.col("predicted").isNotNull())
    by_row = known.groupBy(*g, "actual").agg(F.map_from_entries(F.collect_list(F.struct("predicted", "n"))).alias("m"))
    # one row per actual label (zero rows included), expanded over the label list into its cells
    rows = labels.withColumnRenamed("lbl", "actual").join(by_row, g + ["actual"], "left")
    if g:
        rows = rows.join(labs, g)
    else:   # one list of at most MAX_MATRIX_CLASSES labels: an array literal, no join
        first = labs.first()
        rows = rows.withColumn("labs", F.lit(list(first["labs"]) if first else [])
                               .cast(ArrayType(labels.schema["lbl"].dataType)))
    return (rows.select(*g, "actual", "m", (F.array_position("labs", F.col("actual")) - 1).cast("int").alias("row_idx"),
                        F.posexplode("labs").alias("col_idx", "predicted"))
            .select(*g, "actual", "predicted", "row_idx", "col_idx",
                    F.coalesce(F.try_element_at("m", F.col("predicted")), F.lit(0)).cast("long").alias("count")))


def confusion_matrix(df: DataFrame, label: str, pred: str) -> list[list[int]]:
    """Nested matrix, rows = actual, cols = predicted (classes x classes values to the driver)."""
    cells = confusion_cells(df, label, pred).collect()
    k = 1 + max((c["row_idx"] for c in cells), default=-1)
    m = [[0] * k for _ in range(k)]
    for c in cells:
        m[c["row_idx"]][c["col_idx"]] = c["count"]
    return m


def matrix_cells(matrix: list[list[int]] | None):
    """F12 flatten: [(row, col, count)]; None stays None (absent, not empty)."""
    if matrix is None:
        return None
    return [(i, j, int(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)]


def accuracy(df: DataFrame, label: str, pred: str, group: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Share of rows whose prediction equals the label."""
    g = _g(group)
    if weight:
        hit = F.col(label) == F.col(pred)
        return df.groupBy(*g).agg(F.try_divide(F.sum(F.when(hit, F.col(weight)).when(~hit, F.lit(0))).cast("double"),
                                               F.sum(F.when(hit.isNotNull(), F.col(weight)))).alias("accuracy"))
    return df.groupBy(*g).agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def macro_prf(df: DataFrame, label: str, pred: str, group: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Unweighted means over the label union of per-class precision, recall and F1; 0/0 -> 0.

    F1 per class is 2 tp / (actual + predicted), the same value as 2PR/(P+R) where defined. The rows
    are read once (pair counts); per-label totals come from the small count table."""
    g = _g(group)
    counts = pair_counts(df, label, pred, group, weight)
    small = getattr(counts, "_tabml_rows", None)
    if small is not None:   # bounded table on the driver: per-group arithmetic, no further jobs
        by: dict = {}
        for r in small:
            key = tuple(r[c] for c in g)
            by.setdefault(key, {})[(r["actual"], r["predicted"])] = r["n"]
        out = []
        for key, cnt in by.items():
            m = prf_from_counts(cnt)
            out.append((*key, float(m["precision"]), float(m["recall"]), float(m["f1"])))
        schema = counts.select(*g).schema.simpleString()[len("struct<"):-1]
        schema = (schema + "," if schema else "") + "precision:double,recall:double,f1:double"
        return df.sparkSession.createDataFrame(out, "struct<" + schema + ">")
    labels = label_union(counts, group)
    rows = counts.groupBy(*g, F.col("actual").alias("lbl")).agg(F.sum("n").alias("n_actual"))
    cols = counts.groupBy(*g, F.col("predicted").alias("lbl")).agg(F.sum("n").alias("n_pred"))
    diag = counts.where(F.col("actual") == F.col("predicted")).select(*g, F.col("actual").alias("lbl"),
                                                                      F.col("n").alias("tp"))
    per = labels.join(diag, g + ["lbl"], "left").join(rows, g + ["lbl"], "left").join(cols, g + ["lbl"], "left")
    z = F.lit(0.0)
    tp = F.coalesce(F.col("tp"), F.lit(0))
    na = F.coalesce(F.col("n_actual"), F.lit(0))
    npred = F.coalesce(F.col("n_pred"), F.lit(0))
    p = F.coalesce(F.try_divide(tp, npred), z)
    r = F.coalesce(F.try_divide(tp, na), z)
    f1 = F.coalesce(F.try_divide(2 * tp, na + npred), z)
    return per.groupBy(*g).agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f1).alias("f1"))


def roc_auc(df: DataFrame, label: str, score: str, positive=1, group: list[str] | None = None) -> DataFrame:
    """Exact ROC AUC with tied scores at half weight (= trapezoid rule): (group..., roc_auc), one row without a group. Null
    where a group has one class only; rows without a score do not count.

    Distinct (group, score) pairs are range-partitioned by a global sort, so neither a group nor all scores meet in one task.
    Negatives below a score are those of its group in earlier partitions (one row for each partition a group reaches into, summed
    by a window) and a running sum inside the partition. The layout is written once (checkpoint), as both uses need the same."""
    g = _g(group)
    d = (df.where(F.col(score).isNotNull()).groupBy(*g, F.col(score).alias("__s"))
         .agg(F.sum((F.col(label) == F.lit(positive)).cast("long")).alias("__pos"),
              F.sum((F.col(label) != F.lit(positive)).cast("long")).alias("__neg")))
    ensure_checkpoint_dir(df.sparkSession)
    d = d.orderBy(*g, "__s").withColumn("__pid", F.spark_partition_id()).checkpoint(eager=True)
    earlier = Window.partitionBy(*g).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy(*g, "__pid").agg(F.sum("__neg").alias("__n"))
    per = per.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(g)], F.col("__pid").alias("__at"),
                     F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__pid", *g).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__below", F.coalesce(F.sum("__neg").over(inside), F.lit(0)))
    on = F.col("__pid") == F.col("__at")
    for i, c in enumerate(g):
        on = on & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    hits = F.sum(F.col("__pos") * (F.col("__off") + F.col("__below") + F.col("__neg") / 2.0))
    return d.join(per, on).groupBy(*g).agg(F.try_divide(hits, F.sum("__pos").cast("double") * F.sum("__neg")).alias("roc_auc"))


def is_binary(df: DataFrame, label: str) -> bool:
    return df.select(label).where(F.col(label).isNotNull()).distinct().limit(3).count() == 2


def regression_metrics(df: DataFrame, y: str, pred: str, group: list[str] | None = None) -> DataFrame:
    """A21 + A22: rmse, mae, r2 (zero-variance target: 1 if perfect else 0), residual mean and
    population std, in one aggregate."""
    g = _g(group)
    e = F.col(y) - F.col(pred)
    agg = df.groupBy(*g).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
                             F.sum(e * e).alias("ss_res"), (F.count(F.col(y)) * F.var_pop(F.col(y))).alias("ss_tot"),
                             F.avg(e).alias("residual_mean"), F.stddev_pop(e).alias("residual_std"))
    r2 = F.when(F.col("ss_tot") == 0, F.when(F.col("ss_res") == 0, 1.0).otherwise(0.0)) \
          .otherwise(1 - F.col("ss_res") / F.col("ss_tot"))
    return agg.select(*g, "rmse", "mae", r2.alias("r2"), "residual_mean", "residual_std")


def prf_from_counts(counts: dict) -> dict:
    """Accuracy and macro precision / recall / F1 from cell counts (same rules as ``macro_prf``)."""
    labels = sorted({k for pair in counts for k in pair if k is not None})
    n = sum(counts.values())
    tp = {c: counts.get((c, c), 0) for c in labels}
    n_act = {c: sum(v for (a, _), v in counts.items() if a == c) for c in labels}
    n_pred = {c: sum(v for (_, p), v in counts.items() if p == c) for c in labels}
    k = len(labels) or 1
    return {"accuracy": (sum(tp.values()) / n) if n else 0.0,
            "precision": sum(tp[c] / n_pred[c] if n_pred[c] else 0.0 for c in labels) / k,
            "recall": sum(tp[c] / n_act[c] if n_act[c] else 0.0 for c in labels) / k,
            "f1": sum(2 * tp[c] / (n_act[c] + n_pred[c]) if n_act[c] + n_pred[c] else 0.0 for c in labels) / k}


def macro_values(df: DataFrame, label: str, pred: str) -> dict[str, float]:
    """Accuracy and macro precision / recall / F1 of one evaluation, over all of its cells."""
    r = macro_prf(df, label, pred).first()
    out = {k: float(r[k] or 0.0) if r else 0.0 for k in ("precision", "recall", "f1")}
    out["accuracy"] = float(accuracy(df, label, pred).first()["accuracy"] or 0.0)
    return out


def classification_metrics(df: DataFrame, label: str, pred: str, score: str | None = None) -> dict:
    """All metrics of a classification evaluation as a dict (roc_auc only for a binary target)."""
    prf = macro_values(df, label, pred)
    out = {"f1": float(prf["f1"]), "accuracy": float(prf["accuracy"]),
           "precision": float(prf["precision"]), "recall": float(prf["recall"])}
    if score is not None and is_binary(df, label):
        pos = df.select(F.max(label)).first()[0]
        out["roc_auc"] = float(roc_auc(df, label, score, positive=pos).first()["roc_auc"])
    return out


def grouped_metric(df: DataFrame, metric: str, label: str, pred: str, score: str | None = None,
                   group: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(group..., score): one metric of every group in one plan, signed like its CV scorer (error metrics negated). ``weight`` as in
    ``pair_counts``, for LABEL_METRICS."""
    g = _g(group)
    if metric in ("f1", "precision", "recall"):
        m = macro_prf(df, label, pred, g, weight).select(*g, F.col(metric).alias("score"))
    elif metric == "accuracy":
        m = accuracy(df, label, pred, g, weight).select(*g, F.col("accuracy").alias("score"))
    elif metric in ("rmse", "mae", "r2"):
        sign = -1.0 if metric in ("rmse", "mae") else 1.0
        m = regression_metrics(df, label, pred, g).select(*g, (F.col(metric) * sign).alias("score"))
    elif metric == "roc_auc":
        m = roc_auc(df, label, score, group=g).select(*g, F.col("roc_auc").alias("score"))
    else:
        S.cv_scorer(metric)  # raises
    return m


def fold_metric(df: DataFrame, metric: str, label: str, pred: str, score: str | None = None, fold: str = "fold") -> DataFrame:
    """Per-fold value of one metric."""
    return grouped_metric(df, metric, label, pred, score, [fold])


def cv_mean(df: DataFrame, metric: str, label: str, pred: str, score: str | None = None,
            fold: str = "fold") -> DataFrame:
    """Mean of the per-fold metric (not pooled)."""
    return fold_metric(df, metric, label, pred, score, fold).agg(F.avg("score").alias("cv_score"))


def matrix_total(cells: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Test samples = sum of cells; TN/FP/FN/TP for a 2 x 2 matrix (null otherwise)."""
    g = _g(group)
    two = F.max("row_idx") == 1

    def cell(i, j) -> Column:
        return F.when(two, F.sum(F.when((F.col("row_idx") == i) & (F.col("col_idx") == j), F.col("count"))
                                 .otherwise(0)))
    return cells.groupBy(*g).agg(F.sum("count").alias("total"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"),
                                 cell(1, 0).alias("fn"), cell(1, 1).alias("tp"))
