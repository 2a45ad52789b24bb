"""Cross-validated scoring and the seeded search, plus trial analytics.

Folds come from W3 (a ``fold`` column), so every run uses the same seeded, stratified folds.

One forest a fold serves every trial. It is grown with the most trees and the deepest level that any trial asks for, and every
node keeps its row count and label statistics, so the forest of a trial is contained in it: the first ``n_estimators`` trees, each cut
at ``max_depth`` and at nodes with fewer rows than ``min_samples_split``. A row walks each tree once and takes the values of all trials from
where it ends; rows that are equal in all features walk once for all of them. Metrics of labels are scored from counts of (trial, fold, label, prediction), which the
tasks make; for the others the predictions of all trials on all folds form one long table. One grouped metric scores either. Jobs and fits do not grow with the number of trials.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabml import spec as S
from tabml.functions.missing import quoted
from tabml.operators import metrics as M
from tabml.operators import train as T
from tabml.reports import TrialRecord, TuningResult
from tabml.session import scratch_path
from tabml.spec import ProblemSpec

#: Values that the walk of a block of rows holds at most (rows x trials x classes, rows x levels).
BLOCK_VALUES = 1 << 22


@dataclass
class Forest:
    """Nodes of a forest as arrays: children by place (-1: none), rows of the node, label shares (or the mean); roots by tree."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    rows: np.ndarray
    value: np.ndarray   # (nodes, classes), or (nodes, 1)

    def trials(self, x: np.ndarray, params: list[dict]) -> np.ndarray:
        """(trials, rows, classes): mean over a trial's trees of the value where its cut of the tree ends."""
        n = len(x)
        out = np.zeros((len(params), n, self.value.shape[1]))
        every = np.arange(n)
        deepest = max(p["max_depth"] for p in params)
        stops = np.array([p["n_estimators"] for p in params])
        order = np.argsort(-stops, kind="stable")   # most trees first, so those that still take part stand in front
        sums = np.zeros((n, len(params), self.value.shape[1]))
        depth, least = (np.array([params[i][k] for i in order]) for k in ("max_depth", "min_samples_split"))
        for j, (root, end) in enumerate(zip(self.roots, np.r_[self.roots[1:], len(self.left)])):
            live = [i for i, p in enumerate(params) if j < p["n_estimators"]]
            if live and end - root <= n:   # a table of the tree's nodes costs less than the rows' paths
                m = len(live)
                sums[:, :m] += self.value[self._cut(root, end, depth[:m], least[:m])][self._walk(x, root, deepest) - root]
                continue
            path = [np.full(n, root)]
            while len(path) <= deepest:
                at = path[-1]
                inner = self.left[at] >= 0
                if not inner.any():
                    break
                go = x[every, self.feature[at]] <= self.threshold[at]
                path.append(np.where(inner, np.where(go, self.left[at], self.right[at]), at))
            levels = np.array(path)
            rows = self.rows[levels]
            ends = {m: np.where((rows < m).any(0), (rows < m).argmax(0), len(levels) - 1) for m in {params[i]["min_samples_split"] for i in live}}
            for i in live:
                stop = np.minimum(ends[params[i]["min_samples_split"]], min(params[i]["max_depth"], len(levels) - 1))
                out[i] += self.value[levels[stop, every]]
        out[order] += sums.transpose(1, 0, 2)
        return out / np.array([min(p["n_estimators"], len(self.roots)) for p in params])[:, None, None]

    def _walk(self, x: np.ndarray, root: int, deepest: int) -> np.ndarray:
        """The node where each row ends in one tree."""
        at = np.full(len(x), root)
        live = np.arange(len(x)) if self.left[root] >= 0 else np.zeros(0, np.int64)
        for _ in range(deepest):
            if not len(live):
                break
            node = at[live]
            node = np.where(x[live, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            at[live] = node
            live = live[self.left[node] >= 0]
        return at

    def _cut(self, root: int, end: int, depth: np.ndarray, least: np.ndarray) -> np.ndarray:
        """(nodes of the tree, trials): where a row that reaches the node ends in the cut of each trial."""
        out = np.full((end - root, len(depth)), root)
        level, at = np.array([root]), 0
        while len(level := level[self.left[level] >= 0]):
            goes = (out[level - root] == level[:, None]) & (self.rows[level][:, None] >= least) & (at < depth)
            for child in (self.left[level], self.right[level]):
                out[child - root] = np.where(goes, child[:, None], out[level - root])
            level, at = np.concatenate([self.left[level], self.right[level]]), at + 1
        return out


def read_forest(spark: SparkSession, model, classes: int | None) -> Forest:
    """The nodes of a fitted forest, from its saved form (as large as the model, which the driver holds already)."""
    path = scratch_path(spark, "forest")
    model.write().save(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.rawCount",
                                                     "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex",
                                                     "nodeData.split.leftCategoriesOrThreshold", "nodeData.split.numCategories")
    t = rows.orderBy("treeID", "id").toArrow().combine_chunks()
    col = lambda c: np.asarray(t.column(c))
    if (col("numCategories") > 0).any():
        raise ValueError("a split on categories: features are plain numbers here")
    tree, ids = col("treeID"), col("id")
    first = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]])
    base = first[np.searchsorted(tree[first], tree)]   # ids count the nodes of a tree from 0
    child = lambda c: np.where(col(c) >= 0, base + col(c), -1)
    cuts = t.column("leftCategoriesOrThreshold").combine_chunks()
    have = np.diff(np.asarray(cuts.offsets)) > 0
    threshold = np.zeros(len(ids))
    threshold[have] = np.asarray(cuts.flatten())[: have.sum()]
    if classes is None:
        value = col("prediction")[:, None]
    else:
        value = np.asarray(t.column("impurityStats").combine_chunks().flatten()).reshape(len(ids), classes)
        value = value / value.sum(1, keepdims=True)
    return Forest(first + 0, np.maximum(col("featureIndex"), 0), threshold, child("leftChild"), child("rightChild"), col("rawCount"), value)


def _vectors(data: DataFrame) -> DataFrame:
    return data.select(vector_to_array(T.FEATURES).alias("x"), F.col(T.LABEL).cast("double").alias("label"), F.col("fold").cast("int").alias("fold"))


def trial_predictions(data: DataFrame, forests: dict[int, Forest], params: list[dict], classification: bool) -> DataFrame:
    """(trial, fold, label, prediction, score) of every row for every trial, by the forest of the row's fold (which did not see it)."""
    shared = data.sparkSession.sparkContext.broadcast((forests, params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, ps = shared.value
        k = max(f.value.shape[1] for f in trained.values())
        step = max(1, BLOCK_VALUES // max(len(ps) * k, 2 + max(p["max_depth"] for p in ps)))
        for b in batches:
            fold, label = np.asarray(b.column("fold")), np.asarray(b.column("label"))
            x = np.asarray(b.column("x").flatten()).reshape(b.num_rows, -1)
            for f in np.unique(fold):
                mine = np.flatnonzero(fold == f)
                for i in range(0, len(mine), step):
                    at = mine[i: i + step]
                    got = trained[int(f)].trials(x[at], ps)
                    best = got.argmax(2).astype(np.float64) if classification else got[:, :, 0]
                    score = got[:, :, 1] if classification and k == 2 else np.zeros(best.shape)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.repeat(np.arange(len(ps), dtype=np.int32), len(at))), pa.array(np.full(best.size, f, dtype=np.int32)),
                        pa.array(np.tile(label[at], len(ps))), pa.array(best.ravel()), pa.array(score.ravel())],
                        ["trial", "fold", "label", "prediction", "score"])

    return _vectors(data).mapInArrow(run, "trial int, fold int, label double, prediction double, score double")


def _distinct(rows: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that differ (by their bytes), with the sums of n."""
    rows = np.ascontiguousarray(rows)
    _, first, which = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return rows[first], np.bincount(which.ravel(), weights=n, minlength=len(first))


def trial_cells(data: DataFrame, forests: dict[int, Forest], params: list[dict]) -> DataFrame:
    """(trial, fold, label, prediction, n): ``trial_predictions`` of a classification counted inside the tasks. A task holds rows that differ only."""
    shared = data.sparkSession.sparkContext.broadcast((forests, params))
    k = max(f.value.shape[1] for f in forests.values())
    step = max(1, BLOCK_VALUES // max(len(params) * k, 2 + max(p["max_depth"] for p in params)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained, ps = shared.value
        rows, n = None, np.zeros(0)   # fold, label and features of what is held

        def counted():
            for i in range(0, len(rows), step):
                for f in np.unique(rows[i: i + step, 0]):
                    at = i + np.flatnonzero(rows[i: i + step, 0] == f)
                    best = trained[int(f)].trials(rows[at, 2:], ps).argmax(2)
                    labels, label = np.unique(rows[at, 1], return_inverse=True)
                    cell = (np.arange(len(ps))[:, None] * len(labels) + label) * k + best
                    cells, which = np.unique(cell, return_inverse=True)
                    sums = np.bincount(which.ravel(), weights=np.tile(n[at], len(ps)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array((cells // k // len(labels)).astype(np.int32)), pa.array(np.full(len(cells), f, dtype=np.int32)),
                        pa.array(labels[cells // k % len(labels)]), pa.array((cells % k).astype(np.float64)), pa.array(sums.astype(np.int64))],
                        ["trial", "fold", "label", "prediction", "n"])

        for b in batches:
            new = np.column_stack([np.asarray(b.column("fold")).astype(np.float64), np.asarray(b.column("label")),
                                   np.asarray(b.column("x").flatten()).reshape(b.num_rows, -1)])
            rows, n = new if rows is None else np.concatenate([rows, new]), np.r_[n, np.ones(len(new))]
            if len(rows) >= step:
                rows, n = _distinct(rows, n)
                if 2 * len(rows) >= step:
                    yield from counted()
                    rows, n = None, np.zeros(0)
        if rows is not None:
            rows, n = _distinct(rows, n)
            yield from counted()

    return _vectors(data).mapInArrow(run, "trial int, fold int, label double, prediction double, n long")


def draw_params(n_trials: int, seed: int = S.SPLIT_SEED) -> list[dict]:
    """Seeded uniform draws over the search space (the adaptive sampler is not rebuilt)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n_trials):
        out.append({k: rng.randint(lo, hi) for k, (lo, hi) in S.SEARCH_SPACE.items()})
    return out


def _cv(X: DataFrame, spec: ProblemSpec, features: list[str], param_list: list[dict], parallelism: int = 4) -> list[float]:
    """Mean fold score of each parameter set. The (vector, label, fold) frame is persisted once; a fold's forest is fitted on the other folds."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import StorageLevel

    S.cv_scorer(spec.success_metric)   # a metric without a scorer stops here
    spark = X.sparkSession
    full = [{**T.DEFAULT_PARAMS, **p} for p in param_list]
    base = X.select(*map(quoted, (*features, spec.target_column, "fold"))).persist(StorageLevel.MEMORY_AND_DISK)
    labels = T.class_labels(base, spec.target_column) if spec.is_classification else None
    data = T.assembler(features).transform(T.with_safe_names(T.with_label(base, spec, labels), features)) \
        .select(T.FEATURES, T.LABEL, "fold").persist(StorageLevel.MEMORY_AND_DISK)
    folds = sorted(r[0] for r in data.select("fold").distinct().collect())
    base.unpersist()
    whole = {"n_estimators": max(p["n_estimators"] for p in full), "max_depth": max(p["max_depth"] for p in full), "min_samples_split": 2}

    def grow(f: int) -> Forest:
        model = T.forest(spec, whole).fit(data.where(F.col("fold") != f))
        return read_forest(spark, model, len(labels) if spec.is_classification else None)

    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(folds)))) as pool:
        forests = dict(zip(folds, pool.map(grow, folds)))
    if spec.success_metric in M.LABEL_METRICS:
        by_fold = M.grouped_metric(trial_cells(data, forests, full), spec.success_metric, "label", "prediction", group=["trial", "fold"], weight="n")
    else:
        preds = trial_predictions(data, forests, full, spec.is_classification)
        by_fold = M.grouped_metric(preds, spec.success_metric, "label", "prediction", "score", ["trial", "fold"])
    got = {r["trial"]: r["cv"] for r in by_fold.groupBy("trial").agg(F.avg("score").alias("cv")).collect()}   # one row a trial
    data.unpersist()
    return [got[i] for i in range(len(full))]


def cv_score(X: DataFrame, spec: ProblemSpec, features: list[str], params: dict) -> float:
    """M5: mean of the per-fold metric of one parameter set; X carries ``fold``."""
    return float(_cv(X, spec, features, [params], parallelism=S.CV_FOLDS)[0])


def tune_hyperparameters(X: DataFrame, spec: ProblemSpec, features: list[str], n_trials: int | None = None,
                         parallelism: int = 4) -> TuningResult:
    """M6 + W5 + A24 for one run; every trial is kept."""
    n = n_trials or (spec.constraints.max_tuning_trials or S.DEFAULT_TRIALS)
    params = draw_params(n)
    scores = _cv(X, spec, features, params, parallelism=parallelism)
    history = [TrialRecord(i, p, float(s)) for i, (p, s) in enumerate(zip(params, scores))]
    best = max(history, key=lambda t: (t.score, -t.trial_number))
    conv = converged([t.score for t in history])
    notes = ("The last fifth of the trials brought no better score." if conv
             else "A better score came in the last fifth of the trials; allow more of them.")
    return TuningResult(best_params=dict(best.params), best_cv_score=best.score,
                        metric_optimized=S.cv_scorer(spec.success_metric), search_history=history,
                        converged=conv, search_budget_used=len(history), search_budget_total=n,
                        convergence_notes=notes)


def converged(scores: list[float]) -> bool:
    """W5 for one list: trials before the last max(1, n // 5) reach the overall best (within 1e-9)."""
    if not scores:
        return False
    tail = max(1, len(scores) // 5)
    earlier = scores[:-tail]
    return bool(earlier) and max(earlier) >= max(scores) - S.PLATEAU_TOLERANCE


def convergence_table(trials: DataFrame, run: str = "run_id") -> DataFrame:
    """W5 over many runs: (run_id, n_trials, best_score, converged). ``trial_number`` is 0..n-1."""
    per = trials.groupBy(run).agg(F.count(F.lit(1)).alias("n_trials"), F.max("score").alias("best_score"))
    tail = F.greatest(F.lit(1), F.floor(F.col("n_trials") / 5))
    early = (trials.join(per, run).where(F.col("trial_number") < F.col("n_trials") - tail)
             .groupBy(run).agg(F.max("score").alias("early_best")))
    return (per.join(early, run, "left")
            .select(run, "n_trials", "best_score",
                    F.coalesce(F.col("early_best") >= F.col("best_score") - S.PLATEAU_TOLERANCE,
                               F.lit(False)).alias("converged")))


def best_trial_table(trials: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run, the max score; the first trial on ties."""
    best = F.max_by(F.struct("trial_number", "score"), F.struct(F.col("score"), -F.col("trial_number")))
    return trials.groupBy(run).agg(best.alias("b")).select(run, F.col("b.trial_number").alias("best_trial"),
                                                           F.col("b.score").alias("best_score"))
