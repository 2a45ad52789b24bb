"""The one seeded split, train-only imputation, and CV folds.

Row order for both split and folds is ``md5(key || ':42')`` (then the key): a pure function of the
row, so every engine and every re-run gives the same rows. Nothing sorts a class in one task: digits of the hash cut
it into cells, cell counts are small tables, and rows are ranked inside cells only. The split looks at four digits
of every class and at four more inside its cut-off cell, so the rows it ranks are one in 2**32 of a class. The folds rank
every row; they take as many digits as keep a cell at about CELL_ROWS rows, whatever the table holds, and sum
the cells before one digit group at a time.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabml import spec as S
from tabml.functions.dtypes import BOOL, CATEGORICAL, DATETIME, NUMERIC, column_classes
from tabml.functions.missing import nullify, quoted
from tabml.operators.profile import apply_fills, dedup_rows, drop_missing_target, median_fills, mode_fills
from tabml.spec import ProblemSpec

HASH = "__h"
BUCKET = "__bucket"
GROUP = "__grp"
ROW_KEY = "__row"
PART = "__part"
BUCKET_HEX_DIGITS = 4          # 65,536 cells of a digit group
MAX_BROADCAST_GROUPS = 100_000  # the per-class cut-off table is broadcast only below this size
CELL_ROWS = 4096               # rows that a cell of the folds holds on average, at most


def key_text(df: DataFrame, key: str | None) -> Column:
    """Text form of the split key; without a key, a 64-bit hash of every column (rows are
    distinct after dedup, so this orders them; differs between engines, so rows-only checks)."""
    if key is not None:
        return F.col(key).cast("string")
    return F.xxhash64(*[F.col(quoted(c)) for c in df.columns]).cast("string")


def with_row_key(df: DataFrame, key: str | None = None) -> DataFrame:
    """Carry the split's key (or the hash of the whole deduplicated row) as ROW_KEY, so that the folds of a run are dealt by rows. The
    feature values alone repeat, and equal ones would be ranked in one cell."""
    return df.withColumn(ROW_KEY, key_text(df.drop("is_test"), key))


def with_hash_order(df: DataFrame, key: str | None, seed: int = S.SPLIT_SEED) -> DataFrame:
    kt = key_text(df, key)
    h = F.md5(F.concat(kt, F.lit(f":{seed}")))
    # non-nullable bucket: no inferred not-null filter is pushed into one plan branch only, so the
    # branches reading the same input stay identical and Spark reuses their exchanges
    return df.withColumn(HASH, h).withColumn(
        BUCKET, F.coalesce(F.conv(F.substring(h, 1, BUCKET_HEX_DIGITS), 16, 10).cast("int"), F.lit(0)))


def _tie(key: str | None) -> list[Column]:
    return [F.col(HASH)] + ([F.col(key)] if key is not None else [])


def test_quotas(counts: dict, n_test_total: int | None = None, stratified: bool = True) -> dict:
    """Per-group test quota. Total test rows = ceil(0.2 n). Stratified: the train side is shared by
    largest remainder (exact integer arithmetic), ties to the smaller label; test = count - train."""
    n = sum(counts.values())
    if n == 0:
        return {}
    n_test = n_test_total if n_test_total is not None else int(math.ceil(S.TEST_SIZE * n))
    if not stratified:
        (g,) = counts.keys()
        return {g: n_test}
    n_train = n - n_test
    base = {g: (n_train * c) // n for g, c in counts.items()}
    rem = {g: (n_train * c) % n for g, c in counts.items()}
    left = n_train - sum(base.values())
    for g in sorted(counts, key=lambda g: (-rem[g], str(g)))[:left]:
        base[g] += 1
    return {g: counts[g] - base[g] for g in counts}


def _groups(df: DataFrame, spec: ProblemSpec) -> tuple[DataFrame, Column]:
    if spec.is_classification:
        return df.withColumn(GROUP, F.col(spec.target_column)), F.col(GROUP)
    # one class 0, as a column of the row (buckets are >= 0) rather than a literal: a literal key is
    # folded away, which would turn the per-class joins below into nested-loop joins
    return df.withColumn(GROUP, F.when(F.col(BUCKET) >= 0, F.lit(0)).otherwise(F.lit(1))), F.col(GROUP)


def _quota_frame(spark, quotas: dict, dtype) -> DataFrame:
    rows = [(g, int(q)) for g, q in quotas.items()]
    return spark.createDataFrame(rows, f"{GROUP} {dtype.simpleString()}, __quota long")


def quota_table(cells: DataFrame, stratified: bool) -> DataFrame:
    """Per-class test quotas (``__grp``, ``__quota``) from (``__grp``, ``__bucket``, n) cells, in the
    plan: the rule of ``test_quotas`` (ceil(0.2 n) test rows; train side shared by largest remainder,
    ties to the smaller label text) with exact decimal products, so it holds for any row count.

    The windows run over one row per class; more than MAX_BROADCAST_GROUPS classes fails the job
    (the table is then broadcast, so its size must be bounded)."""
    everything = Window.partitionBy()
    cls = (cells.groupBy(GROUP).agg(F.sum("n").alias("__c"))
           .withColumn("__k", F.count(F.lit(1)).over(everything)))
    cls = cls.where(F.when(F.col("__k") > MAX_BROADCAST_GROUPS,
                           F.raise_error(F.lit(f"more than {MAX_BROADCAST_GROUPS} classes: too many for a "
                                               "stratified split"))).isNull())
    n = F.sum("__c").over(everything)
    cls = cls.withColumn("__n", n).withColumn("__n_test", F.ceil(F.lit(S.TEST_SIZE) * F.col("__n").cast("double")))
    if not stratified:
        return cls.select(GROUP, F.col("__n_test").cast("long").alias("__quota"))
    d = "CAST({} AS DECIMAL(38,0))"
    prod = f"{d.format('__n - __n_test')} * {d.format('__c')}"
    cls = cls.selectExpr(GROUP, "__c", "__n - __n_test AS __ntr",
                         f"CAST({prod} div {d.format('__n')} AS BIGINT) AS __tr",
                         f"{prod} % {d.format('__n')} AS __rem")
    cls = (cls.withColumn("__left", F.col("__ntr") - F.sum("__tr").over(everything))
           .withColumn("__rr", F.row_number().over(Window.orderBy(F.col("__rem").desc(), F.col(GROUP).cast("string")))))
    bonus = F.when(F.col("__rr") <= F.col("__left"), F.lit(1)).otherwise(F.lit(0))
    return cls.select(GROUP, (F.col("__c") - F.col("__tr") - bonus).cast("long").alias("__quota"))


def train_test_split(df: DataFrame, spec: ProblemSpec, key: str | None = None,
                     method: str = "bucketed") -> DataFrame:
    """Adds ``is_test``; 20 % test rows, stratified by label for classification.

    The input should already be target-complete and deduplicated (``prepare_for_split``), which is what makes its hashes
    differ. (class, cell) counts give each class's quota and cut-off cell, counts inside that cell its cut-off part; only
    the rows of that part are ranked. One lazy plan: its count branches and row branch share the input's shuffle.
    ``method="window"`` ranks each class in one task instead: the plain form that the tests compare with."""
    spark = df.sparkSession
    base, grp = _groups(with_hash_order(df, key), spec)
    out_cols = df.columns + ["is_test"]
    if method == "window":
        counts = {r[GROUP]: r["n"] for r in base.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n")).collect()}
        qf = _quota_frame(spark, test_quotas(counts, stratified=spec.is_classification), base.schema[GROUP].dataType)
        w = Window.partitionBy(GROUP).orderBy(*_tie(key))
        return (base.join(qf, GROUP).withColumn("__rn", F.row_number().over(w))
                .withColumn("is_test", F.col("__rn") <= F.col("__quota")).select(*map(quoted, out_cols)))
    base = base.withColumn(PART, F.coalesce(F.conv(F.substring(HASH, BUCKET_HEX_DIGITS + 1, BUCKET_HEX_DIGITS), 16, 10).cast("int"), F.lit(0)))
    cells = base.groupBy(GROUP, BUCKET).agg(F.count(F.lit(1)).alias("n"))
    cut = _cut_offs(cells, quota_table(cells, spec.is_classification), BUCKET, "__cut")
    inside = base.select(GROUP, BUCKET, PART).join(F.broadcast(cut), GROUP).where(F.col(BUCKET) == F.col("__cut"))
    parts = inside.groupBy(GROUP, PART).agg(F.count(F.lit(1)).alias("n"))
    cut = cut.join(_cut_offs(parts, cut.select(GROUP, F.col("__need").alias("__quota")), PART, "__cut_part")
                   .withColumnRenamed("__need", "__need_part"), GROUP)
    tagged = base.join(F.broadcast(cut), GROUP)   # one row per class, bounded (checked by quota_table)
    edge = (F.col(BUCKET) == F.col("__cut")) & (F.col(PART) == F.col("__cut_part"))
    before = (F.col(BUCKET) < F.col("__cut")) | ((F.col(BUCKET) == F.col("__cut")) & (F.col(PART) < F.col("__cut_part")))
    clear = tagged.where(~edge).withColumn("is_test", before)
    w = Window.partitionBy(GROUP).orderBy(*_tie(key))
    ranked = tagged.where(edge).withColumn("__rn", F.row_number().over(w)).withColumn("is_test", F.col("__rn") <= F.col("__need_part"))
    return clear.select(*map(quoted, out_cols)).unionByName(ranked.select(*map(quoted, out_cols)))


def _cut_offs(cells: DataFrame, quotas: DataFrame, cell: str, name: str) -> DataFrame:
    """Per class: the first cell whose running count reaches the quota (``name``), and how many of its rows
    (in hash order) are test rows (``__need``)."""
    wb = Window.partitionBy(GROUP).orderBy(cell).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = cells.withColumn("cum", F.sum("n").over(wb)).join(quotas, GROUP)
    return (cum.where(F.col("cum") >= F.col("__quota"))
            .groupBy(GROUP).agg(F.min_by(F.struct(F.col(cell).alias("b"), (F.col("__quota") - F.col("cum") + F.col("n"))
                                                  .alias("need")), F.col(cell)).alias("c"))
            .select(GROUP, F.col("c.b").cast("int").alias(name), F.col("c.need").cast("long").alias("__need")))


def prepare_for_split(df: DataFrame, spec: ProblemSpec) -> DataFrame:
    """Target-missing rows and exact duplicates go before the split (removed, not learned from)."""
    return dedup_rows(drop_missing_target(nullify(df), spec.target_column))


def train_only_fills(split_df: DataFrame, spec: ProblemSpec) -> dict:
    """W2 statistics: median / mode learned on train rows for every column with gaps on either side."""
    target = spec.target_column
    classes = {n: c for n, c, _ in column_classes(split_df)}
    cols = [c for c in split_df.columns if c not in (target, "is_test")]
    gaps = split_df.agg(*[F.max(F.col(quoted(c)).isNull().cast("int")).alias(c) for c in cols]).first().asDict()
    train = split_df.where(~F.col("is_test"))
    num = [c for c in cols if gaps[c] and classes[c] == NUMERIC]
    cat = [c for c in cols if gaps[c] and classes[c] in (CATEGORICAL, BOOL)]
    fills = {}
    fills.update({c: v for c, v in (median_fills(train, num) if num else {}).items() if v is not None})
    fills.update({c: v for c, v in (mode_fills(train, cat) if cat else {}).items() if v is not None})
    return fills


def split_and_clean(df: DataFrame, spec: ProblemSpec, key: str | None = None,
                    method: str = "bucketed", persist: bool = True, prepared: bool = False) -> tuple[DataFrame, dict]:
    """W1 + W2: one frame with ``is_test``; fills learned on train rows, applied to both sides.
    ``prepared=True``: ``df`` is already target-complete and deduplicated (e.g. from the profile)."""
    prepared = df if prepared else prepare_for_split(df, spec)
    if persist and not prepared.is_cached:
        prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    split = train_test_split(prepared, spec, key=key, method=method)
    if persist:
        split = split.persist(StorageLevel.MEMORY_AND_DISK)
    fills = train_only_fills(split, spec)
    return apply_fills(split, fills), fills


def _rows_at_most(df: DataFrame) -> int:
    """A bound on the rows from the sizes of what the plan reads (two bytes a row and more), or their count where those are unknown. It only
    sets how finely the cells are cut."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return size // 2 if size < 1 << 60 else df.count()


def fold_digits(rows: int) -> int:
    """Hex digits of the hash that cut ``rows`` into cells of CELL_ROWS rows or fewer on average (and not under a 16th of that)."""
    digits = 1
    while digits < 32 and rows > CELL_ROWS * 16**digits:
        digits += 1
    return digits


def cell_offsets(cells: DataFrame, digits: int) -> DataFrame:
    """(``__grp``, ``__cell``, ``__off``): rows of a class before each cell, from (``__grp``, ``__cell``, n) with cells of ``digits`` hex
    digits. Digit groups of four are summed one after the other, so a window never holds more than 65,536 rows."""
    ends = [*range(BUCKET_HEX_DIGITS, digits, BUCKET_HEX_DIGITS), digits]
    before = lambda outer: Window.partitionBy(GROUP, F.substring("__cell", 1, outer)).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    out = cells.withColumn("__off", F.coalesce(F.sum("n").over(before(ends[-2] if len(ends) > 1 else 0)), F.lit(0)))
    off = cells
    for i in reversed(range(len(ends) - 1)):
        mine = F.substring("__cell", 1, ends[i])
        off = off.groupBy(GROUP, mine.alias("__cell")).agg(F.sum("n").alias("n"))
        step = off.select(F.col(GROUP).alias("__g"), F.col("__cell").alias("__c"),
                          F.coalesce(F.sum("n").over(before(ends[i - 1] if i else 0)), F.lit(0)).alias("__s"))
        out = out.join(step, (F.col(GROUP) == F.col("__g")) & (mine == F.col("__c"))).withColumn("__off", F.col("__off") + F.col("__s")).drop("__g", "__c", "__s")
    return out.select(GROUP, "__cell", "__off")


def cv_folds(train: DataFrame, spec: ProblemSpec, key: str | None = None, folds: int = S.CV_FOLDS,
             method: str = "bucketed") -> DataFrame:
    """Adds ``fold`` = position in (label, hash) order mod 3 (hash order for regression):
    shuffled, seeded, stratified folds whose sizes differ by at most one per class.

    Position = rows of earlier classes + rows of earlier cells of the class + rank inside the cell, so the only row
    shuffle is by (label, cell). ``key`` should tell rows apart (``with_row_key``): rows with equal keys share a cell.
    ``method="window"`` ranks each class in one task instead: the plain form that the tests compare with."""
    base, grp = _groups(with_hash_order(train, key), spec)
    out_cols = train.columns + ["fold"]
    before = Window.orderBy(GROUP).rowsBetween(Window.unboundedPreceding, -1)
    if method == "window":
        sizes = base.groupBy(GROUP).agg(F.count(F.lit(1)).alias("n"))
        of = sizes.select(GROUP, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__off"))
        w = Window.partitionBy(GROUP).orderBy(*_tie(key))
        return (base.join(of, GROUP).withColumn("fold", ((F.col("__off") + F.row_number().over(w) - 1) % folds).cast("int"))
                .select(*map(quoted, out_cols)))
    digits = fold_digits(_rows_at_most(train))
    base = base.withColumn("__cell", F.coalesce(F.substring(HASH, 1, digits), F.lit("")))
    cells = base.groupBy(GROUP, "__cell").agg(F.count(F.lit(1)).alias("n"))
    cls = (cells.groupBy(GROUP).agg(F.sum("n").alias("__tot"))
           .select(GROUP, F.coalesce(F.sum("__tot").over(before), F.lit(0)).alias("__cls_off")))   # one row a class
    offsets = cell_offsets(cells, digits).join(cls, GROUP).select(GROUP, "__cell", (F.col("__cls_off") + F.col("__off")).alias("__off"))
    w = Window.partitionBy(GROUP, "__cell").orderBy(*_tie(key))
    return (base.join(offsets, [GROUP, "__cell"])
            .withColumn("fold", ((F.col("__off") + F.row_number().over(w) - 1) % folds).cast("int"))
            .select(*map(quoted, out_cols)))
