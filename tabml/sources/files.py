"""Scans of csv / parquet / builtin tables, source validation, dataset catalog."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tabml.spec import ProblemSpec

SUPPORTED_SUFFIXES = (".csv", ".parquet")
BUILTIN_PREFIX = "builtin:"
BUILTIN_TARGET_NAME = "diagnosis"      # name the peek shows for a builtin's generic `target`
DATA_DIR_ENV = "TABML_DATA_DIR"

# ---- fixed values: text that the reference's csv reader treats as missing ----
CSV_MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                      "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                      "nan", "null")

# Builtin datasets: a table of the given data folder plus a generic `target` column.
# Each target is an expression over that table, so the work grows with the table.
BUILTINS: dict[str, tuple[str, str, str]] = {
    # name: (table, target expression, task type)
    "orders_status": ("orders", "CAST(o_orderstatus = 'P' AS INT)", "classification"),
    "orders_price": ("orders", "o_totalprice", "regression"),
    "part_price": ("part", "p_retailprice", "regression"),
    "lineitem_returns": ("lineitem", "CAST(l_returnflag = 'R' AS INT)", "classification"),
    "customer_segment": ("customer", "c_mktsegment", "classification"),
}


def data_dir(explicit: str | None = None) -> str:
    return explicit or os.environ.get(DATA_DIR_ENV, "/root/testdata/sf0.01")


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S2. Column pruning and filter pushdown reach the scan through Catalyst."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise ValueError(f"Parquet file not found: {path!r}") from None
        raise ValueError(f"Failed to read parquet {path!r}: {e}") from e


def _csv_type_of(stats: dict, c: str) -> T.DataType:
    n = stats[f"n__{c}"]
    if n == 0:
        return T.DoubleType()  # an all-missing column reads as float in the reference
    if stats[f"i__{c}"] == n:
        return T.LongType()
    if stats[f"d__{c}"] == n:
        return T.DoubleType()
    if stats[f"b__{c}"] == n:
        return T.BooleanType()
    return T.StringType()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: What counts as a number in a file; a cast alone would also take suffixes such as ``30D``.
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_DECIMAL = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"


def _number(c: str, kind: str) -> Column:
    col = F.col(_quoted(c))
    return F.when(col.rlike(_INTEGER if kind == "bigint" else _DECIMAL), F.trim(col).try_cast(kind))


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    """S1. Header row, every cell read as text, the missing-token set nulled, then each column's
    type picked by one aggregate over the file (integer, else double, else boolean, else text).
    Date-like text stays text (D1): the reference's reader does not parse dates either."""
    try:
        raw = spark.read.option("header", True).option("inferSchema", False) \
            .option("mode", "PERMISSIVE").option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
        cols = raw.columns
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise ValueError(f"CSV file not found: {path!r}") from None
        raise ValueError(f"Failed to read CSV {path!r}: {e}") from e
    tokens = F.array(*[F.lit(t) for t in CSV_MISSING_TOKENS])
    cleaned = raw.select(*[F.when(~F.array_contains(tokens, F.col(_quoted(c))), F.col(_quoted(c))).alias(c) for c in cols])
    exprs = []
    for c in cols:
        col = F.col(_quoted(c))
        exprs += [F.count(col).alias(f"n__{c}"), F.count(_number(c, "bigint")).alias(f"i__{c}"),
                  F.count(_number(c, "double")).alias(f"d__{c}"),
                  F.count(F.when(F.lower(col).isin("true", "false"), 1)).alias(f"b__{c}")]
    from tabml.operators.stats import wide_agg
    try:
        stats = wide_agg(cleaned, exprs)
    except Exception as e:  # malformed file surfaces here (FAILFAST)
        raise ValueError(f"Failed to read CSV {path!r}: {e}") from e
    out = []
    for c in cols:
        t = _csv_type_of(stats, c)
        if isinstance(t, T.BooleanType):
            out.append((F.lower(F.col(_quoted(c))) == "true").alias(c))
        elif isinstance(t, T.StringType):
            out.append(F.col(_quoted(c)).alias(c))
        else:
            out.append(_number(c, t.simpleString()).alias(c))
    return cleaned.select(*out)


def builtin_frame(spark: SparkSession, name: str, base_dir: str | None = None) -> DataFrame:
    """A builtin dataset with its generic ``target`` column (S3 renames it)."""
    if name not in BUILTINS:
        raise ValueError(f"Unsupported data_source: {BUILTIN_PREFIX + name!r}")
    table, target_sql, _ = BUILTINS[name]
    df = scan_parquet(spark, os.path.join(data_dir(base_dir), f"{table}.parquet"))
    return df.withColumn("target", F.expr(target_sql))


def scan_builtin(spark: SparkSession, token: str, target_column: str,
                 base_dir: str | None = None) -> DataFrame:
    """S3 + P12: ``builtin:<name>``; the generic ``target`` is renamed to the spec's target."""
    name = token[len(BUILTIN_PREFIX):]
    return builtin_frame(spark, name, base_dir).withColumnRenamed("target", target_column)


def load_data(spark: SparkSession, spec: ProblemSpec, base_dir: str | None = None) -> DataFrame:
    """``load_data(spec)``: builtin token, .csv or .parquet; any failure is one ValueError."""
    src = spec.data_source
    if src.startswith(BUILTIN_PREFIX):
        return scan_builtin(spark, src, spec.target_column, base_dir)
    if src.endswith(".csv"):
        return scan_csv(spark, src)
    if src.endswith(".parquet"):
        return scan_parquet(spark, src)
    raise ValueError(f"Unsupported data_source: {src!r}")


def source_valid_expr(src: Column) -> Column:
    """S4 as a column predicate: a known builtin token, or a .csv / .parquet path."""
    builtins = [BUILTIN_PREFIX + n for n in BUILTINS]
    return src.isin(*builtins) | src.endswith(".csv") | src.endswith(".parquet")


def source_valid(source: str) -> bool:
    return source in {BUILTIN_PREFIX + n for n in BUILTINS} or source.endswith(SUPPORTED_SUFFIXES)


def dataset_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Builtins first, then data files of ``folder``; a csv wins over a parquet twin of the
    same stem; label = stem with underscores as spaces, title-cased.

    The listing uses the binaryFile source with only path metadata selected, so file contents
    are pruned from the scan.
    """
    files = (spark.read.format("binaryFile").load(folder)
             .select("path", "length", "modificationTime"))
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    files = files.select(F.col("path").alias("source"), name.alias("file_name"), suffix.alias("suffix"),
                         stem.alias("stem"))
    w = Window.partitionBy("stem").orderBy((F.col("suffix") != ".csv"), F.col("file_name"))
    picked = (files.where(F.col("suffix").isin(*SUPPORTED_SUFFIXES))
              .withColumn("rn", F.row_number().over(w)).where("rn = 1")
              .select("source", F.initcap(F.regexp_replace("stem", "_", " ")).alias("label"),
                      F.concat(F.lit("Sample file "), F.col("file_name"), F.lit(" shipped in "),
                               F.lit(os.path.basename(folder.rstrip('/'))), F.lit("/.")).alias("description"),
                      F.lit(None).cast("string").alias("task_type"),
                      F.lit(1).alias("ord"), F.col("file_name")))
    rows = [(BUILTIN_PREFIX + n, n.replace("_", " ").title(), f"Builtin table {t} with target {e}.",
             task, 0, "") for n, (t, e, task) in BUILTINS.items()]
    builtins = spark.createDataFrame(
        rows, "source string, label string, description string, task_type string, ord int, file_name string")
    return builtins.unionByName(picked)
