"""Token counts of whole texts with a digest cache.

The cache is a Parquet table (tokenizer_digest, content_digest, n_tokens). Texts are looked up by the SHA-256 of their
content (the UTF-8 bytes of the text as it is, null as empty: a count holds only for equal bytes) and of the tokenizer
(file, library version and settings). Only distinct texts that the cache lacks are encoded, each once, and their counts are appended.

Copies: digests are counted with partial aggregation and one row of each missing digest is sent to be encoded, spread by its id, so
a group of copies of any size costs one encoding. Texts go in slices of about one MB to the tokenizer, a longer text alone and
whole, without truncation.

Nulls: a null text counts as the empty text (0 tokens); null ids are kept. Repeated rows are each returned. An empty table
gives no rows and leaves the cache as it is. Only the two named columns are read, so clashing names do not matter.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabml.llm import textnum as T
from tabml.llm.store import Scratch, shared_path

CACHE_SCHEMA = "tokenizer_digest string, content_digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    """Digest of all that a count depends on besides the text."""
    if path.endswith(".json"):
        import tokenizers
        lib = f"tokenizers {tokenizers.__version__}"
    else:
        import sentencepiece
        lib = f"sentencepiece {sentencepiece.__version__}"
    h = hashlib.sha256(f"{lib}; no added special tokens; no truncation; no padding\n".encode())
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


def counter(path: str):
    """texts -> token counts, by the library for the file."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        return lambda texts: [len(e.ids) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    import sentencepiece
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) per row. ``tokenizer_path``: the vocabulary file, at the same place on every machine. ``cache_path``: a folder in
    the cluster's store that later runs use again; unset, this run has a cache of its own."""
    spark: SparkSession = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    cache_path = cache_path or shared_path(spark, "token-cache")
    scratch = Scratch(spark, "tokens")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))
    keys = scratch.table(rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))

    def cache() -> DataFrame:
        p = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
        if not p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p):
            return spark.createDataFrame([], CACHE_SCHEMA)
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer_digest") == version)
        return known.groupBy(F.col("content_digest").alias("digest")).agg(F.max("n_tokens").alias("n_tokens"))

    known = cache()
    missing = keys.groupBy("digest").agg(F.min("id").alias("rep"))
    if "n_tokens" in known.columns and "digest" in known.columns:
        missing = missing.join(known, "digest", "left_anti")
    missing = missing.withColumnRenamed("digest", "want")
    texts = rows.join(missing.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("rep")) & (F.col("digest") == F.col("want")), "left_semi")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for b in batches:
            count = count or counter(tokenizer_path)
            column = b.column("text")
            _, off = T.texts(column)
            got: list[int] = []
            for lo, hi in T.slices(off):
                got += count(column.slice(lo, hi - lo).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(got, pa.int64())], ["digest", "n_tokens"])

    counted = texts.select("digest", "text").mapInArrow(encode, "digest binary, n_tokens long")
    counted = counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    (counted.select(F.lit(version).alias("tokenizer_digest"), F.col("digest").alias("content_digest"), "n_tokens")
     .write.mode("append").parquet(cache_path))
    return keys.join(cache(), "digest").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")
