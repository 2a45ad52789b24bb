"""Corpus pipeline over ``documents``: quality rules, near-dedup, substring dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns of documents.

* quality rules: documents that the rules reject go (null and short texts are rejected).
* near-dedup: five-word shingles at a similarity of 0.8; the document with the smallest id of each group stays, rows
  that repeat its id and text go (an unlike text under its id is judged by itself); null ids and wordless texts are in no group and stay.
* substring dedup: later near-copies of passages of 50 words or more are cut out of the texts, the first stays; ``n_chars`` follows
  the text; no document goes.
* decontamination: documents that overlap a benchmark item go, whatever their id.
* mixing: every document with its size, its source's size and target, the words taken, and ``pieces``: the drawn parts of its text with
  their output shard, their place in it and the pass over the source. Rows with a null id take part like any other.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from tabml.llm import decontaminate, mixing, neardup, passages, quality
from tabml.llm.store import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.judge_quality(docs).where("quality.kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    verdicts = Scratch(spark, "stage").table(neardup.grouped(docs, k=5).where("group_id is not null").select("doc_id", "digest", "group_id"))
    stays = verdicts.groupBy("group_id").agg(F.min(F.struct("doc_id", "digest")).alias("s")).select("s.*", F.lit(True).alias("stays"))
    judged = verdicts.select("doc_id", "digest").distinct().join(stays, ["doc_id", "digest"], "left")
    judged = judged.select(F.col("doc_id").alias("id"), "digest", F.coalesce("stays", F.lit(False)).alias("stays"))
    again = verdicts.groupBy(F.col("doc_id").alias("id"), "digest").count().where("count > 1").drop("count")
    judged = Scratch(spark, "stage").table(judged.join(again.withColumn("again", F.lit(True)), ["id", "digest"], "left"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), neardup.text_digest(F.col("text")).alias("digest"))
    # one shuffle of the texts, at any size: the verdicts grow with the corpus, so they aren't broadcast
    got = rows.join(judged.hint("merge"), ["id", "digest"], "left").where("stays is null or stays")
    once = got.where("again").dropDuplicates(["id", "digest"])  # rows equal in id and text: one stays
    return got.where("again is null").unionByName(once).select(*[F.col("row")[c].alias(c) for c in docs.columns])


@arrow_udf(StringType())
def _cut(text: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([t if not s else passages.cut_words(t, [(x["start"], x["end"]) for x in s])
                     for t, s in zip(text.to_pylist(), spans.to_pylist())], pa.string())


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = passages.with_spans(docs)
    hit = F.size("spans") > 0
    cut = F.when(hit, _cut("row.text", "spans")).otherwise(F.col("row.text"))
    got = got.select("row", hit.alias("hit"), cut.alias("cut"))
    new = {"text": F.col("cut"), "n_chars": F.when(F.col("hit"), F.length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))}
    return got.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = decontaminate.judged(docs, bench).where("not contaminated")
    return got.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # a null id does not find its row again, so these rows, and only these, go through the stage whole
    whole = F.when(F.col("doc_id").isNull(), F.struct(*docs.columns))
    mixed = mixing.mix_sources(docs, carry=whole).drop("source").withColumn("taken", mixing.taken(F.col("parts")))
    drawn = ["size", "source_size", "target", "taken", "parts"]
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(mixing.WORD), F.lit(0))

    def piece(w, p):
        part = F.array_join(F.slice(w, (p["start"] + 1).cast("int"), p["words"].cast("int")), " ")
        return F.struct(p["shard"].alias("shard"), p["place"].alias("place"), p["epoch"].alias("epoch"), part.alias("text"))

    pieces = mixing.let(words, lambda w: F.transform("parts", lambda p: piece(w, p)))
    named = docs.where("doc_id is not null").join(mixed.where("doc_id is not null").select("doc_id", *drawn), "doc_id", "left")
    unnamed = mixed.where("doc_id is null").select("carried.*", *drawn)
    both = named.select(*docs.columns, *drawn).unionByName(unnamed)
    return both.select(*docs.columns, "size", "source_size", "target", "taken", pieces.alias("pieces"))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("substring dedup", substring_dedup),
          ("decontamination", decontamination), ("mixing", mix)]

#: Near-dedup by signatures, passages and sampled mixes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = scratch.table(docs)
    return docs
