"""Registered queries of the training-data operators, over whole tables, with their DuckDB forms where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabml.llm import decontaminate, html_text, langid, lm, mixing, neardup, passages, phrases, quality, suffix_dedup, tokens, url_filter, whitening

#: The path rules of the URL query, (host, path, verdict).
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]
TOKENIZER = "byte_bpe_50k.json"
MAX_TOKENS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_text.extract_text(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", F.col("extracted.text").alias("text"), F.col("extracted.n_chars").alias("n_chars"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    got = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return got.withColumn("over_limit", F.col("n_tokens") > MAX_TOKENS)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.summary(suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")))
    return got.withColumnRenamed("id", "doc_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", mixing.taken(F.col("parts")).alias("taken"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("row.doc_id", "contaminated", "n_items", "n_spans", "items")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = passages.with_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return got.select("row.doc_id", F.size("spans").alias("n_spans"), removed.alias("n_repeated_words"), "spans", "source_ids")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents")).select("doc_id", "quality.*")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~out))
    got = langid.predict(docs, model)
    return got.select("doc_id", out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: URLs of pages whose document (same number) is labelled toxic."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    listed = pages.join(labels.where("toxic = 1"), pages.page_id == labels.doc_id, "left_semi")
    got = url_filter.filter_urls(pages, "url", listed, "url", URL_RULES)
    return got.select("page_id", "host", "path", "canonical_url", "rule", "verdict")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = lm.held_out(F.col("doc_id"))
    return lm.score(docs, lm.fit(docs.where(~out)), out).withColumnRenamed("id", "doc_id")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_token_counts, op3_minhash_near_dedup, op4_suffix_dedup, op5_mixing, op6_decontamination, op7_quality_rules, op8_substring_dedup, op9_language_id,
                                   op10_url_filters, op11_lm_scoring, op12_phrase_collocations, op13_embedding_whitening)}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLE = {
    "op10_url_filters": f"""
WITH rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS r FROM pages),
parts AS (SELECT page_id, r,
    coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(regexp_extract(r, '^([^?#]*)', 1), '^[^/]*(/.*)$', 1, 's'), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(r, '^[^?#]*\\?([^#]*)', 1), '&'),
              lambda a: a <> '' AND NOT starts_with(a, 'utm_') AND NOT starts_with(a, 'ref='))) AS args
  FROM rest),
canon AS (SELECT *, CASE WHEN r IS NOT NULL THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS canonical_url FROM parts),
listed AS (SELECT DISTINCT c.canonical_url FROM canon c WHERE c.canonical_url IS NOT NULL
    AND c.page_id IN (SELECT doc_id FROM labels WHERE toxic = 1)),
rules(h, p, v) AS (VALUES {_RULES_SQL}),
fits AS (SELECT page_id, url_host, url_path, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v FROM
    (SELECT DISTINCT page_id, host AS url_host, path AS url_path FROM canon)
    JOIN rules ON (url_host = h OR ends_with(url_host, '.' || h)) AND starts_with(url_path, p) GROUP BY ALL)
SELECT c.page_id, c.host, c.path, c.canonical_url, f.rule,
    coalesce(f.v, CASE WHEN l.canonical_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM canon c LEFT JOIN listed l USING (canonical_url)
LEFT JOIN fits f ON c.page_id = f.page_id AND c.host = f.url_host AND c.path = f.url_path""",
    "op12_phrase_collocations": r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
f1 AS (SELECT lang, w[i] AS x, count(*) AS f FROM places GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM places WHERE i + 1 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM places WHERE i + 2 <= len(w) GROUP BY ALL HAVING count(*) >= 10),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
two AS (SELECT p.lang, p.x || ' ' || p.y AS phrase, p.f AS a, u.f AS l, v.f AS r,
    (1000000::HUGEINT * p.f * p.f) // (u.f::HUGEINT * v.f) AS score
  FROM f2 p JOIN f1 u ON p.lang = u.lang AND p.x = u.x JOIN f1 v ON p.lang = v.lang AND p.y = v.x
  WHERE NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = p.lang AND t.x = p.x AND t.y = p.y AND 100 * t.f >= 50 * p.f)
    AND NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = p.lang AND t.y = p.x AND t.z = p.y AND 100 * t.f >= 50 * p.f)),
cuts AS (SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, u.f AS l1, yz.f AS r1, xy.f AS l2, v.f AS r2,
    (1000000::HUGEINT * t.f * t.f) // (u.f::HUGEINT * yz.f) AS s1, (1000000::HUGEINT * t.f * t.f) // (xy.f::HUGEINT * v.f) AS s2
  FROM f3 t JOIN f1 u ON t.lang = u.lang AND t.x = u.x JOIN f2 yz ON t.lang = yz.lang AND t.y = yz.x AND t.z = yz.y
  JOIN f2 xy ON t.lang = xy.lang AND t.x = xy.x AND t.y = xy.y JOIN f1 v ON t.lang = v.lang AND t.z = v.x),
found AS (SELECT lang, phrase, a, l, r, score FROM two UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM found)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000""",
}
