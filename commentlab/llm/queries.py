"""The operators as registered queries over whole tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlab.llm import (
    alignment, bpe, common, html_text, jaccard, langid, packing, phrases, quality, token_files, toxicity, urls, vectors,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = common.is_fold("doc_id", 4, 2)
    model = langid.fit(docs.filter(~held_out & F.col("doc_id").isNotNull()))
    return langid.predict(docs, model, held_out)


@query
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def url_log(pages: DataFrame) -> DataFrame:
    """A dated list derived from the pages: hosts blocked and freed, domains, allowed paths."""
    hosts = pages.select(urls.host("url").alias("h"), "page_id").groupBy("h").agg(F.min("page_id").alias("k")).filter("h <> ''")
    k = F.col("k")
    domain = F.regexp_extract("h", r"([^.]+\.[^.]+)$", 1)

    def entry(rule, action, day):
        return F.struct(rule.alias("rule"), F.lit(action).alias("action"), day.cast("int").alias("day"))

    entries = F.array(
        entry(F.col("h"), "block", k * 7 % 200),
        entry(F.col("h"), "remove", k * 7 % 200 + 30 + k % 50),
        entry(F.col("h"), "block", k * 7 % 200 + 100 + k % 60),
        entry(F.concat("h", F.lit("/en")), "allow", k * 11 % 300),
        entry(domain, "block", F.length("h") * 9),
        entry(domain, "remove", F.length("h") * 9 + 20),
    )
    return hosts.select(F.explode(entries).alias("e")).select("e.*")


@query
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", (F.col("page_id") * 13 % 365).cast("int"))
    return urls.judge(captures, url_log(pages))


SQL["op3_url_filters"] = r"""
WITH captures AS (
  SELECT page_id, url, CAST(page_id * 13 % 365 AS INT) AS day,
    coalesce(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '') AS h,
    list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS p
  FROM pages),
hosts AS (SELECT h, min(page_id) AS k FROM captures WHERE h <> '' GROUP BY h),
log AS (
  SELECT h AS rule, 'block' AS action, k * 7 % 200 AS day FROM hosts
  UNION ALL SELECT h, 'remove', k * 7 % 200 + 30 + k % 50 FROM hosts
  UNION ALL SELECT h, 'block', k * 7 % 200 + 100 + k % 60 FROM hosts
  UNION ALL SELECT h || '/en', 'allow', k * 11 % 300 FROM hosts
  UNION ALL SELECT regexp_extract(h, '([^.]+\.[^.]+)$', 1), 'block', length(h) * 9 FROM hosts
  UNION ALL SELECT regexp_extract(h, '([^.]+\.[^.]+)$', 1), 'remove', length(h) * 9 + 20 FROM hosts),
daily AS (
  SELECT rule, day, CASE max(CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END)
    WHEN 2 THEN 'block' WHEN 1 THEN 'allow' ELSE 'remove' END AS action
  FROM log GROUP BY rule, day),
valid AS (
  SELECT rule, action, day AS valid_from, lead(day) OVER (PARTITION BY rule ORDER BY day) AS valid_to FROM daily),
hits AS (
  SELECT c.page_id, v.*, CASE WHEN v.rule LIKE '%/%' THEN 1000 ELSE 0 END + length(v.rule) AS depth
  FROM captures c JOIN valid v
    ON (v.rule = c.h OR (v.rule NOT LIKE '%/%' AND c.h LIKE '%.' || v.rule)
        OR v.rule = c.h || '/' || c.p[1] OR v.rule = c.h || '/' || c.p[1] || '/' || c.p[2])
  WHERE v.action <> 'remove' AND c.day >= v.valid_from AND (v.valid_to IS NULL OR c.day < v.valid_to)),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY depth DESC) AS r FROM hits)
SELECT c.page_id, c.url, c.day, coalesce(b.action = 'block', false) AS blocked, b.rule,
  CAST(b.valid_from AS INT) AS valid_from, CAST(b.valid_to AS INT) AS valid_to
FROM captures c LEFT JOIN best b ON b.page_id = c.page_id AND b.r = 1
"""


@query
def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.top_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL["op4_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), common.is_fold("doc_id", 5, 0)
    trees = quality.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs.select("doc_id", "text"), trees, at_least=0.3)
    return scored.select(
        "doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted")
    )


@query
def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(_table(spark, sf_dir, "embeddings"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _table(spark, sf_dir, "documents"), common.is_fold("doc_id", 5, 0)
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    scored = toxicity.score(docs.select("doc_id", "text"), model, at_least=0.5)
    return scored.select(
        "doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted")
    )


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_texts(_table(spark, sf_dir, "pages"))


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.digests(_table(spark, sf_dir, "documents"), *paths)


@query
def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


SQL["op12_phrase_mining"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents),
spelled AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM spelled GROUP BY lang HAVING sum(len(w)) > 0),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM spelled),
grams AS (
  SELECT lang, w[i : i + k - 1] AS g, count(*) AS f
  FROM places, (VALUES (1), (2), (3), (4)) t(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM grams WHERE len(g) > 1),
scored AS (
  SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r,
    CAST(CAST(c.a AS HUGEINT) * 2000000 // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.g = c.g[1 : c.k]
  JOIN grams y ON y.lang = c.lang AND y.g = c.g[c.k + 1 : len(c.g)]),
weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (
  SELECT lang, g, f, s, m FROM grams, (VALUES (1), (2), (3)) u(s), (VALUES (2), (3)) v(m)
  WHERE m < len(g) AND s + m - 1 <= len(g)),
longer AS (SELECT lang, g[s : s + m - 1] AS g, max(f) AS within FROM inside GROUP BY ALL),
kept AS (
  SELECT w.*, array_to_string(w.g, ' ') AS phrase FROM weakest w LEFT JOIN longer o ON o.lang = w.lang AND o.g = w.g
  WHERE o.within IS NULL OR 100 * CAST(o.within AS HUGEINT) < 80 * CAST(w.a AS HUGEINT)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT p.lang, rank, phrase, a, l, r, n, score FROM placed p JOIN totals t ON t.lang = p.lang WHERE rank <= 2000
"""


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
