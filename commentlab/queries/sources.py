"""Readers, writers and profiles, each over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from commentlab.operators import profile as p
from commentlab.operators.errors import tag_errors
from commentlab.operators.metrics import metrics_report
from commentlab.operators.sampling import error_sample, split_rows
from commentlab.operators.threshold import apply_thresholds, best_threshold, for_languages
from commentlab.plans.evaluate import evaluation_status
from commentlab.plans.train import evaluate, summarise
from commentlab.queries.base import (
    COMMENTS,
    REGISTRY,
    languages,
    SPLIT,
    auc_sql,
    comments,
    counts_sql,
    documents,
    predictions,
    query,
    scored,
    scored_sql,
    six,
    sweep_sql,
    table,
    tuned_sql,
)
from commentlab.queries.metrics import TAGGED, rounded
from commentlab.session import new_path
from commentlab.sources import readers as r
from commentlab.sources import writers as w


def split_comments(spark, sf):
    rows = comments(spark, sf).select("lang", "id", "comment_text", "toxic")
    return split_rows(rows, ["lang"])


@query(
    "load_splits",
    f"""WITH {COMMENTS}, {SPLIT.format(source='comments')}
SELECT lang, split, id, comment_text, toxic FROM parted""",
)
def _(spark, sf):
    folder = new_path(spark, "splits")
    w.write_splits(split_comments(spark, sf), folder, languages(comments(spark, sf)))
    loaded, _ = r.load_splits(spark, folder, languages(comments(spark, sf)))
    return loaded.withColumn("id", F.col("id").cast("long"))


@query(
    "load_split_defaults",
    """SELECT lang, 'test' AS split, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS id,
  text AS comment_text, -1 AS toxic
FROM documents""",
)
def _(spark, sf):
    folder = new_path(spark, "unlabelled")
    docs = documents(spark, sf)
    known = languages(docs)
    for lang in known:
        own = docs.filter(F.col("lang") == lang).orderBy("id").select("comment_text")
        w.write_table(own, f"{folder}/{lang}/test.csv")
    loaded, _ = r.load_splits(spark, folder, known, ["test"])
    return loaded.withColumn("id", F.col("id").cast("long"))


DECIDED = f"""
{scored_sql()}, {sweep_sql('scored')}, decided AS (
  SELECT lang, id, y_true, y_prob, CAST(y_prob >= best_threshold AS INTEGER) AS y_pred, best_threshold
  FROM scored JOIN best USING (lang)
)"""
DECIDED_SQL = f"""WITH {DECIDED}
SELECT 'baseline' AS run_tag, lang, id, y_true, round(y_prob, 6) AS y_prob, y_pred,
  round(best_threshold, 6) AS best_threshold FROM decided"""


def decided(spark, sf):
    rows = scored(spark, sf).select("lang", "id", "y_true", "y_prob")
    return apply_thresholds(rows, best_threshold(rows, ["lang"]), ["lang"])


def _stored(df):
    return df.select(
        "run_tag",
        "lang",
        F.col("id").cast("long").alias("id"),
        "y_true",
        six("y_prob").alias("y_prob"),
        "y_pred",
        six("best_threshold").alias("best_threshold"),
    )


@query("load_predictions", DECIDED_SQL)
def _(spark, sf):
    folder = new_path(spark, "prediction-files")
    w.write_prediction_files(decided(spark, sf), folder, "baseline", languages(comments(spark, sf)))
    return _stored(r.load_predictions(spark, folder, "baseline"))


@query("write_predictions", DECIDED_SQL)
def _(spark, sf):
    folder = new_path(spark, "predictions")
    w.write_predictions(decided(spark, sf), folder, "baseline")
    return _stored(r.load_predictions(spark, folder, "baseline", fmt="parquet"))


@query(
    "discover_languages",
    """SELECT DISTINCT lang FROM documents WHERE source LIKE 'src1%'
UNION SELECT DISTINCT concat(lang, '_', source) FROM documents WHERE source NOT LIKE 'src1%'""",
)
def _(spark, sf):
    one = F.col("source").like("src1%")
    tag = F.when(one, F.col("lang")).otherwise(F.concat_ws("_", "lang", "source"))
    names = table(spark, sf, "documents").select(F.concat(F.lit("baseline_"), tag, F.lit(".csv")).alias("name"))
    others = names.select(F.concat(F.lit("other_"), F.col("name")).alias("name"))
    return r.languages_of_names(names.unionByName(others), "baseline")


@query(
    "filter_languages",
    "SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'fr') GROUP BY lang",
)
def _(spark, sf):
    wanted = r.choose_languages(["en", "fr", "en"], languages(comments(spark, sf)))
    docs = table(spark, sf, "documents").select("lang")
    return docs.filter(F.col("lang").isin(wanted)).groupBy("lang").agg(F.count("*").alias("n"))


@query(
    "scan_parquet_columns",
    "SELECT lang, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY lang",
)
def _(spark, sf):
    shards = r.scan_columns(spark, f"{sf}/documents.parquet", ["lang", "n_chars"])
    return shards.groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))


@query(
    "translated_union",
    f"WITH {COMMENTS} SELECT lang, id, comment_text, toxic FROM comments",
)
def _(spark, sf):
    folder = new_path(spark, "translated")
    rows = comments(spark, sf).select("lang", "id", "comment_text", "toxic")
    manifest = {}
    for lang in languages(comments(spark, sf)):
        manifest[lang] = f"{folder}/{lang}_train.csv"
        w.write_table(rows.filter(F.col("lang") == lang).drop("lang"), manifest[lang])
    corpora = r.translated_union(spark, manifest)
    return corpora.select(
        "lang", F.col("id").cast("long").alias("id"), "comment_text", F.col("toxic").cast("int").alias("toxic")
    )


@query(
    "default_threshold",
    f"""WITH {scored_sql()}, stored AS (
  SELECT *, CASE lang WHEN 'de' THEN '0.6' WHEN 'en' THEN 'x' WHEN 'fr' THEN '0.7' END AS cell
  FROM scored
)
SELECT lang, id, CASE WHEN cell IS NULL THEN 0
  ELSE CAST(y_prob >= coalesce(TRY_CAST(cell AS DOUBLE), 0.5::DOUBLE) AS INTEGER) END AS y_pred
FROM stored""",
)
def _(spark, sf):
    lang = F.col("lang")
    cell = F.when(lang == "de", "0.6").when(lang == "en", "x").when(lang == "fr", "0.7")
    rows = scored(spark, sf).select("lang", "id", "y_true", "y_prob", cell.alias("best_threshold"))
    return r.resolve_predictions(rows).select("lang", "id", "y_pred")


SUMMARY_SQL = f"""WITH {scored_sql()}, {SPLIT.format(source='scored')},
vals AS (SELECT lang, id, y_true, y_prob FROM parted WHERE split = 'val'),
{sweep_sql('vals')}, {tuned_sql()}, decided AS (
  SELECT p.lang, p.split, y_true, y_prob, CAST(y_prob >= best_threshold AS INTEGER) AS y_pred
  FROM parted p JOIN tuned USING (lang) WHERE split <> 'train'
), {counts_sql('decided', 'lang, split')}, {auc_sql('decided', 'lang, split')},
both_parts AS (SELECT * FROM counts JOIN aucs USING (lang, split)),
wide AS (
  SELECT l.lang, v.roc_auc AS val_roc_auc, v.f1 AS val_f1, v."precision" AS val_precision,
    v.recall AS val_recall, t.roc_auc AS test_roc_auc, t.f1 AS test_f1,
    t."precision" AS test_precision, t.recall AS test_recall
  FROM (SELECT lang FROM tuned) l LEFT JOIN both_parts v ON v.lang = l.lang AND v.split = 'val'
    LEFT JOIN both_parts t ON t.lang = l.lang AND t.split = 'test'
)
SELECT lang AS language, round_even(val_roc_auc, 4) AS val_roc_auc, round_even(val_f1, 4) AS val_f1,
  round_even(val_precision, 4) AS val_precision, round_even(val_recall, 4) AS val_recall,
  round_even(test_roc_auc, 4) AS test_roc_auc, round_even(test_f1, 4) AS test_f1,
  round_even(test_precision, 4) AS test_precision, round_even(test_recall, 4) AS test_recall,
  round_even(best_threshold, 4) AS best_threshold, NULL::VARCHAR AS error
FROM wide JOIN tuned USING (lang)
UNION ALL SELECT 'it', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not found'"""


@query("run_summary", SUMMARY_SQL)
def _(spark, sf):
    rows = scored(spark, sf).select("lang", "id", "y_true", "y_prob")
    parts = split_rows(rows, ["lang"]).filter(F.col("split") != "train")
    tuned = best_threshold(parts.filter(F.col("split") == "val"), ["lang"])
    thresholds = for_languages(tuned, languages(comments(spark, sf)))
    errors = {"it": "not found"}
    return summarise(evaluate(parts, thresholds), thresholds, [*languages(comments(spark, sf)), "it"], errors)


PROFILED = {
    "id": "bigint", "comment_text": "string", "lang": "string", "source": "string",
    "n_chars": "bigint", "quality": "int", "toxic": "int",
}


def _profile_sql() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS "column", '{kind}' AS dtype, count(*) AS n_rows,
  count(*) - count({c}) AS n_null, {'NULL::DOUBLE' if kind == 'string' else f'round(avg({c}), 6)'} AS mean,
  (SELECT string_agg(left(CAST({c} AS VARCHAR), 80), ' | ' ORDER BY part) FROM picked) AS examples
FROM comments"""
        for i, (c, kind) in enumerate(PROFILED.items())
    )
    return f"""WITH {COMMENTS}, dealt AS (
  SELECT *, CAST(('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8)) AS BIGINT) % 3 AS part FROM comments
), picked AS (
  SELECT * FROM dealt QUALIFY row_number() OVER (PARTITION BY part ORDER BY md5(CAST(id AS VARCHAR))) = 1
) {rows}"""


@query("profile_table", _profile_sql())
def _(spark, sf):
    told = p.profile_table(comments(spark, sf), ["id"], 3).withColumn("mean", six("mean"))
    return told.withColumn("examples", F.array_join("examples", " | "))


FAULTY = f"""{scored_sql()}, faulty AS (
  SELECT lang, CASE WHEN lang = 'fr' AND id % 10 = 0 THEN 7 ELSE y_true END AS y_true, y_prob,
    CASE WHEN lang = 'de' AND id % 2 = 0 THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END AS best_threshold
  FROM scored
)"""


@query(
    "evaluation_status",
    f"""WITH {FAULTY}
SELECT lang AS language, 'found' AS status, count(*) AS n_rows, count(*) FILTER (y_true NOT IN (0, 1)) AS n_invalid,
  count(DISTINCT best_threshold) AS n_thresholds
FROM faulty WHERE lang IS NOT NULL GROUP BY lang
UNION ALL SELECT 'xx', 'missing', 0, 0, 0""",
)
def _(spark, sf):
    """Stored files with faults, and a language that has none."""
    lang, label = F.col("lang"), F.col("y_true")
    threshold = F.when((lang == "de") & (F.col("id") % 2 == 0), 0.25).otherwise(0.75)
    wrong = F.when((lang == "fr") & (F.col("id") % 10 == 0), 7).otherwise(label)
    rows = scored(spark, sf).filter(lang.isNotNull()).select("lang", "id", wrong.alias("y_true"), "y_prob", threshold.alias("best_threshold"))
    folder, known = new_path(spark, "faulty"), languages(comments(spark, sf))
    w.write_prediction_files(rows.withColumn("y_pred", F.lit(0)), folder, "baseline", known)
    return evaluation_status(spark, folder, "baseline", [*known, "xx"])


# Files that one task writes, about.
FILES_A_TASK = 250


@query(
    "profile_files",
    """SELECT s_suppkey, CAST(strlen(s_name) + 1 AS BIGINT) AS size_bytes, sha256(concat(s_name, chr(10))) AS sha256
FROM supplier""",
)
def _(spark, sf):
    """Digests of one written file per supplier."""
    folder = new_path(spark, "files")
    names = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    # a given number of tasks: by their few bytes all rows would be one task's, which writes file after file
    tasks = max(spark.sparkContext.defaultParallelism, names.count() // FILES_A_TASK)
    names.repartition(tasks, "s_suppkey").write.partitionBy("s_suppkey").text(folder)
    files = p.profile_files(spark, folder, "*.txt")
    key = F.regexp_extract("path", r"s_suppkey=(\d+)/", 1).cast("long")
    return files.select(key.alias("s_suppkey"), "size_bytes", "sha256")


@query("write_metrics", REGISTRY["metrics_report"].sql)
def _(spark, sf):
    """The report as it comes back from its file."""
    report, path = metrics_report(predictions(spark, sf)), new_path(spark, "metrics")
    w.write_table(report, path)
    return rounded(spark.read.csv(path, schema=report.schema, header=True))


@query(
    "write_error_sample",
    f"""WITH {TAGGED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, error_type ORDER BY md5(concat(id, ':0')), id) AS rk
  FROM errors
)
SELECT 'run' AS run_tag, lang, error_type, id, y_true, y_pred FROM ranked WHERE rk <= 50""",
)
def _(spark, sf):
    """The error sample as it comes back from its files."""
    sample = error_sample(tag_errors(predictions(spark, sf)), ["lang"])
    sample, folder = sample.select("lang", "error_type", "id", "y_true", "y_pred"), new_path(spark, "errors")
    w.write_error_sample(sample, folder, "run")
    types = {f.name: f.dataType.simpleString() for f in sample.schema} | {"run_tag": "string"}
    order = ["error_type", "id", "y_true", "y_pred", "run_tag", "lang"]
    return spark.read.csv(folder, schema=", ".join(f"{c} {types[c]}" for c in order), header=True)
