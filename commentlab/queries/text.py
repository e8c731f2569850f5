"""Cleaning, tokenising and sequence packing over every document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlab.functions import text as t
from commentlab.functions.accents import strip_accents
from commentlab.operators.features import vocabulary
from commentlab.operators.sequences import pack_sequences, parse_array, word_ids
from commentlab.queries.base import documents, query, table
from commentlab.scale import literal_table, spread
from commentlab.session import materialise

WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"


def _sub(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"


def no_urls(text: str) -> str:
    return _sub(text, rf"http{NOT_SPACE}+|www\.{NOT_SPACE}+")


def no_mentions(text: str) -> str:
    return _sub(text, f"@{WORD}+")


def squeezed(text: str) -> str:
    return f"trim({_sub(text, SPACE + '+', ' ')})"


def cleaned(text: str) -> str:
    return squeezed(f"lower({no_mentions(no_urls(text))})")


def tokens(text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({text})), '{WORD}+')"


# Documents hold no links or hashtags, so each gets those of its page and source.
POSTS = """
posts AS (
  SELECT d.doc_id AS id, d.lang,
    concat('HTTP://UP ', d.text, ' ', p.url, ' @', d.source, ' #', d.lang, ' www.', d.source, '.org') AS text
  FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id
)"""


def posts(spark, sf) -> DataFrame:
    docs = spread(table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), "url")
    text = F.concat(
        F.lit("HTTP://UP "), "text", F.lit(" "), F.coalesce("url", F.lit("")), F.lit(" @"), "source",
        F.lit(" #"), "lang", F.lit(" www."), "source", F.lit(".org"),
    )
    return docs.join(pages, "doc_id", "left").select(
        F.col("doc_id").alias("id"), "lang", text.alias("text")
    )


def _scalar(name: str, sql_text: str, expression):
    @query(name, f"WITH {POSTS} SELECT id, {sql_text} AS text FROM posts")
    def _(spark, sf):
        return posts(spark, sf).select("id", expression(F.col("text")).alias("text"))


_scalar("clean_urls", no_urls("text"), t.remove_urls)
_scalar("clean_mentions", no_mentions("text"), t.remove_mentions)
_scalar("clean_hashtags", _sub("text", f"#{WORD}+"), t.remove_hashtags)
_scalar("clean_lower", "lower(text)", F.lower)
_scalar("clean_ws", squeezed("text"), t.squeeze_spaces)
_scalar("clean_text", cleaned("text"), t.clean_text)
_scalar("strip_accents", "strip_accents(text)", strip_accents)
_scalar(
    "clean_punct",
    squeezed(_sub("strip_accents(text)", r"[\p{P}]", " ")),
    t.clean_punctuation,
)

STOPWORDS = {
    "de": ["der", "und", "die", "sch", "er"],
    "en": ["the", "and", "of", "in", "to"],
    "es": ["de", "la", "los", "que", "y"],
}


def _stopword_case() -> str:
    lists = " ".join(f"WHEN '{lang}' THEN {words}" for lang, words in STOPWORDS.items())
    return f"CASE lang {lists} ELSE []::VARCHAR[] END"


@query(
    "clean_stopwords",
    f"""WITH {POSTS}, clean AS (
  SELECT id, {_stopword_case()} AS words, {cleaned('text')} AS text FROM posts
)
SELECT id, array_to_string(
  list_filter(string_split(text, ' '), lambda w: NOT list_contains(words, w)), ' ') AS text
FROM clean""",
)
def _(spark, sf):
    words = literal_table(spark, list(STOPWORDS.items()), "lang string, stopwords array<string>")
    clean = posts(spark, sf).withColumn("text", t.clean_text(F.col("text")))
    return t.remove_stopwords(clean, "text", words).select("id", "text")


ANALYZED = f"""
words AS (
  SELECT doc_id AS id, lang, {tokens(cleaned('text'))} AS w FROM documents
), analyzed AS (
  SELECT id, lang, w, list_concat(w, list_transform(range(1, len(w)),
    lambda i: concat(w[i], ' ', w[i + 1]))) AS grams
  FROM words
)"""


def analyzed(spark, sf, pairs: bool = True) -> DataFrame:
    clean = documents(spark, sf).withColumn("comment_text", t.clean_text(F.col("comment_text")))
    return t.analyze(clean, "comment_text", "grams", pairs).select("id", "lang", "grams")


@query(
    "tokenize",
    f"WITH {ANALYZED} SELECT id, len(w) AS n, array_to_string(w, ' ') AS tokens FROM analyzed",
)
def _(spark, sf):
    lowered = F.lower(t.clean_text(F.col("comment_text")))
    rows = documents(spark, sf).withColumn("w", t.tokenize(strip_accents(lowered)))
    return rows.select("id", F.size("w").cast("long").alias("n"), F.array_join("w", " ").alias("tokens"))


@query(
    "ngrams",
    f"WITH {ANALYZED} SELECT id, len(grams) AS n, array_to_string(grams, '|') AS grams FROM analyzed",
)
def _(spark, sf):
    rows = analyzed(spark, sf)
    return rows.select(
        "id", F.size("grams").cast("long").alias("n"), F.array_join("grams", "|").alias("grams")
    )


@query(
    "parse_token_arrays",
    f"""WITH {ANALYZED}, ids AS (SELECT id, list_transform(w, lambda x: len(x)) AS a FROM analyzed)
SELECT id, len(a) AS n, CAST(coalesce(list_sum(a), 0) AS BIGINT) AS total,
  CAST(a[1] AS INTEGER) AS first_id, CAST(a[-1] AS INTEGER) AS last_id
FROM ids""",
)
def _(spark, sf):
    lowered = F.lower(t.clean_text(F.col("comment_text")))
    words = documents(spark, sf).withColumn("w", t.tokenize(strip_accents(lowered)))
    # The stored form: word lengths as text, in round brackets.
    lengths = F.transform("w", lambda x: F.length(x).cast("string"))
    stored = words.select("id", F.concat(F.lit("("), F.array_join(lengths, ", "), F.lit(")")).alias("s"))
    parsed = stored.withColumn("a", parse_array(F.col("s"))).withColumn("n", F.size("a").cast("long"))
    total = F.aggregate("a", F.lit(0).cast("long"), lambda s, x: s + x)
    return parsed.select(
        "id",
        "n",
        total.alias("total"),
        F.get("a", F.lit(0)).alias("first_id"),
        F.get("a", (F.col("n") - 1).cast("int")).alias("last_id"),
    )


@query(
    "pack_sequences",
    f"""WITH {ANALYZED}, terms AS (
  SELECT lang, term, count(*) AS cf, count(DISTINCT id) AS df
  FROM (SELECT id, lang, unnest(w) AS term FROM analyzed) GROUP BY ALL
), sizes AS (SELECT lang, count(*) AS n FROM analyzed GROUP BY lang
), ids AS (
  SELECT lang, term, 1 + row_number() OVER (PARTITION BY lang ORDER BY cf DESC, term) AS word_id
  FROM terms JOIN sizes USING (lang) WHERE df >= 3 AND df <= 0.95::DOUBLE * n
), places AS (
  SELECT id, lang, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM analyzed
), packed AS (
  SELECT p.id, list(coalesce(word_id, 1) ORDER BY pos) AS w
  FROM places p LEFT JOIN ids USING (lang, term) WHERE pos <= 128 GROUP BY p.id
)
SELECT a.id, coalesce(len(p.w), 0) AS used,
  array_to_string(list_concat(coalesce(p.w, []), list_resize([]::BIGINT[], 128 - coalesce(len(p.w), 0), 0)), ' ')
    AS input_word_ids,
  array_to_string(list_concat(list_transform(coalesce(p.w, []), lambda x: 1),
    list_resize([]::INTEGER[], 128 - coalesce(len(p.w), 0), 0)), ' ') AS input_mask
FROM analyzed a LEFT JOIN packed p ON a.id = p.id""",
)
def _(spark, sf):
    lowered = F.lower(t.clean_text(F.col("comment_text")))
    words = documents(spark, sf).withColumn("w", t.tokenize(strip_accents(lowered)))
    rows = materialise(words.select("id", "lang", "w"), "tokens")
    packed = pack_sequences(rows, "w", word_ids(vocabulary(rows, "w")))
    return packed.select(
        "id",
        F.size(F.filter("input_mask", lambda x: x == 1)).cast("long").alias("used"),
        F.array_join(F.transform("input_word_ids", lambda x: x.cast("string")), " ").alias("input_word_ids"),
        F.array_join(F.transform("input_mask", lambda x: x.cast("string")), " ").alias("input_mask"),
    )
