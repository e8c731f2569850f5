"""URL filter lists as a temporal list join, in DataFrame functions only.

A list is a log of dated entries: a rule is blocked, allowed or removed on a day. Per rule each
entry is valid from its day until the rule's next entry, so the log becomes disjoint validity
intervals. A capture asks for the rules that could name it (its host, the domains above it, its
host with the first path segments, as many as the list's longest rule has), and an as-of join keeps
those valid on the day it was fetched. The most specific rule decides.

Rules such as a top-level domain may name a third of all captures, so both sides carry a salt:
captures their own hash, intervals a copy per salt. Verdicts are found once per distinct (url,
day) and joined back, so repeated captures cost nothing and every row has its answer.

Defined results: scheme and host, also a rule's, compare in lower case, paths as they are; user
names, passwords, port, query and fragment are ignored; entries of a rule on one day: remove yields to allow, allow to block;
entries with a NULL rule, action or day are ignored; a capture with a NULL or unreadable url or a
NULL day is not blocked; an empty list blocks nothing. Clashing names in other columns do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SALTS = 16
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:@]+)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: str | Column) -> Column:
    """Lower-case host, or an empty string."""
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def rules_of(url: str, segments: Column) -> Column:
    """(rule, depth) of every rule of up to ``segments`` path segments that could name ``url``; deeper is more specific."""
    labels = F.split(host(url), r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(
            F.array_join(F.slice(labels, F.size(labels) - i + 1, i), ".").alias("rule"), i.alias("depth")
        ),
    )
    parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda x: x != "")
    steps = F.least(F.size(parts), segments)
    paths = F.transform(
        F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.concat_ws("/", host(url), F.array_join(F.slice(parts, 1, i), "/")).alias("rule"), (i + 1000).alias("depth")
        ),
    )
    return F.when(host(url) != "", F.concat(domains, paths)).otherwise(F.array().cast("array<struct<rule:string,depth:int>>"))


def _rule(rule: Column) -> Column:
    """A rule with its host in lower case."""
    named = F.regexp_extract(rule, "^[^/]*", 0)
    return F.concat(F.lower(named), F.substr(rule, F.length(named) + 1))


def intervals(entries: DataFrame, rule: str = "rule", action: str = "action", day: str = "day") -> DataFrame:
    """rule, action, valid_from, valid_to (NULL: still valid) from the log of entries."""
    weight = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    log = (
        entries.select(_rule(F.col(rule)).alias("rule"), F.col(action).alias("action"), F.col(day).alias("valid_from"))
        .na.drop()
        .groupBy("rule", "valid_from")
        .agg(F.max_by("action", weight).alias("action"))
    )
    following = Window.partitionBy("rule").orderBy("valid_from")
    log = log.withColumn("valid_to", F.lead("valid_from").over(following))
    return log.filter("action <> 'remove'").select("rule", "action", "valid_from", "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """``captures`` with blocked, rule, valid_from, valid_to added."""
    distinct = captures.select(F.col(url).alias("_url"), F.col(day).alias("_day")).na.drop().distinct()
    listed = intervals(entries)
    slashes = F.length("rule") - F.length(F.replace("rule", F.lit("/")))
    deepest = listed.agg(F.coalesce(F.max(slashes), F.lit(0)).alias("_segments"))
    asked = distinct.crossJoin(F.broadcast(deepest)).select("_url", "_day", F.explode(rules_of("_url", F.col("_segments"))).alias("_r")).select(
        "_url", "_day", F.col("_r.rule").alias("rule"), F.col("_r.depth").alias("_depth"),
        F.pmod(F.xxhash64("_url", "_day"), F.lit(SALTS)).cast("int").alias("_salt"),
    )
    listed = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    valid = (F.col("_day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_day") < F.col("valid_to")))
    verdicts = (
        asked.join(listed, ["rule", "_salt"])
        .filter(valid)
        .groupBy("_url", "_day")
        .agg(F.max_by(F.struct("rule", "action", "valid_from", "valid_to"), "_depth").alias("_v"))
    )
    joined = captures.join(
        verdicts, (captures[url] == verdicts["_url"]) & (captures[day] == verdicts["_day"]), "left"
    )
    return joined.select(
        *(captures[c] for c in captures.columns),
        F.coalesce(F.col("_v.action") == "block", F.lit(False)).alias("blocked"),
        F.col("_v.rule").alias("rule"),
        F.col("_v.valid_from").alias("valid_from"),
        F.col("_v.valid_to").alias("valid_to"),
    )
