"""URL filters (op 9): every URL is expanded into host-suffix and path-prefix expressions, which are equi-joined with the
rules on a short hash prefix; the full digest, then the rule itself, confirm a match, and the longest rule wins.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there up to "?", "#" or the end.
A rule (host, path) fits its host and all subdomains if the URL's path starts with the rule's path.

Cases: a null URL, or one without "://", has an empty host and path and no rule; equal URLs are judged once; among
rules of one length the first by text wins; an empty rule table leaves every URL to the default verdict; pages keep
all their rows, and other columns with clashing names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import ascii_lower

#: Hex digits of the digest that rules and expressions are joined on.
PREFIX = 8
RULE_SCHEMA = "host string, path string, verdict string"


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, RULE_SCHEMA)


def _stem(path: Column) -> Column:
    """A path up to its last slash: what a rule is looked up by; its rest is confirmed later."""
    return F.regexp_extract(path, r"(?s)^(.*/)?", 1)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    Suffixes and prefixes are cut no deeper than the deepest rule, a bound that comes from the rules themselves; a
    URL of thousands of labels or folders so yields few expressions, and none that could match is left out."""
    r = rules.select(ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
    r = r.withColumn("r_rule", F.concat("r_host", "r_path")).withColumn("r_key", F.sha2(F.concat("r_host", F.lit("\n"), _stem(F.col("r_path"))), 256))
    r = r.withColumn("r_short", F.left("r_key", F.lit(PREFIX)))
    depth = r.agg(F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(0)).alias("_labels"), F.coalesce(F.max(F.size(F.split("r_path", "/"))), F.lit(0)).alias("_folders"))

    urls = pages.select(F.col(url_col).cast("string").alias("_url")).where(F.col("_url").isNotNull()).distinct()
    urls = urls.select("_url", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path")).crossJoin(F.broadcast(depth))  # one row: two numbers
    labels, folders = F.split("host", r"\."), F.split("path", "/")
    urls = urls.withColumn("_l", labels).withColumn("_f", folders)
    hosts = "transform(sequence(1, least(size(_l), _labels)), n -> array_join(slice(_l, size(_l) - n + 1, n), '.'))"
    # The prefix of k folders ends with the k-th slash; k = 0 is the empty one.
    paths = "transform(sequence(0, least(size(_f) - 1, _folders)), n -> if(n = 0, '', concat(array_join(slice(_f, 1, n), '/'), '/')))"
    e = urls.where("_labels > 0").withColumn("_h", F.explode(F.expr(hosts))).withColumn("_p", F.explode(F.expr(paths)))
    e = e.select("_url", "path", F.sha2(F.concat("_h", F.lit("\n"), "_p"), 256).alias("_key")).withColumn("_short", F.left("_key", F.lit(PREFIX)))
    hit = e.join(r, e["_short"] == r["r_short"]).where((F.col("_key") == F.col("r_key")) & F.col("path").startswith(F.col("r_path")))
    best = hit.groupBy("_url").agg(F.min(F.struct((-F.length("r_rule")).alias("n"), F.col("r_rule").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("_best"))
    best = best.select(F.col("_url").alias("_u"), "_best")
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url"))
    out = p.join(best, F.col("_url") == F.col("_u"), "left")
    return out.select("page_id", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
