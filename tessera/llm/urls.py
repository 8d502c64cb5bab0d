"""URL filters by host-suffix and path-prefix expressions.

Each URL is expanded into every (host suffix, path prefix) that a rule could
have; expressions meet the rules in an equi-join on the first bytes of their
digests, the full digests confirm, and the longest rule wins (equally long ones:
block before allow, then the smaller string).

Only path prefixes of a length that some rule has, and suffixes of no more
labels than the longest rule host, are expanded. The number of expressions per
URL so depends on the rules, not on the URL or the table. Rules join on the short hashes
alone; the full digests confirm where a row's best rule is picked, row by row, so a
URL or host that a third of the pages share is no key of any shuffle, and a row's
expressions are summed up before it is sent anywhere. The planner broadcasts the rules
if their size allows; else it joins by short hash, and splits frequent ones.

Defined cases: a null URL or one without ``://`` has an empty host and path and
fits no rule; very long URLs are judged whole; repeated rows and null ids each get a
row; empty labels (``a..b``) are labels like any other; of equally long rules a block
goes before an allow, then the smaller string; empty tables give empty results. Columns
beside page_id and url aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"
HASH_CHARS = 8


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, rule_host string, rule_path string")


def split_url(url) -> tuple:
    pattern = r"://([^/?#]*)([^?#]*)"
    found = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(found(1)), found(2)


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages``."""
    host, path = split_url(F.col("url"))
    shape = rules.agg(
        F.collect_set(F.length("rule_path")).alias("lengths"),
        F.max(F.size(F.split("rule_host", r"\."))).alias("depth"),
    ).first()
    lengths, depth = sorted(shape["lengths"]), shape["depth"] or 0
    labels = F.split("host", r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), n - depth + 1), n), lambda k: F.array_join(F.slice(labels, k, n - k + 1), "."))
    paths = F.array_distinct(F.array(*[F.substring("path", 1, k) for k in lengths])) if lengths else F.array().cast("array<string>")
    expressions = F.when(F.col("host") != "", F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p)))))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    keyed = rows.withColumn("expression", F.explode_outer(expressions)).withColumn("digest", F.sha2("expression", 256))
    keyed = keyed.select("row", "page_id", "host", "path", "digest", F.substring("digest", 1, HASH_CHARS).alias("short"))
    named = rules.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("full", F.sha2("rule", 256))
    named = named.select("action", "rule", "full", F.substring("full", 1, HASH_CHARS).alias("prefix"))
    hits = keyed.join(named, keyed["short"] == named["prefix"], "left")
    # Longest first, then block before allow, then by string; without an order where only the short hash fits.
    order = F.when(F.col("digest") == F.col("full"), F.struct(-F.length("rule"), F.when(F.col("action") == "block", 0).otherwise(1), F.col("rule")))
    best = hits.groupBy("row", "page_id", "host", "path").agg(F.min_by(F.struct("rule", "action"), order).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
