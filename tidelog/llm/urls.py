"""URL filter lists, applied by a sort-merge range join over reversed-host keys."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.llm.tables import keep

#: Host, path, verdict.
BASE_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.sql("select inline(array(" + ",".join("named_struct('host', '{}', 'path', '{}', 'verdict', '{}')".format(*(x.replace("\\", "\\\\").replace("'", "\\'") for x in r)) for r in rules) + "))")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and without ``://``."""
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot: subdomains are what starts with the key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _segments(rules: DataFrame) -> DataFrame:
    """Stretches of the key order with the stack of rules that are active in each: ``key`` (first), ``stack``.

    A rule host is active from its key up to the key with the last dot replaced by
    the next character. Such intervals nest, so a stretch's stack is the rules of the
    hosts above its first key; they are found by joining on those hosts' keys.
    """
    own = rules.where("host <> '' and path is not null").select(host_key(F.col("host")).alias("at"), F.struct(F.concat("host", "path").alias("rule"), "host", "path", "verdict").alias("r"))
    starts = own.select(F.col("at").alias("key"), F.col("at").alias("inner"))
    # after a rule's end the next outer rule goes on: the hosts above it, without its own
    outer = F.array_join(F.slice(F.split("at", r"\."), 1, F.size(F.split("at", r"\.")) - 2), ".")
    ends = own.select(F.concat(F.expr("substring(at, 1, length(at) - 1)"), F.lit("/")).alias("key"), F.concat(outer, F.when(outer != "", ".").otherwise("")).alias("inner"))
    points = starts.unionByName(ends).groupBy("key").agg(F.max("inner").alias("inner"))
    labels = F.split("inner", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    found = points.select("key", F.explode(above).alias("at")).join(own, "at", "left").groupBy("key").agg(F.collect_list("r").alias("stack"))
    return found


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", lanes: int | None = None) -> DataFrame:
    """Verdict of a rule list on every page's URL.

    Reads ``page_id`` and ``url`` of ``pages`` and ``host``, ``path``, ``verdict`` of
    ``rules``. Returns one row per page row: ``page_id``, ``host``, ``path``, ``rule``
    (host and path of the rule; null if none fits) and ``verdict`` (the rule's, else
    ``default``). A rule fits its host and all subdomains if the URL's path starts
    with its path; the longest rule wins, of equal length the first in order.

    Rules with a null or empty host or a null path fit nothing. Null URLs and those without ``://`` have an empty host and path and no rule.
    Repeated rows stay; an empty rule list judges all by ``default``.

    The starts and ends of the rules' intervals and the URLs are put in one order by
    range partitioning, in about ``lanes`` stretches; URLs of one host are spread
    over as many stretches as they fill, and each segment is in one stretch only.
    A sweep of a stretch carries the stack of active nested rules on to the URLs;
    it begins with the last stack of the stretches before, found from one row for
    each stretch. A stack has the rules of one host and of the hosts above it.
    """
    spark = pages.sparkSession
    lanes = lanes or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), F.lit(1).alias("turn"), F.xxhash64("page_id", "url").alias("spread"))
    urls = urls.withColumn("key", host_key(F.col("host")))
    marks = _segments(rules).select("key", "stack", F.lit(0).alias("turn"), F.lit(0).cast("bigint").alias("spread"))
    ordered = urls.unionByName(marks, allowMissingColumns=True).repartitionByRange(lanes, "key", "turn", "spread")
    # written once: the bounds of stretches are sampled anew in each run
    placed = keep(ordered.withColumn("stretch", F.spark_partition_id()), "url-stretches")
    ends = placed.groupBy("stretch").agg(F.max_by("stack", F.when(F.col("turn") == 0, F.col("key"))).alias("stack"))
    before = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    begins = ends.select("stretch", F.lit("").alias("key"), F.lit(-1).alias("turn"), F.last("stack", ignorenulls=True).over(before).alias("stack"))
    order = Window.partitionBy("stretch").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = placed.unionByName(begins, allowMissingColumns=True).withColumn("active", F.last("stack", ignorenulls=True).over(order)).where("turn = 1")
    fitting = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_min(F.transform(fitting, lambda r: F.struct((-F.length(r["rule"])).alias("short"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    swept = swept.withColumn("best", best)
    return swept.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
