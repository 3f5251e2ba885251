"""URL filters: sort-merge range join over reversed-host keys with a stack of nested rules, over ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

#: Repeated rows made at once.
RUN = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host lies between the first ``://`` and ``/``, ``?``, ``#`` or the end; path ends at ``?`` or ``#``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.lit("|"), url), "://", 1))
    rest = F.when(rest.isNotNull(), F.substr(url, F.length(rest) + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def host_key(host: Column) -> Column:
    """Host labels in reverse, each ended by a dot: a host and its subdomains form one interval of keys."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _sweep(rows: DataFrame, marks: DataFrame, key: str, stack: str) -> DataFrame:
    """``rows`` with the ``stack`` of the last of ``marks`` (key, stack) at or before each row's key, else null.

    Rows and marks are cut together into ranges of their order, in which a hash of the row follows the key, so one key
    may fill many ranges. What is open where a range begins is the last mark of the ranges before it: one row each.
    """
    spark, kind, salt, part = rows.sparkSession, *fresh([*rows.columns, stack], "_kind", "_salt", "_part")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = rows.withColumn(kind, F.lit(1)).withColumn(salt, F.xxhash64(*rows.columns))
    both = rows.unionByName(marks.withColumn(kind, F.lit(0)), allowMissingColumns=True)
    ranged = materialize(both.repartitionByRange(parts, key, kind, salt).withColumn(part, F.spark_partition_id()), "ranges")
    last = ranged.where(F.col(kind) == 0).groupBy(part).agg(F.max_by(stack, key).alias(stack))
    every = spark.range(parts).select(F.col("id").cast("int").alias(part)).join(last, part, "left")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    begin = every.select(part, F.last(stack, ignorenulls=True).over(before).alias(stack), F.lit("").alias(key), F.lit(0).alias(kind))
    order = Window.partitionBy(part).orderBy(key, kind).rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.unionByName(begin.where(F.col(stack).isNotNull()), allowMissingColumns=True)
    return swept.withColumn(stack, F.last(stack, ignorenulls=True).over(order)).where(F.col(kind) == 1).drop(kind, salt, part)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict of every row of ``pages`` under ``rules`` (host, path, verdict).

    A rule fits its host and all subdomains if the path of the url starts with the rule's path; of those that fit the
    longest (host and path together, then the host, then the smaller verdict) wins. Null urls and urls without
    ``://`` have an empty host and path, fit no rule and get ``default``, as does every url that no rule fits.
    Repeated rows each get a row; repeated rules count once; null rules and rules without a host are dropped; other
    columns are ignored.

    The first sweep, by host key, gives each url the rule hosts open at it: a rule host's interval holds every later
    key that starts with its own, so they are among the ancestors of the last rule host at or before the url. The
    second, by host key and path for each of those hosts, gives the rules open there in the same way. Rules are sorted
    among the urls and copied nowhere; a stack holds nested rules only, whatever the number of a host's rules.
    """
    host, path = url_parts(F.col("_url"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.groupBy("page_id", "host", "path").agg(F.count("*").alias("_n"))

    rules = rules.where("host is not null and path is not null and verdict is not null")
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").where(r"host <> '' and not host rlike '[/?#]'")
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("_key", host_key(F.col("host")))
    hosts = rules.select("_key").distinct()
    # every ancestor of a rule host is a prefix of its key that ends at a label
    labels = F.split(F.regexp_replace("_key", r"\.$", ""), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))
    above = hosts.select("_key", F.explode(above).alias("_up")).join(hosts.select(F.col("_key").alias("_up")), "_up")
    open_hosts = above.groupBy("_key").agg(F.collect_list("_up").alias("_open"))

    # a rule's nested rules are prefixes of its path, of a length that a rule of the host has
    sizes = rules.select("_key", F.length("path").alias("_size")).distinct()
    inner = rules.select("_key", "path").join(sizes, "_key").where(F.length("path") >= F.col("_size"))
    inner = inner.select("_key", F.col("path").alias("_path"), F.col("path").substr(F.lit(1), F.col("_size")).alias("path"))
    at = F.concat("_key", F.lit("/"), "path")
    size = F.length("host") + F.length("path")
    rule = F.struct(size.alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict", at.alias("at"))
    open_rules = inner.join(rules.select("_key", "path", rule.alias("_rule")), ["_key", "path"]).groupBy("_key", "_path").agg(F.collect_list("_rule").alias("_open"))
    open_rules = open_rules.select(F.concat("_key", F.lit("/"), "_path").alias("_key"), "_open")

    swept = _sweep(rows.withColumn("_key", host_key(F.col("host"))), open_hosts, "_key", "_open")
    swept = swept.withColumn("_host", F.explode_outer(F.filter("_open", lambda h: F.startswith(F.col("_key"), h)))).drop("_key", "_open")
    swept = swept.withColumn("_key", F.coalesce(F.concat("_host", F.lit("/"), "path"), F.lit(""))).drop("_host")
    swept = _sweep(swept, open_rules, "_key", "_open")
    best = F.array_max(F.filter("_open", lambda r: F.startswith(F.col("_key"), r["at"])))
    judged = swept.withColumn("_best", best).groupBy("page_id", "host", "path", "_n").agg(F.max("_best").alias("_best"))
    judged = judged.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"), "_n")
    # repeated rows come back in runs, so that no array grows with them
    judged = judged.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / RUN))))
    judged = judged.withColumn("_row", F.explode(F.sequence(F.lit(1), F.least(F.lit(RUN), F.col("_n") - F.col("_run") * RUN))))
    return judged.drop("_n", "_run", "_row")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark, RULES))


OP9_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u
), q AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM p
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), m AS (
  SELECT q.page_id, q.host, q.path, r.rhost || r.rpath AS rule, r.verdict
  FROM q LEFT JOIN r ON (q.host = r.rhost OR ends_with(q.host, '.' || r.rhost)) AND starts_with(q.path, r.rpath)
)
SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, coalesce(arg_max(verdict, length(rule)), 'allow') AS verdict
FROM m GROUP BY page_id, host, path
"""
