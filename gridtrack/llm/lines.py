"""Line dedup by distinct-site spread: HyperLogLog sketches per line, exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, materialize, row_key

MIN_SITES = 10
#: Bits of an HLL sketch (relative error 1.04 / sqrt(2 ** bits), 1.6 %) and the band around the threshold that is counted exactly: over ten errors wide.
LG_K, BAND = 12, 0.2
#: Most boilerplate lines that the plan itself holds, as 8-byte hashes: 80 kB.
INLINE_LINES = 10_000


def line_array(text: Column) -> Column:
    return F.split(text, "\n")


def line_hash(line: Column) -> Column:
    """Hash of a line without outer white space; null for blank lines, which are never boilerplate."""
    bare = F.regexp_replace(line, r"^\s+|\s+$", "")
    return F.when(bare != "", F.xxhash64(bare))


def spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text", site: str = "source") -> DataFrame:
    """(h): hashes of the lines that occur on at least ``min_sites`` distinct sites.

    One HLL sketch of sites per line, merged by aggregation, so a line that fills a third of all rows is combined
    before the shuffle. Sketches below the band are dropped, above it taken; inside it sites are counted exactly.
    A null site is one site of its own.
    """
    per_line = docs.select(F.coalesce(F.col(site).cast("string"), F.lit("\x00")).alias("site"), F.explode(F.array_distinct(F.transform(line_array(F.col(text)), line_hash))).alias("h"))
    per_line = per_line.where("h is not null")
    rough = per_line.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("n")) if min_sites > 1 else per_line.select("h", F.lit(1).alias("n")).distinct()
    rough = materialize(rough.where(F.col("n") >= min_sites * (1 - BAND)), "line-spread")
    near = rough.where(F.col("n") < min_sites * (1 + BAND)).select("h")
    exact = per_line.join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count("*").alias("n"))
    return rough.where(F.col("n") >= min_sites * (1 + BAND)).select("h").unionByName(exact.where(F.col("n") >= min_sites).select("h"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, max_share: float | None = None, text: str = "text", site: str = "source", removed: str | None = None) -> DataFrame:
    """``docs`` with the lines removed that occur on ``min_sites`` or more sites; all other columns pass unchanged.

    A line counts without its outer white space; blank lines always stay. A document that would lose all its other
    lines is a copy as a whole and stays, for document dedup to judge; with ``max_share`` one that would lose more than
    that share of its characters stays instead. Null texts stay null; empty texts stay empty; repeated rows are
    treated alike; an empty table returns an empty table. ``removed`` names a column for the number of lines removed.
    """
    spread = materialize(spread_lines(docs, min_sites, text, site), "boilerplate")
    count = spread.count()
    cut, key, lost = fresh(docs.columns, "_cut", "_key", "_lost")
    lines = line_array(F.col(text))
    if count <= INLINE_LINES:  # checked
        held = [r["h"] for r in spread.collect()]
        gone = lambda x: F.coalesce(line_hash(x).isin(held), F.lit(False)) if held else F.lit(False)
        return _without(docs.withColumn(lost, F.transform(lines, gone)), lost, text, max_share, removed)
    # otherwise the lines meet the list by a shuffle; AQE splits the rows of a frequent line. Only row keys and positions travel back.
    keyed = docs.withColumn(key, row_key(docs))
    hits = keyed.select(key, F.posexplode(F.transform(lines, line_hash)).alias("p", "h")).join(spread, "h", "left_semi")
    hits = hits.distinct().groupBy(key).agg(F.collect_set("p").alias(cut))
    out = keyed.join(hits, key, "left").withColumn(lost, F.transform(lines, lambda x, i: F.coalesce(F.array_contains(cut, i), F.lit(False)))).drop(cut, key)
    return _without(out, lost, text, max_share, removed)


def _without(docs: DataFrame, lost: str, text: str, max_share: float | None, removed: str | None) -> DataFrame:
    pairs = F.arrays_zip(line_array(F.col(text)).alias("line"), F.col(lost).alias("lost"))
    pick = lambda flag: F.transform(F.filter(pairs, lambda p: p["lost"] == flag), lambda p: p["line"])
    kept, gone = F.array_join(pick(False), "\n"), F.array_join(pick(True), "\n")
    if max_share is None:
        rest = F.exists(pairs, lambda p: ~p["lost"] & line_hash(p["line"]).isNotNull())
    else:
        rest = F.length(gone) <= F.length(text) * max_share
    act = F.exists(lost, lambda x: x) & rest
    if removed:
        docs = docs.withColumn(removed, F.when(act, F.size(pick(True))).otherwise(F.lit(0)))
    return docs.withColumn(text, F.when(act, kept).otherwise(F.col(text))).drop(lost)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines kept, n_removed and the text that stays, of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = dedup_lines(docs, removed="n_removed")
    return out.select("doc_id", F.coalesce(F.size(line_array(F.col("text"))), F.lit(0)).alias("n_lines"), F.col("n_removed").cast("int").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


# A document without lines of its own, blank ones aside, is a copy as a whole and stays, as in dedup_lines.
OP7_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS site, text, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT r, doc_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d
), k AS (
  SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS bare FROM l
), b AS (
  SELECT bare FROM k WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= {MIN_SITES}
), m AS (
  SELECT k.r, k.p, k.line, k.bare, b.bare IS NOT NULL AS gone FROM k LEFT JOIN b ON k.bare = b.bare
), g AS (
  SELECT r, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '') AS kept,
         count(*) FILTER (WHERE gone) AS n_gone, count(*) FILTER (WHERE NOT gone AND bare <> '') AS n_own
  FROM m GROUP BY r
), o AS (
  SELECT d.doc_id, CASE WHEN n_gone > 0 AND n_own > 0 THEN kept ELSE d.text END AS text,
         CASE WHEN n_gone > 0 AND n_own > 0 THEN n_gone ELSE 0 END AS n_removed
  FROM d LEFT JOIN g ON d.r = g.r
)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END::INT AS n_lines,
       n_removed::INT AS n_removed, sha256(coalesce(text, '')) AS text_sha256 FROM o
"""
