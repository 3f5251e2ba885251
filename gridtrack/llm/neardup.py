"""Embedding near-dedup: p-stable Euclidean hashing into several tables, then exact cosines."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialize

COSINE, CELL, LOSS, FEWEST, SEED = 0.9, 1.5, 0.01, 12, 7
#: Unrelated vectors expected in a bucket, and the most vectors that one task compares with each other at once.
CROWD, BLOCK = 2048, 4096


def collision(distance: float, cell: float = CELL) -> float:
    """Chance that two points at this distance share a cell of one projection (Datar et al., 2004)."""
    r = cell / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def layout(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(projections in a key, tables): keys grow with the logarithm of n, so that a bucket holds about ``CROWD``
    unrelated vectors at any n; tables are as many as lose a pair right at the threshold with chance ``LOSS``."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    keys = max(1, math.ceil(math.log(max(n, 2) / CROWD) / -math.log(far)))
    return keys, max(FEWEST, math.ceil(math.log(LOSS) / math.log(1 - near**keys)))


def _hash(x: np.ndarray, keys: int, tables: int, cell: float, seed: int) -> np.ndarray:
    """Bucket of each vector in each table: the cells of ``keys`` Gaussian projections, mixed to 32 bits."""
    rng = np.random.default_rng([seed, x.shape[1]])
    lines, shift = rng.normal(size=(x.shape[1], tables * keys)), rng.uniform(0, cell, tables * keys)
    at = np.broadcast_to(shift, (len(x), len(shift))).copy()
    for j in range(x.shape[1]):  # one order of sums whatever rows come together, which a matrix product doesn't promise
        at += x[:, j : j + 1] * lines[j]
    cells = np.floor(at / cell).astype(np.int64).view(np.uint64).reshape(len(x), tables, keys)
    with np.errstate(over="ignore"):
        h = np.full((len(x), tables), x.shape[1], np.uint64)
        for k in range(keys):
            h = (h ^ cells[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return (h & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _groups(near: np.ndarray) -> np.ndarray:
    """Least index that each row of a symmetric boolean matrix can reach."""
    label = np.arange(len(near))
    todo = near.any(1)
    for v in range(len(near)):
        if todo[v]:
            front = near[v].copy()
            front[v] = True
            while True:
                wider = near[front].any(0) | front
                if (wider == front).all():
                    break
                front = wider
            label[front], todo[front] = v, False
    return label


def _sent(x: np.ndarray) -> bytes:
    """A vector's bytes: as floats if that is what it holds, else as doubles, after a byte that says which."""
    with np.errstate(over="ignore"):
        small = x.astype(np.float32)
    return b"f" + small.tobytes() if (small == x).all() else b"d" + x.tobytes()


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, r[:1].decode(), offset=1).astype(np.float64) for r in raw])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _linked(v: np.ndarray, m: np.ndarray, own: np.ndarray, x: list[np.ndarray], code, cosine: float, across: bool) -> list[tuple]:
    """[(ids, links counted here, least id of the group)] of one bucket, or of the pairs across its two blocks.

    ``x`` are unit vectors; ``code`` gives the buckets that vectors have in the tables before this one.
    """
    by_size = {len(r) for r in x}
    if len(by_size) > 1:  # lengths differ only where hashes of two lengths collide
        out = []
        for size in by_size:
            at = [k for k, r in enumerate(x) if len(r) == size]
            out += _linked(v[at], m[at], own[at], [x[k] for k in at], code, cosine, across)
        return out
    x = np.stack(x)
    near = np.empty((len(x), len(x)), bool)
    for lo in range(0, len(x), 512):
        near[lo : lo + 512] = x[lo : lo + 512] @ x.T >= cosine
    near &= near.T
    np.fill_diagonal(near, False)
    if across:
        near &= own[:, None] != own[None, :]
    hit = np.flatnonzero(near.any(1))
    if not len(hit):
        return []
    near = joined = near[np.ix_(hit, hit)]
    before = code(x[hit])
    if before.shape[1]:
        near = near.copy()
        for t in range(before.shape[1]):
            near &= before[:, t][:, None] != before[:, t][None, :]
    return [(v[hit], near @ m[hit], v[hit][_groups(joined)])]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cell: float = CELL, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors``; other columns are ignored.

    Two vectors of one length link if a table has them in one bucket and their cosine, in double precision, is
    ``cosine`` or more. Vectors that are null, empty, all zero or hold null or non-finite components link with nothing:
    n_links 0, their own component, kept. Equal vectors are one class and count as each other's links. A null vec_id
    counts as a link of others but is no component's name; if alone, its component_id is null and it is kept.

    Rows with one key are at most ``BLOCK``: a fuller bucket is cut into blocks and each pair of blocks is a task. A
    pair counts in the first table that joins it, so links need no list of pairs: tasks return a count for each
    vector and a spanning star of each group.
    """
    v = F.col(embedding)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.coalesce(v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.when(sound, v.cast("array<double>")).alias("x"))
    rows = rows.withColumn("class", F.when(F.col("x").isNotNull(), F.sha2(F.array_join(F.transform("x", lambda c: F.hex(c.cast("string").cast("binary"))), ","), 256)))
    reps = rows.where("x is not null").groupBy("class").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"), F.first("x").alias("x"))
    reps = materialize(reps.withColumn("v", F.xxhash64("class")), "vectors")
    n = reps.count()
    keys, tables = layout(n, cosine)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["x"].map(len)):
                sent = [_sent(np.asarray(r, float)) for r in part["x"]]
                codes = _hash(_unit(sent), keys, tables, cell, seed)
                for t in range(tables):
                    yield pd.DataFrame({"t": t, "bucket": codes[:, t], "v": part["v"].to_numpy(), "m": part["m"].to_numpy(), "x": sent})

    dealt = reps.select("v", "m", "x").mapInPandas(deal, "t int, bucket long, v long, m long, x binary")
    full = reps.select("v", "m", "x").mapInPandas(_only_keys(deal), "t int, bucket long").groupBy("t", "bucket").agg(F.count("*").alias("n"))
    full = materialize(full.where(F.col("n") > 1).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "buckets")
    part = F.pmod(F.col("v"), F.col("blocks")).cast("int")
    dealt = dealt.join(full, ["t", "bucket"]).withColumn("part", part)
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("many", F.col("blocks") > 1).drop("blocks")
    dealt = dealt.withColumn("i", F.least("part", "with")).withColumn("j", F.greatest("part", "with"))

    # buckets of one block share a task's call, as many as hold about one block's rows; a fuller bucket's pairs of blocks stay apart
    slots = max(1, -(-n // BLOCK))
    dealt = dealt.withColumn("slot", F.when(F.col("many"), F.col("bucket")).otherwise(F.pmod("bucket", F.lit(slots)))).drop("many")

    def compare(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["bucket", "v"], kind="stable")
        v, m, own, bucket = (g[c].to_numpy() for c in ("v", "m", "part", "bucket"))
        xs = [None] * len(g)
        for _, at in pd.Series(range(len(g))).groupby([len(r) * 2 + (r[:1] == b"d") for r in g["x"]]):
            for k, r in zip(at, _unit([g["x"].iloc[i] for i in at]), strict=True):
                xs[k] = r
        earlier = lambda x: _hash(x, keys, tables, cell, seed)[:, : key[0]]
        ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(g))
        out = []
        for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
            if hi - lo > 1:
                out += _linked(v[lo:hi], m[lo:hi], own[lo:hi], xs[lo:hi], earlier, cosine, key[2] != key[3])
        return pd.DataFrame(dict(zip(("v", "links", "other"), (np.concatenate(c) for c in zip(*out, strict=True)), strict=True))) if out else pd.DataFrame({"v": [], "links": [], "other": []})

    found = materialize(dealt.groupBy("t", "slot", "i", "j").applyInPandas(compare, "v long, links long, other long"), "links")
    group = components(found.select(F.col("v").alias("a"), F.col("other").alias("b")))
    count = found.groupBy("v").agg(F.sum("links").alias("links"))
    label = reps.select("class", "v", "id", "m").join(count, "v", "left").join(group.withColumnRenamed("id", "v"), "v", "left")
    label = materialize(label.withColumn("component", F.coalesce("component", "v")), "labels")
    first = label.groupBy("component").agg(F.min("id").alias("component_id"))
    label = materialize(label.join(first, "component").select("class", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id"), "classes")
    out = rows.select("vec_id", "class").join(label, "class", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _only_keys(deal):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in deal(batches):
            yield part[["t", "bucket"]]

    return run


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP3_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
), e AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_dot_product(a.x, b.x) >= 0.9 * sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))
), r(id, c) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id AND r.c < e.b
), g AS (
  SELECT id, min(c) AS c FROM r GROUP BY id
), n AS (
  SELECT a, count(*) AS n FROM e GROUP BY a
)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, g.c AS component_id, v.vec_id = g.c AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id JOIN g ON g.id = v.vec_id
"""
