"""Exact top-k inner products with vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

K, EVERY, SCALE = 20, 20, 64
#: Bits of a cell number in each dimension; vectors in a block of cells, in a block of queries, and in a task's read.
BITS, ROWS, QUERIES = 6, 16_384, 256
_LONG, _HUGE = 2**63 - 1, int(1e308)


def sound_vector(v: Column) -> Column:
    """The vector as doubles; null if it is null or empty or holds null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: bad(x.cast("double"))), F.transform(v, lambda x: x.cast("double")))


def _packed(m: np.ndarray) -> tuple[str, bytes]:
    """The bytes of integral doubles in the least integer type that holds them, or as doubles beyond 53 bits."""
    kind = next((t for t in (np.int8, np.int16, np.int32, np.int64) if len(m) and np.iinfo(t).min <= m.min() and m.max() <= min(np.iinfo(t).max, 2**53)), np.float64)
    return np.dtype(kind).str, m.astype(kind).tobytes()


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integral doubles, pair by pair, as integers."""
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a * b).sum(1).astype(np.int64)
    return np.array([sum(int(x) * int(y) for x, y in zip(r, s, strict=True)) for r, s in zip(a, b, strict=True)], object)


class Cells:
    """A vector-approximation file's block: cell numbers of ``BITS`` bits a dimension, and where each cell begins.

    Dimension d's values lie in cells of one width; a value in cell z is at least low[d] + z * width[d] and at most
    width[d] - 1 more. Inner products are bounded from the cells alone.
    """

    def __init__(self, low: np.ndarray, width: np.ndarray, cells: np.ndarray):
        self.low, self.width, self.cells = low, width, cells

    @classmethod
    def of(cls, m: np.ndarray, bits: int = BITS) -> Cells:
        low = m.min(0)
        width = np.exp2(np.ceil(np.log2(np.maximum((m.max(0) - low + 1) / 2**bits, 1))))  # powers of two: exact sums
        return cls(low, width, np.minimum((m - low) // width, 2**bits - 1).astype(np.uint8))

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) inner product of each of ``q`` (queries, dimensions) with each row: (queries, rows)."""
        with np.errstate(over="ignore", invalid="ignore"):
            step = q * self.width
            base = step @ self.cells.T.astype(np.float64) + (q @ self.low)[:, None]
            room = q * (self.width - 1)
            slack = 1e-9 * (np.abs(step) @ np.full(len(self.low), 2.0**BITS) + np.abs(q) @ np.abs(self.low))[:, None]
            slack = np.where(slack * 1e9 < 2.0**52, 0, slack)  # sums within 53 bits are exact
            low, high = base + np.minimum(room, 0).sum(1)[:, None] - slack, base + np.maximum(room, 0).sum(1)[:, None] + slack
        return np.nan_to_num(low, nan=-np.inf, posinf=np.inf, neginf=-np.inf), np.nan_to_num(high, nan=np.inf, posinf=np.inf, neginf=-np.inf)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", seen: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows for each row whose vec_id is divisible by ``every``.

    Scores are exact inner products of floor(scale * x), as ranked; one beyond 64 bits is given as the nearest long. A
    vector whose scaled components overflow a double takes no part. Ties go to the smaller vec_id; rows that carry the query's own vec_id are no candidates. Vectors that are null or empty,
    hold null or non-finite components, or have a null vec_id take no part; vectors of another length are no candidates
    either. Repeated query rows each get their list, repeated candidates each a place. Fewer than ``k`` candidates are
    all returned; an empty table gives none; other columns, whatever their names, are not read.

    1. Every vector is written twice: exactly, and as cells in blocks, the vector-approximation file.
    2. Each block of queries scans each block of cells for bounds. The kth largest lower bound over all blocks is what
       a query's kth result is at least.
    3. A second scan of the cells keeps the rows whose upper bound reaches that. The ``2 * k`` of them with the largest
       upper bounds are read exactly; of the others, only those whose bound reaches the kth exact score found.

    ``seen`` collects the two tables of exact reads, for counting them.
    """
    spark = vectors.sparkSession
    v = sound_vector(F.col(embedding))
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dim"), "v")

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            packed = [_packed(np.floor(np.asarray(x, float) * scale)) if np.isfinite(np.asarray(x, float) * scale).all() else ("", b"") for x in batch["v"]]
            yield batch[["row", "vec_id", "dim"]].assign(kind=[p[0] for p in packed], data=[p[1] for p in packed])

    rows = materialize(rows.mapInPandas(exact, "row long, vec_id long, dim int, kind string, data binary").where("kind <> ''"), "vectors")

    def unpack(batch: pd.DataFrame) -> np.ndarray:
        return np.stack([np.frombuffer(d, t).astype(np.float64) for d, t in zip(batch["data"], batch["kind"], strict=True)])

    def blocks(df: DataFrame, size: int, cells: bool, name: str) -> DataFrame:
        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list[pd.DataFrame]] = {}

            def out(dim: int, part: pd.DataFrame) -> dict:
                m = unpack(part)
                if not cells:
                    kind, data = _packed(m)
                    return {"kind": [kind], "data": [data], "low": [b""], "width": [b""]}
                c = Cells.of(m)
                return {"kind": ["|u1"], "data": [c.cells.tobytes()], "low": [c.low.tobytes()], "width": [c.width.tobytes()]}

            def flush(dim: int, all_of_it: bool) -> Iterator[pd.DataFrame]:
                whole = pd.concat(held.pop(dim))
                for at in range(0, len(whole), size):
                    part = whole.iloc[at : at + size]
                    if len(part) < size and not all_of_it:
                        held[dim] = [part]
                        return
                    yield pd.DataFrame({"dim": [dim], "rows": [part["row"].to_numpy(np.int64).tobytes()], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], **out(dim, part)})

            for batch in batches:
                for dim, part in batch.groupby("dim"):
                    held.setdefault(dim, []).append(part)
                    if sum(map(len, held[dim])) >= size:
                        yield from flush(dim, False)
            for dim in list(held):
                yield from flush(dim, True)

        n = max(1, -(-df.count() // size))
        packed = df.repartition(n).mapInPandas(pack, "dim int, rows binary, ids binary, kind string, data binary, low binary, width binary")
        return materialize(packed.withColumn("block", F.monotonically_increasing_id()), name)

    cells = blocks(rows, ROWS, True, "cells")
    query = blocks(rows.where(F.pmod("vec_id", F.lit(every)) == 0), QUERIES, False, "queries")
    # a row for each pair of a block of queries and one of cells; the cells, a byte a dimension, are what travels
    meet = query.select("dim", F.col("block").alias("qb")).join(cells.select("dim", F.col("block").alias("cb")), "dim").drop("dim")
    tasks = max(1, query.count() * cells.count())
    side = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in ("block", "dim", "rows", "ids", "kind", "data", "low", "width")])

    def paired(name: str, extra: DataFrame | None = None) -> DataFrame:
        out = meet if extra is None else meet.join(extra, "qb")
        out = out.join(side(query, "q").withColumnRenamed("qblock", "qb"), "qb").join(side(cells, "c").withColumnRenamed("cblock", "cb"), "cb")
        return out.repartition(min(tasks, 100_000), "qb", "cb")

    def read(r) -> tuple[np.ndarray, Cells, np.ndarray, np.ndarray]:
        q = np.frombuffer(r.qdata, r.qkind).reshape(-1, r.qdim).astype(np.float64)
        c = Cells(np.frombuffer(r.clow), np.frombuffer(r.cwidth), np.frombuffer(r.cdata, np.uint8).reshape(-1, r.cdim))
        return q, c, np.frombuffer(r.qids, np.int64), np.frombuffer(r.cids, np.int64)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q, c, qi, ci = read(r)
                low = np.where(qi[:, None] == ci[None, :], -np.inf, c.bounds(q)[0])
                if low.shape[1] > k:
                    low = np.partition(low, low.shape[1] - k, 1)[:, -k:]
                yield pd.DataFrame({"qb": r.qb, "part": r.cb % 64, "lows": [low.tobytes()], "n": [len(q)]})

    def merge(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        low = np.concatenate([np.frombuffer(x).reshape(int(n), -1) for x, n in zip(g["lows"], g["n"], strict=True)], 1)
        if low.shape[1] > k:
            low = np.partition(low, low.shape[1] - k, 1)[:, -k:]
        return pd.DataFrame({"qb": [key[0]], "part": [0], "lows": [low.tobytes()], "n": [len(low)]})

    spec = "qb long, part long, lows binary, n long"
    best = paired("bounds").mapInPandas(scan, spec).groupBy("qb", "part").applyInPandas(merge, spec).groupBy("qb").applyInPandas(merge, spec)
    best = materialize(best.select("qb", "lows"), "bounds")  # k doubles a query

    def survive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                q, c, qi, ci = read(r)
                kept = np.frombuffer(r.lows).reshape(len(q), -1)
                least = kept.min(1) if kept.shape[1] >= k else np.full(len(q), -np.inf)
                high = np.where(qi[:, None] == ci[None, :], np.nan, c.bounds(q)[1])
                i, j = np.nonzero(high >= least[:, None])
                qr, cr = np.frombuffer(r.qrows, np.int64), np.frombuffer(r.crows, np.int64)
                for at in range(0, len(i), 100_000):
                    own, other = i[at : at + 100_000], j[at : at + 100_000]
                    yield pd.DataFrame({"q": qr[own], "row": cr[other], "high": high[own, other]})

    open_ = materialize(paired("survivors", best).mapInPandas(survive, "q long, row long, high double"), "survivors")
    place = Window.partitionBy("q").orderBy(F.desc("high"), "row")
    first = open_.withColumn("place", F.row_number().over(place)).where(F.col("place") <= 2 * k)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            exact = np.zeros(len(batch), object)
            like = batch.assign(at=np.arange(len(batch)), n=[len(x) for x in batch["qd"]]).groupby(["qk", "kind", "n"])
            for (t, u, _), part in like:
                a, b = (np.frombuffer(b"".join(part[c]), x).reshape(len(part), -1).astype(np.float64) for c, x in (("qd", t), ("data", u)))
                exact[part["at"]] = _inner(a, b)
            yield batch[["q", "query_id", "row", "vec_id"]].assign(score=[max(-_LONG - 1, min(_LONG, int(x))) for x in exact], size=[float(max(-_HUGE, min(_HUGE, int(x)))) for x in exact], tail=["" if -_LONG <= x <= _LONG else f"{int(x) + (1 << 2200):x}" for x in exact])

    own = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("row").alias("q"), F.col("vec_id").alias("query_id"), F.col("kind").alias("qk"), F.col("data").alias("qd"))

    def scored(some: DataFrame, name: str) -> DataFrame:
        both = some.select("q", "row").join(own, "q").join(rows.select("row", "vec_id", "kind", "data"), "row")
        out = materialize(both.mapInPandas(score, "q long, query_id long, row long, vec_id long, score long, size double, tail string"), name)
        if seen is not None:
            seen.append(out)
        return out

    known = scored(first, "first")
    order = Window.partitionBy("q").orderBy(F.desc("size"), F.desc("score"), F.desc("tail"), "vec_id", "row")
    least = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("q", F.col("size").alias("least"))
    rest = open_.join(least, "q").where("high >= least").join(known.select("q", "row"), ["q", "row"], "left_anti")
    out = known.unionByName(scored(rest, "others"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
