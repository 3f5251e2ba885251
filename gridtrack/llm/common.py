"""Shared folder, materialised tables and connected components for the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset and all
    executors are threads of this process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own.setdefault(app, tempfile.mkdtemp(prefix="gridtrack-"))
    return f"{root.rstrip('/')}/gridtrack-{app}"


def tune(spark: SparkSession, rows: int = 1000, size: str = "4m") -> SparkSession:
    """Arrow batches of fewer rows and bytes than Spark's defaults, as rows here are whole texts, for this session;
    settings of one's own stay."""
    for key, default, own in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, own)
    return spark


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _own.get("hook"):
        _own["hook"] = "set"
        atexit.register(_cleanup)
    return spark.read.schema(df.schema).parquet(path)


def _cleanup() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        try:
            drop_tables(spark)
        except Exception as e:  # the JVM may be gone at exit; the folder is then left to its owner
            print(f"shared folder not removed: {type(e).__name__}")


def drop_tables(spark: SparkSession) -> None:
    """Remove what this application has materialised."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores added until it clashes with no column (Spark compares without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lean(run: Callable) -> Callable:
    """``run`` over the batches of a task; then the Python worker, which serves further stages, gives back to the system
    what its allocators hold but don't use."""

    def out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return out


def row_key(docs: DataFrame):
    """A hash of all columns of a row; maps, which Spark doesn't hash, by their text, and nulls, which add nothing, by
    their places."""
    own = [F.col(f"`{f.name}`") if "map<" not in f.dataType.simpleString() else F.col(f"`{f.name}`").cast("string") for f in docs.schema]
    return F.xxhash64(*own, F.concat(*[F.when(F.col(f"`{f.name}`").isNull(), "1").otherwise("0") for f in docs.schema]))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long) -> (id, component): the smallest id each id can reach.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is one aggregate by vertex and one
    join, edges never outgrow their number, and the number of rounds is logarithmic in practice. Ids without an edge
    to another id are not returned. Each round is cut by a written table, so a lost executor repeats one round at most.
    """
    links = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    links = materialize(links.distinct(), "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(links)
    while now[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # what each vertex above its own minimum keeps, so that no vertex is lost
        large = large.where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lower.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = materialize(small, "links")
        before, now = now, state(links)
        if before == now:
            break
    out = links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    roots = links.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return out.unionByName(roots)
