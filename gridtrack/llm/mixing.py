"""Mixing sources to target weights: word blocks, multinomial draws per output shard, index permutations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, lean, materialize, row_key

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Words in a block, least blocks in an output shard, most output shards, documents in a packing bucket.
BLOCK, SLOTS, SHARDS, BUCKET = 128, 4096, 8192, 2000
#: Most (output shard, source) pairs, which the driver lists; most sources that every task gets.
RANGES, NAMED = 1_000_000, 100_000
#: Repeated rows that are packed and cut together.
COPIES = 100
SEED = 20240229
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words to take from each source, for sizes in order of the sources; the weights repeat along it.

    ``share`` times all words are dealt by weight; a target stops at ``most`` times its source and what is above goes
    to the others by weight, until none is above.
    """
    size, w = np.array(sizes, float), np.resize(np.array(weights, float), len(sizes))
    cap, out, free = most * size, np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = share * size.sum()
    while free.any():
        out[free] = left * w[free] / w[free].sum()
        above = free & (out > cap)
        if not above.any():
            break
        out[above] = cap[above]
        left -= cap[above].sum()
        free &= ~above
    return out.tolist()


def shard_draws(slots: np.ndarray, shards: int, seed: int) -> Iterator[np.ndarray]:
    """Slots of each source in each output shard: multinomial by what each source has left, which no draw exceeds.

    Drawing by what is left makes the totals equal ``slots``, whatever the shards drew before.
    """
    rng, left = np.random.default_rng(seed), slots.astype(np.int64).copy()
    for k in range(shards):
        want, got = -(-int(left.sum()) // (shards - k)), np.zeros_like(left)
        while want:
            rest = left - got
            draw = np.minimum(rng.multinomial(want, rest / rest.sum()), rest)
            got += draw
            want -= int(draw.sum())
        left -= got
        yield got


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..size-1 chosen by ``key``: a Feistel network over the least 4 ** h that holds
    ``size``, applied again to what falls outside, which ends since the network is itself a permutation."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask, out = np.uint64((1 << half) - 1), index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            f = right + np.uint64((key * _MIX[0] + (r + 1) * _MIX[1]) % 2**64)
            f = (f ^ (f >> np.uint64(30))) * np.uint64(_MIX[1])
            f = (f ^ (f >> np.uint64(27))) * np.uint64(_MIX[2])
            left, right = right, left ^ ((f ^ (f >> np.uint64(31))) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def _slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each output slot of a shard's ranges: its pass over the source and the block it takes in that pass."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for r in batch.itertuples(index=False):
                for src, blocks, first, n in np.frombuffer(r.ranges, "<i8").reshape(-1, 4).tolist():
                    for at in range(first, first + n, 100_000):
                        i = np.arange(at, min(at + 100_000, first + n), dtype=np.int64)
                        turn, block = i // blocks, np.empty_like(i)
                        for e in np.unique(turn):
                            here = turn == e
                            block[here] = permute(i[here] - e * blocks, blocks, (r.seed * 1_000_003 + src) * 1_000_003 + int(e))
                        yield pd.DataFrame({"shard": r.shard, "src": src, "turn": turn, "block": block})


class Mix:
    """A mix of ``docs`` by source.

    Sizes are words (null and empty texts: 0). The words of a source, in order of a hash bucket and then doc_id, are
    packed into blocks of ``block`` words regardless of document ends. Output slots of a source are numbered over all
    shards; slot i takes, in pass i // blocks, the block that this pass's permutation gives for i % blocks. So a block
    is taken at most ``most`` times and all blocks equally often but for one pass. Everything follows from the rows
    and ``seed``: reruns agree. A null source is a source, last in order. Repeated rows are packed as separate rows,
    ``COPIES`` of them together. An empty table gives an empty mix. On the driver are the table of sources (one row
    each) and at most ``RANGES`` pairs of an output shard and a source, or one shard's, of 32 bytes each.

    Slots and pieces are far more than the ranges and documents by which Spark judges their size, so joins with them are
    merged: else they are broadcast through the driver.
    """

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, block=BLOCK, seed=SEED, doc_id="doc_id", text="text", source="source"):
        spark, self.block, self.docs, self.text = docs.sparkSession, block, docs, text
        self.key = row_key(docs)
        sized = docs.select(F.col(doc_id).alias("doc_id"), self.key.alias("key"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"))
        # equal rows are counted, then dealt in runs, so that no bucket and no cut document holds all copies of a row
        sized = sized.groupBy(*sized.columns).agg(F.count("*").alias("n"))
        sized = sized.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
        self.sized = materialize(sized.withColumn("copies", F.least(F.lit(COPIES), F.col("n") - F.col("run") * COPIES)).drop("n"), "sizes")
        by_source = self.sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("w"), F.sum("copies").alias("n"))
        found = {r["source"]: (r["w"] or 0, r["n"]) for r in by_source.collect()}
        order = sorted(found, key=lambda s: (s is None, s or ""))
        sizes, rows = [found[s][0] for s in order], sum(n for _, n in found.values())
        goal = targets(sizes, weights, share, most)
        blocks = [-(-w // block) for w in sizes]
        slots = np.array([round(t * b / w) if w else 0 for t, b, w in zip(goal, blocks, sizes, strict=True)], np.int64)
        total = int(slots.sum())
        shards = min(SHARDS, -(-total // SLOTS), max(1, RANGES // max(1, len(order))))
        self.named, ranges, first, sizes_in_blocks = len(order), [], np.zeros_like(slots), np.array(blocks, np.int64)
        for k, got in enumerate(shard_draws(slots, shards, seed)):
            s = got.nonzero()[0]
            ranges.append((k, seed, np.stack([s, sizes_in_blocks[s], first[s], got[s]], 1).astype("<i8").tobytes()))
            first += got
        self.sources = spark.createDataFrame(list(zip(range(len(order)), order, sizes, goal, strict=True)), "src long, source string, source_size long, target double")
        ranges = spark.createDataFrame(ranges, "shard long, seed long, ranges binary").repartition(max(1, min(shards, 1000)))
        #: (shard, src, turn, block): the mix, one row per output slot
        self.slots = ranges.mapInPandas(lean(_slots), "shard long, src long, turn long, block long")
        self.packed = self._pack(max(1, rows // BUCKET))

    def _pack(self, buckets: int) -> DataFrame:
        """Every document with its source and the position of its first word in the source, by two prefix sums."""
        named = self.sources.select("src", "source_size", "target", F.col("source").alias("_s"))
        if self.named <= NAMED:  # one row per source; more are joined by source, where adaptive execution splits a hot one
            named = F.broadcast(named)
        s = self.sized.join(named, self.sized["source"].eqNullSafe(named["_s"])).drop("_s", "source")
        s = s.withColumn("bucket", F.pmod(F.when(F.col("run") == 0, F.col("key")).otherwise(F.xxhash64("key", "run")), F.lit(buckets)))
        s = s.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")
        sums = s.groupBy("src", "bucket").agg(F.sum("size").alias("words"))
        before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("src", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("src", "bucket").orderBy("doc_id", "key", "run")
        s = s.withColumn("ord", F.row_number().over(inside)).withColumn("inner", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        return s.join(sums, ["src", "bucket"]).withColumn("off", F.col("base") + F.col("inner")).drop("base", "inner")

    def pieces(self) -> DataFrame:
        """The words [lo, hi) of each document in each block it reaches; a null block for a document without words."""
        b = F.lit(self.block)
        spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("off") / b), F.floor((F.col("off") + F.col("size") - 1) / b)))
        p = self.packed.withColumn("block", F.explode_outer(spans))
        return p.withColumn("lo", F.greatest(F.col("block") * b - F.col("off"), F.lit(0))).withColumn("hi", F.least((F.col("block") + 1) * b - F.col("off"), F.col("size")))

    def taken(self) -> DataFrame:
        """Per document: doc_id, size, source_size, target, taken."""
        times = self.slots.groupBy("src", "block").agg(F.count("*").alias("times"))
        hit = self.pieces().join(times.hint("merge"), ["src", "block"], "left")
        words = F.coalesce((F.col("hi") - F.col("lo")) * F.col("times"), F.lit(0))
        return hit.groupBy("src", "bucket", "ord", "doc_id", "size", "source_size", "target").agg(F.sum(words).cast("bigint").alias("taken")).drop("src", "bucket", "ord")

    def documents(self, n_chars: str | None = None) -> DataFrame:
        """The mix as documents: a row per document and pass that takes words of it, with the text of those words.

        What lies between taken words stays as it was; where words are left out, a line break takes their place. A
        document that no pass takes words of is not in the mix. ``n_chars`` names a column to hold the new length.
        """
        names = self.docs.columns
        key, spans = fresh(names, "_key", "_spans")
        hit = self.pieces().where("block is not null").join(self.slots.select("src", "turn", "block").hint("merge"), ["src", "block"])
        hit = hit.groupBy("key", "run").agg(F.collect_list(F.struct("bucket", "ord", "turn", "lo", "hi", "size")).alias(spans)).select(F.col("key").alias(key), spans)
        rows = self.docs.withColumn(key, self.key).dropDuplicates([key])  # equal rows come back by their own spans
        at, text = names.index(self.text), self.text

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            word = re.compile(WORD)
            for batch in batches:
                out = []
                for row in batch.itertuples(index=False, name=None):
                    row, all_spans = row[:-1], row[-1]
                    by: dict[tuple, list] = {}
                    for s in all_spans:
                        by.setdefault((s["ord"], s["turn"]), []).append((s["lo"], s["hi"], s["size"]))
                    ends = None
                    for _, runs in sorted(by.items()):
                        runs.sort()
                        if sum(hi - lo for lo, hi, _ in runs) == runs[0][2]:
                            out.append(row)
                            continue
                        ends = ends or [m.span() for m in word.finditer(row[at])]
                        merged: list[list[int]] = []
                        for lo, hi, _ in runs:
                            if merged and merged[-1][1] == lo:
                                merged[-1][1] = hi
                            else:
                                merged.append([lo, hi])
                        part = "\n".join(row[at][ends[lo][0] : ends[hi - 1][1]] for lo, hi in merged)
                        out.append((*row[:at], part, *row[at + 1 :]))
                yield pd.DataFrame(out, columns=names, dtype=object) if out else pd.DataFrame(columns=names)

        mixed = rows.join(hit.hint("merge"), key).drop(key).mapInPandas(lean(cut), self.docs.schema)
        return mixed.withColumn(n_chars, F.length(text).cast(self.docs.schema[n_chars].dataType)) if n_chars else mixed


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).taken()
