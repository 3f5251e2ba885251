"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Labelled rows that the trees are fitted on, at most.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, L2, LEAST = 64, 80, 4, 0.15, 1.0, 5

_SETS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t",
    "line": b"\n", "quote": b"\"'", "stop": b".?!", "mark": b"#$%&*", "bar": b"|", "bang": b"!", "other": b"@+/\\<=>^_~{}[]`", "high": bytes(range(128, 256)),
}
FEATURES = ["log_bytes", "log_words", "word_length", "long_words", "distinct_words", "capital_words", "alpha_words", "lines", "line_length", "distinct_lines", "short_lines", "entropy", *_SETS]
_MEMBER = np.zeros((256, len(_SETS)))
for _k, _v in enumerate(_SETS.values()):
    _MEMBER[list(_v), _k] = 1


def statistics(text: str | None) -> np.ndarray:
    """Statistics of a whole text; zeros for a null or empty one."""
    raw = (text or "").encode()
    if not raw:
        return np.zeros(len(FEATURES))
    n = len(raw)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = hist[hist > 0] / n
    words, lines = raw.split(), raw.split(b"\n")
    w = max(1, len(words))
    letters = len(raw) - hist[32] - hist[9:14].sum()
    return np.concatenate([
        [np.log1p(n), np.log1p(len(words)), letters / w, sum(map(len, words)) and max(map(len, words)) / (letters / w or 1), len(set(words)) / w,
         sum(map(bytes.istitle, words)) / w, sum(map(bytes.isalpha, words)) / w, len(lines) / w, np.log1p(n / len(lines)), len(set(lines)) / len(lines),
         sum(len(x) < 30 for x in lines) / len(lines), -(p * np.log2(p)).sum()],
        hist @ _MEMBER / n,
    ])


class BoostedTrees:
    """Trees of one depth in arrays: node i of a tree has children 2i + 1 and 2i + 2; the last level holds values."""

    def __init__(self, start: float, feature: np.ndarray, cut: np.ndarray, value: np.ndarray):
        self.start, self.feature, self.cut, self.value = start, feature, cut, value

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> BoostedTrees:
        """Logistic loss, second-order gains on histograms of at most ``BINS`` quantile bins. One class only, or no
        rows: no trees, and the share of label 1 (a half without rows), smoothed by one row of each, as score."""
        share = (y.sum() + 1) / (len(y) + 2)
        start = float(np.log(share / (1 - share)))
        inner, leaves = 2**depth - 1, 2**depth
        empty = np.zeros((0, inner), int)
        if len(np.unique(y)) < 2:
            return cls(start, empty, empty.astype(float), np.zeros((0, leaves)))
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
        f_all, c_all, v_all, score = [], [], [], np.full(len(y), start)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            feature, cut, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
            for level in range(depth):
                width, first = 2**level, 2**level - 1
                best = np.zeros(width)
                chosen = np.full(width, -1)
                bin_of = np.zeros(width, int)
                for f in range(len(x.T)):
                    key = node * BINS + binned[f]
                    gs, hs, ns = (np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h, None))
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + L2) + (gt - gs) ** 2 / (ht - hs + L2) - gt**2 / (ht + L2)
                    gain[(ns < LEAST) | (nt - ns < LEAST)] = 0
                    at = gain[:, :-1].argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best + 1e-12
                    best[better], chosen[better], bin_of[better] = top[better], f, at[better]
                for k in np.flatnonzero(chosen >= 0):
                    feature[first + k], cut[first + k] = chosen[k], edges[chosen[k]][bin_of[k]] if bin_of[k] < len(edges[chosen[k]]) else np.inf
                node = 2 * node + (x[np.arange(len(x)), feature[first + node]] > cut[first + node])
            gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
            value = -rate * gs / (hs + L2)
            score += value[node]
            f_all.append(feature)
            c_all.append(cut)
            v_all.append(value)
        return cls(start, np.stack(f_all), np.stack(c_all), np.stack(v_all))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1: all rows walk down each tree at once."""
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), int)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return 1 / (1 + np.exp(-out))


def held_out(doc_id: Column, modulus: int = 3, rest: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> BoostedTrees:
    """Trees from at most ``sample`` labelled documents, the first by a hash of doc_id among those not held out.

    Labels that are null or neither 0 nor 1 are left out; a doc_id with several labels counts with each, and rows
    that repeat count as often as they stand. Ties in the hash go by doc_id and label. Other columns, whatever their
    names, are not read. Empty tables, or no usable label, give no trees: every score is then the share of label 1.
    """
    usable = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(doc_id))).select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
    picked = usable.orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["_y"], "x": [statistics(t).tobytes() for t in batch["text"]]})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))  # sample rows
    got = rows.select("_y", "text").mapInPandas(run, "y int, x binary").toPandas()
    x = np.stack([np.frombuffer(b) for b in got["x"]]) if len(got) else np.zeros((0, len(FEATURES)))
    y = got["y"].to_numpy(float)
    order = np.lexsort((*x.T, y)) if len(x) else []  # the same trees in whatever order rows arrive
    return BoostedTrees.fit(x[order], y[order]) if len(x) else BoostedTrees.fit(x, y)


def score_documents(docs: DataFrame, trees: BoostedTrees, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the chance of label 1 as one more column, the last.

    Statistics are of whole texts, however long; null and empty texts have all statistics 0. Equal texts have equal
    scores, repeated rows each get theirs; an empty table stays empty. If ``docs`` has a column of that name, the new
    one's gets underscores.
    """
    name = fresh(docs.columns, name)[0]
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def predict(texts: pd.Series) -> pd.Series:
        x = np.stack([statistics(t if isinstance(t, str) else None) for t in texts]) if len(texts) else np.zeros((0, len(FEATURES)))
        return pd.Series(shared.value.score(x))

    return docs.withColumn(name, predict(F.col(f"`{text}`")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score_documents(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
