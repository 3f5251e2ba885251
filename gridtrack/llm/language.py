"""Language ID by prediction by partial matching: frozen byte context trees, exact code lengths."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh

#: Most bytes before a symbol that predict it; at most 7, as a context and its symbol are one 64-bit number.
ORDER = 3
#: The sample that models are fitted on: documents of each language, and the most characters read of each.
SAMPLE, SAMPLE_CHARS = 200, 20_000
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_HASH = np.uint64(0x9E3779B97F4A7C15)


class _Index:
    """Rows of sorted distinct numbers, by open addressing: a few array reads for any number of lookups at once."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        size = 1 << int(64 - self.shift)
        self.mask, self.key, self.row = size - 1, np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.row[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            self.key[slot[first]], self.row[slot[first]] = keys[todo[first]], todo[first]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, slot = todo[rest], (slot[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _HASH) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The row of each number, -1 where it isn't one of the keys."""
        slot = self._slot(keys)
        out = self.row[slot]
        todo = np.flatnonzero((out >= 0) & (self.key[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            at = slot[todo]
            out[todo] = self.row[at]
            todo = todo[(self.row[at] >= 0) & (self.key[at] != keys[todo])]
        return out


class ContextTrees:
    """Code lengths, in bits, of a byte after up to ``order`` bytes, for each language.

    Counts of the training texts give trees of contexts. A context predicts what it has seen with count / (total +
    distinct) and leaves distinct / (total + distinct) as escape to the context one byte shorter, in which what was
    already seen is excluded; below the empty context all 256 bytes are alike. Counts are frozen, so for every
    (context, byte) that any language has seen the walk's result is stored for all languages, and for every context
    the bits of its escape, with exclusion, for all languages (0 where a language hasn't seen the context). What a
    byte costs is then one stored value and the escapes of the longer contexts above it. Nothing seen is left out.
    """

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        if not 0 <= order <= 7:
            raise ValueError("order must be 0 to 7")
        self.order, self.languages = order, sorted(samples)
        self.code, self.bits, self.context, self.escape = [], [], [], []
        below, keys = None, None  # probabilities one order down and their numbers
        for o in range(order + 1):
            counts = [self._count(samples[x], o) for x in self.languages]
            own = np.unique(np.concatenate([c for c, _ in counts])) if counts else np.zeros(0, np.uint64)
            heads, owner = np.unique(own >> np.uint64(8), return_inverse=True)
            p, escape = np.empty((len(own), len(counts)), np.float64), np.empty((len(heads), len(counts)), np.float32)
            lower = None if o == 0 else np.searchsorted(keys, own & np.uint64((1 << 8 * o) - 1))
            for k, (code, n) in enumerate(counts):
                seen = np.zeros(len(own))
                seen[np.searchsorted(own, code)] = n
                short = np.full(len(own), 1 / 256) if o == 0 else below[lower, k]
                total, distinct, mass = (np.bincount(owner, w, len(heads)) for w in (seen, seen > 0, np.where(seen > 0, short, 0)))
                room = np.where(distinct == 256, 0, np.maximum(1 - mass, 1e-12))
                with np.errstate(divide="ignore", invalid="ignore"):
                    left = np.where(total > 0, distinct / (total + distinct) / room, 1.0)
                    all_seen = (room == 0)[owner]
                    p[:, k] = np.where(seen > 0, seen / np.where(all_seen, total[owner], (total + distinct)[owner]), short * np.where(all_seen, 0, left[owner]))
                    escape[:, k] = np.where(room > 0, -np.log2(np.where(room > 0, left, 1)), 0)
            self.code.append(_Index(own))
            self.bits.append((-np.log2(np.maximum(p, 1e-300))).astype(np.float32))
            self.context.append(_Index(heads))
            self.escape.append(escape)
            below, keys = p, own

    @staticmethod
    def _count(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
        """(codes, counts) of context and next byte as one number, the byte last; texts begin after spaces."""
        pad = b" " * order
        s = np.frombuffer(b"".join(pad + t for t in texts), np.uint8).astype(np.uint64)
        code = np.zeros(max(0, len(s) - order), np.uint64)
        for i in range(order + 1):
            code = (code << np.uint64(8)) | s[i : len(s) - order + i]
        if order:  # windows that span two texts
            ends = np.cumsum([len(t) + order for t in texts])
            bad = (ends[:-1, None] - order + np.arange(order)).ravel()
            code = np.delete(code, bad[bad < len(code)])
        return np.unique(code, return_counts=True)

    def costs(self, code: np.ndarray) -> np.ndarray:
        """Bits of each (context, byte) number in each language: (numbers, languages)."""
        row = self.code[self.order](code)
        out = self.bits[self.order][row] if len(self.bits[self.order]) else np.zeros((len(code), len(self.languages)), np.float32)
        todo = np.flatnonzero(row < 0)
        out[todo] = 0
        for o in range(self.order, -1, -1):
            if not len(todo):
                break
            own = code[todo] & np.uint64((1 << 8 * (o + 1)) - 1)
            if o < self.order:
                row = self.code[o](own)
                hit = row >= 0
                out[todo[hit]] += self.bits[o][row[hit]]
                todo, own = todo[~hit], own[~hit]
            head = self.context[o](own >> np.uint64(8))
            known = head >= 0
            out[todo[known]] += self.escape[o][head[known]]
        out[todo] += 8  # not even the empty context knows the byte
        return out

    def lengths(self, texts: list[bytes], step: int = 1 << 18) -> np.ndarray:
        """Bits of each text in each language, over all its bytes."""
        order, pad = self.order, b" " * self.order
        s = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
        size = np.array([len(t) + order for t in texts])
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        inside = np.ones(len(s), bool)
        begin = np.cumsum(size) - size
        inside[(begin[:, None] + np.arange(order)).ravel()] = False
        out = np.zeros((len(texts), len(self.languages)))
        for lo in range(order, len(s), step):
            hi = min(len(s), lo + step)
            code = np.zeros(hi - lo, np.uint64)
            for i in range(order, -1, -1):
                code = (code << np.uint64(8)) | s[lo - i : hi - i]
            keep = inside[lo:hi]
            bits, at = self.costs(code[keep]), owner[lo:hi][keep]
            if not len(at):
                continue
            first, last = at[0], at[-1]
            for k in range(len(self.languages)):
                out[first : last + 1, k] += np.bincount(at - first, bits[:, k], last - first + 1)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language of the shortest code, and its share of 2 ** -length among all, taken over at most 64 bytes' worth
        of the difference for each byte, so that long texts don't all score 1."""
        raw = [(t or "").encode() for t in texts]
        names, scores = [UNKNOWN] * len(raw), [0.0] * len(raw)
        at = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
        for lo in range(0, len(at) if self.languages else 0, 512):
            part = at[lo : lo + 512]
            bits = self.lengths([raw[i] for i in part])
            size = np.array([len(raw[i]) for i in part])
            gap = (bits - bits.min(1, keepdims=True)) * (np.minimum(size, 64) / size)[:, None]
            share = 2.0**-gap
            share /= share.sum(1, keepdims=True)
            for i, k, p in zip(part, bits.argmin(1), share, strict=True):
                names[i], scores[i] = self.languages[k], float(p[k])
        return names, scores


def held_out(doc_id: Column, modulus: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, chars: int = SAMPLE_CHARS, order: int = ORDER) -> ContextTrees:
    """Trees from at most ``sample`` documents of each language, of which at most the first ``chars`` characters are read.

    Only documents that have a language, a doc_id and a letter and are not held out are used, and of those the first
    by a hash of doc_id; texts under one doc_id, or with equal hashes, come in order of their text. The sample is the
    only thing that reaches the driver; scoring covers all documents and whole texts. Other columns, whatever their
    names, are not read; without usable rows, as in an empty table, there are no trees.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    able = own.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    able = able.withColumn("at", F.xxhash64("doc_id"))
    first = Window.partitionBy("lang").orderBy("at", "doc_id")
    picked = able.select("at", "doc_id", "lang").withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample)
    ids = sorted({r["doc_id"] for r in picked.select("doc_id").distinct().collect()})  # at most sample rows a language
    if not ids:
        return ContextTrees({}, order)
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in ids], picked.select("doc_id").schema))
    by: dict[str, list[str]] = {}
    some = able.join(wanted, "doc_id", "left_semi").select("lang", F.substring("text", 1, chars).alias("text"))
    for r in some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("text"))).where(F.col("n") <= sample).collect():
        by.setdefault(r["lang"], []).append(r["text"])
    return ContextTrees({k: [t.encode() for t in sorted(v)] for k, v in by.items()}, order)


def identify(docs: DataFrame, trees: ContextTrees, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score as two more columns, the last.

    ``und`` with score 0 if the text is null or has no letters, or nothing was learned. Every byte of a text counts,
    however long it is. Equal code lengths go to the language that sorts first. Repeated rows are treated alike; an
    empty table stays empty; where ``docs`` has a column of a name already, the new one's gets underscores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # what a sample of fixed size gives a language
    names = fresh(docs.columns, *names)
    cell = fresh([*docs.columns, *names], "_predicted")[0]

    @F.pandas_udf("a string, b double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip("ab", shared.value.predict([t if isinstance(t, str) else None for t in texts]), strict=True)))

    out = docs.withColumn(cell, predict(F.col(f"`{text}`")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{cell}.{x}").alias(n) for x, n in zip("ab", names, strict=True)])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
