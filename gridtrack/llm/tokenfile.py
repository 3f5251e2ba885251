"""Token-id files: concatenated ids with Elias-Fano encoded document boundaries."""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, tune

#: Ids after which a shard is closed, words whose ids a Python worker remembers, and the most characters of such a word.
SHARD_IDS, CACHE, LONG_WORD = 4_000_000, 1_000_000, 64
#: Bytes of input of a part of the files, about.
PART_BYTES = 256 << 20
END = 1
_HEAD = struct.Struct("<4sIQQQ")
_SAMPLE = 64


_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """A sorted list of n integers up to u in n * (2 + log2(u / n)) bits, with direct access to the i-th.

    The low bits of each value lie in a packed array; the high bits as ones in a bit string, value v's at position
    (v >> low) + i. A select structure holds the position of every 64th one, as written: ``select`` jumps there and
    counts whole bytes on from it, without unpacking the string.
    """

    def __init__(self, n: int, low: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.samples = n, low, lows, highs, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v, n = np.asarray(values, np.uint64), len(values)
        if n and (np.diff(v.astype(np.int64)) < 0).any():
            raise ValueError("values must be sorted")
        top = int(v[-1]) if n else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        ones = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, low, np.packbits(bits, bitorder="little"), np.packbits(high, bitorder="little"), ones[::_SAMPLE].astype("<u8" if len(high) >> 32 else "<u4"))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for b in range(self.low):
            at = i * self.low + b
            out |= ((self.lows[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return out

    def select(self, i: int | np.ndarray) -> int | np.ndarray:
        """The i-th value, or the values of an array of places."""
        at = np.atleast_1d(np.asarray(i, np.int64))
        ones = self.samples[at // _SAMPLE].astype(np.int64)
        byte, rest = ones >> 3, at % _SAMPLE
        rest = rest + _ONES[self.highs[byte] & ((1 << (ones & 7)) - 1).astype(np.uint8)]  # ones of that byte before the sample
        todo = np.arange(len(at))
        while len(todo):  # whole bytes until the one that holds it
            here = _ONES[self.highs[byte[todo]]]
            todo, here = todo[over := rest[todo] >= here], here[over]
            rest[todo] -= here
            byte[todo] += 1
        cell, bit = self.highs[byte].astype(np.int64), np.zeros(len(at), np.int64)
        for k in range(8):
            one = (cell >> k) & 1
            bit = np.where((rest == 0) & (one == 1), k, bit)
            rest = rest - one
        out = (((byte * 8 + bit - at).astype(np.uint64) << np.uint64(self.low)) | self._lows(at)).astype(np.int64)
        return int(out[0]) if np.ndim(i) == 0 else out

    def dumps(self) -> bytes:
        parts = [x.tobytes() for x in (self.lows, self.highs, self.samples)]
        return struct.pack("<QIQQI", self.n, self.low, len(self.lows), len(self.highs), self.samples.itemsize) + b"".join(parts)

    @classmethod
    def loads(cls, data: memoryview) -> tuple[EliasFano, int]:
        """The list at the start of ``data``, as views of it, and its size in bytes."""
        n, low, a, b, width = struct.unpack_from("<QIQQI", data)
        at, c = struct.calcsize("<QIQQI"), -(-n // _SAMPLE)
        views = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a), np.frombuffer(data, f"<u{width}", c, at + a + b)
        return cls(n, low, *views), at + a + b + c * width


def dump_shard(doc_ids: list[int | None], counts: list[int], ids: bytes, width: int) -> bytes:
    """One shard file: header, document ids as (order, Elias-Fano), boundaries (Elias-Fano), ids of ``width`` bytes.

    Document ids are sorted, nulls first; they are stored from the least one on.
    """
    nulls = sum(d is None for d in doc_ids)
    base = doc_ids[nulls] if nulls < len(doc_ids) else 0
    docs = EliasFano.encode(np.array([d - base for d in doc_ids[nulls:]], np.int64)).dumps()
    bounds = EliasFano.encode(np.cumsum([0, *counts])).dumps()
    return _HEAD.pack(b"GTK2", width, nulls, len(docs), len(bounds)) + struct.pack("<q", base) + docs + bounds + ids


class Shard:
    """A shard file's reader: ``doc(i)`` and ``bounds(i)`` are lookups, the ids a view without a copy."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, width, self.nulls, a, b = _HEAD.unpack_from(view)
        if magic != b"GTK2":
            raise ValueError("not a token shard")
        (self.base,) = struct.unpack_from("<q", view, _HEAD.size)
        at = _HEAD.size + 8
        self.docs, _ = EliasFano.loads(view[at : at + a])
        self.starts, _ = EliasFano.loads(view[at + a : at + a + b])
        self.ids = np.frombuffer(view[at + a + b :], f"<u{width}")

    def __len__(self) -> int:
        return self.starts.n - 1

    def doc(self, i: int) -> int | None:
        return None if i < self.nulls else self.base + self.docs.select(i - self.nulls)

    def part(self, lo: int, hi: int) -> tuple[list[int | None], np.ndarray]:
        """Document ids of documents lo..hi-1, and their boundaries, by select."""
        own = self.base + self.docs.select(np.arange(max(lo, self.nulls), max(hi, self.nulls)) - self.nulls)
        return [None] * (max(lo, self.nulls) - lo - max(0, self.nulls - hi)) + own.tolist(), self.starts.select(np.arange(lo, hi + 1))

    def bounds(self, i: int) -> tuple[int, int]:
        return self.starts.select(i), self.starts.select(i + 1)

    def tokens(self, i: int) -> np.ndarray:
        lo, hi = self.bounds(i)
        return self.ids[lo:hi]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_words: dict[str, dict[str, bytes]] = {}


class WordEncoder:
    """Ids of texts as the tokenizer gives them, each distinct word encoded once for each Python worker.

    Holds for tokenizers that drop white space before merging, as this vocabulary's does: no rule then crosses it.
    Texts with an added token's string or with the separators that Unicode and Python see differently go through
    the tokenizer as a whole. Letters of Latin-1 are one pre-token, as are the ASCII marks other than the apostrophe
    before and after them, and may go to the merges directly, if the tokenizer does that to probes too.
    """

    _WORD = re.compile("([!-&(-/:-@[-`{-~]*)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@[-`{-~]*)")

    def __init__(self, path: str):
        self.tok, self.cache = _tokenizer(path), _words.setdefault(path, {})
        self.odd = ["\x1c", "\x1d", "\x1e", "\x1f", *(t.content for t in self.tok.get_added_tokens_decoder().values())]
        self.model = self.tok.model
        # a character for each byte, as byte-level vocabularies have it: printable ones stand for themselves
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.marks: dict[str, bytes] = {"": b""}
        probe = ["a", "The", "abcxyz", "Zzzzqj", "internationalisation", "ll", "S", "\u00c9t\u00e9s,", "(\u00df\u00f1\u00ff).", "\"x!?", *map(chr, range(0xC0, 0xD7)), *map(chr, range(0xD8, 0xF7)), *map(chr, range(0xF8, 0x100))]
        self.direct = all(self._merge(w) == self._encode(w) for w in probe)

    def _merge(self, word: str) -> bytes | None:
        """Ids of a word of letters with marks around it; None for any other."""
        m = self._WORD.fullmatch(word)
        if not m:
            return None
        before, letters, after = m.groups()
        low = letters.lower()
        if not low.isascii():
            low = "".join(map(self.char.__getitem__, low.encode()))
        ids = array("I", [t.id for t in self.model.tokenize(low)]).tobytes()
        return self._mark(before) + ids + self._mark(after) if before or after else ids

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            if len(self.marks) > 10_000 or len(mark) > LONG_WORD:
                return self._encode(mark)
            self.marks[mark] = self._encode(mark)
        return self.marks[mark]

    def _encode(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.odd):
            return self._encode(text)
        words, cache = text.split(), self.cache
        if len(cache) > CACHE:
            cache.clear()
        new = set(words).difference(cache)
        if new:
            rest = []
            for w in new:
                ids = self._merge(w) if self.direct else None
                if ids is None:
                    rest.append(w)
                else:
                    cache[w] = ids
            for w, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True):
                cache[w] = array("I", e.ids).tobytes()
        out = b"".join(map(cache.__getitem__, words))
        for w in new:
            if len(w) > LONG_WORD:
                del cache[w]
        return out


def write_shards(docs: DataFrame, path: str, end: int = END, shard_ids: int = SHARD_IDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, shard, n_ids, n_docs, data): token files of ``docs`` in ascending doc_id order, as written.

    Rows are dealt by ranges of doc_id and sorted before they are encoded, so each task writes its files in one pass
    and holds one shard. A null text is empty and a document is at least its end id; null doc_ids come first; equal
    doc_ids follow each other by a hash of their text. Ids take two bytes if the vocabulary allows it, else four.
    A very long text is one document of a shard of its own size; an empty table gives no files; other columns, whatever
    their names, are not read. The files are the values of ``data`` in a Parquet table, so Spark's committer makes them
    whole or absent on any store, whatever executors are lost. There are as many parts as keep each at about
    ``PART_BYTES`` of the input as planned.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), min(size // PART_BYTES, 100_000))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).withColumn("part", F.spark_partition_id())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word_ids = WordEncoder(path)
        width = 2 if word_ids.tok.get_vocab_size() <= 1 << 16 and end < 1 << 16 else 4
        docs, counts, ids, total, shard, part = [], [], [], 0, 0, 0

        def close() -> pd.DataFrame:
            data = dump_shard(docs, counts, b"".join(ids), width)
            return pd.DataFrame({"part": [part], "shard": [shard], "n_ids": [total], "n_docs": [len(docs)], "data": [data]})

        for batch in batches:
            for d, t, p in zip(batch["doc_id"], batch["text"], batch["part"], strict=True):
                part = p
                raw = word_ids(t or "")
                docs.append(None if pd.isna(d) else int(d))
                counts.append(len(raw) // 4 + 1)
                ids += (np.frombuffer(raw, np.uint32).astype(f"<u{width}").tobytes(), end.to_bytes(width, "little"))
                total += counts[-1]
                if total >= shard_ids:
                    yield close()
                    docs, counts, ids, total, shard = [], [], [], 0, shard + 1
        if docs:
            yield close()

    return materialize(rows.mapInPandas(encode, "part long, shard long, n_ids long, n_docs long, data binary"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in token files, from the files alone."""
    sums = shards.groupBy("part", "shard").agg(F.sum("n_ids").alias("n"))
    per_part = sums.groupBy("part").agg(F.sum("n").alias("n"))  # one row per task that wrote: a short global order
    order = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    at = sums.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(base, "part").select("part", "shard", (F.col("base") + F.col("inner")).alias("first"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, number, data in zip(batch["part"], batch["shard"], batch["data"], strict=True):
                s = Shard(data)
                for at in range(0, len(s), 4096):
                    docs, bounds = s.part(at, min(len(s), at + 4096))
                    crc = [zlib.crc32(s.ids[lo:hi].astype("<u4").tobytes()) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
                    yield pd.DataFrame({"part": part, "shard": number, "doc_id": pd.array(docs, "Int64"), "inside": bounds[:-1], "n_tokens": np.diff(bounds), "ids_crc32": crc})

    rows = shards.select("part", "shard", "data").mapInPandas(decode, "part long, shard long, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(at, ["part", "shard"]).select("doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(write_shards(tune(spark).read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json")))
