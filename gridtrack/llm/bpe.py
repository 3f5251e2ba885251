"""Byte-level BPE encoding and decoding with overlapping chunks."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize

#: Characters between chunk starts, and characters that neighbouring chunks share.
CHUNK, OVERLAP = 16_384, 1_024
#: A token that ends this close to a chunk's end may be cut short: no alternative of the pattern looks further ahead.
MARGIN = 4
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> tuple[tiktoken.Encoding, list[bytes], list[str], regex.Pattern]:
    with open(path, "rb") as f:  # the tokenizer is an installed package, the same on every machine
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    raw = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        raw[i] = token
    split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), raw, list(map(str, range(len(raw)))), split


def digest(ids: list[int], raw: list[bytes], names: list[str]) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the decimal ids, SHA-256 of the bytes they decode to."""
    decoded = b"".join(map(raw.__getitem__, ids))
    return len(ids), hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def chunks(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[int, int, str]]:
    """(k, number of chunks, text) of chunks that start ``chunk`` characters apart and share ``overlap``."""
    n = max(1, -(-(len(text) - overlap) // chunk))
    for k in range(n):
        yield k, n, text[k * chunk : (k + 1) * chunk + overlap if k < n - 1 else len(text)]


def encode_chunk(k: int, n: int, text: str, codec: tuple, chunk: int = CHUNK, overlap: int = OVERLAP) -> dict:
    """Token starts and ids in the two shared zones of a chunk, and the ids of everything between them.

    Pre-tokenising starts at the chunk's first character, wherever that is, so its first tokens may be wrong; from
    a start that the chunk before has too, they are right, since a match depends on what follows it alone.
    """
    enc, _, _, split = codec
    base, last, end = k * chunk, k == n - 1, len(text)
    left_to, right_from = (overlap if k else 0), (end if last else chunk)
    zones: dict[str, tuple[list[int], list[list[int]]]] = {"left": ([], []), "right": ([], [])}
    at = 0
    while at < left_to:
        m = split.match(text, at)
        zones["left"][0].append(base + at)
        zones["left"][1].append(enc.encode_ordinary(m.group()))
        at = m.end()
    start = at
    if last:
        inner = enc.encode_ordinary(text[start:])
    else:
        # the first sure token start in the right zone
        at = _start_after(text, start, right_from, split) if start <= end - MARGIN else end
        inner = enc.encode_ordinary(text[start:at]) if at > start else []
        while at < end:
            zones["right"][0].append(base + at)
            m = split.match(text, at)
            if m.end() > end - MARGIN:
                zones["right"][1].append([])  # cut short: its start counts, its ids don't
                break
            zones["right"][1].append(enc.encode_ordinary(m.group()))
            at = m.end()
    pack = lambda ids: np.array(ids, "<u4").tobytes()
    return {"k": k, "n": n, "left_at": zones["left"][0], "left_ids": list(map(pack, zones["left"][1])), "inner": pack(inner), "right_at": zones["right"][0], "right_ids": list(map(pack, zones["right"][1]))}


def _start_after(text: str, start: int, goal: int, split: regex.Pattern) -> int:
    """The first sure token start from ``goal`` on that follows no white space: what ends there is the same cut off."""
    for m in split.finditer(text, start):
        if m.start() >= goal and (m.start() == start or not text[m.start() - 1].isspace()):
            return m.start()
        if m.end() > len(text) - MARGIN:
            return len(text)  # one token fills the rest: no start in the zone
    return len(text)


def stitch(parts: list[dict]) -> list[int] | None:
    """Ids of a document from its chunks in order; None if two neighbours have no token start in common."""
    out, after = [], -1
    for k, p in enumerate(parts):
        until = None
        if k + 1 < len(parts):
            common = set(p["right_at"]) & set(parts[k + 1]["left_at"])
            if not common:
                return None
            until = min(common)
        out += [x for at, x in zip(p["left_at"], p["left_ids"], strict=True) if at >= after]
        out.append(p["inner"])
        out += [x for at, x in zip(p["right_at"], p["right_ids"], strict=True) if until is not None and at < until]
        after = until
    return np.frombuffer(b"".join(out), "<u4").tolist()


def _whole(codec: Callable[[], tuple]) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, raw, names, _ = codec()
        for batch in batches:
            found = [digest(enc.encode_ordinary(t or ""), raw, names) for t in batch["text"]]
            yield pd.DataFrame([(i, *d) for i, d in zip(batch["doc_id"], found, strict=True)], columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``; other columns are ignored.

    A null text counts as empty (no ids, the digests of nothing); repeated rows each get a row; an empty table gives
    an empty one. A text of one chunk is encoded where it is read. Longer ones are cut into overlapping chunks that
    are dealt over all tasks, and only ids meet again, by document. A document in which neighbouring chunks share no
    token start (a run of over ``overlap`` letters, say) is encoded once more as one chunk.
    """
    codec = lambda: _codec(path, pattern)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk + overlap
    short = rows.where(~long).mapInPandas(lean(_whole(codec)), RESULT)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, key, t in zip(batch["doc_id"], batch["key"], batch["text"], strict=True):
                for k, n, part in chunks(t, chunk, overlap):
                    yield pd.DataFrame({"doc_id": [i], "key": [key], "k": [k], "n": [n], "text": [part]}).astype({"doc_id": "Int64"})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec()
        for batch in batches:
            done = [encode_chunk(k, n, t, c, chunk, overlap) for k, n, t in zip(batch["k"], batch["n"], batch["text"], strict=True)]
            yield pd.DataFrame(done).assign(doc_id=batch["doc_id"].astype("Int64"), key=batch["key"])

    def join(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        _, raw, names, _ = codec()
        copies = int((group["k"] == 0).sum())
        ids = stitch(group.drop_duplicates("k").sort_values("k").to_dict("records"))
        found = (None, None, None) if ids is None else digest(ids, raw, names)
        return pd.DataFrame([(key[0], key[1], *found)] * copies, columns=["doc_id", "key", "n_tokens", "ids_sha256", "decoded_sha256"]).astype({"doc_id": "Int64", "n_tokens": "Int64"})

    keyed = rows.where(long).select("doc_id", F.xxhash64("text").alias("key"), "text")
    parts = keyed.mapInPandas(lean(cut), "doc_id long, key long, k long, n long, text string")
    parts = parts.repartition("doc_id", "key", "k")
    coded = parts.mapInPandas(lean(encode), "doc_id long, key long, k long, n long, left_at array<long>, left_ids array<binary>, inner binary, right_at array<long>, right_ids array<binary>")
    stitched = materialize(coded.groupBy("doc_id", "key").applyInPandas(join, f"key long, {RESULT}"), "stitched")
    out = short.unionByName(stitched.where("ids_sha256 is not null").drop("key"))
    apart = stitched.where("ids_sha256 is null").select("doc_id", "key").distinct()
    if not apart.isEmpty():
        apart = apart.toDF("_doc_id", "_key")
        again = keyed.join(apart, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("key") == F.col("_key")), "left_semi")
        out = out.unionByName(again.select("doc_id", "text").mapInPandas(lean(_whole(codec)), RESULT))
    return out


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
