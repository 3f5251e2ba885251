"""N-gram Jaccard join by set relations: index lists in blocks that size and position skip, answers derived from a similar set's."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, fresh, lean, materialize, row_key, tune

WIDTH, PERCENT = 5, 75
#: Cells of the frequency sketch (4 MB, a byte each), in as many parts; postings in a bucket.
CELLS, PARTS, POSTINGS = 1 << 22, 32, 100_000
#: Bits of the filter of documents read again (4 MB), at least eight for each; more documents are found by a join.
FILTER_BITS = 1 << 25
#: Lists up to this length are joined at once; longer ones first with one member, then only where that left them apart.
SHORT = 3
#: Postings of one token beyond the sketch's mean cell before the token's list is dealt over several buckets.
LONG = 100_000
#: Members of a block of an index list: block pairs are skipped or judged as a whole.
BLOCK = 512
#: What a Python worker holds: hashes of words (each of at most 32 bytes), members counted or sent at once.
CACHE, HASHES, HELD = 100_000, 250_000, 250_000
_M, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_NONE = np.zeros(0, np.uint64)
#: What a text with words has: a character that ``bytes.split`` doesn't take as white space.
WORDS = r"[^ \t\n\x0B\f\r]"
#: A cell's byte is 8 * log2(1 + count), rounded down: an order of tokens needs no more. The count it stands for, at least:
_COUNT = np.floor(2 ** (np.arange(256) / 8)).astype(np.int64) - 1


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= CACHE:
                self.clear()
            self[word] = h
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: dict, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; of all words as one if there are fewer."""
    parts = text.encode().lower().split() if text else []  # bytes: A-Z only, and the six ASCII white space characters
    if not parts:
        return _NONE
    w = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    n = min(width, len(w))
    with np.errstate(over="ignore"):
        h = np.zeros(len(w) - n + 1, np.uint64)
        for i in range(n):
            h = h * _M + w[i : len(w) - n + 1 + i]
        return np.unique(_mix(h + np.uint64(n)))


def need(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Least intersection of sets of sizes a and b with 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sign(s: np.ndarray) -> int | None:
    """Signature of a set: the hash of its members; 64 bits, and sets of another size never count as equal."""
    return xxhash.xxh3_64_intdigest(s.tobytes() + len(s).to_bytes(8, "little")) - (1 << 63) if len(s) else None


def _scan(rows: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, sig) of every row, and how often each cell's shingles occur in documents, over all of them."""

    def count(cells: np.ndarray, buffer: list) -> None:
        at, times = np.unique(np.concatenate(buffer) & np.uint64(CELLS - 1), return_counts=True)
        cells[at] += times.astype(np.uint32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, cells = _Words(), np.zeros(CELLS, np.uint32)
        for batch in batches:
            n, sig, buffer, held = [], [], [], 0
            for t in batch["text"]:
                s = shingles(t, words, width)
                n.append(len(s))
                sig.append(_sign(s))
                buffer.append(s)
                held += len(s)
                if held > HASHES:
                    count(cells, buffer)
                    buffer, held = [], 0
            if held:
                count(cells, buffer)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n": n, "sig": pd.array(sig, "Int64"), "part": -1, "cells": None})
        for k, part in enumerate(np.split(cells, PARTS)):
            if part.any():
                yield pd.DataFrame({"doc_id": [None], "n": [0], "sig": [None], "part": [k], "cells": [zlib.compress(part.tobytes(), 1)]})

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELLS // PARTS, np.uint64)
        for x in group["cells"]:
            total += np.frombuffer(zlib.decompress(x), np.uint32)
        return pd.DataFrame({"part": [key[0]], "cells": [np.minimum(8 * np.log2(1.0 + total), 255).astype(np.uint8).tobytes()]})

    scanned = materialize(rows.mapInPandas(lean(run), "doc_id long, n long, sig long, part int, cells binary"), "shingled")
    sketch = np.zeros((PARTS, CELLS // PARTS), np.uint8)
    for r in scanned.where("part >= 0").select("part", "cells").groupBy("part").applyInPandas(add, "part int, cells binary").collect():  # 4 MB, whatever the input
        sketch[r["part"]] = np.frombuffer(r["cells"], np.uint8)
    return scanned.where("part < 0").select("doc_id", "n", "sig"), sketch.ravel()


def _postings(rows: DataFrame, shared, mean: int, buckets: int, width: int, percent: int) -> DataFrame:
    """Prefix postings, packed by bucket: (bucket, dealt, token, sig, n, pos), the last four as arrays of bytes.

    The tokens of a set are ordered by their cell's count and then by hash: any such order is right for prefixes,
    and this one leaves frequent shingles out of them. A token that alone lifts its cell far above the ``mean`` is
    ``dealt``: its list may have its members in several buckets.
    """
    most = LONG

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, count, seen, held, size = _Words(), shared.value, set(), [], 0

        def flush() -> pd.DataFrame:
            token, sig, n, pos, often = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = ((token >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            split = np.maximum(_COUNT[often] - mean, 0) // most
            dealt = split > 0
            if dealt.any():  # a list this long is dealt over more buckets by its sets
                turn = np.where(dealt, (sig.view(np.uint64) >> np.uint64(20)) % (split.astype(np.uint64) + np.uint64(1)), 0)
                bucket = (bucket + turn.astype(np.uint64)) % np.uint64(buckets)
            order = np.lexsort((token, dealt, bucket))
            size16 = [x.astype(np.uint16) if len(x) and x.max() < 1 << 16 else x for x in (n, pos)]
            ends = np.append(np.flatnonzero((np.diff(bucket[order]) != 0) | (np.diff(dealt[order]) != 0)) + 1, len(order))
            out = []
            for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True):
                at = order[lo:hi]
                low, high = token[at].astype(np.uint32), (token[at] >> np.uint64(32)).astype(np.uint16)  # 48 bits of a token tell lists apart
                out.append((int(bucket[at[0]]), bool(dealt[at[0]]), low.tobytes() + high.tobytes(), sig[at].tobytes(), *(x[at].tobytes() for x in size16)))
            return pd.DataFrame(out, columns=["bucket", "dealt", "token", "sig", "n", "pos"])

        for batch in batches:
            for t in batch["text"]:
                s = shingles(t, words, width)
                if not len(s) or (g := _sign(s)) in seen:
                    continue
                if len(seen) >= CACHE:
                    seen.clear()
                seen.add(g)  # equal sets mostly meet once for each task
                often = count[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                p = len(s) - -(-percent * len(s) // 100) + 1
                order = np.lexsort((s, often))[:p]
                held.append((s[order], np.full(p, g, np.int64), np.full(p, len(s), np.int32), np.arange(p, dtype=np.int32), often[order]))
                size += p
                if size > HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return rows.mapInPandas(lean(run), "bucket long, dealt boolean, token binary, sig binary, n binary, pos binary")


_PAIR = "a long, b long, na long, nb long, shared long, first boolean, fit boolean"
_LIST = "token long, block long, dealt boolean, step long, sigs binary, ns binary, places binary"


def _step(n: np.ndarray, percent: int) -> np.ndarray:
    """Class of a size: sets of one class can be similar."""
    return np.floor(np.log(n) / np.log(100 / percent)).astype(np.int64)


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """Two kinds of rows. With ``sigs`` null, a pair (a, b) of sizes (na, nb), with the number of short lists that have
    both, whether ``b`` should come first, and whether sizes and positions let them be similar. Else a block of a long
    list: its members' signatures, sizes and places, in order of size class and place; of a ``dealt`` list also a block
    for each size class (``step``) that holds its first member alone."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(group["sig"]), np.int64)
        n, pos = (np.concatenate([np.frombuffer(x, np.uint16 if len(x) * 4 == len(y) else np.int32).astype(np.int32) for x, y in zip(group[c], group["sig"], strict=True)]) for c in ("n", "pos"))
        token = np.concatenate([np.frombuffer(t, np.uint32, len(t) // 6).astype(np.int64) | np.frombuffer(t, np.uint16, offset=len(t) // 6 * 4).astype(np.int64) << 32 for t in group["token"]])
        dealt = np.repeat(group["dealt"].to_numpy(bool), [len(x) // 8 for x in group["sig"]])
        order = np.lexsort((sig, n, token))
        token, sig, n, pos, dealt = token[order], sig[order], n[order].astype(np.int64), pos[order].astype(np.int64), dealt[order]
        keep = np.append(True, (np.diff(token) != 0) | (np.diff(sig) != 0))
        token, sig, n, pos, dealt = token[keep], sig[keep], n[keep], pos[keep], dealt[keep]
        begin = np.flatnonzero(np.append(True, np.diff(token) != 0))
        length = np.diff(np.append(begin, len(token)))
        dealt = np.repeat(np.maximum.reduceat(dealt, begin), length)
        size = np.where(dealt, np.maximum(np.repeat(length, length), SHORT + 1), np.repeat(length, length))  # a dealt list's other members are elsewhere
        pairs, blocks = [], []

        def fits(i: np.ndarray, j: np.ndarray) -> np.ndarray:  # sizes, then what can still follow both positions
            least = need(n[i], n[j], percent)
            return (np.minimum(n[i], n[j]) >= least) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) >= least)

        short = np.flatnonzero((size > 1) & (size <= SHORT))
        for d in range(1, SHORT):
            i = short[short + d < len(token)]
            i = i[token[i] == token[i + d]]
            pairs.append((i, i + d))
        long = np.flatnonzero(size > SHORT)
        if len(long):
            # one member for each run of like sizes, so that it can be similar to the others: the one in which the
            # token comes first, for copies have rare shingles of their own before those they share with their origin
            step = _step(n, percent)
            new_run = np.append(True, (np.diff(token) != 0) | (np.diff(step) != 0))
            run_of = np.cumsum(new_run) - 1
            order = np.lexsort((sig, pos, run_of))
            first = order[np.flatnonzero(np.append(True, np.diff(run_of[order]) != 0))]
            pivot = first[run_of]
            i = long[pivot[long] != long]
            i = i[fits(pivot[i], i)]
            pairs.append((pivot[i], i))
            # blocks of each list in order of size class and place, cut every BLOCK members
            long = order[size[order] > SHORT]
            start = np.append(True, np.diff(token[long]) != 0)
            inside = np.arange(len(long)) - np.maximum.accumulate(np.where(start, np.arange(len(long)), 0))
            cut = np.flatnonzero(inside % BLOCK == 0)
            for k, (lo, hi) in enumerate(zip(cut, np.append(cut[1:], len(long)), strict=True)):
                at = long[lo:hi]
                blocks.append((token[at[0]], (int(key[0]) << 24) + k, False, 0, sig[at].tobytes(), n[at].astype(np.int32).tobytes(), pos[at].astype(np.int32).tobytes()))
            for k in first[dealt[first]]:
                blocks.append((token[k], int(key[0]) << 24, True, step[k], sig[k : k + 1].tobytes(), n[k : k + 1].astype(np.int32).tobytes(), pos[k : k + 1].astype(np.int32).tobytes()))
        shared = [np.ones(len(p[0]), np.int64) for p in pairs]
        if len(long):
            shared[-1][:] = 0
        i, j, shared = (np.concatenate(x) for x in zip(*[(*p, c) for p, c in zip(pairs, shared, strict=True)], strict=True))
        fit = fits(i, j)  # holds at the first token that both have, if they are similar
        turned = sig[i] > sig[j]
        i, j = np.where(turned, j, i), np.where(turned, i, j)
        out = pd.DataFrame({"a": sig[i], "b": sig[j], "na": n[i], "nb": n[j], "shared": shared, "first": turned, "fit": fit}).groupby(["a", "b", "na", "nb"], as_index=False).agg({"shared": "sum", "first": "max", "fit": "max"})
        listed = pd.DataFrame(blocks, columns=["token", "block", "dealt", "step", "sigs", "ns", "places"])
        for name in ("token", "block", "step"):
            out[name], listed[name] = pd.array([None] * len(out), "Int64"), listed[name].astype("Int64")
        for name in ("a", "b", "na", "nb", "shared"):
            out[name], listed[name] = out[name].astype("Int64"), pd.array([None] * len(listed), "Int64")
        out, listed = out.assign(dealt=False, sigs=None, ns=None, places=None), listed.assign(first=False, fit=False)
        order = ["a", "b", "na", "nb", "shared", "first", "fit", "token", "block", "dealt", "step", "sigs", "ns", "places"]
        return out[order] if not len(listed) else listed[order] if not len(out) else pd.concat([out[order], listed[order]])

    return postings.groupBy("bucket").applyInPandas(run, f"{_PAIR}, {_LIST}")


def _unpack(blocks: DataFrame) -> DataFrame:
    """(token, block, step, a, n, pos) of the members of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            times = [len(x) // 8 for x in batch["sigs"]]
            head = {c: np.repeat(batch[c].to_numpy(np.int64), times) for c in ("token", "block", "step")}
            whole = {c: np.frombuffer(b"".join(batch[name]), kind).astype(np.int64) for c, name, kind in (("a", "sigs", np.int64), ("n", "ns", np.int32), ("pos", "places", np.int32))}
            yield pd.DataFrame({**head, **whole})

    return blocks.select("token", "block", "step", "sigs", "ns", "places").mapInPandas(run, "token long, block long, step long, a long, n long, pos long")


def _reach(n, pos, least):
    return F.least(*n) >= least, F.least(*[x - p for x, p in zip(n, pos, strict=True)]) >= least


def _heads(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs that tie together a dealt list's buckets: each bucket's first member of a size class with the first of all."""
    head = _unpack(blocks.where("dealt")).select("token", "step", "a", "n", "pos")
    first = head.groupBy("token", "step").agg(F.min(F.struct("pos", "n", "a")).alias("m")).select("token", "step", F.col("m.a").alias("b"), F.col("m.n").alias("nb"), F.col("m.pos").alias("pb"))
    pairs = head.join(first, ["token", "step"]).where("a <> b")
    least = F.ceil((F.col("n") + F.col("nb")) * percent / F.lit(100 + percent))
    turned = F.col("a") > F.col("b")
    swap = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
    size, place = _reach([F.col("n"), F.col("nb")], [F.col("pos"), F.col("pb")], least)
    return pairs.select(swap("a", "b", "a"), swap("b", "a", "b"), swap("n", "nb", "na"), swap("nb", "n", "nb"), F.lit(0).cast("long").alias("shared"), turned.alias("first"), (size & place).alias("fit"))


def _promising(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb) of the pairs that share enough prefix tokens to be similar at all.

    Tokens beyond both prefixes are at most the longer rest, so a similar pair has at least need - ceil(t * n) + 1
    prefix tokens in common, n being the larger size. Short lists count them for a pair; long lists can add no more
    than either set has there.
    """
    pairs = pairs.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"), F.max("first").alias("first"), F.max("fit").alias("fit")).where("fit")
    lists = members.groupBy("a").agg(F.count("*").alias("l"))
    pairs = pairs.join(lists.toDF("a", "la"), "a", "left").join(lists.toDF("b", "lb"), "b", "left")
    least = F.ceil((F.col("na") + F.col("nb")) * percent / F.lit(100 + percent)) - F.ceil(F.greatest("na", "nb") * percent / F.lit(100)) + 1
    most = F.col("shared") + F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    ends = [F.when(F.col("first"), F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("na", "nb"), ("nb", "na"))]
    return pairs.where(most >= least).select(*ends)


def _slot():
    return F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))


def _bits(ids: DataFrame) -> np.ndarray:
    """A bit for each slot that an id of ``ids`` (doc_id) falls into."""
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    words = ids.select(_slot().alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 as int)))").alias("b"))
    found = words.toArrow()  # at most FILTER_BITS / 64 rows, whatever the input: 8 MB, where rows as Python objects would be far more
    bits[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return bits


def _sets(rows: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(sig, members, is_a, is_b): sets of the pairs' ends, and perhaps of others, each at least once.

    The documents to read again are found by a filter of fixed size as long as it has eight bits for each, so that
    few others pass; beyond that by a join.
    """
    least = F.col("least").alias("doc_id")
    ends = pairs.select(F.col("a").alias("sig"), F.lit(True).alias("is_a")).unionByName(pairs.select(F.col("b").alias("sig"), F.lit(False).alias("is_a")))
    ends = ends.groupBy("sig").agg(F.max("is_a").alias("is_a"), F.max(~F.col("is_a")).alias("is_b"))
    wanted = materialize(classes.join(ends, "sig").where("least is not null").groupBy(least).agg(F.max("is_a").alias("is_a"), F.max("is_b").alias("is_b")), "ends")
    found = rows.where("doc_id is not null")
    shared = None
    if wanted.count() * 8 <= FILTER_BITS:
        shared = rows.sparkSession.sparkContext.broadcast([_bits(wanted.where(c)) for c in ("is_a", "is_b")])
        found = found.select(_slot().alias("s"), "text", F.lit(None).cast("boolean").alias("is_a"), F.lit(None).cast("boolean").alias("is_b"))
    else:
        found = found.join(wanted.hint("merge"), "doc_id").select(F.lit(0).cast("long").alias("s"), "text", "is_a", "is_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for batch in batches:
            if shared is None:
                hits = [batch["is_a"].to_numpy(bool), batch["is_b"].to_numpy(bool)]
            else:
                s = batch["s"].to_numpy()
                hits = [((h[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1)).astype(bool) for h in shared.value]
            any_hit = hits[0] | hits[1]
            sets = [shingles(t, words, width) for t in batch["text"][any_hit]]
            out = pd.DataFrame({"sig": pd.array([_sign(x) for x in sets], "Int64"), "members": [x.tobytes() for x in sets], "is_a": hits[0][any_hit], "is_b": hits[1][any_hit]})
            yield out[out["sig"].notna()]

    out = materialize(found.mapInPandas(lean(run), "sig long, members binary, is_a boolean, is_b boolean"), "sets")
    if shared is not None:
        shared.destroy()
    return out


def _verify(rows: DataFrame, classes: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(a, b, na, nb, common) of every pair (a, b, na, nb): the exact size of the intersection."""
    sets = _sets(rows, classes, pairs, width)
    a, b = sets.where("is_a").select(F.col("sig").alias("a"), F.col("members").alias("ma")), sets.where("is_b").select(F.col("sig").alias("b"), F.col("members").alias("mb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            common = []
            for x, y in zip(batch["ma"], batch["mb"], strict=True):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")  # two sorted runs
                common.append(int((both[1:] == both[:-1]).sum()))
            yield batch[["a", "b", "na", "nb"]].assign(common=common)

    # both sides grow with the input: never a broadcast, whatever their size looks like
    joined = pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a").select("a", "b", "na", "nb", "ma", "mb")
    return joined.mapInPandas(lean(run), "a long, b long, na long, nb long, common long").distinct()


def similar(percent: int = PERCENT):
    return F.col("common") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent


def join_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``; other columns are ignored.

    Two documents link when their sets of ``width``-word shingles (fewer words: all as one) have a Jaccard
    similarity of ``percent`` or more. Null and blank texts have an empty set, link with nothing and are their own
    component. Equal sets are one class; only classes are joined. Repeated rows each get a row. A null doc_id takes
    the least doc_id of the texts with an equal set; where only null doc_ids have a set, it links with nothing else. An empty table gives an empty one.

    Rows with further columns, whatever their names, are read by ``doc_id`` and ``text`` alone; a very long text is one
    set like any other; ties in size or order are settled by signature.

    1. One pass counts shingles over all documents in a sketch of fixed size, which gives the global order.
    2. A second pass sends the prefix tokens of each set to index lists, packed by token range. Lists of up to
       ``SHORT`` sets give all their pairs. A longer list is kept in blocks, in order of size and place, and first
       gives the pairs of each set with one set of like size in it.
    3. Pairs are verified on whole sets. Where that already connects a long list, it is done. Otherwise pairs of its
       blocks are skipped by their least and greatest sizes and their first places; in the others each set's answers
       are derived from the verified intersections with a common set, and only pairs that these bounds leave open are
       formed and verified.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    scanned, sketch = _scan(rows, width)
    total = scanned.agg(F.sum("n")).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    buckets = max(parts, total * (100 - percent) // 100 // POSTINGS + 1)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # 4 MB, whatever the input
    del sketch
    postings = _postings(rows, shared, total // CELLS, buckets, width, percent)
    if buckets > 16 * parts:  # some 40 MB a task at most; with fewer, the groups' own shuffle does, whose tasks AQE may join
        postings = postings.repartition(min(buckets // 16, 100_000), "bucket")
    found = materialize(_candidates(postings, percent), "candidates")
    shared.destroy()  # what was made with it is written
    blocks = found.where("sigs is not null")
    members = materialize(_unpack(blocks.where("not dealt")).drop("step"), "members")
    pairs = found.where("sigs is null").select("a", "b", "na", "nb", "shared", "first", "fit").unionByName(_heads(blocks, percent))
    pairs = materialize(_promising(pairs, members, percent), "pairs")

    classes = materialize(scanned.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least")), "least")
    checked = materialize(_verify(rows, classes, pairs, width), "checked")
    links = checked.where(similar(percent)).select("a", "b")
    group = components(links)

    open_pairs = materialize(_open(members, group, checked, percent), "open")
    more = open_pairs.where("sure").select("a", "b")
    left = open_pairs.where("not sure").select("a", "b", "na", "nb")
    if not left.isEmpty():
        more = more.unionByName(_verify(rows, classes, left, width).where(similar(percent)).select("a", "b"))
    more = materialize(more, "more-links")
    if not more.isEmpty():
        group = components(links.unionByName(more))

    label = classes.join(group.withColumnRenamed("id", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    label = materialize(label, "labels")
    first = label.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = materialize(label.join(first, "component").select("sig", "component_id"), "classes")
    out = scanned.join(by_class, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _open(members: DataFrame, group: DataFrame, checked: DataFrame, percent: int) -> DataFrame:
    """(a, b, na, nb, sure) of the pairs in lists that are still apart which no bound rules out.

    A list is apart if its sets lie in several components. Blocks meet by token and are skipped by their least and
    greatest sizes and by what can follow their first places; a block pair is one row, so a list of any length is
    dealt over all tasks. In a block pair sizes and positions are judged set by set, then with a common verified
    neighbour p: |a & b| >= |a & p| + |b & p| - |p| proves, and min(|a & p|, |b & p|) + min(|a - p|, |b - p|) rules out.
    """
    at = materialize(members.join(group.withColumnRenamed("id", "a"), "a", "left").withColumn("component", F.coalesce("component", "a")), "placed")
    head = at.groupBy("token", "block").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    head = materialize(head, "heads")
    apart = head.groupBy("token").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x <> y").select("token")
    head = head.join(apart, "token", "left_semi")
    # the neighbour that shares most with a set: one for each, by partial aggregation
    side = checked.select(F.col("a").alias("p"), F.col("na").alias("np"), F.col("b").alias("s"), "common").unionByName(checked.select(F.col("b").alias("p"), F.col("nb").alias("np"), F.col("a").alias("s"), "common"))
    best = side.groupBy("s").agg(F.max(F.struct("common", "p", "np")).alias("m")).select(F.col("s").alias("a"), F.col("m.common").alias("c"), F.col("m.p").alias("p"), F.col("m.np").alias("np"))
    row = F.struct("a", "n", "pos", "component", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("np", F.lit(0)).alias("np"), F.coalesce("c", F.lit(-1)).alias("c"))
    whole = at.join(head.select("token", "block"), ["token", "block"], "left_semi").join(best, "a", "left")
    whole = materialize(whole.groupBy("token", "block").agg(F.collect_list(row).alias("rows")), "blocks")  # at most BLOCK members each
    x, y = (head.select("token", *[F.col(c).alias(c + k) for c in ("block", "x", "y", "n0", "n1", "rest")]) for k in "ab")
    least = F.ceil((F.col("n0a") + F.col("n0b")) * percent / F.lit(100 + percent))
    meet = x.join(y, "token").where("blocka <= blockb and (xa <> ya or xb <> yb or xa <> xb)").where(F.least("resta", "restb") >= least)
    meet = meet.where((F.col("n1a") * 100 >= F.col("n0b") * percent) & (F.col("n1b") * 100 >= F.col("n0a") * percent)).select("token", "blocka", "blockb")
    meet = meet.join(whole.select("token", F.col("block").alias("blocka"), F.col("rows").alias("ra")).hint("merge"), ["token", "blocka"])
    meet = meet.join(whole.select("token", F.col("block").alias("blockb"), F.col("rows").alias("rb")).hint("merge"), ["token", "blockb"])
    flat = lambda r: [F.col(f"{r}.{f}").alias(f"{r}_{f}") for f in ("a", "n", "pos", "component", "p", "np", "c")]
    meet = meet.select((F.col("blocka") == F.col("blockb")).alias("same"), *flat("ra"), *flat("rb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                a, n, pos, comp, p, size, c = (np.asarray(v, np.int64)[:, None] for v in r[1:8])
                b, m, at, other, q, _, d = (np.asarray(v, np.int64)[None, :] for v in r[8:15])
                least = need(n, m, percent)
                ok = (comp != other) & (np.minimum(n, m) >= least) & (np.minimum(n - pos, m - at) >= least)
                if r.same:
                    ok &= a < b
                known = ok & (p == q) & (c >= 0) & (d >= 0)
                ok &= ~(known & (np.minimum(c, d) + np.minimum(n - c, m - d) < least))
                i, j = np.nonzero(ok)
                if len(i):
                    sure = known[i, j] & ((c + d - size >= least)[i, j])
                    low, high = np.minimum(a[i, 0], b[0, j]), np.maximum(a[i, 0], b[0, j])
                    turned = a[i, 0] > b[0, j]
                    out.append(pd.DataFrame({"a": low, "b": high, "na": np.where(turned, m[0, j], n[i, 0]), "nb": np.where(turned, n[i, 0], m[0, j]), "sure": sure}))
            if out:
                yield pd.concat(out)

    pairs = meet.mapInPandas(lean(run), "a long, b long, na long, nb long, sure boolean").groupBy("a", "b", "na", "nb").agg(F.max("sure").alias("sure"))
    done = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(done, ["a", "b"], "left_anti")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of ``docs`` for each component, the one with the least doc_id (nulls last); rows without words stay.

    Rows are joined by a key of all their columns, so that rows without a doc_id link like others and texts under one
    doc_id are told apart. Rows with equal keys are equal: they are first combined where they are read.
    """
    key, blank = fresh(docs.columns, "_key", "_blank")
    keyed = docs.withColumn(blank, ~F.coalesce(F.col(text).rlike(WORDS), F.lit(False)))
    rows = keyed.where(~F.col(blank)).drop(blank).withColumn(key, row_key(docs))
    found = join_documents(rows.select(key, text), doc_id=key, text=text, **options).select(F.col("doc_id").alias("k"), "component_id").distinct()
    order = F.struct(F.col("i").isNull().alias("none"), "i", "k")
    ids = rows.groupBy(F.col(key).alias("k")).agg(F.min(doc_id).alias("i"))
    kept = found.join(ids, "k").groupBy("component_id").agg(F.min(order).alias("m")).select(F.col("m.k").alias(key))
    kept = materialize(kept, "kept")
    one = rows.dropDuplicates([key]).join(kept, key, "left_semi").drop(key)
    return one.select(*docs.columns).unionByName(keyed.where(blank).select(*docs.columns))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(tune(spark).read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d
), g AS (
  SELECT doc_id, n, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle FROM w
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, shingle FROM g WHERE i <= greatest(n - 4, 1)
), c AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  JOIN c p ON p.doc_id = x.doc_id JOIN c q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), r(id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id AND r.c < e.b
)
SELECT d.doc_id, coalesce(any_value(c.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM d JOIN r ON r.id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id
"""
