"""Each corpus operator against brute force, and on nulls, empty and very long texts, ties, repeated rows, empty tables
and extra columns whose names clash."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest

from gridtrack.llm import bpe, common, jaccard, language, lines, mixing, neardup, quality, tokenfile, topk, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string, score string, size string, component_id string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    out = []

    def add(text, source="a", lang="en"):
        out.append((len(out), text, lang, source, len(text or ""), "k", "s", "z", "c"))

    base = prose(rng, 120)
    add(base)
    add(base)  # an exact copy
    words = base.split()
    words[60] = "other"
    add(" ".join(words), "b")  # a near copy
    for k in range(12):
        words = base.split()
        for at in rng.choice(120, 3, replace=False):
            words[at] = f"w{k}{at}"
        add(" ".join(words), "c")
    for k in range(40):
        add(prose(rng, int(rng.integers(1, 200))), "abc"[k % 3], ["en", "de", None][k % 3])
    add(None, None, None)
    add("", "a")
    add("  \n\t ", None)
    add("?! 123 --", "b")
    add("two words", "b")
    add("TWO words", "a")
    add("x" * 70_000 + " " + "\u00e9t\u00e9 " * 5000 + " \n" * 3000, "long")
    add(" ".join(prose(rng, 50) + f" {k}\n" for k in range(900)), "long")
    out.append(out[5])  # a repeated row
    out.append((None, "no id here at all today", "en", "a", 5, "k", "s", "z", "c"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).persist()


def count_of(df, *names):
    return collections.Counter(tuple(r[n] for n in names) for r in df.collect())


def test_components(spark):
    rng = np.random.default_rng(2)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(400, 460)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7)]
    root = {x: x for p in e for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {x for a, b in e if a != b for x in (a, b)}
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def test_mix(docs, rows):
    got = mixing.Mix(docs, block=16).taken().collect()
    word = re.compile(mixing.WORD)
    sizes = collections.defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(word.findall(r[1] or ""))
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((r[0], len(word.findall(r[1] or ""))) for r in rows)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order]), strict=True))
    assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes.values()))
    taken, source = collections.defaultdict(int), {r[0]: r[3] for r in rows}
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[source[r["doc_id"]]] and r["target"] == pytest.approx(goal[source[r["doc_id"]]])
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 16 + 16 for s in order)
    again = mixing.Mix(docs.repartition(7), block=16).taken()
    assert count_of(again, "doc_id", "taken") == collections.Counter((r["doc_id"], r["taken"]) for r in got)


def test_mix_documents_holds_the_words_taken(docs):
    mix = mixing.Mix(docs, block=16)
    word = re.compile(mixing.WORD)
    want = collections.Counter()
    for r in mix.taken().collect():
        want[r["doc_id"]] += r["taken"]
    out = mix.documents(n_chars="n_chars")
    assert out.columns == docs.columns
    got, whole = collections.Counter(), {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in out.collect():
        got[r["doc_id"]] += len(word.findall(r["text"]))
        assert r["n_chars"] == len(r["text"]) and all(part in whole[r["doc_id"]] for part in r["text"].split("\n")[:3])
    assert got == +want


def test_mix_of_repeated_rows_and_many_sources(spark, monkeypatch):
    """A row repeated 350 times fills several runs; sources beyond the bounds are joined and share one shard."""
    monkeypatch.setattr(mixing, "RANGES", 3)
    monkeypatch.setattr(mixing, "NAMED", 2)
    monkeypatch.setattr(mixing, "SLOTS", 4)
    many = [(1, "one two three four five", "en", "a", 23)] * 350 + [(k, f"w{k} x y", "en", "bcd"[k % 3], 6) for k in range(2, 100)] + [(None, None, None, None, None)] * 250
    df = spark.createDataFrame(many, "doc_id long, text string, lang string, source string, n_chars long")
    mix = mixing.Mix(df, block=16)
    got = [r.asDict() for r in mix.taken().collect()]
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter((r[0], len((r[1] or "").split())) for r in many)
    assert mix.packed.groupBy("src", "bucket", "key", "run").count().agg({"count": "max"}).first()[0] <= mixing.COPIES
    taken, source = collections.Counter(), {r[0]: r[3] for r in many}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]], r["target"]] += r["taken"]
    assert all(abs(t - goal) <= 32 for (_, goal), t in taken.items()), taken
    want = collections.Counter()
    for r in got:
        want[r["doc_id"]] += r["taken"]
    out = collections.Counter()
    for r in mix.documents(n_chars="n_chars").collect():
        out[r["doc_id"]] += len(r["text"].split())
    assert out == +want


def test_mix_broadcasts_no_slots_or_pieces(docs):
    """Few ranges make many slots, and few documents many pieces: by the size of the former Spark would broadcast the latter."""
    mix = mixing.Mix(docs, block=2)
    for df in (mix.taken(), mix.documents()):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan
        lines_ = plan.partition("== Initial Plan ==")[0].splitlines()
        depth = [len(x) - len(x.lstrip(" :+-*")) for x in lines_]
        for k, x in enumerate(lines_):
            if "BroadcastExchange" in x:
                below = next((j for j in range(k + 1, len(lines_)) if depth[j] <= depth[k]), len(lines_))
                assert not any("MapInPandas" in y or "ObjectHashAggregate" in y or "SortAggregate" in y for y in lines_[k:below]), "\n".join(lines_[k:below])


def test_mix_of_nothing(docs):
    assert mixing.Mix(docs.where("false")).taken().count() == 0
    assert mixing.Mix(docs.where("text is null")).taken().first()["taken"] == 0
    assert mixing.Mix(docs.where("false")).documents().count() == 0


def test_rows_with_maps(spark):
    rows = [(k, f"own line {k}\nCookie notice.", f"s{k}", {"a": k}) for k in range(12)] + [(0, "own line 0\nCookie notice.", "s0", {"a": 0}), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>")
    assert mixing.Mix(df).taken().count() == 14
    assert {r["text"] for r in lines.dedup_lines(df).collect()} == {*(f"own line {k}" for k in range(12)), None}
    inline, lines.INLINE_LINES = lines.INLINE_LINES, 0
    try:
        assert {r["text"] for r in lines.dedup_lines(df).collect()} == {*(f"own line {k}" for k in range(12)), None}
    finally:
        lines.INLINE_LINES = inline
    assert jaccard.keep_one(df).count() == 13


def test_targets_and_draws_and_permutations():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    slots = np.array([50, 0, 7])
    assert (sum(mixing.shard_draws(slots, 5, 1)) == slots).all()
    for n in (1, 2, 3, 5, 64, 1000):
        assert sorted(mixing.permute(np.arange(n), n, 9)) == list(range(n))
    assert (mixing.permute(np.arange(100), 100, 1) != mixing.permute(np.arange(100), 100, 2)).any()


# 2


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _want(tik, t):
    ids = tik.encode_ordinary(t or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(16_384, 1_024), (64, 16)])
def test_bpe(docs, rows, tik, chunk, overlap):
    got = bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, chunk, overlap)
    want = collections.Counter((r[0], *_want(tik, r[1])) for r in rows)
    assert count_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_bpe_of_nothing(docs):
    assert bpe.encode_documents(docs.where("false"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_chunks_stitch_to_the_whole(tik):
    codec = bpe._codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rng = np.random.default_rng(4)
    alphabet = list("abcXYZ  \n\n\t'''stremdvl019!?.,-\u00e9\u4e2d\u2003\x1c") + ["'ll", "'re", " the", "  "]
    for _ in range(300):
        text = "".join(rng.choice(alphabet, int(rng.integers(1, 400))))
        parts = [bpe.encode_chunk(k, n, t, codec, 40, 20) for k, n, t in bpe.chunks(text, 40, 20)]
        ids = bpe.stitch(parts)
        assert ids is None or ids == tik.encode_ordinary(text), text


# 3


def _vectors(rng):
    x = rng.normal(size=(120, 16))
    x[40:60] = x[0] + rng.normal(size=(20, 16)) * 0.05
    x[60:70] = x[1]
    x[70] = 3 * x[2]
    out = [(k, [float(c) for c in v], k) for k, v in enumerate(x)]
    out += [(200, None, 0), (201, [0.0] * 16, 0), (202, [None] + [1.0] * 15, 0), (203, [float("nan")] * 16, 0), (204, [float("inf")] + [1.0] * 15, 0), (205, [], 0), (206, [1.0, 2.0], 0), (207, [1.0, 2.1], 0)]
    return out


def test_near_duplicate_vectors(spark):
    rows = _vectors(np.random.default_rng(1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, class int")
    got = {r["vec_id"]: r for r in neardup.near_duplicates(df).collect()}
    good = {k: np.array(v) for k, v, _ in rows if k < 200 or k > 205}
    near = {k: {j for j, w in good.items() if j != k and len(w) == len(v) and v @ w >= 0.9 * np.linalg.norm(v) * np.linalg.norm(w)} for k, v in good.items()}
    for k, _, _ in rows:
        seen, todo = {k}, [k]
        while todo:
            new = near.get(todo.pop(), set()) - seen
            seen |= new
            todo += new
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (len(near.get(k, ())), min(seen), min(seen) == k), k
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_near_duplicates_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 7)
    rng = np.random.default_rng(5)
    x = rng.normal(size=16) + rng.normal(size=(40, 16)) * 0.02
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert count_of(neardup.near_duplicates(df), "n_links", "component_id") == {(39, 0): 40}


def test_hash_of_a_vector_is_the_same_in_any_company():
    x = np.random.default_rng(0).normal(size=(300, 64))
    whole = neardup._hash(x, 5, 9, 1.5, 7)
    assert all((neardup._hash(x[k : k + 1], 5, 9, 1.5, 7) == whole[k]).all() for k in range(0, 300, 7))
    both = [neardup._sent(np.array([0.5, 1.0])), neardup._sent(np.array([0.1, 1.0]))]
    assert [len(b) for b in both] == [9, 17] and np.allclose(neardup._unit(both[1:]), np.array([[0.1, 1.0]]) / np.hypot(0.1, 1))


def test_near_duplicates_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "y"), (1, [0.0, 1.0], "x"), (2, [0.1, 5.0], "x"), (None, [1.0, 0.1], "x"), (None, None, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept string"))
    assert count_of(got, "vec_id", "n_links", "component_id", "kept") == {(1, 2, 1, True): 2, (1, 1, 1, True): 1, (2, 1, 1, False): 1, (None, 2, 1, False): 1, (None, 0, None, True): 1}


def test_recall_of_layout():
    for n in (10, 10_000, 10**7):
        keys, tables = neardup.layout(n)
        assert 1 - (1 - neardup.collision(np.sqrt(0.2)) ** keys) ** tables >= 0.98


# 4


def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8)) * 0.3
    x[50:90] = x[0]
    rows = [(k, [float(c) for c in v], 0) for k, v in enumerate(x)] + [(300, None, 0), (320, [float("nan")] * 8, 0), (340, [None] * 8, 0), (360, [1.0, 2.0], 0), (None, [1.0] * 8, 0), (380, [1e6] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int").repartition(3)
    ints = {k: np.floor(64 * np.array(v)).astype(int) for k, v, _ in rows if k is not None and v and None not in v and np.isfinite(v).all()}
    want = []
    for q, v in ints.items():
        if q % 20 == 0:
            best = sorted((-int(v @ w), k) for k, w in ints.items() if k != q and len(w) == len(v))[:20]
            want += [(q, r, k, -s) for r, (s, k) in enumerate(best, 1)]
    assert count_of(topk.top_k(df), "query_id", "rank", "vec_id", "score") == collections.Counter(want)
    assert topk.top_k(df.where("false")).count() == 0


def test_top_k_reads_few_rows_exactly(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 300)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1000, 16)) * 8  # integers of over 6 bits: cells are wider than one
    rows = [(k, [float(c) for c in v], 0) for k, v in enumerate(x)] + [(20, [float(c) for c in x[20]], 0), (7, [float(c) for c in x[20]], 0)]
    df, seen = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(3), []
    got = topk.top_k(df, seen=seen)
    ints, want = [(k, np.floor(64 * np.array(v)).astype(int)) for k, v, _ in rows], []
    for q, v in ints:
        if q % 20 == 0:
            best = sorted((-int(v @ w), k) for k, w in ints if k != q)[:20]
            want += [(q, r, k, -s) for r, (s, k) in enumerate(best, 1)]
    assert count_of(got, "query_id", "rank", "vec_id", "score") == collections.Counter(want)
    assert sum(s.count() for s in seen) < 0.1 * 51 * len(rows)


def test_top_k_of_large_components(spark):
    rows = [(k, [10.0 ** (k % 9), -(10.0 ** (k % 14)), 1.5]) for k in range(60)] + [(100, [1e15, 0.0, 1.0]), (101, [1e300, 1.0, 1.0]), (102, [-1e17, 5.0, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    ints, want, top = {k: [int(np.floor(64 * c)) for c in v] for k, v in rows}, [], 2**63 - 1
    for q, v in ints.items():
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), k) for k, w in ints.items() if k != q)[:20]
            want += [(q, r, k, max(-top - 1, min(top, -s))) for r, (s, k) in enumerate(best, 1)]
    assert count_of(got, "query_id", "rank", "vec_id", "score") == collections.Counter(want)


# 5


def _sets(rows):
    out = {}
    for k, r in enumerate(rows):
        w = (r[1] or "").encode().lower().split()
        out[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    return out


def _classes(rows, sets):
    ids = list(sets)
    root = {k: k for k in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and (rows[a][0] is not None and rows[b][0] is not None):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for k in ids:
        if rows[k][0] is not None:
            least[find(k)] = min(least.get(find(k), 10**9), rows[k][0])
    return [(rows[k][0], len(sets[k]), least.get(find(k))) for k in ids]


@pytest.mark.parametrize(("short", "long"), [(3, 100_000), (1, 100_000), (3, 1), (3, 4)])  # long 1: every list is dealt over buckets
def test_jaccard_join(docs, rows, short, long, monkeypatch):
    monkeypatch.setattr(jaccard, "SHORT", short)
    monkeypatch.setattr(jaccard, "LONG", long)
    got = jaccard.join_documents(docs)
    assert count_of(got, "doc_id", "n_shingles", "component_id") == collections.Counter(_classes(rows, _sets(rows)))


@pytest.mark.parametrize(("long", "block", "bits"), [(100_000, 512, 1 << 25), (4, 3, 64), (100_000, 3, 1 << 25)])
def test_jaccard_join_of_chained_groups(spark, long, block, bits, monkeypatch):
    monkeypatch.setattr(jaccard, "LONG", long)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "FILTER_BITS", bits)  # 64: documents are read again by a join
    rng = np.random.default_rng(8)
    rows = []
    for g in range(6):
        words = list(rng.choice(WORDS, 80))
        for k in range(25):
            words = list(words)
            words[int(rng.integers(80))] = f"x{g}.{k}"
            rows.append((len(rows), " ".join(words)))
    shared = prose(rng, 30)
    rows += [(len(rows) + k, shared + " " + " ".join(f"u{k}.{i}" for i in range(int(rng.integers(1, 60))))) for k in range(60)]
    got = jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert count_of(got, "doc_id", "n_shingles", "component_id") == collections.Counter(_classes(rows, _sets(rows)))


def test_jaccard_join_of_nothing_and_keep_one(docs, rows):
    assert jaccard.join_documents(docs.where("false")).count() == 0
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    want = [r[0] for r, (d, _, c) in zip(rows, _classes(rows, _sets(rows)), strict=True) if d is None or c == d]
    assert collections.Counter(r["doc_id"] for r in out.collect()) == collections.Counter(want)


def test_keep_one_row_of_each_group(spark):
    rng = np.random.default_rng(11)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    near = lambda t: t + " tail"
    rows = [(1, a, "x")] * 5 + [(1, a, "y"), (4, near(a), "x")]  # one doc_id many times, and a near copy
    rows += [(2, b, "x"), (None, b, "x"), (None, near(b), None)]  # without a doc_id, beside one that has it
    rows += [(None, c, "x"), (None, c, "x"), (None, near(c), "x")]  # a group without any doc_id
    rows += [(4, d, "x")]  # doc_id 4's other text, in a component of its own
    rows += [(5, None, "x"), (5, " \n\t ", "x"), (None, "", "x"), (None, "", "x")]  # no words: all stay
    for part in (1, 5):
        got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(part)).collect()
        words = [(r["doc_id"], r["text"]) for r in got if (r["text"] or "").strip()]
        assert len(words) == 4 and {(1, a), (2, b), (4, d)} < set(words)
        assert [t in (c, near(c)) for i, t in words if i is None] == [True]
        assert collections.Counter((r["doc_id"], r["text"]) for r in got if not (r["text"] or "").strip()) == collections.Counter((i, t) for i, t, _ in rows[-4:])


# 6


@pytest.mark.parametrize("size", [4_000_000, 50])
def test_token_files(docs, rows, size):
    tok = tokenfile._tokenizer(P.path("word_bpe_49k.json"))
    got = tokenfile.read_shards(tokenfile.write_shards(docs, P.path("word_bpe_49k.json"), shard_ids=size)).collect()
    want, start = collections.Counter(), 0
    coded = [(r[0], tok.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in rows]
    for d, ids in sorted(coded, key=lambda x: (x[0] is not None, x[0] or 0)):
        want[d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert collections.Counter((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert tokenfile.read_shards(tokenfile.write_shards(docs.where("false"), P.path("word_bpe_49k.json"))).count() == 0


def test_word_encoder_is_the_tokenizer():
    enc = tokenfile.WordEncoder(P.path("word_bpe_49k.json"))
    for t in ["", "It's <|endoftext|> ok", "\u0130stanbul \u03a3\u03a3 e\u0301 \u00a0x\u2003y", "a\x1cb c\x1fd", '("\u00c9cole!?" \u00dcber\u00df, na\u00efve... x-y (z) [\u00c5\u00d8\u00ff];: \u00d7\u00f7 e\u0301a, \u00e9\u0301 {a}~ `b` a\u00aab \u00b5m', "\u4e2d\u6587 don't WE'LL 12 3.4\n\n'S"]:
        assert np.frombuffer(enc(t), np.uint32).tolist() == enc.tok.encode(t, add_special_tokens=False).ids


def test_elias_fano():
    rng = np.random.default_rng(0)
    for v in ([], [0], [5], [0, 0, 7, 7, 7], np.sort(rng.integers(0, 10**9, 1000)), np.arange(500), np.cumsum(rng.integers(0, 3, 700))):
        ef, _ = tokenfile.EliasFano.loads(memoryview(tokenfile.EliasFano.encode(np.array(v, np.int64)).dumps()))
        assert ef.select(np.arange(len(v))).tolist() == list(v) and [ef.select(i) for i in range(len(v))] == list(v)
    bounds = np.cumsum(rng.integers(100, 900, 10_000))
    assert len(tokenfile.EliasFano.encode(bounds).dumps()) < 10_000 * 2
    s = tokenfile.Shard(tokenfile.dump_shard([None, 3, 9], [2, 1, 3], np.arange(6, dtype="<u2").tobytes(), 2))
    assert [s.part(i, j)[0] for i, j in ((0, 3), (0, 1), (0, 2), (1, 3), (2, 3))] == [[None, 3, 9], [None], [None, 3], [3, 9], [9]]
    assert [s.doc(i) for i in range(3)] == [None, 3, 9] and s.tokens(2).tolist() == [3, 4, 5] and len(s) == 3


# 7


@pytest.mark.parametrize("inline", [10_000, 0])
def test_line_dedup(spark, inline, monkeypatch):
    monkeypatch.setattr(lines, "INLINE_LINES", inline)
    rows = [(k, f"Own line {k} which is quite long and stays.\n Cookie notice. \nEnd {k % 3}", f"s{k}", "x") for k in range(12)]
    rows += [(20, "Cookie notice.", "s1", "x"), (21, None, "s1", "x"), (22, "", None, "x"), (23, "a\n\nb\n", None, "x"), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _lost string")
    out = lines.dedup_lines(df, min_sites=10, removed="removed")
    want = collections.Counter()
    for d, t, s, x in rows:
        cut = d < 12
        want[d, t.replace("\n Cookie notice. ", "") if cut else t, s, x, int(cut)] += 1
    assert count_of(out, "doc_id", "text", "source", "_lost", "removed") == want
    assert lines.dedup_lines(df.where("false")).count() == 0


@pytest.mark.parametrize("inline", [10_000, 0])
def test_pipeline_removes_boilerplate_of_any_share(spark, inline, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(lines, "INLINE_LINES", inline)
    notice = "All rights reserved by the owners of this site, whoever they are."
    rows = [(k, f"{notice}\nown {k}", f"s{k}") for k in range(12)]  # over half of it is boilerplate
    rows += [(20, f"{notice}\n \n{notice}", "s1"), (21, None, "s1"), (22, "", "s2")]  # a whole copy; nothing
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, source string, n_chars long")
    got = corpus_pipeline.line_dedup(spark, df, "")
    want = [(d, f"own {d}" if d < 12 else t) for d, t, _ in rows]
    assert count_of(got, "doc_id", "text") == collections.Counter(want)


def test_line_spread_is_exact_near_the_threshold(spark):
    rows = [(f"line {k}", f"s{s}") for k in range(300) for s in range(5 + k % 11)]
    got = {r["h"] for r in lines.spread_lines(spark.createDataFrame(rows, "text string, source string"), 10).collect()}
    assert len(got) == sum(5 + k % 11 >= 10 for k in range(300))


# 8


def test_language(spark, docs):
    rng = np.random.default_rng(0)
    syllables = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "\u00fcn", "der"], "cc": ["\u4e2d", "\u6587", "x"]}
    rows = [(k, " ".join("".join(rng.choice(syllables[g], 3)) for _ in range(30)), g) for k, g in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(500, None, "aa"), (501, "123 !!", "aa"), (502, "", None), (503, rows[0][1] * 3000, None), (None, rows[1][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language.fit(df)
    got = language.identify(df, trees).toPandas()
    assert list(got.columns) == ["doc_id", "text", "lang", "lang_pred", "score"]
    unseen = got[got.doc_id.map(lambda k: k < 120 and zlib.crc32(str(int(k)).encode()) % 4 == 2 if k == k else False)]
    assert len(unseen) > 10 and (unseen.lang == unseen.lang_pred).all()
    assert set(got[got.doc_id.isin([500, 501, 502])].lang_pred) == {"und"} and got.score.between(0, 1).all()
    assert got[got.doc_id == 503].lang_pred.tolist() == ["aa"] and got[got.doc_id.isna()].lang_pred.tolist() == ["bb"]
    shuffled = language.identify(df.repartition(5), language.fit(df.repartition(5))).toPandas()
    assert np.allclose(sorted(got.score), sorted(shuffled.score))
    assert set(language.identify(df, language.fit(df.where("lang is null"))).toPandas().lang_pred) == {"und"}
    assert language.identify(df.where("false"), trees).count() == 0


def _walk(samples, order, context, byte):
    """Bits of a byte by a plain walk down the contexts."""

    def chances(c):
        lower = chances(c[1:]) if c else {k: 1 / 256 for k in range(256)}
        n = collections.Counter()
        for x in samples:
            y = b" " * order + x
            n.update(y[i] for i in range(order, len(y)) if y[i - len(c) : i] == c)
        total, distinct = sum(n.values()), len(n)
        if not total:
            return lower
        room = sum(v for k, v in lower.items() if k not in n)
        return {k: n[k] / (total + distinct) if k in n else lower[k] / room * distinct / (total + distinct) for k in range(256)}

    return -np.log2(chances(context)[byte])


@pytest.mark.parametrize("order", [0, 1, 3, 4])
def test_code_lengths_are_a_plain_walk(order):
    samples = {"a": [b"abracadabra", b"abc"], "b": [b"xyzzy xyz", b"aab"]}
    trees = language.ContextTrees(samples, order)
    rng = np.random.default_rng(0)
    for _ in range(60):
        context, byte = bytes(rng.choice(list(b"abrxyz q"), order).tolist()), int(rng.choice(list(b"abxz\x07 ")))
        got = trees.costs(np.array([int.from_bytes(context + bytes([byte]), "big")], np.uint64))[0]
        assert np.allclose(got, [_walk(samples[x], order, context, byte) for x in "ab"], atol=1e-4), (context, byte)
    every = np.array([int.from_bytes(b"abra"[:order] + bytes([k]), "big") for k in range(256)], np.uint64)
    assert np.allclose((2.0 ** -trees.costs(every).astype(float)).sum(0), 1, atol=1e-4)
    got = trees.lengths([b"abra", b"", b"zzzzz"])
    assert np.allclose(got[0], [sum(_walk(samples[x], order, (b" " * order + b"abra")[i : i + order], b"abra"[i]) for i in range(4)) for x in "ab"], atol=1e-3)
    assert (got[1] == 0).all() and np.allclose(trees.lengths([b"abra" * 50, b"xyz"], step=7), trees.lengths([b"abra" * 50, b"xyz"]), atol=1e-3)


def test_language_beside_columns_of_its_names(spark):
    rows = [(k, "some words of it " * (k + 1), "en", 1, "x", 2.0) for k in range(8)] + [(None, None, None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _wanted int, lang_pred string, score double")
    got = language.identify(df, language.fit(df))
    assert got.columns == [*df.columns, "lang_pred_", "score_"]
    assert count_of(got, "doc_id", "lang_pred", "score", "lang_pred_") == collections.Counter((r[0], r[4], r[5], "en" if r[1] else "und") for r in rows)
    long = spark.createDataFrame([(k, "ab " * 30_000, "zz") for k in range(8)], "doc_id long, text string, lang string")
    assert language.fit(long).languages == ["zz"]  # only long texts: their beginnings are learned


# 9


def test_urls(spark):
    cases = {
        "http://Example.COM/en/x?q#f": ("example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://a.b.example.com/en/1": ("a.b.example.com", "/en/1", "example.com/en/", "block"),
        "http://example.com": ("example.com", "", None, "allow"),
        "http://xcom/": ("xcom", "/", None, "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://m.x.net/es/": ("m.x.net", "/es/", "net/es/", "block"),
        "http://x.net?u=http://y/es/": ("x.net", "", None, "allow"),
        "x://a://net/es/": ("a:", "//net/es/", None, "allow"),
        "nothing": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"), "://": ("", "", None, "allow"),
    }
    rows = [(k, u, "h", 1) for k, u in enumerate(cases)] + [(0, next(iter(cases)), "h", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule int")
    got = urls.judge_urls(df, urls.rules_frame(spark, urls.RULES))
    want = collections.Counter((k, *cases[u]) for k, u, _, _ in rows)
    assert count_of(got, "page_id", "host", "path", "rule", "verdict") == want
    assert urls.judge_urls(df.where("false"), urls.rules_frame(spark, urls.RULES)).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in urls.judge_urls(df, none).collect()} == {"allow"}


def test_very_long_urls_and_repeated_rules(spark):
    deep, path = ".".join(["a"] * 300) + ".example.com", "/en/" + "x" * 60_000
    rows = [(1, f"http://{deep}{path}", "v"), (2, "http://" + "b" * 70_000, "v"), (None, f"http://example.com{path}?q", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = urls.judge_urls(df, urls.rules_frame(spark, urls.RULES * 2))
    want = {(1, deep, path, "example.com/en/", "block"): 1, (2, "b" * 70_000, "", None, "allow"): 1, (None, "example.com", path, "example.com/en/", "block"): 1}
    assert count_of(got, "page_id", "host", "path", "rule", "verdict") == want


def test_urls_by_brute_force(spark):
    rng = np.random.default_rng(0)
    hosts = [".".join(rng.choice(["a", "b", "com", "a-b", "a0"], int(rng.integers(1, 5)))) for _ in range(60)]
    rules = [(h, p, v) for h, p, v in zip(rng.choice(hosts, 30), rng.choice(["/", "/x", "/x/y"], 30), rng.choice(["allow", "block"], 30), strict=True)]
    rules = [(str(a), str(b), str(c)) for a, b, c in {(a, b): (a, b, c) for a, b, c in rules}.values()]
    pages = [(k, f"http://{rng.choice(hosts)}{rng.choice(['/', '/x', '/x/y/z', ''])}") for k in range(300)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), urls.rules_frame(spark, rules)).collect()}
    for k, u in pages:
        host, _, path = u[7:].partition("/")
        path = "/" + path if "/" in u[7:] else ""
        fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = min(fit, key=lambda r: (-len(r[0]) - len(r[1]), -len(r[0]), r[2]), default=None)
        assert got[k] == ((best[0] + best[1], best[2]) if best else (None, "allow"))


def test_urls_of_a_hot_host_over_many_ranges(spark, monkeypatch):
    """Two thirds of the pages on one host with many nested rules: ranges begin inside a host, a path and a rule."""
    monkeypatch.setattr(urls, "RUN", 3)
    rules = [("net", "/", "allow"), ("hot.net", "", "block"), ("HOT.net", "", "allow"), ("", "/", "block"), ("net/", "/", "block"), ("cold.org", "/a", "block")]
    rules += [("hot.net", "/" + "a" * k, "block" if k % 2 else "allow") for k in range(0, 40, 3)] + [("hot.net", f"/b{k}", "block") for k in range(200)]
    pages = [(k, f"http://hot.net/{'a' * (k % 50)}") for k in range(300)] + [(k, f"http://www.hot.net/b{k}/x") for k in range(300, 600)]
    pages += [(k, u) for k, u in enumerate(["http://cold.org/ab", "http://org/a", "http://net", "http://a.net/?/b1", "x"] * 50, 600)] + [(7, "http://hot.net/b1")] * 10
    kept = {(h.lower(), p): min(v for g, q, v in rules if (g.lower(), q) == (h.lower(), p)) for h, p, _ in rules if h and "/" not in h}
    want = collections.Counter()
    for k, u in pages:
        host, slash, path = u[7:].partition("/")
        path = (slash + path).partition("?")[0]
        host = host.partition("?")[0]
        fit = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in kept.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want[k, host, path, *(max(fit)[2:] if fit else (None, "allow"))] += 1
    got = urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), urls.rules_frame(spark, rules))
    assert count_of(got, "page_id", "host", "path", "rule", "verdict") == want


# 10


def test_quality(spark):
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for k in range(400):
        bad = k % 3 == 0
        rows.append((k, prose(rng, 40).upper() + "!!" if bad else prose(rng, 40) + ".", "x"))
        labels.append((k, 0 if bad else 1))
    rows += [(900, None, "x"), (901, "", "x"), (902, "word " * 50_000, "x"), (None, "some", "x"), rows[5]]
    labels += [(900, None), (None, 1), (5, 1)]
    d, l = spark.createDataFrame(rows, "doc_id long, text string, _y string"), spark.createDataFrame(labels, "doc_id long, quality int")  # noqa: E741
    trees = quality.fit(d, l)
    got = quality.score_documents(d, trees).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    unseen = got[got.doc_id.map(lambda k: k < 400 and zlib.crc32(str(int(k)).encode()) % 3 == 1 if k == k else False)]
    assert ((unseen.score >= 0.5) == (unseen.doc_id % 3 != 0)).mean() > 0.95
    again = quality.score_documents(d.repartition(5), quality.fit(d.repartition(3), l.repartition(5))).toPandas()
    assert sorted(got.score) == sorted(again.score)
    assert quality.score_documents(d.where("false"), trees).count() == 0
    assert quality.fit(d, l.where("false")).score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]


def test_quality_beside_columns_of_its_names(spark):
    rows = [(k, "some words " * k, 9.0) for k in range(9)] + [(3, "some words " * 3, 9.0), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    trees = quality.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    got = quality.score_documents(df, trees)
    assert got.columns == [*df.columns, "score_"] and count_of(got, "doc_id", "score") == collections.Counter((r[0], r[2]) for r in rows)


def _plain_tree(x, y, start, rate, rounds):
    """Boosted stumps by trying every cut between values: (feature, cut, left, right) and scores."""
    score, out = np.full(len(y), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        best = (1e-12, 0, np.inf)
        for f in range(x.shape[1]):
            for cut in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= cut
                if min(left.sum(), (~left).sum()) >= quality.LEAST:
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + quality.L2) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + quality.L2)
                    if gain > best[0] + 1e-9:
                        best = (gain, f, cut)
        left = x[:, best[1]] <= best[2]
        value = [-rate * g[s].sum() / (h[s].sum() + quality.L2) for s in (left, ~left)]
        score += np.where(left, *value)
        out.append((*best[1:], *value))
    return out, score


def test_trees_are_a_plain_split_search():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (80, 3)).astype(float)  # fewer values than bins: cuts are exact
    y = ((x[:, 1] > 5) ^ (rng.random(80) < 0.1)).astype(float)
    trees = quality.BoostedTrees.fit(x, y, trees=6, depth=1)
    want, score = _plain_tree(x, y, trees.start, quality.RATE, 6)
    assert [int(f[0]) for f in trees.feature] == [w[0] for w in want]
    assert np.allclose(trees.score(x), 1 / (1 + np.exp(-score)), atol=1e-9)
    deep = quality.BoostedTrees.fit(x, y)
    for r, got in zip(x, deep.score(x), strict=True):  # one row at a time down each tree
        total = deep.start
        for feature, cut, value in zip(deep.feature, deep.cut, deep.value, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(r[feature[node]] > cut[node])
            total += value[node - len(feature)]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


# pipeline


def test_pipeline_stages_are_a_plain_version(spark, docs, rows, tik):
    """Each stage on its own input, as rows in Python."""
    import corpus_pipeline

    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    assert list(stages) == ["language_id", "line_dedup", "near_duplicates", "mix", "encode"]

    def run(name, at):
        out = common.materialize(stages[name](spark, at, ""), "test")
        assert name == "encode" or out.columns == columns
        return out, [tuple(r) for r in out.collect()]

    notice = [(1000 + k, f"Shared notice of all sites here.\nown words number {k} of this page", "en", f"site{k}", 50, "k", "s", "z", "c") for k in range(12)]
    at = spark.createDataFrame(rows + notice, DOCS).repartition(4)
    have = [tuple(r) for r in at.collect()]
    trees = language.fit(at)
    names, scores = trees.predict([r[1] for r in have])
    at, got = run("language_id", at)
    want = [r for r, n, x in zip(have, names, scores, strict=True) if n != "und" and x >= corpus_pipeline.LEAST_SCORE]
    assert collections.Counter(got) == collections.Counter(want) and {r[1] for r in have} - {r[1] for r in got} >= {None, "", "  \n\t ", "?! 123 --"}

    sites = collections.defaultdict(set)
    for r in got:
        for x in {x.strip() for x in r[1].split("\n")} - {""}:
            sites[x].add(r[3])
    want = collections.Counter()
    for r in got:
        kept = [x for x in r[1].split("\n") if len(sites.get(x.strip(), ())) < 10]
        text = "\n".join(kept) if any(x.strip() for x in kept) else r[1]
        want[(r[0], text, r[2], r[3], len(text), *r[5:])] += 1
    at, got = run("line_dedup", at)
    assert collections.Counter(got) == want and not any("Shared notice" in r[1] for r in got)

    own = [(k, r[1]) for k, r in enumerate(got)]
    group = collections.defaultdict(list)
    for k, (_, _, c) in enumerate(_classes(own, _sets(own))):
        group[c].append(k)
    want = [min((got[k][0] is None, got[k][0] or 0) for k in x) for x in group.values()]
    before = set(got)
    at, got = run("near_duplicates", at)
    assert sorted((r[0] is None, r[0] or 0) for r in got) == sorted(want) and set(got) <= before

    word, whole = re.compile(mixing.WORD), {(r[0], r[3]): r[1] for r in got}
    sizes, taken, each = collections.Counter(), collections.Counter(), collections.Counter()
    for r in got:
        sizes[r[3]] += len(word.findall(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order]), strict=True))
    at, got = run("mix", at)
    for r in got:
        n = len(word.findall(r[1]))
        taken[r[3]] += n
        each[r[0], r[3]] += n
        assert r[4] == len(r[1]) and collections.Counter(word.findall(r[1])) <= collections.Counter(word.findall(whole[r[0], r[3]]))
    assert all(abs(taken[s] - goal[s]) <= 2 * mixing.BLOCK for s in order)
    assert all(n <= 2 * len(word.findall(whole[k])) for k, n in each.items())

    want = collections.Counter((r[0], *_want(tik, r[1])) for r in got)
    out, _ = run("encode", at)
    assert count_of(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_pipeline_without_languages(spark):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "words here", None, "a", 10), (2, "12 !", None, "a", 4), (3, None, None, "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.language_id(spark, df, "").collect()] == [1]


SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_embedding_near_dedup", "op4_exact_top_k", "op5_jaccard_join", "op7_line_dedup", "op9_url_filters"])
def test_query_is_its_sql(spark, name):
    import duckdb

    from gridtrack.llm import queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SMALL), con.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert collections.Counter(tuple(r[c] for c in want.columns) for r in got.collect()) == collections.Counter(want.fetchall())


def test_queries_without_sql(spark, tik):
    from gridtrack.llm import queries

    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    ids = collections.Counter(d for d, _, _ in docs)
    run = lambda name: queries.QUERIES[name](spark, SMALL)
    assert count_of(run("op2_byte_bpe"), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == collections.Counter((d, *_want(tik, t)) for d, t, _ in docs)
    assert count_of(run("op5_jaccard_join"), "doc_id", "n_shingles", "component_id") == collections.Counter(_classes(docs, _sets(docs)))
    tok, start, want = tokenfile._tokenizer(P.path("word_bpe_49k.json")), 0, collections.Counter()
    for d, t, _ in sorted(docs):
        coded = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want[d, start, len(coded), zlib.crc32(np.array(coded, "<u4").tobytes())] += 1
        start += len(coded)
    assert count_of(run("op6_token_files"), "doc_id", "start", "n_tokens", "ids_crc32") == want
    for name, m, rest in (("op8_language_id", 4, 2), ("op10_quality_classifier", 3, 1)):
        assert count_of(run(name), "doc_id", "held_out") == collections.Counter((d, zlib.crc32(str(d).encode()) % m == rest) for d, _, _ in docs)
    pred, held = {r["doc_id"]: r["lang_pred"] for r in run("op8_language_id").collect()}, [(d, x) for d, t, x in docs if x and t and zlib.crc32(str(d).encode()) % 4 == 2]
    assert np.mean([pred[d] == x for d, x in held]) > 0.95
    mixed = run("op1_mix_sources").collect()
    assert collections.Counter(r["doc_id"] for r in mixed) == ids and all(r["taken"] <= 2 * r["size"] for r in mixed)


def test_pipeline(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "mix", "encode"]
    at = docs
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        at = common.materialize(f(spark, at, ""), "test")
        if k < 4:
            assert at.columns == docs.columns
    assert set(at.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and at.count() > 0
    for empty in (docs.where("false"), docs.where("text is null")):
        at = empty
        for _, f in corpus_pipeline.STAGES:
            at = common.materialize(f(spark, at, ""), "test")
        assert at.count() == 0
