import glob
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepool.llm import bpe, exact_dedup, packing, sharding

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_shards(rows, docs, shards):
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["text"], r["size"]) for r in rows) == Counter((i, t, size(t)) for i, t in docs)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    total, largest = sum(size(t) for _, t in docs), max(size(t) for _, t in docs)
    for s in range(shards):
        assert abs(sum(r["size"] for r in by[s]) - total / shards) <= max(largest, 0.01 * total / shards) + 1


def test_shards_of_odd_rows(odd, odd_docs):
    rows = sharding.shard_documents(odd, shards=4).collect()
    check_shards(rows, [(d[0], d[1]) for d in odd_docs], 4)
    assert rows[0].asDict().keys() >= {"lang", "kept", "fp"} and not any(k.startswith("_") for k in rows[0].asDict())


def test_a_hot_text_is_split_by_id(spark):
    docs = [(i, "hot text") for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = sharding.shard_documents(df, shards=8).collect()
    check_shards(rows, docs, 8)
    assert len({r["shard"] for r in rows if r["text"] == "hot text"}) >= 5


def test_crowded_cells_are_probed_again(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id % 7) AS _h", "id AS _d", "1L AS _size")
    rounds, cells = sharding.plan_splitters(keys, 4, 0.01, 64, 12, 16)
    assert len(rounds) >= 2 and max(c["rows"] for c in cells.values()) <= 5000 / 64
    assert sum(c["rows"] for c in cells.values()) == 5000


def test_extreme_ids(spark):
    docs = [(i, "same") for i in (-(2**63), 2**63 - 1, 0, None, -5, 5)]
    rows = sharding.shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), shards=3, tolerance=0.0).collect()
    check_shards(rows, docs, 3)


def test_no_rows(empty):
    assert sharding.shard_documents(empty).count() == 0
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert packing.pack_documents(empty, PATH).count() == 0
    assert bpe.encode_texts(empty, PATH).count() == 0


def test_exact_dedup(odd, odd_docs):
    got = exact_dedup.exact_dedup(odd).collect()
    groups = defaultdict(list)
    for d in odd_docs:
        groups[d[1] or ""].append(d[0])
    want = Counter()
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want.update((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_index_grows_by_appends(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    batch = lambda rows: spark.createDataFrame(rows, "doc_id long, text_sha256 string")
    found = lambda df: {(r["text_sha256"], r["keep_id"], r["group_size"], r["novel"]) for r in df.collect()}
    assert found(index.add(batch([(1, "a"), (2, "a"), (3, "b")]), "one")) == {("a", 2, 2, True), ("b", 3, 1, True)}
    first = {f: os.stat(f).st_mtime_ns for f in glob.glob(index.path.removeprefix("file://") + "/batch=one/*.parquet")}
    for _ in range(2):  # the second time in place of the first
        assert found(index.add(batch([(9, "a"), (4, "c"), (None, "c")]), "two")) == {("a", 9, 3, False), ("c", 4, 2, True)}
    assert {(r["text_sha256"], r["keep_id"], r["group_size"]) for r in index.groups().collect()} == {("a", 9, 3), ("b", 3, 1), ("c", 4, 2)}
    assert first and all(os.stat(f).st_mtime_ns == t for f, t in first.items())  # earlier files are left alone
    again = exact_dedup.DigestIndex(spark, name=index.name, path=index.path)
    assert found(again.add(batch([(7, "b")]), "three")) == {("b", 7, 2, False)} and again.add(batch([]), "none").count() == 0
    plan = index.rows().join(batch([(1, "a")]).hint("merge"), "text_sha256")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan  # the index side is not shuffled
    index.forget()
    assert not spark.catalog.tableExists(index.name)


def test_documents_meet_an_index_of_earlier_ones(spark):
    index, docs = exact_dedup.DigestIndex(spark), lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    exact_dedup.exact_dedup(docs([(1, "x"), (2, "y"), (3, None)]), index, batch="old")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(docs([(0, "x"), (5, "y"), (6, "z"), (7, "")]), index, batch="new").collect()}
    assert got == {0: (1, 2, False), 5: (5, 2, True), 6: (6, 1, True), 7: (7, 2, True)}


def library(texts):
    t = Tokenizer.from_file(PATH)
    ids = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    return ids, [t.decode(x, skip_special_tokens=False) for x in ids]


def test_bpe_equals_the_library(odd, odd_docs):
    ids, texts = library([d[1] or "" for d in odd_docs])
    want = Counter((d[0], np.array(i, "<u4").tobytes(), t) for d, i, t in zip(odd_docs, ids, texts))
    assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in bpe.encode_texts(odd, PATH).collect()) == want


@pytest.mark.parametrize("words", [bpe.WordEncoder, bpe.LibraryWords])
def test_bpe_on_random_strings(words):
    rng, coder = random.Random(1), bpe.TextEncoder(PATH, words(PATH), most_words=500)
    parts = ["a", "b", "the", " ", "'s", "'", "S", "é", "É", "ß", "1", "²", "½", "\n", "\x1c", "\x85", "é", "Σ", "σς", "İ", "中文", "😀",
             "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "!!", "</w>", "ing", "tion", "_", "​", "ſ", "K", " ", "\x00", "don't", "x" * 70]
    for _ in range(20):
        texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(200)]
        ids, decoded = library(texts)
        got = coder.encode(texts)
        assert bpe.packed(*got).to_pylist() == [np.array(x, "<u4").tobytes() for x in ids]
        assert coder.decode(*got).to_pylist() == decoded
        assert max(map(len, coder.cache)) <= 100 and len(coder.cache) < 1500


def test_long_words_merge_as_the_library_does():
    rng, coder = random.Random(2), bpe.WordEncoder(PATH)
    for n in (63, 64, 65, 2000):
        w = "".join(rng.choice("abcdeinorst") for _ in range(n))
        assert coder.encode([w])[0].tolist() == library([w])[0][0]


def check_packing(rows, docs, capacity):
    want = {}
    for i, t in docs:
        ids = library([t or ""])[0][0] + [1]
        for p, a in enumerate(range(0, len(ids), capacity)):
            want.setdefault((i, p, a, len(ids[a : a + capacity]), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())), 0)
            want[i, p, a, len(ids[a : a + capacity]), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in rows) == Counter(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(odd, odd_docs):
    rows = packing.pack_documents(odd, PATH, capacity=512).collect()
    rooms = []
    for length in sorted((r["length"] for r in rows), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
        rooms.append(min(fits, default=512) - length)
    assert check_packing(rows, [(d[0], d[1]) for d in odd_docs], 512) == len(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    cap = rng.choice([10, 17, 64])
    counts = {n: rng.randint(1, 30) for n in rng.sample(range(1, cap + 1), rng.randint(1, cap))}
    bins, seen = defaultdict(list), defaultdict(set)
    for length, lo, hi, per, first, at in packing.plan_runs(counts, cap):
        for r in range(lo, hi):
            assert r not in seen[length]
            seen[length].add(r)
            bins[first + (r - lo) // per].append((at + (r - lo) % per * length, length))
    assert {k: len(v) for k, v in seen.items()} == counts
    for own in bins.values():
        end = 0
        for at, length in sorted(own):
            assert at == end
            end += length
        assert end <= cap
    rooms = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fits = [r for r in rooms if r >= length]
        if fits:
            rooms.remove(min(fits))
        rooms.append(min(fits, default=cap) - length)
    assert len(rooms) == len(bins)


def test_packing_keeps_columns(odd):
    out = packing.pack_documents(odd, PATH)
    assert {"lang", "source", "ids", "sequence_id", "offset"} <= set(out.columns) and "text" not in out.columns
    assert out.where(F.col("length") > 4096).count() == 0
