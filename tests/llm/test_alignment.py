"""Token alignment against whole texts, encoded and cut one by one."""

import hashlib
import random

import numpy as np
import public_tokenizers as files
import pytest

from tests.llm.conftest import DOCS
from tidepool.llm import alignment

PATHS = files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def coder():
    return alignment.tokenizers(*PATHS)


def whole(coder, text):
    """(n_a, n_b, n_groups, n_links, digest) and how often each id pair is linked."""
    none = (0, 0, 0, 0, ""), {}
    if not text:
        return none
    raw, a, b = (" " + text).encode(), coder.a.encode(" " + text, add_special_tokens=False).ids, coder.b.encode(text)
    first, second = [coder.a_bytes[i] for i in a], [coder.b_bytes[i] for i in b]
    if b"".join(first) != raw or b"".join(second) != raw:
        return none
    x, y = (np.cumsum([*map(len, s)]).tolist() for s in (first, second))
    groups, pairs, i, j = [], {}, 0, 0
    for end in sorted(set(x) & set(y)):
        k, m = x.index(end) + 1, y.index(end) + 1
        groups.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
        for p in a[i:k]:
            for q in b[j:m]:
                pairs[p, q] = pairs.get((p, q), 0) + 1
        i, j = k, m
    return (len(a), len(b), len(groups), sum(pairs.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()), pairs


def brute(coder, texts):
    each = [whole(coder, t) for t in texts]
    count, most = {}, {}
    for _, pairs in each:
        for p in pairs:
            count[p] = count.get(p, 0) + 1
    for (a, b), n in count.items():
        most[a] = max(most.get(a, 0), n)
    return [(*row[:4], sum(n for p, n in pairs.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in pairs.items()), row[4]) for row, pairs in each]


PARTS = ["a", "b", " ", "  ", "\n", "\t", "\xa0", "　", "\r", "é", "中", "😀", "'s", "▁", "<s>", "<|endoftext|>", "12", "\x1c", "\x00", "word", "́", "ﬁ", ".", "\n\n", "Foo,", " the"]


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_groups_by_bisection():
    rng = random.Random(1)
    for _ in range(300):
        last = rng.randint(1, 60)
        a, b = (sorted({*rng.sample(range(1, last + 1), rng.randint(0, last)), last}) for _ in range(2))
        shared = sorted(set(a) & set(b))
        known = sorted({*rng.sample(shared, rng.randint(0, len(shared))), last})
        for cuts in (None, np.array(known)):
            ends_a, ends_b = alignment.shared_groups(np.array(a), np.array(b), cuts)
            assert ends_a.tolist() == [a.index(c) + 1 for c in shared] and ends_b.tolist() == [b.index(c) + 1 for c in shared]


def test_every_text_as_a_whole_one(spark, coder, words):
    texts = [None, "", *odd_texts(700), words(3000, 1), "x" * 5000, "中文" * 800, *[words(40, 5)] * 20, *[words(30, 100 + i) for i in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = {r["doc_id"]: tuple(r[c] for c in columns) for r in alignment.align(df, *PATHS, keep=["doc_id"]).collect()}
    want = brute(coder, texts)
    assert [found[i] for i in range(len(texts))] == want
    assert 100 < sum(w[0] == 0 for w in want) < len(texts) - 100


def test_small_blocks_count_alike(spark, coder):
    texts = odd_texts(120, 8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    blocks = alignment.aligned_blocks(df, *PATHS, ["doc_id"], block_chars=100)
    assert blocks.where("pairs IS NOT NULL").count() > 1
    count = {}
    for t in texts:
        for p in whole(coder, t)[1]:
            count[p] = count.get(p, 0) + 1
    most = {a: max(n for (x, _), n in count.items() if x == a) for a, _ in count}
    from tidepool.llm.shared import written

    got = {(r["pair"] >> 32, r["pair"] & 0xFFFFFFFF): (r["count"], r["best"]) for r in alignment.pair_counts(written(blocks, "blocks")).collect()}
    assert got == {p: (n, n == most[p[0]]) for p, n in count.items()}


def test_models_that_join_words_are_not_cut(coder, monkeypatch):
    monkeypatch.setattr(coder, "spaced", False)
    monkeypatch.setattr(coder, "lined", False)
    block = alignment._Block(coder)
    texts = odd_texts(100, 5)
    block.add(texts)
    assert block.described()[0] == [whole(coder, t)[0] for t in texts]


def test_odd_rows(spark, odd, odd_docs, empty):
    out = alignment.align(odd.withColumnRenamed("size", "n_best"), *PATHS)
    assert out.count() == len(odd_docs) and set(out.columns) == ({c.split()[0] for c in DOCS.split(", ")} - {"size"}) | {
        "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
    assert alignment.align(empty, *PATHS).count() == 0
