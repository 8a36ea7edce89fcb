"""Pair-bound MaxScore against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from tidepool.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    counted = [(i, Counter(split(t))) for i, t in docs if split(t)]
    many, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counted:
            n, score = sum(c.values()), 0
            m = 75 + 25 * n * many // length
            for t in split(text):
                if t in c:
                    score += math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if score:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def corpus(words, n=150):
    rng = random.Random(8)
    frequent = words(12, 77).split()
    docs = []
    for i in range(n):
        own = words(rng.choice((3, 20, 60)), 900 + i % 100).split() + [rng.choice(frequent) for _ in range(rng.choice((0, 10, 30)))]
        rng.shuffle(own)
        docs.append((i, " ".join(own)))
    docs += [(500 + i, docs[3][1]) for i in range(30)]  # copies: ties beyond the 20
    items = [(i, f"{docs[i * 7][1]} {' '.join(frequent[:6])} {frequent[0].upper()}, nowhere-{i}") for i in range(12)]
    return docs, items


def test_scores_and_ties_are_exact(spark, words):
    docs, items = corpus(words)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute(docs, items))
    for s in (lexical.Settings(), lexical.Settings(block_rows=13, block_postings=150, range_rows=3, part_items=2, most_parts=1, most_words=0)):
        got = [tuple(r) for r in lexical.ranked(df, asked, settings=s).collect()]
        assert sorted(got) == want
    assert sorted(tuple(r) for r in lexical.ranked(df, asked, k=3).collect()) == sorted(brute(docs, items, 3))


def test_odd_rows(spark, words):
    long = words(20_000, 4)
    docs = [(1, None), (2, ""), (3, "--- !!"), (4, "Été 12 été"), (4, "Été 12 été"), (None, "alpha beta"), (None, None), (7, long), (8, "alpha " * 50), (9, "ALPHA_beta"), (10, "Äpfel äpfel")]
    items = [(1, "alpha BETA alpha"), (2, None), (3, ""), (4, "unknown"), (5, "Äpfel été Été"), (6, long[:3000])]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, score int, item_id string, n int").repartition(3)
    asked = spark.createDataFrame([(i, t, "y", 3) for i, t in [*items, (None, "alpha"), (1, "alpha BETA alpha")]], "item_id long, text string, doc_id string, rank int")
    got = [tuple(r) for r in lexical.ranked(df, asked).collect()]
    assert sorted(got, key=repr) == sorted(brute(docs, items), key=repr)
    for d, a in ((df.limit(0), asked), (df, asked.limit(0)), (df.where("doc_id = 2"), asked)):
        assert lexical.ranked(d, a).count() == 0


def test_pair_bounds_skip_more_than_term_bounds(words):
    """On terms that rarely stand together the joint maxima rule out ranges which the terms' own maxima let through."""
    rng = np.random.default_rng(2)
    n, many = 400, 6
    held = rng.random((many, n)) < 0.3
    held[1::2] &= ~held[::2]  # of each pair a document holds one term at most
    impact = rng.integers(100, 900, (many, n))
    place = np.concatenate([np.flatnonzero(h) for h in held])
    values = np.concatenate([i[h] for i, h in zip(impact, held)])
    block = lexical.Block(list(range(n)), np.arange(many), np.cumsum(held.sum(1)), place, values, 4)
    q = lexical.Item(1, list(range(many)), [5] * many, [1] * many)
    lists, scores = lexical.pair_lists(block, [q], 5)
    total = (5 * impact * held).sum(0)
    q.least = int(np.sort(total)[-5])
    by_pair, by_term = lexical.Work(), lexical.Work()
    at, score = lexical.search(block, q, lists, 5, by_pair)
    other = lexical.search(block, q, {(0, 1): None, (2, 3): None, (4, 5): None}, 5, by_term)
    want = sorted((-t, i) for i, t in enumerate(total.tolist()))[:5]
    assert sorted(zip((-score).tolist(), at.tolist())) == want == sorted(zip((-other[1]).tolist(), other[0].tolist()))
    assert by_pair.skipped > by_term.skipped and by_pair.read < by_term.read < by_term.postings * 2
