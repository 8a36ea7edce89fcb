"""Near copies against all pairs of five-word shingle sets."""

import random

import corpus_pipeline
from tests.llm.test_secrets_simhash_neighbours import partition
from tidepool.llm import jaccard


def shingles(text, words=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and (5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def corpus(words):
    """Copies with 1 to 8 changed words around the limit, chains of them, one text in many, and short texts."""
    rng = random.Random(4)
    texts = []
    for g in range(60):
        own = words(rng.choice((30, 90, 150)), 1000 + g).split()
        texts.append(" ".join(own))
        for _ in range(rng.choice((1, 1, 2, 6))):
            own = list(own) if rng.random() < 0.5 else texts[-1].split()
            for _ in range(rng.randint(1, 4)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(1000)}"
            texts.append(" ".join(own))
    common = words(60, 5)
    texts += [f"{common} {words(20, 2000 + i)}" for i in range(60)] + [f"{common} {words(5, 2100 + i)}" for i in range(20)]
    texts += ["A b c", "a  B c", "a b d", "one", "a b c d e f", "a b c d e"]
    texts += [" ".join(f"k{i}" for i in range(13)), " ".join([*(f"k{i}" for i in range(12)), "x"]), " ".join(f"k{i}" for i in range(12))]  # 9 of 9, 8 of 10, 8 of 9
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_all_pairs_at_the_limit_are_found(spark, words, monkeypatch):
    texts = corpus(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    want = brute(texts)
    assert 60 < len(set(want.values())) < len(texts)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(docs).collect()} == want
    # the rule alone, without any help of SimHash's or of neighbours, in another order of shingles
    monkeypatch.setattr(jaccard, "frequent", lambda texts, words: jaccard.shingler(words)(" ".join(t["text"] for t in docs.limit(40).collect())))
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(docs).collect()}
    assert partition(found) == partition(want)


def test_one_shingle_in_all_texts(spark, words, monkeypatch):
    """A passage that every text holds is dealt out in parts and bands; no order of shingles keeps it out of the prefixes here."""
    rng, common = random.Random(6), words(8, 3)
    texts = {}
    for i in range(240):
        own = words(rng.choice((6, 9, 14, 30)), 5000 + i // 2).split()
        if i % 2 and rng.random() < 0.5:
            own[rng.randrange(len(own))] = "other"
        texts[i] = f"{common} {' '.join(own)}"
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(jaccard, "frequent", lambda texts, words: jaccard.shingler(words)(" ".join(common.split())) * 0)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(docs, part_rows=16).collect()}
    want = brute(texts)
    assert found == want and len(set(want.values())) > 100


def test_sequences_of_words_are_told_by_two_hashes(spark):
    rows = [(1, "a b"), (2, "A  B"), (3, "a c"), (4, None), (5, "")]
    out = {r["doc_id"]: (r["_h1"], r["_h2"]) for r in jaccard._marked(spark.createDataFrame(rows, "doc_id long, text string"), "text", ["doc_id"], 5).collect()}
    assert out[1] == out[2] != out[3] and out[4] == out[5] and len({h for pair in out.values() for h in pair}) == 6


def test_stage_drops_copies_that_fingerprints_miss(spark, words):
    texts = corpus(words)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == set(brute(texts).values())


def test_odd_rows(odd, odd_docs, empty):
    out = jaccard.near_copies(odd)
    assert out.count() == len(odd_docs) and set(out.columns) == set(odd.columns)
    assert jaccard.near_copies(empty).count() == 0


def test_a_large_group_is_joined_by_texts_in_its_middle(spark, words, monkeypatch):
    """Variants of one text: its first pairs leave many apart that a text with few changes joins, before all are compared."""
    rng, base = random.Random(8), words(150, 9000).split()
    texts = {}
    for i in range(240):
        own = list(base)
        for at in rng.sample(range(len(own)), rng.choice((1, 1, 2, 2, 3, 5))):
            own[at] = f"v{rng.randrange(10**6)}"
        texts[i] = " ".join(own)
    tried, verify = [], jaccard.verify

    def counted(pairs, *more):
        tried.append(pairs.count())
        return verify(pairs, *more)

    monkeypatch.setattr(jaccard, "verify", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_copies(docs).collect()}
    want = brute(texts)
    assert found == want and 60 < max(list(want.values()).count(c) for c in set(want.values())) < 240
    assert sum(tried) < 5500  # 6734 when all that the first pairs had left apart was compared
