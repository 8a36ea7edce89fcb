"""The pipeline against a brute-force version of its stages."""

import re
from collections import Counter

import corpus_pipeline
from tests.llm.test_jaccard import brute
from tests.llm.test_sharding_dedup_packing import check_packing
from tidepool.llm import queries


def expected(rows):
    """(doc_id, text) that reach packing."""
    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    last = {}
    for i, t in kept:
        last[t] = i if t not in last or i is not None and (last[t] is None or i > last[t]) else last[t]
    kept = [(i, t) for i, t in kept if last[t] == i]
    comp = brute({n: t for n, (_, t) in enumerate(kept)})  # five-word shingles, 0.8
    least = {}
    for n, (i, _) in enumerate(kept):
        if i is not None:
            least[comp[n]] = min(i, least.get(comp[n], i))
    kept = [(i, t) for n, (i, t) in enumerate(kept) if least.get(comp[n]) == i]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8,}""", re.I | re.A)
    return [(i, re.sub("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", "[SECRET]", assign.sub("[SECRET]", t))) for i, t in kept]


def test_run(spark, table, words):
    rows = [(i, words(40, i % 35), "en") for i in range(45)] + [(50, None, "en"), (51, "", None), (52, "12 !!", "en")]
    near = words(300, 77).split()
    rows += [(60 + i, " ".join(near[: 7 * i] + ["other"] + near[7 * i + 1 :]), "en") for i in range(5)]
    rows += [(90 + i, words(60, 600) + " " + words(12 + i, 610 + i), "en") for i in range(6)]  # a shared passage, on both sides of 0.8
    rows += [(80, words(20, 500) + ' token = "abcdefgh12345" end', "en"), (81, words(5000, 501), None), (82, words(12, 502) + " AKIAABCDEFGHIJKLMN", "en")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _text string, component_id int, kept string, gram int, _h1 string, ids int, secrets string"
    folder = table(documents=([(i, t, lang, "s", len(t or ""), "x", 1, "x", 2, "x", 3, "x") for i, t, lang in rows], schema))
    want = expected([(i, t) for i, t, _ in rows])
    assert {80, 81, 82} <= {i for i, _ in want} and not {50, 51, 52} & {i for i, _ in want} and len({i for i, _ in want} & set(range(60, 65))) == 1
    got = corpus_pipeline.run(spark, folder).collect()
    check_packing(got, want, 4096)


def test_run_on_odd_tables(spark, table, words):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert corpus_pipeline.run(spark, table(documents=([], schema))).count() == 0
    one, two = words(30, 900), words(30, 901)
    rows = [(None, one, None, None, None), (None, one, None, None, None), (1, two, "en", None, None), (1, two, "en", None, None), (None, None, None, None, None), (2, two, None, "s", 3)]
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, table(documents=(rows, schema))).collect())
    assert got == {None: 2, 2: 1}


def test_stages_keep_the_columns(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert Counter(r["doc_id"] for r in docs.collect())[400] == 1


def test_every_operator_is_registered():
    names = [n for n in queries.QUERIES if n.startswith("op")]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and "pipeline" in corpus_pipeline.QUERIES
