"""Containment of names, digests of sets, tenants and ranked full text."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tidepool.functions.digests import tree_digest
from tidepool.operators import evaluation, recall
from tidepool.operators.containment import contained
from tidepool.sources.tenancy import TenantCatalog, require_scoped, unscoped


def test_contained_equals_all_pairs(spark):
    rng = random.Random(5)
    word = lambda least, most: "".join(rng.choice("abc é中文\n😀") for _ in range(rng.randint(least, most)))
    names = [(i, word(1, 5)) for i in range(150)] + [(200, ""), (201, None), (202, "abc"), (203, "abc"), (204, "(.*")]
    texts = [(i, word(0, 60)) for i in range(80)] + [(100, None), (101, "abcabc (.*"), (102, "")]
    a, b = spark.createDataFrame(names, "name_id long, name string").repartition(3), spark.createDataFrame(texts, "text_id long, text string").repartition(3)
    got = sorted((r["name_id"], r["text_id"]) for r in contained(a, b, "name", "text").collect())
    assert got == sorted((i, j) for i, n in names for j, t in texts if n and t is not None and n in t) and len(got) > 100
    assert contained(a.limit(0), b, "name", "text").count() == 0 == contained(a, b.limit(0), "name", "text").count()


def test_containment_needs_no_nested_loop(spark):
    tags = spark.createDataFrame([(i, f"name {i}") for i in range(150_000)], "tag_id long, normalized_name string")  # more than once could be matched
    docs = spark.createDataFrame([(i, "t", f"this holds name {i * 7} alone") for i in range(50)], "document_id long, title string, content string")
    out = recall.auto_tags(docs, tags, tags.limit(0).select(F.col("tag_id").alias("document_id"), "tag_id"))
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = {(r["document_id"], r["tag_id"]) for r in out.collect()}
    assert found == {(i, t) for i in range(50) for t in {int(str(i * 7)[:n]) for n in range(1, len(str(i * 7)) + 1)}}


def test_runs_travel_without_their_text(spark):
    names = spark.createDataFrame([(1, "abcd"), (2, "xy")], "name_id long, name string")
    texts = spark.createDataFrame([(1, "zabcdz"), (1, "zabcdz"), (2, "xabc"), (3, "wxyz")], "text_id long, text string")
    for own in (names, names.where("name_id = 1")):
        out = contained(own, texts, "name", "text")
        joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "_run#" in x]
        assert joins and not any("text#" in x for x in joins)
    assert sorted((r.name_id, r.text_id) for r in contained(names, texts, "name", "text").collect()) == [(1, 1), (1, 1), (2, 3)]


def digest(ids, leaf):
    ids, n = sorted(set(ids)), len(set(ids))
    depth = sum(n > leaf * 256**k for k in range(3))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def node(path):
        if len(path) == 2 * depth:
            own = [i for i in ids if sha(i).startswith(path)]
            return sha("|".join(own)) if own else None
        parts = [p for b in range(256) if any(sha(i).startswith(path + f"{b:02x}") for i in ids) and (p := node(path + f"{b:02x}"))]
        return sha("|".join(parts))

    return node("")


@pytest.mark.parametrize("leaf", (1, 30, 4096))
def test_tree_digest(spark, leaf):
    rng = random.Random(3)
    groups = {g: [f"id{rng.randrange(10**6)}" for _ in range(n)] for g, n in (("a", 1), ("b", 40), ("c", 300))}
    rows = [(g, i) for g, own in groups.items() for i in own] + [("b", groups["b"][0]), ("b", None), ("d", None)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "g string, i string").repartition(parts)
        got = {r["g"]: r["digest"] for r in tree_digest(df, ["g"], "i", leaf).collect()}
        assert got == {g: digest(own, leaf) for g, own in groups.items()}
    assert leaf > 40 or got["b"] != hashlib.sha256("|".join(sorted(set(groups["b"]))).encode()).hexdigest()


def test_manifest_of_no_cases(spark):
    none = spark.createDataFrame([], "case_id string, question string")
    one = evaluation.manifest(none, {"kb_id": "k"}).first()
    assert one["case_count"] == 0 and one["cases_sha256"] == hashlib.sha256(b"").hexdigest() and one["kb_id"] == "k"


def test_tenants_see_their_own_rows(spark, tmp_path):
    columns = {"notes": "workspace_id", "kbs": "workspace_id"}
    spark.createDataFrame([(w, i) for w in ("x", "y") for i in range(5)], "workspace_id string, n long").write.parquet(f"{tmp_path}/notes.parquet")
    spark.createDataFrame([("x", 3), ("y", 3)], "workspace_id string, n long").write.parquet(f"{tmp_path}/kbs.parquet")
    own = TenantCatalog(spark, str(tmp_path), "x", columns)
    joined = own.table("notes").join(own.table("kbs").select("n"), "n")
    assert {r["workspace_id"] for r in joined.collect()} == {"x"} and unscoped(joined, columns, "x") == []
    assert TenantCatalog(spark, str(tmp_path), None, columns).table("notes").count() == 0
    with pytest.raises(PermissionError):
        TenantCatalog(spark, str(tmp_path), "x", {"notes": "workspace_id"}).table("kbs")
    plain = spark.read.parquet(f"{tmp_path}/kbs.parquet")
    for bad in (own.table("notes").join(plain.select("n"), "n"), plain, plain.where("workspace_id = 'x' OR n = 3"), plain.where("workspace_id = 'y'"),
                own.table("notes").unionByName(plain), plain.where("n = 3")):
        with pytest.raises(PermissionError):
            require_scoped(bad, columns, "x")
    assert require_scoped(plain.where("n = 3 AND workspace_id = 'x'").groupBy("n").count(), columns, "x").count() == 1


def test_full_text_scores_equal_a_loop(spark):
    rng = random.Random(7)
    texts = {f"l{i:02}": " ".join(rng.choice("one two three four five six".split()) for _ in range(rng.randint(1, 25))) for i in range(60)}
    asked = {1: "one Two", 2: "three, one three", 3: "six five four", 4: "seven", 5: "", 6: None}
    chunks = spark.createDataFrame(list(texts.items()), "locator string, content string")
    q = spark.createDataFrame(list(asked.items()), "query_id long, query string")
    want = {}
    for i, query in asked.items():
        terms = set(re.findall(r"\w+", (query or "").lower()))
        for name, text in texts.items():
            at = [(p, w) for p, w in enumerate(text.split()) if w in terms]
            if terms and {w for _, w in at} == terms:
                last, begin, total = {}, None, 0.0
                for k, (p, w) in enumerate(at):
                    last[w] = k
                    if len(last) == len(terms) and (first := min(last.values())) != begin:
                        begin = first
                        total += 0.1 / (1 + max(p - at[first][0] - (k - first), 0))
                want[i, name] = total / (1 + total)
    got = {(r["query_id"], r["locator"]): r["score"] for r in recall.full_text_recall(q, chunks).collect()}
    assert got.keys() == want.keys() and len(got) > 40 and all(got[k] == pytest.approx(want[k]) for k in got)
    top = recall.full_text_recall(q, chunks, 3)
    assert top.groupBy("query_id").count().where("count > 3").isEmpty()
    assert "Python" not in top._jdf.queryExecution().toString()
