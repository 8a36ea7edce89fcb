import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import language, licenses, toxicity


def test_trigrams_count_letters_between_boundaries():
    [(owner, code)] = language.trigrams(["Ab, c", None, "é1x", ""])
    spelled = [(int(o), "".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0)).replace("\0", "_")) for o, c in zip(owner, code.tolist())]
    assert spelled == [(0, "_ab"), (0, "ab_"), (0, "_c_"), (2, "_é_"), (2, "_x_")]


@pytest.mark.parametrize("n", [5, 3000])
def test_bundles_equal_a_plain_sum(words, n):
    texts = [words(n, 3), None, words(7, 4), "中文 字"]
    want = np.zeros((4, 64))
    for i, t in enumerate(texts):
        padded = "".join(c if c.isalpha() else "\0" for c in f" {(t or '').lower()} ")
        for j in range(1, len(padded) - 1):
            if padded[j] != "\0":
                code = sum(ord(c) << s for c, s in zip(padded[j - 1 : j + 2], (42, 21, 0)))
                want[i] += language.bind(np.array([code]), 64, 7)[0]
    got = np.zeros((4, 64))
    for owner, code in language.trigrams(texts, block=n):
        owners, sums = language.bundle(owner, code, 64, 7)
        got[owners] += sums
    assert (got == want).all()


SYLLABLES = {"en": ["the", "th", "ing", "er", "and", "of", "tion"], "de": ["sch", "ein", "ung", "der", "ich", "keit"], "fr": ["eau", "oi", "é", "ment", "que", "aux"]}


def sentences(lang, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages_are_told_apart(spark, table):
    rows = [(i, sentences(lang, 30, i), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "12 !", "fr"), (1003, sentences("de", 9000, 1), None)]
    folder = table(documents=(rows, "doc_id long, text string, lang string"))
    out = {r["doc_id"]: r for r in language.op3_hyperdimensional_language(spark, folder).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out.values())
    right = [out[i]["lang_pred"] == lang for i, _, lang in rows[:180] if out[i]["held_out"]]
    assert len(right) > 20 and sum(right) / len(right) > 0.97
    assert [out[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())


def test_language_of_odd_rows(odd, odd_docs, empty):
    out = language.identify(odd)
    assert out.count() == len(odd_docs) and {"lang_pred", "score", "kept"} <= set(out.columns)
    assert {r["lang_pred"] for r in out.collect()} <= {"und", "en"}
    assert language.identify(empty).count() == 0


TOXIC = ["idiot", "scumbag", "worthless"]


def labelled(words, n=600):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        text = words(rng.randint(5, 60), i) + (" " + rng.choice(TOXIC) if toxic else "")
        docs.append((i, text.upper() if i % 50 == 0 else text))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity(spark, table, words):
    docs, labels = labelled(words)
    docs += [(9000, None), (9001, ""), (9002, words(20000, 5) + " idiot"), (0, docs[0][1])]
    labels += [(1, None), (2, 7), (None, 1), (0, 1)]
    folder = table(documents=(docs, "doc_id long, text string"), labels=(labels, "doc_id long, toxic int"))
    out = toxicity.op8_counterfactual_toxicity(spark, folder).collect()
    assert len(out) == len(docs)
    for r in out:
        assert r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1
        if r["doc_id"] < 600:
            assert r["predicted"] == (r["doc_id"] % 6 == 0)
    by = {r["doc_id"]: r for r in out}
    assert by[9000]["predicted"] == by[9001]["predicted"] == 0 and by[9002]["predicted"] == 1


def test_counterfactuals_free_identity_terms(spark, words):
    """A group that the labelled toxic texts often name gets a weight, unless score changes under swaps are penalised."""
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        docs.append((i, words(12, i) + (" muslims " + "idiot" * (i % 8 == 0) if toxic else "")))
        labels.append((i, int(toxic)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    biased = toxicity.train(d, lab, toxicity.Settings(counterfactual=0.0))
    fair = toxicity.train(d, lab, toxicity.Settings(counterfactual=5.0))
    gap = lambda m: m.weights["muslims"] - m.weights["christians"]
    assert gap(biased) > 0.2 and abs(gap(fair)) < 0.3 * gap(biased) and fair.weights["idiot"] > 0.5
    neutral = spark.createDataFrame([(1, "the muslims of the town"), (2, "idiot")], "doc_id long, text string")
    flagged = lambda m: {r["doc_id"]: r["score"] for r in toxicity.score(neutral, m).collect()}
    assert flagged(fair)[1] < 0.5 < flagged(fair)[2] and flagged(fair)[1] < flagged(biased)[1]


def test_the_penalty_acts_in_the_registered_query(spark):
    """At sf0.01 every labelled training text gives a pair, and with the penalty a mention moves scores less."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    free, held = toxicity.train(docs, labels, toxicity.Settings(counterfactual=0.0)), toxicity.train(docs, labels)
    known = {r[0] for r in labels.where("toxic IN (0, 1)").select("doc_id").collect()}
    learned = [r[0] for r in docs.select("doc_id").collect() if r[0] in known and zlib.crc32(str(r[0]).encode()) % 5]
    assert held.pairs == free.pairs == len(learned) > 0
    terms = sorted(toxicity.SWAP)

    def move(m):
        total = lambda w: sum(m.weights.get(f, 0.0) for f in toxicity.features_of(w, (4, 5, 6, 7)))
        return sum((total(t) - total(toxicity.SWAP[t])) ** 2 + total(t) ** 2 for t in terms)

    assert 0 < move(held) < 0.5 * move(free)
    got = {r["doc_id"]: r["score"] for r in toxicity.op8_counterfactual_toxicity(spark, folder).collect()}
    for r in docs.collect():  # brute force: the words' features, one by one
        found = {f for w in toxicity.words_of(r["text"]) for f in toxicity.features_of(w, (4, 5, 6, 7))}
        want = 1 / (1 + np.exp(-(held.bias + sum(held.weights.get(f, 0.0) for f in found))))
        assert abs(got[r["doc_id"]] - want) < 1e-6


def test_gradient_of_the_loss():
    rng, n, size = np.random.default_rng(3), 9, 6

    def entries(sign):
        row, feature = np.nonzero(rng.random((n, size)) < 0.4)
        return toxicity.Entries(row, feature, rng.choice(sign, len(row)))

    data = toxicity.Sample(rng.integers(0, 2, n), entries([1.0]), entries([1.0, -1.0]), entries([1.0, -1.0]), size)
    s, w = toxicity.Settings(l2=0.1, counterfactual=0.7), rng.normal(size=size + 1)
    x, a, b = (np.zeros((n, size)) for _ in range(3))
    for m, e in ((x, data.own), (a, data.first), (b, data.second)):
        m[e.row, e.feature] = e.sign
    plain = 0.0
    for m in (x, x + a, x + b):
        p = 1 / (1 + np.exp(-(m @ w[:-1] + w[-1])))
        plain -= np.where(data.y == 1, np.log(p), np.log(1 - p)).sum() / (3 * n)
    plain += 0.05 * (w[:-1] ** 2).sum() + 0.7 * (((a @ w[:-1]) ** 2).mean() + (((b - a) @ w[:-1]) ** 2).mean())
    total, g = toxicity.loss(w, data, s)
    assert abs(total - plain) < 1e-12
    for i in range(size + 1):
        step = np.eye(size + 1)[i] * 1e-6
        assert abs((toxicity.loss(w + step, data, s)[0] - toxicity.loss(w - step, data, s)[0]) / 2e-6 - g[i]) < 1e-6


def test_toxicity_of_odd_rows(spark, empty, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, none)
    assert model == toxicity.Model({}, -2.0) and toxicity.train(empty, none) == model
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(empty, model).count() == 0
    all_toxic = spark.createDataFrame([(i, 1) for i in range(300, 340)], "doc_id long, toxic int")
    assert toxicity.train(odd, all_toxic) == toxicity.Model({}, 2.0)
    mixed = spark.createDataFrame([(i, i % 2) for i in range(300, 340)], "doc_id long, toxic int")
    scores = toxicity.score(odd, toxicity.train(odd, mixed)).groupBy("text").agg(F.countDistinct("score").alias("n")).collect()
    assert {r["n"] for r in scores} == {1}  # repeated rows and copies score alike


@pytest.mark.parametrize("text, accepted", [
    ("a d z e", True), ("a b c q d x y e", True), ("a q q q d z e", False), ("a b d z e", True), ("a d x e", False), ("k a d z e", False), ("a d z", False),
])
def test_templates(text, accepted):
    made = licenses.compile_template("t", "a [[b c]] {{2}} d {{x y|z}} e")
    assert (made.accepts_from(text.encode().split(), 0) is not None) == accepted


def test_nested_optional_region():
    made = licenses.compile_template("t", "[[copyright {{6}}]] all rights [[are [[all]]]] reserved")
    assert made.mandatory == {b"all", b"rights", b"reserved"}
    for text, end in (("all rights reserved", 3), ("copyright 2020 me all rights are all reserved", 8)):
        assert made.accepts_from(text.encode().split(), 0) == end


MIT = """The MIT License (MIT)

Copyright (c) 2020 Some Body and others

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#     http://www.apache.org/licenses/LICENSE-2.0
# Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
# WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
# under the License."""


def test_whole_licenses(spark):
    texts = [MIT, "// code\n" + MIT.replace("Some Body", "X").replace("The MIT License (MIT)", ""), MIT.replace("without restriction", "with restrictions"),
             APACHE, APACHE.replace("either express", "neither express"), "all rights reserved"]
    out = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")).collect()
    labels = {r["doc_id"]: {m["label"] for m in r["license_matches"]} for r in out}
    assert labels == {0: {"mit-text"}, 1: {"mit-text"}, 2: set(), 3: {"apache-2.0", "apache-2.0-notice"}, 4: {"apache-2.0"}, 5: set()}


@pytest.mark.parametrize("label, template", licenses.TEMPLATES)
def test_every_template_accepts_its_own_wording(label, template):
    def spell(sequence, rich):
        for part in sequence:
            if isinstance(part, str):
                yield part
            elif isinstance(part, list):
                yield from spell(part, rich) if rich else ()
            elif isinstance(part, tuple):
                yield from part[-1 if rich else 0]
            else:
                yield from ["name"] * (part if rich else 0)

    made = licenses.compile_template(label, template)
    for rich in (False, True):
        words = [w.encode() for w in spell(licenses.parts(template), rich)]
        assert made.accepts_from(words, 0) is not None and made.mandatory <= set(words)
        assert re.match(licenses.as_regex(licenses.parts(template)) + "( |$)", b" ".join([b"", *words]).decode())


def test_license_words_and_places(spark, table):
    texts = ["Released under the MIT License.", "MIT-license; mit LICENSE mit license", None, "", "Licensed under the Apache License, Version 2.0.",
             "the GNU General Public License, version 3", "This is licensed under the GNU General Public License, version 3.", "Ünïcode wörd É mit\x00license", "x " * 30000 + "mit license"]
    folder = table(documents=([(i, t) for i, t in enumerate(texts)] + [(1, texts[1])], "doc_id long, text string"))
    rows = licenses.op7_license_templates(spark, folder).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), texts[r["doc_id"]] or "")
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)
        at = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    labels = {r["doc_id"]: r["labels"] for r in rows}
    assert labels[4] == "apache,apache-2.0" and labels[5] == "gpl" and labels[6] == "gpl,gpl-3.0"


def test_licenses_of_odd_rows(odd, odd_docs, empty):
    out = licenses.scan_licenses(odd)
    assert out.count() == len(odd_docs) and "kept" in out.columns
    assert licenses.scan_licenses(empty).count() == 0
