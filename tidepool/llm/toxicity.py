"""Counterfactual-regularised toxicity classifier.

A text's features are its distinct words and their beginnings. Spark counts features over a bounded sample of
labelled rows and picks those that speak for toxicity; a logistic regression over them, and over the features of
identity terms, is fitted on that sample.

Every labelled text gives a pair of counterfactuals. Where it names identity groups, each of their terms is
swapped for another of its kind; where it names none, a term is put in, and swapped in the second. Both keep the
text's label in the loss, and the squared changes of the score, from the text to the first and from the first to
the second, are penalised, so that a mere mention of a group moves no score.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.language import held_out
from tidepool.llm.shared import map_batches, table, written

#: Identity terms in English, German, French and Spanish; each group's members are swapped for one another.
IDENTITY_GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"),
    ("transgender", "cisgender"), ("immigrant", "citizen"), ("immigrants", "citizens"),
    ("african", "european", "american"), ("disabled", "abled"), ("young", "old"),
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "jungen"), ("muslime", "christen", "juden", "hindus"),
    ("schwarze", "weiße"), ("schwule", "lesben"), ("ausländer", "einwanderer", "flüchtlinge"), ("türken", "polen"),
    ("femmes", "hommes"), ("femme", "homme"), ("filles", "garçons"), ("musulmans", "chrétiens", "juifs", "hindous"),
    ("noirs", "blancs"), ("homosexuels", "hétérosexuels"), ("immigrés", "réfugiés"), ("arabes", "africains"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niñas", "niños"), ("musulmanes", "cristianos", "judíos", "hindúes"),
    ("negros", "blancos"), ("homosexuales", "heterosexuales"), ("inmigrantes", "refugiados"), ("gitanos", "latinos"),
)
SWAP = {t: g[(i + 1) % len(g)] for g in IDENTITY_GROUPS for i, t in enumerate(g)}
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """most_rows bounds the labelled rows fitted on.

    significance: the log-likelihood ratio (chi-squared with one degree of freedom) that a feature must reach.
    counterfactual: the weight of the penalty on score changes.
    """

    most_rows: int = 50_000
    significance: float = 20.0
    beginnings: tuple[int, ...] = (4, 5, 6, 7)
    l2: float = 1e-4
    counterfactual: float = 1.0
    steps: int = 300


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str, beginnings: tuple[int, ...]) -> list[str]:
    return [word, *["^" + word[:k] for k in beginnings if len(word) > k]]


def _all_features(words: set[str], beginnings: tuple[int, ...]) -> set[str]:
    return {f for w in words for f in features_of(w, beginnings)}


def _count(rows: DataFrame, beginnings: tuple[int, ...], among: set[str] | None = None) -> DataFrame:
    """(feature, n1, n0): texts with the feature among toxic and clean rows, summed in each task first."""

    def run(batches):
        import pyarrow as pa

        seen = [Counter(), Counter()]

        def flush():
            names = list(seen[0].keys() | seen[1].keys())
            out = [pa.array(names, pa.string()), *[pa.array([seen[y][f] for f in names], pa.int64()) for y in (1, 0)]]
            for c in seen:
                c.clear()
            return pa.RecordBatch.from_arrays(out, ["feature", "n1", "n0"])

        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                found = _all_features(words_of(text), beginnings)
                seen[y].update(found if among is None else found & among)
                if len(seen[1]) + len(seen[0]) > 500_000:
                    yield flush()
        yield flush()

    counted = rows.select("text", "toxic").mapInArrow(run, "feature string, n1 long, n0 long")
    return counted.groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


@dataclass(frozen=True)
class Entries:
    """Sparse rows: entry i adds sign[i] times the weight of feature[i] to row[i]."""

    row: np.ndarray
    feature: np.ndarray
    sign: np.ndarray

    def times(self, w: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(self.row, w[self.feature] * self.sign, rows)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.feature, g[self.row] * self.sign, size)


@dataclass(frozen=True)
class Sample:
    """The texts, and what their first and second counterfactuals add to them."""

    y: np.ndarray
    own: Entries
    first: Entries
    second: Entries
    size: int


def loss(w: np.ndarray, data: Sample, s: Settings) -> tuple[float, np.ndarray]:
    """Mean logistic loss over texts and counterfactuals + l2 + penalty, and its gradient; the bias is w's last."""
    n, size = len(data.y), data.size
    z = w[-1] + data.own.times(w, n)
    a, b = data.first.times(w, n), data.second.times(w, n)
    total, errors = 0.0, []
    for v in (z, z + a, z + b):
        v = np.clip(v, -30, 30)
        total += (np.logaddexp(0, v) - data.y * v).sum() / (3 * n)
        errors.append((1 / (1 + np.exp(-v)) - data.y) / (3 * n))
    pull = 2 * s.counterfactual / n
    total += s.l2 / 2 * (w[:-1] ** 2).sum() + s.counterfactual / n * ((a**2).sum() + ((b - a) ** 2).sum())
    every = errors[0] + errors[1] + errors[2]
    g = data.own.back(every, size) + data.first.back(errors[1] + pull * (2 * a - b), size) + data.second.back(errors[2] + pull * (b - a), size)
    return total, np.append(g + s.l2 * w[:-1], every.sum())


def _fit(data: Sample, s: Settings) -> np.ndarray:
    """The weights and, last, the bias, by Adam over the whole sample."""
    w, m, v = np.zeros(data.size + 1), np.zeros(data.size + 1), np.zeros(data.size + 1)
    w[-1] = -2.0
    for step in range(1, s.steps + 1):
        g = loss(w, data, s)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def counterfactuals(words: set[str]) -> tuple[set[str], set[str]]:
    """The words of a text's two counterfactuals. The term put in depends on nothing but the words."""
    if words.isdisjoint(SWAP):
        terms = sorted(SWAP)
        term = terms[crc32(" ".join(sorted(words)).encode("utf-8", "surrogatepass")) % len(terms)]
        return words | {term}, words | {SWAP[term]}
    return words, {SWAP.get(w, w) for w in words}


def evidence(n1: Column, n0: Column, all1: int, all0: int) -> Column:
    """Log-likelihood ratio of a feature held by n1 of all1 toxic and n0 of all0 clean texts."""
    share = (n1 + n0) / (all1 + all0)
    terms = [(n1, all1 * share), (n0, all0 * share), (all1 - n1, all1 * (1 - share)), (all0 - n0, all0 * (1 - share))]
    return 2 * sum(F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in terms)


@dataclass
class Model:
    """Weights by feature, the bias, and how many counterfactual pairs the penalty acted on."""

    weights: dict[str, float]
    bias: float
    pairs: int = 0


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), text: str = "text",
          doc_id: str = "doc_id", toxic: str = "toxic") -> Model:
    """Learns from rows whose crc32(doc_id) mod 5 is not 0, at most settings.most_rows labels in the order of a hash of their id.

    Labels other than 0 and 1 are left out; of several labels for one id the largest counts. Repeated rows of a
    labelled id are learned from each. Without labelled rows of both kinds every text scores the same.
    """
    s = settings
    known = labels.where(F.col(toxic).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.max(toxic).cast("int").alias("toxic"))
    known = known.where(~held_out("_id")).orderBy(F.xxhash64("_id"), "_id").limit(s.most_rows)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    rows = written(rows.join(F.broadcast(known), "_id").select("toxic", "text"), "labelled")  # at most most_rows labels
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model({}, -2.0 if not n1 else 2.0)
    # with fewer toxic texts no feature reaches the significance, even if no clean text has it
    least = s.significance / (2 * np.log((n1 + n0) / n1))
    among = {r["feature"] for r in _count(rows.where("toxic = 1"), s.beginnings).where(F.col("n1") >= least).select("feature").collect()}
    a, b = F.col("n1"), F.col("n0")
    telling = _count(rows, s.beginnings, among).where((a / n1 > b / n0) & (evidence(a, b, n1, n0) >= s.significance))
    names = {r["feature"] for r in telling.select("feature").collect()} | _all_features(set(SWAP), s.beginnings)
    index = {f: i for i, f in enumerate(sorted(names))}

    def find(batches):
        import pyarrow as pa

        def ids(words):
            return {index[f] for f in _all_features(words, s.beginnings) if f in index}

        for batch in batches:
            columns = [[] for _ in range(5)]
            for t in batch.column("text").to_pylist():
                words = words_of(t)
                own, first, second = ids(words), *map(ids, counterfactuals(words))
                for c, v in zip(columns, (own, first - own, own - first, second - own, own - second)):
                    c.append(sorted(v))
            arrays = [batch.column("toxic"), *[pa.array(c, pa.list_(pa.int32())) for c in columns]]
            yield pa.RecordBatch.from_arrays(arrays, ["toxic", "own", "first_in", "first_out", "second_in", "second_out"])

    ddl = "toxic int, own array<int>, first_in array<int>, first_out array<int>, second_in array<int>, second_out array<int>"
    got = rows.mapInArrow(find, ddl).toArrow().combine_chunks()

    def entries(*columns):
        row, feature, sign = [], [], []
        for name, way in columns:
            lists = got.column(name).chunk(0)
            row.append(np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())))
            feature.append(lists.flatten().to_numpy())
            sign.append(np.full(len(feature[-1]), way))
        return Entries(*map(np.concatenate, (row, feature, sign)))

    data = Sample(got.column("toxic").to_numpy(), entries(("own", 1.0)), entries(("first_in", 1.0), ("first_out", -1.0)),
                  entries(("second_in", 1.0), ("second_out", -1.0)), len(index))
    w = _fit(data, s)
    return Model({f: float(w[i]) for f, i in index.items() if w[i]}, float(w[-1]), len(data.y))


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None,
          settings: Settings = Settings(), most_words: int = 300_000) -> DataFrame:
    """docs (or its columns keep) with score, the probability of toxic; null and empty texts score the bias alone.

    A score depends on the text alone, so repeated rows score alike. A column of docs named score is replaced. No
    rows in, no rows out.
    """
    docs, weights, bias = docs.drop("score"), model.weights, model.bias
    keep = docs.columns if keep is None else keep

    def make():
        known: dict[str, tuple[str, ...]] = {}
        none = ()

        def learn(word):
            known[word] = found = tuple(f for f in features_of(word, settings.beginnings) if f in weights) or none
            return found

        def work(batch):
            if len(known) > most_words:
                known.clear()
            out = []
            for t in batch.column(text).to_pylist():
                found = {f for w in words_of(t) for f in (known.get(w) or (none if w in known else learn(w)))}
                z = bias + sum(weights[f] for f in sorted(found))
                out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
            return None, [out]

        return work

    return map_batches(docs.select(*dict.fromkeys([*keep, text])), make, "score double", keep, rows=1000)


def op8_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
