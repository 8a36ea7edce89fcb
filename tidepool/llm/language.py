"""Language ID with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. A trigram's vector binds its letters:
the element-wise product of the first letter's vector rotated twice, the second's rotated once and the third's.
A text's vector bundles (sums) its trigrams' vectors, a language's prototype bundles those of all its training
texts, and a text takes the language whose prototype has the largest cosine with it.

A bundle is linear in trigram counts, so training sums counts per language and trigram in Spark and binds each
trigram once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.shared import map_batches, table

UNKNOWN = "und"
_PLACE = 21  # bits of a code point


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


@lru_cache(maxsize=100_000)
def _letter_vector(point: int, dims: int, seed: int) -> np.ndarray:
    """Word boundaries (0) have a vector of their own, like letters."""
    return np.random.default_rng([seed, point]).integers(0, 2, dims, np.int8) * np.int8(2) - np.int8(1)


def bind(codes: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """Vectors of trigrams given as packed code points."""
    first, second, third = (codes >> s & (1 << _PLACE) - 1 for s in (2 * _PLACE, _PLACE, 0))
    out = np.ones((len(codes), dims), np.int8)
    for turns, points in ((2, first), (1, second), (0, third)):
        own, at = np.unique(points, return_inverse=True)
        vectors = np.stack([np.roll(_letter_vector(p, dims, seed), turns) for p in own.tolist()])
        out *= vectors[at]
    return out


def trigrams(texts: list[str | None], block: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, packed trigram) of every letter with its neighbours, so many characters at a time.

    Characters that are no letters, and the ends of a text, are boundaries.
    """
    lowered = [(t or "").lower() for t in texts]
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    joined = " ".join(["", *lowered, ""])
    for at in range(1, len(joined) - 1, block):
        part = joined[at - 1 : at + block + 1]
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = np.where(_letters()[points], points, 0).astype(np.int64)
        middle = np.flatnonzero(points[1:-1]) + 1
        code = points[middle - 1] << 2 * _PLACE | points[middle] << _PLACE | points[middle + 1]
        yield np.searchsorted(ends, middle + (at - 2), side="right"), code


def grouped(owner: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes, and counts of (owner, index of the code) as three arrays."""
    used, short = np.unique(code, return_inverse=True) if len(code) < 1000 else _short(code)
    key = owner * len(used) + short
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    return used, key[first] // max(1, len(used)), key[first] % max(1, len(used)), n


def _short(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As np.unique with inverse, by letters first: cheap while the letters in use are few."""
    parts = [code >> s & (1 << _PLACE) - 1 for s in (2 * _PLACE, _PLACE, 0)]
    mark = np.zeros(0x110000, np.int64)
    for p in parts:
        mark[p] = 1
    letters = np.flatnonzero(mark)
    if len(letters) > 200:
        return np.unique(code, return_inverse=True)
    mark[letters] = np.arange(len(letters))
    local = (mark[parts[0]] * len(letters) + mark[parts[1]]) * len(letters) + mark[parts[2]]
    seen = np.zeros(len(letters) ** 3, np.int64)
    seen[local] = 1
    used = np.flatnonzero(seen)
    seen[used] = np.arange(len(used))
    a, b, c = letters[used // len(letters) ** 2], letters[used // len(letters) % len(letters)], letters[used % len(letters)]
    return a << 2 * _PLACE | b << _PLACE | c, seen[local]


def bundle(owner: np.ndarray, code: np.ndarray, dims: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The owners in order, and for each the sum of its bound trigrams; memory is bounded by blocks of trigrams."""
    used, who, short, n = grouped(owner, code)
    owners, owner = np.unique(who, return_inverse=True)
    rows = len(owners)
    out = np.zeros((rows, dims), np.float32)
    order = np.argsort(short, kind="stable")
    owner, short, n = owner[order], short[order], n[order]
    for at in range(0, len(used), 8192):
        a, b = np.searchsorted(short, (at, at + 8192))
        counts = np.zeros((rows, min(8192, len(used) - at)), np.float32)
        counts[owner[a:b], short[a:b] - at] = n[a:b]
        out += counts @ bind(used[at : at + 8192], dims, seed).astype(np.float32)
    return owners, out


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", dims: int = 1024, seed: int = 7) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their prototypes. What comes to the driver is languages * dims numbers."""

    def count(batches):
        import pyarrow as pa

        seen: dict[tuple[str, int], int] = {}

        def flush():
            names, codes, n = [k[0] for k in seen], [k[1] for k in seen], list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["lang", "code", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                langs = np.array(part.column("lang").to_pylist(), object)
                names, label = np.unique(langs.astype(str), return_inverse=True)
                for owner, code in trigrams(part.column("text").to_pylist()):
                    used, who, short, n = grouped(label[owner], code)
                    for k, c, m in zip(names[who].tolist(), used[short].tolist(), n.tolist()):
                        seen[k, c] = seen.get((k, c), 0) + m
                    if len(seen) > 300_000:
                        yield flush()
        yield flush()

    def spell(batches):
        import pyarrow as pa

        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, who = np.unique(np.array(batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            codes, n = batch.column("code").to_numpy(), batch.column("n").to_numpy()
            for at in range(0, len(codes), 8192):
                vectors = bind(codes[at : at + 8192], dims, seed).astype(np.float64)
                for i, name in enumerate(names.tolist()):
                    own = n[at : at + 8192] * (who[at : at + 8192] == i)
                    sums[name] = sums.get(name, 0) + (own @ vectors).astype(np.int64)
        for name, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * dims, pa.string()), pa.array(range(dims), pa.int32()), pa.array(v)], ["lang", "dim", "v"])

    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = known.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    sums = counts.mapInArrow(spell, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v")).collect()
    langs = sorted({r["lang"] for r in sums})
    prototypes = np.zeros((len(langs), dims))
    for r in sums:
        prototypes[langs.index(r["lang"]), r["dim"]] = r["v"]
    return langs, prototypes


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, text: str = "text",
            keep: list[str] | None = None, dims: int = 1024, seed: int = 7) -> DataFrame:
    """docs (or its columns keep) with lang_pred and score, the cosine (0 where it is negative).

    `und` with score 0 where a text is null or has no letter, or where no language was learned. Of equal cosines
    the first language in sorted order wins. Columns of docs named lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    keep = docs.columns if keep is None else keep
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    unit = unit.astype(np.float32)

    def make():
        def work(batch):
            texts = batch.column(text).to_pylist()
            if not langs:
                return None, [[UNKNOWN] * len(texts), [0.0] * len(texts)]
            vectors = np.zeros((len(texts), dims), np.float32)
            lettered = np.zeros(len(texts), bool)
            for owner, code in trigrams(texts):
                owners, sums = bundle(owner, code, dims, seed)
                vectors[owners] += sums
                lettered[owners] = True
            norm = np.linalg.norm(vectors, axis=1, keepdims=True)
            cosine = (vectors @ unit.T) / np.maximum(norm, 1e-12)
            best = cosine.argmax(1)
            top = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
            return None, [
                [langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())],
                [float(s) if ok else 0.0 for s, ok in zip(top.tolist(), lettered.tolist())],
            ]

        return work

    return map_batches(docs.select(*dict.fromkeys([*keep, text])), make, "lang_pred string, score double", keep, rows=500)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
             keep: list[str] | None = None, dims: int = 1024, seed: int = 7) -> DataFrame:
    """Learns from the rows with a language whose crc32(doc_id) mod 5 is not 0, and predicts every row.

    Rows with a null doc_id are neither learned from nor held out. No rows in, no rows out.
    """
    teach = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0
    langs, prototypes = train(docs.where(teach), text, lang, dims, seed)
    return predict(docs, langs, prototypes, text, keep, dims, seed)


def op3_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
