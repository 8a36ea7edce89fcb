import random

import pytest


@pytest.fixture(scope="session")
def table(spark, tmp_path_factory):
    """table(**{name: (rows, schema)}) -> a folder with these tables as parquet."""

    def make(**tables):
        path = str(tmp_path_factory.mktemp("tables"))
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/{name}.parquet")
        return path

    return make


#: Columns of other operators' results among them, and a column of every type to carry along.
DOCS = ("doc_id long, text string, lang string, source string, n_chars long, size int, shard string, slot double, kept string, fp string, ids int, "
        "piece string, secrets int, lang_pred int, score string, license_words string, component_id string, length string")


def doc(i, text, lang="en"):
    return (i, text, lang, "s", None if text is None else len(text), 1, "x", 0.5, "x", "x", 1, "x", 1, 1, "x", "x", "x", "x")


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(2, 7))) for _ in range(400)]

    def make(n, seed):
        own = random.Random(seed)
        return " ".join(own.choice(stems) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_docs(words):
    """Null and empty texts, very long ones, ties, repeated rows, a null id and lang, copies and near copies."""
    base = words(120, 1)
    rows = [doc(1, None), doc(2, ""), doc(3, None, None), doc(None, "no id here at all"), doc(5, words(30000, 2)), doc(6, "1 2 3 !!"), doc(7, "a")]
    rows += [doc(100 + i, base) for i in range(60)] + [doc(200, base + " extra"), doc(200, base + " extra")]
    rows += [doc(300 + i, words(40 + i, 50 + i), None if i % 9 == 0 else "en") for i in range(60)]
    rows += [doc(400, "token = \"abcdefgh12345\" and AKIAABCDEFGHIJKLMN"), doc(401, "É ñ 中文 😀 <|endoftext|> it's 12")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_docs):
    return spark.createDataFrame(odd_docs, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
