import random

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def small(spark):
    return SMALL


def hard_rows():
    """Texts with every kind of trouble: null, empty, blank, other alphabets, long, copies, near copies, shared passages."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgé漢Z") for _ in range(r.randint(1, 8)))
    base = [word() for _ in range(120)]
    passage = " ".join(word() for _ in range(60))
    texts = [None, "", "   \n\t", "one", "One two  THREE four", "one two three four", "\x1c\x85 odd blanks", "x" * 5000, "a b " * 900, "same line here\n" * 40]
    texts += [" ".join(base), " ".join(base), " ".join(base[:119] + ["q"]), " ".join(base[:60] + ["new"] + base[60:]), " ".join(base).upper()]
    texts += [" ".join([word() for _ in range(r.randint(5, 80))] + [passage] * (i % 3) + [word() for _ in range(r.randint(0, 40))]) for i in range(30)]
    texts += [" ".join(word() for _ in range(6000)) + " " + passage]
    return [(i * 3, t, None if i % 5 == 0 else "xx", None if i % 7 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def hard(spark):
    return spark.createDataFrame(hard_rows(), DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, repeated rows and ids, and columns whose names the operators use inside."""
    rows = [(None, "a b c d e f g", 1), (None, None, 2), (7, "a b c d e f g", 3), (7, "a b c d e f g", 3), (7, "z " * 30, 4), (8, None, 5)]
    names = ["key", "row", "runs", "size", "cell", "n", "votes", "words", "label", "hash"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.LongType())] + [T.StructField(x, T.IntegerType()) for x in names])
    return spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema)
