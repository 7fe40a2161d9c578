import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def corpus(n=60, seed=1):
    """Random texts with copies, near copies, shared passages, nulls, blanks and a very long text."""
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=r.randint(1, 6))) for _ in range(400)]
    make = lambda k: " ".join(r.choices(words, k=k))
    passage, texts = make(25), []
    for i in range(n):
        kind = i % 10
        if kind == 3 and texts:
            texts.append(r.choice(texts))
        elif kind == 4 and texts:
            w = (r.choice(texts) or "x").split(" ")
            w[r.randrange(len(w))] = "edited"
            texts.append(" ".join(w))
        elif kind == 5:
            texts.append(make(r.randint(0, 30)) + "\n" + passage + "\t" + make(r.randint(0, 30)))
        else:
            texts.append(make(r.randint(1, 120)))
    texts += [None, "", "   \n", "Ünï çödé ÀB", "word", make(30_000), "same same same " * 40]
    rows = [(i, t, ["en", "de", None][i % 3], ["hot", "hot", "a", "b", None][i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, repeated rows and columns named like the operators' own."""
    from pyspark.sql import functions as F

    base = [(1, "one two three", "en", "a", 13), (1, "one two three", "en", "a", 13), (None, "four five six seven", None, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(base, DOCS)
    for c in ("fp", "shard", "slot", "score", "rank", "copies", "place", "block", "rest", "kept", "cell", "root", "label", "queue", "media"):
        frame = frame.withColumn(c, F.lit("clash"))
    return frame
