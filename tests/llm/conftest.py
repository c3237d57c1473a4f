import random

import pytest

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
CLASHING = ["rid", "row", "name", "level", "pos", "fp", "n", "a", "b", "words", "keys", "kept", "spans", "p", "digest", "content",
            "salt", "label", "host", "template", "rank", "length", "start", "ids", "lang.x"]


def frame(spark, rows, id_col="doc_id", text_col="text", extra=True):
    """(id, text) rows as a table with columns that clash with inner names."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, f"{id_col} long, {text_col} string")
    for c in CLASHING if extra else []:
        df = df.withColumn(c, F.lit("x"))
    return df


def words(rng, n, size=400):
    return " ".join("".join(rng.choice("bcdfgh") + rng.choice("aeiou") for _ in range(1 + rng.randrange(size) % 4)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Awkward rows: nulls, empty and blank texts, copies, near copies, shared
    passages, a very long text, repeated ids and rows, odd characters."""
    rng = random.Random(7)
    base = [words(rng, 30 + rng.randrange(200)) for _ in range(24)]
    passage = words(rng, 40)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i].replace(" ", "\n", 3)) for i in range(6)]  # equal after deleting white space
    for i in range(6):  # near copies
        w = base[10 + i].split()
        w[len(w) // 2] = "zzz"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, words(rng, 20) + " " + passage + " " + words(rng, 20)) for i in range(6)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (None, None), (None, base[0]), (403, "x"), (404, "!!! ***"), (405, "éà ü 漢字 😀 it's")]
    rows += [(500, "a" * 400), (501, "a" * 400), (502, words(rng, 20000)), (503, base[1] + "<|endoftext|>" + base[2])]
    rows += [(7, base[7]), (7, base[7]), (8, "other text with the same id")]  # repeated rows and ids
    return rows


@pytest.fixture(scope="session")
def df(spark, corpus):
    return frame(spark, corpus).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
