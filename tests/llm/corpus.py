"""Small frames with every awkward case, and plain versions of what the operators do."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("id", T.StringType()),  # clashes with names the operators use
        T.StructField("tag", T.StringType()),
        T.StructField("n", T.LongType()),
    ]
)


def texts(seed: int = 5) -> list[tuple]:
    r = random.Random(seed)
    vocabulary = ["alpha", "Beta", "gamma,", "été", "ñandú", "straße", "x", "don't", "漢字", "the", "of", "and", "12", "##", "a.b", "it's"]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    passage, long_text = make(70), make(4000)
    out = [
        (1, make(120)), (2, None), (3, ""), (4, " \t\n"), (5, make(30) + " " + passage + " " + make(20)), (6, passage + "\n" + make(60)), (7, make(300)),
        (9, long_text), (8, long_text + " " + make(10)), (10, "De " * 400), (11, "De " * 300 + make(60)), (13, "a"), (12, "a"), (14, " a "), (15, "A"),
    ]
    base = make(200)
    for k in range(16, 26):
        words = base.split(" ")
        words[r.randrange(200)] = f"edit{k}"
        out.append((k, " ".join(words)))
    out += [(26, base), (27, base.upper()), (28, base.replace(" ", "\n")), (29, base), (29, base), (30, make(55)), (30, make(56)), (None, base), (None, None)]
    out += [(40 + k, make(r.randrange(1, 150))) for k in range(40)]
    r.shuffle(out)
    return out


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "id", "tag", 7) for i, t in rows], SCHEMA).repartition(5)


def rows_of(df, *names):
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)
