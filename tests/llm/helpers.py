"""Small corpora with the awkward cases, and the driver's smallest documents."""

import random

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
#: doc_id, text and columns that clash with the operators' own names.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("lang", T.StringType())])


def corpus(seed=1, n=60):
    """(doc_id, text): prose of a small vocabulary, copies, near copies, null, empty, long and repeated rows."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    line = lambda k: " ".join(rng.choice(words) for _ in range(k)).capitalize() + "."
    rows = []
    for i in range(n):
        rows.append((i, "\n".join(line(rng.randint(1, 25)) for _ in range(rng.randint(1, 6)))))
    for i in range(n, n + 20):  # near copies and copies
        _, text = rows[rng.randrange(n)]
        parts = text.split(" ")
        for _ in range(rng.randint(0, 3)):
            parts[rng.randrange(len(parts))] = rng.choice(words)
        rows.append((i, " ".join(parts)))
    rows += [(900, None), (901, ""), (902, "\n\n \t\n"), (903, "word"), (904, "Word word\nword"), (905, line(3000)), (906, "same line here\n" * 50), (None, rows[0][1]), (None, None)]
    rows += [rows[3], rows[3]]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 5, None) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
