"""Small tables with everything that may be odd in them."""

from __future__ import annotations

import random

from pyspark.sql import functions as F


def random_rows(seed=5, n=150):
    """Texts over small vocabularies, and texts pasted together from others."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        voc = r.choice(["ab", "abcdefgh", ["a", "b b b", "c d", "eé"], [f"w{j}" for j in range(400)]])
        rows.append((i, " ".join(r.choice(voc) for _ in range(r.choice([0, 1, 5, 19, 20, 21, 25, 60, 150])))))
    for i in range(n, n + 60):
        a, b = r.choice(rows[:n])[1], r.choice(rows[:n])[1]
        rows.append((i, a[r.randrange(len(a) + 1) :] + " " + b[: r.randrange(len(b) + 1)]))
    rows += [(500 + i, "x " * r.randrange(80) + "y z " * r.randrange(40)) for i in range(15)]
    return [*rows, (600, None), (601, ""), (602, " \n\t")]


def copies(seed=3):
    """Groups of texts with a few words changed."""
    r = random.Random(seed)
    rows = []
    for _ in range(30):
        base = [r.choice("abcdefghijklmnopqrstuvwxyz") + str(r.randrange(30)) for _ in range(r.choice([1, 2, 3, 8, 12, 13, 30, 120, 300]))]
        for _ in range(r.choice([1, 2, 6, 14])):
            words = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                words[r.randrange(len(words))] = f"Z{r.randrange(99)}"
            rows.append((len(rows) * 7 % 1009, "  ".join(words)))
    return [*rows, (2000, None), (2001, ""), (2002, " \n")]


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def odd_documents(spark):
    """Nulls in every column, repeated rows, a very long text, extra columns with names that operators use inside."""
    prose = "the quick brown fox and the lazy dog went to the old mill by the river for a day of rest "
    rows = [
        (None, prose * 3, None, None, None),
        (1, None, "en", "a", 1),
        (2, "", "en", "a", 0),
        (3, " \n\t", None, "b", 3),
        (4, prose * 8000, "en", "a", 9),
        (5, prose * 2, "en", "a", 5),
        (5, prose * 2, "en", "a", 5),
        (6, "é" * 120 + " \u0000 ñ", "es", None, 7),
        (7, "Released under the MIT License.\n" + prose, "en", "c", 4),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ["id", "start", "end", "n", "spans", "words", "lines", "cell", "node", "packed", "rest", "anchor", "bucket", "weight", "toxic", "quality", "notices"]
    return df.select("*", *[F.lit(i).alias(name) for i, name in enumerate(names)]).repartition(3)


def odd_labels(spark):
    rows = [(5, 1, 0), (5, 1, 0), (None, 1, 1), (7, None, None), (4, 1, 1), (2, 0, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
