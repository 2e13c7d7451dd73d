from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls in every column, empty and very long texts, repeated rows."""
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n\t ", None, "s", 4), (4, "word " * 40_000, "en", None, 200_000), (5, "same text here", "en", "s", 14), (5, "same text here", "en", "s", 14), (6, "same text here", "en", "s", 14), (7, "ünïcode 日本語 \x00 end", "en", "s", 9)]
    return spark.createDataFrame(rows, DOCS)


def clashing(frame, *names):
    """The frame with further columns of names that operators use themselves."""
    from pyspark.sql import functions as F

    for name in names:
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


def prose(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n)]
