"""Small tables for the operators' tests."""

from __future__ import annotations

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


def edge_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, and columns
    with the names that operators use themselves."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (0, "", "en", "s", 0),
        (1, None, None, None, None),
        (None, "a text without an id but with words of its own here", "en", "s", 3),
        (3, long, "en", "s", len(long)),
        (4, "one two three four five six seven eight nine ten", "en", "s", 48),
        (4, "one two three four five six seven eight nine ten", "en", "s", 48),
        (5, " \n\t\x0b \r\n", "en", None, 7),
        (6, "é▁🙂\u0000 ß\nÉ", None, "s", -1),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("rid", "row", "key", "node", "n", "n_words", "spans", "items", "score", "pieces", "host", "label", "snap", "drop"):
        df = df.withColumn(c, df["source"])
    return df


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def near_copies(seed=0, families=12, size=5, words=60):
    """Texts in families whose members differ in some words, close to the threshold."""
    r = random.Random(seed)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    out = []
    for _ in range(families):
        base = [r.choice(vocabulary) for _ in range(r.randint(6, words))]
        for _ in range(size):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            out.append(" ".join(own))
    r.shuffle(out)
    return out


class Groups:
    def __init__(self, nodes):
        self.up = {x: x for x in nodes}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
