"""Small tables with every awkward row, and plain versions of the operators' results."""

import re

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names the operators use inside.
    T.StructField("id", T.StringType()), T.StructField("kept", T.StringType()), T.StructField("size", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("component", T.StringType()), T.StructField("times", T.StringType()),
])


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, *[None] * (4 - len(r)))
        full.append((doc_id, text, lang, source, None if text is None else len(text), "x", None, "y", None, "z", "w"))
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def thue_morse(n):
    """Two words of ``n`` letters that every polynomial hash modulo 2^64 confuses once ``n`` is 1,024 or more."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


class Union:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        while self.parent.setdefault(x, x) != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.parent[b] = a


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=lambda t: tuple((v is not None, v) for v in t))
