"""Small tables with awkward rows, stored so that each is a scan of files."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)
#: Names that operators use for columns of their own.
CLASHING = ["_row", "_doc", "size", "kept", "score", "component_id", "group_size", "copy", "rate", "target", "length", "region", "node"]


def stored(df, tmp):
    path = f"{tmp}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def documents(spark, tmp, rows, clashing=False):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    if clashing:
        df = df.withColumns({c: F.lit("mine") for c in CLASHING})
    return stored(df, tmp)


def awkward(long_words=30_000):
    """Nulls, empty and blank texts, repeated rows, a null doc_id, a very long text."""
    return [
        (1, None),
        (2, ""),
        (3, " \t\n\x0b\f\r "),
        (4, "one two three four five six"),
        (4, "one two three four five six"),
        (5, "One  two three\nfour five six"),
        (None, "a row without a name has words too"),
        (6, "x"),
        (7, " ".join(f"w{i}" for i in range(long_words))),
    ]
