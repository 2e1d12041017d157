"""Small tables with every awkward row: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def table(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en" if i is None or i % 3 else None, "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def awkward(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    texts = [None, "", " \n\t ", "one", "one two three four five six", "one two three four five six", long, "A\nb\nA\n", "ñandú é x", "x" * 5000]
    return table(spark, [*texts, "same row", "same row", "no id"], [*range(len(texts)), 50, 50, None])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(df, *names):
    from pyspark.sql import functions as F

    for n in names:
        df = df.withColumn(n, F.lit("clash"))
    return df
