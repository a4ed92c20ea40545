"""Small documents with every odd case, and columns that clash with the operators' own."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("size", "key", "fp", "first", "n", "cell", "component_id", "_id", "_copy", "_masked", "n_tokens", "c", "p", "label", "_source", "v", "id", "digest", "payload", "n_words", "host", "value")
WORDS = "the of and to in a is that it for on was be with as by this at from or an are not have but all one can had which their said if will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()


def prose(seed: int, n: int = 120) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def odd_rows() -> list[tuple]:
    long = " ".join(prose(k, 400) for k in range(60))
    return [
        (1, prose(1), "en", "a", 10), (2, prose(1), "en", "a", 10), (3, prose(3), "en", "b", 10),
        (4, None, "en", "b", None), (5, "", None, "b", 0), (6, " \t\n ", "en", None, 4), (7, "one two", None, None, 7),
        (8, long, "en", "c", len(long)), (9, prose(9), None, None, 1), (9, prose(9), None, None, 1),
        (None, prose(10), "en", "c", 5), (None, prose(10), "en", "c", 5), (None, None, None, None, None),
        (12, "été œuvre 中文 \U0001F600 naïve " * 30, "fr", "c", 3), (13, "line\nline\nline\n" * 40, "en", "a", 3),
    ]


def documents(spark, rows=None, clash: bool = True):
    df = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA).repartition(3)
    for k, name in enumerate(CLASHING if clash else ()):
        df = df.withColumn(name, F.lit(k))
    return df
