"""Tables with the troubles that every text operator has to stand."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark: SparkSession) -> DataFrame:
    """Null ids and texts, empty and blank texts, repeated rows, ties, no letters, a very long text."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "café", "straße", "the", "of", "ÀB", "x1"]
    rows = [(1, None, "en", "s", 0), (None, "null id", "en", "s", 7), (None, None, None, None, None), (2, "", "en", "s", 0),
            (3, "   \n\t ", "de", "s", 6), (4, "12 34 !!", "fr", None, 8), (5, "one", None, "s", 3), (5, "one", None, "s", 3),
            (6, "same words here in both rows of text", "en", "s", None), (7, "same words here in both rows of text", "en", "t", None),
            (8, " ".join(rng.choice(words) for _ in range(30_000)), "en", "s", None), (9, "é" * 5000, "fr", "s", 5000),
            (10, "日本語のテキスト <|endoftext|> tail", "xx", "s", 30), (11, "a\u0000b ﻿ z\U0001f600", "en", "s", 8)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
