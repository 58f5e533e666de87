"""Functions for SQL text: what a session registers by name."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


def register(spark: SparkSession) -> None:
    """token_set_ratio(a, b), nfkc(s) and the table function entity_mentions(text)."""
    from corpusieve.operators.entities import PATTERNS
    from corpusieve.operators.matching import token_set_ratio

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    @F.pandas_udf(StringType())
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    patterns = {label: p.replace("(?iU)", "(?i)").replace("(?U)", "") for label, p in PATTERNS.items()}

    @F.udtf(returnType="label string, mention string, start int")
    class Mentions:
        def eval(self, text: str):
            import re

            for label, pattern in patterns.items():
                for m in re.finditer(pattern, text or ""):
                    yield label, m[0], m.start()

    spark.udf.register("token_set_ratio", ratio)
    spark.udf.register("nfkc", nfkc)
    spark.udtf.register("entity_mentions", Mentions)
