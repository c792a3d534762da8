"""The library's functions for SQL texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> None:
    """Makes ``rrf_score(rank)``, an aggregate, and ``hash_embed(text, dim)`` known to ``spark.sql``.

    ``rrf_score`` is the sum of 1 / (60 + rank) over a hit's lists, null ranks aside; ``hash_embed`` the hashed vector of a text, whose
    dimension is one for all rows.
    """
    from recollect.operators.fusion import RRF_K
    from recollect.operators.vectors import _hash_texts

    @F.pandas_udf("double")
    def rrf_score(rank: pd.Series) -> float:
        return float((1.0 / (RRF_K + rank.dropna())).sum())

    @F.pandas_udf("array<float>")
    def hash_embed(text: pd.Series, dim: pd.Series) -> pd.Series:
        return pd.Series(_hash_texts(text, int(dim.iloc[0])) if len(text) else [])

    spark.udf.register("rrf_score", rrf_score)
    spark.udf.register("hash_embed", hash_embed)
