"""Ranking formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.5, 0.70
MODELS = ("bm25", "tfidf")


def check_model(model: str) -> str:
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; one of {', '.join(MODELS)}")
    return model


def idf(n_docs: Column, df: Column) -> Column:
    return F.log10(n_docs.cast("double") / df)


def bm25(tf: Column, doc_len: Column, avgdl: Column, weight: Column) -> Column:
    """Term frequency saturated and normalised by length, without the usual factor k1 + 1."""
    return tf / (F.lit(K1) * (F.lit(1 - B) + F.lit(B) * doc_len / avgdl) + tf) * weight


def tfidf(tf: Column, weight: Column) -> Column:
    return (1 + F.log10(tf.cast("double"))) * weight
