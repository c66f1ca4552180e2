"""Helpers that keep large expression trees from being copied by the optimiser."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add (or replace) columns so that later filters use their value.

    A filter on an ordinary computed column is pushed below it by inlining the whole expression, again for each
    mention; chains of text rules then grow past what can be compiled.  A one-row generator stops the inlining.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.stack(F.lit(1), *columns.values()).alias(*columns))
