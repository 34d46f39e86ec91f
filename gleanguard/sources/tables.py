"""Rows of any table as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def from_table(df: DataFrame, text: str, *keys: str, prefix: str = "") -> DataFrame:
    """(path: prefix and the keys' values parted by slashes, content). Paths have no extension, so file filters pass."""
    return df.select(F.concat(F.lit(f"{prefix}/" if prefix else ""), F.concat_ws("/", *(F.col(k).cast("string") for k in keys))).alias("path"), F.col(text).alias("content"))
