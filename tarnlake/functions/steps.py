"""Columns in steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def step(df: DataFrame, kept: list[str], **columns: Column) -> DataFrame:
    """The kept columns of df and new ones, each worked out once: what generates rows is not merged with what reads them, nor are filters pushed below it."""
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
