"""Columns computed once, however often they are used further up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    """Adds or replaces columns (or SQL expressions) behind a one-row generator.

    Neighbouring projections are merged and a costly column is then copied into
    every use of it. A generator between them keeps one evaluation, and keeps the
    generated code of wide config tables within the JVM's method size.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.struct(
        *[
            (F.expr(column) if isinstance(column, str) else column).alias(name)
            for name, column in columns.items()
        ]
    )
    return df.select(*kept, F.inline(F.array(made)))
