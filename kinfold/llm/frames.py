"""Tables whose columns may have any name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def positional(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with its columns called c0, c1, ..., and the way back: these columns alone, under their own names."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain, lambda out: out.select(*plain.columns).toDF(*names)


def place(df: DataFrame, name: str) -> str:
    """What :func:`positional` calls the column ``name``."""
    return f"c{df.columns.index(name)}"
