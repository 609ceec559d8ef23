"""Cached tables that lazy results start from, until the caller has read these.  Each thread has its own."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame

_own = threading.local()


def _kept() -> list[DataFrame]:
    if not hasattr(_own, "tables"):
        _own.tables = []
    return _own.tables


def keep(df: DataFrame) -> DataFrame:
    """Caches the table and remembers it."""
    out = df.persist()
    _kept().append(out)
    return out


def release() -> int:
    """Frees every table that ``keep`` has cached in this thread; returns how many.  Results that start from them still work, but compute them anew."""
    tables = _kept()
    n = len(tables)
    while tables:
        tables.pop().unpersist()
    return n
