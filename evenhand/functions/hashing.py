"""Repeatable pseudo-random numbers derived from md5, usable in any SQL engine.

A value depends only on its key, so a recomputed task (a lost executor, a second scan)
draws the same numbers again; ``rand()`` would not.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

_RANGE = 16777216.0  # 6 hex digits


def uniform(key: Column, salt: str) -> Column:
    """Uniform in [0, 1) from md5(key-salt)."""
    digest = F.md5(F.concat(key.cast("string"), F.lit("-" + salt)))
    return F.conv(F.substring(digest, 1, 6), 16, 10).cast("double") / F.lit(_RANGE)


def uniform_sql(key: str, salt: str) -> str:
    """:func:`uniform` as a SQL expression: one parse instead of a call per function."""
    return f"(cast(conv(substring(md5(concat(cast({key} AS string), '-{salt}')), 1, 6), 16, 10) AS double) / {_RANGE}D)"


def uniform_py(text: str) -> float:
    """The same number for a plain Python string (used for plan-time literals)."""
    return int(hashlib.md5(text.encode()).hexdigest()[:6], 16) / _RANGE
