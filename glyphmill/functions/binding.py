"""Values that are computed once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a lambda's variable is never expanded again."""
    return F.element_at(F.transform(F.array(value), body), 1)
