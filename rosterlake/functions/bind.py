"""Values that an expression uses several times, computed once a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` isn't repeated for each time that ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]
