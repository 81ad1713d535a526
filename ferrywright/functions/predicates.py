"""Small builders of boolean columns."""

from __future__ import annotations

import datetime
from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def conjunction(tests: Iterable[Column]) -> Column:
    tests = list(tests)
    return reduce(Column.__and__, tests) if tests else F.lit(True)


def disjunction(tests: Iterable[Column]) -> Column:
    tests = list(tests)
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def all_present(names: Iterable[str]) -> Column:
    return conjunction(F.col(n).isNotNull() for n in names)


def literal(value: Any, dtype: T.DataType) -> Column:
    """A collected value as a literal of the column type it came from."""
    if isinstance(dtype, T.TimestampNTZType) and isinstance(value, datetime.datetime):
        # As a timestamp it would pass through the time zone of the Python process.
        value = value.isoformat(sep=" ")
    return F.lit(value).cast(dtype)
