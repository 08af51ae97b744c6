"""Arrow UDFs that are made when they are used, so that modules import on workers as well."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(return_type: str) -> Callable[[Callable], Callable[..., Column]]:
    def decorate(fn: Callable) -> Callable[..., Column]:
        @wraps(fn)
        def apply(*columns) -> Column:
            return F.pandas_udf(fn, return_type)(*columns)
        return apply
    return decorate
