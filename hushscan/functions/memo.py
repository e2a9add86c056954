"""Reuse of built Columns.

A detection Column is a few thousand JVM calls to build but only depends on the
column name and the options, so it is built once per Spark application.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column

_built: dict[tuple, Column] = {}


def memoised(build: Callable[..., Column]) -> Callable[..., Column]:
    @functools.wraps(build)
    def cached(column: str, *settings) -> Column:
        context = SparkContext._active_spark_context
        key = (build.__qualname__, context.applicationId, column, settings)
        if key not in _built:
            _built[key] = build(column, *settings)
        return _built[key]

    return cached
