"""Column helpers for ordered work inside one row.

Catalyst has no ``let``: an expression used twice is evaluated twice.  ``bind``
evaluates it once by passing it through a one-element ``transform``.
``running`` is a fold that emits elements as it goes; its two-level buffer
keeps the cost near-linear where a plain ``concat`` accumulator is quadratic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_BUFFER = 256
_SHIFT = 10
_CHUNK = 1 << _SHIFT


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty_array(element: str) -> Column:
    return F.array().cast(f"array<{element}>")


def running(
    items: Column,
    state: Column,
    step: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column],
    element: str,
    tail: Callable[[Column], Column] | None = None,
) -> Column:
    """Fold ``items``; ``emit(state, item)`` gives the array to append each time."""

    def merge(acc: Column, item: Column) -> Column:
        full = F.size(acc["open"]) >= _BUFFER
        return F.struct(
            step(acc["state"], item).alias("state"),
            F.when(full, F.concat(acc["closed"], F.array(acc["open"])))
            .otherwise(acc["closed"])
            .alias("closed"),
            F.concat(
                F.when(full, empty_array(element)).otherwise(acc["open"]),
                emit(acc["state"], item),
            ).alias("open"),
        )

    def finish(acc: Column) -> Column:
        parts = [F.flatten(acc["closed"]), acc["open"]]
        if tail is not None:
            parts.append(tail(acc["state"]))
        return F.concat(*parts)

    zero = F.struct(
        state.alias("state"),
        F.array().cast(f"array<array<{element}>>").alias("closed"),
        empty_array(element).alias("open"),
    )
    return F.aggregate(items, zero, merge, finish)


def chunked(text: Column) -> Column:
    """Fixed-size pieces of a text, so that ``cut`` never walks it from the start."""
    return F.when(F.length(text) <= _CHUNK, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))
    )


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """Characters ``[start, end)`` of the text behind ``chunks``."""
    first = F.shiftright(start, _SHIFT)
    count = F.shiftright(end, _SHIFT) - first + 1
    window = F.array_join(F.slice(chunks, first + 1, count), "")
    return window.substr(start - F.shiftleft(first, _SHIFT) + 1, end - start)
