"""Keyed stream state that joins fragments into lines before they are redacted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hushscan.operators.lines import MAX_BUFFERED

_OUTPUT = "stream_id string, ord long, line string"
_STATE = "buffer string, ord long"


def reassemble_lines(
    chunks: DataFrame,
    stream_id: str = "stream_id",
    seq: str = "seq",
    fragment: str = "fragment",
    flush: str | None = None,
    cap: int = MAX_BUFFERED,
    idle: str | None = None,
) -> DataFrame:
    """Lines released per stream: at ``\\n``, on a flush flag, past ``cap`` or after ``idle``.

    ``ord`` numbers the lines of a stream in release order.  The state per
    stream is the waiting text, which ``cap`` bounds.  ``idle`` (milliseconds)
    releases a partial line after a quiet period.
    """
    names = {stream_id: "stream_id", seq: "seq", fragment: "fragment"}
    quiet = int(idle) if idle else None

    def release(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, number = state.get if state.exists else ("", 0)
        out: list[tuple[int, str]] = []

        def emit(line: str) -> None:
            nonlocal number
            out.append((number, line))
            number += 1

        if state.hasTimedOut:
            if buffer:
                emit(buffer)
            buffer = ""
        else:
            rows = pd.concat(list(batches)).sort_values("seq")
            flags = rows[flush] if flush else [False] * len(rows)
            for text, flushed in zip(rows["fragment"], flags):
                *done, rest = (buffer + (text or "")).split("\n")
                for line in done:
                    emit(line + "\n")
                buffer = rest
                if buffer and (flushed or len(buffer) > cap):
                    emit(buffer)
                    buffer = ""
        state.update((buffer, number))
        if quiet and buffer:
            state.setTimeoutDuration(quiet)
        if out:
            yield pd.DataFrame(
                {"stream_id": str(key[0]), "ord": [n for n, _ in out], "line": [t for _, t in out]}
            )

    wanted = [stream_id, seq, fragment] + ([flush] if flush else [])
    rows = chunks.select(*wanted).withColumnsRenamed(names)
    return rows.groupBy("stream_id").applyInPandasWithState(
        release,
        _OUTPUT,
        _STATE,
        "append",
        GroupStateTimeout.ProcessingTimeTimeout if quiet else GroupStateTimeout.NoTimeout,
    )
