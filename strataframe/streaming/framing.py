"""Messages from chunks of text: a message ends where all that came since the last one is one JSON value."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "pending string, messages long"


def framed(chunks: DataFrame, connection: str, order: str, text: str) -> DataFrame:
    """(connection, message, body): each complete message of each connection, counted from 0, of a stream of chunks.

    What isn't complete yet is kept as state until more comes. Two values in one buffer never parse, so such a
    connection gives nothing more; a connection's chunks of one trigger are taken in order."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, n = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values(order)
        out = []
        for part in rows[text]:
            pending += part or ""
            try:
                json.loads(pending)
            except ValueError:
                continue
            out.append((key[0], n, pending))
            pending, n = "", n + 1
        state.update((pending, n))
        yield pd.DataFrame(out, columns=[connection, "message", "body"])

    kind = chunks.schema[connection].dataType.simpleString()
    return chunks.groupBy(connection).applyInPandasWithState(run, f"{connection} {kind}, message long, body string", _STATE, "append", GroupStateTimeout.NoTimeout)
