"""Streaming sessions: the transcript so far of each session, re-read at every utterance.

State is one row per session.  A session's gate term latches, since every later
transcript holds the text it was found in.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from .. import ship_by_value
from ..functions import lexicons as L

OUTPUT = "session string, turn long, transcript string, gate_term string"


def session_stream(utterances: DataFrame, idle: str | None = None) -> DataFrame:
    """utterances: session, turn, text, as a stream.  One output row for each input row.

    Turns are put in order within a micro-batch; one that comes a batch late is read where it
    comes.  The state of a session is its transcript; ``idle`` says when it is dropped.
    """
    pattern = "|".join(L.OUT_OF_DOMAIN)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import re

        if state.hasTimedOut:
            state.remove()
            return
        rx = re.compile(pattern, re.I)
        said = state.get[0] if state.exists else ""
        pdf = pd.concat(list(batches)).sort_values("turn")
        rows = []
        for turn, text in zip(pdf["turn"], pdf["text"]):
            said = f"{said} {text or ''}".strip() if said else (text or "")
            found = rx.search(said)
            rows.append((key[0], turn, said, found.group(0) if found else None))
        state.update((said,))
        if idle:
            state.setTimeoutDuration(idle)
        yield pd.DataFrame(rows, columns=["session", "turn", "transcript", "gate_term"])

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return utterances.groupBy("session").applyInPandasWithState(step, OUTPUT, "said string", "append", timeout)


def resume_sink(path: str, keys: list[str]):
    """A foreachBatch writer that appends only rows whose keys the sink doesn't hold yet."""

    def write(batch: DataFrame, _: int) -> None:
        from ..operators.sessions import not_done
        from ..sources.readers import optional

        spark = batch.sparkSession
        # Of what the sink holds only the keys are read.
        known = StructType([batch.schema[k] for k in keys])
        have = optional(spark, lambda: spark.read.schema(known).json(path), known)
        not_done(batch.dropDuplicates(keys), have, keys).write.mode("append").json(path)

    return write


ship_by_value(__name__)
