"""A stream of utterances from a file that grows by a line for each; it owns its offsets.

    spark.dataSource.register(UtteranceSource)
    spark.readStream.format("utterances").option("path", "/var/log/crew.txt").load()

A line is an utterance, a blank line ends the session, and the next line begins another.
The file is read on the driver, as what a person types is small.  An offset holds the
byte, session and turn that come next; only whole lines count, so a line that is still
being written is read once it has ended.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from .. import ship_by_value

SCHEMA = "session long, turn long, text string"


class UtteranceReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, most_bytes: int):
        self.path, self.most_bytes = path, most_bytes

    def initialOffset(self) -> dict:
        return {"byte": 0, "session": 1, "turn": 1}

    def _lines(self, start: dict, end: int | None) -> tuple[list[tuple], dict]:
        if not os.path.exists(self.path):
            return [], start
        with open(self.path, "rb") as f:
            f.seek(start["byte"])
            data = f.read(self.most_bytes if end is None else end - start["byte"])
            # A line longer than the limit is read to its end.
            if end is None and len(data) == self.most_bytes and b"\n" not in data:
                data += f.readline()
        whole = data[: data.rfind(b"\n") + 1]
        rows, session, turn = [], start["session"], start["turn"]
        for line in whole.split(b"\n")[:-1]:
            text = line.decode("utf-8", "replace").strip()
            if text:
                rows.append((session, turn, text))
                turn += 1
            elif turn > 1:
                session, turn = session + 1, 1
        return rows, {"byte": start["byte"] + len(whole), "session": session, "turn": turn}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._lines(start, None)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(self._lines(start, end["byte"])[0])

    def commit(self, end: dict) -> None:
        """The file keeps everything."""


class UtteranceSource(DataSource):
    """Options: ``path``; ``most_bytes`` of a micro-batch (1 MB)."""

    @classmethod
    def name(cls) -> str:
        return "utterances"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> UtteranceReader:
        return UtteranceReader(self.options["path"], int(self.options.get("most_bytes", 1 << 20)))


ship_by_value(__name__)
