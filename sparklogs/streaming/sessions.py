"""Sessions of a stream in cells of time, with a timer for each: what a batch costs follows its lines, not what is open.

A cell is as wide as the gap between sessions, so lines in one cell always belong together, and a session is a chain of
cells one after another. New lines are read and written in their own cells only. When the watermark passes the last line
of a cell by the gap, the cell is final: it is folded into the next one if the session goes on there, and is the end of
the session otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparklogs.operators.sessions import EXAMPLES

KEYS = ["project_id", "source_service", "source_env", "signature"]
SESSIONS = "project_id string, source_service string, source_env string, signature string, count long, examples array<string>, timestamp_start timestamp, timestamp_end timestamp, log_level string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NAMES = [x.split()[0] for x in SESSIONS.split(", ")]


class Cell(NamedTuple):
    """``start`` of the session as far as it is folded in here, first and last line of the cell itself, in microseconds, the
    number of lines, and the first ``EXAMPLES`` of them."""

    start: int
    first: int
    last: int
    count: int
    times: list
    messages: list
    levels: list

    def lines(self) -> Iterable[tuple]:
        return zip(self.times, self.messages, self.levels, strict=True)


CELL = "start long, first long, last long, count long, times array<long>, messages array<string>, levels array<string>"


def earliest(lines: Iterable[tuple]) -> tuple[list, list, list]:
    """Times, messages and levels of the first ``EXAMPLES`` lines (ts, message, level), by time and message."""
    kept = sorted(lines, key=lambda x: (x[0], x[1] or "", x[2] or ""))[:EXAMPLES]
    times, messages, levels = zip(*kept, strict=True)
    return list(times), list(messages), list(levels)


def cells_of(lines: Iterable[tuple], gap: int) -> dict[int, Cell]:
    """The lines (ts, message, level) of a batch, in any order, by cell."""
    dealt: dict[int, list[tuple]] = {}
    for line in lines:
        dealt.setdefault(line[0] // gap, []).append(line)
    return {cell: Cell(min(x[0] for x in own), min(x[0] for x in own), max(x[0] for x in own), len(own), *earliest(own)) for cell, own in dealt.items()}


def added(old: Cell | None, new: Cell) -> Cell:
    """Both of one cell together."""
    if old is None:
        return new
    ends = min(old.start, new.start), min(old.first, new.first), max(old.last, new.last)
    return Cell(*ends, old.count + new.count, *earliest([*old.lines(), *new.lines()]))


def folded(before: Cell, after: Cell) -> Cell:
    """A final cell taken into the next one of its session."""
    return Cell(before.start, after.first, after.last, before.count + after.count, *earliest([*before.lines(), *after.lines()]))


class SessionCells(StatefulProcessor):
    """Closed sessions of a key. State is a map of cells; each has a timer at which it is final."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getMapState("cells", "cell long", CELL)

    def _get(self, cell: int) -> Cell | None:
        found = self.cells.getValue((cell,)) if self.cells.containsKey((cell,)) else None
        return None if found is None else Cell(*found)

    def _time(self, cell: Cell) -> int:
        """The millisecond before the one in which the cell is final."""
        return -(-(cell.last + self.gap) // 1000) - 1

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new: dict[int, Cell] = {}
        for frame in rows:
            for cell, own in cells_of(zip(frame["micros"].tolist(), frame["message"].tolist(), frame["level"].tolist(), strict=True), self.gap).items():
                new[cell] = added(new.get(cell), own)
        for cell, own in new.items():
            old = self._get(cell)
            whole = added(old, own)
            self.cells.updateValue((cell,), tuple(whole))
            if old is None or whole.last > old.last:
                if old is not None:
                    self.handle.deleteTimer(self._time(old))
                self.handle.registerTimer(self._time(whole))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        mark, at = timerValues.getCurrentWatermarkInMs() * 1000, expiredTimerInfo.getExpiryTimeInMs() * 1000
        closed: list[tuple] = []
        for cell in range((at - 1000 - self.gap) // self.gap, (at + 1000 - self.gap) // self.gap + 1):
            closed.extend(self._settle(cell, mark))
        if closed:
            yield pd.DataFrame([(*key, *session) for session in closed], columns=_NAMES)

    def _settle(self, number: int, mark: int) -> Iterator[tuple]:
        cell = self._get(number)
        if cell is None:
            return
        if cell.last + self.gap > mark:
            if cell.last + self.gap <= mark + 1000:  # the timer was that of the millisecond before
                self.handle.registerTimer(self._time(cell) + 1)
            return
        before = self._get(number - 1)
        if before is not None:
            yield from self._settle(number - 1, mark)
            cell = self._get(number)
        after = self._get(number + 1)
        if after is not None and after.first - cell.last <= self.gap:
            self.cells.updateValue((number + 1,), tuple(folded(cell, after)))
        else:
            yield cell.count, cell.messages, pd.Timestamp(cell.start, unit="us"), pd.Timestamp(cell.last, unit="us"), cell.levels[0]
        self.cells.removeKey((number,))

    def close(self) -> None:
        pass


def session_cells(parsed: DataFrame, gap_seconds: int, delay: str) -> DataFrame:
    """``SESSIONS`` rows of closed sessions of ``parsed``, each once; see ``streams.stream_chunks``. The session's state
    store must be ``ROCKSDB``."""
    timed = parsed.where("ts is not null").withWatermark("ts", delay).select(*KEYS, "ts", F.unix_micros("ts").alias("micros"), "message", "level")
    return timed.groupBy(*KEYS).transformWithStateInPandas(SessionCells(gap_seconds * 1_000_000), SESSIONS, "append", "eventTime")
