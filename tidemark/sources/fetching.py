"""A stream of vendors' daily bars that remembers, for each symbol, the last day it fetched.

    spark.dataSource.register(Fetches)
    spark.readStream.format("fetches").option("symbols", "A,B").option("start", "1990-01-01").option("fetch", "module:function").load()

``fetch(symbol, first, last)`` gives rows of (day, Open, High, Low, Close, Volume) from ``first`` to ``last``, both ISO days and included; with the option ``at`` it gets that as a fourth argument. A batch covers, for each symbol,
the days after the last batch's up to ``end`` (the day of the call, in UTC, unless given): the offset is a map of symbol to day, so a symbol that is new in the list starts at ``start``, and one that has left it is kept where it was.
A batch that ended is never fetched again; one that failed is fetched again with the same days. Rows of other days than those asked for are dropped, so no day comes twice.

- Work: a symbol's days are cut into pieces of ``days`` (366), one call each; the pieces go round over ``tasks`` (8) partitions.
- Rate: ``pause`` seconds between two calls of a task (0), so calls are at most tasks / pause a second.
- Failures: a call is tried ``tries`` times (3), after 1, 2, 4 … times ``wait`` seconds (1). Then the batch fails, or, with ``failures`` "rows", the piece comes as one row with its first day, NULL prices and the reason in
  ``error``, for a later fetch; the stream goes on. Consumers take the rows whose ``error`` is NULL.
- An empty list of symbols gives no rows; names are trimmed, in capitals, and taken once.
"""

from __future__ import annotations

import datetime as dt
import importlib
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.dataset as ds
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


@dataclass
class Pieces(InputPartition):
    """Calls of one task: symbol, first and last day."""

    calls: list[tuple[str, str, str]]


class FetchReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.symbols = list(dict.fromkeys(s.strip().upper() for s in self.options.get("symbols", "").split(",") if s.strip()))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        end = self.options.get("end") or dt.datetime.now(dt.UTC).date().isoformat()
        return dict.fromkeys(self.symbols, end)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        one, days, calls = dt.timedelta(days=1), int(self.options.get("days", 366)), []
        for symbol, last in sorted(end.items()):
            first, last = dt.date.fromisoformat(start[symbol]) + one if symbol in start else dt.date.fromisoformat(self.options["start"]), dt.date.fromisoformat(last)
            while first <= last:
                until = min(last, first + days * one - one)
                calls.append((symbol, first.isoformat(), until.isoformat()))
                first = until + one
        tasks = int(self.options.get("tasks", 8))
        return [Pieces(calls[i::tasks]) for i in range(min(tasks, len(calls)))]

    def read(self, partition: Pieces) -> Iterator[tuple]:
        pause = float(self.options.get("pause", 0))
        for i, (symbol, first, last) in enumerate(partition.calls):
            if i and pause:
                time.sleep(pause)
            try:
                rows = self._tried(symbol, first, last)
            except Exception as e:
                if self.options.get("failures") != "rows":
                    raise
                yield symbol, dt.date.fromisoformat(first), None, None, None, None, None, f"{type(e).__name__}: {e}"
                continue
            for day, *prices in rows:
                if first <= day.isoformat() <= last:
                    yield symbol, day, *[None if p is None else float(p) for p in prices], None

    def _tried(self, symbol: str, first: str, last: str) -> list[tuple]:
        module, _, name = self.options["fetch"].partition(":")
        fetch, tries = getattr(importlib.import_module(module), name), int(self.options.get("tries", 3))
        more = [self.options["at"]] if "at" in self.options else []
        for n in range(tries):
            try:
                return list(fetch(symbol, first, last, *more))
            except Exception:
                if n == tries - 1:
                    raise
                time.sleep(float(self.options.get("wait", 1)) * 2**n)
        raise ValueError("tries is less than one")


class Fetches(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fetches"

    def schema(self) -> str:
        return "symbol string, dt date, Open double, High double, Low double, Close double, Volume double, error string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FetchReader(self.options)


def archive(symbol: str, first: str, last: str, at: str) -> list[tuple]:
    """A vendor that is a folder of Parquet by symbol, as ``sinks.write_bars`` writes it; for backfills. Only the symbol's files are read, and of them the days asked for."""
    day = ds.field("dt")
    table = ds.dataset(at.removeprefix("file:"), partitioning=ds.partitioning(flavor="hive"), format="parquet").to_table(
        ["dt", "Open", "High", "Low", "Close", "Volume"], filter=(ds.field("symbol") == symbol) & (day >= dt.date.fromisoformat(first)) & (day <= dt.date.fromisoformat(last)),
    )
    return list(zip(*[c.to_pylist() for c in table.columns], strict=True))
