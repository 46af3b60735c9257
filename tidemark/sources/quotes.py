"""A Python data source for vendors' price histories: one partition for each symbol, fetched by any function that is given.

    spark.dataSource.register(Quotes)
    spark.read.format("quotes").option("symbols", "A,B").option("start", "1990-01-01").option("fetch", "module:function").load()

``fetch(symbol, start, end)`` gives rows of (dt, Open, High, Low, Close, Volume). A symbol that fails gives no rows unless ``failfast`` is set; a retried task fetches its symbol anew.
"""

from __future__ import annotations

import importlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class SymbolPartition(InputPartition):
    def __init__(self, symbol: str) -> None:
        self.symbol = symbol


class QuotesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        names = [s.strip().upper() for s in self.options.get("symbols", "").split(",")]
        return [SymbolPartition(s) for s in dict.fromkeys(names) if s]

    def read(self, partition: SymbolPartition):
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        try:
            rows = fetch(partition.symbol, self.options.get("start"), self.options.get("end"))
        except Exception:
            if self.options.get("failfast", "false").lower() == "true":
                raise
            rows = []
        for row in rows:
            yield (partition.symbol, *row)


class Quotes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quotes"

    def schema(self) -> str:
        return "symbol string, dt date, Open double, High double, Low double, Close double, Volume double"

    def reader(self, schema) -> DataSourceReader:
        return QuotesReader(self.options)
