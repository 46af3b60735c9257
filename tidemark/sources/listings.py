"""A Python data source for exchanges' listings: one partition for each exchange, fetched by any function that is given, with a fallback list.

    spark.dataSource.register(Listings)
    spark.read.format("listings").option("exchanges", "NSE,BSE").option("fetch", "module:function").option("fallback", "A.NS,B.BO").load()

``fetch(exchange)`` gives rows of (symbol, name). Symbols are trimmed and in upper case, without the exchange's suffix. An exchange that fails or has no rows
takes the symbols of the fallback list that have its suffix; without any it gives no rows.
"""

from __future__ import annotations

import importlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SUFFIXES = {"NSE": ".NS", "BSE": ".BO"}


class Exchange(InputPartition):
    def __init__(self, name: str) -> None:
        self.name = name


class ListingsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        names = [x.strip().upper() for x in self.options.get("exchanges", ",".join(SUFFIXES)).split(",")]
        return [Exchange(x) for x in dict.fromkeys(names) if x in SUFFIXES]

    def read(self, partition: Exchange):
        suffix = SUFFIXES[partition.name]
        module, _, name = self.options["fetch"].partition(":")
        try:
            rows = [(str(s), n) for s, n in getattr(importlib.import_module(module), name)(partition.name)]
        except Exception:
            rows = []
        rows = rows or [(s, None) for s in self.options.get("fallback", "").split(",") if s.strip().upper().endswith(suffix)]
        seen = set()
        for symbol, title in rows:
            symbol = symbol.strip().upper().removesuffix(suffix)
            if symbol and symbol not in seen:
                seen.add(symbol)
                yield symbol, symbol + suffix, partition.name, title


class Listings(DataSource):
    @classmethod
    def name(cls) -> str:
        return "listings"

    def schema(self) -> str:
        return "SYMBOL string, SYMBOL_EXCHANGE string, EXCHANGE string, NAME string"

    def reader(self, schema) -> DataSourceReader:
        return ListingsReader(self.options)
