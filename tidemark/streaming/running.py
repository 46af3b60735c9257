"""Running sums, run lengths and exponential means that go on from batch to batch of a stream, so that a new bar costs no recomputing of its history.

The state of a symbol is one row: its last dt, and for each scan the number that the next row needs. It lives in the stream's state store and is recovered from the checkpoint. What
``operators.scans.scan`` gives for the table of all rows, the stream gives row by row, however the rows are cut into batches, if each symbol's rows come in order of dt.

A row that isn't after the last dt of its symbol's earlier batches, or has no dt, changes nothing: it comes out with ``late`` true and NULL in all scans, to be taken up by a new scan of the table.
Rows of one batch may come in any order; those of one dt follow each other in any order. Missing values are as in ``scan``. Rows without a symbol are one series.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.scans import Scans, _kept, _mean


def running(stream: DataFrame, scans: Scans) -> DataFrame:
    """symbol, dt, the scanned columns and ``late`` of a stream (symbol, dt as date or timestamp, and what the columns of ``scans`` read), in append mode. A task holds one symbol's rows of one batch: bound batches at the source."""
    sums, runs, spans = list(scans.sums), list(scans.runs), {k: s for k, (_, s) in scans.means.items()}
    columns = ["symbol", "dt", *scans.names(), "late"]
    rows = stream.select("symbol", "dt", *scans.inputs())
    kinds = dict(rows.dtypes)
    out = [f"symbol {kinds['symbol']}", f"dt {kinds['dt']}", *[f"`{k}` double" for k in sums], *[f"`{k}` bigint" for k in runs], *[f"`{k}` double" for k in spans], "late boolean"]
    kept = ["last bigint", *[f"`{k}` double" for k in sums], *[f"`{k}` bigint" for k in runs], *[f"`{n}` {t}" for k in spans for n, t in ((k, "double"), (f"age_{k}", "bigint"))]]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(parts), ignore_index=True)
        when = pd.to_datetime(part["dt"])
        micros = when.astype("datetime64[us]").astype("int64").where(when.notna())
        before = list(state.get) if state.exists else [None, *[0.0] * len(sums), *[0] * len(runs), *[None, 0] * len(spans)]
        late = micros.isna() | (micros <= before[0] if before[0] is not None else False)
        yield pd.DataFrame({"symbol": part["symbol"], "dt": part["dt"], "late": True}).reindex(columns=columns)[late].astype(dict.fromkeys(sums + list(spans), "Float64") | dict.fromkeys(runs, "Int64"))
        order = micros[~late].sort_values(kind="stable").index
        part, place = part.loc[order].reset_index(drop=True), np.arange(len(order))
        if not len(part):
            return
        made, after = {"symbol": part["symbol"], "dt": part["dt"]}, [int(micros[order[-1]])]
        for k, old in zip(sums, before[1:], strict=False):
            made[k] = part[f"in_{k}"].fillna(0.0).cumsum() + old
            after.append(float(made[k].iloc[-1]))
        for k, old in zip(runs, before[1 + len(sums) :], strict=False):
            run = place - np.maximum.accumulate(np.where(part[f"in_{k}"].to_numpy(bool), -1, place))
            made[k] = run + np.where(run == place + 1, old, 0)
            after.append(int(made[k][-1]))
        for i, (k, span) in enumerate(spans.items()):
            old, age = before[1 + len(sums) + len(runs) + 2 * i :][:2]
            x = part[f"in_{k}"].to_numpy(float)
            mean, share = _mean(x, span)
            known = np.flatnonzero(~np.isnan(x))
            if len(known) and old is not None:
                mean = mean + share * _kept(age + known[0], span) * (old - x[known[0]])
            if old is not None:
                mean[: known[0] if len(known) else len(x)] = old
            made[k] = pd.array(np.where(np.isnan(mean), None, mean), "Float64")
            after += [None if np.isnan(mean[-1]) else float(mean[-1]), int(len(x) - known[-1] if len(known) else age + len(x))]
        state.update(tuple(after))
        yield pd.DataFrame(made | {"late": False})

    return rows.groupBy("symbol").applyInPandasWithState(step, ", ".join(out), ", ".join(kept), "append", GroupStateTimeout.NoTimeout)
