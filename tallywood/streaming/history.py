"""Captures compared with the one before as they arrive: the streaming form of operators.sequence.with_previous."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, seq long, result string, metric double, moved string, delta double"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Only the last capture of a key is kept as state; a batch's rows are taken in order of seq. A null metric has no delta."""
    last = state.get if state.exists else None
    number = lambda x: None if x is None or pd.isna(x) else float(x)
    for f in frames:
        rows = []
        for r in f.sort_values("seq").itertuples(index=False):
            if last is None:
                moved, delta = "nothing to compare", None
            else:
                moved = "same" if last[0] == r.result else "improved" if r.result == "pass" else "REGRESSION"
                now, before = number(r.metric), number(last[1])
                delta = None if now is None or before is None else round(now - before, 4)
            rows.append((key[0], int(r.seq), r.result, number(r.metric), moved, delta))
            last = (r.result, number(r.metric))
        yield pd.DataFrame(rows, columns=["key", "seq", "result", "metric", "moved", "delta"]).astype({"metric": "Float64", "delta": "Float64"})
    if last is not None:
        state.update(last)


def analysed(captures: DataFrame) -> DataFrame:
    """A stream (key string, seq long, result string, metric double) with the transition of each capture."""
    return captures.groupBy("key").applyInPandasWithState(_step, OUT, "result string, metric double", "append", GroupStateTimeout.NoTimeout)
