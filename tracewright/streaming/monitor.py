"""Incremental detection of missing runs on samples as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "trace_id string, s long, e long, length long"
STATE = "start long, last long"


def _runs(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Closes a run at the first good sample after it; the state holds an open run's first and last place, -1 for none."""
    start, last = state.get if state.exists else (-1, -1)
    found = []
    for pdf in sorted(frames, key=lambda f: f["idx"].min() if len(f) else 0):
        for i, missing in pdf.sort_values("idx")[["idx", "missing"]].itertuples(index=False):
            if missing:
                start, last = (start if start >= 0 else i), i
            elif start >= 0:
                found.append((key[0], start, last, last - start + 1))
                start = last = -1
    state.update((int(start), int(last)))
    yield pd.DataFrame(found, columns=["trace_id", "s", "e", "length"])


def missing_runs(samples: DataFrame) -> DataFrame:
    """A streaming DataFrame of the runs in (trace_id, idx, missing) that have ended; samples of a trace come in order from batch to batch."""
    return samples.groupBy("trace_id").applyInPandasWithState(_runs, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
