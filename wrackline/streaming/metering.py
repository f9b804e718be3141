"""Metering of active time over a stream of power samples, with state per run."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "run_id string, samples bigint, consumed_s double, exceeded boolean"
STATE = "last double, active boolean, consumed double, samples bigint"


def metering(samples: DataFrame, active: float = 25.0, cap_s: float = float("inf")) -> DataFrame:
    """`run_id, samples, consumed_s, exceeded` after each trigger; samples: `run_id, ts, watts`.

    The time from a sample to the next counts if the earlier one was active. A sample older
    than the last one is left out of the sum. State survives restarts in the stream's checkpoint.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, on, consumed, n = state.get if state.exists else (float("nan"), False, 0.0, 0)
        for part in sorted(parts, key=lambda p: p["ts"].min()):
            for ts, w in part.sort_values("ts")[["ts", "watts"]].itertuples(index=False):
                at = pd.Timestamp(ts).timestamp()
                n += 1
                if at < last:
                    continue
                consumed += at - last if on and last == last else 0.0
                last, on = at, bool(w >= active)
        state.update((last, on, consumed, n))
        yield pd.DataFrame([(key[0], n, consumed, consumed > cap_s)], columns=["run_id", "samples", "consumed_s", "exceeded"])

    return samples.groupBy("run_id").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
