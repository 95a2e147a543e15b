"""As-of join of two streams with corrections: late right rows retract a result and emit the better one.

State per key is the right rows and left rows within the lateness bound, kept as
arrays; rows older than the newest time less the bound leave the state.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "key string, left_ts double, left_value double, right_ts double, right_value double, op string"


def fold(events, state: dict, lookback: float, lateness: float):
    """events: (time, side, value), in order of arrival.  Yields (left time, left value, right time, right value, op); state: sorted lists left and right."""
    left, right = state["left"], state["right"]

    def best(t: float):
        i = bisect.bisect_right(right, (t, float("inf"), float("inf"))) - 1
        return right[i] if i >= 0 and right[i][0] >= t - lookback else None

    for t, side, value in events:
        if t < state["newest"] - lateness:
            continue  # beyond repair
        state["newest"] = max(state["newest"], t)
        state["seq"] += 1
        if side == "left":
            bisect.insort(left, (t, state["seq"], value))
            r = best(t)
            yield t, value, r and r[0], r and r[2], "+"
        else:
            touched = left[bisect.bisect_left(left, (t,)) : bisect.bisect_right(left, (t + lookback, float("inf"), float("inf")))]
            before = [best(x[0]) for x in touched]
            bisect.insort(right, (t, state["seq"], value))
            for x, old in zip(touched, before):
                new = best(x[0])
                if new != old:
                    yield x[0], x[2], old and old[0], old and old[2], "-"
                    yield x[0], x[2], new[0], new[2], "+"
        edge = state["newest"] - lateness
        del left[: bisect.bisect_left(left, (edge,))]
        del right[: bisect.bisect_left(right, (edge - lookback,))]


def fresh() -> dict:
    return {"left": [], "right": [], "newest": float("-inf"), "seq": 0}


def asof_stream(events: DataFrame, key: str, ts: str, side: str, value: str, arrival: str, lookback: float, lateness: float) -> DataFrame:
    """One stream that holds both sides (side: left or right) to results with op + and -."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("double").alias("t"), F.col(side).alias("s"), F.col(value).cast("double").alias("v"), F.col(arrival).cast("double").alias("a"))

    def run(k, frames, state):
        import json

        import pandas as pd

        held = fresh()
        if state.exists:
            held = json.loads(state.get[0])
            held["left"], held["right"] = [tuple(x) for x in held["left"]], [tuple(x) for x in held["right"]]
        pdf = pd.concat(list(frames)).sort_values("a")
        out = [(k[0], *r) for r in fold(zip(pdf.t, pdf.s, pdf.v), held, lookback, lateness)]
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["key", "left_ts", "left_value", "right_ts", "right_value", "op"])

    return rows.groupBy("key").applyInPandasWithState(run, SCHEMA, "held string", "append", GroupStateTimeout.NoTimeout)


def net(results: DataFrame) -> DataFrame:
    """The results that stand: additions less retractions."""
    cols = [c for c in results.columns if c != "op"]
    return results.groupBy(*cols).agg(F.sum(F.when(F.col("op") == "+", 1).otherwise(-1)).alias("n")).filter("n > 0").drop("n")
