"""Sequence patterns per entity: steps with counts, gaps, flags and a total window.

One fold serves batches (applyInPandas) and streams (applyInPandasWithState).
At most one partial match is open per entity; events that do not fit are passed
over; an event that comes after the window or gap has run out resets the match
and is spent; a match resets, so matches do not overlap.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Step:
    type: str
    count: int = 1
    gap: float | None = None
    low: float | None = None
    high: float | None = None
    flags: int = 0


@dataclass(frozen=True)
class Pattern:
    name: str
    steps: tuple[Step, ...] = field(default=())
    window: float | None = None

    def begin(self, type: str, **kw) -> Pattern:
        return Pattern(self.name, (Step(type, **kw),), self.window)

    def then(self, type: str, **kw) -> Pattern:
        return Pattern(self.name, (*self.steps, Step(type, **kw)), self.window)

    def within(self, seconds: float) -> Pattern:
        return Pattern(self.name, self.steps, seconds)

    def fold(self, events: Iterable[tuple[float, str, float, int]], state: tuple[int, int, float, float] = (0, 0, 0.0, 0.0)) -> Iterator[tuple[tuple, tuple[float, float] | None]]:
        """After each event (time, type, value, flags) the state (step, count, start, last) and the match (start, end), if one ends here."""
        for t, kind, value, flags in events:
            step, count, start, last = state
            open_ = step > 0 or count > 0
            s = self.steps[step]
            expired = open_ and ((self.window is not None and t - start > self.window) or (step > 0 and s.gap is not None and t - last > s.gap))
            match = None
            if expired:
                state = (0, 0, 0.0, 0.0)
            elif kind == s.type and (s.low is None or value >= s.low) and (s.high is None or value <= s.high) and flags & s.flags == s.flags:
                start = start if open_ else t
                count += 1
                if count < s.count:
                    state = (step, count, start, t)
                elif step + 1 < len(self.steps):
                    state = (step + 1, 0, start, t)
                else:
                    match, state = (start, t), (0, 0, 0.0, 0.0)
            yield state, match


def match(df: DataFrame, patterns: list[Pattern], entity: str, ts: str, kind: str, value: str, flags: str | None = None, order: str | None = None) -> DataFrame:
    """pattern, entity, start, end (seconds) of every match in a batch.  One entity's events meet in one task."""
    import pyspark.sql.functions as F

    kind_of = df.schema[entity].dataType.simpleString()
    rows = df.select(F.col(entity).alias("e"), F.col(ts).cast("timestamp").cast("double").alias("t"), F.col(kind).alias("k"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"), (F.col(flags).cast("long") if flags else F.lit(0).cast("long")).alias("f"), (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("o"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["t", "o"])
        events = list(zip(pdf.t, pdf.k, pdf.v, pdf.f))
        out = [(p.name, pdf.e.iloc[0], *m) for p in patterns for _, m in p.fold(events) if m]
        return pd.DataFrame(out, columns=["pattern", "entity", "start", "end"])

    return rows.groupBy("e").applyInPandas(run, f"pattern string, entity {kind_of}, start double, end double")


def match_stream(stream: DataFrame, pattern: Pattern, entity: str, ts: str, kind: str, value: str) -> DataFrame:
    """The same on a stream, in append mode; events of one batch are taken in the order of their time."""
    import pyspark.sql.functions as F
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind_of = stream.schema[entity].dataType.simpleString()
    rows = stream.select(F.col(entity).alias("e"), F.col(ts).cast("timestamp").cast("double").alias("t"), F.col(kind).alias("k"), F.col(value).cast("double").alias("v"))

    def run(key, frames, state):
        import pandas as pd

        pdf = pd.concat(list(frames)).sort_values("t")
        at = tuple(state.get) if state.exists else (0, 0, 0.0, 0.0)
        out = []
        for at, m in pattern.fold(zip(pdf.t, pdf.k, pdf.v, [0] * len(pdf)), at):
            if m:
                out.append((pattern.name, key[0], *m))
        state.update((int(at[0]), int(at[1]), float(at[2]), float(at[3])))
        yield pd.DataFrame(out, columns=["pattern", "entity", "start", "end"])

    return rows.groupBy("e").applyInPandasWithState(run, f"pattern string, entity {kind_of}, start double, end double", "step int, count int, start double, last double", "append", GroupStateTimeout.NoTimeout)
