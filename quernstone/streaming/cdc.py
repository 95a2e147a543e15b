"""Change streams: envelopes, ordering by log position, deduplication, exactly-once and causal checks."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_envelope(df: DataFrame, column: str, row: str) -> DataFrame:
    """JSON envelopes (before, after, op, ts_ms, source.lsn) to the row's fields, op, lsn, ts_ms, deleted; broken ones have op null."""
    e = F.from_json(F.col(column), f"before STRUCT<{row}>, after STRUCT<{row}>, op STRING, ts_ms BIGINT, source STRUCT<lsn: BIGINT>")
    x = df.withColumn("_e", e)
    image = F.when(F.col("_e.op") == "d", F.col("_e.before")).otherwise(F.col("_e.after"))
    return x.withColumn("_i", image).select("_i.*", F.col("_e.op").alias("op"), F.col("_e.source.lsn").alias("lsn"), F.col("_e.ts_ms").alias("ts_ms"), (F.col("_e.op") == "d").alias("deleted"))


def dead_letters(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    return flat.filter("op IS NOT NULL"), flat.filter("op IS NULL")


def upsert_soft_delete(current: DataFrame, changes: DataFrame, keys: list[str], lsn: str = "lsn") -> DataFrame:
    """Newest position wins, an older change never overwrites; deletes are marked, not removed."""
    rest = [c for c in current.columns if c not in keys]
    every = current.unionByName(changes.select(*current.columns))
    return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), lsn).alias("_x")).select(*keys, "_x.*")


def releasable(buffer: DataFrame, partition: str, lsn: str) -> DataFrame:
    """Rows up to the least of the partitions' largest positions, in order: nothing earlier can still come."""
    safe = buffer.groupBy(partition).agg(F.max(lsn).alias("m")).agg(F.min("m").alias("safe"))
    return buffer.crossJoin(F.broadcast(safe)).filter(F.col(lsn) <= F.col("safe")).drop("safe").orderBy(lsn)  # one row


def exactly_once_violations(log: DataFrame, event_id: str, producer: str, seq: str, position: str) -> DataFrame:
    """position, kind: duplicate (an id seen before) and gap (a producer's number is not the one before plus 1)."""
    again = F.row_number().over(Window.partitionBy(event_id).orderBy(position)) > 1
    before = F.lag(seq).over(Window.partitionBy(producer).orderBy(position))
    gap = F.when(before.isNotNull(), F.col(seq) != before + 1).otherwise(False)
    v = log.withColumn("_a", again).withColumn("_g", gap)
    kinds = F.filter(F.array(F.when(F.col("_a"), F.lit("duplicate")), F.when(F.col("_g"), F.lit("gap"))), lambda x: x.isNotNull())
    return v.select(F.col(position), F.explode(kinds).alias("kind"))


def causal_sort(log: DataFrame, group: str, producer: str, seq: str, clock: str) -> DataFrame:
    """Per group a total order that respects the vector clocks (maps), ties by producer and number: group, producer, seq, place.

    A group's events meet in one task.  A cycle is an error.
    """

    def run(pdf):
        import pandas as pd

        ev = sorted((p, int(s), dict(c)) for p, s, c in zip(pdf[producer], pdf[seq], pdf[clock]))
        at = {(p, s): i for i, (p, s, _) in enumerate(ev)}
        needs = [[at[k] for k in {*((q, int(n)) for q, n in c.items() if q != p), (p, s - 1)} if k in at] for p, s, c in ev]
        out_of: list[list[int]] = [[] for _ in ev]
        open_ = [len(n) for n in needs]
        for i, n in enumerate(needs):
            for j in n:
                out_of[j].append(i)
        heap = [(ev[i][0], ev[i][1], i) for i, n in enumerate(open_) if not n]
        heapq.heapify(heap)
        done = []
        while heap:
            p, s, i = heapq.heappop(heap)
            done.append((pdf[group].iloc[0], p, s, len(done)))
            for j in out_of[i]:
                open_[j] -= 1
                if not open_[j]:
                    heapq.heappush(heap, (ev[j][0], ev[j][1], j))
        if len(done) < len(ev):
            raise ValueError("the clocks form a cycle")
        return pd.DataFrame(done, columns=["group", "producer", "seq", "place"])

    kinds = [log.schema[c].dataType.simpleString() for c in (group, producer)]
    return log.select(group, producer, seq, clock).groupBy(group).applyInPandas(run, f"group {kinds[0]}, producer {kinds[1]}, seq long, place long")


ORDER_EVENTS = T.StructType([T.StructField("order_id", T.LongType()), T.StructField("customer_id", T.LongType()), T.StructField("amount", T.DoubleType()), T.StructField("event_time", T.StringType())])


def json_orders(stream: DataFrame, column: str = "value") -> DataFrame:
    """Order events from JSON text, with the time as TIMESTAMP."""
    return stream.select(F.from_json(F.col(column).cast("string"), ORDER_EVENTS).alias("o")).select("o.*").withColumn("event_time", F.to_timestamp("event_time"))


def alert_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows as a message sink takes them: key and value (all columns as JSON), both text."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))


def write_alerts(stream: DataFrame, key: str, format: str, checkpoint: str, options: dict[str, str]):
    """Start an append query that writes alerts to any sink of key and value rows (a message broker where its format is installed, else files)."""
    return alert_rows(stream, key).writeStream.format(format).outputMode("append").option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()
