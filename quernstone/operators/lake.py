"""Table maintenance on plain Parquet: merges, slowly changing dimensions, snapshots, compaction, layout."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.windows import global_row_number


def merge_scd1(base: DataFrame, updates: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Upsert: the latest row of each key; of equal sequences the update wins."""
    every = base.withColumn("_u", F.lit(0)).unionByName(updates.withColumn("_u", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_u"), F.desc(sequence)) if sequence not in base.columns else Window.partitionBy(*keys).orderBy(F.desc(sequence), F.desc("_u"))
    return every.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_u")


def scd2(history: DataFrame, keys: list[str], tracked: list[str], sequence: str) -> DataFrame:
    """Versions from a change log: runs of equal tracked values once, with valid_from, valid_to and is_current."""
    w = Window.partitionBy(*keys).orderBy(sequence)
    state = F.struct(*tracked)
    runs = history.withColumn("_before", F.lag(state).over(w)).withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(state))
    out = runs.withColumn("valid_from", F.col(sequence)).withColumn("valid_to", F.lead(sequence).over(w))
    return out.withColumn("is_current", F.col("valid_to").isNull()).withColumn("surrogate", F.sha2(F.concat_ws("|", *keys, F.col("valid_from").cast("string")), 256)).drop("_before", "_n")


def merge_scd2(current: DataFrame, updates: DataFrame, keys: list[str], tracked: list[str], sequence: str) -> DataFrame:
    """Versions (as scd2 makes them) after more changes; brand-new keys come in once."""
    log = current.select(*keys, *tracked, F.col("valid_from").alias(sequence)).unionByName(updates.select(*keys, *tracked, sequence))
    return scd2(log.dropDuplicates([*keys, sequence]), keys, tracked, sequence)


def merge_on_read(base: DataFrame, log: DataFrame, keys: list[str], order: str, op: str) -> DataFrame:
    """Base rows with an ordered log of insert, update and delete folded in; the last entry of a key wins, of entries of one order the greater op, then the greater row."""
    cols = base.columns
    b = base.select(*keys, F.struct(*cols).alias("_r"), F.lit(-1).cast("long").alias("_o"), F.lit("insert").alias("_op"))
    d = log.select(*keys, F.struct(*cols).alias("_r"), F.col(order).cast("long").alias("_o"), F.col(op).alias("_op"))
    last = b.unionByName(d).groupBy(*keys).agg(F.max_by(F.struct("_r", "_op"), F.struct("_o", "_op", "_r")).alias("_x"))
    return last.filter("_x._op <> 'delete'").select("_x._r.*")


def cdc_fold(events: DataFrame, keys: list[str], lsn: str, op: str) -> DataFrame:
    """Current rows of a change stream: the newest LSN of each key wins, deletes vanish."""
    last = events.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in events.columns if c not in keys]), lsn).alias("_x"))
    return last.filter(F.col(f"_x.{op}") != "d").select(*keys, "_x.*")


def conflicts_lww(versions: DataFrame, keys: list[str], ts: str, region: str) -> DataFrame:
    """Last writer wins; of equal times the region of greater name."""
    rest = [c for c in versions.columns if c not in keys]
    return versions.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, region)).alias("_x")).select(*keys, "_x.*")


def snapshot(history: DataFrame, source: DataFrame, keys: list[str], updated_at: str) -> DataFrame:
    """History (source columns, valid_from, valid_to) after one look at the source.

    A newer updated_at closes the standing version and opens another; rows that the
    source no longer has are closed at the newest time it has (hard deletes).
    """
    standing, closed = history.filter("valid_to IS NULL"), history.filter("valid_to IS NOT NULL")
    now = source.agg(F.max(updated_at).alias("_now"))
    j = standing.join(source.select(*keys, F.col(updated_at).alias("_new")), keys, "left").crossJoin(F.broadcast(now))  # one row
    end = F.when(F.col("_new").isNull(), F.col("_now")).when(F.col("_new") > F.col(updated_at), F.col("_new"))
    old = j.withColumn("valid_to", end).select(*history.columns)
    fresh = source.join(standing.select(*keys, F.col(updated_at).alias("_old")), keys, "left").filter("_old IS NULL OR _old < " + updated_at)
    new = fresh.withColumn("valid_from", F.col(updated_at)).withColumn("valid_to", F.lit(None).cast(history.schema["valid_to"].dataType)).select(*history.columns)
    return closed.unionByName(old).unionByName(new)


class SnapshotTable:
    """Versioned Parquet directories and a manifest: append, overwrite, time travel, history, change feed.

    Writers are one driver at a time; a version exists once its manifest entry
    does, which is written last, as one small file, by Spark's own writer.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def history(self) -> list[dict]:
        fs, p = self._fs(f"{self.path}/_manifest")
        if not fs.exists(p):
            return []
        rows = self.spark.read.text(f"{self.path}/_manifest/*/").collect()  # one short line a version
        return sorted((json.loads(r.value) for r in rows), key=lambda x: x["version"])

    def write(self, df: DataFrame, mode: str = "overwrite", partition_by: list[str] | None = None) -> int:
        past = self.history()
        version = past[-1]["version"] + 1 if past else 0
        folder = f"{self.path}/v{version}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)
        entry = {"version": version, "ts": time.time(), "mode": mode, "folders": ([] if mode == "overwrite" or not past else past[-1]["folders"]) + [folder]}
        self.spark.createDataFrame([(json.dumps(entry),)], "value string").coalesce(1).write.text(f"{self.path}/_manifest/{version:08d}")
        return version

    def read(self, version: int | None = None, as_of: float | None = None) -> DataFrame:
        past = [e for e in self.history() if (version is None or e["version"] <= version) and (as_of is None or e["ts"] <= as_of)]
        if not past:
            raise ValueError("no such version")
        frames = [self.spark.read.option("mergeSchema", "true").parquet(f) for f in past[-1]["folders"]]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def changes(self, before: int, after: int) -> DataFrame:
        """Rows with _change: insert or delete, between two versions, as multisets."""
        a, b = self.read(before), self.read(after)
        return b.exceptAll(a).withColumn("_change", F.lit("insert")).unionByName(a.exceptAll(b).withColumn("_change", F.lit("delete")))

    def vacuum(self, keep: int) -> list[str]:
        """Delete the folders that only versions before the last ``keep`` use."""
        past = self.history()
        held = {f for e in past[-keep:] for f in e["folders"]}
        gone = sorted({f for e in past[:-keep] for f in e["folders"]} - held)
        for f in gone:
            fs, p = self._fs(f)
            fs.delete(p, True)
        return gone


def copy_on_write(base: DataFrame, change: DataFrame, keys: list[str], delete: Column | None = None) -> DataFrame:
    """Base with changed keys replaced (and keys for which ``delete`` holds removed)."""
    keep = base.join(change.select(*keys), keys, "left_anti")
    new = change if delete is None else change.filter(~delete)
    return keep.unionByName(new.select(*base.columns))


def compact(df: DataFrame, rows: int, per_file: int, sort: list[str] | None = None) -> DataFrame:
    """Evenly filled files: range partitions by the sort columns, else round robin."""
    n = max(1, -(-rows // per_file))
    return df.repartitionByRange(n, *sort).sortWithinPartitions(*sort) if sort else df.repartition(n)


def z_order(df: DataFrame, columns: list[str], partitions: int, bits: int = 16) -> DataFrame:
    """Rows clustered by the interleaved ranks of their columns' ranges."""
    from quernstone.functions.scalar import z_key

    lo_hi = df.agg(*[F.min(c).cast("double").alias(f"lo_{c}") for c in columns], *[F.max(c).cast("double").alias(f"hi_{c}") for c in columns])
    width = float((1 << bits) - 1)
    scaled = [F.coalesce(F.floor((F.col(c).cast("double") - F.col(f"lo_{c}")) / F.nullif(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(0.0)) * width), F.lit(0)).cast("long") for c in columns]
    keyed = df.crossJoin(F.broadcast(lo_hi)).withColumn("_z", z_key(scaled, bits)).drop(*lo_hi.columns)  # one row
    return keyed.repartitionByRange(partitions, "_z").sortWithinPartitions("_z").drop("_z")


def pages_scanned(df: DataFrame, order: list[str], page: int, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Pages of ``page`` rows, in this order, whose minima and maxima a box query must read: one row, pages and scanned."""
    p = global_row_number(df, order, "_rn").withColumn("_p", F.floor((F.col("_rn") - 1) / page)).groupBy("_p").agg(*[F.min(c).alias(f"lo_{c}") for c in ranges], *[F.max(c).alias(f"hi_{c}") for c in ranges])
    hit = F.lit(True)
    for c, (lo, hi) in ranges.items():
        hit = hit & (F.col(f"hi_{c}") >= lo) & (F.col(f"lo_{c}") <= hi)
    return p.agg(F.count("*").alias("pages"), F.count_if(hit).alias("scanned"))


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace only the partitions that the frame has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
