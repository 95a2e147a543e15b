"""Session plumbing shared by the operators: code shipping, sizes, shared folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import quernstone

BATCH = 1000


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once a SparkContext, through Spark's own file server."""
    # Batches of at most so many texts: some are very long.
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, BATCH + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    sc = spark.sparkContext
    if getattr(sc, "_quernstone_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(quernstone.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quernstone"), "quernstone_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._quernstone_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); in local mode (tests), where it is unset, one is made; on a cluster that is an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if base is None:
        held = sc._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="quernstone_ckpt")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what stands there goes when the driver ends, if nothing removes it before."""
    path = f"{shared_dir(spark).rstrip('/')}/quernstone/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_swept, spark)
    _scratch.add(path)
    return path


_scratch: set[str] = set()


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _swept(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is None:  # stopped: the folder's own retention applies
        return
    for path in list(_scratch):
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session is going away
            return


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by written()."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        _delete(spark, f)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size of what the plan reads; where it knows none (rows that come from no file), a job counts the bytes of the texts.

    Only used to choose how many groups to deal rows to.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    if all(0 < x < 1 << 60 for x in sizes):  # larger: Spark knows no size
        return sum(sizes)
    texts = [c for c, t in df.dtypes if t in ("string", "binary")]
    total = sum((F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`"))), F.lit(0)) for c in texts), F.count("*") * 8)
    return int(df.agg(total).first()[0])


def lowest(rows: DataFrame, number: Column, many: int, total: int) -> DataFrame:
    """The ``many`` rows of lowest ``number`` (a 64-bit hash) of ``total``; tasks pass on only rows that can be among them.

    Of evenly spread hashes four times as many as asked lie below the bound, so fewer
    than ``many`` lie there with no chance worth a name.
    """
    return rows.filter(number <= F.lit(hash_bound(4 * many / max(total, 1)))).orderBy(number).limit(many)


def hash_bound(share: float) -> int:
    """Below which this share of signed 64-bit hashes lies."""
    return (1 << 63) - 1 if share >= 1 else int(share * 2.0**64) - (1 << 63)


def release() -> None:
    """Give memory that a worker has freed back to the system, where its allocators can."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
