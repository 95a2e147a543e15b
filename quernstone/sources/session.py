"""A session with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def plain_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """ANSI on, UTC, adaptive execution, RocksDB state store, checkpointed lineage where a folder is given."""
    base = {
        "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    return SparkSession.builder.master(master).config(map=base | conf).getOrCreate()
