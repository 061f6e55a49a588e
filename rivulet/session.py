"""The session's settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Zone pinned, plans adaptive, state in RocksDB with a changelog.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def session(
    app: str = "rivulet",
    master: str | None = None,
    partitions: int | None = None,
    ui_port: int | None = None,
    **more: str,
) -> SparkSession:
    """A session with SETTINGS; master None leaves it to spark-submit, ui_port None turns the UI off."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {**SETTINGS, **more, "spark.ui.enabled": str(ui_port is not None).lower()}
    if ui_port is not None:
        settings["spark.ui.port"] = str(ui_port)
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
