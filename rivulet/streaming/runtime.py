"""Running, stopping and restarting streams."""

from __future__ import annotations

import tempfile
import time
from collections import deque
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from rivulet.session import SETTINGS
from rivulet.sinks.writers import once_per_batch


def live_session(spark: SparkSession) -> SparkSession:
    """A session beside the given one, whose settings stay as they are, with what keyed state in streams needs."""
    beside = spark.newSession()
    for key, value in SETTINGS.items():
        if key.startswith("spark.sql."):
            beside.conf.set(key, value)
    beside.conf.set("spark.sql.shuffle.partitions", spark.sparkContext.defaultParallelism)
    return beside


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or for a local session that has none, here."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="rivulet-")
    return f"{named}/live-{uuid4().hex}"


def finished(stream: DataFrame, mode: str = "append",
             sink: Callable[[str], Callable[[DataFrame, int], None]] = once_per_batch, schema: str | None = None
             ) -> DataFrame:
    """All that a stream gives for the input that is there, as a table: each batch in a folder of its own.

    sink makes the function for foreachBatch from the folder; schema: of what it writes, if not the stream's.
    """
    folder = scratch(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).foreachBatch(sink(f"{folder}/rows"))
    available_now(writer, f"{folder}/checkpoint")
    rows = stream.sparkSession.read.schema(schema or stream.schema).parquet(f"{folder}/rows")
    return rows if schema else rows.select(*stream.columns)


def available_now(writer: DataStreamWriter, checkpoint: str, name: str | None = None) -> StreamingQuery:
    """Everything that is there, in as many batches as the source makes, then the end.

    Not for state that lives by the clock: its batches never end.
    """
    named = writer.queryName(name) if name else writer
    query = named.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def every(writer: DataStreamWriter, seconds: float) -> DataStreamWriter:
    """A batch, and with it a new watermark, at most once in so many seconds."""
    return writer.trigger(processingTime=f"{seconds} seconds")


def either(batch: Callable[[], DataFrame], stream: Callable[[], DataFrame], streaming: bool,
           transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One transformation over a bounded or an unbounded input."""
    return transform(stream() if streaming else batch())


def run_all(writers: list[DataStreamWriter]) -> list[StreamingQuery]:
    """Several queries at once; the caller waits for them."""
    return [w.start() for w in writers]


def supervised(start: Callable[[], StreamingQuery], failures: int = 10, within: float = 600.0, pause: float = 10.0,
               sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic
               ) -> StreamingQuery:
    """Starts a query again from its checkpoint when it fails, unless it failed too often in the last seconds."""
    failed: deque[float] = deque()
    while True:
        query = start()
        try:
            query.awaitTermination()
            return query
        except Exception:
            now = clock()
            failed.append(now)
            while failed and failed[0] < now - within:
                failed.popleft()
            if len(failed) > failures:
                raise
            sleep(pause)


def _paths(spark: SparkSession, *names: str) -> tuple:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(n) for n in names]
    return jvm.org.apache.hadoop.fs.FileUtil, conf, [(p.getFileSystem(conf), p) for p in paths]


def savepoint(spark: SparkSession, checkpoint: str, target: str) -> None:
    """A copy of a stopped query's checkpoint. A query that takes it, or a copy of it, as its checkpoint starts there."""
    files, conf, ((source_fs, source), (to_fs, to)) = _paths(spark, checkpoint, target)
    files.copy(source_fs, source, to_fs, to, False, conf)


def delete_checkpoint(spark: SparkSession, checkpoint: str) -> None:
    """Checkpoints outlive their query; this removes one whose query shall not go on."""
    _, _, ((fs, path),) = _paths(spark, checkpoint)
    fs.delete(path, True)
