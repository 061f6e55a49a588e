"""Sinks: console, memory, row files in hourly buckets, JDBC, and tables."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def printed(stream: DataFrame, prefix: str | None = None, mode: str = "append") -> DataStreamWriter:
    shown = stream.withColumn("prefix", F.lit(prefix)) if prefix else stream
    return shown.writeStream.format("console").outputMode(mode)


def in_memory(stream: DataFrame, name: str, mode: str = "append") -> DataStreamWriter:
    return stream.writeStream.format("memory").queryName(name).outputMode(mode)


def row_files(lines: DataFrame, path: str, checkpoint: str, seconds: int = 60, rows_per_file: int | None = None
              ) -> DataStreamWriter:
    """Text files in a folder for each hour of processing; rolled by trigger and row count.

    A file counts once the batch has committed it, and each batch once, across restarts.
    """
    hourly = lines.select("value", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH").alias("hour"))
    writer = (
        hourly.writeStream.format("text")
        .partitionBy("hour")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{seconds} seconds")
    )
    return writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer


def jdbc(options: dict[str, str], batch_rows: int = 100, retries: int = 3, pause: float = 1.0,
         batch_column: str | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends a batch in inserts of batch_rows, and tries again when the write fails.

    A failed write may have committed some rows. With batch_column the rows carry their batch's number, and what an
    earlier attempt has left of it is deleted first, so that each row counts once, across restarts too.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn(batch_column, F.lit(number).cast("long")) if batch_column else batch
        for left in reversed(range(retries + 1)):
            try:
                if batch_column:
                    _delete_batch(batch.sparkSession, options, batch_column, number)
                rows.write.format("jdbc").options(**options).option("batchsize", batch_rows).mode("append").save()
                return
            except Exception:
                if not left:
                    raise
                time.sleep(pause)

    return write


def _dialect(spark: SparkSession, options: dict[str, str]):
    """Spark's dialect of the database: how it quotes names and looks tables up."""
    return spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"])


def _connected(spark: SparkSession, options: dict[str, str]):
    jvm = spark.sparkContext._jvm
    if "driver" in options:
        jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(options["driver"])
    return jvm.java.sql.DriverManager.getConnection(options["url"], options.get("user"), options.get("password"))


def _there(dialect, link, table: str) -> bool:
    """Whether a table, named as in SQL, can be read."""
    try:
        link.createStatement().executeQuery(dialect.getTableExistsQuery(table)).close()
        return True
    except Exception:
        return False


def _delete_batch(spark: SparkSession, options: dict[str, str], column: str, number: int) -> None:
    """Removes the rows of a batch, if the table is there."""
    dialect, link = _dialect(spark, options), _connected(spark, options)
    try:
        if _there(dialect, link, options["dbtable"]):
            quoted = dialect.quoteIdentifier(column)
            link.createStatement().executeUpdate(f"DELETE FROM {options['dbtable']} WHERE {quoted} = {int(number)}")
    finally:
        link.close()


def commit_statements(dialect, table: str, staged: str, commits: str, columns: list[str], query: str, number: int
                      ) -> dict[str, str]:
    """The SQL of a batch's transaction, names quoted as the dialect does."""
    quoted = ", ".join(dialect.quoteIdentifier(c) for c in columns)
    of_query, of_batch = dialect.quoteIdentifier("query"), dialect.quoteIdentifier("batch")
    told = query.replace("'", "''")
    return {
        "create": f"CREATE TABLE {commits} ({of_query} VARCHAR(200) NOT NULL, {of_batch} BIGINT NOT NULL)",
        "done": f"SELECT count(*) FROM {commits} WHERE {of_query} = '{told}' AND {of_batch} = {int(number)}",
        "move": f"INSERT INTO {table} ({quoted}) SELECT {quoted} FROM {staged}",
        "commit": f"INSERT INTO {commits} ({of_query}, {of_batch}) VALUES ('{told}', {int(number)})",
        "drop": f"DROP TABLE {staged}",
    }


def jdbc_once(options: dict[str, str], query: str, batch_rows: int = 100, retries: int = 3, pause: float = 1.0
              ) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch exactly once into a table of any database with transactions.

    The tasks write a staging table of the batch, made anew by each attempt. Then one transaction moves its rows into
    the table and notes (query, batch) in <table>_commits; a batch that is noted is not moved again, after a failure
    or a restart. So the table needs no column for it. The table must exist, or is made from the first batch.
    """
    table = options["dbtable"]
    commits = f"{table}_commits"

    def write(batch: DataFrame, number: int) -> None:
        for left in reversed(range(retries + 1)):
            try:
                return attempt(batch, number)
            except Exception:
                if not left:
                    raise
                time.sleep(pause)

    def attempt(batch: DataFrame, number: int) -> None:
        spark, staged = batch.sparkSession, f"{table}_staged_{int(number)}"
        dialect, link = _dialect(spark, options), _connected(spark, options)
        try:
            sql = commit_statements(dialect, table, staged, commits, batch.columns, query, number)
            if not _there(dialect, link, commits):
                link.createStatement().executeUpdate(sql["create"])
            if not _there(dialect, link, table):
                _writer(batch.limit(0), table).mode("append").save()
            done = link.createStatement().executeQuery(sql["done"])
            done.next()
            if not done.getInt(1):
                done.close()
                _writer(batch, staged).mode("overwrite").save()
                link.setAutoCommit(False)
                for step in ("move", "commit"):
                    link.createStatement().executeUpdate(sql[step])
                link.commit()
                link.setAutoCommit(True)
            if _there(dialect, link, staged):
                link.createStatement().executeUpdate(sql["drop"])
        except Exception:
            if not link.getAutoCommit():
                link.rollback()
            raise
        finally:
            link.close()

    def _writer(rows: DataFrame, name: str):
        return rows.write.format("jdbc").options(**options | {"dbtable": name}).option("batchsize", batch_rows)

    return write


def once_per_batch(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: a folder for each batch, overwritten if the batch is run again; so its rows count once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def fan_out(outputs: dict[str, Callable[[DataFrame, int], None]], route: str = "route"
            ) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each route's rows to its own sink, from one computation of the batch."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for name, sink in outputs.items():
                sink(kept.where(F.col(route) == name).drop(route), number)
        finally:
            kept.unpersist()

    return write


def insert_into(df: DataFrame, name: str) -> None:
    """Appends a batch to a table by position."""
    df.write.insertInto(name)


def started(writer: DataStreamWriter, name: str | None = None) -> StreamingQuery:
    return (writer.queryName(name) if name else writer).start()
