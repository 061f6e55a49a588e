"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every contract of this subpackage.
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"

#: Rows and characters that a task works on at once. A longer text is a part by itself.
PART_ROWS, PART_CHARS = 256, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_parts(batches: Iterable[pd.Series]) -> Iterator[pd.Series]:
    """The texts of Arrow batches, some at a time: Spark bounds a batch's bytes, but not what is made of it."""
    for texts in batches:
        start, chars = 0, 0
        for end, text in enumerate(texts):
            chars += len(text or "")
            if end > start and (chars > PART_CHARS or end - start == PART_ROWS):
                yield texts.iloc[start:end]
                start, chars = end, len(text or "")
        if start < len(texts):
            yield texts.iloc[start:]


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of its own only for a local session that names none."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="rivulet-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def released(df: DataFrame) -> None:
    """Deletes what a checkpointed df was read from, once what was made of it is checkpointed itself."""
    rdd = df._jdf.queryExecution().logical().rdd()
    if rdd.getCheckpointFile().isDefined():
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(rdd.getCheckpointFile().get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The maximal runs of characters outside SPACES, in order."""
    trimmed = F.btrim(text, F.lit(SPACES))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, SPACE_CLASS + "+"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(-1))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    folds: int,
    held_out: int,
    per_class: int,
    salt: str,
    max_chars: int | None = None,
) -> DataFrame:
    """(doc_id, text, label) of at most per_class labelled documents of each class.

    The ids are chosen among the labelled rows outside the held-out fold, in the
    order of a hash, before any text is read; the at most 2 * per_class ids are
    then broadcast to the documents. max_chars leaves longer documents out of
    the sample, which bounds its bytes.
    """
    ranked = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .where(remainder(F.col("doc_id"), folds) != held_out)
        .withColumn("order", F.xxhash64(F.col("doc_id"), F.lit(salt)))
    )
    parts = [ranked.where(F.col("label") == k).orderBy("order", "doc_id").limit(per_class) for k in (0, 1)]
    chosen = parts[0].union(parts[1]).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if max_chars is not None:
        texts = texts.where(F.length("text") <= max_chars)
    return texts.join(F.broadcast(chosen), "doc_id")
