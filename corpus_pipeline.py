"""The corpus pipeline: documents in, clean and encoded documents out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. run() writes what a stage returns as Parquet
and reads it again for the next one, so that a lost executor costs a stage at
most and every stage sees the sizes of what it really reads.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import bpe, decontam, secrets, simhash, toxicity
from rivulet.llm.common import shared_folder, table
from rivulet.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity cut-off, each row by its own text: null and empty texts have none of it and stay.

    Repeated rows are judged alike; without labels of both classes all rows stay; an empty table gives none.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate group.

    Rows are told apart by id and text, and one of repeated rows is kept; rows without an id stay. Null, empty and
    wordless texts are one group. An empty table gives none.
    """
    return simhash.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and empty texts hold none and stay, as do repeated rows.

    An empty benchmark leaves all rows, an empty table none.
    """
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced and n_chars to match; no row goes, and null texts stay null."""
    return secrets.without_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the tokens of each row's text with their digests; a null text has no tokens."""
    coded = docs.select("doc_id", "lang", "source", bpe.coded(docs["text"], TOKENIZER).alias("c"))
    return coded.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length("c.ids") / 4).cast("long").alias("n_tokens"),
        F.col("c.ids").alias("ids"),
        F.sha2("c.ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("c.decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("secrets", redact_secrets),
    ("encoding", encode),
]

#: Compression distances, SimHash, edit distances, a random field and BPE are beyond SQL:
#: tests/llm compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _deleted(spark, f"{folder}/{k - 1}")
    return docs


def _deleted(spark: SparkSession, folder: str) -> None:
    """A stage's rows are not needed once the next stage's are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
