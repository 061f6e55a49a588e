"""User-defined functions of four kinds: scalar, table, aggregate and table-aggregate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivulet.operators.topn import table_top
from rivulet.operators.transforms import java_split


def java_hash(text: Column) -> Column:
    """The 32-bit hash 31 * h + unit over a string's UTF-16 units, without Python."""
    coded = F.hex(F.encode(text, "UTF-16BE"))
    starts = F.sequence(F.lit(1), F.greatest(F.length(coded) - 3, F.lit(1)), F.lit(4))
    units = F.transform(starts, lambda i: F.conv(F.substring(coded, i, F.lit(4)), 16, 10).cast("long"))
    wrapped = lambda h: F.pmod(h + (1 << 31), F.lit(1 << 32)) - (1 << 31)
    fold = F.aggregate(units, F.lit(0).cast("long"), lambda h, u: wrapped(h * 31 + u))
    return F.when(text == "", F.lit(0)).otherwise(fold.cast("int"))


def split_words(text: Column) -> Column:
    """Table function: array of (word, length)."""
    return F.transform(java_split(text), lambda w: F.struct(w.alias("word"), F.length(w).alias("length")))


def weighted_avg(score: Column, weight: Column) -> Column:
    """Aggregate function: null for a zero total weight."""
    return F.try_divide(F.sum(score.cast("long") * weight).cast("double"), F.sum(weight.cast("long")))


@F.pandas_udf(T.DoubleType())
def weighted_avg_udf(score: pd.Series, weight: pd.Series) -> float:
    """The same as a grouped-aggregate function, for SQL."""
    total = weight.sum()
    return float((score * weight).sum() / total) if total else float("nan")


@F.udtf(returnType=T.StructType([T.StructField("word", T.StringType()), T.StructField("length", T.IntegerType())]))
class SplitWords:
    """The table function as SQL calls it: LATERAL split_words(text)."""

    def eval(self, text: str):
        if text is None or text and not text.strip(" "):
            return
        for word in text.rstrip(" ").split(" "):
            yield word, len(word)


def top2(df: DataFrame, value: str) -> DataFrame:
    """Table-aggregate function."""
    return table_top(df, [], value, 2)


def register(spark: SparkSession) -> None:
    """Names for SQL: java_hash (a SQL function), weighted_avg and split_words."""
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION java_hash(s STRING) RETURNS INT RETURN
        CASE WHEN s = '' THEN 0 ELSE CAST(aggregate(
            transform(sequence(0, octet_length(encode(s, 'UTF-16BE')) div 2 - 1),
                      i -> CAST(conv(substring(hex(encode(s, 'UTF-16BE')), CAST(i AS INT) * 4 + 1, 4), 16, 10) AS BIGINT)),
            CAST(0 AS BIGINT),
            (h, u) -> pmod(h * 31 + u + 2147483648, 4294967296) - 2147483648) AS INT) END
    """)
    spark.udf.register("weighted_avg", weighted_avg_udf)
    spark.udtf.register("split_words", SplitWords)
