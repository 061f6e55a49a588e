"""Quality rules: one table of thresholds compiled into one Spark projection.

Everything is a built-in function on the row, so the scan is followed by
projections alone: no shuffle, no Python. Repeated windows are found inside the
row by hashing, in n log n steps of the document's words.

Defined results: a null text counts as empty, an empty one has no words and
fails the base rule, a null doc_id is passed on, repeated rows give repeated
rows, an empty table gives none, and columns other than the id and the text are
never read.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import SPACES, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    dict.fromkeys(
        (
            "the of and to a in is it that for with as was on by be this are from at or an not have "
            "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden "
            "de la le et les des en un du une que est pour qui dans par sur pas plus au avec ne se ce "
            "el y los del las por con no su para al lo como más o pero sus una"
        ).split()
    )
)


class Rule(NamedTuple):
    """part * scale must lie between low * whole and high * whole (None: no bound)."""

    name: str
    part: str
    whole: str
    scale: int
    low: int | None
    high: int | None


#: The threshold table. Bounds are whole numbers, so that every engine decides alike.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 10, 15, 140),
    Rule("symbols per word", "n_symbols", "n_words", 100, None, 12),
    Rule("stop words per word", "n_stop_words", "n_words", 100, 3, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", 100, None, 40),
    Rule("lines that end in an ellipsis", "n_ellipsis_lines", "n_lines", 100, None, 30),
    Rule("lines that begin with a bullet", "n_bullet_lines", "n_lines", 100, None, 90),
)

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column, window: int) -> Column:
    """Words covered by the windows whose hash occurs twice or more."""

    def twice(s: Column, x: Column, k: Column) -> Column:
        same = lambda other: F.coalesce(F.get(s, other)["h"] == x["h"], F.lit(False))
        return same(k - 1) | same(k + 1)

    def starts(s: Column) -> Column:
        marked = F.transform(s, lambda x, k: F.when(twice(s, x, k), x["i"]))
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - i, F.lit(window))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(hashes) == F.size(F.array_distinct(hashes)), F.lit(0)).otherwise(
        _let(_let(pairs, starts), covered)
    )


def _window_hashes(word_hashes: Column) -> Column:
    """A hash of every WINDOW = 8 adjacent words, by joining spans of 1, 2 and 4."""

    def joined(span: int):
        return lambda h: F.zip_with(h, F.slice(h, span + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))

    spans = _let(_let(_let(word_hashes, joined(1)), joined(2)), joined(4))
    whole = F.slice(spans, F.lit(1), F.size(word_hashes) - F.lit(WINDOW - 1))
    return F.when(F.size(word_hashes) >= WINDOW, whole).otherwise(F.array().cast("array<bigint>"))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that the rules compare, a row for each row of docs."""
    text = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("t"))
    cut = text.select(
        "doc_id",
        words(F.col("t")).alias("w"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
        (F.size(F.split("t", "[" + SYMBOLS + "]", -1)) - 1).alias("n_symbols"),
    )
    counted = cut.select(
        "doc_id",
        "n_symbols",
        F.size("w").alias("n_words"),
        F.aggregate("w", F.lit(0), lambda n, x: n + F.length(x)).alias("word_chars"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h1"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(*STOP_WORDS))).alias("n_stop_words"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias(
            "n_ellipsis_lines"
        ),
        F.size(F.filter("lines", lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•"))).alias(
            "n_bullet_lines"
        ),
    )
    hashed = counted.withColumn("hashes", _window_hashes(F.col("h1"))).drop("h1")
    return hashed.withColumn("n_repeat_words", _repeat_words(F.col("hashes"), WINDOW)).drop("hashes")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression over the measures."""

    def holds(rule: Rule) -> Column:
        part, whole = F.col(rule.part).cast("long") * rule.scale, F.col(rule.whole).cast("long")
        tests = [part >= whole * rule.low] if rule.low is not None else []
        tests += [part <= whole * rule.high] if rule.high is not None else []
        return reduce(and_, tests, F.lit(True))

    return reduce(and_, (holds(rule) for rule in rules), F.lit(True))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row of docs."""
    found = measures(docs, id_col, text_col)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = found.select(
        "doc_id",
        *[F.col(c).cast("long").alias(c) for c in counts],
        verdict(rules).alias("passes"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    return judged.withColumn("base_failed", failed).select(
        "doc_id", *counts, "base_failed", (~F.col("base_failed") & F.col("passes")).alias("kept")
    )
