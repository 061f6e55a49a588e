"""The numbered queries: thin callers of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rivulet.llm import (
    bpe,
    decontam,
    html_extract,
    lm,
    prefix_tree,
    quality_classifier,
    quality_rules,
    resample,
    secrets,
    simhash,
    topk,
    toxicity,
    url_filter,
)
from rivulet.llm.common import table

#: The tokenizer whose ids op8 and the pipeline give.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    listed = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_tree.prefix_tree(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_url_filter": op3_url_filter,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_simhash": op5_simhash,
    "op6_secrets": op6_secrets,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_bpe": op8_bpe,
    "op9_decontamination": op9_decontamination,
    "op10_html_text": op10_html_text,
    "op11_top_k": op11_top_k,
    "op12_resample": op12_resample,
    "op13_prefix_trie": op13_prefix_trie,
}


def _rule_sql(rule: quality_rules.Rule) -> str:
    tests = [f"{rule.part} * {rule.scale} >= {rule.whole} * {rule.low}"] if rule.low is not None else []
    tests += [f"{rule.part} * {rule.scale} <= {rule.whole} * {rule.high}"] if rule.high is not None else []
    return " AND ".join(tests)


def _quoted(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


OP1_SQL = rf"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)),
                       lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM documents
), spans AS (
    SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM cut)
), twice AS (
    SELECT doc_id, s FROM spans GROUP BY doc_id, s HAVING count(*) > 1
), covered AS (
    SELECT DISTINCT spans.doc_id, spans.i + k AS place
    FROM spans JOIN twice USING (doc_id, s), range(0, 8) AS r(k)
), repeats AS (
    SELECT doc_id, count(*) AS n FROM covered GROUP BY doc_id
), counted AS (
    SELECT cut.doc_id, len(w) AS n_words,
           length(array_to_string(w, '')) AS word_chars,
           length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
           len(lines) AS n_lines,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           coalesce(n, 0) AS n_repeat_words,
           len(list_filter(w, lambda x: lower(x) IN ({_quoted(quality_rules.STOP_WORDS)}))) AS n_stop_words,
           len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ellipsis_lines,
           len(list_filter(lines, lambda x: left(ltrim(x, ' '), 1) IN ('-', '*', '•'))) AS n_bullet_lines
    FROM cut LEFT JOIN repeats USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
       AND {" AND ".join(map(_rule_sql, quality_rules.RULES))} AS kept
FROM counted
"""

OP3_SQL = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN url LIKE '%://%' THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), split AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^([^/?#]*)', 1),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM cut
), rules(rule, verdict) AS (
    VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'),
           ('net/es/', 'block'), ('net/fr/', 'block')
), fits AS (
    SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
    FROM split, rules
    WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
      AND starts_with(path, substring(rule, strpos(rule, '/')))
    GROUP BY page_id
)
SELECT split.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN fits USING (page_id)
"""

OP11_SQL = """
WITH good AS (
    SELECT row_number() OVER () AS r, vec_id,
           list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.r, q.vec_id AS query_id, c.vec_id,
           coalesce(CAST(list_sum(list_transform(range(1, least(len(q.w), len(c.w)) + 1), lambda i: q.w[i] * c.w[i])) AS BIGINT), 0)
               AS score
    FROM good AS q, good AS c
    WHERE q.vec_id % 100 = 0 AND q.vec_id IS DISTINCT FROM c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""

#: crc32 of the bytes of a text: the table of its 256 values, and what a column's bytes make of it.
CRC_TABLE = """crc(t) AS (
    SELECT list(c ORDER BY n)
    FROM (SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) AS c
          FROM range(256) AS r(n))
)"""


def _crc(text: str) -> str:
    byte = f"CAST('0x' || substring(hex(encode({text})), 2 * i + 1, 2) AS BIGINT)"
    return (
        f"xor(4294967295, list_reduce(list_transform(range(octet_length(encode({text}))), lambda i: {byte}), "
        "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295))"
    )


OP12_SQL = rf"""
WITH {CRC_TABLE}, texts AS (
    SELECT row_number() OVER () AS r, doc_id, text FROM documents
    UNION ALL SELECT -row_number() OVER (), NULL, text FROM benchmark
), cut AS (
    SELECT r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM texts
), features AS (
    SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM cut
), buckets AS (
    SELECT f, {_crc("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM features), crc
), counted AS (
    SELECT bucket, count_if(r > 0) AS s, count_if(r < 0) AS t FROM features JOIN buckets USING (f) GROUP BY bucket
), gains AS (
    SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (all_s + 10000) / (CAST(s + 1 AS DOUBLE) * (all_t + 10000)))) AS BIGINT) AS gain
    FROM counted, (SELECT CAST(sum(s) AS DOUBLE) AS all_s, CAST(sum(t) AS DOUBLE) AS all_t FROM counted)
), weights AS (
    SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total
    FROM features JOIN buckets USING (f) JOIN gains USING (bucket) WHERE r > 0 GROUP BY r
), scored AS (
    SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features,
           coalesce((total - ((total % n) + n) % n) // n, 0) AS weight,
           CAST('0x' || left(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) AS h
    FROM cut LEFT JOIN weights USING (r) WHERE r > 0
), keyed AS (
    SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored
), placed AS (
    SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () * 25 // 100 AS drawn
    FROM keyed WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM keyed LEFT JOIN placed USING (r)
"""

OP13_SQL = rf"""
WITH {CRC_TABLE}, named AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
           sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS h
    FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS pos FROM named
), convs AS (
    SELECT conv_id, {_crc("CAST(conv_id AS VARCHAR)")} % 9 AS taken FROM (SELECT DISTINCT conv_id FROM turns), crc
), parts AS (
    SELECT c.conv_id, 0 AS own, pos, text, h FROM convs AS c JOIN turns AS g ON g.conv_id = c.conv_id - c.conv_id % 5 AND pos <= taken
    UNION ALL SELECT c.conv_id, 1, pos, text, h FROM convs AS c JOIN turns USING (conv_id) WHERE pos > taken
), rebuilt AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth FROM parts
), prefixes AS (
    SELECT conv_id, depth, octet_length(encode(text)) AS n_bytes,
           sha256(string_agg(h, ',') OVER (PARTITION BY conv_id ORDER BY depth)) AS d
    FROM rebuilt
    UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
    SELECT depth, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_bytes) AS n_bytes FROM prefixes GROUP BY depth, d
), above AS (
    SELECT n.conv_id AS below_conv, n.depth AS below_depth, n.n_convs, n.n_bytes, a.conv_id, a.depth
    FROM nodes AS n
    JOIN prefixes AS p ON p.conv_id = n.conv_id AND p.depth <= n.depth
    JOIN nodes AS a ON a.depth = p.depth AND a.d = p.d
), children AS (
    SELECT conv_id, depth, count(*) AS n FROM above WHERE below_depth = depth + 1 GROUP BY conv_id, depth
), totals AS (
    SELECT a.conv_id, a.depth, count_if(c.n IS NULL) AS n_leaves, sum((a.n_convs - 1) * n_bytes) AS saved
    FROM above AS a LEFT JOIN children AS c ON c.conv_id = below_conv AND c.depth = below_depth GROUP BY a.conv_id, a.depth
), ends AS (
    SELECT n.conv_id, n.depth, sha256(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)) AS ends_sha256
    FROM (SELECT conv_id, max(depth) AS depth, arg_max(d, depth) AS d FROM prefixes GROUP BY conv_id) AS p
    JOIN nodes AS n ON n.depth = p.depth AND n.d = p.d GROUP BY n.conv_id, n.depth
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes AS n
JOIN totals AS t ON t.conv_id = n.conv_id AND t.depth = n.depth
LEFT JOIN children AS c ON c.conv_id = n.conv_id AND c.depth = n.depth
LEFT JOIN ends AS e ON e.conv_id = n.conv_id AND e.depth = n.depth
LEFT JOIN above AS up ON up.below_conv = n.conv_id AND up.below_depth = n.depth AND up.depth = n.depth - 1
"""

ORACLES: dict[str, str] = {
    "op1_quality_rules": OP1_SQL,
    "op3_url_filter": OP3_SQL,
    "op11_top_k": OP11_SQL,
    "op12_resample": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
