"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terselake.llm import byte_bpe, decontaminate, html_extract, id_store, quality, secrets, simhash, token_counts, topk, toxicity
from terselake.llm.common import held_out, table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_token_counts(spark: SparkSession, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), token_counts.sentencepiece_vocabulary(public_tokenizers.path(model)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _judged(quality.score(docs, model), 0.3)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _judged(toxicity.score(docs, model), 0.5)


def op9_id_store(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    store = id_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))
    return id_store.checksums(spark, store).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(ranks), public_tokenizers.PATTERN)


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_token_counts": op2_token_counts,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_html": op5_html,
    "op6_simhash": op6_simhash,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity": op8_toxicity,
    "op9_id_store": op9_id_store,
    "op10_byte_bpe": op10_byte_bpe,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: RE2 folds more than ASCII, so the keywords are spelled out.
_ASSIGN_SQL = "(" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _located_sql(pattern: str, rank: int, keep: str) -> str:
    """Spans of a pattern over d(doc_id, t): offsets are sums of the lengths of the pieces between the matches."""
    value = f"regexp_extract_all(t, '{pattern}', 2)" if rank == 0 else "m"
    return f"""SELECT doc_id, {{'start': s, 'rank': {rank}, 'stop': s + n, 'kind': '{secrets.KINDS[rank]}'}} AS span FROM (
        SELECT doc_id, length(m[i]) AS n, v[i] AS c, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, {value} AS v FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}', 0) AS m, string_split_regex(t, '{pattern}') AS g FROM d)))) WHERE {keep}"""


_WINDOW_CLOG = f"list_sum(list_transform(string_split(w, ''), lambda ch: log2({secrets.WINDOW} - length(replace(w, ch, '')))))"
_RANDOM_SQL = (
    "regexp_matches(c, '[0-9]') AND regexp_matches(c, '[A-Za-z]') AND NOT (" + " OR ".join(f"regexp_matches(c, '{p.replace(')*+', ')*')}')" for p in secrets.ALLOWED) + ") AND "
    f"list_min(list_transform(list_transform(range(1, length(c) - {secrets.WINDOW - 2}), lambda k: substr(c, k, {secrets.WINDOW})), lambda w: {_WINDOW_CLOG})) "
    f"<= (log2({secrets.WINDOW}) - CASE WHEN regexp_full_match(c, '[0-9A-Fa-f]+') THEN {secrets.HEX_BITS}::DOUBLE ELSE {secrets.MIXED_BITS}::DOUBLE END) * {secrets.WINDOW} + 1e-9"
)
_JOINED_SQL = "coalesce(string_agg(span.kind || ':' || span.start || ':' || span.stop, ',' ORDER BY span.start, span.rank), '')"
_SECRETS_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    base AS ({_located_sql(_ASSIGN_SQL, 0, "length(c) >= 6")} UNION ALL {_located_sql(secrets.ACCESS, 1, "n >= 20")} UNION ALL {_located_sql(secrets.HEX, 2, "true")}),
    added AS ({_located_sql(secrets.CANDIDATE, 3, _RANDOM_SQL)}),
    every AS (SELECT * FROM base UNION ALL SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = a.doc_id AND b.span.start < a.span.stop AND a.span.start < b.span.stop)),
    b AS (SELECT doc_id, count(*) FILTER (span.rank = 0) AS n_assign, count(*) FILTER (span.rank = 1) AS n_access, count(*) FILTER (span.rank = 2) AS n_hex, {_JOINED_SQL} AS j FROM base GROUP BY doc_id),
    e AS (SELECT doc_id, {_JOINED_SQL} AS spans, count(*) FILTER (span.rank = 3) AS n_entropy FROM every GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(j, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0) AS n_entropy
    FROM d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id
"""
_WORDS_SQL = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_OVERLAPS_SQL = f"""
    WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark WHERE item_id IS NOT NULL),
    iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
    d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
    dw AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d JOIN (SELECT DISTINCT n FROM iw) l ON len(w) >= n)),
    h AS (SELECT doc_id, k, dw.n, item FROM dw JOIN iw ON iw.n = dw.n AND iw.g = dw.g),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY doc_id),
    it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op4_secrets": _SECRETS_SQL,
    "op7_decontaminate": _OVERLAPS_SQL,
}
