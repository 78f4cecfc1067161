"""Queries of the ten operators over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import ann, bpe, chat, exact_dedup, mixing, quality, secrets, simhash, substring_dedup, token_count
from gristmill.llm.common import documents

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def tokenizer(name: str) -> str:
    """Where the public vocabulary file lies on this machine and, by the same installation, on executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ann": lambda spark, d: ann.neighbours(table(spark, d, "embeddings")),
        "op2_quality": lambda spark, d: quality.quality_scores(documents(spark, d), table(spark, d, "labels")),
        "op3_exact_dedup": lambda spark, d: exact_dedup.exact_groups(documents(spark, d)),
        "op4_bpe": lambda spark, d: bpe.word_bpe_digest(spark, documents(spark, d), tokenizer(WORD_BPE)),
        "op5_secrets": lambda spark, d: secrets.secret_digest(documents(spark, d)),
        "op6_token_counts": lambda spark, d: token_count.token_counts(documents(spark, d), tokenizer(BYTE_BPE)),
        "op7_simhash": lambda spark, d: simhash.simhash_groups(documents(spark, d)),
        "op8_chat": lambda spark, d: chat.conversation_digest(chat.with_hard_case(spark, table(spark, d, "conversations"))),
        "op9_substring_dedup": lambda spark, d: substring_dedup.substring_dedup(documents(spark, d)),
        "op10_mixing": lambda spark, d: mixing.mix_plan(documents(spark, d)),
    }


def _secrets_sql() -> str:
    """Operator 5 in SQL: matches and the gaps between them give the spans, an interval semi join the links."""
    name = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    assign = rf"""(?:{name})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    # a blob is a whole run of 40: one that goes on or ends in = is none
    patterns = {
        "assign": assign, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+",
        "ident": r"""\b(?:client_?id|access_?key_?id|account(?:_?id)?|user_?name|login)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9@+/_.-]{3,}""",
        "blob": "[A-Za-z0-9+/]+=?", "endpoint": r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\x20\x09-\x0D"''<>]*""",
    }
    found = " UNION ALL ".join(f"SELECT rid, {i} AS kind, '{k}' AS name, regexp_extract_all(text, '{p}') AS hits, string_split_regex(text, '{p}') AS gaps FROM t" for i, (k, p) in enumerate(patterns.items()))
    return rf"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
        f AS ({found}),
        m AS (SELECT rid, kind, name, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, unnest(range(len(hits))) AS i FROM f),
        p AS (SELECT rid, kind, name, hit, length(hit) AS n, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS e FROM m),
        s AS (SELECT rid, kind, name, e - n AS a, e FROM p WHERE CASE name WHEN 'assign' THEN length(regexp_extract(hit, '^{assign}$', 1)) >= 12 WHEN 'access' THEN n >= 18 WHEN 'hex' THEN n >= 16
              WHEN 'blob' THEN n = 40 AND right(hit, 1) <> '=' AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[0-9]') ELSE true END),
        near AS (SELECT x.rid, x.kind, x.a, x.e, bool_or(y.name IN ('assign', 'hex', 'blob')) AS secret, bool_or(y.name IN ('access', 'ident')) AS identifier
              FROM s x JOIN s y ON x.rid = y.rid AND x.a <= y.e + 200 AND y.a <= x.e + 200 AND x.kind <> y.kind WHERE x.kind >= 3 GROUP BY ALL),
        kept AS (SELECT s.* FROM s LEFT JOIN near USING (rid, kind, a, e) WHERE s.kind < 3 OR (s.name = 'ident' AND secret) OR (s.name = 'blob' AND identifier) OR (s.name = 'endpoint' AND secret AND identifier)),
        g AS (SELECT rid, count(*) FILTER (name = 'assign') AS n_assign, count(*) FILTER (name = 'access') AS n_access, count(*) FILTER (name = 'hex') AS n_hex,
              string_agg(name || ':' || a || ':' || e, ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || a || ':' || e, ',' ORDER BY a, kind) AS spans FROM kept GROUP BY rid)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_secrets": _secrets_sql(),
        "op3_exact_dedup": r"""
            WITH t AS (SELECT doc_id, coalesce(text, '') AS raw FROM documents),
            h AS (SELECT doc_id, length(raw) AS n, sha256(regexp_replace(raw, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM t),
            r AS (SELECT doc_id, text_sha256, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id,
                         count(*) OVER (PARTITION BY text_sha256) AS group_size
                  FROM h WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
            SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r""",
        "op8_chat": r"""
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT -7, k, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS hard(k, r)),
            e AS (SELECT *, regexp_replace(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e'), '<((image|audio|document) \d+>)', '\\l\1', 'g') AS etext,
                         replace(regexp_replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), '<((image|audio|document) \d+>)', '\\l\1', 'g'), ':', '\c') AS erole FROM c)
            SELECT conv_id, count(*) AS n_turns,
                   sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, erole || etext)) AS turns_sha256,
                   CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, etext) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   CAST(sum(length('### ' || erole || ': ' || etext || ' </turn>' || chr(10))) AS BIGINT) AS formatted_chars
            FROM e GROUP BY conv_id""",
    }
