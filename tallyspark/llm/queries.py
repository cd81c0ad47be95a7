"""The operators over the given tables, with production parameters: name, plan and, where it can be stated, SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, langid, lines, lm, packing, quality, search, sharding, simhash, substrings, tokens, toxicity, trie
from .common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(plan: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


@query("op1_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(documents(spark, folder))


@query("op2_simhash")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicate_table(documents(spark, folder))


@query("op3_quality")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_table(documents(spark, folder), table(spark, folder, "labels"))


@query(
    "op4_line_dedup",
    r"""
    WITH cut AS (
        SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
    ), line AS (
        SELECT doc_id, unnest(ls) AS l, CAST(unnest(range(len(ls))) AS INTEGER) AS i FROM cut
    ), judged AS (
        SELECT doc_id, i, list_sort(list_distinct(list_filter(
            string_split_regex(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != ''))) AS w
        FROM line
    ), sets AS (
        SELECT w, len(w) AS n, min((doc_id, i)) AS place, row_number() OVER (ORDER BY min((doc_id, i))) AS id
        FROM judged WHERE len(w) > 0 GROUP BY w
    ), word AS (
        SELECT id, n, unnest(w) AS x FROM sets
    ), rare AS (
        SELECT x, count(*) AS c FROM word GROUP BY x
    ), prefix AS (
        SELECT id, x FROM (SELECT id, n, x, row_number() OVER (PARTITION BY id ORDER BY c, x) AS r FROM word JOIN rare USING (x))
        WHERE r <= n - (4 * n + 4) // 5 + 1
    ), pairs AS (
        SELECT DISTINCT a.id AS a, b.id AS b FROM prefix a JOIN prefix b ON a.x = b.x AND a.id < b.id
    ), alike AS (
        SELECT DISTINCT b AS id FROM pairs JOIN sets p ON p.id = a JOIN sets q ON q.id = b
        WHERE len(list_intersect(p.w, q.w)) * 5 >= (p.n + q.n - len(list_intersect(p.w, q.w))) * 4
    ), gone AS (
        SELECT doc_id, count(*) AS c, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS removed
        FROM judged JOIN sets USING (w) WHERE (doc_id, i) != place OR id IN (SELECT id FROM alike) GROUP BY doc_id
    )
    SELECT doc_id, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, coalesce(c, 0) AS n_removed, coalesce(removed, '') AS removed
    FROM cut LEFT JOIN gone USING (doc_id)
    """,
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.line_table(documents(spark, folder))
    return found.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


@query("op5_token_output")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    segments = tokens.write_tokens(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))
    return tokens.read_digests(segments)


@query("op6_sharding")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, folder))


@query(
    "op7_substring_dedup",
    r"""
    WITH words AS (
        SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w FROM documents
    ), windows AS (
        SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words)
    ), later AS (
        SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM windows) WHERE r > 1
    ), gone AS (
        SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM later)
    ), kept AS (
        SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
        FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(t, '')) AS kept_sha256
    FROM words LEFT JOIN kept USING (doc_id)
    """,
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeats_table(documents(spark, folder))


@query("op8_toxicity")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_table(documents(spark, folder), table(spark, folder, "labels"))


@query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return langid.language_table(documents(spark, folder))


@query(
    "op9_decontamination",
    r"""
    WITH items AS (
        SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM benchmark
    ), docs AS (
        SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents
    ), item AS (
        SELECT item_id, n, o, array_to_string(w[o + 1:o + 5], ' ') AS g FROM (SELECT *, len(w) AS n, unnest(range(len(w) - 4)) AS o FROM items)
    ), doc AS (
        SELECT doc_id, size, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS g FROM (SELECT *, len(w) AS size, unnest(range(len(w) - 4)) AS pos FROM docs)
    ), windows AS (
        SELECT DISTINCT doc_id, item_id, greatest(pos - o, 0) AS s, least(n, size - greatest(pos - o, 0)) AS n FROM doc JOIN item USING (g)
    ), parts AS (
        SELECT v.doc_id, item_id, s, n, g, count(*) AS a, 0 AS b FROM windows v JOIN doc d ON v.doc_id = d.doc_id AND pos BETWEEN s AND s + n - 5 GROUP BY ALL
        UNION ALL
        SELECT doc_id, item_id, s, v.n, g, 0, count(*) FROM windows v JOIN item i USING (item_id) GROUP BY ALL
    ), weights AS (
        SELECT doc_id, item_id, s, n, g, sum(a) AS a, sum(b) AS b FROM parts GROUP BY ALL
    ), alike AS (
        SELECT doc_id, item_id, s, n, CAST(sum(least(a, b)) AS DOUBLE) / CAST(sum(greatest(a, b)) AS DOUBLE) AS similarity FROM weights GROUP BY ALL
    )
    SELECT doc_id, item_id, similarity, CAST(s AS INTEGER) AS start, CAST(n AS INTEGER) AS n_words FROM alike WHERE similarity >= 0.8
    QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s, n DESC) = 1
    """,
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(documents(spark, folder), table(spark, folder, "benchmark"))


@query(
    "op11_prefix_trie",
    r"""
    WITH turns AS (
        SELECT conv_id, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
        FROM conversations WHERE conv_id IS NOT NULL
    ), convs AS (
        SELECT conv_id, xor(list_reduce(
            list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
            lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))
        ), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)
    ), parts AS (
        SELECT c.conv_id, 0 AS part, t, d, text FROM convs c JOIN turns s ON s.conv_id = c.conv_id - c.conv_id % 20 AND t <= h
        UNION ALL SELECT c.conv_id, 1, t, d, text FROM convs c JOIN turns s ON s.conv_id = c.conv_id AND t > h
    ), paths AS (
        SELECT conv_id, row_number() OVER w AS depth, string_agg(d, '') OVER w AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
        FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY part, t ROWS UNBOUNDED PRECEDING)
        UNION ALL SELECT conv_id, 0, '', 0 FROM convs
    ), nodes AS (
        SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, max(words) AS words FROM paths GROUP BY path, depth
    ), children AS (
        SELECT path[:-65] AS path, count(*) AS k FROM nodes WHERE depth > 0 GROUP BY 1
    ), below AS (
        SELECT p.path, sum(CAST(k IS NULL AS INTEGER)) AS leaves, sum((n - 1) * v.words) AS saved
        FROM nodes v LEFT JOIN children c ON c.path = v.path JOIN paths p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.path
    ), ends AS (
        SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
        FROM (SELECT conv_id, path FROM paths QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY path
    )
    SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n AS n_convs, coalesce(k, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
           CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM nodes v JOIN below USING (path) LEFT JOIN children USING (path) LEFT JOIN ends USING (path)
    LEFT JOIN nodes u ON v.depth > 0 AND u.path = v.path[:-65]
    """,
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return trie.trie_table(table(spark, folder, "conversations"))


@query(
    "op12_lexical_search",
    r"""
    WITH item AS (
        SELECT item_id, t, count(*) AS q FROM (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL
    ), found AS (
        SELECT r, doc_id, t, count(*) AS tf FROM (
            SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
            FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)) GROUP BY ALL
    ), doc AS (
        SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM found GROUP BY r
    ), corpus AS (
        SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM doc
    ), weight AS (
        SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM found, corpus GROUP BY t, docs
    ), scored AS (
        SELECT item_id, r, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
        FROM item JOIN weight USING (t) JOIN found USING (t) JOIN doc USING (r), corpus GROUP BY ALL
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 20
    """,
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return search.search_table(documents(spark, folder), table(spark, folder, "benchmark"))


@query("op13_lm_scoring")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return lm.scores(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
