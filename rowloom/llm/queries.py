"""One query for each operator over the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rowloom.llm import (
    bpe,
    decontaminate,
    language,
    licenses,
    main_text,
    merge_automaton,
    near_dup,
    pii,
    prefix_trie,
    quality,
    ranked_search,
    token_store,
    warc,
)
from rowloom.llm.common import table


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_passages(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op2_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents"))


def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(
        table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(table(spark, folder, "pages"))


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find_personal_data(table(spark, folder, "documents"))


def op6_token_store(spark: SparkSession, folder: str) -> DataFrame:
    return token_store.store_and_read(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_and_read(table(spark, folder, "pages"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.learn_and_judge(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"))


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(
        table(spark, folder, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op11_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


def op12_automaton(spark: SparkSession, folder: str) -> DataFrame:
    return merge_automaton.round_trip(
        table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


ALL = (
    op1_decontaminate,
    op2_licenses,
    op3_language,
    op4_main_text,
    op5_pii,
    op6_token_store,
    op7_warc,
    op8_quality,
    op9_near_dedup,
    op10_bpe,
    op11_search,
    op12_automaton,
    op13_prefix_trie,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in ALL}
ORACLE: dict[str, str] = {
    "op7_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
o AS (SELECT *, CASE WHEN payload_bytes >= 1000
  THEN max(page_id) OVER (PARTITION BY payload_digest) END AS largest FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN largest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN largest <> page_id THEN largest END AS refers_to FROM o""",
    "op11_search": r"""WITH i AS (SELECT row_number() OVER () AS i, item_id, text
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
all_texts AS (SELECT i, NULL AS r, item_id AS id, text FROM i
  UNION ALL SELECT NULL, row_number() OVER (), doc_id, text FROM documents),
w AS (SELECT i, r, id, unnest(regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM all_texts),
q AS (SELECT DISTINCT i, id AS item_id, term FROM w WHERE i IS NOT NULL),
tf AS (SELECT r, id AS doc_id, term, count(*) AS tf FROM w WHERE r IS NOT NULL GROUP BY ALL),
n AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, s GROUP BY term, docs),
m AS (SELECT r, 10 + (90 * n * docs) // words AS m FROM n, s),
score AS (SELECT i, item_id, r, doc_id,
  sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT *, (row_number() OVER (PARTITION BY i
  ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
    "op13_prefix_trie": """WITH own AS (SELECT conv_id, list({'role': role, 'text': text}
  ORDER BY turn NULLS FIRST, role, text) AS s
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
h AS (SELECT conv_id, s, xor(list_reduce(
  list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda x, c: list_reduce(list_prepend(xor(x, c), range(8)),
    lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)), 4294967295) % 9 AS h
  FROM own),
seq AS (SELECT h.conv_id, list_concat(coalesce(b.s[1:h], []), h.s[h + 1:]) AS s
  FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5),
member AS (SELECT conv_id, s, unnest(range(len(s) + 1)) AS depth FROM seq),
node AS (SELECT depth, s[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
    FILTER (WHERE len(s) = depth), '')) AS ends_sha256
  FROM member GROUP BY ALL),
kids AS (SELECT depth - 1 AS depth, p[1:depth - 1] AS p, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n, 0) AS n_children,
  CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(p[depth].text) ELSE 0 END AS own_saved
  FROM node LEFT JOIN kids USING (depth, p)),
up AS (SELECT p, n_children, own_saved, unnest(range(depth + 1)) AS depth FROM full_node),
below AS (SELECT depth, p[1:depth] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
  sum(own_saved)::BIGINT AS saved_tokens FROM up GROUP BY ALL)
SELECT a.conv_id, a.depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves,
  saved_tokens, a.ends_sha256
FROM full_node a JOIN below USING (depth, p)
LEFT JOIN node b ON b.depth = a.depth - 1 AND b.p = a.p[1:a.depth - 1]""",
}
