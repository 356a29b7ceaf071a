"""One query per operator of this package, over the whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwright.llm import (
    exact_dedup,
    langid,
    licenses,
    merkle,
    mixing,
    packing,
    prefix_trie,
    pseudonyms,
    ranked_search,
    sharding,
    simhash,
    toxicity,
    url_rules,
)
from epochwright.llm.common import crc_of, table

KEY = b"a key for tests; in production it comes from a secret store"


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonyms(table(spark, sf_dir, "documents"), KEY)


def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_fingerprints(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"), crc_of() % 4 == 2)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), crc_of() % 5 != 0)
    return toxicity.scores(docs, model).select(
        "doc_id",
        F.coalesce(crc_of() % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads come from the first conversation of each five; their length is drawn from the id."""
    conv = F.col("conv")
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), conv - conv % 5, crc_of("conv") % 9)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return sharding.sharded(table(spark, sf_dir, "documents")).select(
        F.col("record.doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pseudonyms": op1_pseudonyms,
    "op2_merkle_fingerprints": op2_merkle_fingerprints,
    "op3_language_id": op3_language_id,
    "op4_packing": op4_packing,
    "op5_toxicity": op5_toxicity,
    "op6_source_mixing": op6_source_mixing,
    "op7_simhash_neardup": op7_simhash_neardup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_url_rules": op9_url_rules,
    "op10_license_scan": op10_license_scan,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_sharding": op12_sharding,
    "op13_lexical_search": op13_lexical_search,
}

SQL: dict[str, str] = {
    "op8_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
    "op11_prefix_trie": r"""
        WITH stored AS (
            SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                                      ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), headed AS (
            -- CRC-32 of the decimal digits, bit by bit
            SELECT c, turns, c - c % 5 AS base,
                   xor(list_reduce(
                       list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                       lambda crc, byte: list_reduce(
                           range(8), lambda v, bit: xor(v >> 1, 3988292384 * (v & 1)), xor(crc, byte)),
                       CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h
            FROM stored
        ), rebuilt AS (
            SELECT a.c, list_concat(list_slice(coalesce(b.turns, []), 1, a.h), list_slice(a.turns, a.h + 1, len(a.turns))) AS turns
            FROM headed a LEFT JOIN stored b ON a.base = b.c
        ), steps AS (
            SELECT c, unnest(range(len(turns) + 1)) AS depth, turns FROM rebuilt
        ), nodes AS (
            SELECT depth, list_slice(turns, 1, depth) AS prefix, min(c) AS conv_id, count(*) AS n_convs,
                   coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(turns) = depth), '') AS ends
            FROM steps GROUP BY 1, 2
        ), kin AS (
            SELECT n.*, p.conv_id AS parent_conv_id,
                   (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND list_slice(k.prefix, 1, n.depth) = n.prefix) AS n_children
            FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = list_slice(n.prefix, 1, n.depth - 1)
        ), above AS (
            SELECT unnest(range(depth + 1)) AS depth, prefix, (n_children = 0)::BIGINT AS leaf,
                   (n_convs - 1) * (CASE WHEN depth = 0 THEN 0 ELSE strlen(prefix[depth].t) END) AS saved
            FROM kin
        ), sums AS (
            SELECT depth, list_slice(prefix, 1, depth) AS prefix, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
            FROM above GROUP BY 1, 2
        )
        SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(ends) AS ends_sha256
        FROM kin JOIN sums USING (depth, prefix)
    """,
    "op13_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), total AS (
            SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d WHERE len(words) > 0
        ), tf AS (
            SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM d) GROUP BY 1, 2
        ), items AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), df AS (
            SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
            FROM tf, total GROUP BY term, n_docs
        ), scored AS (
            SELECT item_id, row, doc_id,
                   sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(words) * n_docs) // n_terms))))::BIGINT AS score
            FROM items JOIN df USING (term) JOIN tf USING (term) JOIN d USING (row), total
            GROUP BY ALL
        ), ranked AS (
            SELECT item_id, doc_id, score,
                   row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
            FROM scored WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
}
