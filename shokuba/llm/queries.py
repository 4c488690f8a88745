"""The registered queries of the text operators and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shokuba.llm.centroids import cluster_report
from shokuba.llm.conversations import repair_conversations
from shokuba.llm.decontaminate import find_leaks
from shokuba.llm.exact_dedup import exact_duplicates
from shokuba.llm.html_text import extract_pages
from shokuba.llm.language import language_id
from shokuba.llm.packing import pack
from shokuba.llm.pieces import piece_digests
from shokuba.llm.pii import find_personal_data
from shokuba.llm.quality import score_documents
from shokuba.llm.simhash import near_duplicates
from shokuba.llm.substring_dedup import remove_repeats
from shokuba.llm.url_filter import judge_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_pages(_table(spark, sf_dir, "pages"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), window=35)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents")).drop("row")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as damaged and repaired; nulls, ties and empty conversations as `repair_conversations` says."""
    return repair_conversations(_table(spark, sf_dir, "conversations"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 centroids, 5 rounds; vectors that are not 64 finite components have no row."""
    return cluster_report(_table(spark, sf_dir, "embeddings"), k=40, rounds=5)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text to ids and back; null and empty texts are the end id alone."""
    return piece_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_benchmark_decontamination, op3_pii, op4_url_filters, op5_simhash_near_dedup, op6_quality_classifier, op7_language_id, op8_packing,
        op9_substring_dedup, op10_exact_dedup, op11_conversation_repair, op12_centroid_clustering, op13_sentencepiece,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": r"""
        WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        ruled AS (SELECT *, '.' || host AS h, CASE
            WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
            WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
            WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
            WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
            WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host, '(^|\.)[a-z0-9]+(-[a-z0-9]+)+(\.|$)') THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled
    """,
    "op10_exact_dedup": r"""
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        WINDOW w AS (PARTITION BY norm)
    """,
}


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """Each round assigns by a join with the centroids and takes floors of means; exact in huge integers."""
    parts = [
        "kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings "
        "WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "points AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, q) AS row, * FROM kept)",
        f"""c0 AS MATERIALIZED (SELECT c - 1 AS c, q FROM (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) AS c, q FROM points) WHERE c <= {k})""",
    ]
    for i in range(rounds + 1):
        parts.append(
            f"""a{i} AS MATERIALIZED (SELECT row, arg_min(c, d * 64 + c) AS c, min(d) AS d FROM (
            SELECT row, c, list_sum(list_transform(list_zip(p.q, c{i}.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM points p, c{i}) GROUP BY row)"""
        )
        if i < rounds:
            parts.append(f"""m{i} AS (SELECT c, j, floor_div FROM (SELECT c, j, CAST((sum(v) - ((sum(v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS floor_div
            FROM (SELECT a.c, generate_subscripts(p.q, 1) AS j, unnest(p.q) AS v FROM points p JOIN a{i} a USING (row)) GROUP BY c, j))""")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m.q, o.q) AS q FROM c{i} o LEFT JOIN (SELECT c, list(floor_div ORDER BY j) AS q FROM m{i} GROUP BY c) m USING (c))")
    return f"""WITH {", ".join(parts)}
        SELECT p.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN points p USING (row) JOIN c{rounds} c ON a.c = c.c"""


ORACLE_SQL["op12_centroid_clustering"] = _clusters_sql()
