"""The operators of this package as queries over the given tables, and SQL for those that SQL can express."""

from tendergrid.llm import (
    byte_bpe, content_sort, fill_middle, mixing, near_dup, periodic_runs, pii, quality, secret_scan, simhash, topk, url_filter, warc,
)
from tendergrid.llm.common import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def vocabulary() -> tuple[str, str]:
    """Rank file and pattern of the public vocabulary, as installed on the driver."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


QUERIES = {
    "op1_pii": lambda spark, folder: pii.detect(table(spark, folder, "documents")),
    "op2_byte_bpe": lambda spark, folder: byte_bpe.digests(table(spark, folder, "documents"), *vocabulary()),
    "op3_mixing": lambda spark, folder: mixing.mix(table(spark, folder, "documents")),
    "op4_near_dup": lambda spark, folder: near_dup.classify(table(spark, folder, "documents")),
    "op5_simhash": lambda spark, folder: simhash.compare(table(spark, folder, "documents")),
    "op6_warc": lambda spark, folder: warc.round_trip(table(spark, folder, "pages")),
    "op7_topk": lambda spark, folder: topk.search(table(spark, folder, "embeddings")),
    "op8_secrets": lambda spark, folder: secret_scan.detect(table(spark, folder, "documents")),
    "op9_quality": lambda spark, folder: quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels")),
    "op10_url_filter": lambda spark, folder: url_filter.judge(table(spark, folder, "pages")),
    "op11_content_sort": lambda spark, folder: content_sort.classify(table(spark, folder, "documents")),
    "op12_periodic_runs": lambda spark, folder: periodic_runs.digests(table(spark, folder, "documents")),
    "op13_fill_middle": lambda spark, folder: fill_middle.digests(table(spark, folder, "documents")),
}

SQL = {
    "op6_warc": """
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
            FROM pages
        ), g AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last_id FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to,
            CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN NULL ELSE TRUE END AS intact
        FROM g""",
    "op7_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
        ), s AS (
            SELECT q.place, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.place <> q.place
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_content_sort": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            row_number() OVER (same ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op13_fill_middle": """
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
        ), d AS (
            SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n,
                CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
            FROM t
        ), c AS (
            SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), p AS (
            SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c
        )
        SELECT doc_id, n, form,
            CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(text) AS restored_sha256
        FROM p""",
}
