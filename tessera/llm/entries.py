"""The queries of this package and their SQL."""

from __future__ import annotations

import importlib

#: Query name: module that has a function of this name.
QUERIES = {
    "op1_packing": "packing",
    "op2_warc": "warc",
    "op3_line_dedup": "linededup",
    "op4_decontamination": "decontam",
    "op5_ogg": "ogg",
    "op6_quality": "quality",
    "op7_language": "langid",
    "op8_arrow_tokens": "arrowstore",
    "op9_minhash": "minhash",
    "op10_lm_scoring": "bloomlm",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"tessera.llm.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": """
            WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
                 d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
                 f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
                   CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
            FROM d JOIN f USING (h)
        """,
        "op9_minhash": """
            WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
                 s AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
                 x AS (SELECT DISTINCT doc_id, g FROM s), n AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1),
                 p AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
                 l AS (SELECT i, j FROM p JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE 100 * c >= 75 * (a.n + b.n - c)),
                 e AS (SELECT i, j FROM l UNION ALL SELECT j, i FROM l),
                 r(node, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.j FROM r JOIN e ON r.reach = e.i),
                 c AS (SELECT node, min(reach) AS c FROM r GROUP BY 1)
            SELECT doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, c = doc_id AS kept FROM documents JOIN c ON node = doc_id LEFT JOIN n USING (doc_id)
        """,
    }
