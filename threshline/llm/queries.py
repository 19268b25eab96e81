"""The queries of this subpackage, and the SQL that DuckDB checks some of them with."""

from __future__ import annotations

from threshline.llm.ann import op9_approximate_neighbours
from threshline.llm.decontam import op10_benchmark_decontamination
from threshline.llm.licenses import op4_license_scan
from threshline.llm.lines import op6_line_dedup
from threshline.llm.mixing import op3_mix_sources
from threshline.llm.secrets import op1_secret_scan
from threshline.llm.simhash import op8_simhash_near_dedup
from threshline.llm.suffix import op2_suffix_array_dedup
from threshline.llm.toxicity import op5_toxicity_chain
from threshline.llm.warc import op7_warc_normalise

QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_suffix_array_dedup,
        op3_mix_sources,
        op4_license_scan,
        op5_toxicity_chain,
        op6_line_dedup,
        op7_warc_normalise,
        op8_simhash_near_dedup,
        op9_approximate_neighbours,
        op10_benchmark_decontamination,
    )
}

ORACLES = {
    "op2_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800)),
        r AS (SELECT k FROM w GROUP BY 1 HAVING count(*) > 1),
        p AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM w WHERE k IN (SELECT k FROM r)),
        g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p),
        s AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY 1, 2),
        t AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last FROM s GROUP BY 1),
        q AS (SELECT s.doc_id, run, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY run), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY run), 0))) AS piece FROM s JOIN d ON s.doc_id = d.doc_id),
        c AS (SELECT doc_id, string_agg(piece, '' ORDER BY run) AS pieces FROM q GROUP BY 1)
        SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
          sha256(unhex(CASE WHEN t.doc_id IS NULL THEN h ELSE pieces || substr(h, 2 * last + 1) END)) AS kept_sha256, t.doc_id IS NOT NULL AS repeats
        FROM d LEFT JOIN t ON d.doc_id = t.doc_id LEFT JOIN c ON d.doc_id = c.doc_id""",
    "op7_warc_normalise": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS g FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY g) AS first FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, g AS payload_digest,
          CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
}
