"""The queries of this package and their SQL."""

from __future__ import annotations

import corpus_pipeline
from sparkloom.llm import align, bpe, decontaminate, linededup, neardup, periodic, pii, qda, quality, secrets, sharding, urlfilter, warc
from sparkloom.llm._common import table


def queries() -> dict:
    return {
        "op1_quality_rules": lambda spark, d: quality.op1(table(spark, d, "documents")),
        "op2_warc": lambda spark, d: warc.op2(table(spark, d, "pages")),
        "op3_minhash": lambda spark, d: neardup.op3(table(spark, d, "documents")),
        "op4_line_dedup": lambda spark, d: linededup.op4(table(spark, d, "documents")),
        "op5_secret_scan": lambda spark, d: secrets.op5(table(spark, d, "documents")),
        "op6_byte_bpe": lambda spark, d: bpe.op6(table(spark, d, "documents")),
        "op7_url_filter": lambda spark, d: urlfilter.op7(table(spark, d, "pages"), table(spark, d, "labels")),
        "op8_sharding": lambda spark, d: sharding.op8(table(spark, d, "documents")),
        "op9_pii": lambda spark, d: pii.op9(table(spark, d, "documents")),
        "op10_decontaminate": lambda spark, d: decontaminate.op10(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op11_align_tokens": lambda spark, d: align.op11(table(spark, d, "documents")),
        "op12_periodic_runs": lambda spark, d: periodic.op12(table(spark, d, "documents")),
        "op13_quality_discriminant": lambda spark, d: qda.op13(table(spark, d, "documents"), table(spark, d, "labels")),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": OP4, "op10_decontaminate": OP10}


OP4 = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), keyed AS (
  SELECT rid, doc_id, i, parts[i] AS line,
    translate(trim(parts[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM texts, unnest(range(1, len(parts) + 1)) AS u(i)
), repeated AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT rid, doc_id, i, line, (r.k IS NOT NULL AND doc_id IS DISTINCT FROM keep) AS gone FROM keyed LEFT JOIN repeated r USING (k)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid, doc_id
"""

OP10 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS m, list_slice(w, i, i + least(13, len(w)) - 1) AS g
  FROM bw, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(i) WHERE len(w) > 0
), dg AS (
  SELECT doc_id, i, m, list_slice(w, i, i + m - 1) AS g
  FROM dw, (SELECT DISTINCT m FROM win), unnest(range(1, len(w) - m + 2)) AS u(i) WHERE len(w) >= m
), hit AS (SELECT doc_id, i, m, item_id FROM dg JOIN win USING (m, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + m)) AS u(p) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN listed USING (doc_id)
"""
