"""Queries of the repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpmill.operators import repeats as R
from kelpmill.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.repeated_records(table(spark, sf_dir, "ingest_sms"), table(spark, sf_dir, "brain_documents"))


def p1_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one delivery of each SMS: the row with the least record_id."""
    sms = table(spark, sf_dir, "ingest_sms")
    ids = R.sms_identity(sms)
    return R.keep_one(ids, ["date_ms", "msg_type", "number"], "bucket", "record_id").select("record_id", "number", "date_ms", "msg_type")


NUMBER_SQL = r"""
CASE WHEN regexp_full_match(translate(address, '０１２３４５６７８９＋（）－．–—‑', '0123456789+()-.---'), '[\s+().\-/]*[0-9][0-9\s+().\-/]*')
THEN (SELECT CASE
    WHEN regexp_matches(b, '^(\+|00)82\d*$') THEN '0' || regexp_extract(b, '^(\+|00)82(\d*)$', 2)
    WHEN regexp_matches(b, '^(\+|00)44\d*$') THEN '0' || regexp_extract(b, '^(\+|00)44(\d*)$', 2)
    WHEN regexp_matches(b, '^(\+|00)1\d*$') THEN regexp_extract(b, '^(\+|00)1(\d*)$', 2)
    WHEN regexp_matches(b, '^(\+|00)\d+$') THEN '+' || regexp_extract(b, '^(\+|00)(\d+)$', 2)
    WHEN regexp_matches(b, '^1[2-9]\d{9}$') THEN substr(b, 2)
    ELSE replace(b, '+', '') END
  FROM (SELECT regexp_replace(replace(translate(address, '０１２３４５６７８９＋（）－．–—‑', '0123456789+()-.---'), '(0)', ''), '[^0-9+]', '', 'g') AS b))
ELSE address END
"""

SQL = {
    "p1_found": f"""
        WITH s AS (SELECT record_id, date_ms, msg_type, {NUMBER_SQL} AS number FROM ingest_sms),
        a AS (SELECT record_id, min(record_id) OVER (PARTITION BY date_ms, msg_type, number) AS first FROM s
              WHERE date_ms IS NOT NULL AND msg_type IS NOT NULL AND number IS NOT NULL),
        b AS (SELECT record_id, min(record_id) OVER (PARTITION BY source_type, source_id) AS first FROM brain_documents
              WHERE source_type IS NOT NULL AND source_id IS NOT NULL)
        SELECT 'ingest_sms' AS table_name, record_id FROM a WHERE record_id > first
        UNION ALL SELECT 'brain_documents', record_id FROM b WHERE record_id > first""",
    "p1_kept": f"""
        WITH s AS (SELECT record_id, date_ms, msg_type, {NUMBER_SQL} AS number FROM ingest_sms)
        SELECT min(record_id) AS record_id, number, date_ms, msg_type FROM s GROUP BY number, date_ms, msg_type""",
}
QUERIES = {"p1_found": p1_found, "p1_kept": p1_kept}
