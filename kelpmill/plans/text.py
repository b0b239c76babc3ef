"""Queries of text, time, JSON, hash and number functions, and of chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpmill.functions import redact
from kelpmill.functions import text as X
from kelpmill.operators import chunking as C
from kelpmill.plans.analytics import T, calls, docs, events, sms

QUERIES: dict = {}
SQL: dict[str, str] = {}
col = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')"
query("f01_tokens", f"SELECT record_id, len({TOKENS.format('title')}) AS title_words, len({TOKENS.format('content')}) AS content_words FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", F.size(X.tokens(col("title"))).alias("title_words"), F.size(X.tokens(col("content"))).alias("content_words")))
query("f02_all_words", f"SELECT record_id FROM brain_documents WHERE list_contains({TOKENS.format('content')}, 'list') AND list_contains({TOKENS.format('content')}, 'door')")(lambda s, d: docs(s, d).filter(X.matches_all(F.array().cast("array<string>"), X.tokens(col("content")), ["list", "door"])).select("record_id"))
query("f05_cosine", "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6) AS similarity FROM embeddings, q")(lambda s, d: _cosine(s, d))
query("f06_name", "SELECT record_id, lower(regexp_replace(contact_name, '^\\s+|\\s+$', '', 'g')) AS name FROM ingest_sms WHERE contact_name IS NOT NULL")(lambda s, d: sms(s, d).filter("contact_name IS NOT NULL").select("record_id", X.normalized_name(col("contact_name")).alias("name")))
query("f07_query", "SELECT event_id, lower(trim('  Q ' || event_type || '  ', ' ')) AS q FROM events")(lambda s, d: events(s, d).select("event_id", X.normalized_query(F.concat(F.lit("  Q "), "event_type", F.lit("  "))).alias("q")))
query("f08_split", "SELECT event_id, CASE WHEN ('0x' || substr(md5('sbfeedback:v1:' || lower(trim(event_type || user_id, ' '))), 1, 8))::BIGINT % 100 < 70 THEN 'train' ELSE 'holdout' END AS part FROM events")(lambda s, d: events(s, d).select("event_id", X.split_of(F.concat("event_type", col("user_id").cast("string"))).alias("part")))
query("f09_query_hash", "SELECT event_id, substr(md5(lower(trim(event_type, ' '))), 1, 8) AS h FROM events")(lambda s, d: events(s, d).select("event_id", X.query_hash(col("event_type")).alias("h")))
query("f10_short_hash", "SELECT record_id, substr(sha256(address), 1, 16) AS a, substr(sha256(coalesce(body, '')), 1, 8) AS b FROM ingest_sms")(lambda s, d: sms(s, d).select("record_id", X.short_hash(col("address")).alias("a"), X.short_hash(F.coalesce("body", F.lit("")), 8).alias("b")))
query("f17_sanitized", "SELECT record_id, md5(regexp_replace(content, '\\n{3,}', chr(10) || chr(10), 'g')) AS h FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", F.md5(X.sanitized(col("content"))).alias("h")))
query("f19_tags", "SELECT record_id, md5(regexp_replace('<p>' || content || '<br', '<[^>]*(>|\\z)|>', '', 'g')) AS h FROM brain_documents WHERE content IS NOT NULL")(lambda s, d: docs(s, d).filter("content IS NOT NULL").select("record_id", F.md5(X.stripped_tags(F.concat(F.lit("<p>"), "content", F.lit("<br")))).alias("h")))
query("f25_direction", "SELECT record_id, CASE msg_type WHEN 1 THEN 'received' WHEN 2 THEN 'sent' WHEN 3 THEN 'draft' WHEN 4 THEN 'outbox' WHEN 5 THEN 'failed' WHEN 6 THEN 'queued' ELSE 'unknown' END AS direction FROM ingest_sms")(lambda s, d: sms(s, d).select("record_id", X.direction(col("msg_type")).alias("direction")))
query("f25_call_kind", "SELECT record_id, CASE call_type WHEN 1 THEN 'incoming' WHEN 2 THEN 'outgoing' WHEN 3 THEN 'missed' WHEN 4 THEN 'voicemail' WHEN 5 THEN 'rejected' WHEN 6 THEN 'blocked' ELSE 'unknown' END AS kind FROM ingest_calls")(lambda s, d: calls(s, d).select("record_id", X.call_kind(col("call_type")).alias("kind")))
query("f33_local_week", "SELECT event_id, (date_trunc('week', ts + INTERVAL 9 HOUR) - INTERVAL 9 HOUR)::TIMESTAMP AS begins, (date_trunc('week', ts + INTERVAL 9 HOUR) + INTERVAL 7 DAY - INTERVAL 9 HOUR)::TIMESTAMP AS ends FROM events")(lambda s, d: events(s, d).select("event_id", *[c.cast("timestamp_ntz").alias(n) for c, n in zip(X.local_range(col("ts").cast("timestamp"), "week"), ("begins", "ends"))]))
query("f35_day_difference", "SELECT batch_id, date_diff('day', (started_at AT TIME ZONE 'UTC' + INTERVAL 9 HOUR)::DATE, (finished_at AT TIME ZONE 'UTC' + INTERVAL 9 HOUR)::DATE)::INT AS days FROM collection_log")(lambda s, d: T("collection_log")(s, d).select("batch_id", F.datediff(X.local_day(col("finished_at")), X.local_day(col("started_at"))).alias("days")))
query("f37_layouts", "SELECT event_id, coalesce(try_strptime(t, '%Y-%m-%d %H:%M:%S'), try_strptime(t, '%Y-%m-%d')) AS ts FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d') ELSE 'soon' END AS t FROM events)")(lambda s, d: events(s, d).select("event_id", F.when(col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd")).otherwise("soon").alias("t")).select("event_id", X.parsed_time(col("t")).cast("timestamp_ntz").alias("ts")))
query("f39_epoch", "SELECT record_id, make_timestamp(date_ms * 1000) AS at FROM ingest_sms")(lambda s, d: sms(s, d).select("record_id", F.timestamp_millis("date_ms").cast("timestamp_ntz").alias("at")))
query("f40_backoff", "SELECT n, CASE WHEN n <= 1 THEN 5.0 ELSE least(60.0, pow(2.0, n - 1)) END AS minutes, n >= 10 AS dead FROM range(15) t(n)")(lambda s, d: s.range(15).select(col("id").alias("n"), X.backoff_minutes(col("id")).alias("minutes"), X.dead_letter(col("id")).alias("dead")))
query("f42_split_part", "SELECT record_id, split_part(source_id, ':', 2) AS part, regexp_matches(source_id, '^sms:[0-9]+') AS sms FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", F.split_part("source_id", F.lit(":"), F.lit(2)).alias("part"), col("source_id").rlike("^sms:[0-9]+").alias("sms")))
query("f48_ratio", "SELECT source_type, count(*) FILTER (status = 'deleted') / count(*) > 0.5 AS too_many FROM brain_documents GROUP BY 1")(lambda s, d: docs(s, d).groupBy("source_type").agg((F.count_if(col("status") == "deleted") / F.count(F.lit(1)) > 0.5).alias("too_many")))
query("c01_chunker")(lambda s, d: C.chunked(docs(s, d).filter("status = 'active'").select("id", "source_type", "content")))
query("f23_redacted")(lambda s, d: sms(s, d).filter("body IS NOT NULL").select("record_id", redact.redacted(col("body")).alias("body")))


def _cosine(s, d):
    e = T("embeddings")(s, d)
    q = e.orderBy("vec_id").limit(1).select(col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(X.cosine(col("embedding"), col("q")), 6).alias("similarity"))  # one row
