"""Queries of message threads: keys, counterparts, what awaits a reply, counts of a briefing."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpmill.functions import text as X
from kelpmill.operators import actions as P
from kelpmill.plans.analytics import docs, orders
from kelpmill.plans.registry import registry

QUERIES, SQL, query = registry()
col = F.col
MINE = "flora.linquist530@example.com"
NOW, SINCE = "TIMESTAMP '2025-07-01 00:00:00'", "TIMESTAMP '2025-06-01 00:00:00'"

MESSAGES = """m AS (SELECT record_id, status, source_type, title, occurred_at, coalesce(metadata->>'$.from', '') AS f, coalesce(metadata->>'$.contact_name', '') AS c, coalesce(metadata->>'$.number', '') AS n,
    coalesce(metadata->>'$.direction', '') AS way, coalesce(metadata->>'$.thread_id', '') AS t, coalesce(metadata->>'$.is_auth_like', '') AS auth FROM brain_documents WHERE source_type IN ('gmail', 'sms', 'call-log', 'call-transcript'))"""
WHO = "CASE WHEN c <> '' THEN c WHEN n <> '' THEN substr(sha256(n), 1, 16) ELSE 'unknown' END"
THREAD = f"CASE WHEN source_type = 'gmail' THEN CASE WHEN t <> '' THEN 'gmail:' || t END WHEN source_type = 'sms' THEN 'sms:' || {WHO} ELSE 'call:' || {WHO} END"
PARTNER = f"CASE WHEN source_type = 'gmail' THEN CASE WHEN f <> '' AND lower(trim(f)) <> '{MINE}' THEN f END ELSE {WHO} END"
QUOTES = "chr(34) || chr(39)"
SENDER = f"coalesce(nullif(trim(trim(trim(regexp_extract(trim(f), '^(.*)<[^<>]*>', 1)), {QUOTES})), ''), nullif(trim(regexp_extract(f, '<([^<>]+)>', 1)), ''), trim(trim(f), {QUOTES}))"
SHOWN = f"nullif(CASE WHEN source_type = 'gmail' THEN {SENDER} ELSE coalesce(nullif(trim(c), ''), trim(n)) END, '')"
FLAT = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
CLAMP = "CASE WHEN {1} <= 0 THEN '' WHEN length({0}) <= {1} THEN {0} ELSE rtrim(substr({0}, 1, greatest({1} - 1, 0))) || '…' END"
OUT = "((source_type = 'sms' AND way IN ('sent', 'draft')) OR (source_type IN ('call-log', 'call-transcript') AND way = 'outgoing'))"
OUTCOME = f"CASE WHEN auth = 'true' THEN 'skipped_auth_like' WHEN {OUT} THEN 'skipped_outbound' WHEN {PARTNER} IS NULL THEN 'skipped_no_counterpart' WHEN {THREAD} IS NULL THEN 'skipped_no_thread_key' ELSE 'written' END"
CHANNEL = "CASE source_type WHEN 'gmail' THEN '메일' WHEN 'sms' THEN '문자' WHEN 'call-transcript' THEN '통화 녹취' ELSE CASE way WHEN 'missed' THEN '부재중 전화' WHEN 'voicemail' THEN '음성 메시지' ELSE '통화' END END"
AGE = "CASE WHEN days IS NULL THEN '미응답' WHEN days <= 0 THEN '오늘부터 미응답' WHEN days = 1 THEN '어제부터 미응답' ELSE days || '일째 미응답' END"
LATEST = """latest AS (SELECT *, CASE source_type WHEN 'gmail' THEN 'gmail:' || nullif(t, '') WHEN 'sms' THEN 'sms:' || c ELSE 'call:' || c END AS thread FROM m
    WHERE status = 'active' AND occurred_at >= TIMESTAMPTZ '2025-06-01 00:00:00+00' AND (source_type <> 'sms' OR auth <> 'true') QUALIFY row_number() OVER (PARTITION BY thread ORDER BY occurred_at DESC, record_id DESC) = 1)"""


def card(rows: str) -> str:
    """Cards of the rows of a table like m."""
    return f"""c0 AS (SELECT *, {SHOWN} AS name, date_diff('day', (occurred_at AT TIME ZONE 'UTC' + INTERVAL 9 HOUR)::DATE, DATE '2025-07-01') AS days FROM {rows}),
    c1 AS (SELECT *, coalesce(nullif({FLAT.format('name')}, ''), '상대방 미상') || ' · ' || {CHANNEL} AS head, ' · ' || {AGE} AS tail, CASE WHEN source_type = 'gmail' THEN {FLAT.format("coalesce(title, '')")} ELSE '' END AS subject FROM c0),
    c2 AS (SELECT *, 80 - length(tail) AS budget, 80 - length(tail) - length(head) - 3 AS room FROM c1),
    c3 AS (SELECT *, head || CASE WHEN subject <> '' AND room >= 4 THEN ' "' || {CLAMP.format('subject', 'room')} || '"' ELSE '' END AS whole FROM c2),
    card AS (SELECT *, {CLAMP.format('whole', 'budget')} || tail AS summary FROM c3)"""


def messages(s, d):
    return docs(s, d).filter(col("source_type").isin(*P.SOURCES))


def latest(s, d):
    return P.latest_per_thread(docs(s, d), F.expr(SINCE))


def listed(s, d):
    """The list of actions at its greatest length, 200."""
    return orders(s, d).orderBy("o_orderkey").limit(200).select(F.expr(KINDS).alias("kind"), F.concat(F.lit("d"), col("o_custkey").cast("string")).alias("document_id"), F.concat(F.lit("k"), col("o_orderkey").cast("string")).alias("identity"))


query("f11_action_summary", f"SELECT record_id, left(trim(regexp_replace(lower({FLAT.format('title')}), '[.,!?;:''\"()\\[\\]{{}}]', '', 'g')), 80) AS s FROM brain_documents WHERE strlen(title) <= 80 OR regexp_matches(title, '^[\\x00-\\x7f]*$')")(lambda s, d: docs(s, d).filter("octet_length(title) <= 80 OR title rlike '^[\\\\x00-\\\\x7f]*$'").select("record_id", X.action_summary(col("title"), F.lit("my_commitment")).alias("s")))
query("f12_identity", f"WITH {MESSAGES} SELECT record_id, 'action:' || substr(sha256(coalesce({THREAD}, '') || '|awaiting_my_reply|' || coalesce({PARTNER}, '') || '|'), 1, 16) AS k FROM m")(lambda s, d: messages(s, d).select("record_id", X.identity_key(P.thread_key(), F.lit("awaiting_my_reply"), P.counterpart([MINE]), col("title")).alias("k")))
query("f13_thread_key", f"WITH {MESSAGES} SELECT record_id, {THREAD} AS k FROM m")(lambda s, d: messages(s, d).select("record_id", P.thread_key().alias("k")))
query("f14_counterpart", f"WITH {MESSAGES} SELECT record_id, {PARTNER} AS who, {SHOWN} AS name, CASE WHEN {SHOWN} IS NULL THEN NULL WHEN source_type = 'gmail' OR trim(c) <> '' THEN 'PERSON' ELSE 'OTHER' END AS kind FROM m")(lambda s, d: messages(s, d).select("record_id", P.counterpart([MINE]).alias("who"), *[c.alias(n) for c, n in zip(P.display(), ("name", "kind"))]))
query("f15_awaiting", f"WITH {MESSAGES}, {card('m')} SELECT record_id, summary FROM card")(lambda s, d: messages(s, d).select("record_id", P.awaiting_summary(P.display()[0], col("title"), col("occurred_at"), F.expr(NOW)).alias("summary")))
query("f16_outbound", f"WITH {MESSAGES} SELECT record_id, {OUT} AS outbound FROM m")(lambda s, d: messages(s, d).select("record_id", X.outbound(col("source_type"), P.meta("direction")).alias("outbound")))
query("w02_latest_per_thread", f"WITH {MESSAGES}, {LATEST} SELECT thread, record_id, source_type FROM latest")(lambda s, d: latest(s, d).select("thread", "record_id", "source_type"))
query("a21_outcomes", f"WITH {MESSAGES}, {LATEST} SELECT {OUTCOME} AS outcome, count(*) AS n FROM latest GROUP BY 1")(lambda s, d: P.outcomes(latest(s, d), [MINE]).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))
query("l06_awaiting", f"WITH {MESSAGES}, {LATEST}, w AS (SELECT * FROM latest WHERE {OUTCOME} = 'written'), {card('w')} SELECT record_id, 'action:' || substr(sha256({THREAD} || '|awaiting_my_reply|' || {PARTNER} || '|'), 1, 16) AS identity, summary, name FROM card")(lambda s, d: P.awaiting(latest(s, d), F.expr(NOW), [MINE]).select("record_id", "identity", "summary", "name"))
KINDS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'awaiting_my_reply' WHEN '2-HIGH' THEN 'my_commitment' WHEN '3-MEDIUM' THEN 'scheduled' WHEN '5-LOW' THEN 'elsewhere' END"
query(
    "a22_kind_counts",
    f"""WITH a AS (SELECT {KINDS} AS kind, 'd' || o_custkey AS document, 'k' || o_orderkey AS k FROM orders ORDER BY o_orderkey LIMIT 200),
    n AS (SELECT count(*) FILTER (kind = 'awaiting_my_reply') AS a1, count(*) FILTER (kind = 'my_commitment') AS a2, count(*) FILTER (kind = 'scheduled') AS a3,
        count(*) FILTER (coalesce(kind, '') NOT IN ('awaiting_my_reply', 'my_commitment', 'scheduled')) AS a4, string_agg(DISTINCT document, ',' ORDER BY document) AS documents, string_agg(k, ',' ORDER BY k) AS keys FROM a)
    SELECT concat_ws(', ', CASE WHEN a1 > 0 THEN '응답 대기 ' || a1 || '건' END, CASE WHEN a2 > 0 THEN '내 약속 ' || a2 || '건' END, CASE WHEN a3 > 0 THEN '예정 ' || a3 || '건' END, CASE WHEN a4 > 0 THEN '기타 ' || a4 || '건' END) || '.' AS text, documents, keys FROM n""",
)(lambda s, d: P.action_counts(listed(s, d)).select("text", F.array_join("documents", ",").alias("documents"), F.array_join("keys", ",").alias("keys")))
