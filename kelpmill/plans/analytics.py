"""Queries of corpus, collection, feedback, thread and list analytics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from kelpmill.functions import text as X
from kelpmill.operators import analytics as A
from kelpmill.session import table

NOW = "TIMESTAMP '2025-07-01 00:00:00'"
T = lambda n: lambda s, d: table(s, d, n)
docs, log, sms, calls, events, orders, gmail = map(T, ("brain_documents", "collection_log", "ingest_sms", "ingest_calls", "events", "orders", "gmail_messages"))
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def paragraphs(s, d):
    rows = docs(s, d).filter("status = 'active' AND content IS NOT NULL")
    return rows.select("id", F.explode(F.split("content", "\n\n")).alias("chunk")).filter("chunk <> ''")


SOURCE = "CASE WHEN source_type = 'secretary' THEN coalesce(nullif(metadata->>'$.kind', ''), source_type) ELSE source_type END"
LENGTHS = "SELECT source_type, count(*) AS n, round(avg(length(content)), 4) AS mean, round(quantile_cont(length(content), 0.5), 4) AS p50, round(quantile_cont(length(content), 0.95), 4) AS p95, max(length(content)) AS longest FROM brain_documents WHERE status = 'active' GROUP BY source_type"
FAILURES = "SELECT source_type, count(*) FILTER (error_text IS NOT NULL AND finished_at IS NULL) AS dead, count(*) FILTER (error_text IS NOT NULL AND finished_at IS NOT NULL) AS open FROM collection_log GROUP BY source_type"
FB = "fb AS (SELECT event_id, 'q' || (user_id % 40) AS query, 'd' || (event_id % 97) AS document_id, CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END AS thumbs, user_id AS session, ts AS created_at FROM events)"
PAIRS = "SELECT lower(trim(query)) AS query, coalesce(list_sort(list(DISTINCT document_id) FILTER (thumbs > 0)), []) AS relevant, coalesce(list_sort(list(DISTINCT document_id) FILTER (thumbs < 0)), []) AS irrelevant, min(created_at) AS since FROM fb WHERE thumbs <> 0 GROUP BY 1 ORDER BY since DESC, query LIMIT 5000"

query("a01_counts_by_source", f"SELECT {SOURCE} AS source, count(*) AS n FROM brain_documents WHERE status = 'active' GROUP BY 1")(lambda s, d: A.counts_by_source(docs(s, d)))
query("a02_length_stats", LENGTHS)(lambda s, d: A.length_stats(docs(s, d)))
query("a03_chunk_totals", "WITH c AS (SELECT id, unnest(string_split(content, chr(10) || chr(10))) AS chunk FROM brain_documents WHERE status = 'active' AND content IS NOT NULL) SELECT count(*) AS chunks, round(avg(strlen(chunk)), 4) AS mean_bytes, round(coalesce(count(*) / nullif(count(DISTINCT id), 0), 0), 6) AS per_document FROM c WHERE chunk <> ''")(lambda s, d: A.chunk_totals(paragraphs(s, d)))
query("a04_failure_counts", FAILURES)(lambda s, d: A.failure_counts(log(s, d)))
query("a05_coverage", "SELECT round(coalesce(avg((embedding IS NOT NULL)::INT), 0), 6) AS coverage FROM brain_documents WHERE status = 'active'")(lambda s, d: A.coverage(docs(s, d), "embedding"))
query("a06_last_collected", "SELECT source_type, max(collected_at) AS last_collected FROM brain_documents GROUP BY ROLLUP (source_type)")(lambda s, d: A.last_collected(docs(s, d)))
query("a07_baseline", f"SELECT l.*, coalesce(dead, 0) AS dead, coalesce(open, 0) AS open, last_collected FROM ({LENGTHS}) l LEFT JOIN ({FAILURES}) f USING (source_type) LEFT JOIN (SELECT source_type, max(collected_at) AS last_collected FROM brain_documents GROUP BY 1) c USING (source_type)")(lambda s, d: A.baseline(docs(s, d), log(s, d)))
STATUS = f"""WITH per AS (SELECT source_type, max(finished_at) FILTER (error_text IS NULL AND finished_at IS NOT NULL) AS last_success, count(*) AS runs FROM collection_log GROUP BY 1),
    f AS (SELECT source_type, count(*) AS failures FROM collection_log JOIN per USING (source_type) WHERE error_text IS NOT NULL AND (last_success IS NULL OR started_at > last_success) GROUP BY 1)
    SELECT source_type, last_success, runs, coalesce(failures, 0) AS failures, (floor(epoch({NOW})) - floor(epoch(last_success)))::BIGINT AS stale_seconds FROM per LEFT JOIN f USING (source_type)"""
query("a08_collection_status", STATUS)(lambda s, d: A.collection_status(log(s, d), F.expr(NOW)))
query("j06_theta", STATUS)(lambda s, d: A.collection_status(log(s, d), F.expr(NOW)))
query("a09_freshness", "SELECT source_type, max(created_at) AS newest, count(*) AS n FROM brain_documents GROUP BY 1")(lambda s, d: A.freshness(docs(s, d)))
query("a10_feedback_stats", f"WITH {FB} SELECT query, count(*) FILTER (thumbs > 0) AS positive, count(*) FILTER (thumbs < 0) AS negative FROM fb GROUP BY 1")(lambda s, d: A.feedback_stats(A.feedback(events(s, d))))


@query("a11_eval_pairs", f"WITH {FB} SELECT query, array_to_string(relevant, ',') AS relevant, array_to_string(irrelevant, ',') AS irrelevant, since FROM ({PAIRS})")
def a11(s, d):
    return A.eval_pairs(A.feedback(events(s, d))).select("query", F.array_join("relevant", ",").alias("relevant"), F.array_join("irrelevant", ",").alias("irrelevant"), "since")


@query("a12_negative_only", f"WITH {FB} SELECT query, len(irrelevant) AS n FROM ({PAIRS}) WHERE len(relevant) = 0")
def a12(s, d):
    return A.eval_pairs(A.feedback(events(s, d))).filter(F.size("relevant") == 0).select("query", F.size("irrelevant").alias("n"))


@query("a13_manual_positives", f"WITH {FB}, m AS (SELECT 'q' || (user_id % 50) AS query, list(DISTINCT 'm' || (event_id % 7)) AS manual FROM events WHERE event_type = 'click' GROUP BY 1), p AS ({PAIRS}) SELECT coalesce(p.query, m.query) AS query, array_to_string(list_sort(list_distinct(list_concat(coalesce(relevant, []), coalesce(manual, [])))), ',') AS relevant, array_to_string(coalesce(irrelevant, []), ',') AS irrelevant FROM p FULL JOIN m ON p.query = m.query ORDER BY 1 LIMIT 1000")
def a13(s, d):
    e = events(s, d)
    manual = e.filter("event_type = 'click'").select(F.concat(F.lit("q"), (F.col("user_id") % 50).cast("string")).alias("query"), F.concat(F.lit("m"), (F.col("event_id") % 7).cast("string")).alias("document_id"))
    return A.merged_positives(A.eval_pairs(A.feedback(e)), manual).select("query", F.array_join("relevant", ",").alias("relevant"), F.array_join("irrelevant", ",").alias("irrelevant"))


query("a19_nearest_rank", "SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS mean FROM events")(lambda s, d: A.nearest_rank(events(s, d), "value"))
ROLL = ", ".join(f"s[least(floor(len(s) * {p})::INT + 1, len(s))] AS {n}" for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")))
query("a20_rolling_latency", f"SELECT event_type, {ROLL} FROM (SELECT event_type, list_sort(list(value)) AS s FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100) GROUP BY 1)")(lambda s, d: A.rolling_latency(events(s, d), "event_type", ["ts", "event_id"], "value"))
query("a23_counts", "SELECT source_type, count(*) FILTER (status = 'active') AS active, count(*) AS total FROM brain_documents GROUP BY CUBE (source_type)")(lambda s, d: docs(s, d).cube("source_type").agg(F.count_if(F.col("status") == "active").alias("active"), F.count(F.lit(1)).alias("total")))
query("a24_distinct_queries", f"WITH {FB} SELECT count(DISTINCT lower(trim(query))) AS n FROM fb")(lambda s, d: A.feedback(events(s, d)).agg(F.countDistinct(X.normalized_query(F.col("query"))).alias("n")))

# windows and the best of each group
AUTH = "coalesce(regexp_matches({}, '(?i)인증번호|본인.{{0,2}}확인|verification|\\b\\d{{4,8}}\\b|타인에게|otp'), false)"
query("w03_rekey_winners", "SELECT record_id, date_ms, address_hash, msg_type FROM (SELECT *, substr(sha256(address), 1, 16) AS address_hash FROM ingest_sms) QUALIFY row_number() OVER (PARTITION BY date_ms, address_hash, msg_type ORDER BY received_at DESC, record_id DESC) = 1")(lambda s, d: A.rekey_winners(sms(s, d)))
query("w04_latest_turn", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")(lambda s, d: A.latest_turns(events(s, d), "user_id", "ts", 1).select("user_id", "event_id", "ts"))
query("w05_last_six_turns", "SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 6")(lambda s, d: A.latest_turns(events(s, d), "user_id", "ts", 6).select("user_id", "event_id", "ts"))
query("w07_rolling_sum", "SELECT event_id, sum(round(value * 100)::BIGINT) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)::BIGINT AS cents FROM events")(lambda s, d: events(s, d).select("event_id", F.sum(F.round(F.col("value") * 100).cast("long")).over(Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(-99, 0)).alias("cents")))

# ordered lists
query("t02_recent", "SELECT id FROM brain_documents WHERE status = 'active' AND source_type NOT IN ('sms') ORDER BY coalesce(occurred_at, collected_at) DESC, record_id LIMIT 50 OFFSET 10")(lambda s, d: docs(s, d).filter("status = 'active' AND source_type NOT IN ('sms')").orderBy(F.coalesce("occurred_at", "collected_at").desc(), "record_id").offset(10).limit(50).select("id"))
query("t03_recent_kind", "SELECT record_id FROM brain_documents WHERE status = 'active' AND source_type = 'sms' ORDER BY occurred_at DESC NULLS LAST, collected_at DESC, record_id LIMIT 100")(lambda s, d: A.recent_by_kind(docs(s, d), "sms", 100).select("record_id"))
query("t04_actions_by_due", "SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate END ASC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 200")(lambda s, d: orders(s, d).orderBy(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).asc_nulls_last(), F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey"))
query("t10_recent_runs", "SELECT batch_id, started_at FROM collection_log ORDER BY started_at DESC, batch_id DESC LIMIT 50")(lambda s, d: log(s, d).orderBy(F.desc("started_at"), F.desc("batch_id")).limit(50).select("batch_id", "started_at"))
query("t11_last_finished", "SELECT batch_id FROM collection_log WHERE error_text IS NULL ORDER BY finished_at DESC NULLS LAST, batch_id DESC LIMIT 1")(lambda s, d: log(s, d).filter("error_text IS NULL").orderBy(F.desc_nulls_last("finished_at"), F.desc("batch_id")).limit(1).select("batch_id"))

# joins
query("j03_chunks_active", "SELECT source_type, count(*) AS n FROM (SELECT id, unnest(string_split(content, chr(10) || chr(10))) AS chunk FROM brain_documents WHERE content IS NOT NULL) c JOIN brain_documents b USING (id) WHERE status = 'active' AND chunk <> '' GROUP BY 1")(lambda s, d: docs(s, d).filter("content IS NOT NULL").select("id", F.explode(F.split("content", "\n\n")).alias("chunk")).filter("chunk <> ''").join(docs(s, d).filter("status = 'active'").select("id", "source_type"), "id").groupBy("source_type").agg(F.count(F.lit(1)).alias("n")))
query("j04_three_way", "SELECT n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")(lambda s, d: orders(s, d).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n")))
ACTIONS = "WITH a AS (SELECT o_orderkey AS id, o_orderpriority AS kind, o_custkey AS who FROM orders), st AS (SELECT o_orderkey AS id, o_orderstatus AS state FROM orders WHERE o_orderkey % 4 <> 0) "
query("j05_actions_left", ACTIONS + "SELECT a.id, kind, coalesce(state, 'open') AS state, c_name AS counterpart FROM a LEFT JOIN st USING (id) LEFT JOIN customer ON who = c_custkey AND c_acctbal > 0")(lambda s, d: _actions(s, d))
query("j07_left_counts", f"SELECT source_type, n, coalesce(dead + open, 0) AS failed FROM (SELECT source_type, count(*) AS n FROM brain_documents GROUP BY 1) LEFT JOIN ({FAILURES}) USING (source_type)")(lambda s, d: docs(s, d).groupBy("source_type").agg(F.count(F.lit(1)).alias("n")).join(A.failure_counts(log(s, d)), "source_type", "left").select("source_type", "n", F.coalesce(F.col("dead") + F.col("open"), F.lit(0)).alias("failed")))
query("j09_semi", "SELECT record_id FROM brain_documents b WHERE EXISTS (SELECT 1 FROM gmail_messages g WHERE b.source_id = 'gmail:' || g.message_id AND list_contains(label_ids, 'INBOX'))")(lambda s, d: docs(s, d).join(gmail(s, d).filter(F.array_contains("label_ids", "INBOX")).select(F.concat(F.lit("gmail:"), "message_id").alias("source_id")), "source_id", "left_semi").select("record_id"))
query("j10_in_subquery", "SELECT batch_id FROM collection_log WHERE batch_id IN (SELECT batch_id FROM brain_documents WHERE status = 'deleted')")(lambda s, d: log(s, d).join(docs(s, d).filter("status = 'deleted'").select("batch_id"), "batch_id", "left_semi").select("batch_id"))
query("j11_update_from", "SELECT b.record_id, coalesce(g.subject, b.title) AS title FROM brain_documents b LEFT JOIN gmail_messages g ON b.source_id = 'gmail:' || g.message_id")(lambda s, d: docs(s, d).join(gmail(s, d).select(F.concat(F.lit("gmail:"), "message_id").alias("source_id"), "subject"), "source_id", "left").select("record_id", F.coalesce("subject", "title").alias("title")))
query("j12_anti", "SELECT record_id FROM ingest_calls c WHERE NOT EXISTS (SELECT 1 FROM ingest_sms s WHERE s.address = c.number)")(lambda s, d: calls(s, d).join(sms(s, d).select(F.col("address").alias("number")), "number", "left_anti").select("record_id"))
query("j13_dup_content", "SELECT record_id FROM brain_documents WHERE status = 'active' AND content IN (SELECT content FROM brain_documents WHERE status = 'active' AND content IS NOT NULL GROUP BY content HAVING min(source_id) <> max(source_id))")(lambda s, d: A.duplicate_content(docs(s, d)))


def _actions(s, d):
    a = orders(s, d).select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"), F.col("o_custkey").alias("who"))
    st = orders(s, d).filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"))
    c = table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("who"), F.col("c_name").alias("counterpart"))
    return a.join(st, "id", "left").join(c, "who", "left").select("id", "kind", F.coalesce("state", F.lit("open")).alias("state"), "counterpart")


@query("j14_interval_join", "SELECT recording_id, seg_index, w.start_sec AS l0, d.start_sec AS r0, speaker, round(least(w.end_sec, d.end_sec) - greatest(w.start_sec, d.start_sec), 6) AS overlap FROM whisper_segments w JOIN diar_segments d USING (recording_id) WHERE w.start_sec < d.end_sec AND d.start_sec < w.end_sec AND w.end_sec >= w.start_sec AND d.end_sec >= d.start_sec")
def j14(s, d):
    left = table(s, d, "whisper_segments").select(F.col("recording_id").alias("key"), F.col("seg_index").alias("lid"), F.col("start_sec").alias("l0"), F.col("end_sec").alias("l1"))
    right = table(s, d, "diar_segments").select(F.col("recording_id").alias("key"), F.col("speaker").alias("rid"), F.col("start_sec").alias("r0"), F.col("end_sec").alias("r1"))
    return A.interval_join(left, right).select(F.col("key").alias("recording_id"), F.col("lid").alias("seg_index"), "l0", "r0", F.col("rid").alias("speaker"), F.round("overlap", 6).alias("overlap"))


@query("j15_verdicts", "SELECT record_id, (record_id % 10) / 10.0::DOUBLE AS relevance FROM brain_documents WHERE record_id % 3 <> 0 AND (record_id % 10) / 10.0 >= 0.3")
def j15(s, d):
    """Verdicts on two thirds of the records, and on some that are not there."""
    from kelpmill.operators.retrieval import curated

    rows = docs(s, d).select("record_id", F.col("record_id").alias("index"))
    judged = rows.select("index").filter("index % 3 <> 0").unionByName(rows.select((-F.col("index") - 1).alias("index")))
    return curated(rows, judged.select("index", ((F.abs("index") % 10) / 10.0).alias("relevance"))).select("record_id", "relevance")


# predicates
query("p10_json_text", "SELECT record_id, metadata->>'$.language' AS language FROM brain_documents WHERE metadata->>'$.language' IS NOT NULL")(lambda s, d: docs(s, d).select("record_id", X.json_text(F.col("metadata"), "language").alias("language")).filter("language IS NOT NULL"))
query("p11_json_has", "SELECT source_type, count(*) AS n FROM brain_documents WHERE metadata IS NOT NULL AND list_contains(json_keys(metadata), 'thread_id') GROUP BY 1")(lambda s, d: docs(s, d).filter(X.json_has(F.col("metadata"), "thread_id")).groupBy("source_type").agg(F.count(F.lit(1)).alias("n")))
query("p12_distinct_from", "SELECT record_id FROM brain_documents WHERE occurred_at IS DISTINCT FROM collected_at")(lambda s, d: docs(s, d).filter(~F.col("occurred_at").eqNullSafe(F.col("collected_at"))).select("record_id"))
query("p14_ilike", "SELECT record_id FROM ingest_sms WHERE contact_name ILIKE '%bra%'")(lambda s, d: sms(s, d).filter(F.col("contact_name").ilike("%bra%")).select("record_id"))
query("p15_keyset", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey, l_linenumber) > (100, 2) ORDER BY 1, 2 LIMIT 500")(lambda s, d: A.keyset_page(table(s, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], (100, 2), 500))
query("p16_work_queue", "SELECT record_id FROM brain_documents WHERE status = 'active' AND embedding IS NULL AND length(content) > 0 ORDER BY record_id LIMIT 200")(lambda s, d: docs(s, d).filter("status = 'active' AND embedding IS NULL AND length(content) > 0").orderBy("record_id").limit(200).select("record_id"))
query("p18_logical_source", f"SELECT record_id, {SOURCE} AS source FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", A.logical_source().alias("source")))
query("p19_recent_recordings", "SELECT record_id FROM brain_documents WHERE status = 'active' AND source_type = 'call-transcript' AND coalesce(list_contains(json_keys(metadata), 'duration_sec'), false) ORDER BY occurred_at DESC NULLS LAST, collected_at DESC, record_id LIMIT 100")(lambda s, d: A.recent_by_kind(docs(s, d), "call-recording", 100).select("record_id"))
query("p22_emit_rule", "SELECT record_id FROM ingest_sms s WHERE date_ms >= 1748736000000 AND (date_ms > 1750000000000 OR NOT EXISTS (SELECT 1 FROM ingest_calls c WHERE c.number = s.address))")(lambda s, d: sms(s, d).filter("date_ms >= 1748736000000").join(calls(s, d).select(F.col("number").alias("address")).distinct().withColumn("known", F.lit(True)), "address", "left").filter("date_ms > 1750000000000 OR known IS NULL").select("record_id"))
query("p23_live_ids", "SELECT DISTINCT source_type, source_id FROM brain_documents WHERE status = 'active'")(lambda s, d: docs(s, d).filter("status = 'active'").select("source_type", "source_id").distinct())
query("p24_lane_split", "SELECT lane, count(*) AS n FROM (SELECT CASE WHEN source_type = 'insight' THEN 'inferred' ELSE 'observed' END AS lane FROM brain_documents WHERE status = 'active') GROUP BY 1")(lambda s, d: docs(s, d).filter("status = 'active'").groupBy(F.when(F.col("source_type") == "insight", "inferred").otherwise("observed").alias("lane")).agg(F.count(F.lit(1)).alias("n")))

# sets
query("u01_union", "SELECT source_id FROM brain_documents WHERE status = 'active' UNION SELECT recording_id FROM whisper_segments")(lambda s, d: docs(s, d).filter("status = 'active'").select("source_id").union(table(s, d, "whisper_segments").select("recording_id")).distinct())
query("u02_bag_union", "SELECT 0 AS lane, record_id FROM brain_documents WHERE source_type <> 'insight' UNION ALL SELECT 1, record_id FROM brain_documents WHERE source_type = 'insight'")(lambda s, d: docs(s, d).filter("source_type <> 'insight'").select(F.lit(0).alias("lane"), "record_id").unionByName(docs(s, d).filter("source_type = 'insight'").select(F.lit(1).alias("lane"), "record_id")))
query("u03_disjoint", f"WITH {FB}, x AS (SELECT DISTINCT query, CASE WHEN ('0x' || substr(md5('sbfeedback:v1:' || lower(trim(query))), 1, 8))::BIGINT % 100 < 70 THEN 'train' ELSE 'holdout' END AS part FROM fb) SELECT query FROM x WHERE part = 'train' INTERSECT SELECT query FROM x WHERE part = 'holdout'")(lambda s, d: _disjoint(s, d))


def _disjoint(s, d):
    x = A.feedback(events(s, d)).select("query", X.split_of(F.col("query")).alias("part")).distinct()
    return x.filter("part = 'train'").select("query").intersect(x.filter("part = 'holdout'").select("query"))
