"""Queries of the remaining filters, list orders, lifecycle steps, metrics and scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from kelpmill.functions import text as X
from kelpmill.operators import analytics as A
from kelpmill.operators import enrich as N
from kelpmill.operators import evaluate as E
from kelpmill.operators import graph as G
from kelpmill.operators import retrieval as V
from kelpmill.operators import state as S
from kelpmill.plans import retrieval as PR
from kelpmill.plans.analytics import FB, PAIRS, T, docs, events, log, orders, sms
from kelpmill.plans.state import DCG, EDGES, IDEAL, RUNS, edges, runs
from kelpmill.sources import files as FS
from kelpmill.sources import messages as M

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


Q = V.SearchQuery
n_by_source = lambda df: df.groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))
N_SQL = "SELECT source_type, count(*) AS n FROM brain_documents WHERE {} GROUP BY 1"

# filters
query("p01_active", N_SQL.format("status = 'active' AND source_type <> 'insight'"))(lambda s, d: n_by_source(V.filtered(docs(s, d), Q("x"))))
query("p01_include_deleted", N_SQL.format("source_type <> 'insight'"))(lambda s, d: n_by_source(V.filtered(docs(s, d), Q("x", include_deleted=True))))
query("p02_include", N_SQL.format("status = 'active' AND source_type IN ('slack', 'note')"))(lambda s, d: n_by_source(V.filtered(docs(s, d), Q("x", source_types=("slack", "note")))))
query("p03_exclusion_wins", N_SQL.format("status = 'active' AND source_type = 'slack'"))(lambda s, d: n_by_source(V.filtered(docs(s, d), Q("x", source_types=("slack", "note"), exclude=("note",)))))
query("p06_insights_asked", N_SQL.format("status = 'active' AND source_type = 'insight'"))(lambda s, d: n_by_source(V.filtered(docs(s, d), Q("x", source_type="insight"))))
query("p08_after_top_k", f"WITH {PR.BASE}, {PR.FTS} SELECT fts.id, rank FROM fts JOIN brain_documents USING (id) WHERE source_type <> 'gmail'")(lambda s, d: _after(s, d))
query("p13_optional", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 1000 AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY")(lambda s, d: _optional(s, d, kinds=["1-URGENT", "2-HIGH"], least=1000.0, days=90))
query("p20_clamped_lists", "SELECT source_type, least(count(*), 50) AS shown FROM brain_documents GROUP BY 1")(lambda s, d: docs(s, d).groupBy("source_type").agg(F.least(F.count(F.lit(1)), F.lit(V.clamp(500, 20, 50))).alias("shown")))

# retrieval
GATE = "g AS (SELECT avg((embedding IS NOT NULL)::INT) AS coverage FROM brain_documents WHERE status = 'active')"
query("r05_summvec_lane", f"WITH {PR.BASE}, {PR.QV}, s AS (SELECT id, embedding FROM base WHERE len(title) > 0) SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, score FROM (SELECT id, {PR.COS} AS score FROM s, qv WHERE {PR.USABLE}) QUALIFY rank <= 40")(lambda s, d: _summary(s, d))
query("r09_weights_gate", f"WITH {GATE} SELECT coverage >= 0.80 AS on_, CASE WHEN coverage >= 0.80 THEN 0.8 ELSE 0.0 END::DOUBLE AS summary_weight FROM g")(lambda s, d: A.coverage(docs(s, d), "embedding").select((col("coverage") >= 0.80).alias("on_"), F.when(col("coverage") >= 0.80, F.lit(0.8)).otherwise(F.lit(0.0)).alias("summary_weight")))
query("r21_entity_weights", PR.WITH.replace("sum(1.0::DOUBLE / (60 + rank))", "sum(w / (60 + rank))").replace("SELECT id, rank FROM fts UNION ALL SELECT id, rank FROM vec UNION ALL SELECT id, rank FROM bigm", "SELECT id, rank, 1.0::DOUBLE AS w FROM fts UNION ALL SELECT id, rank, 1.0 FROM vec UNION ALL SELECT id, rank, 1.5 FROM bigm") + "SELECT id, score FROM rrf")(lambda s, d: V.fused(V.lanes(docs(s, d), PR.query(s, d)), V.SearchWeights(bigm=1.5)))
query("j02_fetch", PR.WITH + "SELECT record_id, score FROM (SELECT * FROM rrf ORDER BY score DESC, id LIMIT 40) JOIN brain_documents USING (id)")(lambda s, d: docs(s, d).select("id", "record_id").join(F.broadcast(V.fused(V.lanes(docs(s, d), PR.query(s, d)), V.SearchWeights()).orderBy(F.desc("score"), "id").limit(40)), "id").select("record_id", "score"))
query("w01_global_rank", f"WITH {PR.BASE} SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, length(content)::DOUBLE AS score FROM base WHERE content IS NOT NULL) QUALIFY rank <= 40")(lambda s, d: V.ranked(V.filtered(docs(s, d), Q("x")).filter("content IS NOT NULL").select("id", F.length("content").cast("double").alias("score")), "x", 40).select("id", "rank"))
query("w06_best_chunk", f"WITH {PR.CHUNKS}, scored AS (SELECT id, chunk_index, length(chunk)::DOUBLE AS score FROM chunks WHERE chunk <> '') {PR.BEST}")(lambda s, d: V.chunk_best(PR.chunks(s, d).select("id", "chunk_index", F.length("chunk").cast("double").alias("score")), 20))

# list orders and sets
query("t01_whitelist", PR.WITH + "SELECT id, score FROM rrf ORDER BY score DESC, id LIMIT 20")(lambda s, d: V.fused(V.lanes(docs(s, d), PR.query(s, d)), V.SearchWeights()).orderBy(F.desc("score"), "id").limit(20))
query("t05_recency_keys", PR.WITH + ", top AS (SELECT id, score, coalesce(occurred_at, collected_at) AS seen FROM rrf JOIN brain_documents USING (id)) SELECT id, row_number() OVER (ORDER BY seen DESC NULLS LAST, score DESC, id) AS place FROM top QUALIFY place <= 30")(lambda s, d: _recency(s, d))
query("t07_prompt_actions", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END NULLS LAST, o_orderkey LIMIT 40")(lambda s, d: orders(s, d).filter("o_orderstatus = 'O'").orderBy(F.when(col("o_orderkey") % 2 == 0, col("o_orderdate")).asc_nulls_last(), "o_orderkey").limit(40).select("o_orderkey"))
query("t08_newest_edges", f"WITH {EDGES} SELECT evidence, observed_at FROM e ORDER BY observed_at DESC, evidence, to_id, from_id LIMIT 100")(lambda s, d: edges(s, d).orderBy(F.desc("observed_at"), "evidence", "to_id", "from_id").limit(100).select("evidence", "observed_at"))
query("u04_set_union", f"WITH {FB} SELECT query, array_to_string(list_sort(list(DISTINCT document_id)), ',') AS ids FROM fb WHERE thumbs <> 0 GROUP BY 1")(lambda s, d: A.eval_pairs(A.feedback(events(s, d))).select("query", F.array_join(F.array_sort(F.array_union("relevant", "irrelevant")), ",").alias("ids")))

# joins and aggregations of the graph and of evaluation
query("j08_two_roles", "SELECT c_name AS a, s_name AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")(lambda s, d: edges(s, d).join(T("customer")(s, d).select(col("c_custkey").alias("from_id"), col("c_name").alias("a")), "from_id").join(T("supplier")(s, d).select(col("s_suppkey").alias("to_id"), col("s_name").alias("b")), "to_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
query("j16_undirected", f"WITH {EDGES} SELECT direction, count(*) AS n FROM b GROUP BY 1")(lambda s, d: G.both_ways(edges(s, d)).groupBy("direction").agg(F.count(F.lit(1)).alias("n")))
query("j17_evidence_documents", f"WITH {EDGES} SELECT o_orderkey, count(*) AS n FROM e JOIN orders ON evidence = o_orderkey WHERE from_id = to_id GROUP BY 1")(lambda s, d: edges(s, d).filter("from_id = to_id").join(orders(s, d).select(col("o_orderkey").alias("evidence")), "evidence").groupBy(col("evidence").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n")))
query("j18_prefix", "SELECT c_custkey AS id, lower(c_name) AS name FROM customer WHERE starts_with(lower(c_name), 'customer#00') ORDER BY name, id LIMIT 50")(lambda s, d: G.by_prefix(T("customer")(s, d).select(col("c_custkey").alias("id"), F.lower("c_name").alias("name")), "Customer#00", 50))
query("a14_mentions_per_document", f"WITH {PR.MENTIONS} SELECT id, count(*) AS n FROM mentions GROUP BY 1")(lambda s, d: PR.mentions(s, d).groupBy("id").agg(F.count(F.lit(1)).alias("n")))
query("a15_degree", f"WITH {EDGES} SELECT entity, count(*) AS degree FROM b GROUP BY 1")(lambda s, d: G.both_ways(edges(s, d)).groupBy("entity").agg(F.count(F.lit(1)).alias("degree")))
query("a16_neighbour_weight", f"WITH {EDGES} SELECT entity, neighbour, count(*) AS weight, max(observed_at) AS last_seen FROM b GROUP BY 1, 2")(lambda s, d: G.both_ways(edges(s, d)).groupBy("entity", "neighbour").agg(F.count(F.lit(1)).alias("weight"), F.max("observed_at").alias("last_seen")))
EV = f"WITH {FB}, p AS ({PAIRS}), {RUNS} "
query("a17_macro_ndcg", EV + f"SELECT round(avg(coalesce({DCG.format(k=10)} / {IDEAL.format(k=10)}, 0)), 6) AS ndcg10 FROM runs")(lambda s, d: runs(s, d).agg(F.round(F.avg(E.ndcg(col("results"), col("relevant"), 10)), 6).alias("ndcg10")))
query("a18_macro_fp", EV + "SELECT round(avg(len(list_intersect(results, irrelevant)) / 10), 6) AS fp10 FROM runs WHERE len(irrelevant) > 0")(lambda s, d: runs(s, d).filter(F.size("irrelevant") > 0).agg(F.round(F.avg(E.fp_penalty(col("results"), col("irrelevant"), 10)), 6).alias("fp10")))
query("f43_ndcg", EV + f"SELECT query, round(coalesce({DCG.format(k=5)} / {IDEAL.format(k=5)}, 0), 6) AS ndcg5 FROM runs")(lambda s, d: runs(s, d).select("query", F.round(E.ndcg(col("results"), col("relevant"), 5), 6).alias("ndcg5")))
query("f44_mrr", EV + "SELECT query, round(coalesce(1 / list_min(list_filter(range(1, len(results) + 1), lambda i: list_contains(relevant, results[i]))), 0), 6) AS mrr FROM runs")(lambda s, d: runs(s, d).select("query", F.round(E.mrr(col("results"), col("relevant"), 10), 6).alias("mrr")))
query("f45_fp_penalty", EV + "SELECT query, round(len(list_intersect(results, irrelevant)) / 10, 6) AS fp FROM runs")(lambda s, d: runs(s, d).select("query", F.round(E.fp_penalty(col("results"), col("irrelevant"), 10), 6).alias("fp")))
SPLIT = "CASE WHEN ('0x' || substr(md5('sbfeedback:v1:' || lower(trim(query, ' '))), 1, 8))::BIGINT % 100 < 70 THEN 'train' ELSE 'holdout' END"
query("e03_split_sizes", f"WITH {FB}, p AS ({PAIRS}) SELECT {SPLIT} AS part, count(*) AS n FROM p GROUP BY 1")(lambda s, d: A.eval_pairs(A.feedback(events(s, d))).groupBy(X.split_of(col("query")).alias("part")).agg(F.count(F.lit(1)).alias("n")))
query("e07_judge", EV + f"SELECT part, round(avg(coalesce({DCG.format(k=10)} / {IDEAL.format(k=10)}, 0)), 6) AS ndcg10 FROM (SELECT *, {SPLIT} AS part FROM runs) runs GROUP BY 1")(lambda s, d: runs(s, d).groupBy(X.split_of(col("query")).alias("part")).agg(F.round(F.avg(E.ndcg(col("results"), col("relevant"), 10)), 6).alias("ndcg10")))

# scalar rules
query("f03_lexical", f"WITH {PR.BASE} SELECT id, {PR.SCORE} AS score FROM ({PR.TOK})")(lambda s, d: V.filtered(docs(s, d), Q("x")).select("id", X.lexical_score(X.tokens(col("title")), X.tokens(col("content")), ["the", "parcel"]).alias("score")))
query("f04_bigrams", f"SELECT record_id, {PR.SIM.format('title')} AS similarity FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", X.bigram_similarity(col("title"), "the parcel").alias("similarity")))
query("f27_first_json", "SELECT record_id, json_extract_string(metadata, '$.language') AS language FROM brain_documents WHERE metadata IS NOT NULL")(lambda s, d: docs(s, d).filter("metadata IS NOT NULL").select("record_id", F.get_json_object(N.first_json(F.concat(F.lit("Sure:\n```json\n"), "metadata", F.lit("\n```"))), "$.language").alias("language")))
query("f38_backfill", "SELECT record_id, try_strptime(regexp_extract(content, '(\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2})', 1), '%Y-%m-%d %H:%M:%S') AS at FROM brain_documents WHERE source_type = 'call-log' AND content IS NOT NULL")(lambda s, d: docs(s, d).filter("source_type = 'call-log' AND content IS NOT NULL").select("record_id", F.try_to_timestamp(F.regexp_extract("content", r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("at")))

# lifecycle
query("m04_delete_note", "SELECT record_id, CASE WHEN source_type = 'note' AND metadata->>'$.language' = 'de' THEN 'deleted' ELSE status END AS status FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", F.when((col("source_type") == "note") & (X.json_text(col("metadata"), "language") == "de"), "deleted").otherwise(col("status")).alias("status")))
query("m07_relations_ignore", f"WITH {EDGES} SELECT DISTINCT from_id, to_id, type FROM e")(lambda s, d: _relations(s, d))
query("m09_open_status", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus ELSE 'open' END AS state FROM orders")(lambda s, d: S.insert_ignore(orders(s, d).filter("o_orderkey % 4 <> 0").select(col("o_orderkey").alias("id"), col("o_orderstatus").alias("state")), orders(s, d).select(col("o_orderkey").alias("id"), F.lit("open").alias("state")), ["id"]))
query("m10_feedback_upsert", f"WITH {FB} SELECT query, document_id, session, arg_max(thumbs, event_id) AS thumbs FROM fb GROUP BY 1, 2, 3")(lambda s, d: S.latest(A.feedback(events(s, d)).select("query", "document_id", "session", "event_id", "thumbs"), ["query", "document_id", "session"], "event_id").drop("event_id"))
query("m12_watermarks", "SELECT source_type, max(started_at) FILTER (error_text IS NULL AND finished_at IS NOT NULL) AS watermark FROM collection_log GROUP BY 1")(lambda s, d: log(s, d).groupBy("source_type").agg(F.max(F.when(col("error_text").isNull() & col("finished_at").isNotNull(), col("started_at"))).alias("watermark")))
query("m13_ledger", "SELECT recording_id FROM whisper_segments UNION SELECT recording_id FROM diar_segments")(lambda s, d: S.insert_ignore(T("whisper_segments")(s, d).select("recording_id").distinct(), T("diar_segments")(s, d).select("recording_id"), ["recording_id"]))
query("s02_incremental", "SELECT record_id FROM brain_documents WHERE collected_at > TIMESTAMPTZ '2025-06-20 00:00:00+00' OR source_id NOT IN (SELECT 'gmail:' || message_id FROM gmail_messages)")(lambda s, d: FS.incremental(docs(s, d).select("record_id", "source_id", col("collected_at").alias("mtime")), F.expr("TIMESTAMP '2025-06-20 00:00:00'"), T("gmail_messages")(s, d).select(F.concat(F.lit("gmail:"), "message_id").alias("source_id"))).select("record_id"))
query("s12_slack_dedup", "SELECT count(*) AS n FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type <> '')")(lambda s, d: M.map_slack(events(s, d).select(col("user_id").cast("string").alias("channel"), F.unix_micros(col("ts").cast("timestamp")).cast("string").alias("ts"), F.lit("u").alias("user"), col("event_type").alias("text"), F.lit(None).cast("string").alias("thread_ts"))).agg(F.count(F.lit(1)).alias("n")))
query("st4_late_rows", "SELECT record_id FROM ingest_sms s WHERE date_ms >= 1748736000000 AND (date_ms > 1750500000000 OR record_id::VARCHAR NOT IN (SELECT record_id::VARCHAR FROM ingest_calls))")(lambda s, d: _late(s, d))


def _after(s, d):
    q = PR.query(s, d)
    hits = V.ranked(V.fts_candidates(V.filtered(docs(s, d), q), q), "fts", 40)
    return docs(s, d).select("id", "source_type").join(F.broadcast(hits), "id").filter("source_type <> 'gmail'").select("id", "rank")


def _optional(s, d, kinds=None, least=None, days=None):
    rows = orders(s, d)
    if kinds:
        rows = rows.filter(col("o_orderpriority").isin(kinds))
    if least is not None:
        rows = rows.filter(col("o_totalprice") >= least)
    if days is not None:
        newest = orders(s, d).agg(F.max("o_orderdate").alias("_m"))
        rows = rows.crossJoin(F.broadcast(newest)).filter(col("o_orderdate") >= col("_m") - F.expr(f"INTERVAL {days} DAY"))  # one row
    return rows.select("o_orderkey")


def _summary(s, d):
    q = PR.query(s, d)
    rows = V.filtered(docs(s, d), q).withColumn("summary_embedding", F.when(F.length("title") > 0, col("embedding")))
    return V.ranked(V.vec_candidates(rows, q, "summary_embedding"), "summvec", 40).select("id", "rank", "score")


def _recency(s, d):
    best = V.fused(V.lanes(docs(s, d), PR.query(s, d)), V.SearchWeights())
    top = V.by_recency(docs(s, d).select("id", "occurred_at", "collected_at").join(best, "id")).limit(30)
    return top.select("id", F.row_number().over(Window.orderBy(F.desc_nulls_last(F.coalesce("occurred_at", "collected_at")), F.desc("score"), "id")).alias("place"))


def _relations(s, d):
    e = edges(s, d).select("from_id", "to_id", "type")
    old = e.filter("from_id % 2 = 0").distinct()
    return S.insert_ignore(old, e, ["from_id", "to_id", "type"])


def _late(s, d):
    from kelpmill.streaming.ingest import admitted

    rows = sms(s, d).select("record_id", "date_ms", col("record_id").cast("string").alias("id"))
    return admitted(rows, 1_750_500_000_000, 1_748_736_000_000, T("ingest_calls")(s, d).select(col("record_id").cast("string").alias("id"))).select("record_id")
