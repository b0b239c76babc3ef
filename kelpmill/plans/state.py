"""Queries of upserts and state transitions, the entity graph, and evaluation.

Old snapshots and new batches are cut from the tables by delivery batch: a row of an even batch is old, of an odd one
new. That is the meaning of the operators (a merge of two deliveries), not a sample: both sides together are the table.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from kelpmill.operators import evaluate as E
from kelpmill.operators import graph as G
from kelpmill.operators import state as S
from kelpmill.operators.analytics import collection_status, eval_pairs, feedback
from kelpmill.plans.analytics import FB, NOW, PAIRS, STATUS, T, docs, events, log, orders, sms

QUERIES: dict = {}
SQL: dict[str, str] = {}
col = F.col
KEYS = ["source_type", "source_id"]
COLUMNS = ["source_type", "source_id", "title", "content", "occurred_at", "status", "collected_at"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def sides(s, d):
    rows = docs(s, d).select("record_id", "batch_id", *COLUMNS)
    pick = lambda p: S.latest(rows.filter(f"batch_id % 2 = {p}").drop("batch_id"), KEYS, "record_id").drop("record_id")
    return pick(0), pick(1)


SIDES = ", ".join(f"{n} AS (SELECT {', '.join(COLUMNS)} FROM brain_documents WHERE batch_id % 2 = {p} QUALIFY row_number() OVER (PARTITION BY source_type, source_id ORDER BY record_id DESC) = 1)" for n, p in (("o", 0), ("n", 1)))


@query("m01_upsert", f"WITH {SIDES} SELECT coalesce(o.source_type, n.source_type) AS source_type, coalesce(o.source_id, n.source_id) AS source_id, CASE WHEN n.source_id IS NOT NULL THEN n.title ELSE o.title END AS title, coalesce(n.occurred_at, o.occurred_at) AS occurred_at, CASE WHEN n.source_id IS NOT NULL THEN 'active' ELSE o.status END AS status FROM o FULL JOIN n ON o.source_type = n.source_type AND o.source_id = n.source_id")
def m01(s, d):
    old, new = sides(s, d)
    return S.upsert(old, new, KEYS, keep=("occurred_at",), fixed={"status": F.lit("active")}).select(*KEYS, "title", "occurred_at", "status")


@query("m02_change_detect", f"WITH {SIDES} SELECT n.source_type, n.source_id, (o.source_id IS NULL OR o.content IS DISTINCT FROM n.content) AS content_changed FROM n LEFT JOIN o ON o.source_type = n.source_type AND o.source_id = n.source_id")
def m02(s, d):
    return S.changes(*sides(s, d), KEYS)


@query("m03_mark_deleted", "SELECT record_id, CASE WHEN source_type = 'note' AND status = 'active' AND source_id NOT IN (SELECT source_id FROM brain_documents WHERE source_type = 'note' AND length(content) > 100) THEN 'deleted' ELSE status END AS status FROM brain_documents")
def m03(s, d):
    live = docs(s, d).filter("source_type = 'note' AND length(content) > 100").select("source_id")
    return S.mark_deleted(docs(s, d), live, "note", F.expr(NOW)).select("record_id", "status")


@query("m05_entity_upsert", "SELECT lower(trim(contact_name)) AS normalized_name, 'PERSON' AS type, arg_max(contact_name, (length(contact_name), -record_id)) AS name FROM ingest_sms WHERE contact_name IS NOT NULL GROUP BY 1, 2")
def m05(s, d):
    rows = sms(s, d).filter("contact_name IS NOT NULL").select(F.lower(F.trim("contact_name")).alias("normalized_name"), F.lit("PERSON").alias("type"), col("contact_name").alias("name"), col("record_id").alias("seen"))
    return S.longest_names(rows)


@query("m06_insert_ignore", f"WITH {SIDES} SELECT source_type, source_id FROM o UNION SELECT source_type, source_id FROM n")
def m06(s, d):
    old, new = sides(s, d)
    return S.insert_ignore(old.select(*KEYS), new.select(*KEYS), KEYS)


OLD_NEW = "o AS (SELECT o_orderkey AS identity, o_orderstatus AS summary, CASE WHEN o_custkey % 2 = 0 THEN 'c' || o_custkey END AS counterpart, 'rule' AS detected_by FROM orders WHERE o_orderkey % 3 <> 0), n AS (SELECT o_orderkey AS identity, o_orderpriority AS summary, CASE WHEN o_custkey % 3 = 0 THEN 'd' || o_custkey END AS counterpart, CASE WHEN o_custkey % 5 = 0 THEN 'rule' ELSE 'model' END AS detected_by FROM orders WHERE o_orderkey % 4 <> 0)"


@query("m08_action_upsert", f"WITH {OLD_NEW} SELECT coalesce(o.identity, n.identity) AS identity, coalesce(n.summary, o.summary) AS summary, coalesce(n.counterpart, o.counterpart) AS counterpart, CASE WHEN o.identity IS NULL THEN n.detected_by WHEN n.identity IS NULL OR n.detected_by = o.detected_by THEN o.detected_by ELSE 'both' END AS detected_by FROM o FULL JOIN n USING (identity)")
def m08(s, d):
    t = orders(s, d)
    c = col("o_custkey")
    old = t.filter("o_orderkey % 3 <> 0").select(col("o_orderkey").alias("identity"), col("o_orderstatus").alias("summary"), F.when(c % 2 == 0, F.concat(F.lit("c"), c.cast("string"))).alias("counterpart"), F.lit("rule").alias("detected_by"))
    new = t.filter("o_orderkey % 4 <> 0").select(col("o_orderkey").alias("identity"), col("o_orderpriority").alias("summary"), F.when(c % 3 == 0, F.concat(F.lit("d"), c.cast("string"))).alias("counterpart"), F.when(c % 5 == 0, "rule").otherwise("model").alias("detected_by"))
    return S.upsert_actions(old, new)


@query("m11_vote_toggle", f"WITH RECURSIVE {FB}, v AS (SELECT query, document_id, thumbs, row_number() OVER (PARTITION BY query, document_id ORDER BY event_id) AS i FROM fb), r AS (SELECT query, document_id, i, thumbs AS state FROM v WHERE i = 1 UNION ALL SELECT v.query, v.document_id, v.i, CASE WHEN r.state = v.thumbs THEN 0 ELSE v.thumbs END FROM r JOIN v ON v.query = r.query AND v.document_id = r.document_id AND v.i = r.i + 1) SELECT query, document_id, state AS thumbs FROM r QUALIFY row_number() OVER (PARTITION BY query, document_id ORDER BY i DESC) = 1")
def m11(s, d):
    return S.toggled_votes(feedback(events(s, d)), ["query", "document_id"], "event_id")


@query("m14_failure_backoff", "SELECT source_type, count(*) AS attempts, floor(epoch(max(started_at)))::BIGINT + round(CASE WHEN count(*) <= 1 THEN 5.0 ELSE least(60.0, pow(2.0, count(*) - 1)) END * 60)::BIGINT AS retry_at, count(*) + 1 >= 10 AS dead FROM collection_log WHERE error_text IS NOT NULL GROUP BY 1")
def m14(s, d):
    return S.failures_folded(log(s, d).filter("error_text IS NOT NULL"), "source_type", "started_at")


query("m15_set_once", "SELECT record_id, coalesce(occurred_at, collected_at) AS at FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", S.set_once(col("occurred_at"), col("collected_at")).alias("at")))
query("f41_json_merge", "SELECT record_id, json_merge_patch(coalesce(metadata, '{}')::JSON, '{\"language\": \"xx\", \"zz\": \"1\"}'::JSON)->>'$.language' AS language FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", F.get_json_object(S.merged_json(col("metadata"), F.lit('{"language": "xx", "zz": "1"}')), "$.language").alias("language")))
HISTORY = "SELECT n_nationkey AS id, CASE WHEN n_nationkey = 7 THEN 'active' WHEN n_nationkey < 7 THEN 'superseded' ELSE 'candidate' END AS status, CASE WHEN n_nationkey <= 7 THEN TIMESTAMP '2025-01-01' + INTERVAL 1 DAY * n_nationkey END AS promoted_at FROM nation"


def history(s, d):
    k = col("n_nationkey")
    return T("nation")(s, d).select(k.alias("id"), F.when(k == 7, "active").when(k < 7, "superseded").otherwise("candidate").alias("status"), F.when(k <= 7, F.expr("TIMESTAMP '2025-01-01' + make_dt_interval(n_nationkey)")).alias("promoted_at"))


query("m17_weights_promote", f"SELECT id, CASE WHEN id = 9 THEN 'active' WHEN status = 'active' THEN 'superseded' ELSE status END AS status FROM ({HISTORY})")(lambda s, d: S.promoted(history(s, d), 9, F.expr(NOW)).select("id", "status"))
query("m17_weights_rollback", f"SELECT id, CASE WHEN id = 6 THEN 'active' WHEN status = 'active' THEN 'superseded' ELSE status END AS status FROM ({HISTORY})")(lambda s, d: S.rolled_back(history(s, d)).select("id", "status"))


@query("s32_replace_chunks", "WITH c AS (SELECT record_id AS id, batch_id, title AS chunk FROM brain_documents) SELECT id, chunk FROM c WHERE batch_id % 2 = 0 AND id NOT IN (SELECT id FROM c WHERE batch_id % 3 = 0) UNION ALL SELECT id, 'new' FROM c WHERE batch_id % 3 = 0")
def s32(s, d):
    c = docs(s, d).select(col("record_id").alias("id"), "batch_id", col("title").alias("chunk"))
    return S.replace_chunks(c.filter("batch_id % 2 = 0").select("id", "chunk"), c.filter("batch_id % 3 = 0").select("id", F.lit("new").alias("chunk")))


# the entity graph: orders and their lines as relations
EDGES = "e AS (SELECT o_custkey AS from_id, l_suppkey AS to_id, l_returnflag AS type, l_shipdate AS observed_at, 1 - l_discount AS confidence, l_orderkey AS evidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey), b AS (SELECT from_id AS entity, to_id AS neighbour, 'out' AS direction, * FROM e UNION ALL SELECT to_id, from_id, 'in', * FROM e WHERE from_id <> to_id)"


def edges(s, d):
    return T("lineitem")(s, d).join(orders(s, d), col("l_orderkey") == col("o_orderkey")).select(col("o_custkey").alias("from_id"), col("l_suppkey").alias("to_id"), col("l_returnflag").alias("type"), col("l_shipdate").alias("observed_at"), (1 - col("l_discount")).alias("confidence"), col("l_orderkey").alias("evidence"))


query("g01_entry_points", f"WITH {EDGES} SELECT entity, count(*) AS degree FROM b WHERE confidence >= 0.95 GROUP BY 1 ORDER BY degree DESC, entity LIMIT 20")(lambda s, d: G.entry_points(edges(s, d), 0.95))
query("g02_expand", f"WITH {EDGES} SELECT neighbour, type, direction, count(*) AS weight, max(observed_at) AS last_seen FROM b WHERE entity = 7 GROUP BY ALL ORDER BY weight DESC, last_seen DESC, neighbour, type, direction LIMIT 50")(lambda s, d: G.expand(edges(s, d), 7))
query("g03_evidence", f"WITH {EDGES}, p AS (SELECT from_id AS a, to_id AS b FROM e ORDER BY 1, 2 LIMIT 1) SELECT evidence, type, observed_at FROM e, p WHERE (from_id = a AND to_id = b) OR (from_id = b AND to_id = a) ORDER BY observed_at DESC, evidence, type LIMIT 20")(lambda s, d: G.evidence(edges(s, d), *edges(s, d).select("from_id", "to_id").orderBy("from_id", "to_id").first()))
query("g04_prefix", "SELECT n_nationkey AS id, lower(n_name) AS name FROM nation WHERE starts_with(lower(n_name), 'n') ORDER BY name, id LIMIT 10")(lambda s, d: G.by_prefix(T("nation")(s, d).select(col("n_nationkey").alias("id"), F.lower("n_name").alias("name")), " N "))
query("g05_vocabulary", "SELECT DISTINCT o_orderpriority AS raw, 'related_to' AS type FROM orders")(lambda s, d: orders(s, d).select(col("o_orderpriority").alias("raw"), G.relation_type(col("o_orderpriority")).alias("type")).distinct())
query("g06_incremental", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey > 5000 - 1000")(lambda s, d: G.incremental(T("lineitem")(s, d).select(col("l_orderkey").alias("id")), 5000))


@query("g07_projected", "SELECT source_type, source_id, arg_min(title, (batch_id % 2, record_id)) AS title FROM (SELECT source_type, source_id, batch_id, record_id, coalesce(title, '-') AS title FROM brain_documents) GROUP BY 1, 2")
def g07(s, d):
    rows = docs(s, d).select(*KEYS, F.coalesce("title", F.lit("-")).alias("title"), "record_id", "batch_id")
    return G.projected(rows.filter("batch_id % 2 = 0").drop("batch_id"), rows.filter("batch_id % 2 = 1").drop("batch_id"), KEYS, "record_id", True).select(*KEYS, "title")


# evaluation: results of a query are its documents by votes, labels the pairs of the feedback
RUNS = "runs AS (SELECT fb.query, results, relevant, irrelevant FROM (SELECT query, list(document_id ORDER BY n DESC, document_id)[1:10] AS results FROM (SELECT query, document_id, count(*) AS n FROM fb GROUP BY 1, 2) GROUP BY 1) fb JOIN p USING (query))"


def runs(s, d):
    fb = feedback(events(s, d))
    per = fb.groupBy("query", "document_id").agg(F.count(F.lit(1)).alias("n"))
    best = per.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n"), "document_id"))).filter("_r <= 10")
    results = best.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "document_id"))), lambda x: x["document_id"]).alias("results"))
    return results.join(eval_pairs(fb), "query").select("query", "results", "relevant", "irrelevant")


DCG = "list_sum(list_transform(range(1, len(results[1:{k}]) + 1), lambda i: CASE WHEN list_contains(relevant, results[i]) THEN 1 / log2(i + 1) ELSE 0 END))"
IDEAL = "list_sum(list_transform(range(1, least(len(relevant), len(results[1:{k}])) + 1), lambda i: 1 / log2(i + 1)))"
METRICS = f"""WITH {FB}, p AS ({PAIRS}), {RUNS}, m AS (SELECT coalesce({DCG.format(k=5)} / {IDEAL.format(k=5)}, 0) AS n5, coalesce({DCG.format(k=10)} / {IDEAL.format(k=10)}, 0) AS n10,
    coalesce(1 / list_min(list_filter(range(1, len(results) + 1), lambda i: list_contains(relevant, results[i]))), 0) AS mrr, CASE WHEN len(irrelevant) > 0 THEN len(list_intersect(results, irrelevant)) / 10 END AS fp FROM runs)
    SELECT round(avg(n5), 6) AS ndcg5, round(avg(n10), 6) AS ndcg10, round(avg(mrr), 6) AS mrr10, round(coalesce(avg(fp), 0), 6) AS fp10, count(*) AS queries FROM m"""
query("e01_metrics", METRICS)(lambda s, d: E.metrics(runs(s, d)))
query("e02_eval_metrics", METRICS)(lambda s, d: E.metrics(runs(s, d)))
query("e06_gate", f"SELECT queries, CASE WHEN queries < 30 THEN 'too few queries' WHEN ndcg10 - 0.5 < 0.01 - 1e-9 THEN 'no gain' WHEN fp10 - 0.05 > 0.02 + 1e-9 THEN 'more false positives' ELSE 'promote' END AS verdict FROM ({METRICS})")(lambda s, d: E.metrics(runs(s, d)).select("queries", E.gate(col("queries"), col("ndcg10") - 0.5, col("fp10") - 0.05).alias("verdict")))
query("f46_objective", f"SELECT round(ndcg10 - 0.5 * fp10, 6) AS objective FROM ({METRICS})")(lambda s, d: E.metrics(runs(s, d)).select(F.round(E.objective(col("ndcg10"), col("fp10")), 6).alias("objective")))
query("f47_drop", "SELECT event_id, coalesce(value <> 0 AND (value - 50) / value >= 0.05, false) AS worse FROM events")(lambda s, d: events(s, d).select("event_id", E.relative_drop(col("value"), F.lit(50.0)).alias("worse")))
query("e09_alerts", f"SELECT source_type, concat_ws(',', CASE WHEN last_success IS NULL THEN 'never succeeded' END, CASE WHEN stale_seconds > 3600 THEN 'stale' END, CASE WHEN failures >= 1 THEN 'failing' END) AS reasons FROM ({STATUS}) WHERE reasons <> ''")(lambda s, d: E.freshness_alerts(collection_status(log(s, d), F.expr(NOW)), 3600, 1))


@query("e04_reweighted", f"WITH {FB}, l AS (SELECT query, document_id AS id, unnest(['fts', 'vec']) AS lane, row_number() OVER (PARTITION BY query ORDER BY document_id) AS rank FROM (SELECT DISTINCT query, document_id FROM fb)), w AS (SELECT unnest(range(8)) AS candidate) SELECT candidate, query, id, round(sum(CASE lane WHEN 'fts' THEN 1.0 ELSE candidate * 0.25 END::DOUBLE / (60 + rank)), 9) AS score FROM l, w GROUP BY ALL")
def e04(s, d):
    rows = feedback(events(s, d)).select("query", col("document_id").alias("id")).distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("id"))).withColumn("lane", F.explode(F.array(F.lit("fts"), F.lit("vec"))))
    weights = s.range(8).select(col("id").cast("int").alias("candidate"), F.inline(F.array(F.struct(F.lit("fts").alias("lane"), F.lit(1.0).alias("weight")), F.struct(F.lit("vec").alias("lane"), (col("id") * 0.25).alias("weight")))), F.lit(60.0).alias("k"))
    return E.reweighted(rows, weights)
