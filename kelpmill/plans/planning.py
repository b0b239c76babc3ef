"""Queries of question planning, model answers, request checks and streaming runs."""

from __future__ import annotations

from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import functions as F

from kelpmill.functions import text as X
from kelpmill.operators import chunking as C
from kelpmill.operators import enrich as N
from kelpmill.operators import retrieval as R
from kelpmill.plans import intent as I
from kelpmill.plans import requests as Q
from kelpmill.plans import retrieval as PR
from kelpmill.plans.analytics import T, docs, log, sms
from kelpmill.plans.registry import registry
from kelpmill.session import shared_dir

QUERIES, SQL, query = registry()
col = F.col
NOW = datetime(2025, 6, 18, 3, tzinfo=timezone.utc)  # Wednesday noon in Seoul

# questions: one for every record, by turns
QUESTIONS = ("오늘 메일", "내일 일정", "모레 회의", "어제 통화", "이번 주말 약속", "다음 주 일정", "이번 주 슬랙", "지난달 노션", "2025년 2월 문자", "2025년 13월", "아무거나")
WINDOWS = (("2025-06-17 15:00", "2025-06-18 15:00"), ("2025-06-18 15:00", "2025-06-19 15:00"), ("2025-06-19 15:00", "2025-06-20 15:00"), ("2025-06-16 15:00", "2025-06-17 15:00"), ("2025-06-20 15:00", "2025-06-22 15:00"), ("2025-06-22 15:00", "2025-06-29 15:00"), ("2025-06-15 15:00", "2025-06-22 15:00"), ("2025-04-30 15:00", "2025-05-31 15:00"), ("2025-01-31 15:00", "2025-02-28 15:00"), None, None)
ASKED = ("gmail", "calendar", "", "call-log", "", "calendar", "slack", "notion", "sms", "", "")


def _values(of: tuple) -> str:
    """SQL list of texts and nulls."""
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in of) + "]"


def _asked(s, d):
    n = len(QUESTIONS)
    return docs(s, d).select("record_id", F.element_at(F.array(*map(F.lit, QUESTIONS)), (col("record_id") % n + 1).cast("int")).alias("question"))


def _planned(texts: pd.Series) -> pd.DataFrame:
    plans = [I.plan(t, NOW) for t in texts]
    at = lambda t: t and t.strftime("%Y-%m-%d %H:%M")
    return pd.DataFrame({"begins": [at(p.begin) for p in plans], "ends": [at(p.end) for p in plans], "sources": [",".join(p.sources) for p in plans]})


def _plans(s, d):
    return _asked(s, d).select("record_id", F.pandas_udf(_planned, "begins string, ends string, sources string")("question").alias("p")).select("record_id", "p.*")


PLACE = f"record_id % {len(QUESTIONS)} + 1"
query("f34_windows", f"SELECT record_id, {_values(tuple(w and w[0] for w in WINDOWS))}[{PLACE}] AS begins, {_values(tuple(w and w[1] for w in WINDOWS))}[{PLACE}] AS ends FROM brain_documents")(lambda s, d: _plans(s, d).select("record_id", "begins", "ends"))
query("p25_sources", f"SELECT record_id, {_values(ASKED)}[{PLACE}] AS sources FROM brain_documents")(lambda s, d: _plans(s, d).select("record_id", "sources"))
PROPOSED = ('{"from": "2025-06-01T00:00:00+00:00", "to": "2025-06-02T00:00:00+00:00", "sources": ["sms", "insight"]}', '{"from": "2025-06-02", "to": "2025-06-01"}', "no plan", '{"sources": ["fax"]}')


def _checked(raw: pd.Series, texts: pd.Series) -> pd.DataFrame:
    plans = [I.checked(r, t, NOW) for r, t in zip(raw, texts)]
    return pd.DataFrame({"begins": [p.begin and p.begin.astimezone(timezone.utc).strftime("%Y-%m-%d %H:%M") for p in plans], "sources": [",".join(p.sources) for p in plans]})


query("l08_checked_plans", f"SELECT record_id, CASE WHEN record_id % 4 = 0 THEN '2025-06-01 00:00' ELSE {_values(tuple(w and w[0] for w in WINDOWS))}[{PLACE}] END AS begins, CASE WHEN record_id % 4 = 0 THEN 'sms' ELSE {_values(ASKED)}[{PLACE}] END AS sources FROM brain_documents")(
    lambda s, d: _asked(s, d).select("record_id", F.pandas_udf(_checked, "begins string, sources string")(F.element_at(F.array(*map(F.lit, PROPOSED)), (col("record_id") % 4 + 1).cast("int")), "question").alias("p")).select("record_id", "p.*")
)


def _alone(ids: pd.Series, texts: pd.Series) -> pd.Series:
    told = lambda i: [("q", "a")] if i % 2 else []
    answer = lambda i: (lambda q, h: f"{q} ({h[0][0]})" if i % 3 else " ")
    return pd.Series([I.standalone(t, told(i), answer(i)) for i, t in zip(ids, texts)])


query("l09_standalone", f"SELECT record_id, {_values(QUESTIONS)}[{PLACE}] || CASE WHEN record_id % 2 = 1 AND record_id % 3 <> 0 THEN ' (q)' ELSE '' END AS question FROM brain_documents")(lambda s, d: _asked(s, d).select("record_id", F.pandas_udf(_alone, "string")("record_id", "question").alias("question")))


def _grown(ids: pd.Series, texts: pd.Series) -> pd.Series:
    write = (None, lambda q: "", lambda q: q[::-1])
    return pd.Series([R.expanded(t, write[i % 3]) for i, t in zip(ids, texts)])


query("r19_expanded", f"SELECT record_id, q || CASE WHEN record_id % 3 = 2 THEN chr(10) || chr(10) || reverse(q) ELSE '' END AS question FROM (SELECT record_id, {_values(QUESTIONS)}[{PLACE}] AS q FROM brain_documents)")(lambda s, d: _asked(s, d).select("record_id", F.pandas_udf(_grown, "string")("record_id", "question").alias("question")))

# requests
DAYS = "CASE record_id % 6 WHEN 0 THEN '' WHEN 1 THEN '7' WHEN 2 THEN ' 4000 ' WHEN 3 THEN '-1' WHEN 4 THEN 'x' ELSE NULL END"
LEAST = "CASE record_id % 5 WHEN 0 THEN '' WHEN 1 THEN '0.25' WHEN 2 THEN '1.5' WHEN 3 THEN 'x' ELSE '1' END"
query("p21_requests", "SELECT record_id, CASE record_id % 6 WHEN 1 THEN 7 WHEN 2 THEN 3650 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE 30 END AS days, CASE WHEN record_id % 6 IN (3, 4) THEN 'days must be a positive integer' WHEN record_id % 5 IN (2, 3) THEN 'min_confidence must be between 0 and 1' END AS fault, CASE record_id % 5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.25 WHEN 4 THEN 1.0 END::DOUBLE AS least FROM brain_documents")(
    lambda s, d: docs(s, d).select("record_id", Q.days(F.expr(DAYS)).alias("days"), Q.confidence(F.expr(LEAST)).alias("least"), Q.fault(F.expr(DAYS), F.expr(LEAST)).alias("fault"))
)
query("p21_lists", "SELECT record_id, array_to_string(list_filter(list_transform(string_split(coalesce(title, '') || ' , ,b', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", F.array_join(Q.listed(F.concat(F.coalesce("title", F.lit("")), F.lit(" , ,b"))), "|").alias("parts")))

# answers of models, as they would come for each document
ANSWER = "'Sure:' || chr(10) || '```json' || chr(10) || {} || chr(10) || '```'"


def _answers(s, d, made):
    rows = docs(s, d).filter("title IS NOT NULL")
    return rows.select("id", F.concat(F.lit("Sure:\n```json\n"), F.to_json(made), F.lit("\n```")).alias("answer"))


def _entity(name, kind):
    return F.struct(name.alias("name"), F.lit(kind).alias("type"))


query("l02_entities", "SELECT id, name, type FROM (SELECT id, trim(title) AS name, 'PERSON' AS type, title FROM brain_documents UNION ALL SELECT id, source_type, 'OTHER', title FROM brain_documents UNION ALL SELECT id, source_id, 'CONCEPT', title FROM brain_documents) WHERE title IS NOT NULL AND name <> ''")(lambda s, d: N.entities(_answers(s, d, F.struct(F.array(_entity(col("title"), "person"), _entity(col("source_type"), "PLACE"), _entity(F.lit(" "), "ORG"), _entity(col("source_id"), " Concept ")).alias("entities")))))
query("f28_fifteen", "SELECT id, 15 AS n FROM brain_documents WHERE title IS NOT NULL")(lambda s, d: N.entities(_answers(s, d, F.struct(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: _entity(F.concat(F.lit("e"), i.cast("string")), "ORG")).alias("entities")))).groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n")))
query("l03_relations", "SELECT id, source_id AS source, source_type AS target, CASE WHEN record_id % 2 = 0 THEN 'requested_of' ELSE 'related_to' END AS type, CASE WHEN record_id % 3 = 0 THEN 1.0 ELSE 0.25 END::DOUBLE AS confidence FROM brain_documents WHERE title IS NOT NULL")(lambda s, d: _related(s, d))


def _related(s, d):
    rel = F.struct(col("source_id").alias("source"), col("source_type").alias("target"), F.when(col("record_id") % 2 == 0, "requested_of").otherwise("Requested_of").alias("type"), F.when(col("record_id") % 3 == 0, F.lit(7.0)).otherwise(F.lit(0.25)).alias("confidence"))
    blank = F.struct(F.lit(" ").alias("source"), F.lit("x").alias("target"), F.lit("mentions").alias("type"), F.lit(0.5).alias("confidence"))
    return N.relations(_answers(s, d, F.struct(F.array(rel, blank).alias("relations")))).select("id", "source", "target", "type", col("confidence").cast("double").alias("confidence"))


query("l04_insights", "SELECT id, 'insight:' || id || ':' || i AS source_id, CASE i WHEN 0 THEN trim(title) ELSE 'n' || i END AS insight FROM brain_documents, range(3) t(i) WHERE title IS NOT NULL AND trim(title) <> ''")(lambda s, d: N.insights(_answers(s, d, F.struct(F.array(F.lit(""), col("title"), F.lit("n1"), F.lit("n2"), F.lit("n3")).alias("insights"))).join(docs(s, d).filter("trim(title) <> ''").select("id"), "id", "left_semi")))
query("l01_summaries", "SELECT id, title AS title_summary, title || chr(10) || chr(10) || source_id AS to_embed FROM brain_documents WHERE title IS NOT NULL")(lambda s, d: N.summaries(_answers(s, d, F.struct(col("title").alias("title_summary"), col("source_id").alias("bullet_summary")))).select("id", "title_summary", "to_embed"))
query("l07_grounded", "SELECT source_type AS id, record_id AS at FROM (SELECT source_type, record_id, row_number() OVER (PARTITION BY source_type ORDER BY record_id) AS r FROM brain_documents WHERE length(trim(coalesce(title, ''))) > 0 AND length(title) <= 400 AND record_id % 2 = 0) WHERE r <= 6")(lambda s, d: _grounded(s, d))


def _grounded(s, d):
    sentences = docs(s, d).select(col("source_type").alias("id"), col("record_id").alias("at"), col("title").alias("text"), F.array((col("record_id") % 2).cast("string"), F.lit("0")).alias("cites"))
    return N.grounded(sentences, s.createDataFrame([("0",), ("2",)], "key string")).select("id", "at")


query("l10_prompts", "SELECT query, count(*) AS lines, max(starts_with(p, 'OBSERVED')::INT) AS first FROM (SELECT source_type AS query, unnest(string_split(p, chr(10) || '- [')) AS line, p FROM (SELECT source_type, 'OBSERVED' || string_agg(chr(10) || '- [' || record_id, '') AS p FROM brain_documents WHERE record_id % 40 < 20 GROUP BY 1)) GROUP BY 1")(lambda s, d: _prompts(s, d))


def _prompts(s, d):
    rows = docs(s, d).filter("record_id % 40 < 20").select(col("source_type").alias("query"), F.lit("observed").alias("lane"), col("record_id").alias("rank"), col("title"), "occurred_at")
    return N.prompt(rows).select("query", F.size(F.split("prompt", r"\n- \[")).cast("long").alias("lines"), F.when(col("prompt").startswith("OBSERVED"), 1).otherwise(0).alias("first"))


query("r20_curated", "SELECT record_id AS index, (record_id % 10) / 10.0::DOUBLE AS relevance FROM brain_documents WHERE (record_id % 10) / 10.0 >= 0.3")(lambda s, d: R.curated(docs(s, d).select(col("record_id").alias("index")), docs(s, d).select(col("record_id").alias("index"), (col("record_id") % 10 / 10.0).alias("relevance"))))
query("r16_direction", "SELECT record_id, occurred_at IS NOT NULL AND occurred_at >= TIMESTAMPTZ '2025-06-18 03:00:00+00' AS ascending FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", F.pandas_udf(_ahead, "boolean")("occurred_at").alias("ascending")))


def _ahead(times: pd.Series) -> pd.Series:
    return pd.Series([R.recency_ascending(None if pd.isna(t) else t.to_pydatetime().replace(tzinfo=timezone.utc), NOW) for t in times])


query("f22_messages")(lambda s, d: docs(s, d).filter("content IS NOT NULL").select("record_id", F.posexplode(F.pandas_udf(_messages, "array<string>")("content")).alias("at", "message")))


def _messages(texts: pd.Series) -> pd.Series:
    return texts.map(C.split_message)


query("r22_batches", "SELECT record_id, ceil(length(content) / 1000.0)::INT AS n FROM brain_documents WHERE content IS NOT NULL AND content <> ''")(lambda s, d: docs(s, d).filter("content <> ''").select("record_id", F.pandas_udf(_packs, "int")("content").alias("n")))


def _packs(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(N.packed_batches([t[k : k + 500] for k in range(0, len(t), 500)], 1000)))


query("r23_embedder")(lambda s, d: N.embedded(docs(s, d).filter("content <> ''").select("id", col("content").alias("text")), N.hashing_embedder(64)).select("id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm")))


# f26: speaker blocks
SPEAKERS = """WITH x AS (SELECT record_id AS pos, source_type AS recording, 'S' || (record_id // 3 % 4) AS speaker, coalesce(title, '') AS text FROM brain_documents WHERE record_id % 2 = 0),
    f AS (SELECT recording, speaker, row_number() OVER (PARTITION BY recording ORDER BY min(pos)) AS no FROM x GROUP BY 1, 2),
    g AS (SELECT x.*, no, sum(new) OVER (PARTITION BY recording ORDER BY pos) AS block FROM (SELECT *, (lag(speaker) OVER (PARTITION BY recording ORDER BY pos) IS DISTINCT FROM speaker)::INT AS new FROM x) x JOIN f USING (recording, speaker)),
    b AS (SELECT recording, block, '[화자' || any_value(no) || '] ' || string_agg(trim(text), ' ' ORDER BY pos) AS line FROM g WHERE trim(text) <> '' GROUP BY 1, 2)
    SELECT recording, string_agg(line, chr(10) ORDER BY block) AS content FROM b GROUP BY 1"""
query("f26_speaker_blocks", SPEAKERS)(lambda s, d: _blocks(s, d))


def _blocks(s, d):
    from kelpmill.operators.speakers import blocks

    rows = docs(s, d).filter("record_id % 2 = 0").select(col("source_type").alias("recording"), col("record_id").alias("at"), F.concat(F.lit("S"), (F.floor(col("record_id") / 3) % 4).cast("string")).alias("speaker"), F.coalesce("title", F.lit("")).alias("text"))
    return blocks(rows).select("recording", "content")


# streams: read as streams from the tables, run until all there is has been read
def _streamed(s, d, name: str):
    """The rows of a table as a stream of three micro-batches, in order of record_id."""
    path, rows = _place(s, "in"), T(name)(s, d)
    most = rows.agg(F.max("record_id")).first()[0] or 0
    for n in range(3):
        rows.filter(F.least(F.floor(col("record_id") * 3 / max(most, 1)), F.lit(2)) == n).write.mode("append").parquet(path)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(path)


def _place(s, name: str) -> str:
    import uuid

    return f"{shared_dir(s)}/kelpmill/{s.sparkContext.applicationId}/stream-{name}-{uuid.uuid4().hex}"


def _collected(s, d):
    from kelpmill.streaming.ingest import Snapshot, collect

    target = Snapshot(s, _place(s, "table"), "address string, record_id long, date_ms long, msg_type int")
    stream = _streamed(s, d, "ingest_sms").filter("address IS NOT NULL").select("address", "record_id", "date_ms", "msg_type")
    collect(stream, target, ["address"], "record_id", "sms", _place(s, "checkpoint")).awaitTermination()
    return target.read()


query("st1_collected", "SELECT address, max(record_id) AS record_id, arg_max(date_ms, record_id) AS date_ms, arg_max(msg_type, record_id) AS msg_type FROM ingest_sms WHERE address IS NOT NULL GROUP BY 1")(_collected)


def _twice(s, d):
    """ST5: the batches of a source come again with their ids, as after a writer that died; they change nothing."""
    from kelpmill.streaming.ingest import Snapshot, upserting

    target = Snapshot(s, _place(s, "table"), "address string, record_id long")
    rows = sms(s, d).filter("address IS NOT NULL").select("address", "record_id")
    put = upserting(target, ["address"], "record_id", "sms")
    for n in (0, 1):
        put(rows.filter(col("record_id") % 2 == n), n)
    put(rows.select("address", (-col("record_id")).alias("record_id")), 1)
    return target.read()


query("st5_once", "SELECT address, coalesce(max(record_id) FILTER (record_id % 2 = 1), max(record_id)) AS record_id FROM ingest_sms WHERE address IS NOT NULL GROUP BY 1")(_twice)


def _watermark(s, d):
    """ST2/ST6: a second run of a collector goes on where the first ended and finds nothing new."""
    from kelpmill.streaming.ingest import Snapshot, collect

    path, point = _place(s, "in"), _place(s, "checkpoint")
    rows = log(s, d).select("batch_id", "source_type")
    rows.repartition(4).write.parquet(path)
    target = Snapshot(s, _place(s, "table"), "batch_id long, source_type string, run int")
    for run in (1, 2):
        stream = s.readStream.schema(rows.schema).parquet(path).withColumn("run", F.lit(run))
        collect(stream, target, ["batch_id"], "run", "log", point).awaitTermination()
    return target.read()


query("st2_watermark", "SELECT batch_id, source_type, 1 AS run FROM collection_log")(_watermark)
query("st3_cutover", "SELECT record_id FROM ingest_sms WHERE date_ms >= 1750000000000")(lambda s, d: _cut(s, d))


def _cut(s, d):
    from kelpmill.streaming.ingest import admitted

    return admitted(sms(s, d).select("record_id", "date_ms", col("record_id").cast("string").alias("id")), 0, 1_750_000_000_000, s.createDataFrame([], "id string")).select("record_id")


def _retries(s, d):
    from kelpmill.streaming.ingest import retry_queue

    path, out = _place(s, "retries"), "retries_" + _place(s, "x")[-32:]
    made = log(s, d).filter("started_at IS NOT NULL").groupBy("source_type").agg(F.count_if(col("error_text").isNotNull()).cast("int").alias("n"))
    # each source fails as often as it did in the log, one failure a second
    failures = made.select(F.col("source_type").alias("key"), F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)))).alias("at")).select("key", F.lit(False).alias("ok"), F.col("at").cast("long").alias("at"))
    failures.coalesce(1).sortWithinPartitions("key", "at").write.parquet(path)
    stream = s.readStream.schema(failures.schema).parquet(path)
    retry_queue(stream).writeStream.format("memory").queryName(out).outputMode("update").trigger(availableNow=True).option("checkpointLocation", _place(s, "checkpoint")).start().awaitTermination()
    return s.table(out)


query("st7_retries", "SELECT source_type AS key, greatest(n, 1)::INT AS attempts, greatest(n, 1) >= 10 AS dead, greatest(n, 1) + CASE WHEN greatest(n, 1) <= 1 THEN 300 ELSE least(60, 2 ** (greatest(n, 1) - 1)) * 60 END::BIGINT AS retry_at FROM (SELECT source_type, count(*) FILTER (error_text IS NOT NULL) AS n FROM collection_log GROUP BY 1)")(_retries)


def _worked(s, d):
    from kelpmill.streaming.ingest import work_once

    pending = docs(s, d).filter("embedding IS NULL AND content <> ''").select(col("record_id").alias("id"), "content")
    return work_once(pending, _measured, "id long, n int", 200)


def _measured(frames):
    for pdf in frames:
        yield pd.DataFrame({"id": pdf["id"], "n": pdf["content"].str.len()})


query("st8_worked", "SELECT record_id AS id, length(content)::INT AS n FROM brain_documents WHERE embedding IS NULL AND content <> '' ORDER BY record_id LIMIT 200")(_worked)
query("r11_chunk_vector", f"WITH {PR.CHUNKS}, {PR.QV}, n AS (SELECT count(*) AS n FROM embeddings), e AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS at, embedding FROM embeddings), scored AS (SELECT c.id, chunk_index, {PR.COS.replace('embedding', 'e.embedding')} AS score FROM chunks c JOIN brain_documents b USING (id), n, qv JOIN e ON e.at = (b.record_id * 31 + chunk_index) % n.n WHERE chunk <> '') {PR.BEST}")(lambda s, d: _chunk_vectors(s, d))


def _chunk_vectors(s, d):
    """Chunks with vectors of their own, taken from the table of embeddings."""
    from pyspark.sql import Window

    e = T("embeddings")(s, d)
    n = e.count()  # one number
    vectors = e.select((F.row_number().over(Window.orderBy("vec_id")) - 1).cast("long").alias("at"), "embedding")
    chunks = PR.chunks(s, d).join(docs(s, d).select("id", "record_id"), "id").withColumn("at", (col("record_id") * 31 + col("chunk_index")) % n)
    mine = F.array(*[F.lit(float(x)) for x in PR.vector(s, d)])
    scored = chunks.join(vectors, "at").select("id", "chunk_index", F.round(X.cosine(col("embedding"), mine), 6).alias("score"))
    return R.chunk_best(scored, PR.LIMIT)
