"""Queries of files, message mappers, exports, pushes and notes, over raw records made of the tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from kelpmill.functions import text as X
from kelpmill.operators import evaluate as E
from kelpmill.operators import enrich as N
from kelpmill.operators import retrieval as R
from kelpmill.operators import state as S
from kelpmill.plans import retrieval as PR
from kelpmill.plans.analytics import AUTH, T, calls, docs, gmail, log, sms
from kelpmill.plans.registry import registry
from kelpmill.session import shared_dir
from kelpmill.sources import extract as EX
from kelpmill.sources import files as FS
from kelpmill.sources import messages as M

QUERIES, SQL, query = registry()
col = F.col
ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)

# messages
WAY = "CASE msg_type WHEN 1 THEN 'received' WHEN 2 THEN 'sent' WHEN 3 THEN 'draft' WHEN 4 THEN 'outbox' WHEN 5 THEN 'failed' WHEN 6 THEN 'queued' ELSE 'unknown' END"
CALL = "CASE call_type WHEN 1 THEN 'incoming' WHEN 2 THEN 'outgoing' WHEN 3 THEN 'missed' WHEN 4 THEN 'voicemail' WHEN 5 THEN 'rejected' WHEN 6 THEN 'blocked' ELSE 'unknown' END"
HIDDEN = f"CASE WHEN {AUTH.format('body')} THEN regexp_replace(body, '\\b\\d{{4,8}}\\b', '[REDACTED]', 'g') ELSE coalesce(body, '') END"
query("s23_sms_documents", f"SELECT 'sms:' || date_ms || ':' || substr(sha256(coalesce(address, '')), 1, 16) || ':' || {WAY} AS source_id, 'SMS ' || {WAY} || ' ' || coalesce(nullif(contact_name, ''), address, '') AS title, md5({HIDDEN}) AS content, {AUTH.format('body')}::VARCHAR AS auth, coalesce(address, '') AS number FROM ingest_sms")(
    lambda s, d: M.map_sms(sms(s, d)).select("source_id", "title", F.md5("content").alias("content"), F.get_json_object("metadata", "$.is_auth_like").alias("auth"), F.get_json_object("metadata", "$.number").alias("number"))
)
WHO = "coalesce(nullif(contact_name, ''), {})"
CALL_DOC = f"SELECT 'call-log:' || date_ms || ':' || substr(sha256(coalesce(number, '')), 1, 16) || ':' || substr(sha256(coalesce(duration_sec, 0)::VARCHAR), 1, 8) AS source_id, {CALL} || ' 통화 ' || {{0}} AS title, md5('상대방: ' || {{0}} || chr(10) || '통화 방향: ' || {CALL} || chr(10) || '시각: ' || strftime(make_timestamp(date_ms * 1000), '%Y-%m-%d %H:%M:%S UTC') || chr(10) || '통화 시간: ' || coalesce(duration_sec, 0) || 's') AS content, make_timestamp(date_ms * 1000) AS occurred_at FROM ingest_calls"
query("s23_call_documents", CALL_DOC.format(WHO.format("coalesce(number, '')")))(lambda s, d: M.map_calls(calls(s, d)).select("source_id", "title", F.md5("content").alias("content"), ntz("occurred_at")))
query("s23_hashed_calls", CALL_DOC.format(WHO.format("'상대 ' || substr(sha256(coalesce(number, '')), 1, 8)")))(lambda s, d: M.map_calls(calls(s, d), hashed_numbers=True).select("source_id", "title", F.md5("content").alias("content"), ntz("occurred_at")))
query("s14_gmail_documents", "SELECT 'gmail:' || message_id AS source_id, subject AS title, md5(regexp_replace('<p>' || content || '</p>', '<[^>]*(>|\\z)|>', '', 'g')) AS content, make_timestamp(internal_date::BIGINT * 1000) AS occurred_at FROM gmail_messages LEFT JOIN (SELECT source_id, min(content) AS content FROM brain_documents WHERE source_type = 'gmail' GROUP BY 1) ON source_id = 'gmail:' || message_id")(lambda s, d: _gmail(s, d))


def _gmail(s, d):
    bodies = docs(s, d).filter("source_type = 'gmail'").groupBy("source_id").agg(F.min("content").alias("content"))
    g = gmail(s, d).withColumn("source_id", F.concat(F.lit("gmail:"), "message_id")).join(bodies, "source_id", "left")
    headers = F.array(*[F.struct(F.lit(n).alias("name"), col(c).alias("value")) for n, c in (("Subject", "subject"), ("FROM", "from_header"), ("To", "to_header"))])
    data = F.translate(F.base64(F.encode(F.concat(F.lit("<p>"), "content", F.lit("</p>")), "utf-8")), "+/\r\n", "-_")
    parts = F.array(F.struct(F.lit("text/html").alias("mimeType"), data.alias("data")))
    raw = g.select(col("message_id").alias("id"), col("thread_id").alias("threadId"), col("internal_date").alias("internalDate"), headers.alias("headers"), parts.alias("parts"))
    return M.map_gmail(raw).select("source_id", "title", F.md5("content").alias("content"), ntz("occurred_at"))


KEY = "regexp_replace(regexp_replace(lower(trim({})), '/$', ''), '^(https://)?(http://)?', '')"
FEED = "CASE record_id % 3 WHEN 0 THEN ' HTTPS://x.test/' || source_id || '/ ' WHEN 1 THEN 'http://x.test/' || source_id ELSE 'x.test/' || source_id || '#top' END"
query("s30_feed_dedup", f"SELECT DISTINCT {KEY.format(FEED)} AS u FROM brain_documents WHERE {KEY.format(FEED)} NOT IN (SELECT 'x.test/gmail:' || lower(message_id) FROM gmail_messages)")(
    lambda s, d: M.new_feed_items(docs(s, d).select(F.expr(FEED).alias("url")), gmail(s, d).select(F.concat(F.lit("https://x.test/gmail:"), "message_id").alias("url"))).select(X.normalized_url(col("url")).alias("u"))
)
query("s29_valid_notes", "SELECT record_id, CASE WHEN regexp_full_match(coalesce(title, ''), '\\s*') THEN 'title is required' WHEN strlen(title) > 1024 THEN 'title is too long' WHEN regexp_full_match(coalesce(content, ''), '\\s*') THEN 'content is required' WHEN strlen(content) > 10485760 THEN 'content is too long' END AS fault FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", M.note_fault(col("title"), col("content")).alias("fault")))
PUSH = "CASE record_id % 5 WHEN 0 THEN 'voice-memo' WHEN 1 THEN 'fax' ELSE 'call' END"
NAME = "CASE WHEN record_id % 5 = 0 THEN CASE WHEN record_id % 2 = 0 THEN 'My memo, ' || record_id || '.MP3' END WHEN record_id % 7 = 0 THEN 'x.m4a' ELSE 'x.wav' END"
BYTES = "CASE record_id % 4 WHEN 0 THEN '0000ftyp' WHEN 1 THEN 'short' ELSE 'RIFF0000' END"
query(
    "s28_recording_outcome",
    f"SELECT record_id, CASE WHEN record_id % 5 = 1 THEN 'unknown kind' WHEN record_id % 5 > 1 AND coalesce(number, '') = '' THEN 'number is required' WHEN coalesce(date_ms, 0) = 0 THEN 'date is required' WHEN date_ms < 1750000000000 THEN 'skipped' WHEN record_id % 4 = 1 THEN 'too short' WHEN record_id % 5 <> 0 AND record_id % 7 = 0 AND record_id % 4 <> 0 THEN 'no m4a file' ELSE 'accepted' END AS outcome FROM ingest_calls",
)(lambda s, d: calls(s, d).select("record_id", M.recording_outcome(F.expr(PUSH), col("number"), col("date_ms"), 1_750_000_000_000, F.expr(NAME), F.encode(F.expr(BYTES), "utf-8")).alias("outcome")))
STAMP = "strftime(make_timestamp(date_ms * 1000), '%Y%m%d%H%M%S')"
query(
    "s28_recordings",
    f"""SELECT CASE WHEN record_id % 5 = 0 THEN 'call-log:voice-memo:' || substr(sha256(CASE WHEN record_id % 2 = 0 THEN 'My memo, ' || record_id || '.MP3' ELSE date_ms::VARCHAR END), 1, 8) ELSE 'call-log:' || date_ms || ':' || substr(sha256(coalesce(number, '')), 1, 16) || ':' || substr(sha256(coalesce(duration_sec, 0)::VARCHAR), 1, 8) END AS source_id,
    CASE WHEN record_id % 10 = 0 THEN 'voice-memo_' || {STAMP} || '_My_memo_' || record_id || '.MP3' WHEN record_id % 5 = 0 THEN 'voice-memo_' || {STAMP} || '.m4a' ELSE coalesce(nullif(regexp_replace(number, '[^0-9+-]', '', 'g'), ''), 'unknown') || '_' || {STAMP} || CASE WHEN record_id % 7 = 0 THEN '.m4a' ELSE '.wav' END END AS file_name FROM ingest_calls""",
)(lambda s, d: M.map_recordings(calls(s, d).select(F.expr(PUSH).alias("kind"), "number", "date_ms", "duration_sec", F.expr(NAME).alias("file_name"))))
query("s13_github", "SELECT source_id || '#' || record_id AS source_id, CASE WHEN record_id % 3 = 0 THEN 'pr' ELSE 'issue' END AS kind, coalesce(content, '') AS content FROM brain_documents WHERE source_type = 'github'")(
    lambda s, d: M.map_github(docs(s, d).filter("source_type = 'github'").select(col("source_id").alias("repo"), col("record_id").alias("number"), "title", col("content").alias("body"), F.lit("open").alias("state"), F.lit("2025-06-01T00:00:00Z").alias("updated_at"), F.expr("CASE WHEN record_id % 3 = 0 THEN 'x' END").alias("pull_request"))).select("source_id", F.get_json_object("metadata", "$.kind").alias("kind"), "content")
)
query("s15_calendar", "SELECT 'calendar:' || record_id AS source_id, concat_ws(chr(10), nullif(content, ''), 'Location: ' || nullif(title, ''), CASE WHEN record_id % 2 = 0 THEN 'Attendees: a, b' END) AS content FROM brain_documents WHERE source_type = 'calendar'")(
    lambda s, d: M.map_calendar(docs(s, d).filter("source_type = 'calendar'").select(col("record_id").cast("string").alias("id"), col("title").alias("summary"), col("content").alias("description"), col("title").alias("location"), F.expr("CASE WHEN record_id % 2 = 0 THEN array('a', 'b') ELSE array() END").alias("attendees"), F.lit("2025-06-01").alias("start"), F.lit(None).cast("boolean").alias("all_day"))).select("source_id", "content")
)
query("s16_notion", "SELECT 'notion:' || record_id AS source_id, md5(concat_ws(chr(10), '# ' || nullif(title, ''), '- ' || nullif(content, ''), '[ ] todo')) AS content FROM brain_documents WHERE source_type = 'notion'")(
    lambda s, d: M.map_notion(docs(s, d).filter("source_type = 'notion'").select(col("record_id").cast("string").alias("id"), "title", F.expr("array(struct('heading_2' AS type, coalesce(title, '') AS text), struct('bulleted_list_item' AS type, coalesce(content, '') AS text), struct('to_do' AS type, 'todo' AS text))").alias("blocks"), F.lit("2025-06-01").alias("edited"))).select("source_id", F.md5("content").alias("content"))
)
query("s17_telegram", "SELECT (record_id % 3) || ':' || record_id AS source_id, coalesce(nullif(CASE WHEN record_id % 2 = 0 THEN content END, ''), title) AS content FROM brain_documents WHERE record_id % 3 < 2 AND coalesce(nullif(CASE WHEN record_id % 2 = 0 THEN content END, ''), title) <> ''")(
    lambda s, d: M.map_telegram(docs(s, d).select((col("record_id") % 3).alias("chat_id"), col("record_id").alias("message_id"), F.lit(1_750_000_000).cast("long").alias("date"), F.expr("CASE WHEN record_id % 2 = 0 THEN content END").alias("text"), col("title").alias("caption"), F.lit(None).cast("string").alias("from_name")), [0, 1], F.lit("2025-01-01").cast("timestamp")).select("source_id", "content")
)
query("s18_discord", "SELECT source_type || ':' || record_id AS source_id, concat_ws(chr(10), nullif(content, ''), CASE WHEN record_id % 2 = 0 THEN title END) AS content FROM brain_documents WHERE concat_ws(chr(10), nullif(content, ''), CASE WHEN record_id % 2 = 0 THEN title END) <> ''")(
    lambda s, d: M.map_discord(docs(s, d).select(col("source_type").alias("channel"), col("record_id").cast("string").alias("id"), F.lit("a").alias("author"), "content", F.expr("CASE WHEN record_id % 2 = 0 AND title IS NOT NULL THEN array(title) ELSE array() END").alias("attachments"), F.lit("2025-06-01").alias("at"))).select("source_id", "content")
)
query("s19_drive", "SELECT record_id, CASE WHEN record_id % 3 = 0 THEN NULL ELSE replace(source_id, ':', '_') END AS id FROM brain_documents WHERE length(source_id) >= 10 AND NOT regexp_matches(source_id, '[^A-Za-z0-9:_-]')")(
    lambda s, d: docs(s, d).filter("length(source_id) >= 10 AND NOT source_id rlike '[^A-Za-z0-9:_-]'").select("record_id", M.drive_file_id(F.expr("CASE record_id % 3 WHEN 0 THEN 'https://x.test/nothing' WHEN 1 THEN 'https://x.test/d/' || replace(source_id, ':', '_') || '/edit' ELSE 'https://x.test/open?a=1&id=' || replace(source_id, ':', '_') END")).alias("id"))
)
query("s24_memories", "SELECT 'memory:' || record_id AS source_id, title, md5(content) AS content FROM (SELECT record_id, coalesce(nullif(title, ''), 'memory') AS title, trim(concat_ws(chr(10) || chr(10), nullif(trim(title), ''), nullif(trim(content), ''))) AS content FROM brain_documents WHERE updated_at > TIMESTAMPTZ '2025-06-10 00:00:00+00') WHERE content <> ''")(
    lambda s, d: M.map_memories(docs(s, d).select(col("record_id").alias("id"), col("title").alias("summary"), "content", "updated_at"), F.expr("TIMESTAMP '2025-06-10 00:00:00'")).select("source_id", "title", F.md5("content").alias("content"))
)
query("l13_curated", "SELECT record_id AS id, record_id % 10 AS relevance FROM brain_documents WHERE record_id % 4 <> 1")(lambda s, d: M.judged_items(docs(s, d).select(col("record_id").alias("id"), "title", col("source_id").alias("url")), _judge).select(col("id").cast("long").alias("id"), F.get_json_object("verdict", "$.relevance").cast("long").alias("relevance")))


def _judge(items: list[dict]) -> list[dict]:
    """A stand-in that passes over a quarter of the items and answers for one nobody asked about."""
    return [{"id": int(i["id"]), "relevance": int(i["id"]) % 10} for i in items if i["id"] % 4 != 1] + [{"id": -1, "relevance": 9}]


# exports: written to the shared folder and read again
def _folder(s, name: str) -> str:
    return f"{shared_dir(s)}/kelpmill/{name}-{s.sparkContext.applicationId}"


def _sms_xml(s, d):
    path = _folder(s, "sms-xml")
    rows = sms(s, d).select(*[col(c).cast("string").alias(a) for c, (a, _) in M.SMS_XML.items() if c != "body"])
    rows.write.mode("overwrite").format("xml").option("rowTag", "sms").option("rootTag", "smses").save(path)
    return M.sms_xml(s, path).select("address", "date_ms", "msg_type", "contact_name")


def _calls_xml(s, d):
    path = _folder(s, "call-xml")
    rows = calls(s, d).select(*[col(c).cast("string").alias(a) for c, (a, _) in M.CALL_XML.items()])
    rows.write.mode("overwrite").format("xml").option("rowTag", "call").option("rootTag", "calls").save(path)
    return M.calls_xml(s, path).select("number", "date_ms", "duration_sec", "call_type")


query("s20_sms_xml", "SELECT address, date_ms, msg_type, contact_name FROM ingest_sms WHERE date_ms IS NOT NULL")(_sms_xml)
query("s21_calls_xml", "SELECT number, date_ms, duration_sec, call_type FROM ingest_calls WHERE date_ms IS NOT NULL")(_calls_xml)
query("s26_ingest_split_batches", "SELECT batch_id, count(*) FILTER (address IS NULL OR trim(address) = '' OR date_ms IS NULL OR date_ms <= 0 OR NOT coalesce(msg_type BETWEEN 1 AND 6, false)) AS errors FROM ingest_sms GROUP BY 1")(lambda s, d: M.ingest_split(sms(s, d), 0).groupBy("batch_id").agg(F.count_if(col("outcome") == "error").alias("errors")))

# files made of the documents: packed in each format, then read by its extractor
LINES = "list_filter(list_transform(string_split(regexp_replace(coalesce(content, ''), '[^ -~\\n가-힣À-ÿ]', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _lines(text: str | None) -> list[str]:
    import re

    return [x for x in (x.strip(" ") for x in re.sub("[^ -~\n가-힣À-ÿ]", "", text or "").split("\n")) if x]


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _docx(lines):
    return _zip({"word/document.xml": "<w:d xmlns:w='u'>" + "".join(f"<w:p><w:t>{escape(x)}</w:t></w:p>" for x in lines) + "</w:d>"})


def _pptx(lines):
    return _zip({f"ppt/slides/slide{k}.xml": "<s xmlns:a='u'>" + "".join(f"<a:p><a:t>{escape(x)}</a:t></a:p>" for x in lines) + "</s>" for k in (1, 2)})


def _hwpx(lines):
    half = len(lines) // 2
    return _zip({f"Contents/section{n}.xml": "<s xmlns='u'>" + "".join(f"<p><t>{escape(x)}</t></p>" for x in part) + "</s>" for n, part in ((10, lines[half:]), (2, lines[:half]))})


def _xlsx(lines):
    rows = "".join(f"<row><c t='s'><v>{k}</v></c><c><v>{k}</v></c></row>" for k, _ in enumerate(lines))
    return _zip({"xl/workbook.xml": "<w><sheet name='S1'/><sheet name='S2'/></w>", "xl/sharedStrings.xml": "<s>" + "".join(f"<si><t>{escape(x)}</t></si>" for x in lines) + "</s>", "xl/worksheets/sheet1.xml": f"<d>{rows}</d>", "xl/worksheets/sheet2.xml": "<d/>"})


def _html(lines):
    return ("<html><style>p{}</style><body>" + "".join(f"<p>{escape(x)}</p>" for x in lines) + "<script>var a='<p>';</script></body></html>").encode()


def _through(kind: str, pack):
    def run(s, d):
        @F.pandas_udf("binary")
        def packed(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: pack(_lines(t)))

        return docs(s, d).select("record_id", F.md5(EX.extracted(packed("content"), F.lit(f"a.{kind}"))).alias("h"))

    return run


WHOLE = f"coalesce(array_to_string({LINES}, chr(10)), '')"
query("s06_html_text", f"SELECT record_id, md5({WHOLE}) AS h FROM brain_documents")(_through("html", _html))
query("s08_docx", f"SELECT record_id, md5({WHOLE}) AS h FROM brain_documents")(_through("docx", _docx))
query("s09_xlsx", f"SELECT record_id, md5(CASE WHEN len({LINES}) = 0 THEN '' ELSE '##SHEET S1' || chr(10) || array_to_string(list_transform({LINES}, lambda x, i: x || chr(9) || (i - 1)), chr(10)) END) AS h FROM brain_documents WHERE strlen(coalesce(content, '')) <= 100000")(lambda s, d: _through("xlsx", _xlsx)(s, d).join(docs(s, d).filter("octet_length(coalesce(content, '')) <= 100000").select("record_id"), "record_id", "left_semi"))
query("s10_pptx", f"SELECT record_id, md5(rtrim('--- Slide 1 ---' || chr(10) || {WHOLE}, chr(10)) || chr(10) || chr(10) || rtrim('--- Slide 2 ---' || chr(10) || {WHOLE}, chr(10))) AS h FROM brain_documents WHERE len({LINES}) > 0")(lambda s, d: _through("pptx", _pptx)(s, d).join(docs(s, d).filter(F.regexp_replace(F.coalesce("content", F.lit("")), "[^!-~가-힣À-ÿ]", "") != "").select("record_id"), "record_id", "left_semi"))
query("s11_hwpx", f"SELECT record_id, md5({WHOLE}) AS h FROM brain_documents")(_through("hwpx", _hwpx))
query("s05_extractors", f"SELECT record_id, CASE WHEN record_id % 4 = 3 THEN NULL ELSE md5({WHOLE}) END AS h FROM brain_documents")(lambda s, d: _dispatched(s, d))


def _dispatched(s, d):
    """The extension decides; a file that is not what it says gives nothing."""
    kinds = {0: ("html", _html), 1: ("docx", _docx), 2: ("hwpx", _hwpx), 3: ("docx", lambda lines: b"broken")}

    @F.pandas_udf("binary")
    def packed(ids: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([kinds[i % 4][1](_lines(t)) for i, t in zip(ids, texts)])

    name = F.concat(F.lit("a."), F.element_at(F.array(*[F.lit(kinds[k][0]) for k in range(4)]), (col("record_id") % 4 + 1).cast("int")))
    return docs(s, d).select("record_id", F.md5(EX.extracted(packed("record_id", "content"), name)).alias("h"))


def _scan(s, d):
    """The test folder itself as a collection; contents are not read."""
    return FS.scan(s, d)


query("s01_scan")(lambda s, d: _scan(s, d).select("source_id", "name", "ext", "size"))
query("s03_live_ids")(lambda s, d: FS.live_ids(_scan(s, d)))
query("s22_latest_export")(lambda s, d: FS.latest_by_prefix(_scan(s, d), "o"))
query("s04_file_documents", f"SELECT source_id || '.md' AS source_id, 'a/b' AS dir, md5(CASE WHEN coalesce(content, '') = '' THEN 'File: x.md' || chr(10) || 'Path: ' || source_id || '.md' || chr(10) || 'Size: 0 B' || chr(10) || '[content unavailable]' WHEN strlen(content) > 524288 THEN NULL ELSE regexp_replace(content, '\\n{{3,}}', chr(10) || chr(10), 'g') END) AS content FROM (SELECT 'a/b/' || source_id AS source_id, content FROM brain_documents WHERE strlen(coalesce(content, '')) <= 524288)")(
    lambda s, d: FS.documents(docs(s, d).filter("octet_length(coalesce(content, '')) <= 524288").select(F.concat(F.lit("a/b/"), "source_id", F.lit(".md")).alias("source_id"), F.lit("x.md").alias("name"), F.lit("md").alias("ext"), F.octet_length(F.coalesce("content", F.lit(""))).cast("long").alias("size"), col("updated_at").alias("mtime"), F.encode(F.coalesce("content", F.lit("")), "utf-8").alias("content"))).select("source_id", F.get_json_object("metadata", "$.dir").alias("dir"), F.md5("content").alias("content"))
)
NAMED = f"CASE record_id % 4 WHEN 0 THEN '010_' || {STAMP} || '-1.m4a' WHEN 1 THEN 'Voice_' || strftime(make_timestamp(date_ms * 1000), '%y%m%d_%H%M%S') || '.m4a' WHEN 2 THEN 'call_20251399999999.m4a' ELSE 'call_20250601_120000x.m4a' END"
query("f36_recorded_at", "SELECT record_id, CASE WHEN record_id % 4 < 2 THEN date_trunc('second', make_timestamp(date_ms * 1000)) ELSE received_at AT TIME ZONE 'UTC' END AS at FROM ingest_calls")(
    lambda s, d: calls(s, d).select("record_id", FS.recorded_at(F.expr("CASE record_id % 4 WHEN 0 THEN '010_' || date_format(timestamp_millis(date_ms), 'yyyyMMddHHmmss') || '-1.m4a' WHEN 1 THEN 'Voice_' || date_format(timestamp_millis(date_ms), 'yyMMdd_HHmmss') || '.m4a' WHEN 2 THEN 'call_20251399999999.m4a' ELSE 'call_20250601_120000x.m4a' END"), col("received_at")).cast("timestamp_ntz").alias("at"))
)
KNOWN = "SELECT source_id FROM brain_documents WHERE source_id IS NOT NULL"
query("p26_known_ids", "SELECT 'transcript' AS rule, recording_id AS id FROM (SELECT DISTINCT recording_id FROM whisper_segments) WHERE recording_id NOT IN (SELECT source_id FROM brain_documents WHERE source_type = 'call-transcript' AND source_id IS NOT NULL) UNION ALL SELECT 'file', record_id::VARCHAR FROM brain_documents WHERE updated_at > TIMESTAMPTZ '2025-06-20 00:00:00+00' OR source_id NOT IN (SELECT 'gmail:' || message_id FROM gmail_messages)")(lambda s, d: _known(s, d))


def _known(s, d):
    recordings = T("whisper_segments")(s, d).select(col("recording_id").alias("source_id")).distinct()
    heard = FS.untranscribed(recordings, None, docs(s, d).filter("source_type = 'call-transcript'").select("source_id"))
    mails = gmail(s, d).select(F.concat(F.lit("gmail:"), "message_id").alias("source_id"))
    files = FS.incremental(docs(s, d).select("record_id", "source_id", col("updated_at").alias("mtime")), F.expr("TIMESTAMP '2025-06-20 00:00:00'"), mails)
    return heard.select(F.lit("transcript").alias("rule"), col("source_id").alias("id")).unionByName(files.select(F.lit("file").alias("rule"), col("record_id").cast("string").alias("id")))


# sinks: what was written is read again
def _pairs_file(s, d):
    from kelpmill.operators import analytics as A
    from kelpmill.plans.analytics import events

    path = _folder(s, "eval-pairs")
    M.write_eval_pairs(A.eval_pairs(A.feedback(events(s, d))).select("query", "relevant", "irrelevant"), path)
    return s.read.schema("query string, relevant array<string>, irrelevant array<string>").json(path).select("query", F.size("relevant").alias("relevant"), F.size("irrelevant").alias("irrelevant"))


def _graph_files(s, d, token: str = "a"):
    from kelpmill.plans.state import edges

    path = _folder(s, "graph")
    mentions = PR.mentions(s, d).select(col("id").alias("document_id"), col("name").alias("entity_id"))
    M.project_graph(edges(s, d), mentions, path, token)
    rel = s.read.parquet(f"{path}/relations").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return rel.unionByName(s.read.parquet(f"{path}/mentions").agg(F.lit("mention").alias("type"), F.count(F.lit(1)).alias("n")))


def _rebuilt(s, d):
    _graph_files(s, d, "a").count()
    return _graph_files(s, d, "b")  # another token: everything is written anew


from kelpmill.plans.analytics import FB, PAIRS  # noqa: E402
from kelpmill.plans.state import EDGES  # noqa: E402

query("s31_eval_file", f"WITH {FB} SELECT query, len(relevant) AS relevant, len(irrelevant) AS irrelevant FROM ({PAIRS})")(_pairs_file)
GRAPH = f"WITH {EDGES}, {PR.MENTIONS} SELECT type, count(*) AS n FROM (SELECT DISTINCT from_id, to_id, type FROM e) GROUP BY 1 UNION ALL SELECT 'mention', count(*) FROM (SELECT DISTINCT id, name FROM mentions)"
query("s33_graph_files", GRAPH)(_graph_files)
query("s34_graph_rebuilt", GRAPH)(_rebuilt)

# notes, weights, runs, turns
NOTE = "json_object('enrichment_status', CASE record_id % 3 WHEN 0 THEN 'failed' ELSE 'pending' END, 'n', record_id)"
query("m16_enrichment_states", "SELECT record_id, CASE WHEN record_id % 3 = 0 THEN 'pending' WHEN record_id % 4 >= 3 THEN 'failed' ELSE 'pending' END AS state, CASE WHEN record_id % 3 = 0 THEN 0 WHEN record_id % 4 < 3 THEN greatest(record_id % 4, 1) END AS attempts, record_id AS n, CASE WHEN record_id % 3 <> 0 AND record_id % 4 < 3 THEN CASE WHEN record_id % 4 = 2 THEN '2025-07-01 00:05:00' ELSE '2025-07-01 00:01:00' END END AS again FROM brain_documents WHERE source_type = 'note'")(lambda s, d: _lifecycle(s, d))


def _lifecycle(s, d):
    """Failed notes are reset; pending ones fail for the first, second or third time."""
    state = F.to_json(F.struct(F.when(col("record_id") % 3 == 0, "failed").otherwise("pending").alias("enrichment_status"), col("record_id").alias("n")))
    rows = docs(s, d).filter("source_type = 'note'").select("record_id", state.alias("m"))
    failed = N.attempt_failed(col("m"), F.greatest(col("record_id") % 4, F.lit(1)).cast("int"), F.lit("no answer"), F.expr("TIMESTAMP '2025-07-01 00:00:00'"))
    after = rows.select("record_id", F.when(col("record_id") % 3 == 0, N.note_reset(col("m"))).otherwise(failed).alias("m"))
    at = F.date_format(F.try_to_timestamp(F.get_json_object("m", "$.enrichment_next_retry_at")), "yyyy-MM-dd HH:mm:ss")
    return after.select("record_id", F.get_json_object("m", "$.enrichment_status").alias("state"), F.get_json_object("m", "$.enrichment_attempts").cast("long").alias("attempts"), F.get_json_object("m", "$.n").cast("long").alias("n"), at.alias("again"))


query("f41_types_kept", "SELECT record_id, CASE WHEN metadata IS NULL THEN '{\"k\":[1]}' END AS whole, metadata->'$.label_ids' AS labels, '[1]' AS k FROM brain_documents WHERE source_type = 'gmail'")(lambda s, d: docs(s, d).filter("source_type = 'gmail'").select("record_id", S.merged_json(col("metadata"), F.lit('{"k": [1]}')).alias("m"), col("metadata").isNull().alias("_n")).select("record_id", F.when(col("_n"), col("m")).alias("whole"), F.get_json_object("m", "$.label_ids").alias("labels"), F.get_json_object("m", "$.k").alias("k")))
query("r10_active_weights", "SELECT 0.5::DOUBLE AS fts, 2.0::DOUBLE AS vec UNION ALL SELECT 1, 1")(lambda s, d: _weights(s, d))


def _weights(s, d):
    """Once with an active set, once with one whose weights are all zero."""
    sets = T("nation")(s, d).select(col("n_nationkey").alias("id"), F.when(col("n_nationkey") == 7, "active").otherwise("superseded").alias("status"), F.when(col("n_nationkey") == 7, 0.5).otherwise(3.0).alias("fts"), F.lit(2.0).alias("vec"))
    configured = s.range(1).select(F.lit(1.0).alias("fts"), F.lit(1.0).alias("vec"))
    return S.active_weights(sets, configured).unionByName(S.active_weights(sets.withColumn("fts", F.lit(0.0)).withColumn("vec", F.lit(0.0)), configured))


query("r14_snippets", f"WITH {PR.CHUNKS} SELECT c.id, title, source_type, chunk AS snippet, 'chunk-vector' AS match_type FROM chunks c JOIN brain_documents USING (id) WHERE chunk LIKE '%the parcel%'")(lambda s, d: R.snippets(PR.chunks(s, d).filter("chunk LIKE '%the parcel%'").withColumn("score", F.lit(1.0)), docs(s, d), "chunk-vector").drop("score"))
query("u05_ordered_union", "SELECT message_id, array_to_string(list_concat(['INBOX'], list_filter(list_distinct_ordered, lambda x: x <> 'INBOX')), ',') AS labels FROM (SELECT message_id, list_filter(coalesce(label_ids, []), lambda x, i: list_position(label_ids, x) = i) AS list_distinct_ordered FROM gmail_messages)")(lambda s, d: gmail(s, d).select("message_id", F.array_join(R.ordered_union(F.array(F.lit("INBOX")), col("label_ids")), ",").alias("labels")))
query("t06_stable_order", "SELECT event_id, place FROM (SELECT event_id, row_number() OVER (ORDER BY round(value) DESC, event_id) AS place FROM events) WHERE place <= 100")(lambda s, d: _stable(s, d))


def _stable(s, d):
    from pyspark.sql import Window

    top = R.by_score(T("events")(s, d).select("event_id", F.round("value").alias("score")), "event_id").limit(100)  # the list of a search
    return top.select("event_id", F.row_number().over(Window.orderBy(F.desc("score"), "event_id")).alias("place"))


query(
    "e08_reindex",
    """WITH r AS (SELECT source_type, max(finished_at) FILTER (error_text IS NULL) AS last FROM collection_log GROUP BY 1), n AS (SELECT source_type, count(*) AS total, count(*) FILTER (status = 'active') / count(*) AS before, count(*) FILTER (status = 'active' AND embedding IS NOT NULL) / count(*) AS after FROM brain_documents GROUP BY 1)
    SELECT source_type, CASE WHEN last IS NULL THEN 'never indexed' ELSE concat_ws(',', CASE WHEN TIMESTAMPTZ '2025-07-05 00:00:00+00' - last >= INTERVAL 7 DAY THEN 'stale' END, CASE WHEN total >= 1000 THEN 'grown' END, CASE WHEN before <> 0 AND (before - after) / before >= 0.05 THEN 'worse' END) END AS reasons FROM n LEFT JOIN r USING (source_type)""",
)(lambda s, d: _reindex(s, d))


def _reindex(s, d):
    last = log(s, d).groupBy("source_type").agg(F.max(F.when(col("error_text").isNull(), col("finished_at"))).alias("last"))
    n = docs(s, d).groupBy("source_type").agg(F.count(F.lit(1)).alias("total"), F.avg((col("status") == "active").cast("double")).alias("before"), F.avg(((col("status") == "active") & col("embedding").isNotNull()).cast("double")).alias("after"))
    reasons = E.reindex_reasons(col("last"), F.expr("TIMESTAMP '2025-07-05 00:00:00'"), F.lit(0), col("total"), [col("before")], [col("after")])
    return n.join(last, "source_type", "left").select("source_type", F.array_join(reasons, ",").alias("reasons"))


query("m18_append", "SELECT batch_id AS id, documents_count AS n FROM collection_log UNION ALL SELECT (SELECT max(batch_id) FROM collection_log) + row_number() OVER (ORDER BY source_type), n FROM (SELECT source_type, count(*)::INT AS n FROM brain_documents GROUP BY 1)")(lambda s, d: _appended(s, d))


def _appended(s, d):
    history = log(s, d).select(col("batch_id").alias("id"), col("documents_count").alias("n"), "source_type")
    run = docs(s, d).groupBy("source_type").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return S.appended(history, run).select("id", "n")


query("m19_turn_ids", "SELECT record_id, CASE WHEN record_id % 3 = 0 OR id IS NULL OR id = '' THEN 'new' ELSE id END AS id FROM brain_documents")(lambda s, d: _turns(s, d))


def _turns(s, d):
    made = docs(s, d).select("record_id", F.when(col("record_id") % 6 == 0, S.NO_ID).when(col("record_id") % 6 == 3, "").otherwise(col("id")).alias("given")).withColumn("id", S.turn_id(col("given")))
    fresh = ~col("id").eqNullSafe(col("given")) & col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    return made.select("record_id", F.when(fresh, "new").otherwise(col("id")).alias("id"))


query("l05_retry_after", "SELECT n, CASE WHEN n <= 1 THEN 1 WHEN n = 2 THEN 5 ELSE 30 END AS minutes FROM range(8) t(n)")(lambda s, d: s.range(8).select(col("id").alias("n"), N.retry_after(col("id").cast("int")).alias("minutes")))
query("f32_cache_key", "SELECT source_type, sha256('v1|m|' || strftime(max(updated_at) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') || '|' || string_agg(DISTINCT status, chr(10) ORDER BY status)) AS k FROM brain_documents GROUP BY 1")(lambda s, d: docs(s, d).groupBy("source_type").agg(F.max("updated_at").alias("at"), F.collect_set("status").alias("s")).select("source_type", N.cache_key("v1", "m", col("at"), col("s")).alias("k")))
query("l12_projection", PR.WITH + "SELECT id, title, source_type, score, occurred_at FROM (SELECT * FROM rrf ORDER BY score DESC, id LIMIT 20) JOIN brain_documents USING (id)")(lambda s, d: R.answer_sources(R.hybrid_search(docs(s, d), PR.query(s, d), PR.NOW)))
query("m20_rekeyed", "SELECT record_id, CASE WHEN source_type = 'sms' AND status = 'active' AND coalesce(metadata->>'$.direction', '') <> '' AND first THEN 'sms:' || split_part(source_id, ':', 2) || ':' || split_part(source_id, ':', 3) || ':' || (metadata->>'$.direction') ELSE CASE WHEN source_type = 'sms' THEN 'sms:' || split_part(source_id, ':', 2) || ':' || split_part(source_id, ':', 3) || ':0a1b2c3d' ELSE source_id END END AS source_id, CASE WHEN source_type = 'sms' AND status = 'active' AND coalesce(metadata->>'$.direction', '') <> '' AND NOT first THEN 'deleted' ELSE status END AS status FROM (SELECT *, row_number() OVER (PARTITION BY source_type = 'sms' AND status = 'active' AND coalesce(metadata->>'$.direction', '') <> '', split_part(source_id, ':', 2), split_part(source_id, ':', 3), metadata->>'$.direction' ORDER BY updated_at DESC, id DESC) = 1 AS first FROM brain_documents)")(lambda s, d: _rekeyed(s, d))


def _rekeyed(s, d):
    old = F.when(col("source_type") == "sms", F.concat(F.lit("sms:"), F.split_part("source_id", F.lit(":"), F.lit(2)), F.lit(":"), F.split_part("source_id", F.lit(":"), F.lit(3)), F.lit(":0a1b2c3d"))).otherwise(col("source_id"))
    rows = docs(s, d).select("record_id", "id", "source_type", old.alias("source_id"), "status", "metadata", "updated_at")
    return S.rekeyed(rows, most_conflicts=1 << 40).select("record_id", "source_id", "status")


query("m20_split_backfill", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'kept' WHEN q IS NULL OR trim(q) = '' THEN NULL WHEN ('0x' || substr(md5('sbfeedback:v1:' || lower(trim(q))), 1, 8))::BIGINT % 100 < 70 THEN 'train' ELSE 'holdout' END AS split FROM (SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' ' || event_type || user_id END AS q FROM events)")(lambda s, d: S.split_backfilled(T("events")(s, d).select("event_id", F.expr("CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE ' ' || event_type || user_id END").alias("query"), F.expr("CASE WHEN event_id % 5 = 0 THEN 'kept' END").alias("split"))).select("event_id", "split"))
query("p17_claimed", "SELECT record_id FROM brain_documents WHERE embedding IS NULL AND record_id % 3 <> 0 ORDER BY record_id LIMIT 100")(lambda s, d: S.claimed(docs(s, d).filter("embedding IS NULL").select("record_id"), docs(s, d).filter("record_id % 3 = 0").select("record_id"), "record_id", 100))
