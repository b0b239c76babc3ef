"""Queries of byte cuts, encodings, addresses, one-time codes, file and channel rules, chunk sizes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from kelpmill.functions import text as X
from kelpmill.operators import chunking as C
from kelpmill.operators import enrich as N
from kelpmill.plans.actions import CLAMP
from kelpmill.plans.analytics import AUTH, docs, sms
from kelpmill.plans.registry import registry
from kelpmill.sources import files as FS

QUERIES, SQL, query = registry()
col = F.col
BYTES = "CASE WHEN strlen(content) <= 2000 THEN content ELSE left(content, list_last(list_filter(range(500, 2001), lambda i: strlen(left(content, i)) <= 2000))) || {} END"
URL = "CASE record_id % 4 WHEN 0 THEN ' HTTPS://Www.X.test/' || source_id || '/' WHEN 1 THEN 'http://x.test/' || source_id || '//' WHEN 2 THEN 'x.test/' || source_id || '?utm_source=a#b' ELSE source_id END"
LINK = "CASE record_id % 5 WHEN 0 THEN 'https://CDN.discordapp.com/' WHEN 1 THEN 'https://files.slack.com/x' WHEN 2 THEN 'https://files.slack.com.evil.test/' WHEN 3 THEN 'http://169.254.169.254/' ELSE 'no address' END"
SIZE = "greatest(record_id % 7, 1) * 200 * (CASE record_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 1024 WHEN 2 THEN 1048576 ELSE 1073741824 END)::BIGINT"
SIZE_TEXT = "CASE WHEN {0} >= 1073741824 THEN printf('%.1f GB', {0} / 1073741824.0) WHEN {0} >= 1048576 THEN printf('%.1f MB', {0} / 1048576.0) WHEN {0} >= 1024 THEN printf('%.0f KB', {0} / 1024.0) ELSE {0} || ' B' END"


def _sizes(sources: pd.Series, texts: pd.Series) -> pd.DataFrame:
    options = [C.for_source(k, t or "") for k, t in zip(sources, texts)]
    return pd.DataFrame({"longest": [o.most for o in options], "headings": [o.headings for o in options]})


query("f18_byte_cut", f"SELECT record_id, md5({BYTES.format("chr(10) || '[content truncated]'")}) AS h FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", F.md5(X.truncated(col("content"), 2000)).alias("h")))
query("l01_byte_cut", f"SELECT record_id, md5({BYTES.format("'...'")}) AS h FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", F.md5(N.cut_bytes(col("content"), 2000)).alias("h")))
query("f20_base64url", "SELECT record_id, md5(content) AS h FROM brain_documents WHERE content IS NOT NULL")(lambda s, d: docs(s, d).filter("content IS NOT NULL").select("record_id", F.md5(X.base64url(F.regexp_replace(F.translate(F.base64(F.encode("content", "utf-8")), "+/\r\n", "-_"), "=+$", ""))).alias("h")))
query("f21_shortened", f"SELECT record_id, CASE WHEN length(title) > 12 THEN substr(title, 1, 12) || '…' ELSE title END AS t, {CLAMP.format('title', '12')} AS c FROM brain_documents WHERE title IS NOT NULL")(lambda s, d: docs(s, d).filter("title IS NOT NULL").select("record_id", X.shortened(col("title"), 12).alias("t"), X.clamped(col("title"), 12).alias("c")))
query("f21_url", f"SELECT record_id, regexp_replace(regexp_replace(lower(trim({URL})), '/$', ''), '^(https://)?(http://)?', '') AS u FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", X.normalized_url(F.expr(URL)).alias("u")))
query("f24_codes", f"SELECT record_id, {AUTH.format('body')} AS auth, md5(CASE WHEN {AUTH.format('body')} THEN regexp_replace(body, '\\b\\d{{4,8}}\\b', '[REDACTED]', 'g') ELSE body END) AS h FROM ingest_sms")(lambda s, d: sms(s, d).select("record_id", X.auth_like(col("body")).alias("auth"), F.md5(X.codes_hidden(col("body"))).alias("h")))
query("f49_human_size", f"SELECT record_id, {SIZE_TEXT.format('b')} AS size FROM (SELECT record_id, {SIZE} AS b FROM brain_documents)")(lambda s, d: docs(s, d).select("record_id", X.human_size(F.expr(SIZE)).alias("size")))
query("f51_file_name", "SELECT record_id, trim(regexp_replace(title, '[^A-Za-z0-9-]+', '_', 'g'), '_') AS n FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", X.safe_file_name(col("title")).alias("n")))
query("f52_number", "SELECT record_id, coalesce(nullif(regexp_replace(address, '[^0-9+-]', '', 'g'), ''), 'unknown') AS n FROM ingest_sms")(lambda s, d: sms(s, d).select("record_id", X.safe_number(col("address")).alias("n")))
query("f53_snowflake", "SELECT record_id, CASE WHEN date_ms > 1420070400000 THEN ((date_ms - 1420070400000) * 4194304)::VARCHAR ELSE '' END AS id FROM ingest_sms")(lambda s, d: sms(s, d).select("record_id", X.snowflake(F.timestamp_millis("date_ms")).alias("id")))
query("f54_mention", "SELECT record_id, md5(replace(replace('<@7> ' || body || '<@!7><@70>', '<@7>', ''), '<@!7>', '')) AS h FROM ingest_sms")(lambda s, d: sms(s, d).select("record_id", F.md5(X.without_mention(F.concat(F.lit("<@7> "), "body", F.lit("<@!7><@70>")), "7")).alias("h")))
query("f55_fetch_hosts", "SELECT record_id, (source_type = 'discord' AND record_id % 5 = 0) OR (source_type = 'slack' AND record_id % 5 = 1) AS ok FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", X.fetch_allowed(F.expr(LINK), col("source_type")).alias("ok")))
HEAD = "CASE record_id % 3 WHEN 0 THEN '0000ftyp' WHEN 1 THEN 'RIFF' ELSE '' END || coalesce(content, '')"
query("f56_audio", f"SELECT record_id, CASE WHEN strlen({HEAD}) < 8 THEN 'too short' WHEN record_id % 2 = 0 AND record_id % 3 <> 0 AND substr({HEAD}, 5, 4) <> 'ftyp' THEN 'no m4a file' END AS fault FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", FS.audio_fault(F.expr("CASE record_id % 2 WHEN 0 THEN 'a.M4A' ELSE 'a.mp3' END"), F.encode(F.expr(HEAD), "utf-8")).alias("fault")))
query("f57_korean_time", "SELECT record_id, CASE WHEN occurred_at IS NULL THEN '시각 정보 없음' ELSE strftime(t, '%Y-%m-%d(') || ['일', '월', '화', '수', '목', '금', '토'][dayofweek(t) + 1] || strftime(t, ') %H:%M') END AS at FROM (SELECT record_id, occurred_at, occurred_at AT TIME ZONE 'UTC' + INTERVAL 9 HOUR AS t FROM brain_documents)")(lambda s, d: docs(s, d).select("record_id", X.korean_time(col("occurred_at")).alias("at")))
query("c06_sizes", "SELECT record_id, CASE WHEN source_type IN ('slack', 'discord', 'telegram') THEN 1500 WHEN source_type IN ('secretary', 'llm-memory') THEN 2500 ELSE 4000 END AS longest, CASE WHEN source_type IN ('slack', 'discord', 'telegram', 'secretary', 'llm-memory') THEN false WHEN source_type IN ('filesystem', 'notion', 'github', 'gdrive') THEN coalesce(contains(content, chr(10) || chr(10)) OR len(list_filter(string_split(content, chr(10))[:50], lambda x: starts_with(trim(x, ' ' || chr(9) || chr(13)), '#'))) > 0, false) ELSE true END AS headings FROM brain_documents")(lambda s, d: docs(s, d).select("record_id", F.pandas_udf(_sizes, "longest int, headings boolean")("source_type", "content").alias("o")).select("record_id", "o.*"))

# files of many kinds made of the documents
EXT = "(CASE record_id % 8 WHEN 0 THEN 'md' WHEN 1 THEN 'gdoc' WHEN 2 THEN 'png' WHEN 3 THEN 'zip' WHEN 4 THEN 'xyz' WHEN 5 THEN 'json' WHEN 6 THEN 'gsheet' ELSE 'txt' END)"
DATA = f"(CASE WHEN {EXT} = 'gdoc' THEN left('see \"https://x.test/d/' || source_id || '\" ' || coalesce(content, ''), 1500) WHEN {EXT} = 'gsheet' THEN '' ELSE coalesce(content, '') END)"
INFO = "'{}: ' || name || chr(10) || 'Path: ' || path || chr(10) || 'Size: ' || " + SIZE_TEXT.format("size")
query(
    "f50_content",
    f"""WITH f AS (SELECT record_id, source_id || '.' || {EXT} AS name, 'dir/' || source_id || '.' || {EXT} AS path, {EXT} AS ext, {DATA} AS data, strlen({DATA}) AS size FROM brain_documents)
    SELECT record_id, md5(CASE WHEN ext IN ('md', 'json', 'txt') THEN CASE WHEN size > 524288 THEN {INFO.format('File')} || chr(10) || '[large file — metadata only]' WHEN data = '' THEN {INFO.format('File')} || chr(10) || '[content unavailable]' ELSE regexp_replace(data, '\\n{{3,}}', chr(10) || chr(10), 'g') END
        WHEN ext IN ('gdoc', 'gsheet') AND size = 0 THEN 'File: ' || name || chr(10) || 'Path: ' || path || chr(10) || '[Google Drive stub — metadata only]' WHEN ext = 'gdoc' AND size > 1024 THEN {INFO.format('File')} || chr(10) || '[content too large for inline indexing]'
        WHEN ext = 'gdoc' THEN 'Google Doc: ' || name || chr(10) || 'Path: ' || path || chr(10) || 'URL: ' || regexp_extract(data, 'https?://[^\\s"'']+') WHEN ext = 'png' THEN {INFO.format('Image')} WHEN ext = 'zip' THEN {INFO.format('Archive')} ELSE {INFO.format('File')} END) AS h FROM f""",
)(lambda s, d: _contents(s, d))


def _contents(s, d):
    name = F.concat("source_id", F.lit("."), F.expr(EXT))
    f = docs(s, d).select("record_id", name.alias("name"), F.concat(F.lit("dir/"), name).alias("path"), F.expr(EXT).alias("ext"), F.encode(F.expr(DATA.replace('\\"', '"')), "utf-8").alias("data"))
    return f.select("record_id", F.md5(FS.content(col("name"), col("path"), col("ext"), F.octet_length("data"), col("data"))).alias("h"))
