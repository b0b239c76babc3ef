"""Message exports and service dumps as documents: SMS and call XML, chat, mail, calendar, issues, pages, memories.

Each mapper takes a DataFrame of raw records and gives source_type, source_id, title, content, metadata, occurred_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpmill.functions import text as X
from kelpmill.sources.files import audio_fault

OUT = ("source_type", "source_id", "title", "content", "metadata", "occurred_at")
SMS_XML = {"address": ("_address", "string"), "body": ("_body", "string"), "date_ms": ("_date", "bigint"), "msg_type": ("_type", "int"), "contact_name": ("_contact_name", "string")}
CALL_XML = {"number": ("_number", "string"), "date_ms": ("_date", "bigint"), "duration_sec": ("_duration", "int"), "call_type": ("_type", "int"), "contact_name": ("_contact_name", "string")}


def _doc(rows: DataFrame, kind: str, id_: Column, title: Column, content: Column, meta: dict[str, Column], at: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("source_type"), id_.alias("source_id"), title.alias("title"), content.alias("content"), F.to_json(F.struct(*[c.alias(k) for k, c in meta.items()])).alias("metadata"), at.alias("occurred_at"))


def _xml(spark: SparkSession, path: str, tag: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Attributes are read as text and cast leniently: a malformed element or value becomes null, not an error."""
    raw = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("ignoreSurroundingSpaces", "false").schema(", ".join(f"{a} string" for a, _ in fields.values())).load(path)
    return raw.select(*[F.expr(f"try_cast({a} AS {t})").alias(n) for n, (a, t) in fields.items()]).filter("date_ms IS NOT NULL")


def sms_xml(spark: SparkSession, path: str) -> DataFrame:
    """Broken elements fall away, a truncated file gives what it has."""
    return _xml(spark, path, "sms", SMS_XML)


def calls_xml(spark: SparkSession, path: str) -> DataFrame:
    """S21."""
    return _xml(spark, path, "call", CALL_XML)


def map_sms(sms: DataFrame, hashed_numbers: bool = False) -> DataFrame:
    """Id of time, hash of the address and direction; one-time codes hidden. The address itself stands in the
    metadata only if numbers need not be hashed."""
    way, auth = X.direction(F.col("msg_type")), X.auth_like(F.col("body"))
    address = F.coalesce("address", F.lit(""))
    key = F.concat(F.lit("sms:"), F.col("date_ms").cast("string"), F.lit(":"), X.short_hash(address), F.lit(":"), way)
    title = F.concat(F.lit("SMS "), way, F.lit(" "), F.coalesce(F.nullif("contact_name", F.lit("")), address))
    meta = {"contact_name": F.coalesce("contact_name", F.lit("")), "direction": way, "is_auth_like": auth} | ({} if hashed_numbers else {"number": address})
    return _doc(sms, "sms", key, title, X.codes_hidden(F.coalesce("body", F.lit(""))), meta, F.timestamp_millis("date_ms"))


def map_calls(calls: DataFrame, hashed_numbers: bool = False) -> DataFrame:
    """Id of time and the hashes of number and duration; an unnamed caller shows by number, or by its hash if
    numbers are to be hashed."""
    way, number = X.call_kind(F.col("call_type")), F.coalesce("number", F.lit(""))
    length = F.coalesce("duration_sec", F.lit(0))
    key = F.concat(F.lit("call-log:"), F.col("date_ms").cast("string"), F.lit(":"), X.short_hash(number), F.lit(":"), X.short_hash(length.cast("string"), 8))
    unnamed = F.concat(F.lit("상대 "), X.short_hash(number, 8)) if hashed_numbers else number
    who = F.coalesce(F.nullif("contact_name", F.lit("")), unnamed)
    at = F.timestamp_millis("date_ms")
    time = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd HH:mm:ss 'UTC'")
    content = F.concat(F.lit("상대방: "), who, F.lit("\n통화 방향: "), way, F.lit("\n시각: "), time, F.lit("\n통화 시간: "), length.cast("string"), F.lit("s"))
    meta = {"contact_name": F.coalesce("contact_name", F.lit("")), "direction": way, "duration_seconds": length} | ({} if hashed_numbers else {"number": number})
    return _doc(calls, "call-log", key, F.concat(way, F.lit(" 통화 "), who), content, meta, at)


def recording_outcome(kind: Column, number: Column, date_ms: Column, cutover_ms: int, name: Column, data: Column) -> Column:
    """Why a pushed recording is refused, 'skipped' if it is older than the cutover, or 'accepted'."""
    memo = F.coalesce(F.nullif(kind, F.lit("")), F.lit("call"))
    audio = audio_fault(name, data)
    return (
        F.when(~memo.isin("call", "voice-memo"), "unknown kind")
        .when((memo == "call") & (F.coalesce(number, F.lit("")) == ""), "number is required")
        .when(F.coalesce(date_ms, F.lit(0)) == 0, "date is required")
        .when(date_ms < cutover_ms, "skipped")
        .when(data.isNull(), "file is required")
        .when(audio.isNotNull(), audio)
        .otherwise("accepted")
    )


def map_recordings(pushed: DataFrame, hashed_numbers: bool = False, zone: str = "UTC") -> DataFrame:
    """(source_id, file_name) of pushed recordings. pushed: kind, number, date_ms, duration_sec, file_name.

    A call is known by time and the hashes of number and duration, a memo by the hash of its file name, or of its
    time where it has none."""
    memo, given = F.col("kind") == "voice-memo", F.coalesce("file_name", F.lit(""))
    number, length = F.coalesce("number", F.lit("")), F.coalesce("duration_sec", F.lit(0)).cast("string")
    day = F.date_format(F.from_utc_timestamp(F.to_utc_timestamp(F.timestamp_millis("date_ms"), F.current_timezone()), zone), "yyyyMMddHHmmss")
    ending = F.coalesce(F.nullif(F.regexp_extract(given, r"(\.[^./\\]*)$", 1), F.lit("")), F.lit(".m4a"))
    hashed = X.short_hash(F.when(given != "", given).otherwise(F.col("date_ms").cast("string")), 8)
    base = F.coalesce(F.nullif(X.safe_file_name(F.regexp_replace(given, r"\.[^./\\]*$", "")), F.lit("")), hashed)
    memo_file = F.concat(F.lit("voice-memo_"), day, F.when(given != "", F.concat(F.lit("_"), base)).otherwise(""), ending)
    call_file = F.concat(X.short_hash(number) if hashed_numbers else X.safe_number(number), F.lit("_"), day, ending)
    call_id = F.concat(F.lit("call-log:"), F.col("date_ms").cast("string"), F.lit(":"), X.short_hash(number), F.lit(":"), X.short_hash(length, 8))
    return pushed.select(F.when(memo, F.concat(F.lit("call-log:voice-memo:"), hashed)).otherwise(call_id).alias("source_id"), F.when(memo, memo_file).otherwise(call_file).alias("file_name"))


def map_gmail(messages: DataFrame) -> DataFrame:
    """S14. messages: id, threadId, internalDate, headers array<struct<name,value>>, parts array<struct<mimeType,data>>."""
    header = lambda name: F.get(F.filter("headers", lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]
    part = lambda kind: F.decode(X.base64url(F.get(F.filter("parts", lambda p: p["mimeType"] == kind), F.lit(0))["data"]), "utf-8")
    body = F.coalesce(part("text/plain"), X.stripped_tags(part("text/html")))
    return _doc(messages, "gmail", F.concat(F.lit("gmail:"), "id"), header("subject"), body, {"thread_id": F.col("threadId"), "from": header("from"), "to": header("to")}, F.timestamp_millis(F.col("internalDate").cast("long")))


def map_slack(messages: DataFrame) -> DataFrame:
    """S12. messages: channel, ts, user, text, thread_ts; repeated timestamps of a channel count once."""
    rows = messages.filter("text <> ''").dropDuplicates(["channel", "ts"])
    return _doc(rows, "slack", F.concat_ws(":", "channel", "ts"), F.concat(F.lit("#"), "channel"), F.col("text"), {"user": F.col("user"), "thread": F.col("thread_ts")}, F.timestamp_seconds(F.col("ts").cast("double")))


def map_github(issues: DataFrame) -> DataFrame:
    """S13. issues: repo, number, title, body, state, updated_at, pull_request."""
    kind = F.when(F.col("pull_request").isNotNull(), "pr").otherwise("issue")
    return _doc(issues, "github", F.concat(F.col("repo"), F.lit("#"), F.col("number").cast("string")), F.col("title"), F.coalesce("body", F.lit("")), {"kind": kind, "state": F.col("state")}, X.parsed_time(F.col("updated_at")))


def map_calendar(events: DataFrame) -> DataFrame:
    """S15. events: id, summary, description, location, attendees array<string>, start, all_day."""
    people = F.when(F.size("attendees") > 0, F.concat(F.lit("Attendees: "), F.array_join("attendees", ", ")))
    content = F.concat_ws("\n", F.nullif("description", F.lit("")), F.concat(F.lit("Location: "), F.nullif("location", F.lit(""))), people)
    return _doc(events, "calendar", F.concat(F.lit("calendar:"), "id"), F.col("summary"), content, {"all_day": F.coalesce("all_day", F.lit(False)), "attendees": F.col("attendees")}, X.parsed_time(F.col("start")))


def map_notion(pages: DataFrame) -> DataFrame:
    """S16. pages: id, title, blocks array<struct<type,text>>, edited."""
    mark = lambda b: F.when(b["type"].startswith("heading"), F.concat(F.lit("# "), b["text"])).when(b["type"].isin("bulleted_list_item", "numbered_list_item"), F.concat(F.lit("- "), b["text"])).when(b["type"] == "to_do", F.concat(F.lit("[ ] "), b["text"])).otherwise(b["text"])
    return _doc(pages, "notion", F.concat(F.lit("notion:"), "id"), F.col("title"), F.array_join(F.transform(F.filter("blocks", lambda b: b["text"] != ""), mark), "\n"), {"blocks": F.size("blocks")}, X.parsed_time(F.col("edited")))


def map_telegram(updates: DataFrame, chats: list[int], since: Column) -> DataFrame:
    """S17. updates: chat_id, message_id, date, text, caption, from_name; only allowed chats, nothing before since."""
    rows = updates.filter(F.col("chat_id").isin(chats) & (F.timestamp_seconds("date") >= since)).withColumn("_t", F.coalesce(F.nullif("text", F.lit("")), "caption")).filter("_t <> ''")
    return _doc(rows, "telegram", F.concat_ws(":", F.col("chat_id").cast("string"), F.col("message_id").cast("string")), F.coalesce("from_name", F.lit("unknown")), F.col("_t"), {"chat_id": F.col("chat_id")}, F.timestamp_seconds("date"))


def reaction_feedback(reactions: DataFrame, bot: str) -> DataFrame:
    """Votes on messages of the bot by others. reactions: message_id, author, user, emoji."""
    thumbs = F.when(F.col("emoji") == "👍", 1).when(F.col("emoji") == "👎", -1)
    return reactions.filter((F.col("author") == bot) & (F.col("user") != bot)).select("message_id", "user", thumbs.alias("thumbs")).filter("thumbs IS NOT NULL")


def map_discord(messages: DataFrame) -> DataFrame:
    """S18. messages: channel, id, author, content, attachments array<string>, at."""
    body = F.concat_ws("\n", F.nullif("content", F.lit("")), F.when(F.size("attachments") > 0, F.array_join("attachments", "\n")))
    rows = messages.withColumn("_b", body).filter("_b <> ''")
    return _doc(rows, "discord", F.concat_ws(":", "channel", "id"), F.col("author"), F.col("_b"), {"channel": F.col("channel")}, X.parsed_time(F.col("at")))


def drive_file_id(url: Column) -> Column:
    """The file id in a link or a stub file."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/d/([\w-]{10,})", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"[?&]id=([\w-]{10,})", 1), F.lit("")))


def map_drive(files: DataFrame) -> DataFrame:
    """S19. files: id, name, text, modified."""
    return _doc(files, "gdrive", F.concat(F.lit("gdrive:"), "id"), F.col("name"), F.coalesce("text", F.lit("")), {"id": F.col("id")}, X.parsed_time(F.col("modified")))


def map_memories(rows: DataFrame, since: Column) -> DataFrame:
    """S24. rows: id, summary, content, updated_at."""
    body = F.trim(F.concat_ws("\n\n", F.nullif(F.trim("summary"), F.lit("")), F.nullif(F.trim("content"), F.lit(""))))
    fresh = rows.filter(F.col("updated_at") > since).withColumn("_b", body).filter("_b <> ''")
    return _doc(fresh, "llm-memory", F.concat(F.lit("memory:"), F.col("id").cast("string")), F.coalesce(F.nullif("summary", F.lit("")), F.lit("memory")), F.col("_b"), {"id": F.col("id")}, F.col("updated_at"))


def ingest_split(batch: DataFrame, cutover_ms: int) -> DataFrame:
    """Outcome of each pushed record: error, skipped (before the cutover) or accepted. batch: address, body, date_ms, msg_type."""
    bad = F.col("address").isNull() | (F.trim("address") == "") | F.col("date_ms").isNull() | (F.col("date_ms") <= 0) | ~F.coalesce(F.col("msg_type").between(1, 6), F.lit(False))
    return batch.withColumn("outcome", F.when(bad, "error").when(F.col("date_ms") < cutover_ms, "skipped").otherwise("accepted"))


def new_feed_items(items: DataFrame, seen: DataFrame) -> DataFrame:
    """Feed items whose normalised URL is new, once each. items: url, title; seen: url."""
    key = lambda df: df.withColumn("_u", X.normalized_url(F.col("url")))
    return key(items).dropDuplicates(["_u"]).join(key(seen).select("_u").distinct(), "_u", "left_anti").drop("_u")


MOST_TITLE_BYTES, MOST_NOTE_BYTES = 1024, 10 * 1024 * 1024  # fixed values


def note_fault(title: Column, content: Column, title_required: bool = True) -> Column:
    """Why a note can't be saved, or null."""
    blank = lambda c: F.coalesce(c, F.lit("")).rlike(r"(?U)^\s*$")
    no_title = blank(title) if title_required else F.lit(False)
    return (
        F.when(no_title, "title is required")
        .when(F.octet_length(F.coalesce(title, F.lit(""))) > MOST_TITLE_BYTES, "title is too long")
        .when(blank(content), "content is required")
        .when(F.octet_length(content) > MOST_NOTE_BYTES, "content is too long")
    )


def judged_items(items: DataFrame, service, batch: int = 25) -> DataFrame:
    """Feed items judged by a service in batches; (id, verdict) of the items it answers for.

    items: id int, title, url. service takes a list of {id, title, url} and gives a list of objects with an id and
    whatever else it finds; ids that were not asked for fall away, a batch that fails gives no rows and harms no other.
    """
    import json

    def run(frames):
        import pandas as pd

        for pdf in frames:
            for lo in range(0, len(pdf), batch):
                part = pdf.iloc[lo : lo + batch]
                try:
                    answers = service(part.to_dict("records"))
                except Exception:  # noqa: BLE001 - a service may fail in any way
                    continue
                asked = set(part["id"])
                good = [a for a in answers if a.get("id") in asked]
                yield pd.DataFrame({"id": [a["id"] for a in good], "verdict": [json.dumps(a, ensure_ascii=False, sort_keys=True) for a in good]})

    return items.select(F.col("id").cast("int").alias("id"), "title", "url").mapInPandas(run, "id int, verdict string")


def write_eval_pairs(pairs: DataFrame, path: str) -> None:
    """One JSON object a line."""
    pairs.write.mode("overwrite").json(path)


def write_graph(edges: DataFrame, mentions: DataFrame, path: str) -> None:
    """Full projection: relations by type, mentions once each."""
    edges.dropDuplicates(["from_id", "to_id", "type"]).write.mode("overwrite").partitionBy("type").parquet(f"{path}/relations")
    mentions.dropDuplicates(["document_id", "entity_id"]).write.mode("overwrite").parquet(f"{path}/mentions")


def project_graph(edges: DataFrame, mentions: DataFrame, path: str, token: str) -> None:
    """Another token than that of the last projection wipes it and writes everything anew; the same token writes
    over it. The token stands beside the data and is written last, so a projection that broke off is made again."""
    spark = edges.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path
    fs = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
    mark = folder(f"{path}/token")
    before = spark.read.text(f"{path}/token").first()[0] if fs.exists(mark) else None
    if before != token:
        fs.delete(folder(path), True)
    write_graph(edges, mentions, path)
    out = fs.create(mark, True)
    out.write(bytearray(token.encode()))
    out.close()
