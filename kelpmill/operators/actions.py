"""Actions read off message threads: thread keys, counterparts, what awaits a reply, and the counts of a briefing.

Messages are documents of mail, SMS, call log and call transcripts; what is known of them stands in their metadata.
Everything is a column expression, but for encoded words in a mail header, which go through an Arrow function.
"""

from __future__ import annotations

from email.header import decode_header, make_header

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpmill.functions import text as X

SOURCES = ("gmail", "sms", "call-log", "call-transcript")
SUMMARY = 80  # characters of a card
#: Names of the media and of ages on a card.
CHANNELS = {"gmail": "메일", "sms": "문자", "call-transcript": "통화 녹취"}
CALLS = {"missed": "부재중 전화", "voicemail": "음성 메시지"}
NOBODY, UNDATED, TODAY, YESTERDAY, DAYS = "상대방 미상", "미응답", "오늘부터 미응답", "어제부터 미응답", "일째 미응답"


def meta(key: str, metadata: str = "metadata") -> Column:
    """A text value of the metadata; blank where there is none."""
    return F.coalesce(X.json_text(F.col(metadata), key), F.lit(""))


def _contact(other: Column) -> Column:
    return F.when(meta("contact_name") != "", meta("contact_name")).when(meta("number") != "", X.short_hash(meta("number"))).otherwise(other)


def thread_key() -> Column:
    """calls and their transcripts share a thread; a number stands in for a contact by its hash only."""
    source = F.col("source_type")
    mail = F.when(meta("thread_id") != "", F.concat(F.lit("gmail:"), meta("thread_id")))
    who = _contact(F.lit("unknown"))
    return F.when(source == "gmail", mail).when(source == "sms", F.concat(F.lit("sms:"), who)).when(source.isin("call-log", "call-transcript"), F.concat(F.lit("call:"), who))


def is_mine(address: Column, mine: list[str]) -> Column:
    """one of the user's own addresses, in whatever case."""
    known = [m.strip().lower() for m in mine if m.strip()]
    return F.lower(F.trim(address)).isin(*known) if known else F.lit(False)


def counterpart(mine: list[str] = ()) -> Column:
    """who the thread is with, as it enters identity keys; null for the user's own mail and for other sources."""
    source = F.col("source_type")
    sender = F.when((meta("from") != "") & ~is_mine(meta("from"), list(mine)), meta("from"))
    return F.when(source == "gmail", sender).when(source.isin(*SOURCES), _contact(F.lit("unknown")))


def _decoded(headers: pd.Series) -> pd.Series:
    def one(h):
        try:
            return None if h is None else str(make_header(decode_header(h)))
        except (ValueError, LookupError):
            return h

    return headers.map(one, na_action="ignore")


def sender_name(header: Column) -> Column:
    """the display name of a sender's header, the bare address where there is none; blank for an unusable one."""
    encoded = F.when(header.contains("=?"), header)  # others pass the function as null
    text = F.trim(F.coalesce(F.pandas_udf(_decoded, "string")(encoded), header))
    name = F.trim(F.regexp_replace(F.trim(F.regexp_extract(text, "^(.*)<[^<>]*>", 1)), "^[\"']+|[\"']+$", ""))
    address = F.trim(F.regexp_extract(text, "<([^<>]+)>", 1))
    bare = F.regexp_replace(text, "^[\"']+|[\"']+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(address, F.lit("")), bare, F.lit(""))


def display() -> tuple[Column, Column]:
    """(name to show, its entity type); null where nobody can be named."""
    source = F.col("source_type")
    name = F.when(source == "gmail", sender_name(meta("from"))).when(source.isin(*SOURCES), F.coalesce(F.nullif(F.trim(meta("contact_name")), F.lit("")), F.trim(meta("number"))))
    kind = F.when((source == "gmail") | (F.trim(meta("contact_name")) != ""), "PERSON").otherwise("OTHER")
    name = F.nullif(name, F.lit(""))
    return name, F.when(name.isNotNull(), kind)


def channel() -> Column:
    source = F.col("source_type")
    out = F.when(source == "call-log", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CALLS.items() for x in kv]), meta("direction")), F.lit("통화")))
    for k, v in CHANNELS.items():
        out = out.when(source == k, v)
    return out.otherwise("메시지")


def age(at: Column, now: Column) -> Column:
    """How long a message waits, in local calendar days."""
    days = F.datediff(X.local_day(now), X.local_day(at))
    return F.when(at.isNull(), UNDATED).when(days <= 0, TODAY).when(days == 1, YESTERDAY).otherwise(F.concat(days.cast("string"), F.lit(DAYS)))


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once; generated code stays small."""
    return F.transform(F.array(value), use)[0]


def awaiting_summary(who: Column, title: Column, at: Column, now: Column) -> Column:
    """who, medium, subject of a mail and age, in at most 80 characters; the age is never cut."""
    subject = F.when(F.col("source_type") == "gmail", X.collapsed(F.coalesce(title, F.lit("")))).otherwise("")
    head = F.concat(F.coalesce(F.nullif(X.collapsed(who), F.lit("")), F.lit(NOBODY)), F.lit(" · "), channel())
    parts = F.struct(F.concat(F.lit(" · "), age(at, now)).alias("tail"), head.alias("head"), subject.alias("subject"))

    def cut(p: Column) -> Column:
        budget = F.lit(SUMMARY) - F.length(p["tail"])
        room = budget - F.length(p["head"]) - 3  # a blank and two quotation marks
        quoted = F.when((p["subject"] != "") & (room >= 4), F.concat(F.lit(' "'), X.clamped(p["subject"], room), F.lit('"'))).otherwise("")
        return _let(F.concat(p["head"], quoted), lambda whole: F.concat(X.clamped(whole, budget), p["tail"]))

    return _let(parts, cut)


def latest_per_thread(docs: DataFrame, since: Column) -> DataFrame:
    """The newest message of each thread since a time, authentication messages aside; undated ones take no part.

    One aggregation with partial results, no window: a hot thread is no burden to a task. Ties go to the greater
    record_id. Columns: thread, record_id, source_type, title, metadata, occurred_at, collected_at.
    """
    source = F.col("source_type")
    key = F.when(source == "gmail", F.concat(F.lit("gmail:"), X.json_text(F.col("metadata"), "thread_id"))).otherwise(F.concat(F.when(source == "sms", "sms:").otherwise("call:"), meta("contact_name")))
    rows = docs.filter(source.isin(*SOURCES) & (F.col("status") == "active") & (F.col("occurred_at") >= since))
    rows = rows.filter((source != "sms") | (meta("is_auth_like") != "true"))
    newest = F.max(F.struct("occurred_at", "record_id", "source_type", "title", "metadata", "collected_at")).alias("_m")
    return rows.groupBy(key.alias("thread")).agg(newest).select("thread", "_m.*")


def outcomes(latest: DataFrame, mine: list[str] = ()) -> DataFrame:
    """What becomes of each thread's newest message, in a column `outcome`."""
    out = (
        F.when(meta("is_auth_like") == "true", "skipped_auth_like")
        .when(X.outbound(F.col("source_type"), meta("direction")), "skipped_outbound")
        .when(counterpart(mine).isNull(), "skipped_no_counterpart")
        .when(thread_key().isNull(), "skipped_no_thread_key")
        .otherwise("written")
    )
    return latest.withColumn("outcome", out)


def awaiting(latest: DataFrame, now: Column, mine: list[str] = ()) -> DataFrame:
    """One action for every thread that awaits a reply: identity, thread, record_id, summary, name, entity type."""
    name, kind = display()
    rows = outcomes(latest.drop("thread"), mine).filter("outcome = 'written'")
    rows = rows.withColumn("thread", thread_key()).withColumn("_who", counterpart(mine)).withColumn("name", name).withColumn("entity_type", kind)
    identity = X.identity_key(F.col("thread"), F.lit("awaiting_my_reply"), F.col("_who"), F.lit(""))
    return rows.select(identity.alias("identity"), "thread", "record_id", awaiting_summary(F.col("name"), F.col("title"), F.col("occurred_at"), now).alias("summary"), "name", "entity_type")


def action_counts(actions: DataFrame) -> DataFrame:
    """The briefing without a model: one text of counts by kind, in fixed order, with its documents and keys.

    actions: kind, document_id, identity. No actions give no row. Documents and keys are those of one user's briefing.
    """
    count = lambda cond: F.count_if(cond)
    known = F.coalesce(F.col("kind").isin(*X.ACTION_KINDS), F.lit(False))
    per = actions.agg(*[count(F.col("kind") == k).alias(k) for k in X.ACTION_KINDS], count(~known).alias("_rest"), F.array_sort(F.collect_set(F.nullif("document_id", F.lit("")))).alias("documents"), F.array_sort(F.collect_list(F.nullif("identity", F.lit("")))).alias("keys"), F.count(F.lit(1)).alias("_n"))
    parts = [F.when(F.col(k) > 0, F.concat(F.lit(v + " "), F.col(k).cast("string"), F.lit("건"))) for k, v in {**X.ACTION_KINDS, "_rest": "기타"}.items()]
    return per.filter("_n > 0").select(F.concat(F.concat_ws(", ", *parts), F.lit(".")).alias("text"), "documents", "keys")
