"""Corpus, collection, feedback and thread analytics: aggregations, windows, joins, ordered lists, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kelpmill.functions import text as X


def logical_source(source: str = "source_type", metadata: str = "metadata") -> Column:
    """The retired secretary source counts as the kind in its metadata."""
    kind = F.nullif(X.json_text(F.col(metadata), "kind"), F.lit(""))
    return F.when(F.col(source) == "secretary", F.coalesce(kind, F.col(source))).otherwise(F.col(source))


def counts_by_source(docs: DataFrame) -> DataFrame:
    """A01/A23."""
    return docs.filter("status = 'active'").groupBy(logical_source().alias("source")).agg(F.count(F.lit(1)).alias("n"))


def length_stats(docs: DataFrame) -> DataFrame:
    """Exact continuous percentiles of the content length."""
    n = F.length("content")
    return docs.filter("status = 'active'").groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(n), 4).alias("mean"), F.round(F.percentile(n, F.lit(0.5)), 4).alias("p50"), F.round(F.percentile(n, F.lit(0.95)), 4).alias("p95"), F.max(n).alias("longest"))


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """Chunks: id, chunk."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg(F.octet_length("chunk")), 4).alias("mean_bytes"), F.round(F.coalesce(F.count(F.lit(1)) / F.nullif(F.countDistinct("id"), F.lit(0)), F.lit(0.0)), 6).alias("per_document"))


def failure_counts(log: DataFrame) -> DataFrame:
    """Runs with an error, split by a flag (here: never finished)."""
    return log.groupBy("source_type").agg(F.count_if(F.col("error_text").isNotNull() & F.col("finished_at").isNull()).alias("dead"), F.count_if(F.col("error_text").isNotNull() & F.col("finished_at").isNotNull()).alias("open"))


def coverage(docs: DataFrame, column: str) -> DataFrame:
    """Share of active documents with a value."""
    return docs.filter("status = 'active'").agg(F.round(F.coalesce(F.avg(F.col(column).isNotNull().cast("double")), F.lit(0.0)), 6).alias("coverage"))


def last_collected(docs: DataFrame) -> DataFrame:
    """By source and over all (source null)."""
    return docs.rollup("source_type").agg(F.max("collected_at").alias("last_collected"))


def baseline(docs: DataFrame, log: DataFrame) -> DataFrame:
    """One row per source of A02, A04 and A06."""
    last = docs.groupBy("source_type").agg(F.max("collected_at").alias("last_collected"))
    return length_stats(docs).join(failure_counts(log), "source_type", "left").join(last, "source_type", "left").na.fill(0, ["dead", "open"])


def collection_status(log: DataFrame, now: Column) -> DataFrame:
    """Last success, runs, failures since it (all of them where there is none), seconds since it."""
    ok = F.col("error_text").isNull() & F.col("finished_at").isNotNull()
    per = log.groupBy("source_type").agg(F.max(F.when(ok, F.col("finished_at"))).alias("last_success"), F.count(F.lit(1)).alias("runs"))
    failed = log.filter("error_text IS NOT NULL").join(per.select("source_type", "last_success"), "source_type")
    recent = failed.filter(F.col("last_success").isNull() | (F.col("started_at") > F.col("last_success"))).groupBy("source_type").agg(F.count(F.lit(1)).alias("failures"))
    seconds = (F.unix_timestamp(now) - F.unix_timestamp("last_success")).alias("stale_seconds")
    return per.join(recent, "source_type", "left").select("source_type", "last_success", "runs", F.coalesce("failures", F.lit(0)).alias("failures"), seconds)


def freshness(docs: DataFrame) -> DataFrame:
    """A09."""
    return docs.groupBy("source_type").agg(F.max("created_at").alias("newest"), F.count(F.lit(1)).alias("n"))


def feedback(events: DataFrame) -> DataFrame:
    """Feedback rows of an event stream: query, document_id, thumbs, session, created_at."""
    thumbs = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return events.select("event_id", F.concat(F.lit("q"), (F.col("user_id") % 40).cast("string")).alias("query"), F.concat(F.lit("d"), (F.col("event_id") % 97).cast("string")).alias("document_id"), thumbs.alias("thumbs"), F.col("user_id").alias("session"), F.col("ts").alias("created_at"))


def feedback_stats(fb: DataFrame) -> DataFrame:
    """A10: votes by query, pivoted."""
    return fb.groupBy("query").agg(F.count_if(F.col("thumbs") > 0).alias("positive"), F.count_if(F.col("thumbs") < 0).alias("negative"))


def eval_pairs(fb: DataFrame, limit: int = 5000) -> DataFrame:
    """Relevant and irrelevant documents of each query; queries with votes only against are kept."""
    pos = F.array_sort(F.collect_set(F.when(F.col("thumbs") > 0, F.col("document_id"))))
    neg = F.array_sort(F.collect_set(F.when(F.col("thumbs") < 0, F.col("document_id"))))
    rows = fb.filter("thumbs <> 0").groupBy(X.normalized_query(F.col("query")).alias("query")).agg(pos.alias("relevant"), neg.alias("irrelevant"), F.min("created_at").alias("since"))
    return rows.orderBy(F.desc("since"), "query").limit(limit)


def merged_positives(pairs: DataFrame, manual: DataFrame, limit: int = 1000) -> DataFrame:
    """Manual positives (query, document_id) joined to the pairs by set union."""
    more = manual.groupBy("query").agg(F.array_sort(F.collect_set("document_id")).alias("manual"))
    empty = F.array().cast("array<string>")
    return pairs.join(more, "query", "full").select("query", F.array_sort(F.array_union(F.coalesce("relevant", empty), F.coalesce("manual", empty))).alias("relevant"), F.coalesce("irrelevant", empty).alias("irrelevant")).orderBy("query").limit(limit)


def nearest_rank(rows: DataFrame, value: str) -> DataFrame:
    """Nearest-rank percentiles and the mean."""
    return rows.agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {value})").alias("p95"), F.round(F.avg(value), 6).alias("mean"))


def rolling_latency(rows: DataFrame, key: str, order: list[str], value: str, n: int = 100) -> DataFrame:
    """Percentiles by floor index over the last n values of each key."""
    last = rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).filter(F.col("_r") <= n)
    s = F.array_sort(F.collect_list(value))
    at = lambda p: F.element_at(F.col("s"), F.least(F.floor(F.size("s") * p).cast("int") + 1, F.size("s")))
    return last.groupBy(key).agg(s.alias("s")).select(key, at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def rekey_winners(sms: DataFrame) -> DataFrame:
    """Of rows with one (date, address hash, type) the latest received wins."""
    key = X.short_hash(F.col("address"))
    w = Window.partitionBy("date_ms", "address_hash", "msg_type").orderBy(F.desc("received_at"), F.desc("record_id"))
    return sms.withColumn("address_hash", key).withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("record_id", "date_ms", "address_hash", "msg_type")


def latest_turns(turns: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group, in order."""
    w = Window.partitionBy(group).orderBy(F.desc(order), F.desc("event_id"))
    return turns.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def duplicate_content(docs: DataFrame) -> DataFrame:
    """Active documents whose content another source id holds too, by content hash."""
    rows = docs.filter("status = 'active' AND content IS NOT NULL").select("record_id", "source_id", F.xxhash64("content").alias("_h"), F.sha2("content", 256).alias("_s"))
    shared = rows.groupBy("_h", "_s").agg(F.min("source_id").alias("_a"), F.max("source_id").alias("_b")).filter("_a <> _b")
    return rows.join(shared, ["_h", "_s"], "left_semi").select("record_id")


def keyset_page(rows: DataFrame, keys: list[str], after: tuple, limit: int) -> DataFrame:
    """The rows after a composite key."""
    return rows.filter(F.struct(*keys) > F.struct(*[F.lit(a).alias(k) for a, k in zip(after, keys)])).orderBy(*keys).limit(limit)


def recent_by_kind(docs: DataFrame, kind: str, limit: int) -> DataFrame:
    """P19/T03."""
    rows = {"sms": F.col("source_type") == "sms", "call-recording": (F.col("source_type") == "call-transcript") & X.json_has(F.col("metadata"), "duration_sec"), "voice-memo": (F.col("source_type") == "call-transcript") & ~X.json_has(F.col("metadata"), "duration_sec")}[kind]
    return docs.filter((F.col("status") == "active") & rows).orderBy(F.desc_nulls_last("occurred_at"), F.desc("collected_at"), "record_id").limit(limit)


def interval_join(left: DataFrame, right: DataFrame, seconds: float = 30.0) -> DataFrame:
    """Pairs of intervals of one key that overlap, and for how long. left: key, lid, l0, l1; right: key, rid, r0, r1.

    Both sides are spread over time bins; a pair is formed only in the first bin they share.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / seconds), F.floor(F.col(b) / seconds))).alias("_bin")
    x, y = left.filter("l1 >= l0").select("*", bins("l0", "l1")), right.filter("r1 >= r0").select("*", bins("r0", "r1"))
    first = F.greatest(F.floor(F.col("l0") / seconds), F.floor(F.col("r0") / seconds))
    both = x.join(y, ["key", "_bin"]).filter((F.col("_bin") == first) & (F.col("l0") < F.col("r1")) & (F.col("r0") < F.col("l1")))
    return both.drop("_bin").withColumn("overlap", F.least("l1", "r1") - F.greatest("l0", "r0"))
