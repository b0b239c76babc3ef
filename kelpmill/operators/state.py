"""Idempotent upserts and state transitions as merges of two snapshots: old and new in, the next snapshot out.

Keys of both sides are unique; callers dedupe the new side first (latest()).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kelpmill.functions.text import backoff_minutes, dead_letter


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the greatest order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = (), fixed: dict[str, Column] | None = None) -> DataFrame:
    """New rows overwrite; the columns in keep are not overwritten by null; fixed ones are set on every new row."""
    a, b = old.withColumn("_o", F.lit(True)).alias("a"), new.withColumn("_n", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "full")
    pick = []
    for c in old.columns:
        x, y = F.col(f"a.{c}"), F.col(f"b.{c}") if c in new.columns else F.lit(None)
        if c in keys:
            pick.append(F.coalesce(x, y).alias(c))
        elif fixed and c in fixed:
            pick.append(F.when(F.col("_n"), fixed[c]).otherwise(x).alias(c))
        elif c in keep or c not in new.columns:
            pick.append(F.coalesce(y, x).alias(c))
        else:
            pick.append(F.when(F.col("_n"), y).otherwise(x).alias(c))
    return joined.select(*pick)


def changes(old: DataFrame, new: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Keys of the new rows and whether their content changed; an insert counts as changed."""
    a, b = old.select(*keys, F.col(content).alias("_c"), F.lit(True).alias("_o")), new.select(*keys, content)
    return b.join(a, keys, "left").select(*keys, (F.col("_o").isNull() | ~F.col("_c").eqNullSafe(F.col(content))).alias("content_changed"))


def mark_deleted(docs: DataFrame, live: DataFrame, source: str, now: Column, ratio: float = 0.5) -> DataFrame:
    """Active rows of a source that are no longer listed become deleted; an empty list, or one that would
    delete more than the ratio, changes nothing."""
    mine = (F.col("source_type") == source) & (F.col("status") == "active")
    gone = docs.filter(mine).join(live.select("source_id").distinct(), "source_id", "left_anti").select("source_id").distinct().withColumn("_gone", F.lit(True))
    totals = docs.filter(mine).select("source_id").distinct().join(live.select("source_id").distinct().withColumn("_l", F.lit(True)), "source_id", "left").agg(F.count(F.lit(1)).alias("n"), F.count("_l").alias("kept")).first()
    if live.isEmpty() or totals["n"] and (totals["n"] - totals["kept"]) / totals["n"] > ratio:
        return docs
    hit = mine & F.coalesce("_gone", F.lit(False))
    return docs.join(gone, "source_id", "left").withColumn("deleted_at", F.when(hit, now).otherwise(F.col("deleted_at"))).withColumn("status", F.when(hit, "deleted").otherwise(F.col("status"))).select(*docs.columns)


def longest_names(entities: DataFrame) -> DataFrame:
    """The longest display name of each (normalized_name, type); of equal ones the first seen."""
    return entities.groupBy("normalized_name", "type").agg(F.max_by("name", F.struct(F.length("name"), -F.col("seen"))).alias("name"))


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is new, once each."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def upsert_actions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counterpart is never lost; two detectors that disagree make 'both'."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.identity") == F.col("b.identity"), "full")
    old_by, new_by = F.col("a.detected_by"), F.col("b.detected_by")
    by = F.when(old_by.isNull(), new_by).when(new_by.isNull() | (old_by == new_by), old_by).otherwise("both")
    return both.select(F.coalesce("a.identity", "b.identity").alias("identity"), F.coalesce("b.summary", "a.summary").alias("summary"), F.coalesce("b.counterpart", "a.counterpart").alias("counterpart"), by.alias("detected_by"))


def toggled_votes(votes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each vote replaces the one before; the same vote again takes it back. The state after all votes is 0 or the
    last vote, by the parity of the run of equal votes at the end. That run begins behind the last other vote, so three
    aggregations with partial results find it; no key's votes are gathered. Of votes of one order number one counts."""
    one = votes.groupBy(*keys, order).agg(F.max("thumbs").alias("thumbs"))
    last = one.groupBy(*keys, "thumbs").agg(F.max(order).alias("_at"))
    ends = last.groupBy(*keys).agg(F.max(F.struct("_at", "thumbs")).alias("_l"), F.array_sort(F.collect_list("_at")).alias("_ats"))  # one for each value of a vote
    ends = ends.select(*keys, F.col("_l.thumbs").alias("_last"), F.when(F.size("_ats") > 1, F.element_at("_ats", -2)).alias("_before"))
    run = one.join(ends, keys).filter((F.col("thumbs") == F.col("_last")) & (F.col("_before").isNull() | (F.col(order) > F.col("_before"))))
    return run.groupBy(*keys, "_last").agg((F.count(F.lit(1)) % 2).alias("_odd")).select(*keys, F.when(F.col("_odd") == 1, F.col("_last")).otherwise(0).alias("thumbs"))


def failures_folded(failed: DataFrame, key: str, at: str) -> DataFrame:
    """Attempts, time of the next one and dead letters from the failures of each key."""
    per = failed.groupBy(key).agg(F.count(F.lit(1)).alias("attempts"), F.max(at).alias("last"))
    return per.select(key, "attempts", (F.unix_timestamp("last") + F.round(backoff_minutes(F.col("attempts")) * 60).cast("long")).alias("retry_at"), dead_letter(F.col("attempts")).alias("dead"))


def set_once(old: Column, new: Column) -> Column:
    """A value that is there stays."""
    return F.coalesce(old, new)


def merged_json(old: Column, new: Column) -> Column:
    """shallow merge of two JSON objects, the new one winning; values keep their types, keys come sorted."""
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    added = F.map_keys(as_map(new))
    left = F.map_filter(as_map(old), lambda k, _: ~F.array_contains(added, k))
    both = F.map_concat(left, as_map(new))
    keys = F.array_sort(F.map_keys(both))
    return F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(both, k))))


def promoted(history: DataFrame, new_id: int, now: Column) -> DataFrame:
    """One set of weights is active; the one before is superseded."""
    status = F.when(F.col("id") == new_id, "active").when(F.col("status") == "active", "superseded").otherwise(F.col("status"))
    return history.withColumn("promoted_at", F.when(F.col("id") == new_id, now).otherwise(F.col("promoted_at"))).withColumn("status", status)


def rolled_back(history: DataFrame) -> DataFrame:
    """The superseded set promoted last becomes active again."""
    target = history.filter("status = 'superseded'").agg(F.max(F.struct("promoted_at", "id"))["id"].alias("_t"))  # one row
    marked = history.crossJoin(F.broadcast(target))
    status = F.when(F.col("id") == F.col("_t"), "active").when(F.col("_t").isNotNull() & (F.col("status") == "active"), "superseded").otherwise(F.col("status"))
    return marked.withColumn("status", status).drop("_t")


def active_weights(history: DataFrame, configured: DataFrame) -> DataFrame:
    """The weights of the one active set; where none is active or all of its weights are zero, the configured ones.

    history: id, status and the columns of configured, which has one row.
    """
    names = configured.columns
    some = F.greatest(*[F.abs(F.coalesce(F.col(n), F.lit(0.0))) for n in names]) > 0
    live = history.filter(F.col("status") == "active").filter(some).agg(F.max_by(F.struct(*names), "id").alias("_a"))
    return configured.select(F.struct(*names).alias("_c")).crossJoin(F.broadcast(live)).select(F.coalesce("_a", "_c").alias("_w")).select("_w.*")


def rekeyed(docs: DataFrame, most_conflicts: int = 500) -> DataFrame:
    """Ids of old messages by body hash become ids by direction; of several of one new id the one updated last keeps
    living and the others are deleted. More conflicts than most_conflicts raise, and nothing changes."""
    way = F.get_json_object("metadata", "$.direction")
    part = lambda i: F.split_part("source_id", F.lit(":"), F.lit(i))
    mine = (F.col("source_type") == "sms") & (F.col("status") == "active") & part(4).rlike("^[0-9a-f]{8}$") & (F.coalesce(way, F.lit("")) != "")
    new_id = F.when(mine, F.concat(F.lit("sms:"), part(2), F.lit(":"), part(3), F.lit(":"), way))
    rows = docs.withColumn("_new", new_id)
    winners = rows.filter("_new IS NOT NULL").groupBy("_new").agg(F.max(F.struct("updated_at", "id"))["id"].alias("_w"), F.count(F.lit(1)).alias("_n"))
    lost = winners.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()[0]  # one number
    if lost > most_conflicts:
        raise ValueError(f"{lost} conflicts, more than {most_conflicts}")
    joined = rows.join(winners.select("_new", "_w"), "_new", "left")
    wins, loses = F.col("id") == F.col("_w"), F.col("id") != F.col("_w")
    out = {"source_id": F.when(wins, F.col("_new")).otherwise(F.col("source_id")), "status": F.when(loses, "deleted").otherwise(F.col("status"))}
    return joined.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])


def split_backfilled(feedback: DataFrame) -> DataFrame:
    """A split for every row with a query and none yet; a split once given never changes."""
    from kelpmill.functions.text import split_of

    return feedback.withColumn("split", F.when(F.col("split").isNull() & (F.trim(F.coalesce("query", F.lit(""))) != ""), split_of(F.col("query"))).otherwise(F.col("split")))


def claimed(pending: DataFrame, claims: DataFrame, order: str, limit: int) -> DataFrame:
    """The first `limit` rows that no other worker holds; rows held elsewhere are passed over, not waited for."""
    return pending.join(claims.select(order).distinct(), order, "left_anti").orderBy(order).limit(limit)


def replace_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the documents in new are replaced."""
    return old.join(new.select("id").distinct(), "id", "left_anti").unionByName(new)


def appended(history: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows behind a history, with ids that go on from its greatest; rows are those of one run, a bounded few."""
    last = history.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))  # one row
    numbered = rows.crossJoin(F.broadcast(last)).withColumn(key, F.col("_last") + F.row_number().over(Window.orderBy(*rows.columns)))
    return history.unionByName(numbered.select(*history.columns))


NO_ID = "00000000-0000-0000-0000-000000000000"


def turn_id(given: Column) -> Column:
    """The id that came with a turn, or a new one where none did."""
    return F.coalesce(F.nullif(F.nullif(given, F.lit("")), F.lit(NO_ID)), F.uuid())
