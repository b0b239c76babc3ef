"""Streaming ingestion: micro-batches into a versioned snapshot, exactly once; late rows, cutover, retries, backfill.

A snapshot is cut into buckets by the hash of its keys. A batch writes the next version of the buckets it touches and of
no others, and then moves the pointer, a small file that names the version of every bucket; it is renamed over the old
one in one step. A batch id that the pointer has seen is not applied again. Versions that neither the pointer nor the
one before names are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kelpmill.operators import state as S


BUCKETS = 16


class Snapshot:
    """A table of the latest state; readers see whole versions only."""

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.buckets = spark, path.rstrip("/"), schema, buckets
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointer(self) -> dict:
        if not self._fs.exists(self._fs_path(f"{self.path}/current.json")):
            return {"version": -1, "batches": {}, "of": {}, "before": []}
        return json.loads(self.spark.read.text(f"{self.path}/current.json").first()[0])

    def _of(self, buckets: dict) -> DataFrame:
        paths = [f"{self.path}/v{v}/_bucket={b}" for b, v in buckets.items()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._of(self._pointer()["of"])

    def write(self, df: DataFrame, source: str = "", batch: int | None = None) -> bool:
        """Replaces the table; False if this batch of this source was applied before."""
        return self._put(lambda now: (df.select("*", F.lit(0).alias("_bucket")), {}), source, batch)

    def merge(self, new: DataFrame, keys: list[str], source: str = "", batch: int | None = None) -> bool:
        """Upserts rows with unique keys; only buckets that they touch are read and written."""
        bucket = F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

        def merged(now: dict):
            touched = {str(r[0]) for r in new.select(bucket).distinct().collect()}  # at most `buckets` numbers
            old = self._of({b: v for b, v in now["of"].items() if b in touched})
            return S.upsert(old, new, keys).withColumn("_bucket", bucket), {b: v for b, v in now["of"].items() if b not in touched}

        return self._put(merged, source, batch)

    def _put(self, make: Callable, source: str, batch: int | None) -> bool:
        now = self._pointer()
        if batch is not None and now["batches"].get(source, -1) >= batch:
            return False
        v = now["version"] + 1
        df, kept = make(now)
        df.write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/v{v}")
        made = [f.getPath().getName() for f in self._fs.listStatus(self._fs_path(f"{self.path}/v{v}")) if f.isDirectory()]
        of = kept | {name.split("=")[1]: v for name in made if name.startswith("_bucket=")}
        batches = now["batches"] | ({source: batch} if batch is not None else {})
        self._point({"version": v, "batches": batches, "of": of, "before": sorted(set(now["of"].values()))})
        for old in set(now["before"]) - set(of.values()) - set(now["of"].values()):  # readers of the version before may still be at work
            self._fs.delete(self._fs_path(f"{self.path}/v{old}"), True)
        return True

    def _point(self, pointer: dict) -> None:
        """Written beside the old pointer and renamed over it in one step."""
        fresh, current = (self._fs_path(f"{self.path}/{n}") for n in (f"v{pointer['version']}.json", "current.json"))
        out = self._fs.create(fresh, True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        jvm = self.spark._jvm
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(current).toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(fresh), self._fs.makeQualified(current), how)


def upserting(target: Snapshot, keys: list[str], order: str, source: str) -> Callable[[DataFrame, int], None]:
    """ST1/ST5: foreachBatch function that merges a batch into a snapshot."""

    def run(batch: DataFrame, batch_id: int) -> None:
        target.merge(S.latest(batch, keys, order), keys, source, batch_id)

    return run


def collect(stream: DataFrame, target: Snapshot, keys: list[str], order: str, source: str, checkpoint: str) -> StreamingQuery:
    """ST1/ST6: one query per source, all that is there now; its checkpoint is the watermark of the source (ST2)."""
    return stream.writeStream.foreachBatch(upserting(target, keys, order, source)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admitted(batch: DataFrame, since_ms: int, cutover_ms: int, known: DataFrame) -> DataFrame:
    """ST3/ST4/P22: nothing before the cutover; older than the watermark only if its id was never seen."""
    fresh = batch.filter(F.col("date_ms") >= cutover_ms)
    ids = known.select("id").distinct().withColumn("_known", F.lit(True))
    return fresh.join(ids, "id", "left").filter((F.col("date_ms") > since_ms) | F.col("_known").isNull()).drop("_known")


def unique_events(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Each event once, as long as its copies come within the delay."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, key: str, width: str, delay: str) -> DataFrame:
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width), key).agg(F.count(F.lit(1)).alias("n"))


RETRY_OUT = "key string, attempts int, retry_at long, dead boolean"


def _retry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    attempts, last = state.get if state.exists else (0, 0)
    for pdf in batches:
        for ok, at in zip(pdf["ok"], pdf["at"]):
            attempts, last = (0, int(at)) if ok else (attempts + 1, int(at))
    state.update((attempts, last))
    wait = 300 if attempts <= 1 else int(min(60.0, 2.0 ** (attempts - 1)) * 60)
    yield pd.DataFrame({"key": [key[0]], "attempts": [attempts], "retry_at": [last + wait if attempts else last], "dead": [attempts >= 10]})


def retry_queue(stream: DataFrame) -> DataFrame:
    """ST7: attempts, next time and dead letters of each key, kept as state. stream: key, ok, at (seconds)."""
    return stream.groupBy("key").applyInPandasWithState(_retry, RETRY_OUT, "attempts int, last long", "update", GroupStateTimeout.NoTimeout)


def work_once(pending: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, limit: int) -> DataFrame:
    """ST8/ST9: a polling worker's cycle: the first `limit` pending rows by id through the work function."""
    return pending.orderBy("id").limit(limit).mapInPandas(work, schema)
