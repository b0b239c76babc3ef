"""Messages delivered more than once: screening by Bloom filters per time bucket, then exact verification.

The identity of a message is a set of columns. Rows fall into time buckets, buckets into hash shards of bounded size;
bucket and shard make a cell, so a hot bucket spreads over many cells while others keep one. Three steps:

1. Every input partition, sorted by cell, passes on for each cell the filter slots that its rows set once and those set
   more than once; the slots of a cell are merged into a saturating filter ("seen" and "seen again") and written to the
   shared folder. Equal rows of a partition are merged before the shuffle, so a hot message is no burden to a task.
2. Every row is looked up in the filter of its cell, which its task reads from the shared folder, cells being met in
   order. A row none of whose slots was seen again is definitely the only one of its message and goes no further.
   Where the bucket is no function of the identity, copies may lie in several buckets: the filters of all buckets of a
   shard are then joined (seen in two buckets is seen again) and the joint filter screens.
3. The rest, repeats and rare false alarms, are written once and verified exactly by their full identity.

Cases: a null in an identity column equals nothing, so such rows are never repeats; a null bucket counts as bucket 0
where buckets are joined; rows of an empty table give no rows; of equal order numbers all rows but those with the least
one are repeats; other columns are ignored.
"""

from __future__ import annotations

import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpmill.functions.phone import canonical_number
from kelpmill.session import written

SLOTS = 1 << 20
ROWS_PER_CELL = 64_000
HASHES = 4
AT_ONCE = 64  # filters that a probing task holds
SPAN_DAYS = 30  # of a time bucket of documents


def _slots(h: np.ndarray) -> np.ndarray:
    """HASHES slots of each 64-bit hash, by double hashing; shape (rows, HASHES)."""
    u = h.astype(np.uint64)
    a, b = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    i = np.arange(HASHES, dtype=np.uint64)
    return ((a[:, None] + i[None, :] * b[:, None]) % np.uint64(SLOTS)).astype(np.int64)


def _marked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots set by one of the rows, slots set by more than one); a row counts once for each slot."""
    s = np.sort(_slots(h), axis=1)
    fresh = np.ones(s.shape, bool)
    fresh[:, 1:] = s[:, 1:] != s[:, :-1]
    slots, counts = np.unique(s[fresh], return_counts=True)
    return slots[counts == 1].astype(np.int32), slots[counts > 1].astype(np.int32)


def _pack(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8)).astype(bool)


def _runs(cells: np.ndarray):
    """(cell, slice) of runs of equal cells."""
    edges = np.flatnonzero(np.r_[True, np.diff(cells) != 0, True]) if len(cells) else []
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield int(cells[lo]), slice(int(lo), int(hi))


def _partial_slots(batches):
    """Rows (cell, shard, h) sorted by cell -> (cell, shard, once, more) for each run of a batch."""
    for batch in batches:
        cells, h = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("cell", "h"))
        shards, out = batch.column("shard").to_numpy(zero_copy_only=False), [[], [], [], []]
        for cell, rows in _runs(cells):
            once, more = _marked(h[rows])
            for column, value in zip(out, (cell, int(shards[rows.start]), once.tobytes(), more.tobytes())):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["cell", "shard", "once", "more"])


def _filter_row(cell: int, shard: int, seen: np.ndarray, again: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([shard], pa.int64()), pa.array([_pack(seen)], pa.binary()), pa.array([_pack(again)], pa.binary())], names=["cell", "shard", "seen", "again"])


def _merged_slots(batches):
    """Partial slots sorted by cell -> one filter per cell; one is open at a time."""
    cell, shard, seen, again = None, 0, None, None
    for batch in batches:
        for c, s, once, more in zip(*(batch.column(k).to_pylist() for k in ("cell", "shard", "once", "more"))):
            if c != cell:
                if cell is not None:
                    yield _filter_row(cell, shard, seen, again)
                cell, shard, seen, again = c, s, np.zeros(SLOTS, bool), np.zeros(SLOTS, bool)
            once, more = np.frombuffer(once, np.int32), np.frombuffer(more, np.int32)
            again[once[seen[once]]] = True
            again[more] = True
            seen[once] = True
            seen[more] = True
    if cell is not None:
        yield _filter_row(cell, shard, seen, again)


def _joined_filters(batches):
    """Filters sorted by shard -> one joint filter per shard, over all its buckets; its cell is the shard."""
    shard, seen, again = None, None, None
    for batch in batches:
        for k, s, a in zip(*(batch.column(c).to_pylist() for c in ("shard", "seen", "again"))):
            s, a = _unpack(s), _unpack(a)
            if k != shard:
                if shard is not None:
                    yield _filter_row(shard, shard, seen, again)
                shard, seen, again = k, s, a
            else:
                again |= a | (seen & s)
                seen |= s
    if shard is not None:
        yield _filter_row(shard, shard, seen, again)


def _store(path: str):
    """The filters as a data set, wherever the shared folder lies."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    at = urlparse(path)
    if at.scheme in ("", "file"):
        return ds.dataset(at.path, format="parquet")
    where, inner = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return ds.dataset(inner, filesystem=where, format="parquet")


def _prober(path: str, key: str):
    """Keeps the rows whose slots were all seen again; rows come sorted by key, filters are read in that order."""

    def probe(batches):
        import pyarrow.dataset as ds

        held: dict[int, np.ndarray] = {}
        store = _store(path)
        for batch in batches:
            cells, h = batch.column(key).to_numpy(zero_copy_only=False), batch.column("h").to_numpy(zero_copy_only=False)
            keep, runs = np.zeros(len(h), bool), list(_runs(cells))
            for lo in range(0, len(runs), AT_ONCE):
                part = runs[lo : lo + AT_ONCE]
                wanted = {c for c, _ in part}
                held = {c: f for c, f in held.items() if c in wanted}
                if missing := sorted(wanted - set(held)):
                    found = store.to_table(columns=["cell", "again"], filter=ds.field("cell").isin(missing))
                    held |= {c: _unpack(a) for c, a in zip(found.column("cell").to_pylist(), found.column("again").to_pylist())}
                for c, rows in part:
                    keep[rows] = held[c][_slots(h[rows])].all(axis=1)
            yield batch.filter(pa.array(keep))

    return probe


def possible_repeats(df: DataFrame, identity: list[str], bucket: str, joined: bool = False) -> DataFrame:
    """The rows of df that the Bloom filters can't prove to be the only row of their message.

    df: identity columns, the integer column named bucket, and whatever else is to come along. joined: copies of a
    message may lie in different buckets. Shards are as many as the greatest bucket (or, where buckets are joined, all
    of them) needs; smaller buckets have fewer.
    """
    rows = df.dropna(subset=[*identity, bucket])
    sizes = rows.groupBy(bucket).count()
    if joined:
        total = sizes.agg(F.sum("count")).first()[0] or 0  # one number
        keyed = rows.withColumn("_shards", F.lit(max(1, -(-int(total) // ROWS_PER_CELL))))
    else:
        most = sizes.agg(F.max("count")).first()[0] or 0  # one number
        keyed = rows.withColumn("_shards", F.lit(1))
        if most > ROWS_PER_CELL:
            large = sizes.filter(F.col("count") > ROWS_PER_CELL).select(F.col(bucket), F.ceil(F.col("count") / ROWS_PER_CELL).cast("int").alias("_s"))
            keyed = rows.join(large, bucket, "left").withColumn("_shards", F.coalesce("_s", F.lit(1))).drop("_s")
    keyed = keyed.withColumn("h", F.xxhash64(*identity)).withColumn("shard", F.pmod(F.xxhash64("h", F.lit(7)), F.col("_shards")).cast("long")).drop("_shards")
    keyed = keyed.withColumn("cell", F.xxhash64(bucket, "shard"))
    schema = "cell long, shard long, seen binary, again binary"
    partial = keyed.select("cell", "shard", "h").sortWithinPartitions("cell").mapInArrow(_partial_slots, "cell long, shard long, once binary, more binary")
    filters, path = written(partial.repartition("cell").sortWithinPartitions("cell").mapInArrow(_merged_slots, schema), "filters")
    if joined:
        _, path = written(filters.repartition("shard").sortWithinPartitions("shard").mapInArrow(_joined_filters, schema), "joint-filters")
    key = "shard" if joined else "cell"
    return keyed.sortWithinPartitions(key).mapInArrow(_prober(path, key), keyed.schema).drop("h", "cell", "shard")


def repeats(df: DataFrame, identity: list[str], bucket: str, order: str, joined: bool = False) -> DataFrame:
    """Every row (identity, order) of a message of which there is a row with a smaller order."""
    candidates, _ = written(possible_repeats(df.select(*identity, bucket, order), identity, bucket, joined), "possible-repeats")
    firsts = candidates.groupBy(*identity).agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return candidates.join(firsts, identity).filter(F.col(order) > F.col("_first")).select(*identity, order)


def keep_one(df: DataFrame, identity: list[str], bucket: str, order: str) -> DataFrame:
    """df without repeats: the row with the least order of each message, and every row without a whole identity."""
    return df.join(repeats(df, identity, bucket, order).select(order).distinct(), order, "left_anti")


def _day(ms: Column) -> Column:
    return F.floor(ms / F.lit(86_400_000)).cast("long")


def sms_identity(sms: DataFrame) -> DataFrame:
    """Deliveries with the identity (date_ms, msg_type, number); the bucket is the day of the message."""
    return sms.select("record_id", "date_ms", "msg_type", canonical_number(F.col("address")).alias("number"), _day(F.col("date_ms")).alias("bucket"))


def document_identity(docs: DataFrame) -> DataFrame:
    """Documents with the identity (source_type, source_id); the bucket is the time of collection, by 30 days. Copies may
    come at any time, so the buckets of a shard are joined."""
    span = F.floor(F.unix_millis("collected_at") / F.lit(SPAN_DAYS * 86_400_000)).cast("long")
    return docs.select("record_id", "source_type", "source_id", F.coalesce(span, F.lit(0)).alias("bucket"))


def repeated_records(sms: DataFrame, docs: DataFrame) -> DataFrame:
    """(table_name, record_id) of every repeated delivery in both tables."""
    a = repeats(sms_identity(sms), ["date_ms", "msg_type", "number"], "bucket", "record_id")
    b = repeats(document_identity(docs), ["source_type", "source_id"], "bucket", "record_id", joined=True)
    return a.select(F.lit("ingest_sms").alias("table_name"), "record_id").unionByName(b.select(F.lit("brain_documents").alias("table_name"), "record_id"))
