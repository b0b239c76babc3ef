"""The k most similar vectors of every vector: cross-polytope hashing and exact reranking.

A hash is a fast pseudo-rotation (three rounds of random signs and a Hadamard transform) and the signed axis nearest to
the rotated unit vector, of 2 d. A table uses `depth` rotations together; a vector is put into its own cell and is
also looked up in cells whose last axis is the next best (multiprobe). Within a cell, vectors are compared exactly,
block by block on packed copies, and of each vector only its k best (within MARGIN) are passed on; pairs found in any
table are reranked by their exact similarity. Cells keep their mean size at every number of vectors: rotations are added,
and of the last one only as many coordinates are looked at as are needed. Two vectors meet more seldom in finer cells, so
the number of tables follows from how often pairs of the least similarity do, so that TARGET of them meet at every size.

Bounds: a few tables are worked on at a time, so that disk does not grow with their number; equal vectors are hashed once and expanded at the end; a cell crowded with rows that ask or answer is cut into a
grid of blocks of both, whose parts are spread over tasks, so that no task holds a whole crowded cell.

Cases: vectors that are null, of another length, all zero or with a value that is not finite take no part; of several
rows of one id the one with the least order counts; ties in similarity go to the lesser id; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kelpmill.session import removed, written

BLOCK, ASK = 1024, 8192  # rows that answer and that ask in one part of a cell
AT_ONCE = 6  # tables whose cells are on disk at the same time
MARGIN = 0.01  # of similarities of packed vectors


def usable(v: Column, dim: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(3.0e38)))
    return v.isNotNull() & (F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows; their length is a power of two."""
    x, n, h = x.copy(), x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.float32(math.sqrt(n))


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    width = 1 << (x.shape[1] - 1).bit_length()
    if width > x.shape[1]:
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng(seed).choice(np.array([-1, 1], np.float32), (3, width))
    for s in signs:
        x = hadamard(x * s)
    return x


def axes(x: np.ndarray, seed: int, best: int, among: int | None = None) -> np.ndarray:
    """The `best` nearest signed axes of each row, nearest first: axis * 2 + (1 if negative); of the first `among` axes."""
    r = rotate(x, seed)[:, :among]
    if best > r.shape[1]:  # so few axes that their far sides count too
        return np.argsort(-np.stack([r, -r], axis=2).reshape(len(r), -1), axis=1)[:, :best]
    top = np.argsort(-np.abs(r), axis=1)[:, :best]
    return top * 2 + (np.take_along_axis(r, top, 1) < 0)


def _unit(column, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares of very small or large numbers stay in range
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _packed(x: np.ndarray) -> list[bytes]:
    """Unit vectors in eight bits a value, after their scale; products of two are right to MARGIN."""
    scale = np.abs(x).max(axis=1, keepdims=True) / np.float32(127)
    return [r.tobytes() for r in np.concatenate([scale.astype(np.float32).view(np.int8), np.rint(x / scale).astype(np.int8)], axis=1)]


def _unpacked(column, dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, dim + 4)
    return raw[:, 4:].astype(np.float32) * raw[:, :4].copy().view(np.float32)


def _hashed(dim: int, tables: range, depth: int, among: int, probes: int):
    """Batches (vid, v) -> (vid, q: packed unit vector, cells: one per table and probe, the first of a table its own)."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(b.column("v"), dim)
            cells = np.stack([_codes(x, t, depth, among, probes) for t in tables], axis=1)
            offsets = np.arange(0, cells.size + 1, cells[0].size)
            yield pa.RecordBatch.from_arrays([b.column("vid"), pa.array(_packed(x), pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(cells.reshape(-1)))], names=["vid", "q", "cells"])

    return run


def _compare(dim: int, k: int, least: float):
    """Rows of one partition sorted by (cell, part): vid, q, left, right -> (a, b, similarity): k best of each left row.

    A group is a cell or a pair of blocks of a crowded cell; left rows ask, right rows answer.
    """

    def best(ids, x, left, right):
        l, r = np.flatnonzero(left), np.flatnonzero(right)
        for lo in range(0, len(l), BLOCK):
            rows = l[lo : lo + BLOCK]
            s = x[rows] @ x[r].T
            s[ids[rows][:, None] == ids[r][None, :]] = -2
            hits = s >= least
            if not hits.any():
                continue
            if s.shape[1] > k:
                cut = np.partition(s, -k, axis=1)[:, -k]
                hits &= s >= cut[:, None] - MARGIN
            i, j = np.nonzero(hits)
            yield ids[rows[i]], ids[r[j]], s[i, j]

    def run(batches):
        rest = None
        out: list[list] = [[], [], []]

        def group(ids, q, left, right):
            if len(ids) > 1:
                for found in best(ids, q, left, right):
                    for o, f in zip(out, found):
                        o.append(f)

        def flush():
            columns = [np.concatenate(o) if o else np.zeros(0) for o in out]
            for o in out:
                o.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(columns[2].astype(np.float32))], names=["a", "b", "s"])

        for b in batches:
            key = np.stack([b.column("cell").to_numpy(), b.column("part").to_numpy()], 1)
            data = (key, b.column("vid").to_numpy(), _unpacked(b.column("q"), dim), b.column("l").to_numpy(zero_copy_only=False), b.column("r").to_numpy(zero_copy_only=False))
            if rest is not None:
                data = tuple(np.concatenate(p) for p in zip(rest, data))
            key = data[0]
            if not len(key):
                continue
            edges = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
            for lo, hi in zip(edges[:-1], edges[1:]):
                if hi - lo > 1:
                    group(*(p[lo:hi] for p in data[1:]))
            rest = tuple(p[edges[-1] :] for p in data)
            yield flush()
        if rest is not None:
            group(*rest[1:])
            yield flush()

    return run


LEAST_AXES = 2  # of the last rotation
TARGET = 0.93  # share of the pairs of exactly the least similarity that are to meet in some table


def _codes(x: np.ndarray, table: int, depth: int, among: int, probes: int) -> np.ndarray:
    """Cells (rows, probes) of unit vectors in one table; the first is a vector's own."""
    key = np.full(len(x), table, np.int64)
    base = 2 * (1 << (x.shape[1] - 1).bit_length())
    for k in range(depth - 1):
        key = key * base + axes(x, 1000 * table + k, 1)[:, 0]
    return key[:, None] * base + axes(x, 1000 * table + depth - 1, probes, among)


def meeting(dim: int, similarity: float, depth: int, among: int, probes: int, pairs: int = 2000) -> float:
    """Share of random pairs of a similarity that meet in one table, measured on `pairs` pairs in each of eight."""
    rng = np.random.default_rng(11)
    a, b = rng.standard_normal((2, pairs, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = similarity * a + math.sqrt(1 - similarity**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    hits = 0
    for t in range(8):
        x, y = (_codes(v.astype(np.float32), 500_000 + t, depth, among, probes) for v in (a, b))
        hits += ((x[:, :1] == y).any(axis=1) | (y[:, :1] == x).any(axis=1)).sum()
    return max(float(hits), 0.5) / (8 * pairs)


def planned(n: int, dim: int, mean_cell: float, similarity: float, probes: int) -> tuple[int, int, int]:
    """(rotations, axes of the last one, tables) for n vectors: as many tables as let TARGET of the pairs of the least
    similarity meet."""
    width = 1 << (dim - 1).bit_length()
    cells = max(2.0 * LEAST_AXES, n / mean_cell)
    depth = max(1, math.ceil(math.log(cells, 2 * width) - 1e-9))
    if depth > 1 and cells / (2 * width) ** (depth - 1) < 2 * LEAST_AXES:  # nearly whole rotations
        depth -= 1
    among = min(width, max(LEAST_AXES, round(cells / (2 * width) ** (depth - 1) / 2)))
    p = meeting(dim, similarity, depth, among, probes)
    return depth, among, max(1, math.ceil(math.log(1 - TARGET) / math.log(1 - min(p, 0.999))))


def similar(df: DataFrame, id_col: str, vector_col: str, order_col: str, dim: int = 64, k: int = 5, min_similarity: float = 0.8, probes: int = 3, mean_cell: float = 6) -> DataFrame:
    """(a, b, similarity, rank): for each usable id a, its up to k most similar ids b of at least min_similarity."""
    rows = df.filter(usable(F.col(vector_col), dim) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).alias("v"), F.col(order_col).alias("o"))
    one = rows.groupBy("id").agg(F.min_by("v", "o").alias("v"))
    whole, path = written(one.withColumn("vid", F.xxhash64("v")), "vectors")
    ids, _ = written(whole.select("id", "vid"), "ids")
    distinct, _ = written(whole.groupBy("vid").agg(F.any_value("v").alias("v"), F.count(F.lit(1)).alias("copies")), "distinct-vectors")
    removed(df.sparkSession, path)
    n = distinct.count()
    depth, among, tables = planned(n, dim, mean_cell, min_similarity, probes)
    found = [_met(distinct, dim, range(lo, min(lo + AT_ONCE, tables)), depth, among, probes, k, min_similarity) for lo in range(0, tables, AT_ONCE)]
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return _ranked(pairs.distinct(), ids, distinct, k, min_similarity)


def _met(distinct: DataFrame, dim: int, tables: range, depth: int, among: int, probes: int, k: int, least: float) -> DataFrame:
    """(a, b), a < b: pairs found in some of the tables, written. Packed vectors go to their cells in one shuffle, whose
    files and those of the hashes are given up before the next tables are begun."""
    spark = distinct.sparkSession
    hashed, path = written(distinct.select("vid", "v").mapInArrow(_hashed(dim, tables, depth, among, probes), "vid long, q binary, cells array<long>"), "cells")
    cells = hashed.select("vid", "q", F.posexplode("cells").alias("at", "cell"))
    own = (F.col("at") % probes) == 0  # a vector lies in its own cell and asks in all its cells
    cells = cells.select("cell", "vid", "q", own.alias("r"))
    held = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("_l"), F.count_if("r").alias("_r")).filter((F.col("_l") > ASK) | (F.col("_r") > BLOCK))
    crowded, _ = written(held.select("cell", F.ceil(F.col("_l") / ASK).cast("int").alias("lb"), F.greatest(F.ceil(F.col("_r") / BLOCK), F.lit(1)).cast("int").alias("rb")), "crowded")
    # a crowded cell is a grid: its askers of block i ask in the parts (i, *), its owners of block j answer in (*, j)
    mine = lambda blocks, salt: F.pmod(F.xxhash64("vid", F.lit(salt)), F.col(blocks)).cast("int")
    row = lambda part, l, r: F.struct(part.alias("part"), F.lit(l).alias("l"), F.lit(r).alias("r"))
    asks = F.transform(F.sequence(F.lit(0), F.col("rb") - 1), lambda j: row(mine("lb", 1) * F.col("rb") + j, True, False))
    answers = F.when(F.col("r"), F.transform(F.sequence(F.lit(0), F.col("lb") - 1), lambda i: row(i * F.col("rb") + mine("rb", 2), False, True))).otherwise(F.array().cast("array<struct<part:int,l:boolean,r:boolean>>"))
    n = crowded.count()
    placed = cells.select("cell", F.lit(0).alias("part"), "vid", "q", F.lit(True).alias("l"), "r")
    if n:
        small = F.broadcast(crowded) if n < 100_000 else crowded  # checked
        grid = cells.join(small, "cell").select("cell", "vid", "q", F.inline(F.concat(asks, answers)))
        placed = placed.join(small.select("cell"), "cell", "left_anti").unionByName(grid)
    sorted_rows = placed.select("cell", "part", "vid", "q", "l", "r").repartition("cell", "part").sortWithinPartitions("cell", "part")
    found = sorted_rows.mapInArrow(_compare(dim, k, least - MARGIN), "a long, b long, s float")
    pairs, _ = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "neighbours")
    removed(spark, path)
    del sorted_rows, found, placed, cells, held
    gc.collect()
    spark._jvm.System.gc()  # the cleaner removes the shuffle files of frames that are gone
    return pairs


def _ranked(pairs: DataFrame, ids: DataFrame, distinct: DataFrame, k: int, least: float) -> DataFrame:
    va, vb = distinct.select(F.col("vid").alias("a"), F.col("v").alias("va")), distinct.select(F.col("vid").alias("b"), F.col("v").alias("vb"))
    exact = pairs.join(va, "a").join(vb, "b").select("a", "b", cosine(F.col("va"), F.col("vb")).alias("similarity")).filter(F.col("similarity") >= least)
    exact = exact.unionByName(exact.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    members = ids.select("id", "vid")
    # of the copies of a vector the k + 1 least ids can be among k neighbours of anything
    ranked = members.withColumn("_k", F.row_number().over(Window.partitionBy("vid").orderBy("id"))).filter(F.col("_k") <= k + 1).drop("_k")
    x, y = members.select(F.col("id").alias("x"), F.col("vid").alias("a")), ranked.select(F.col("id").alias("y"), F.col("vid").alias("b"))
    across = exact.join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b"), "similarity")
    same = distinct.filter("copies > 1").select(F.col("vid").alias("a"))
    within = x.join(same, "a", "left_semi").join(y.withColumnRenamed("b", "a"), "a").filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(1.0).alias("similarity"))
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    return across.unionByName(within).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cosine(x: Column, y: Column) -> Column:
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(x, y) / F.sqrt(dot(x, x)) / F.sqrt(dot(y, y))
