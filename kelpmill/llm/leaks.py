"""Evaluation texts leaking into training text: greedy string tiling over Karp-Rabin seeds.

Seeds are hashes of min_words consecutive words. Documents that share a seed with an item are joined to it, and each such
pair is tiled: of all common runs of words that hold no marked word the longest is marked next; what a mark cuts off from
another run is a shorter run and waits for its turn; until no run of min_words is left. The tiles give the longest common
run, the words of the item that are covered (in whatever order its passages stand in the document) and the place of the
first tile. Hash equality is confirmed word by word.

Only maximal common runs are ever formed: a run begins where the words before it differ, and its length is found by
comparing hashes of 1, 2, 4, ... words. So a word repeated a thousand times makes no million matches.

Bounds: neither documents nor items reach the driver. A filter of the items' seeds goes to the tasks if there are at most
FILTER_SEEDS of them (checked), so that documents without a seed stop at the scan; a larger set of items is met by a
shuffle join on the seeds instead. Pairs meet their texts by shuffle joins, in which skewed keys are split at run time.

Cases: null or too short texts and items leak nothing; repeated rows of a document or item each count, the result
being distinct; very long documents are matched whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpmill.llm.text import WordHashes, batch, lists, shingles, words
from kelpmill.session import written

FILTER_SEEDS = 4_000_000  # 32 MB
LEAKS = "doc_id long, item_id int, longest int, covered int, item_words int, first_word int"


def _levels(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Hashes of 1, 2, 4, ... words at each place, up to `most` words."""
    out, n = [x], 1
    while 2 * n <= most:
        h = out[-1]
        out.append(shingles_of_two(h, n))
        n *= 2
    return out


def shingles_of_two(h: np.ndarray, apart: int) -> np.ndarray:
    """Hashes of two neighbouring runs whose hashes are h at places `apart` of each other."""
    if len(h) <= apart:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        z = h[:-apart] * np.uint64(0x9E3779B97F4A7C15) ^ (h[apart:] + np.uint64(0xD6E8FEB86659FD93))
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(32))


def runs(x: np.ndarray, y: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start in x, start in y, words) of all maximal common runs of at least `length` words."""
    none = np.zeros(0, np.int64)
    sx, sy = shingles(x, length), shingles(y, length)
    if not len(sx) or not len(sy):
        return none, none, none
    at = np.flatnonzero(np.isin(sx, sy))
    before = lambda v, i: np.where(i > 0, v[np.maximum(i - 1, 0)], 0)
    j_all = np.arange(len(sy))
    py = before(y, j_all)
    order = np.lexsort((py, sy))
    seeds, fronts = sy[order], py[order]
    lo, hi = np.searchsorted(seeds, sx[at], "left"), np.searchsorted(seeds, sx[at], "right")
    i_parts, j_parts = [], []
    for k in range(0, len(at), 4096):  # pairs of a seed whose words before differ, a stretch of x at a time
        i, a, b = at[k : k + 4096], lo[k : k + 4096], hi[k : k + 4096]
        n = b - a
        ii = np.repeat(i, n)
        if not len(ii):
            continue
        jj = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        starts = (before(x, ii) != fronts[jj]) | (ii == 0) | (order[jj] == 0)
        i_parts.append(ii[starts])
        j_parts.append(order[jj[starts]])
    if not i_parts:
        return none, none, none
    i, j = np.concatenate(i_parts), np.concatenate(j_parts)
    n = np.zeros(len(i), np.int64)
    lx, ly = _levels(x, min(len(x), len(y))), _levels(y, min(len(x), len(y)))
    for level in range(len(lx) - 1, -1, -1):
        hx, hy, step = lx[level], ly[level], 1 << level
        u, v = i + n, j + n
        fits = (u < len(hx)) & (v < len(hy))
        same = np.zeros(len(i), bool)
        same[fits] = hx[u[fits]] == hy[v[fits]]
        n[same] += step
    good = n >= length
    return i[good], j[good], n[good]


def tiles(x: np.ndarray, y: np.ndarray, min_words: int) -> list[tuple[int, int, int]]:
    """Greedy tiles of word hashes x and y, longest first, none overlapping in either."""
    free_x, free_y, out = np.ones(len(x), bool), np.ones(len(y), bool), []
    waiting = [(-int(n), int(a), int(b)) for a, b, n in zip(*runs(x, y, min_words)) if (x[a : a + n] == y[b : b + n]).all()]
    heapq.heapify(waiting)
    while waiting:
        n, a, b = heapq.heappop(waiting)
        n = -n
        free = free_x[a : a + n] & free_y[b : b + n]
        if free.all():
            free_x[a : a + n] = free_y[b : b + n] = False
            out.append((a, b, n))
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, free, False].astype(np.int8)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):  # what is left of the run
            if e - s >= min_words:
                heapq.heappush(waiting, (s - e, a + s, b + s))
    return out


def _seeds(min_words: int, keep: np.ndarray | None, name: str):
    """Batches (key, text) -> (key, text, seeds: distinct seeds of the text, of those in keep if given), none without."""

    def run(batches):
        hashed = WordHashes()
        for b in batches:
            rows, parts = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                s = shingles(hashed(words(text)), min_words)
                if keep is not None and len(s):
                    at = np.searchsorted(keep, s)
                    s = s[keep[np.minimum(at, len(keep) - 1)] == s]
                if len(s):
                    rows.append(k)
                    parts.append(np.unique(s).view(np.int64))
            sizes = np.array([len(p) for p in parts], np.int64)
            seeds = lists(np.concatenate(parts) if parts else np.zeros(0, np.int64), np.r_[0, np.cumsum(sizes)].astype(np.int32))
            taken = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), seeds], names=[name, "text", "seeds"])

    return run


def _tiled(min_words: int):
    """Batches (doc_id, item_id, text, item_text) -> LEAKS."""

    def run(batches):
        hashed = WordHashes()
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            texts, known = b.column(2).to_pylist(), {}
            for doc, item, text, passage in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts, b.column(3).to_pylist()):
                if passage not in known:
                    known[passage] = hashed(words(passage))
                x, y = hashed(words(text)), known[passage]
                if t := tiles(x, y, min_words):
                    for c, v in zip(out, (doc, item, max(n for *_, n in t), sum(n for *_, n in t), len(y), min(a for a, *_ in t))):
                        c.append(v)
            yield batch(["doc_id", "item_id", "longest", "covered", "item_words", "first_word"], out, [pa.int64(), *[pa.int32()] * 5])

    return run


def leaks(docs: DataFrame, items: DataFrame, min_words: int = 12, min_coverage: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, longest, covered, item_words, first_word) of every document and item that share a run.

    items: item_id, item_text. Coverage is covered / item_words; pairs below min_coverage are left out.
    """
    source = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = items.filter("item_id IS NOT NULL AND item_text IS NOT NULL").select(F.struct(F.col("item_id").cast("int").alias("id"), F.xxhash64("item_text").alias("h")).alias("item"), F.col("item_text").alias("text")).distinct()
    known, _ = written(known.mapInArrow(_seeds(min_words, None, "item"), "item struct<id:int,h:long>, text string, seeds array<long>"), "items")
    seeds = known.select("item", F.explode("seeds").alias("seed"))
    n = known.agg(F.coalesce(F.sum(F.size("seeds")), F.lit(0))).first()[0]  # one number
    keep = None
    if n <= FILTER_SEEDS:  # a bounded filter; equal seeds of items are sent once
        keep = np.sort(seeds.select("seed").distinct().toArrow().column(0).to_numpy().view(np.uint64))
        if not len(keep):
            return docs.sparkSession.createDataFrame([], LEAKS)
    matched = source.mapInArrow(_seeds(min_words, keep, "doc_id"), "doc_id long, text string, seeds array<long>").withColumn("row", F.monotonically_increasing_id())
    matched, _ = written(matched, "matched")
    pairs = matched.select("row", F.explode("seeds").alias("seed")).join(seeds, "seed").select("row", "item").distinct()
    both = pairs.join(matched.select("row", "doc_id", "text"), "row").join(known.select("item", F.col("text").alias("item_text")), "item")
    found = both.select("doc_id", F.col("item.id").alias("item_id"), "text", "item_text").mapInArrow(_tiled(min_words), LEAKS)
    return found.filter(F.col("covered") >= F.lit(min_coverage) * F.col("item_words"))
