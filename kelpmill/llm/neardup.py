"""Near-duplicate texts: ProbMinHash signatures of weighted shingles, banding and exact verification.

ProbMinHash (Ertl): every shingle d of weight w sends Poisson arrivals of rate w; an arrival falls on a random
register, which keeps the earliest. Two texts agree on a register with the probability Jaccard similarity of their
weighted shingle sets; with equal weights that is the plain Jaccard similarity. Arrivals of all shingles of a batch
of texts are made round by round, and a shingle drops out once its next arrival is later than every register of its
text (early termination). Signatures are cut into bands; texts that agree on a band are candidates; candidates are
verified exactly on their shingle sets.

Bounds: texts with equal shingle sets form one class, named by a digest of 128 bits, and only its representative goes
through banding, so a group of copies never makes pairs. A pair must agree on a band and in the size of its shingle sets
within the threshold before it is formed. A band of more than BLOCK classes is cut into blocks by size of set; pairs of
blocks whose sizes are too far apart fall away, the others are parts of their own and spread over tasks.

Cases: null, empty and too short texts (fewer words than a shingle) belong to no class and no pair; very long texts
are taken whole; repeated rows of an id count once (of different texts of one id
the one with the least digest); an empty table gives no rows; columns other than the two named ones are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpmill.llm.text import WordHashes, batch, lists, mix, shingles, uniform, words
from kelpmill.session import written

_U = np.uint64
BLOCK = 2000  # classes of a band that are compared with each other in one task
PARTS = 16  # ranges of sizes in a crowded band


def probminhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, m: int, seed: int = 1) -> np.ndarray:
    """Registers (n, m) of n weighted sets: the element whose arrival on the register is the earliest.

    elements: hashes; weights: above 0; owner: the set of each element, 0 to n - 1, every set with an element.
    """
    registers = np.full((n, m), np.inf)
    flat, latest = registers.reshape(-1), np.full(n, np.inf)
    winners = np.zeros(n * m, np.uint64)
    element = elements.astype(np.uint64)
    state = mix(element ^ _U(seed * 0x9E3779B9))
    time, rate, own = np.zeros(len(elements)), weights.astype(np.float64), owner.astype(np.int64)
    while len(own):
        state = mix(state + _U(0x9E3779B97F4A7C15))
        time = time - np.log(uniform(state)) / rate
        live = time < latest[own]
        state, time, rate, own, element = state[live], time[live], rate[live], own[live], element[live]
        register = (mix(state ^ _U(0xD6E8FEB86659FD93)) % _U(m)).astype(np.int64)
        at = own * m + register
        np.minimum.at(flat, at, time)
        first = flat[at] == time
        winners[at[first]] = element[first]
        touched = np.unique(own)
        latest[touched] = registers[touched].max(axis=1)
    return winners.reshape(n, m)


def _shingle_sets(n_words: int, weighted: bool):
    """Batches (id, text) -> (id, sets: sorted distinct shingle hashes, counts, n, digest of the set)."""

    def run(batches):
        hashed = WordHashes()
        for b in batches:
            ids, sets, counts = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(hashed(words(text)), n_words)
                if len(s):
                    u, c = np.unique(s, return_counts=True)
                    ids.append(i)
                    sets.append(u.view(np.int64))
                    counts.append(c)
            if not ids:
                continue
            sizes = np.array([len(s) for s in sets])
            offsets = np.r_[0, np.cumsum(sizes)]
            values = np.concatenate(sets)
            digest = [xxhash.xxh3_128_digest(s.tobytes() + (c.tobytes() if weighted else b"")) for s, c in zip(sets, counts)]
            columns = [pa.array(ids, pa.string()), lists(values, offsets), pa.array(sizes, pa.int32()), pa.array(digest, pa.binary())]
            if weighted:
                columns.append(lists(np.concatenate(counts).astype(np.int32), offsets))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "shingles", "n", "digest", "counts"][: len(columns)])

    return run


def _bands(bands: int, rows: int, weighted: bool):
    """Batches (id, shingles, n[, counts]) -> (id, n, bands: array of band hashes)."""

    def run(batches):
        for b in batches:
            sets = b.column("shingles")
            values = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(sets.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            weights = b.column("counts").flatten().to_numpy(zero_copy_only=False) if weighted else np.ones(len(values))
            out = np.zeros((len(sizes), bands), np.uint64)
            for lo in range(0, len(sizes), 512):  # so that registers stay in cache
                part = slice(lo, min(lo + 512, len(sizes)))
                mine = (owner >= lo) & (owner < part.stop) if len(sizes) > 512 else slice(None)
                reg = probminhash(values[mine], weights[mine], owner[mine] - lo, part.stop - lo, bands * rows)
                h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (part.stop - lo, bands)).copy()
                for r in range(rows):
                    h = mix(h * _U(0x9E3779B97F4A7C15) + reg[:, r::rows])
                out[part] = h
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), lists(out.view(np.int64).reshape(-1), np.arange(0, len(sizes) * bands + 1, bands))], names=["id", "n", "bands"])

    return run


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sorted arrays of distinct values."""
    z = np.concatenate([x, y])
    z.sort()
    both = int((z[1:] == z[:-1]).sum())
    return both / (len(z) - both) if len(z) else 0.0


def probability_jaccard(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray) -> float:
    """The similarity of weighted sets that ProbMinHash estimates: over shared d, the sum of 1 / sum over all e of
    max(wx[e] / wx[d], wy[e] / wy[d]). By sorting on the ratio wy / wx each inner sum is two prefix sums."""
    ids, where = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = np.zeros(len(ids)), np.zeros(len(ids))
    a[where[: len(x)]], b[where[len(x) :]] = wx, wy
    ratio = np.divide(b, a, out=np.full(len(ids), np.inf), where=a > 0)
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    below, above = np.r_[0, np.cumsum(a)], np.r_[np.cumsum(b[::-1])[::-1], 0]
    shared = (a > 0) & (b > 0)
    at = np.searchsorted(ratio, ratio[shared], "left")
    return float((1 / (above[at] / b[shared] + below[at] / a[shared])).sum()) if shared.any() else 0.0


def _verified(threshold: float, weighted: bool):
    """Batches (a, b, sa, sb[, ca, cb]) -> (a, b, similarity) of at least the threshold, by whole sets."""

    def run(batches):
        for b in batches:
            flat = lambda k: b.column(k).flatten().to_numpy(zero_copy_only=False)
            ends = lambda k: np.r_[0, np.cumsum(np.diff(b.column(k).offsets.to_numpy()))]
            va, vb, oa, ob = flat("sa"), flat("sb"), ends("sa"), ends("sb")
            if weighted:
                ca, cb = flat("ca").astype(np.float64), flat("cb").astype(np.float64)
            sims = []
            for i in range(len(oa) - 1):
                p, q = slice(oa[i], oa[i + 1]), slice(ob[i], ob[i + 1])
                sims.append(probability_jaccard(va[p], ca[p], vb[q], cb[q]) if weighted else jaccard(va[p], vb[q]))
            mask = pa.array([s >= threshold for s in sims], pa.bool_())
            yield batch(["a", "b", "similarity"], [b.column("a").filter(mask), b.column("b").filter(mask), pa.array(sims, pa.float64()).filter(mask)], [None] * 3)

    return run


def candidates(keys: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """(a, b), a < b, once each: classes that share a band and are near enough in size. keys: id, n, band."""
    crowded = keys.groupBy("band").count().filter(F.col("count") > BLOCK).select("band", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    near = (F.col("a.n") >= F.lit(threshold) * F.col("b.n")) & (F.col("b.n") >= F.lit(threshold) * F.col("a.n"))
    near = F.lit(True) if weighted else near  # sizes bound plain similarity only
    order = F.col("a.id") < F.col("b.id")
    calm = keys.join(crowded.select("band"), "band", "left_anti")
    x, y = calm.alias("a"), calm.alias("b")
    pairs = x.join(y.hint("merge"), (F.col("a.band") == F.col("b.band")) & order & near)
    pairs = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    # crowded bands: blocks by size, so that each holds a narrow range of sizes; equal sizes are told apart by hash
    hot = keys.join(crowded, "band")
    cuts = hot.groupBy("band").agg(F.percentile_approx("n", F.array(*[F.lit(k / PARTS) for k in range(1, PARTS)]), F.lit(10_000)).alias("cuts"))
    rank = F.aggregate("cuts", F.lit(0), lambda at, c: at + (F.col("n") > c).cast("int"))
    per = F.greatest(F.ceil(F.col("blocks") / PARTS), F.lit(1)).cast("int")
    spread = hot.join(cuts, "band").select("id", "n", "band", rank.alias("range"), per.alias("per")).withColumn("block", F.col("range") * F.col("per") + F.pmod(F.xxhash64("id"), F.col("per")).cast("int"))
    part = lambda i, j: F.struct(F.least(i, j).alias("lo"), F.greatest(i, j).alias("hi"))
    placed = spread.select("id", "n", "band", "block", F.inline(F.transform(F.sequence(F.lit(0), F.col("per") * PARTS - 1), lambda j: part(F.col("block"), j))))
    if not weighted:  # ranges of sizes that are too far apart for any pair
        span = spread.groupBy("band", "block").agg(F.min("n").alias("least"), F.max("n").alias("most"))
        lo, hi = (span.select("band", F.col("block").alias(k), F.col("least").alias(f"least_{k}"), F.col("most").alias(f"most_{k}")) for k in ("lo", "hi"))
        fit = lo.join(hi, "band").filter((F.col("lo") <= F.col("hi")) & (F.col("most_lo") >= F.lit(threshold) * F.col("least_hi")) & (F.col("most_hi") >= F.lit(threshold) * F.col("least_lo")))
        placed = placed.join(fit.select("band", "lo", "hi"), ["band", "lo", "hi"], "left_semi")
    u, v = placed.filter("block = lo").alias("a"), placed.filter("block = hi").alias("b")
    met = u.join(v.hint("merge"), (F.col("a.band") == F.col("b.band")) & (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi")) & (F.col("a.id") != F.col("b.id")) & near)
    more = met.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"))
    return pairs.unionByName(more).distinct()


class NearDuplicates:
    """classes: (id, class_id) of every id with a shingle; links: (a, b, similarity), a < b, between class ids.

    weighted: shingles count as often as they stand in a text, and similarity is the probability Jaccard similarity;
    otherwise a set counts each once, and it is the plain Jaccard similarity.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, words_per_shingle: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 6, weighted: bool = False) -> None:
        texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
        schema = "id string, shingles array<long>, n int, digest binary" + ", counts array<int>" * weighted
        sets, _ = written(texts.mapInArrow(_shingle_sets(words_per_shingle, weighted), schema), "shingles")
        self.classes = sets.groupBy("id").agg(F.min("digest").alias("class_id"))
        extra = ["counts"] * weighted
        reps = sets.groupBy("digest").agg(F.any_value("n").alias("n"), F.any_value("shingles").alias("shingles"), *[F.any_value(c).alias(c) for c in extra])
        banded = reps.withColumnRenamed("digest", "id").select("id", "shingles", "n", *extra).mapInArrow(_bands(bands, rows, weighted), "id binary, n int, bands array<long>")
        banded, _ = written(banded, "bands")
        pairs = candidates(banded.select("id", "n", F.explode("bands").alias("band")), threshold, weighted)
        side = lambda k: reps.select(F.col("digest").alias(k), F.col("shingles").alias(f"s{k}"), *[F.col(c).alias(f"c{k}") for c in extra])
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", *(["ca", "cb"] * weighted))
        self.links, _ = written(both.mapInArrow(_verified(threshold, weighted), "a binary, b binary, similarity double"), "links")

    def pairs(self) -> DataFrame:
        """(a, b), a < b: all pairs of different ids, those within a class included: quadratic in copies. documents() and
        links say the same without expanding them."""
        c = self.classes
        x, y = c.select(F.col("id").alias("x"), F.col("class_id").alias("a")), c.select(F.col("id").alias("y"), F.col("class_id").alias("b"))
        across = self.links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        within = x.join(y, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("a"), F.col("y").alias("b"))
        return across.unionByName(within)

    def documents(self) -> DataFrame:
        """One row per text: (id, class_id, links), links being the number of similar classes."""
        ends = self.links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").count().withColumnRenamed("count", "links")
        return self.classes.join(ends, "class_id", "left").select("id", F.lower(F.hex("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
