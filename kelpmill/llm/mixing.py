"""Mixing sources to target weights by a minimum-cost flow over membership patterns.

Equal texts are one unit; the set of sources that hold it is its pattern. Units are summed to tokens per pattern, a
small table. Tokens flow from patterns to source quotas: of a pattern's tokens the first use costs nothing, each
further use one more than the one before (convex), and a source takes a unit at most max_repeats times. The flow is
then laid out along each pattern: units stand in seeded hash order on a circle of the pattern's tokens, the sources
take consecutive arcs, and a unit is used by a source as often as the arc passes its place. Shares are therefore met
to within one document per pattern and source.

Without total_tokens the total is the largest for which every source that has text can reach its target exactly.

Bounds: only token sums per pattern reach the driver (at most MOST_PATTERNS, checked); running sums go by hash ranges
of each pattern, so that no task holds a whole pattern.

Cases: null and empty texts and texts without a token are no units; null sources are left out; a source without a
target is never drawn, one without text gets share 0 and the others keep their proportions; null or negative max_repeats counts as 1;
several target rows of a source are summed; repeated rows of a text in a source count once, the least doc_id standing
for them; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kelpmill.session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_PATTERNS = 200_000


BLANKS = re.compile(r"\s{500,}")


def count_tokens(encoder, text: str) -> int:
    """Tokens of a whole text. Long runs of white space, which the splitting pattern can't take, are pieces of their own
    just as the pattern has them: all of the run, but for its last character if something follows."""
    n = at = 0
    for m in BLANKS.finditer(text):
        end = m.end() - (m.end() < len(text))
        n += len(encoder.encode_ordinary(text[at : m.start()])) + len(encoder._encode_single_piece(text[m.start() : end]))
        at = end
    return n + len(encoder.encode_ordinary(text[at:]))


def _counter(path: str):
    def run(batches):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encoder = tiktoken.Encoding("mixing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "unit": pdf["unit"], "n_tokens": [count_tokens(encoder, t) for t in pdf["text"]]})

    return run


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, unit, n_tokens): unit is the md5 of the text."""
    rows = docs.filter("doc_id IS NOT NULL AND source IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.md5("text").alias("unit"), "text")
    return rows.mapInPandas(_counter(tokenizer), "doc_id long, source string, unit string, n_tokens long").filter("n_tokens > 0")


def min_cost_flow(arcs: list[tuple], source, sink) -> tuple[int, dict, set]:
    """Maximum flow of least cost by successive shortest paths. arcs: (from, to, capacity, cost). The flow, its parts by
    arc number, and the nodes on the source's side of a least cut."""
    graph, to, cap, cost = defaultdict(list), [], [], []
    for a, b, c, w in arcs:
        graph[a].append(len(to))
        to.append(b), cap.append(c), cost.append(w)
        graph[b].append(len(to))
        to.append(a), cap.append(0), cost.append(-w)
    total = 0
    while True:
        dist, via, queue, waiting = {source: 0}, {}, deque([source]), {source}
        while queue:
            u = queue.popleft()
            waiting.discard(u)
            for e in graph[u]:
                if cap[e] > 0 and dist[u] + cost[e] < dist.get(to[e], 1 << 60):
                    dist[to[e]], via[to[e]] = dist[u] + cost[e], e
                    if to[e] not in waiting:
                        queue.append(to[e])
                        waiting.add(to[e])
        if sink not in dist:
            return total, {i: cap[2 * i + 1] for i in range(len(arcs))}, set(dist)
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        least = min(cap[e] for e in path)
        for e in path:
            cap[e] -= least
            cap[e ^ 1] += least
        total += least


def _network(patterns: dict[tuple, int], quota: dict[str, int], repeats: dict[str, int]) -> list[tuple]:
    arcs = []
    for p, tokens in patterns.items():
        for use in range(sum(repeats[s] for s in p)):
            arcs.append(("in", p, tokens, use))
        arcs += [(p, s, tokens * repeats[s], 0) for s in p]
    return arcs + [(s, "out", q, 0) for s, q in quota.items()]


def flows(tokens: dict[tuple, int], targets: dict[str, float], repeats: dict[str, int], total: int | None = None) -> dict[tuple, int]:
    """Tokens to draw by (pattern, source)."""
    alive = {s for p in tokens for s in p}
    weight = sum(w for s, w in targets.items() if s in alive)
    if not weight:
        return {}
    share = {s: w / weight for s, w in targets.items() if s in alive and w > 0}
    quota = lambda t: {s: int(t * w) for s, w in share.items()}
    if total is None:  # from cut to cut: each names sources whose quotas pass all that can reach them
        total = 2 * sum(n * sum(repeats[s] for s in p) for p, n in tokens.items()) + 1
        while True:
            q = quota(total)
            arcs = _network(tokens, q, repeats)
            flow, _, near = min_cost_flow(arcs, "in", "out")
            if flow == sum(q.values()):
                break
            reach = sum(c for a, b, c, _ in arcs if a in near and b not in near and b != "out")
            total = min(total - 1, int(reach / sum(w for s, w in share.items() if s not in near)))
    arcs = _network(tokens, quota(total), repeats)
    flow = min_cost_flow(arcs, "in", "out")[1]
    return {(a, b): flow[i] for i, (a, b, _, _) in enumerate(arcs) if isinstance(a, tuple) and b != "out" and flow[i]}


def draw(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(drawn, targets): drawn has doc_id, source, n_tokens, repeats; targets one row per source."""
    spark = docs.sparkSession
    wanted = targets.filter("source IS NOT NULL").groupBy("source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.min(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("max_repeats"))
    rows = [r.asDict() for r in wanted.filter("target_share > 0").limit(10_001).collect()]
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 sources")
    share, repeats = {r["source"]: r["target_share"] for r in rows}, {r["source"]: r["max_repeats"] for r in rows}
    counted, _ = written(token_counts(docs.join(F.broadcast(wanted.filter("target_share > 0").select("source")), "source", "left_semi"), tokenizer), "tokens")
    held = counted.groupBy("unit", "source").agg(F.min("doc_id").alias("doc_id"), F.any_value("n_tokens").alias("n_tokens"))
    units = held.groupBy("unit").agg(F.array_sort(F.collect_set("source")).alias("pattern"), F.any_value("n_tokens").alias("n_tokens"))
    units, _ = written(units.withColumn("at", F.xxhash64("unit", F.lit(seed))), "units")
    sums = units.groupBy("pattern").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("units")).limit(MOST_PATTERNS + 1).collect()
    if len(sums) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    tokens = {tuple(r["pattern"]): r["n"] for r in sums}
    taken, begin = flows(tokens, share, repeats, total_tokens), defaultdict(int)
    arcs = []
    for (p, s), n in sorted(taken.items()):
        arcs.append((list(p), s, begin[p], n, tokens[p]))
        begin[p] += n
    arc_df = spark.createDataFrame(arcs, "pattern array<string>, source string, begin long, length long, around long")
    bits = max(0, sum(r["units"] for r in sums).bit_length() - 12)  # ranges of about 4,000 units
    ranged = units.withColumn("range", F.shiftright(F.col("at"), 64 - bits) if bits else F.lit(0).cast("long"))
    per_range = ranged.groupBy("pattern", "range").agg(F.sum("n_tokens").alias("_n"))
    before = per_range.withColumn("_before", F.sum("_n").over(Window.partitionBy("pattern").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("pattern", "range", F.coalesce("_before", F.lit(0)).alias("_before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("pattern", "range").orderBy("at", "unit").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    placed = ranged.withColumn("_in", inside).join(before, ["pattern", "range"]).withColumn("place", F.col("_in") + F.col("_before"))
    # the number of turns t with begin <= place + t * around < begin + length
    at_or_after = lambda x: F.ceil((x - F.col("place")) / F.col("around"))
    used = placed.join(arc_df, "pattern").withColumn("repeats", (at_or_after(F.col("begin") + F.col("length")) - at_or_after(F.col("begin"))).cast("int"))
    drawn = used.filter("repeats > 0").select("unit", "source", "repeats").join(held, ["unit", "source"]).select("doc_id", "source", "n_tokens", "repeats")
    return drawn, wanted


def shares(drawn: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, documents, most_repeats) of every target source."""
    per = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    all_of = wanted.join(per, "source", "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    total = all_of.agg(F.sum("tokens").alias("_total"))
    return all_of.crossJoin(F.broadcast(total)).select("source", "target_share", F.coalesce(F.col("tokens") / F.nullif(F.col("_total"), F.lit(0)), F.lit(0.0)).alias("actual_share"), "tokens", "documents", "most_repeats")
