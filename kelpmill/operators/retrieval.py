"""Hybrid retrieval: filtered lanes, reciprocal rank fusion, chunk lanes, recency, entities.

A lane takes its best candidates first (a distributed top-k) and ranks only those, so no window ever sees the corpus.
Fusion is a union of (id, lane, rank) and one aggregation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kelpmill.functions import text as X


@dataclass(frozen=True)
class SearchWeights:
    """Nan, infinite and zero values stand for the default, negative ones disable a lane."""

    k: float = 60.0
    fts: float = 1.0
    vec: float = 1.0
    bigm: float = 1.0
    summvec: float = 0.0
    entity: float = 0.0

    def resolved(self, coverage: float = 0.0, entities_on: bool = False) -> SearchWeights:
        pick = lambda v, d: d if v is None or math.isnan(v) or math.isinf(v) or v == 0 else max(v, 0.0)
        return SearchWeights(pick(self.k, 60.0), pick(self.fts, 1.0), pick(self.vec, 1.0), pick(self.bigm, 1.0), pick(self.summvec, 0.8 if coverage >= 0.80 else 0.0), pick(self.entity, 0.5 if entities_on else 0.0))


@dataclass(frozen=True)
class SearchQuery:
    text: str
    vector: list[float] | None = None
    limit: int = 20
    source_type: str | None = None
    source_types: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    begin: datetime | None = None
    end: datetime | None = None
    include_deleted: bool = False
    sort: str = "score"
    weights: SearchWeights = field(default_factory=SearchWeights)

    def includes(self) -> list[str]:
        """Ordered union without repeats; empty means all."""
        return list(dict.fromkeys([*([self.source_type] if self.source_type else []), *self.source_types]))

    def excludes(self) -> list[str]:
        """Insights stay out unless asked for."""
        asked = "insight" in self.includes() or "insight" in self.exclude
        return list(dict.fromkeys([*self.exclude, *([] if asked else ["insight"])]))

    def words(self) -> list[str]:
        out, word = [], ""
        for c in self.text.lower() + " ":
            if c.isalnum():
                word += c
            elif word:
                out.append(word)
                word = ""
        return list(dict.fromkeys(out))


def clamp(limit: int | None, default: int, most: int) -> int:
    """P20."""
    return default if not limit or limit < 0 else min(limit, most)


def filtered(docs: DataFrame, q: SearchQuery) -> DataFrame:
    """What every lane may see; exclusion beats inclusion, the window is half open and never holds nulls."""
    if not q.include_deleted:
        docs = docs.filter(F.col("status") == "active")
    if inc := q.includes():
        docs = docs.filter(F.col("source_type").isin(inc))
    if exc := q.excludes():
        docs = docs.filter(~F.col("source_type").isin(exc))
    if q.begin is not None:
        docs = docs.filter(F.col("occurred_at") >= F.lit(q.begin))
    if q.end is not None:
        docs = docs.filter(F.col("occurred_at") < F.lit(q.end))
    return docs


def like(docs: DataFrame, text: str) -> Column:
    """Substring in content or title; % and _ of the user are wildcards."""
    pattern = f"%{text}%"
    return F.coalesce(F.col("content").like(pattern), F.lit(False)) | F.coalesce(F.col("title").like(pattern), F.lit(False))


def ranked(candidates: DataFrame, lane: str, n: int) -> DataFrame:
    """(id, lane, rank) of the n best; candidates has id and score, ties go to the lesser id."""
    top = candidates.orderBy(F.desc("score"), F.asc("id")).limit(n)
    return top.select("id", F.lit(lane).alias("lane"), F.row_number().over(Window.orderBy(F.desc("score"), F.asc("id"))).alias("rank"), "score")


def fts_score(words: list[str]) -> Column:
    """Score of a row in which all words stand, else null. Texts that don't even hold the letters of the words
    are not cut into words."""
    holds = F.lit(True)
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "content")]
    for w in words:
        holds = holds & (low[0].contains(w) | low[1].contains(w))
    parts = F.struct(X.tokens(F.col("title")).alias("t"), X.tokens(F.col("content")).alias("c"))
    scored = F.transform(F.array(parts), lambda p: F.when(X.matches_all(p["t"], p["c"], words), X.lexical_score(p["t"], p["c"], words)))[0]
    return F.when(holds, scored)


def fts_candidates(docs: DataFrame, q: SearchQuery) -> DataFrame:
    words = q.words()
    if not words:
        return docs.limit(0).select("id", F.lit(0.0).alias("score"))
    return docs.select("id", fts_score(words).alias("score")).filter("score IS NOT NULL")


def text_lanes(docs: DataFrame, q: SearchQuery, n: int) -> DataFrame:
    """(id, lane, rank, score) of the full-text and the bigram lane from one scan. Each partition passes on its n best of
    a lane only (a limit on the groups of the window), so nothing but candidates is shuffled."""
    words = q.words()
    bigm = F.when(like(docs, q.text), F.greatest(X.bigram_similarity(F.col("content"), q.text), X.bigram_similarity(F.col("title"), q.text)))
    fts = fts_score(words) if words else F.lit(None).cast("double")
    both = docs.select("id", F.inline(F.array(F.struct(F.lit("fts").alias("lane"), fts.alias("score")), F.struct(F.lit("bigm").alias("lane"), bigm.alias("score"))))).filter("score IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("score"), F.asc("id")))
    return both.withColumn("rank", place).filter(F.col("rank") <= n).select("id", "lane", "rank", "score")


def vec_candidates(docs: DataFrame, q: SearchQuery, column: str = "embedding") -> DataFrame:
    if not q.vector:
        return docs.limit(0).select("id", F.lit(0.0).alias("score"))
    mine = F.array(*[F.lit(float(x)) for x in q.vector])
    return docs.filter(X.usable_vector(F.col(column), len(q.vector))).select("id", F.round(X.cosine(F.col(column), mine), 6).alias("score"))


def bigm_candidates(docs: DataFrame, q: SearchQuery) -> DataFrame:
    return docs.filter(like(docs, q.text)).select("id", F.greatest(X.bigram_similarity(F.col("content"), q.text), X.bigram_similarity(F.col("title"), q.text)).alias("score"))


def entity_candidates(docs: DataFrame, mentions: DataFrame, q: SearchQuery) -> DataFrame:
    """Documents by the number of their entities whose name holds the query. mentions: id, name."""
    name = q.text.strip().lower()
    if not name:
        return docs.limit(0).select("id", F.lit(0.0).alias("score"))
    hits = mentions.filter(F.col("name").like(f"%{name}%")).groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("score"))
    return hits.join(docs.select("id"), "id", "left_semi")


def fulltext(docs: DataFrame, q: SearchQuery) -> DataFrame:
    """Full-text search without vectors: all words match, or the text as a substring."""
    words, rows = q.words(), filtered(docs, q)
    every = fts_score(words) if words else F.lit(None).cast("double")
    found = rows.select("id", "source_type", every.alias("_all"), like(rows, q.text).alias("_like"), "title", "content").filter("_all IS NOT NULL OR _like")
    part = X.lexical_score(X.tokens(F.col("title")), X.tokens(F.col("content")), words) if words else F.lit(0.0)
    return found.select("id", "source_type", F.coalesce("_all", part).alias("score")).orderBy(F.desc("score"), "id").limit(q.limit)


def lanes(docs: DataFrame, q: SearchQuery, mentions: DataFrame | None = None, summaries: bool = False) -> DataFrame:
    """(id, lane, rank, score) of all lanes that have a weight, each cut to twice the limit."""
    rows, n, w = filtered(docs, q), 2 * q.limit, q.weights
    out = [text_lanes(rows, q, n), ranked(vec_candidates(rows, q), "vec", n)]
    if summaries and w.summvec > 0:
        out.append(ranked(vec_candidates(rows, q, "summary_embedding"), "summvec", n))
    if mentions is not None and w.entity > 0:
        out.append(ranked(entity_candidates(rows, mentions, q), "entity", n))
    all_of = out[0]
    for x in out[1:]:
        all_of = all_of.unionByName(x)
    return all_of


def fused(lane_rows: DataFrame, w: SearchWeights) -> DataFrame:
    """(id, score), the sum of weight / (k + rank) over the lanes of a document."""
    weight = F.create_map(*[x for n in ("fts", "vec", "bigm", "summvec", "entity") for x in (F.lit(n), F.lit(float(getattr(w, n))))])
    return lane_rows.groupBy("id").agg(F.round(F.sum(weight[F.col("lane")] / (F.lit(w.k) + F.col("rank"))), 9).alias("score"))


def fused_by_joins(lane_rows: DataFrame, w: SearchWeights) -> DataFrame:
    """The same by full outer joins, an oracle for fused()."""
    out = None
    for name in ("fts", "vec", "bigm"):
        one = lane_rows.filter(F.col("lane") == name).select("id", (F.lit(float(getattr(w, name))) / (F.lit(w.k) + F.col("rank"))).alias(name))
        out = one if out is None else out.join(one, "id", "full")
    return out.select("id", F.round(sum((F.coalesce(F.col(n), F.lit(0.0)) for n in ("fts", "vec", "bigm")), F.lit(0.0)), 9).alias("score"))


def recency_ascending(begin: datetime | None, now: datetime) -> bool:
    """Only a window that lies wholly ahead is listed from its start."""
    return begin is not None and begin >= now


def by_recency(rows: DataFrame, ascending: bool = False) -> DataFrame:
    """Dated rows first, then score and id."""
    if ascending:
        return rows.orderBy(F.asc_nulls_last("occurred_at"), F.desc("score"), "id")
    return rows.orderBy(F.desc_nulls_last(F.coalesce("occurred_at", "collected_at")), F.desc("score"), "id")


def hybrid_search(docs: DataFrame, q: SearchQuery, now: datetime, mentions: DataFrame | None = None) -> DataFrame:
    """The fused best twice the limit, joined to their documents, ordered and cut."""
    best = fused(lanes(docs, q, mentions), q.weights).orderBy(F.desc("score"), "id").limit(2 * q.limit)
    rows = docs.select("id", "source_type", "title", "occurred_at", "collected_at").join(F.broadcast(best), "id")  # at most 2 * limit rows
    if q.sort == "recent":
        return by_recency(rows, recency_ascending(q.begin, now)).limit(q.limit)
    return rows.orderBy(F.desc("score"), "id").limit(q.limit)


def chunk_best(scored: DataFrame, n: int) -> DataFrame:
    """Of the 3n best chunks the best of each document, cut to n. scored: id, chunk_index, score."""
    top = scored.orderBy(F.desc("score"), "id", "chunk_index").limit(3 * n)
    w = Window.partitionBy("id").orderBy(F.desc("score"), "chunk_index")
    return top.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").orderBy(F.desc("score"), "id").limit(n)


def chunk_fts(chunks: DataFrame, q: SearchQuery) -> DataFrame:
    """Chunks in which all words or the text stand; a mere substring scores 0.01."""
    words, low = q.words(), F.lower("chunk")
    none = F.array().cast("array<string>")
    substring = F.when(F.col("chunk").like(f"%{q.text}%"), 0.01)
    holds = F.lit(bool(words))
    for w in words:
        holds = holds & low.contains(w)
    scored = F.transform(F.array(X.tokens(F.col("chunk"))), lambda t: F.when(X.matches_all(none, t, words), X.lexical_score(none, t, words or [""])))[0]
    rows = chunks.select("id", "chunk_index", F.when(holds, scored).alias("_f"), substring.alias("_s")).filter("_f IS NOT NULL OR _s IS NOT NULL")
    return rows.select("id", "chunk_index", F.round(F.greatest(F.coalesce("_f", F.lit(0.0)), F.coalesce("_s", F.lit(0.0))), 6).alias("score"))


def merged(primary: DataFrame, secondary: DataFrame, limit: int) -> DataFrame:
    """Both lists by 1 / (60 + rank); what only the second has fills free places and displaces nothing.

    primary, secondary: id, rank.
    """
    both = primary.select("id", F.col("rank").alias("p")).join(secondary.select("id", F.col("rank").alias("s")), "id", "full")
    free = F.lit(limit) - F.count("p").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.partitionBy(F.col("p").isNull()).orderBy(F.asc_nulls_last("s"), "id"))
    kept = both.withColumn("_free", free).withColumn("_place", place).filter(F.col("p").isNotNull() | (F.col("_place") <= F.col("_free")))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(60.0) + F.col(c)), F.lit(0.0))
    match = F.when(F.col("p").isNotNull() & F.col("s").isNotNull(), "hybrid+chunk").when(F.col("p").isNotNull(), "hybrid").otherwise("chunk-vector")
    return kept.select("id", F.round(part("p") + part("s"), 9).alias("score"), match.alias("match_type")).orderBy(F.desc("score"), "id").limit(limit)


def with_entities(rows: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entities of each document, by type and name, as one text."""
    per = mentions.join(rows.select("id"), "id").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("type", "name"))), lambda e: F.concat(e["type"], F.lit(":"), e["name"])), ",").alias("entities"))
    return rows.join(per, "id", "left").withColumn("entities", F.coalesce("entities", F.lit("")))


def reranked(rows: DataFrame, score: Column | None) -> DataFrame:
    """By the provider's score; without one the order stays and scores fall in equal steps."""
    if score is None:
        w = Window.orderBy(F.desc("score"), "id")
        n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
        return rows.withColumn("rerank", F.round((n - F.row_number().over(w) + 1) / n, 6))
    return rows.withColumn("rerank", score)


def curated(rows: DataFrame, verdicts: DataFrame, least: float = 0.3) -> DataFrame:
    """Verdicts (index, relevance) joined by place; unknown places drop, weak ones too. rows: index."""
    return rows.join(verdicts, "index").filter(F.col("relevance") >= least).orderBy(F.desc("relevance"), "index")


def ordered_union(*parts: Column) -> Column:
    """The values of several arrays in order, each once; null arrays hold nothing."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(p, none) for p in parts]))


def answer_sources(rows: DataFrame) -> DataFrame:
    """What an answer shows of the documents it rests on."""
    return rows.select("id", "title", "source_type", "score", "occurred_at")


def expanded(question: str, write=None) -> str:
    """The question and behind it a passage that could answer it; without a writer, or if it fails or writes
    nothing, the question alone."""
    if write is None:
        return question
    try:
        passage = write(question)
    except Exception:  # noqa: BLE001 - a service may fail in any way
        return question
    return f"{question}\n\n{passage}" if passage else question


def snippets(hits: DataFrame, docs: DataFrame, match_type: str) -> DataFrame:
    """Hits of chunks as results: the chunk is the snippet, titles and sources come from the documents.

    hits: id, chunk, score, at most a few times the limit."""
    return hits.join(docs.select("id", "title", "source_type"), "id").select("id", "title", "source_type", F.col("chunk").alias("snippet"), "score", F.lit(match_type).alias("match_type"))


def by_score(rows: DataFrame, order: str) -> DataFrame:
    """By score, equal ones in the order they came in."""
    return rows.orderBy(F.desc("score"), order)
