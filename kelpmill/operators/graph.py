"""Entity graph queries over edge and mention tables; an undirected match sees a self-loop once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The closed vocabularies of relation and entity types.
RELATIONS = ("communicated_with", "requested_of", "committed_to", "mentions", "belongs_to", "scheduled_with", "about_topic", "related_to")
ENTITIES = ("PERSON", "ORG", "CONCEPT", "OTHER")


def relation_type(t: Column) -> Column:
    """Values of the vocabulary as they are written; everything else, null too, becomes related_to."""
    return F.when(t.isin(*RELATIONS), t).otherwise("related_to")


def entity_type(t: Column) -> Column:
    """trimmed and in upper case; everything else becomes OTHER."""
    up = F.upper(F.trim(t))
    return F.when(up.isin(*ENTITIES), up).otherwise("OTHER")


def both_ways(edges: DataFrame) -> DataFrame:
    """(entity, neighbour, type, direction, ...) from either end."""
    rest = [c for c in edges.columns if c not in ("from_id", "to_id")]
    out = edges.select(F.col("from_id").alias("entity"), F.col("to_id").alias("neighbour"), F.lit("out").alias("direction"), *rest)
    back = edges.filter("from_id <> to_id").select(F.col("to_id").alias("entity"), F.col("from_id").alias("neighbour"), F.lit("in").alias("direction"), *rest)
    return out.unionByName(back)


def entry_points(edges: DataFrame, least: float = 0.0, since: Column | None = None, limit: int = 20) -> DataFrame:
    """Entities of the highest degree."""
    rows = edges.filter(F.col("confidence") >= least)
    if since is not None:
        rows = rows.filter(F.col("observed_at") >= since)
    return both_ways(rows).groupBy("entity").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "entity").limit(limit)


def expand(edges: DataFrame, entity: int, limit: int = 50) -> DataFrame:
    """Neighbours of an entity by relation and direction."""
    near = both_ways(edges).filter(F.col("entity") == entity)
    return near.groupBy("neighbour", "type", "direction").agg(F.count(F.lit(1)).alias("weight"), F.max("observed_at").alias("last_seen")).orderBy(F.desc("weight"), F.desc("last_seen"), "neighbour", "type", "direction").limit(limit)


def evidence(edges: DataFrame, a: int, b: int, limit: int = 20) -> DataFrame:
    """Evidence of the edges between two entities, whichever way they point."""
    hit = ((F.col("from_id") == a) & (F.col("to_id") == b)) | ((F.col("from_id") == b) & (F.col("to_id") == a))
    return edges.filter(hit).select("evidence", "type", "observed_at").orderBy(F.desc("observed_at"), "evidence", "type").limit(limit)


def by_prefix(entities: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """G04/J18."""
    return entities.filter(F.col("name").startswith(prefix.strip().lower())).orderBy("name", "id").limit(limit)


def incremental(edges: DataFrame, watermark: int, overlap: int = 1000) -> DataFrame:
    """Edges behind a watermark, some of them again, once each."""
    return edges.filter(F.col("id") > watermark - overlap).dropDuplicates(["id"])


def projected(old: DataFrame, new: DataFrame, keys: list[str], order: str, first_wins: bool) -> DataFrame:
    """Merge by key; properties of the first (relations) or the last (documents) row stay."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    place = F.struct("_new", order)
    rest = F.struct(*[c for c in old.columns if c not in keys])
    pick = F.min_by(rest, place) if first_wins else F.max_by(rest, place)
    return both.groupBy(*keys).agg(pick.alias("_r")).select(*keys, "_r.*")
