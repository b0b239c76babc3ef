"""Enrichment: outputs of language models parsed and checked in columns; offline stand-ins for the services.

A service is a function from texts to JSON texts that runs per Arrow batch; services are injected, and those here need
no network.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from kelpmill.functions import text as X
from kelpmill.operators.graph import entity_type, relation_type
from kelpmill.operators.state import merged_json

Service = Callable[[list[str]], list[str]]


def first_json(text: Column) -> Column:
    """the outermost object in a model's answer, fences and talk around it left out."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def cut_bytes(text: Column, most: int) -> Column:
    """The first bytes of a text with three dots, never a broken character."""
    return F.when(F.octet_length(text) > most, F.concat(X.byte_prefix(text, most), F.lit("..."))).otherwise(text)


def served(rows: DataFrame, service: Service, text: str) -> DataFrame:
    """rows: id and a text column -> id, answer."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "answer": service([t or "" for t in pdf["text"]])})

    return rows.select("id", F.col(text).alias("text")).mapInPandas(run, "id string, answer string")


def summaries(answers: DataFrame) -> DataFrame:
    """Id, title_summary, bullet_summary, and the text to embed."""
    a = answers.select("id", F.from_json(first_json(F.col("answer")), "title_summary string, bullet_summary string").alias("a")).filter("a IS NOT NULL").select("id", "a.*")
    return a.withColumn("to_embed", F.concat_ws("\n\n", "title_summary", "bullet_summary"))


def entities(answers: DataFrame, most: int = 15) -> DataFrame:
    """Trimmed names with their canonical type, blanks dropped, at most 15 a document."""
    rows = answers.select("id", F.posexplode(F.from_json(first_json(F.col("answer")), "entities array<struct<name:string,type:string>>")["entities"]).alias("at", "e"))
    good = rows.select("id", "at", F.trim("e.name").alias("name"), entity_type(F.coalesce("e.type", F.lit(""))).alias("type")).filter("name <> ''")
    w = Window.partitionBy("id").orderBy("at")
    return good.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).select("id", "name", "type")


def relations(answers: DataFrame) -> DataFrame:
    """Relations with both ends; unknown types are downgraded, confidence is kept within 0 and 1."""
    rows = answers.select("id", F.inline(F.from_json(first_json(F.col("answer")), "relations array<struct<source:string,target:string,type:string,confidence:double>>")["relations"]))
    return rows.filter("trim(source) <> '' AND trim(target) <> ''").select("id", F.trim("source").alias("source"), F.trim("target").alias("target"), relation_type(F.coalesce("type", F.lit(""))).alias("type"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)))).cast("decimal(3,2)").alias("confidence"))


def insights(answers: DataFrame, most: int = 3) -> DataFrame:
    """The first three insights of a note with their ids."""
    rows = answers.select("id", F.posexplode(F.slice(F.filter(F.from_json(first_json(F.col("answer")), "insights array<string>")["insights"], lambda x: F.trim(x) != ""), 1, most)).alias("i", "insight"))
    return rows.select("id", F.concat(F.lit("insight:"), "id", F.lit(":"), F.col("i").cast("string")).alias("source_id"), F.trim("insight").alias("insight"))


def grounded(sentences: DataFrame, keys: DataFrame, longest: int = 400, most: int = 6) -> DataFrame:
    """Sentences of a briefing that are short enough and cite only known keys. sentences: id, at, text, cites."""
    short = sentences.filter((F.trim("text") != "") & (F.length("text") <= longest) & (F.size("cites") > 0))
    cited = short.select("id", "at", F.explode("cites").alias("key")).join(keys.select("key", F.lit(True).alias("_known")).distinct(), "key", "left")
    unknown = cited.filter("_known IS NULL").select("id", "at").distinct()
    good = short.join(unknown, ["id", "at"], "left_anti")
    w = Window.partitionBy("id").orderBy("at")
    return good.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).select("id", "at", "text", "cites")


def cache_key(version: str, model: str, latest: Column, keys: Column) -> Column:
    """F32: the same for the same actions in any order; latest in UTC to the second."""
    at = F.date_format(F.to_utc_timestamp(latest, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.sha2(F.concat_ws("|", F.lit(version), F.lit(model), at, F.array_join(F.array_sort(keys), "\n")), 256)


def context_block(ranked: DataFrame, snippet: int = 800, most: int = 12_000) -> DataFrame:
    """Snippets by rank, stopping before the first that would pass the limit of bytes. ranked: query, rank, text."""
    rows = ranked.withColumn("snippet", F.substring("text", 1, snippet))
    total = F.sum(F.octet_length("snippet")).over(Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_total", total).filter(F.col("_total") <= most).select("query", "rank", "snippet")


def prompt(rows: DataFrame) -> DataFrame:
    """One text per query: sections of observed and inferred rows, each with its local time. rows: query, lane, rank, title, occurred_at."""
    when = X.korean_time(F.col("occurred_at"))
    line = rows.withColumn("_l", F.concat(F.lit("- ["), when, F.lit("] "), F.coalesce("title", F.lit(""))))
    part = line.groupBy("query", "lane").agg(F.concat(F.upper("lane"), F.lit("\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_l"))), lambda x: x["_l"]), "\n")).alias("_p"))
    return part.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("lane") == "observed", 0).otherwise(1).alias("o"), "_p"))), lambda x: x["_p"]), "\n\n").alias("prompt"))


RETRY_MINUTES, MOST_ATTEMPTS = (1, 5, 30), 3  # fixed values


def retry_after(attempts: Column, minutes: tuple[int, ...] = RETRY_MINUTES) -> Column:
    """Minutes to wait by the number of failures; the last value holds on."""
    return F.element_at(F.array(*map(F.lit, minutes)), F.greatest(F.lit(1), F.least(attempts, F.lit(len(minutes)))))


def attempt_failed(metadata: Column, attempts: Column, reason: Column, now: Column) -> Column:
    """Metadata after a failure: a time for the next attempt, or, with the last one, the state 'failed'."""
    again = F.to_json(F.struct(attempts.alias("enrichment_attempts"), reason.alias("enrichment_last_error"), (now + F.make_dt_interval(mins=retry_after(attempts))).alias("enrichment_next_retry_at")))
    end = F.to_json(F.struct(F.lit("failed").alias("enrichment_status"), reason.alias("enrichment_last_error")))
    return merged_json(metadata, F.when(attempts < MOST_ATTEMPTS, again).otherwise(end))


def note_reset(metadata: Column) -> Column:
    """A failed note is pending again, without attempts; any other stays as it is."""
    fresh = F.lit('{"enrichment_status":"pending","enrichment_attempts":0,"enrichment_last_error":null,"enrichment_next_retry_at":null}')
    return F.when(F.get_json_object(metadata, "$.enrichment_status") == "failed", merged_json(metadata, fresh)).otherwise(metadata)


def note_enriched(title: Column, metadata: Column, new_title: Column, fields: Column) -> tuple[Column, Column]:
    """(title, metadata) of an enriched note; a blank title keeps the old one, the content is never touched."""
    return F.when(F.coalesce(new_title, F.lit("")) != "", new_title).otherwise(title), merged_json(metadata, fields)


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """An offline embedder: signed hashes of words, unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts):
            for w in re.findall(r"[^\W_]+", t.lower()):
                h = xxhash.xxh3_64_intdigest(w)
                row[h % dim] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)

    return embed


def packed_batches(texts: list[str], most_chars: int = 500_000) -> list[list[str]]:
    """Batches of at most so many characters, in order; a longer text goes alone."""
    out: list[list[str]] = []
    size = 0
    for t in texts:
        if not out or size + len(t) > most_chars:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return out


def embedded(rows: DataFrame, embed: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """ST9: (id, embedding) of rows: id, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vectors = [v for part in packed_batches([t or "" for t in pdf["text"]]) for v in embed(part)]
            yield pd.DataFrame({"id": pdf["id"], "embedding": [v.astype(np.float32) for v in vectors]})

    return rows.select("id", "text").mapInPandas(run, "id string, embedding array<float>")
