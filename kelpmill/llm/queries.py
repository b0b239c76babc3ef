"""Registered queries of this folder; SQL holds the oracles where SQL can express the operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpmill.llm import leaks, mail, mixing, personal, speech, split, subjects, vectors
from kelpmill.llm.neardup import NearDuplicates
from kelpmill.session import table

EDITED = ("notion", "gdrive", "github", "filesystem", "note")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "brain_documents").filter(F.col("source_type").isin(*EDITED))
    near = NearDuplicates(docs, "source_id", "content", words_per_shingle=3, threshold=0.6, bands=50, rows=4)
    return near.pairs().select(F.col("a").alias("source_id_a"), F.col("b").alias("source_id_b"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(table(spark, sf_dir, "documents"), "doc_id", "text").documents()


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "brain_documents").select("record_id", "source_type", "content")
    return split.with_limits(docs, table(spark, sf_dir, "split_limits"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = split.oversized_pieces(_limited(spark, sf_dir), "record_id", "content")
    return cut.filter("piece_no = 2").select(F.col("row").alias("record_id"))  # a row that was cut has a second piece


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.pieces(_limited(spark, sf_dir), "record_id", "content").withColumnRenamed("row", "record_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vectors.similar(table(spark, sf_dir, "brain_documents"), "source_id", "embedding", "record_id")
    return near.select(F.least("a", "b").alias("source_id_a"), F.greatest("a", "b").alias("source_id_b")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = speech.turns_of_segments(table(spark, sf_dir, "whisper_segments"), table(spark, sf_dir, "diar_segments"))
    return rows.select("recording_id", "seg_index", "turn_no", "speaker_no").distinct()


def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech.turns(table(spark, sf_dir, "whisper_segments"), table(spark, sf_dir, "diar_segments"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of each item: documents touched, and those that hold at least half of its words."""
    found = leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.count_if(F.col("covered") * 2 >= F.col("item_words")).alias("at_least_half"), F.max("longest").alias("longest"))


def p9_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(*mixing.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.new_lines(table(spark, sf_dir, "brain_documents"), table(spark, sf_dir, "gmail_messages"))


def p3_new_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mail.new_text(table(spark, sf_dir, "brain_documents"), table(spark, sf_dir, "gmail_messages"))


FIELDS = (("brain_documents", "content"), ("ingest_sms", "body"), ("ingest_sms", "contact_name"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = (personal.find(table(spark, sf_dir, t), "record_id", f) for t, f in FIELDS)
    return a.unionByName(b).unionByName(c).select("field_name", "record_id", "start_char", "kind")


def p7_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b, c = (personal.redacted(table(spark, sf_dir, t), "record_id", f).select(F.lit(f).alias("field_name"), "record_id", "text") for t, f in FIELDS)
    return a.unionByName(b).unionByName(c)


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sentences of each subject."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"), F.sum("hits").alias("sentences"))


QUERIES = {"p7_found": p7_found, "p7_redacted": p7_redacted, "p10_found": p10_found, "p10_composition": p10_composition, "p3_found": p3_found, "p3_new_text": p3_new_text, "p8_found": p8_found, "p8_items": p8_items, "p9_drawn": p9_drawn, "p9_shares": p9_shares, "p5_found": p5_found, "p5_turns": p5_turns, "p2_found": p2_found, "p2_classes": p2_classes, "p4_found": p4_found, "p4_pieces": p4_pieces, "p6_found": p6_found}
WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


def _runs(rows: str, key: str, text: str, n: int) -> str:
    """SQL of the distinct n-word sequences of each text."""
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"SELECT DISTINCT {key}, {joined} AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {key}, {WORDS.format(text)} AS w FROM {rows} WHERE {text} IS NOT NULL) WHERE len(w) >= {n})"


SQL: dict[str, str] = {
    "p2_found": f"""WITH d AS (SELECT source_id, min(content) AS content FROM brain_documents WHERE source_type IN {EDITED} GROUP BY 1), s AS ({_runs('d', 'source_id', 'content', 3)}), n AS (SELECT source_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.source_id AS a, b.source_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.source_id < b.source_id GROUP BY 1, 2)
        SELECT a AS source_id_a, b AS source_id_b FROM p JOIN n x ON a = x.source_id JOIN n y ON b = y.source_id WHERE c / (x.n + y.n - c) >= 0.6""",
    "p8_found": f"WITH d AS ({_runs('documents', 'doc_id', 'text', 12)}), i AS ({_runs('eval_items', 'item_id', 'item_text', 12)}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)",
    "p4_found": "SELECT record_id FROM brain_documents JOIN split_limits USING (source_type) WHERE length(content) > max_chars",
}
