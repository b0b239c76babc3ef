"""Speaker blocks of a transcript (F26): speakers numbered by first appearance, neighbouring segments of one joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SPEAKER = "화자"  # fixed value


def blocks(segments: DataFrame) -> DataFrame:
    """(recording, content, speakers): one text per recording. segments: recording, at, speaker, text.

    Blank segments give no text but count as appearances. The text of a recording is one value and stands on one task
    at the end; what leads there goes by windows over a recording.
    """
    order = Window.partitionBy("recording").orderBy("at")
    first = segments.groupBy("recording", "speaker").agg(F.min("at").alias("_first"))
    numbered = first.withColumn("no", F.row_number().over(Window.partitionBy("recording").orderBy("_first", "speaker"))).drop("_first")
    changed = (~F.lag("speaker").over(order).eqNullSafe(F.col("speaker"))).cast("int")
    runs = segments.withColumn("_new", changed).withColumn("_block", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).join(numbered, ["recording", "speaker"])
    said = runs.withColumn("text", F.trim("text")).filter("text <> ''")
    lines = said.groupBy("recording", "_block", "no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("_t"))
    line = F.concat(F.lit(f"[{SPEAKER}"), F.col("no").cast("string"), F.lit("] "), F.col("_t"))
    texts = lines.groupBy("recording").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_block", line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))
    return texts.join(numbered.groupBy("recording").agg(F.count(F.lit(1)).alias("speakers")), "recording")
