"""Queries of the message mappers, the push ingest and enrichment, over the raw tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from kelpmill.operators import enrich as N
from kelpmill.plans.analytics import docs, sms
from kelpmill.sources import files as S
from kelpmill.sources import messages as M
from kelpmill.sources.extract import extracted

QUERIES: dict = {}
SQL: dict[str, str] = {}
col = F.col


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


query("s26_ingest_split", "SELECT CASE WHEN address IS NULL OR trim(address) = '' OR date_ms IS NULL OR date_ms <= 0 OR NOT coalesce(msg_type BETWEEN 1 AND 6, false) THEN 'error' WHEN date_ms < 1750000000000 THEN 'skipped' ELSE 'accepted' END AS outcome, count(*) AS n FROM ingest_sms GROUP BY 1")(lambda s, d: M.ingest_split(sms(s, d), 1_750_000_000_000).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))
query("s27_upload_id", "SELECT record_id, 'upload:' || substr(sha256(title || content), 1, 12) AS source_id FROM brain_documents WHERE title IS NOT NULL AND content IS NOT NULL")(lambda s, d: docs(s, d).filter("title IS NOT NULL AND content IS NOT NULL").select("record_id", S.upload_id(col("title"), F.encode("content", "utf-8")).alias("source_id")))
query("s35_point_lookup", "SELECT id, title FROM brain_documents WHERE record_id = (SELECT min(record_id) FROM brain_documents)")(lambda s, d: docs(s, d).join(F.broadcast(docs(s, d).agg(F.min("record_id").alias("record_id"))), "record_id").select("id", "title"))
query("l11_context", "WITH r AS (SELECT source_type AS query, record_id AS rank, substr(content, 1, 800) AS snippet FROM brain_documents WHERE content IS NOT NULL AND status = 'active') SELECT query, rank, snippet FROM (SELECT *, sum(strlen(snippet)) OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING) AS t FROM r) WHERE t <= 12000")(lambda s, d: N.context_block(docs(s, d).filter("content IS NOT NULL AND status = 'active'").select(col("source_type").alias("query"), col("record_id").alias("rank"), col("content").alias("text"))))
query("st9_embedded")(lambda s, d: N.embedded(docs(s, d).filter("embedding IS NULL AND content IS NOT NULL").select("id", col("content").alias("text")), N.hashing_embedder()))


@query("s06_html_pages")
def html_pages(s, d):
    """All documents as pages, markup, entities and line ends included; SQL cannot follow the parser there."""
    escaped = F.replace(F.replace(F.replace(col("content"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.array_join(F.transform(F.split(escaped, "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    page = F.encode(F.concat(F.lit("<html><style>p{}</style><body>"), lines, F.lit("<script>var a='<p>';</script></body></html>")), "utf-8")
    return docs(s, d).select("record_id", F.md5(F.replace(extracted(page, F.lit("page.html")), F.lit("\n"), F.lit("|"))).alias("h"))
