"""Queries of retrieval, over brain_documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpmill.functions import text as X
from kelpmill.operators import retrieval as R
from kelpmill.session import table

TEXT, LIMIT = "the parcel", 20
NOW = datetime(2025, 7, 1)
BEGIN, END = datetime(2025, 6, 5), datetime(2025, 6, 25)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "brain_documents")


def vector(spark: SparkSession, d: str) -> list[float] | None:
    """The query vector: the first usable embedding, one row."""
    row = docs(spark, d).filter(X.usable_vector(F.col("embedding"), 64)).orderBy("record_id").select("embedding").first()
    return [float(x) for x in row[0]] if row else None


def query(spark: SparkSession, d: str, **kw) -> R.SearchQuery:
    return R.SearchQuery(TEXT, kw.pop("vector", vector(spark, d)), LIMIT, **kw)


def mentions(spark: SparkSession, d: str) -> DataFrame:
    """Entities: people and systems named in the metadata (from, to and language)."""
    m = docs(spark, d).filter("metadata IS NOT NULL")
    pick = lambda key, kind: m.select("id", F.lit(kind).alias("type"), X.normalized_name(X.json_text(F.col("metadata"), key)).alias("name"))
    return pick("from", "PERSON").unionByName(pick("to", "PERSON")).unionByName(pick("language", "OTHER")).filter("name <> ''").distinct()


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of the active documents."""
    rows = docs(spark, d).filter("status = 'active' AND content IS NOT NULL")
    return rows.select("id", F.posexplode(F.split("content", "\n\n")).alias("chunk_index", "chunk")).filter("chunk <> ''")


def r01(s, d):
    return R.fulltext(docs(s, d), query(s, d, vector=None))


def lane(name, of):
    def run(s, d):
        q = query(s, d)
        return R.ranked(of(R.filtered(docs(s, d), q), q), name, 2 * LIMIT).select("id", "rank", "score")

    return run


def r06(s, d):
    q = R.SearchQuery("garquist", None, LIMIT)
    return R.ranked(R.entity_candidates(R.filtered(docs(s, d), q), mentions(s, d), q), "entity", 2 * LIMIT).select("id", "rank", "score")


def r07(s, d):
    q = query(s, d)
    return R.fused(R.lanes(docs(s, d), q), q.weights)


def j01(s, d):
    q = query(s, d)
    return R.fused_by_joins(R.lanes(docs(s, d), q), q.weights)


def r08(s, d):
    return R.hybrid_search(docs(s, d), query(s, d), NOW).select("id", "source_type", "title", "score")


def r15(s, d):
    return R.hybrid_search(docs(s, d), query(s, d, sort="recent", begin=BEGIN, end=END, exclude=("sms",)), NOW).select("id", "occurred_at", "score")


def r12(s, d):
    q = query(s, d, vector=None)
    return R.chunk_best(R.chunk_fts(chunks(s, d), q), LIMIT)


def r13(s, d):
    q = query(s, d)
    rows = R.filtered(docs(s, d), q)
    return R.merged(R.ranked(R.fts_candidates(rows, q), "fts", 15), R.ranked(R.vec_candidates(rows, q), "vec", 30), LIMIT)


def r18(s, d):
    return R.with_entities(R.hybrid_search(docs(s, d), query(s, d), NOW).select("id", "score"), mentions(s, d))


def r17(s, d):
    return R.reranked(R.hybrid_search(docs(s, d), query(s, d), NOW).select("id", "score"), None).select("id", "rerank")


def p04(s, d):
    q = R.SearchQuery(TEXT, source_type="gmail", source_types=("slack", "gmail", "insight"), exclude=("slack",))
    return R.filtered(docs(s, d), q).groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


def p05(s, d):
    return R.filtered(docs(s, d), R.SearchQuery(TEXT, begin=BEGIN, end=END)).select("id")


def p07(s, d):
    rows = docs(s, d)
    return rows.filter(R.like(rows, "p_rcel%Friday")).select("record_id")


def p09(s, d):
    """Candidates verified against a window by a semi join."""
    q = query(s, d)
    hits = R.ranked(R.fts_candidates(R.filtered(docs(s, d), q), q), "fts", 40)
    return hits.join(R.filtered(docs(s, d), R.SearchQuery(TEXT, begin=BEGIN, end=END)).select("id"), "id", "left_semi").select("id", "rank")


WORD_LIST = "regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+')"
TOK = "SELECT *, " + WORD_LIST.format("title") + " AS t, " + WORD_LIST.format("content") + " AS c FROM base"
BASE = "base AS (SELECT * FROM brain_documents WHERE status = 'active' AND source_type <> 'insight')"
TF = "(1.0 * ln(1 + len(list_filter(t, lambda x: x = '{0}'))) + 0.4 * ln(1 + len(list_filter(c, lambda x: x = '{0}'))))"
SCORE = "round(" + " + ".join(TF.format(w) for w in ("the", "parcel")) + ", 6)"
ALL = " AND ".join(f"(list_contains(t, '{w}') OR list_contains(c, '{w}'))" for w in ("the", "parcel"))
USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
QV = f"qv AS (SELECT embedding::DOUBLE[] AS q FROM brain_documents WHERE {USABLE} ORDER BY record_id LIMIT 1)"
COS = "round(list_dot_product(embedding::DOUBLE[], q) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(q, q))), 6)"
GRAMS = "list_distinct(list_transform(range(1, length(' ' || coalesce({0}, '') || ' ')), lambda i: substr(' ' || coalesce({0}, '') || ' ', i, 2)))"
MINE = "list_distinct(list_transform(range(1, 12), lambda i: substr(' the parcel ', i, 2)))"
SIM = f"round(len(list_intersect({GRAMS}, {MINE})) / greatest(len({GRAMS}), len({MINE})), 6)"
LIKE = "(coalesce(content LIKE '%the parcel%', false) OR coalesce(title LIKE '%the parcel%', false))"
FTS = f"fts AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, {SCORE} AS score FROM ({TOK}) WHERE {ALL}) QUALIFY rank <= 40)"
VEC = f"vec AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, {COS} AS score FROM base, qv WHERE {USABLE}) QUALIFY rank <= 40)"
BIGM = f"bigm AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, greatest({SIM.format('content')}, {SIM.format('title')}) AS score FROM base WHERE {LIKE}) QUALIFY rank <= 40)"
RRF = "rrf AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT id, rank FROM fts UNION ALL SELECT id, rank FROM vec UNION ALL SELECT id, rank FROM bigm) GROUP BY id)"
WITH = f"WITH {BASE}, {QV}, {FTS}, {VEC}, {BIGM}, {RRF} "
RECENT_BASE = BASE.replace("<> 'insight'", "NOT IN ('sms', 'insight') AND occurred_at >= TIMESTAMP '2025-06-05' AND occurred_at < TIMESTAMP '2025-06-25'")
CHUNKS = "chunks AS (SELECT id, unnest(range(len(p))) AS chunk_index, unnest(p) AS chunk FROM (SELECT id, string_split(content, chr(10) || chr(10)) AS p FROM brain_documents WHERE status = 'active' AND content IS NOT NULL))"
BEST = "SELECT id, chunk_index, score FROM (SELECT * FROM (SELECT * FROM scored ORDER BY score DESC, id, chunk_index LIMIT 60) QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, chunk_index) = 1) ORDER BY score DESC, id LIMIT 20"
CTF = TF.replace("1.0 * ln(1 + len(list_filter(t, lambda x: x = '{0}'))) + ", "")
MENTIONS = "mentions AS (SELECT DISTINCT id, type, name FROM (" + " UNION ALL ".join(f"SELECT id, '{k}' AS type, lower(trim(metadata->>'$.{p}')) AS name FROM brain_documents WHERE metadata IS NOT NULL" for p, k in (("from", "PERSON"), ("to", "PERSON"), ("language", "OTHER"))) + ") WHERE name <> '')"

QUERIES = {
    "r01_fulltext": r01, "r02_fts_lane": lane("fts", R.fts_candidates), "r03_vec_lane": lane("vec", R.vec_candidates), "r04_bigm_lane": lane("bigm", R.bigm_candidates),
    "r06_entity_lane": r06, "r07_rrf_union": r07, "j01_rrf_full_outer": j01, "r08_hybrid_search": r08, "r12_chunk_fts": r12, "r13_merge_rrf": r13,
    "r15_recency_sort": r15, "r17_linear_rerank": r17, "r18_entity_attach": r18, "p04_includes": p04, "p05_window": p05, "p07_like": p07, "p09_semi_window": p09,
}
SQL = {
    "r01_fulltext": f"WITH {BASE} SELECT id, source_type, {SCORE} AS score FROM ({TOK}) WHERE ({ALL}) OR {LIKE} ORDER BY score DESC, id LIMIT 20",
    "r02_fts_lane": f"WITH {BASE}, {FTS} SELECT id, rank, score FROM fts",
    "r03_vec_lane": f"WITH {BASE}, {QV}, {VEC} SELECT id, rank, score FROM vec",
    "r04_bigm_lane": f"WITH {BASE}, {BIGM} SELECT id, rank, score FROM bigm",
    "r06_entity_lane": f"WITH {BASE}, {MENTIONS} SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, score FROM (SELECT id, count(*)::DOUBLE AS score FROM mentions JOIN base USING (id) WHERE name LIKE '%garquist%' GROUP BY id) QUALIFY rank <= 40",
    "r07_rrf_union": WITH + "SELECT id, score FROM rrf",
    "j01_rrf_full_outer": WITH + "SELECT id, score FROM rrf",
    "r08_hybrid_search": WITH + "SELECT id, source_type, title, score FROM (SELECT * FROM rrf ORDER BY score DESC, id LIMIT 40) JOIN brain_documents USING (id) ORDER BY score DESC, id LIMIT 20",
    "r12_chunk_fts": f"WITH {CHUNKS}, c AS (SELECT id, chunk_index, chunk, {WORD_LIST.format('chunk')} AS c FROM chunks WHERE chunk <> ''), scored AS (SELECT id, chunk_index, greatest(CASE WHEN list_contains(c, 'the') AND list_contains(c, 'parcel') THEN round({' + '.join(CTF.format(w) for w in ('the', 'parcel'))}, 6) ELSE 0 END, CASE WHEN chunk LIKE '%the parcel%' THEN 0.01 ELSE 0 END)::DOUBLE AS score FROM c WHERE (list_contains(c, 'the') AND list_contains(c, 'parcel')) OR chunk LIKE '%the parcel%') {BEST}",
    "r13_merge_rrf": f"""WITH {BASE}, {QV}, {FTS}, {VEC}, p AS (SELECT id, rank AS p FROM fts WHERE rank <= 15), s AS (SELECT id, rank AS s FROM vec WHERE rank <= 30),
        b AS (SELECT coalesce(p.id, s.id) AS id, p, s, row_number() OVER (PARTITION BY p IS NULL ORDER BY s NULLS LAST, coalesce(p.id, s.id)) AS place FROM p FULL JOIN s ON p.id = s.id)
        SELECT id, round(coalesce(1.0::DOUBLE / (60 + p), 0) + coalesce(1.0::DOUBLE / (60 + s), 0), 9) AS score, CASE WHEN p IS NOT NULL AND s IS NOT NULL THEN 'hybrid+chunk' WHEN p IS NOT NULL THEN 'hybrid' ELSE 'chunk-vector' END AS match_type
        FROM b WHERE p IS NOT NULL OR place <= 20 - (SELECT count(*) FROM p) ORDER BY score DESC, id LIMIT 20""",
    "r15_recency_sort": f"WITH {RECENT_BASE}, {QV}, {FTS}, {VEC}, {BIGM}, {RRF} SELECT id, occurred_at, score FROM (SELECT * FROM rrf ORDER BY score DESC, id LIMIT 40) JOIN brain_documents USING (id) ORDER BY coalesce(occurred_at, collected_at) DESC NULLS LAST, score DESC, id LIMIT 20",
    "r17_linear_rerank": WITH + ", top AS (SELECT * FROM rrf ORDER BY score DESC, id LIMIT 20) SELECT id, round((count(*) OVER () - row_number() OVER (ORDER BY score DESC, id) + 1)::DOUBLE / count(*) OVER (), 6) AS rerank FROM top",
    "r18_entity_attach": WITH + f", {MENTIONS}, top AS (SELECT * FROM rrf ORDER BY score DESC, id LIMIT 20) SELECT id, any_value(score) AS score, coalesce(string_agg(type || ':' || name, ',' ORDER BY type, name), '') AS entities FROM top LEFT JOIN mentions USING (id) GROUP BY id",
    "p04_includes": "SELECT source_type, count(*) AS n FROM brain_documents WHERE status = 'active' AND source_type IN ('gmail', 'insight') GROUP BY source_type",
    "p05_window": f"WITH {RECENT_BASE.replace(chr(39) + 'sms' + chr(39) + ', ', '')} SELECT id FROM base",
    "p07_like": "SELECT record_id FROM brain_documents WHERE content LIKE '%p_rcel%Friday%' OR title LIKE '%p_rcel%Friday%'",
    "p09_semi_window": f"WITH {BASE}, {FTS} SELECT fts.id, rank FROM fts JOIN base USING (id) WHERE occurred_at >= TIMESTAMP '2025-06-05' AND occurred_at < TIMESTAMP '2025-06-25'",
}
