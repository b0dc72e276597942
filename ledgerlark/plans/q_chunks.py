"""Queries of the chunking operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as C
from .registry import query


def _docs(t):
    return t("documents").select(F.col("doc_id").alias("document_id"), "text")


@query()
def chunk_documents(t):
    return C.chunk_documents(_docs(t), target=200, overlap=25, backup=50)


@query()
def embed_chunks(t):
    rows = C.embed_chunks(C.chunk_documents(_docs(t), target=200, overlap=25, backup=50))
    return rows.select("document_id", "chunk_index", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm"))


def _fixed(t):
    """Windows of 500 characters as chunks."""
    rows = t("documents").select(F.col("doc_id").alias("document_id"), "n_chars", F.explode(F.expr("sequence(0, CAST((n_chars - 1) div 500 AS INT))")).alias("chunk_index"))
    return rows.select("document_id", "chunk_index", (F.col("chunk_index") * 500).alias("char_start"), F.least(F.col("n_chars"), (F.col("chunk_index") + 1) * 500).cast("int").alias("char_end"))


_FIXED = "fx AS (SELECT doc_id AS document_id, CAST(k AS INT) AS chunk_index, CAST(k * 500 AS INT) AS char_start, CAST(least(n_chars, (k + 1) * 500) AS INT) AS char_end FROM (SELECT doc_id, n_chars, unnest(range(0, (n_chars - 1) // 500 + 1)) AS k FROM {documents}))"


@query(f"""WITH {_FIXED} SELECT document_id, chunk_index, CASE WHEN char_start < 100 THEN NULL WHEN char_start < 700 THEN '# A' WHEN char_start < 1200 THEN '# A > ## B' WHEN char_start < 2100 THEN '# A > ### C' WHEN char_start < 3300 THEN '# A > ## D > #### E' ELSE '# F' END AS section_heading FROM fx""".replace("'# A > ### C'", "'# A > ## B > ### C'"))
def heading_path(t):
    marks = [(100, 1, "A"), (700, 2, "B"), (1200, 3, "C"), (2100, 2, "D"), (2101, 4, "E"), (3300, 1, "F")]
    rows = F.array(*[F.struct(F.lit(o).alias("offset"), F.lit(d).alias("depth"), F.lit(x).alias("text")) for o, d, x in marks])
    headings = t("documents").select(F.col("doc_id").alias("document_id"), F.explode(rows).alias("h")).select("document_id", "h.*")
    return C.heading_path(_fixed(t), headings).select("document_id", "chunk_index", "section_heading")


def _pages(t):
    """Pages of documents in three states: with offsets, without, and none."""
    i = F.col("document_id")
    docs = t("documents").select(F.col("doc_id").alias("document_id"), F.col("n_chars").alias("doc_len"))
    rows = docs.where(i % 3 < 2).select("document_id", "doc_len", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page_number"))
    start = (F.col("page_number") - 1) * 400
    end = F.when(F.col("page_number") == 3, start).otherwise(F.col("page_number") * 400)
    rows = rows.select("document_id", "page_number", F.when(i % 3 == 0, start).cast("int").alias("start"), F.when(i % 3 == 0, end).cast("int").alias("end"))
    return C.normalize_pages(rows, docs)


_PAGES = """pg AS (SELECT doc_id AS document_id, CAST(p AS INT) AS page_number, CAST(CASE WHEN doc_id % 3 = 0 THEN (p - 1) * 400 ELSE (p - 1) * (n_chars // 3) END AS INT) AS s, CAST(CASE WHEN doc_id % 3 = 0 THEN CASE WHEN p = 3 THEN greatest(n_chars, 800) ELSE p * 400 END WHEN p = 3 THEN n_chars ELSE p * (n_chars // 3) END AS INT) AS e FROM {documents} CROSS JOIN range(1, 4) r(p) WHERE doc_id % 3 < 2
    UNION ALL SELECT doc_id, 1, 0, CAST(n_chars AS INT) FROM {documents} WHERE doc_id % 3 = 2)"""


@query(f'WITH {_PAGES} SELECT document_id, page_number, s AS start, e AS "end" FROM pg')
def normalize_pages(t):
    return _pages(t)


@query(f"""WITH {_PAGES}, {_FIXED} SELECT document_id, chunk_index, coalesce(min(page_number) FILTER (s <= char_start AND char_start < e), min(page_number)) AS page_start,
    coalesce(max(page_number) FILTER (s < char_end AND char_end <= e OR s <= char_end - 1 AND char_end - 1 < e), max(page_number)) AS page_end FROM fx JOIN pg USING (document_id) GROUP BY 1, 2""")
def map_pages(t):
    return C.map_pages(_fixed(t), _pages(t)).select("document_id", "chunk_index", "page_start", "page_end")


@query("""SELECT l_orderkey AS document_id, string_agg('p' || c, chr(10) || chr(10) ORDER BY l_linenumber) AS text FROM (SELECT l_orderkey, l_linenumber, count(*) AS c FROM {lineitem} GROUP BY ALL) WHERE l_linenumber <> 2 GROUP BY 1""")
def document_text(t):
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index")).agg(F.count("*").alias("c"))
    return C.document_text(rows.select("document_id", "chunk_index", F.when(F.col("chunk_index") == 2, "").otherwise(F.concat(F.lit("p"), "c")).alias("content")))


@query("""SELECT o_orderkey AS document_id, CAST(o_orderdate AS VARCHAR)[:10] AS created_at, coalesce(n, 0) AS n_chunks FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM {orders} WHERE o_orderkey % 10 <> 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 200 OFFSET 40)
    LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} GROUP BY 1) ON l_orderkey = o_orderkey""")
def document_listing(t):
    docs = t("orders").select(F.col("o_orderkey").alias("document_id"), F.to_date("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 10 == 0, F.lit("x")).alias("deleted_at"))
    rows = C.document_listing(docs, t("lineitem").select(F.col("l_orderkey").alias("document_id")), limit=500, offset=40)
    return rows.withColumn("created_at", F.col("created_at").cast("string"))
