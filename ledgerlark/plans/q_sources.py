"""Queries of sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import files as A
from ..sources.files import new_dir as _new_dir
from ..streaming import jobs as K
from .registry import query


@query("""SELECT doc_id, octet_length(CAST(c AS BLOB)) AS length, CASE WHEN octet_length(CAST(c AS BLOB)) <= 104857600 THEN sha256(c) END AS sha256, CASE WHEN octet_length(CAST(c AS BLOB)) > 104857600 THEN 'pdf_too_large' WHEN doc_id % 4 = 0 THEN 'not_a_pdf' END AS reject_reason
    FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE '%PDF-' END || text AS c FROM {documents})""".replace("octet_length(CAST(c AS BLOB))", "strlen(c)"))
def document_manifest(t):
    content = F.concat(F.when(F.col("doc_id") % 4 == 0, "").otherwise("%PDF-"), "text").cast("binary")
    rows = t("documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content")).withColumn("length", F.octet_length("content"))
    return A.document_manifest(rows).select(F.col("path").cast("long").alias("doc_id"), "length", "sha256", "reject_reason")


def _parsed(t):
    """Parser envelopes written as JSON and read with the fixed schema."""
    docs = t("documents")
    i = F.col("doc_id")
    heading = F.array(F.struct(F.concat(F.lit("H"), i).alias("text"), (i % 3 + 1).cast("int").alias("level"), F.lit(1).alias("page_number")))
    table = F.array(F.struct(F.lit(1).alias("page_number"), F.array(F.array(F.lit("a"), i.cast("string"))).alias("rows"), F.lit("m").alias("markdown"), F.lit(None).cast("string").alias("caption")))
    page = lambda n, h, tb: F.struct(F.lit(n).alias("page_number"), F.col("text"), h.alias("headings"), tb.alias("tables"))
    rows = docs.select(i.cast("string").alias("document_id"), F.lit("e").alias("engine"), F.lit(5).alias("duration_ms"), F.lit(2).alias("page_count"), F.lit("md").alias("markdown"), F.array(page(1, heading, F.slice(table, 1, 0)), page(2, F.slice(heading, 1, 0), table)).alias("pages"))
    path = _new_dir(docs.sparkSession) + "/parsed"
    rows.write.json(path)
    return A.read_parsed_documents(docs.sparkSession, path)


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(p - 1 AS INT) AS pos, CAST(p AS INT) AS page_number, text FROM {documents} CROSS JOIN range(1, 3) r(p)")
def flatten_pages(t):
    return A.flatten_pages(_parsed(t))


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, 'H' || doc_id AS text, CAST(doc_id % 3 + 1 AS INT) AS level, CAST(1 AS INT) AS page_number FROM {documents}")
def flatten_headings(t):
    return A.flatten_headings(_parsed(t)).drop("page_pos", "pos")


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(1 AS INT) AS page_number, 'a;' || doc_id AS cells FROM {documents}")
def flatten_tables(t):
    return A.flatten_tables(_parsed(t)).select("document_id", "page_number", F.array_join(F.flatten("rows"), ";").alias("cells"))


def _written(t, write, *columns):
    """The chunks of lines, some without a vector, written twice as one batch, then the first three chunks of some documents as a second one; read back."""
    rows = t("lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_orderkey") % 10).alias("tenant_id"))
    vectors = rows.where("(document_id + chunk_index) % 11 <> 0").select("document_id", "chunk_index", F.array(F.lit(1.0), F.col("chunk_index").cast("double")).alias("embedding"))
    path = _new_dir(rows.sparkSession) + "/chunks"
    for batch, some in (("one", "true"), ("one", "true"), ("two", "document_id % 3 = 0 AND chunk_index <= 3")):
        write(rows.where(some), vectors.where(some), path, batch)
    return A.read_current(rows.sparkSession, path).select("document_id", "chunk_index", *columns)


_WRITTEN = """FROM (WITH r AS (SELECT DISTINCT l_orderkey AS d, l_linenumber AS i, (l_orderkey + l_linenumber) % 11 = 0 AS lost FROM {lineitem}), one AS (SELECT d, i FROM r WHERE d NOT IN (SELECT d FROM r WHERE lost)),
    s AS (SELECT * FROM r WHERE d % 3 = 0 AND i <= 3), two AS (SELECT d, i FROM s WHERE d NOT IN (SELECT d FROM s WHERE lost))
    SELECT d AS document_id, i AS chunk_index FROM two UNION ALL SELECT d, i FROM one WHERE d NOT IN (SELECT d FROM two))"""


@query(f"SELECT document_id, chunk_index {_WRITTEN}")
def write_chunks(t):
    return _written(t, A.write_chunks)


@query(f"SELECT document_id, chunk_index, CAST(chunk_index + 1 AS DOUBLE) AS total {_WRITTEN}")
def write_embeddings(t):
    return _written(t, A.write_embeddings, (F.col("embedding")[0] + F.col("embedding")[1]).alias("total"))


@query("""SELECT coalesce(s.slug, f.slug) AS slug, CASE WHEN s.slug IS NULL THEN f.name ELSE s.name END AS name, coalesce(f.kind, s.kind) AS kind FROM (SELECT slug, name, 'old' AS kind FROM {funders} WHERE funder_id < 15) f FULL JOIN (SELECT slug, 'New ' || name AS name, 'new' AS kind FROM {funders} WHERE funder_id > 10) s USING (slug)""")
def upsert_by_key(t):
    target = t("funders").where("funder_id < 15").select("slug", "name", F.lit("old").alias("kind"))
    source = t("funders").where("funder_id > 10").select("slug", F.concat(F.lit("New "), "name").alias("name"), F.lit("new").alias("kind"))
    return A.upsert_by_key(target, source, ["slug"], ["name"])


@query("""SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 7 = 0 THEN 'new' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 2 = 0 OR o_orderkey % 14 = 7 THEN CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'none' END END AS priority FROM {orders} WHERE o_orderkey % 2 = 0 OR o_orderkey % 7 = 0""")
def upsert_buckets(t):
    """Even orders in buckets; each seventh order comes in, or changes its status."""
    rows = t("orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    path = f"{_new_dir(rows.sparkSession)}/orders"
    A.write_buckets(rows.where("order_id % 2 = 0"), ["order_id"], path, 16)
    source = rows.where("order_id % 7 = 0").select("order_id", F.lit("new").alias("status"), F.lit("none").alias("priority"))
    A.upsert_buckets(rows.sparkSession, path, source, ["order_id"], ["status"], 16)
    return A.read_buckets(rows.sparkSession, path)


@query("""SELECT 'awards' AS name, count(*) AS n FROM {awards} WHERE tenant_id = 7 UNION ALL SELECT 'reports', count(*) FROM {reports} WHERE tenant_id = 7 UNION ALL SELECT 'audit_log', count(*) FROM {audit_log} WHERE tenant_id = 7
    UNION ALL SELECT 'funders_referenced', count(*) FROM {funders} WHERE funder_id IN (SELECT funder_id FROM {awards} WHERE tenant_id = 7)""")
def tenant_export(t):
    tables = {n: t(n) for n in ("awards", "reports", "audit_log", "funders")}
    spark = tables["awards"].sparkSession
    path = _new_dir(spark) + "/export"
    A.tenant_export(tables, 7, path)
    out = None
    for name in ("awards", "reports", "audit_log", "funders_referenced"):
        schema = tables[name.removesuffix("_referenced")].schema
        part = A.read_export(spark, path, name, schema).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def _import(t, strategy):
    rows = t("funders")
    exported = rows.where("funder_id > 10").select("funder_id", F.when(F.col("funder_id") % 2 == 0, F.concat(F.lit("X "), "name")).alias("name"), "slug")
    return A.tenant_import(exported, rows.where("funder_id < 15"), ["funder_id"], strategy)


@query("SELECT funder_id, CASE WHEN funder_id < 15 THEN name WHEN funder_id % 2 = 0 THEN 'X ' || name END AS name, slug FROM {funders}")
def tenant_import_skip(t):
    return _import(t, "skip")


@query("SELECT funder_id, CASE WHEN funder_id <= 10 THEN name WHEN funder_id % 2 = 0 THEN 'X ' || name END AS name, slug FROM {funders}")
def tenant_import_overwrite(t):
    return _import(t, "overwrite")


@query("SELECT funder_id, CASE WHEN funder_id <= 10 THEN name WHEN funder_id % 2 = 0 THEN 'X ' || name WHEN funder_id < 15 THEN name END AS name, slug FROM {funders}")
def tenant_import_merge(t):
    return _import(t, "merge")


def _staged(df, name):
    """A table as files in a folder, as many as Spark writes, and how many a micro-batch takes so that there are several."""
    spark, path = df.sparkSession, f"{_new_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return spark, path, max(1, len(spark.read.schema(df.schema).parquet(path).inputFiles()) // 3)


def _until_end(df, time):
    """``df`` with a far later row that moves the watermark past all windows."""
    return df.select(*[F.expr("TIMESTAMP '2100-01-01'").alias(c) if c == time else F.lit(None).cast(k).alias(c) for c, k in df.dtypes]).limit(1)


def _drain(df, time, make):
    """Drain a stream of ``df`` twice from one checkpoint: the rows, then the row that ends all windows."""
    spark, path, _ = _staged(df, "rows")
    base = _new_dir(spark)
    make_stream = lambda: make(K.read_stream(spark, path, df.schema))
    K.drain(make_stream(), f"{base}/out", f"{base}/check")
    _until_end(df, time).coalesce(1).write.mode("append").parquet(path)
    K.drain(make_stream(), f"{base}/out", f"{base}/check")
    return K.drain(make_stream(), f"{base}/out", f"{base}/check")


_CENTS = "CAST(floor((tokens_in * 3 + tokens_out * 15) / 10000) AS BIGINT)"


@query(f"""SELECT tenant_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, model, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum({_CENTS}) AS BIGINT) AS cents, count(*) AS n_calls FROM {{llm_calls}} GROUP BY ALL""")
def token_usage_stream(t):
    cents = F.floor((F.col("tokens_in") * 3 + F.col("tokens_out") * 15) / 10000).cast("long")
    rows = _drain(t("llm_calls").drop("call_id"), "ts", lambda s: K.token_usage_stream(s, cents)).where("tenant_id IS NOT NULL")
    return rows.withColumn("day", F.col("day").cast("string"))


@query("""WITH e AS (SELECT id, tenant_id % 20 AS tenant_id, CAST(created_at AS DATE) AS day, id % 11 <> 0 AND id % 4 <> 0 AS passed FROM {audit_log}), s AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, day ORDER BY id) AS nth FROM e),
    d AS (SELECT tenant_id, day, count(*) AS n, count_if(passed) AS good FROM s WHERE nth <= 5 GROUP BY 1, 2), r AS (SELECT tenant_id, day, n, sum(good) OVER w / sum(n) OVER w AS rate FROM d WINDOW w AS (PARTITION BY tenant_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW))
    SELECT tenant_id, CAST(day AS VARCHAR) AS day, n, round(rate, 9) AS pass_rate, rate < 0.9 AS alert FROM r""")
def drift_stream(t):
    evals = t("audit_log").select((F.col("tenant_id") % 20).alias("tenant_id"), F.col("created_at").alias("ts"), F.col("id").alias("draft_id"), ((F.col("id") % 11 != 0) & (F.col("id") % 4 != 0)).alias("passed"))
    rows = _drain(evals, "ts", K.drift_stream).where("tenant_id IS NOT NULL")
    return rows.withColumns({"day": F.col("day").cast("string"), "pass_rate": F.round("pass_rate", 9)})


@query("SELECT DISTINCT deadline_id, threshold, 'email' AS channel FROM (SELECT deadline_id, unnest(['30d', '14d']) AS threshold FROM {deadlines} WHERE due_at > TIMESTAMP '1998-06-15')")
def reminder_stream(t):
    hours = F.explode(F.array(*[F.expr(f"TIMESTAMP '1998-06-15 0{h}:00:00'") for h in range(3)]))
    rows = t("deadlines").where("due_at > TIMESTAMP '1998-06-15'").select("deadline_id", F.explode(F.array(F.lit("30d"), F.lit("14d"))).alias("threshold"), F.lit("email").alias("channel")).select("*", hours.alias("at"))
    spark, path, files = _staged(rows.repartition("at"), "rows")
    base = _new_dir(spark)
    return K.drain(K.reminder_stream(K.read_stream(spark, path, rows.schema, files)), f"{base}/out", f"{base}/check").drop("at")


@query("""SELECT doc_id AS document_id, CASE WHEN trim(text) = '' OR doc_id % 13 = 0 AND doc_id % 2 <> 0 THEN 'failed' ELSE 'indexed' END AS parse_status, CASE WHEN trim(text) = '' OR doc_id % 13 = 0 AND doc_id % 2 <> 0 THEN 'no_text' END AS parse_error,
    CASE WHEN doc_id % 13 = 0 AND doc_id % 2 = 0 THEN 2 ELSE 1 END AS n_queued FROM {documents}""")
def ingest_stream(t):
    """All documents, some without text; then the even ones of these again, by an event, with the text that they have by now, and ids that nobody knows."""
    rows = t("documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 10).alias("tenant_id"), F.when(F.col("doc_id") % 13 == 0, " \n").otherwise(F.col("text")).alias("text"), F.lit("upload").alias("event"))
    spark, path, files = _staged(rows, "queue")
    base, sizes = _new_dir(spark), {"target": 200, "overlap": 25, "backup": 50}
    stored = t("documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 10).alias("tenant_id"), "text")
    drain = lambda: K.ingest_stream(K.read_stream(spark, path, rows.schema, files), f"{base}/chunks", f"{base}/status", f"{base}/check", stored, **sizes).awaitTermination()
    drain()
    again = rows.where("document_id % 26 = 0").select("document_id", "tenant_id", F.lit(None).cast("string").alias("text"), F.lit("requeue").alias("event"))
    again.unionByName(again.withColumn("document_id", -1 - F.col("document_id"))).write.mode("append").parquet(path)
    drain()
    log = spark.read.parquet(f"{base}/status")
    queued = log.where("step = 0").groupBy("document_id").agg(F.count("*").cast("int").alias("n_queued"))
    return K.current_status(log).join(queued, "document_id")


@query("""SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 'queued' WHEN doc_id % 2 = 0 THEN 'failed' ELSE 'indexed' END AS parse_status,
    CASE WHEN doc_id % 2 = 0 AND (doc_id % 3 <> 0 OR doc_id % 5 = 0) THEN 'no_text' END AS parse_error FROM {documents}""")
def requeue_documents(t):
    i = F.col("document_id")
    docs = t("documents").select(F.col("doc_id").alias("document_id"))
    failed = i % 2 == 0
    status = docs.withColumns({"parse_status": F.when(failed, "failed").otherwise("indexed"), "parse_error": F.when(failed, "no_text"), "deleted_at": F.when(i % 5 == 0, F.lit("1998-06-15"))})
    return K.requeue(status, docs.where(i % 3 == 0)).drop("deleted_at")
