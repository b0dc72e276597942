"""Sources and sinks: raw files, parser output, chunks with vectors, snapshots, exports."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

MAX_BYTES = 100 * 1024 * 1024
FEW_ROWS, TASK_ROWS, MOST_ROWS, DIRECT = 20_000, 500_000, 1_500_000, 200
EXPORT_TABLES = ("tenants", "users", "awards", "reports", "report_fields", "audit_log")
_HEADING = "struct<text:string,level:int,page_number:int>"
_TABLE = "struct<page_number:int,rows:array<array<string>>,markdown:string,caption:string>"
PARSED = f"document_id string, engine string, duration_ms long, page_count int, markdown string, pages array<struct<page_number:int,text:string,headings:array<{_HEADING}>,tables:array<{_TABLE}>>>"


def new_dir(spark: SparkSession) -> str:
    """A folder in the shared one; a temporary folder where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{base.rstrip('/')}/jobs-{uuid.uuid4().hex}" if base else tempfile.mkdtemp()


def filesystem(uri: str):
    """The pyarrow file system and path of ``uri``, usable in driver and tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def read_raw_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def document_manifest(files: DataFrame, max_bytes: int = MAX_BYTES, magic: bytes = b"%PDF-") -> DataFrame:
    """(path, length, sha256, reject_reason) of binary files; the content of too large ones isn't hashed."""
    large = F.col("length") > max_bytes
    other = F.coalesce(F.substring("content", 1, len(magic)) != F.lit(bytearray(magic)), F.lit(True))
    reason = F.when(large, "pdf_too_large").when(other, "not_a_pdf")
    return files.select("path", "length", F.when(~large, F.sha2("content", 256)).alias("sha256"), reason.alias("reject_reason"))


def read_parsed_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARSED).json(path)


def flatten_pages(parsed: DataFrame) -> DataFrame:
    return parsed.select("document_id", F.posexplode("pages").alias("pos", "p")).select("document_id", "pos", "p.page_number", "p.text")


def flatten_headings(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("document_id", F.posexplode("pages").alias("page_pos", "p")).select("document_id", "page_pos", F.posexplode("p.headings").alias("pos", "h"))
    return rows.select("document_id", "page_pos", "pos", "h.text", "h.level", "h.page_number")


def flatten_tables(parsed: DataFrame) -> DataFrame:
    rows = parsed.select("document_id", F.posexplode("pages").alias("page_pos", "p")).select("document_id", "page_pos", F.posexplode("p.tables").alias("pos", "t"))
    return rows.select("document_id", "page_pos", "pos", "t.page_number", "t.rows", "t.markdown", "t.caption")


def task_count(spark: SparkSession, rows: int) -> int:
    """Tasks to deal ``rows`` to: the session's while each gets ``FEW_ROWS``, and more once one would get over ``TASK_ROWS``.

    Short rows shrink to a few bytes in a shuffle, so partitions put together by their shuffled bytes hold millions of them.
    Up to ``DIRECT`` partitions (spark.shuffle.sort.bypassMergeThreshold) the tasks before a shuffle hold no rows; so there are
    more only once one would get over ``MOST_ROWS``."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few, some, most = (-(-rows // each) for each in (FEW_ROWS, TASK_ROWS, MOST_ROWS))
    return max(1, min(own, few), min(DIRECT, some), most)


def embedded_chunks(chunks: DataFrame, vectors: DataFrame, n_rows: int | None = None) -> DataFrame:
    """Chunks with their vectors, of documents all of whose chunks have one; of a repeated chunk any one counts.

    Chunks and vectors meet in one shuffle by document, dealt out by the number of chunks, which are counted unless
    ``n_rows`` tells it."""
    key, spark = ["document_id", "chunk_index"], chunks.sparkSession
    n = task_count(spark, chunks.count() if n_rows is None else n_rows)
    others = [[x for x in side.columns if x not in key] for side in (chunks, vectors)]
    # a chunk keeps its own ids, whatever type it shares with its vector
    c = chunks.select(*key, F.struct(*key, *others[0]).alias("c"))
    v = vectors.where("document_id IS NOT NULL AND chunk_index IS NOT NULL").select(*key, F.struct(F.lit(True).alias("has_vector"), *others[1]).alias("v"))
    both = c.unionByName(v, allowMissingColumns=True).repartition(n, "document_id")
    rows = both.groupBy(*key).agg(F.first("c", True).alias("c"), F.first("v", True).alias("v")).where("c IS NOT NULL")
    whole = F.count_if(F.col("v").isNull()).over(Window.partitionBy("document_id"))
    return rows.withColumn("lacking", whole).where("lacking = 0").select("c.*", "v.*").drop("has_vector")


_LOG = "version long, nth long, batch string, attempt string"


def _log(spark: SparkSession, path: str) -> DataFrame:
    """The commits of ``path``, one row each."""
    try:
        return spark.read.schema(_LOG).json(f"{path}/log")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LOG)


def version_of(spark: SparkSession, path: str, batch: str) -> int:
    """The version that ``batch`` has, or the next one."""
    row = _log(spark, path).agg(F.max("version").alias("last"), F.max(F.when(F.col("batch") == batch, F.col("version"))).alias("own")).first()
    return row.own if row.own is not None else (row.last or 0) + 1


def commit_documents(rows: DataFrame, path: str, batch: str) -> None:
    """Make ``rows`` (with document_id) the newest version of their documents.

    Rows go to a folder of the attempt's own, then a pointer for each document, then one line of the
    log, written as one file, which makes all of them visible at once.  What was killed before has no
    line and is never read.  A batch that is written again keeps its version and replaces its earlier
    attempt; a later batch replaces the documents that it holds.  One writer at a time; ids of any type."""
    spark, attempt = rows.sparkSession, f"a{uuid.uuid4().hex}"
    # with a letter ahead, a folder's name is read as text whatever the id
    tenant = {"tenant": F.concat(F.lit("t"), F.col("tenant_id").cast("string"))} if "tenant_id" in rows.columns else {}
    rows.withColumns(tenant).write.partitionBy(*tenant).parquet(f"{path}/data/attempt={attempt}")
    held = spark.read.schema(rows.schema).parquet(f"{path}/data/attempt={attempt}")
    n = task_count(spark, held.count())
    held.select("document_id").repartition(n, "document_id").groupBy("document_id").agg(F.count("*").alias("n_rows")).write.parquet(f"{path}/documents/attempt={attempt}")
    line = [(version_of(spark, path, batch), _log(spark, path).count() + 1, batch, attempt)]
    spark.createDataFrame(line, _LOG).coalesce(1).write.mode("append").json(f"{path}/log")


def read_batch(spark: SparkSession, path: str, batch: str) -> DataFrame:
    """(document_id, n_rows) of the documents that ``batch`` committed."""
    last = _log(spark, path).where(F.col("batch") == batch).agg(F.max_by("attempt", "nth").alias("attempt"))
    return spark.read.parquet(f"{path}/documents").join(last, "attempt", "left_semi").drop("attempt")


def read_current(spark: SparkSession, path: str, tenant_id=None) -> DataFrame:
    """The rows of the newest committed version of each document; of one tenant, only its folders are read."""
    good = _log(spark, path).groupBy("batch").agg(F.max_by(F.struct("version", "attempt"), "nth").alias("c")).select("c.*")
    pointers = spark.read.parquet(f"{path}/documents").join(good, "attempt")
    rows = spark.read.parquet(f"{path}/data")
    if tenant_id is not None:
        rows = rows.where(F.col("tenant") == f"t{tenant_id}")
    n = task_count(spark, rows.count() + spark.read.parquet(f"{path}/documents").count())
    newest = pointers.repartition(n, "document_id").groupBy("document_id").agg(F.max_by("attempt", "version").alias("attempt"))
    both = [side.repartition(n, "document_id", "attempt") for side in (rows, newest)]
    return both[0].join(both[1], ["document_id", "attempt"]).select(*[c for c in rows.columns if c not in ("attempt", "tenant")])


def write_chunks(chunks: DataFrame, vectors: DataFrame, path: str, batch: str) -> None:
    """Commit the embedded chunks; ``read_current`` gives each document's last ones, so (document_id, chunk_index) is unique whatever the batches."""
    commit_documents(embedded_chunks(chunks, vectors), path, batch)


def write_embeddings(chunks: DataFrame, vectors: DataFrame, path: str, batch: str) -> None:
    """The same for (document_id, chunk_index, embedding) of the documents all of whose chunks have a vector."""
    commit_documents(embedded_chunks(chunks.select("document_id", "chunk_index"), vectors).select("document_id", "chunk_index", "embedding"), path, batch)


def upsert_by_key(target: DataFrame, source: DataFrame, keys: list[str], set_cols: list[str]) -> DataFrame:
    """A snapshot of ``target`` after ``source``: new keys come in whole, known ones change in ``set_cols`` only."""
    s = source.select(*keys, *[F.col(c).alias(f"s_{c}") for c in source.columns if c not in keys], F.lit(True).alias("s_here"))
    both = target.withColumn("t_here", F.lit(True)).join(s, keys, "full_outer")
    fresh = F.col("t_here").isNull()

    def value(c: str):
        if c not in source.columns:
            return F.col(c)
        if c in set_cols:
            return F.when(F.col("s_here"), F.col(f"s_{c}")).otherwise(F.col(c)).alias(c)
        return F.when(fresh, F.col(f"s_{c}")).otherwise(F.col(c)).alias(c)

    return both.select(*[F.col(c) if c in keys else value(c) for c in target.columns])


def bucket_of(keys: list[str], buckets: int):
    """The bucket of a row by its keys, as text, so that ids of any type have one."""
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, keys: list[str], path: str, buckets: int) -> None:
    """A snapshot of ``df`` in ``buckets`` folders by the hash of its keys."""
    df.withColumn("bucket", bucket_of(keys, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def upsert_buckets(spark: SparkSession, path: str, source: DataFrame, keys: list[str], set_cols: list[str], buckets: int) -> int:
    """``upsert_by_key`` into a snapshot of ``write_buckets``: only the buckets that hold keys of ``source`` are read and written; returns their number.

    Their numbers go through the driver, ``buckets`` at most.  New rows are all written before they take the place of
    the old folders, so a failed job leaves the snapshot as it was."""
    placed = source.withColumn("bucket", bucket_of(keys, buckets))
    touched = [r.bucket for r in placed.select("bucket").distinct().collect()]
    target = spark.read.parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
    merged = upsert_by_key(target, source, keys, set_cols).withColumn("bucket", bucket_of(keys, buckets))
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return len(touched)


def tenant_rows(tables: dict[str, DataFrame], tenant_id) -> dict[str, DataFrame]:
    """A tenant's rows of each table, and ``funders_referenced``: the funders of its awards."""
    out = {name: df.where(F.col("tenant_id") == F.lit(tenant_id)) for name, df in tables.items() if name in EXPORT_TABLES}
    if "funders" in tables and "awards" in tables:
        out["funders_referenced"] = tables["funders"].join(out["awards"].select("funder_id"), "funder_id", "left_semi")
    return out


def tenant_export(tables: dict[str, DataFrame], tenant_id, path: str) -> None:
    """CSV per table, chunks as JSON per document, and a manifest."""
    for name, df in tenant_rows(tables, tenant_id).items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    if "chunks" in tables:
        tables["chunks"].where(F.col("tenant_id") == F.lit(tenant_id)).write.mode("overwrite").partitionBy("document_id").json(f"{path}/chunks")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(1, str(tenant_id))], "schema_version int, tenant_id string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_export(spark: SparkSession, path: str, name: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(f"{path}/{name}")


def tenant_import(exported: DataFrame, target: DataFrame, keys: list[str], strategy: str) -> DataFrame:
    """``target`` with the exported rows: ``overwrite`` and ``merge`` change known keys (merge only where the export has a value), ``skip`` leaves them."""
    rows = exported.select(*target.columns)
    if strategy == "skip":
        return target.unionByName(rows.join(target.select(*keys), keys, "left_anti"))
    if strategy == "overwrite":
        return target.join(rows.select(*keys), keys, "left_anti").select(*target.columns).unionByName(rows)
    if strategy == "merge":
        s = rows.select(*keys, *[F.col(c).alias(f"s_{c}") for c in target.columns if c not in keys])
        both = target.join(s, keys, "full_outer")
        return both.select(*[F.col(c) if c in keys else F.coalesce(f"s_{c}", c).alias(c) for c in target.columns])
    raise ValueError(f"unknown strategy {strategy}")
