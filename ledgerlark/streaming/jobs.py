"""Streams over files: ingest, usage, drift and reminders.  Each equals its batch job once drained."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState

from ..operators.chunking import chunk_documents, embed_chunks
from ..sources.files import commit_documents, embedded_chunks, new_dir, read_batch, version_of


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).load(path)


def ingest_stream(queue: DataFrame, chunk_path: str, status_path: str, checkpoint: str, documents: DataFrame | None = None, **sizes):
    """Chunk, embed and commit queued documents (document_id, tenant_id, text, and maybe ``event``).

    An event is ``upload`` (as is null) or ``requeue``.  A re-queued document is done again, with its text in ``documents``
    (document_id, tenant_id, text) where the event has none; one that was never uploaded is left out.  Of several
    events of a document in a micro-batch, an upload counts, else a re-queue.

    ``status_path`` gets a row per document and step: 0 ``queued`` and 1 ``parsing``, 2 ``parsed`` where there is text, then 3 ``indexed``, or
    ``failed`` with ``parse_error``; a step is only taken from the one before it.  Chunks are read by ``read_current``: a document that is
    indexed again replaces its old chunks, one that fails keeps them.  Micro-batches are named by the query's id, which
    belongs to its checkpoint, so a new checkpoint adds to what is there and a repeated micro-batch replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        name = f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId')}-{number}"
        version = version_of(spark, chunk_path, name)
        event = F.coalesce("event", F.lit("upload")) if "event" in batch.columns else F.lit("upload")
        one = F.min_by(F.struct("tenant_id", "text", "event"), F.struct(F.col("event") != "upload", F.col("text").isNull(), F.xxhash64("text"))).alias("d")
        has_text = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)).alias("has_text")
        events = _kept(batch.withColumn("event", event).where("event IN ('upload', 'requeue')").groupBy("document_id").agg(one).select("document_id", "d.*"))
        docs = events.where("event = 'upload'").select("document_id", "tenant_id", "text", has_text)
        if events.where("event = 'requeue'").head(1):
            again = _kept(events.where("event = 'requeue'").join(_before(spark, status_path, version, events.schema["document_id"].dataType), "document_id", "left_semi"))
            if documents is not None:
                # only the texts of documents that are done again are taken along
                stored = documents.select("document_id", F.col("tenant_id").alias("s_tenant"), F.col("text").alias("s_text")).join(again.select("document_id"), "document_id")
                again = again.join(stored, "document_id", "left").select("document_id", F.coalesce("tenant_id", "s_tenant").alias("tenant_id"), F.coalesce("text", "s_text").alias("text"))
            docs = docs.unionByName(_kept(again.select("document_id", "tenant_id", "text", has_text)))

        def advance(rows: DataFrame, step: int, status, error=None) -> None:
            # a repeated micro-batch replaces its own folders
            error = F.lit(None).cast("string") if error is None else error
            rows.select("document_id", F.lit(status).alias("parse_status") if isinstance(status, str) else status.alias("parse_status"), error.alias("parse_error")).write.mode("overwrite").parquet(f"{status_path}/version={version}/step={step}")

        def reached(step: int) -> DataFrame:
            return spark.read.schema(docs.select("document_id").schema).parquet(f"{status_path}/version={version}/step={step}")

        # steps are of ids, texts stay where they are
        ids = docs.select("document_id", "has_text")
        advance(ids, 0, "queued")
        advance(ids.join(reached(0), "document_id", "left_semi"), 1, "parsing")
        parsing = ids.join(reached(1), "document_id", "left_semi")
        advance(parsing.where("has_text"), 2, "parsed")
        texts = docs.where("has_text")
        chunks = chunk_documents(texts, keep=("tenant_id",), **sizes)
        # each 100 characters of a text stand for a chunk, so that none is cut for the count alone
        n_rows = texts.agg(F.sum(F.ceil(F.length("text") / 100))).first()[0] or 0
        commit_documents(embedded_chunks(chunks, embed_chunks(chunks), n_rows), chunk_path, name)
        good = read_batch(spark, chunk_path, name).select("document_id").withColumn("ok", F.lit(True))
        ended = parsing.join(good, "document_id", "left")
        advance(ended, 3, F.when(F.col("ok"), "indexed").otherwise("failed"), F.when(F.col("ok").isNull(), F.when(F.col("has_text"), "embedding_failed").otherwise("no_text")))

    return queue.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _kept(rows: DataFrame) -> DataFrame:
    """``rows`` written to a folder of its own and read back: a micro-batch uses them for every step."""
    path = f"{new_dir(rows.sparkSession)}/rows"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _before(spark: SparkSession, status_path: str, version: int, id_type) -> DataFrame:
    """(document_id) of the documents that earlier versions have."""
    schema = T.StructType([T.StructField("document_id", id_type), T.StructField("version", T.LongType()), T.StructField("step", T.IntegerType())])
    try:
        return spark.read.schema(schema).parquet(status_path).where(F.col("version") < version).select("document_id").distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema).select("document_id")


def current_status(log: DataFrame) -> DataFrame:
    """(document_id, parse_status, parse_error) of each document's last step."""
    last = log.groupBy("document_id").agg(F.max_by(F.struct("parse_status", "parse_error"), F.struct("version", "step")).alias("s"))
    return last.select("document_id", "s.parse_status", "s.parse_error")


def requeue(status: DataFrame, ids: DataFrame) -> DataFrame:
    """``status`` with the documents of ``ids`` queued again and without their error; unknown and deleted ones stay as they are."""
    alive = F.col("deleted_at").isNull() if "deleted_at" in status.columns else F.lit(True)
    rows = status.join(ids.select("document_id").distinct().withColumn("again", F.lit(True)), "document_id", "left")
    again = F.coalesce(F.col("again") & alive, F.lit(False))
    return rows.withColumns({"parse_status": F.when(again, "queued").otherwise(F.col("parse_status")), "parse_error": F.when(~again, F.col("parse_error"))}).select(*status.columns)


def token_usage_stream(calls: DataFrame, cents, late: str = "1 day") -> DataFrame:
    """Daily token and cent sums, and the number of calls in them; rows of a day that ended before the watermark drop (see ``late_calls``)."""
    sums = [F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(cents).alias("cents"), F.count("*").alias("n_calls")]
    rows = calls.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "tenant_id", "model").agg(*sums)
    return rows.select("tenant_id", F.to_date("window.start").alias("day"), "model", "tokens_in", "tokens_out", "cents", "n_calls")


def late_calls(calls: DataFrame, usage: DataFrame, until: Column) -> DataFrame:
    """(tenant_id, day, model, n_calls, n_late) of days before ``until``: the calls that came too late for ``token_usage_stream``.

    ``calls`` are all that were put in, ``usage`` is what the stream gave; days that it hasn't closed yet are not before ``until``."""
    key = ["tenant_id", "day", "model"]
    given = calls.select("tenant_id", F.to_date("ts").alias("day"), "model").where(F.col("day") < until).groupBy(*key).agg(F.count("*").alias("n_calls"))
    counted = usage.select(*[F.col(k).alias(f"u_{k}") for k in key], F.col("n_calls").alias("n_counted"))
    rows = given.join(counted, [F.col(k).eqNullSafe(F.col(f"u_{k}")) for k in key], "left")
    return rows.withColumn("n_late", F.col("n_calls") - F.coalesce("n_counted", F.lit(0))).where("n_late > 0").select(*key, "n_calls", "n_late")


_DAY_MS = 86_400_000


def _drift_step(sample: int, days: int):
    """State of a tenant, as JSON: the ``sample`` least rows of each open day, and the counts of closed days that a window may still need."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"open": {}, "closed": {}}
        if not state.hasTimedOut:
            for frame in frames:
                for day, order, draft, passed in zip(frame["day"].tolist(), frame["nth_by"].tolist(), frame["draft_id"].tolist(), frame["passed"].tolist()):
                    rows = held["open"].setdefault(str(day), [])
                    rows.append([order, draft, bool(passed)])
                    if len(rows) > 4 * sample:
                        held["open"][str(day)] = sorted(rows)[:sample]
            held["open"] = {day: sorted(rows)[:sample] for day, rows in held["open"].items()}
        now, out = state.getCurrentWatermarkMs(), []
        for day in sorted(map(int, held["open"])):
            if (day + 1) * _DAY_MS > now:
                break
            rows = held["open"].pop(str(day))
            held["closed"][str(day)] = [len(rows), sum(passed for _, _, passed in rows)]
            held["closed"] = {d: c for d, c in held["closed"].items() if int(d) > day - days}
            n, good = map(sum, zip(*held["closed"].values()))
            out.append((key[0], day, len(rows), good / n))
        state.update((json.dumps(held),))
        if held["open"]:
            state.setTimeoutTimestamp((min(map(int, held["open"])) + 1) * _DAY_MS)
        elif now > (max(map(int, held["closed"])) + days) * _DAY_MS:
            state.remove()  # no later day's window reaches back to it
        else:
            state.setTimeoutTimestamp((max(map(int, held["closed"])) + days + 1) * _DAY_MS)
        yield pd.DataFrame(out, columns=["tenant_id", "day", "n", "pass_rate"])

    return run


def drift_stream(evals: DataFrame, late: str = "1 day", sample: int = 5, days: int = 7, floor: float = 0.9, seed: int | None = None) -> DataFrame:
    """``drift_report`` of a stream (tenant_id, ts, draft_id, passed): (tenant_id, day, n, pass_rate, alert), each day once the watermark has passed it.

    State per tenant is ``sample`` rows of each open day and two counts of each of the last ``days`` days.  Days are UTC's;
    rows of a day that has ended before the watermark drop."""
    order = F.col("draft_id") if seed is None else F.xxhash64("draft_id", F.lit(seed))
    day = F.floor(F.unix_micros("ts") / (_DAY_MS * 1000)).cast("int")
    rows = evals.withWatermark("ts", late).select("tenant_id", "ts", day.alias("day"), order.alias("nth_by"), "draft_id", F.coalesce("passed", F.lit(False)).alias("passed"))
    kind = dict(evals.dtypes)["tenant_id"]
    out = rows.groupBy("tenant_id").applyInPandasWithState(_drift_step(sample, days), f"tenant_id {kind}, day int, n long, pass_rate double", "held string", "append", "EventTimeTimeout")
    return out.select("tenant_id", F.date_from_unix_date("day").alias("day"), "n", "pass_rate", (F.col("pass_rate") < floor).alias("alert"))


def reminder_stream(candidates: DataFrame, keep: str = "40 days") -> DataFrame:
    """Each (deadline, threshold, channel) once, with state bounded by the watermark."""
    return candidates.withWatermark("at", keep).dropDuplicatesWithinWatermark(["deadline_id", "threshold", "channel"])


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over what is there into Parquet and read that."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
