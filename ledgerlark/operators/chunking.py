"""Chunks of documents: cutting, headings, pages, embedding, listing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.chunker import chunk, spans


def chunk_documents(docs: DataFrame, target: int = 800, overlap: int = 100, backup: int = 200, tokenizer: Callable = spans, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per chunk of (document_id, text), with the document's ``keep``; a blank document has none.  Narrow: no shuffle."""
    if overlap >= target:
        raise ValueError("overlap must be less than target")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["document_id", "chunk_index", "content", "token_count", "char_start", "char_end", *keep]
        for batch in batches:
            for k in range(0, len(batch), 200):  # a few documents' chunks at a time
                some = batch.iloc[k : k + 200]
                rows = [(i, *c, *kept) for i, text, *kept in zip(some["document_id"], some["text"], *[some[k] for k in keep]) for c in chunk(text, target, overlap, backup, tokenizer)]
                yield pd.DataFrame(rows, columns=columns)

    kind = dict(docs.dtypes)["document_id"]
    # what is kept goes as text, which loses nothing where numbers and nulls meet
    texts = docs.select("document_id", "text", *[F.col(k).cast("string") for k in keep])
    rows = texts.mapInPandas(run, f"document_id {kind}, chunk_index int, content string, token_count int, char_start int, char_end int" + "".join(f", {k} string" for k in keep))
    return rows.withColumns({k: F.col(k).cast(docs.schema[k].dataType) for k in keep}) if keep else rows


def heading_path(chunks: DataFrame, headings: DataFrame, max_depth: int = 6) -> DataFrame:
    """``chunks`` with ``section_heading``: the chain of headings (document_id, offset, depth, text) above each chunk's start."""
    marks = headings.select("document_id", F.col("offset").alias("at"), F.lit(0).alias("is_chunk"), "depth", "text", F.lit(None).cast("int").alias("chunk_index"))
    starts = chunks.select("document_id", F.col("char_start").alias("at"), F.lit(1).alias("is_chunk"), F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("text"), "chunk_index")
    order = Window.partitionBy("document_id").orderBy("at", "is_chunk", F.desc("depth"), "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = marks.unionByName(starts).withColumn("seq", F.row_number().over(Window.partitionBy("document_id").orderBy("at", "is_chunk", F.desc("depth"), "text")))
    last = {d: F.last(F.when(F.col("depth") == d, F.struct("seq", "text")), ignorenulls=True).over(order) for d in range(1, max_depth + 1)}
    rows = rows.withColumns({f"h{d}": c for d, c in last.items()}).where("is_chunk = 1")
    parts, above = [], F.lit(0)
    for d in range(1, max_depth + 1):  # a heading stands if no shallower one came after it
        later = F.greatest(F.lit(0), *[F.coalesce(F.col(f"h{k}.seq"), F.lit(0)) for k in range(1, d)], F.lit(0)) if d > 1 else above
        parts.append(F.when(F.col(f"h{d}.seq") > later, F.concat(F.lit("#" * d + " "), F.col(f"h{d}.text"))))
    path = F.nullif(F.array_join(F.array_compact(F.array(*parts)), " > "), F.lit(""))
    return chunks.join(rows.select("document_id", "chunk_index", path.alias("section_heading")), ["document_id", "chunk_index"], "left")


def normalize_pages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(document_id, page_number, start, end): given offsets, or an equal split, or page 1 over the whole document."""
    rows = docs.select("document_id", "doc_len").join(pages, "document_id", "left")
    one = Window.partitionBy("document_id")
    order = one.orderBy("page_number")
    rows = rows.withColumns({"n": F.count("page_number").over(one), "k": F.row_number().over(order) - 1, "whole": F.bool_and(F.col("start").isNotNull() & F.col("end").isNotNull()).over(one)})
    size = F.expr("doc_len div greatest(n, 1)").cast("int")
    last = F.col("k") == F.col("n") - 1
    start = F.when(F.col("n") == 0, 0).when(F.col("whole"), F.col("start")).otherwise(F.col("k") * size)
    end = F.when(F.col("n") == 0, F.col("doc_len")).when(F.col("whole"), F.when(last & (F.col("end") <= F.col("start")), F.greatest("doc_len", "end")).otherwise(F.col("end"))).otherwise(F.when(last, F.col("doc_len")).otherwise((F.col("k") + 1) * size))
    return rows.select("document_id", F.coalesce("page_number", F.lit(1)).alias("page_number"), start.cast("int").alias("start"), end.cast("int").alias("end"))


def _pages_by_range(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, chunk_index, a, b): each chunk (document_id, struct c) with its first and last page, by a join of all its document's pages."""
    p = pages.select(F.col("document_id").alias("p_doc"), "page_number", "start", "end")
    s, e = F.col("c.char_start"), F.col("c.char_end")
    first, final = (F.col("start") <= s) & (s < F.col("end")), (F.col("start") < e) & (e <= F.col("end"))
    near = chunks.join(p, (F.col("document_id") == F.col("p_doc")) & (first | final), "left")
    return near.groupBy("document_id", F.col("c.chunk_index").alias("chunk_index")).agg(F.min(F.when(first, F.col("page_number"))).alias("a"), F.max(F.when(final, F.col("page_number"))).alias("b"))


def map_pages(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``chunks`` with ``page_start``, the first page that holds their start (else the document's first), and ``page_end``, the last that holds their end (else its last).

    Where a document's pages begin and end in their order, as ``normalize_pages`` has them, two sweeps over the edges of pages and
    chunks find both: linear, and no join.  Documents whose pages don't are joined by range.  A document without pages has nulls."""
    mine = Window.partitionBy("document_id")
    by_number = mine.orderBy("page_number")
    before = lambda c: F.lag(c).over(by_number)
    back = F.coalesce((F.col("start") < before("start")) | (F.col("end") < before("end")) | (F.col("page_number") == before("page_number")), F.lit(False))
    p = pages.select("document_id", "page_number", "start", "end").withColumn("back", back)
    c = chunks.select("document_id", F.struct("*").alias("c"))
    page = F.struct("page_number", "start", "end").alias("page")
    both = p.select("document_id", page, F.col("back"), F.lit(None).cast(c.schema["c"].dataType).alias("c")).unionByName(c.select("document_id", F.lit(None).cast(p.select(page).schema["page"].dataType).alias("page"), F.lit(None).cast("boolean").alias("back"), "c"))
    is_page = F.col("page").isNotNull()
    rows = both.withColumns({"odd": F.coalesce(F.bool_or("back").over(mine), F.lit(False)), "least": F.min("page.page_number").over(mine), "most": F.max("page.page_number").over(mine)})
    # at equal places a chunk comes ahead of a page: a page that ends where a chunk starts, or starts where it ends, doesn't hold it
    ends = mine.orderBy(F.desc(F.coalesce("page.end", "c.char_start")), is_page, F.desc("page.page_number"))
    starts = mine.orderBy(F.coalesce("page.start", "c.char_end"), is_page, "page.page_number")
    last = lambda w: F.last("page", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    swept = rows.withColumns({"first_page": last(ends), "last_page": last(starts)}).where("c IS NOT NULL")
    holds = F.when(~F.col("odd") & (F.col("first_page.start") <= F.col("c.char_start")), F.col("first_page.page_number"))
    ended = F.when(~F.col("odd") & (F.col("last_page.end") >= F.col("c.char_end")), F.col("last_page.page_number"))
    swept = swept.select("document_id", "c", "odd", "least", "most", holds.alias("a"), ended.alias("b"))
    ranged = _pages_by_range(swept.where("odd").select("document_id", "c"), pages).select("document_id", "chunk_index", F.col("a").alias("r_a"), F.col("b").alias("r_b"))
    rows = swept.where("NOT odd").select("c.*", F.coalesce("a", "least").alias("page_start"), F.coalesce("b", "most").alias("page_end"))
    odd = swept.where("odd").withColumn("chunk_index", F.col("c.chunk_index")).join(ranged, ["document_id", "chunk_index"], "left")
    return rows.unionByName(odd.select("c.*", F.coalesce("r_a", "least").alias("page_start"), F.coalesce("r_b", "most").alias("page_end")))


def document_text(chunks: DataFrame) -> DataFrame:
    """(document_id, text): non-empty chunks in order, parted by blank lines."""
    rows = chunks.where("content <> ''").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    return rows.select("document_id", F.array_join("c.content", "\n\n").alias("text"))


def document_listing(docs: DataFrame, chunks: DataFrame, limit=50, offset=0) -> DataFrame:
    """A page of the documents that aren't deleted, newest first, with their chunk counts."""
    size = limit if isinstance(limit, int) and limit != 0 else 50
    size, skip = min(200, max(1, size)), max(0, offset if isinstance(offset, int) else 0)
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    rows = docs.where("deleted_at IS NULL").orderBy(F.desc("created_at"), "document_id").offset(skip).limit(size)
    return rows.join(counts, "document_id", "left").select("document_id", "created_at", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def hashed_vectors(texts: list[str], size: int = 16) -> np.ndarray:
    """A deterministic stand-in for an embedder: hashed words, unit length."""
    import zlib

    out = np.zeros((len(texts), size), np.float32)
    for row, text in zip(out, texts):
        for word in text.lower().split():
            row[zlib.crc32(word.encode()) % size] += 1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed_chunks(chunks: DataFrame, embed: Callable[[list[str]], np.ndarray] = hashed_vectors, batch: int = 100) -> DataFrame:
    """(document_id, chunk_index, embedding), at most ``batch`` texts to a call, in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                some = frame.iloc[k : k + batch]
                yield some[["document_id", "chunk_index"]].assign(embedding=list(embed(some["content"].tolist())))

    kind = dict(chunks.dtypes)["document_id"]
    return chunks.select("document_id", "chunk_index", "content").mapInPandas(run, f"document_id {kind}, chunk_index int, embedding array<float>")
