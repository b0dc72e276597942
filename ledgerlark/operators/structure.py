"""Structure of parsed text: headings, tables, pages, and their way back to markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Patterns of headings: fixed values.
NUMBERED, CAPITALS = r"^(\d+(?:\.\d+)*)\.?\s+\S.*$", r"""^[A-Z0-9][A-Z0-9 \-&/,.:'"()]{2,}$"""
PAGE_RULE = "\n\n---\n\n"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def detect_headings(pages: DataFrame) -> DataFrame:
    """(doc_id, page_number, line_no, text, level): numbered lines, else short lines in capitals."""
    rows = pages.select("doc_id", "page_number", F.posexplode(F.split("text", "\n")).alias("line_no", "text")).withColumn("text", _trim(F.col("text")))
    number = F.regexp_extract("text", NUMBERED, 1)
    level = F.when(number != "", F.least(F.lit(6), F.size(F.split(number, r"\.")))).when((F.length("text") <= 80) & F.col("text").rlike(CAPITALS), 1)
    return rows.withColumn("level", level).where((F.col("text") != "") & (F.length("text") <= 120) & F.col("level").isNotNull())


def markdown_headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, text) of ATX headings; more than six marks count six."""
    rows = docs.select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("line_no", "line"))
    marks, text = F.regexp_extract("line", r"^\s*(#+)", 1), _trim(F.regexp_replace("line", r"^\s*#+", ""))
    return rows.where((marks != "") & (text != "")).select("doc_id", "line_no", F.least(F.lit(6), F.length(marks)).alias("level"), text.alias("text"))


def _table_lines(docs: DataFrame) -> DataFrame:
    """Table lines with ``run``, which is the same for lines that follow one another."""
    rows = docs.select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("line_no", "line")).withColumn("line", _trim(F.col("line")))
    rows = rows.where(F.col("line").startswith("|") & F.col("line").endswith("|"))
    return rows.withColumn("run", F.col("line_no") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")))


def markdown_tables(docs: DataFrame) -> DataFrame:
    """(doc_id, first_line, n_rows, n_cols, page) of runs of two table lines or more; the page isn't known (-1)."""
    pipes = F.length("line") - F.length(F.replace("line", F.lit("|"), F.lit("")))
    runs = _table_lines(docs).groupBy("doc_id", "run").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_rows"), F.max(pipes - 1).alias("n_cols"))
    return runs.where("n_rows > 1").select("doc_id", "first_line", "n_rows", "n_cols", F.lit(-1).alias("page"))


def markdown_table_cells(docs: DataFrame) -> DataFrame:
    """(doc_id, run, line_no, cells): stripped cells of table lines that are no separators."""
    cells = F.transform(F.split(F.expr("substring(line, 2, length(line) - 2)"), r"\|"), lambda x: F.trim(x))
    rows = _table_lines(docs).where(~F.col("line").rlike(r"^\|(\s*:?-+:?\s*\|)+$"))
    return rows.select("doc_id", "run", "line_no", cells.alias("cells"))


def split_page_markers(docs: DataFrame) -> DataFrame:
    """(doc_id, place, page_number, text): text parted at ``N----------``; what stands before the first marker is page 1."""
    marker = r"(?m)^\s*(\d+)-{10,}\s*$|(\d+)-{10,}"
    rows = docs.select("doc_id", F.split("markdown", marker).alias("texts"), F.regexp_extract_all("markdown", F.lit(r"(\d+)-{10,}"), F.lit(1)).alias("numbers"))
    number = lambda i: F.when(i == 0, F.lit(1)).otherwise(F.get("numbers", i - 1).try_cast("int"))
    parts = F.transform("texts", lambda x, i: F.struct(i.alias("place"), number(i).alias("page_number"), _trim(x).alias("text")))
    kept = F.filter(parts, lambda p: (p["place"] > 0) | (p["text"] != "") | (F.size("texts") == 1))
    return rows.select("doc_id", F.explode(kept).alias("p")).select("doc_id", "p.*")


def html_table_rows(docs: DataFrame, row_tag: str = "tr", cell_tags: str = "td|th", html_col: str = "html") -> DataFrame:
    """(doc_id, row_no, cells): rows and cells of HTML without tags, empty rows dropped; without rows, lines with tabs."""
    rows = F.regexp_extract_all(html_col, F.lit(rf"(?is)<(?:{row_tag})\b[^>]*>(.*?)</(?:{row_tag})\s*>"), F.lit(1))
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\s+", " "))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(rf"(?is)<(?:{cell_tags})\b[^>]*>(.*?)</(?:{cell_tags})\s*>"), F.lit(1)), clean)
    tabbed = F.transform(F.filter(F.split(html_col, "\n"), lambda x: x.contains("\t")), lambda x: F.transform(F.split(x, "\t"), lambda c: F.trim(c)))
    found = F.when(F.size(rows) > 0, F.transform(rows, cells)).otherwise(tabbed)
    full = F.filter(found, lambda r: F.exists(r, lambda c: c != ""))
    return docs.select("doc_id", F.posexplode(full).alias("row_no", "cells"))


def elements_to_pages(elements: DataFrame) -> DataFrame:
    """(doc_id, page_number, text, headings): typed elements (doc_id, pos, page, kind, text) joined page by page in order."""
    page = F.greatest(F.lit(1), F.coalesce("page", F.lit(1)))
    text = F.when(F.col("kind") == "ListItem", F.concat(F.lit("- "), F.col("text"))).when(F.col("kind").isin("Title", "Table"), F.lit(None)).otherwise(F.col("text"))
    level = F.when(F.col("kind") == "Title", 1).when(F.col("kind") == "Header", 2)
    rows = elements.select("doc_id", page.alias("page_number"), "pos", text.alias("t"), F.when(level.isNotNull(), F.concat(level.cast("string"), F.lit(":"), F.col("text"))).alias("h"))
    listed = rows.groupBy("doc_id", "page_number").agg(F.sort_array(F.collect_list(F.struct("pos", "t", "h"))).alias("e"))
    return listed.select("doc_id", "page_number", F.array_join(F.col("e.t"), "\n\n").alias("text"), F.array_join(F.col("e.h"), "|").alias("headings"))


def clean_table_rows(rows: Column) -> Column:
    """Rows with null cells as empty text and without empty rows."""
    full = F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))
    return F.filter(full, lambda r: F.exists(r, lambda c: F.trim(c) != ""))


def table_to_markdown(rows: Column) -> Column:
    """A markdown table of rows padded to the widest; the first is the header."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r?\n", " "), F.lit("|"), F.lit("\\|"))
    line = lambda r, wide: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), wide - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    # the width is found once a table, not once a row
    lines = F.get(F.transform(F.array(width), lambda wide: F.transform(rows, lambda r: line(r, wide))), F.lit(0))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))), "\n")).otherwise("")


def document_to_markdown(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown) of (doc_id, page_number, headings, text, tables): a marker and a body per page, parted by rules."""
    body = F.array_join(F.filter(F.concat("headings", F.array("text"), "tables"), lambda x: F.trim(x) != ""), "\n\n")
    parts = F.array(F.concat(F.lit("<!-- page "), F.col("page_number").cast("string"), F.lit(" -->")), body)
    rows = pages.select("doc_id", "page_number", F.filter(parts, lambda x: x != "").alias("parts"))
    listed = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "parts"))).alias("p"))
    return listed.select("doc_id", F.array_join(F.flatten(F.col("p.parts")), PAGE_RULE).alias("markdown"))


def merge_toc_hints(headings: DataFrame, toc: DataFrame, pages: DataFrame) -> DataFrame:
    """``headings`` (doc_id, page_number, text, level) and the TOC entries of pages that are there and lack them."""
    key = lambda c: F.lower(F.trim(c))
    hints = toc.where(F.trim("text") != "").withColumns({"text": F.trim("text"), "level": F.least(F.lit(6), F.greatest(F.lit(1), F.col("level")))}).withColumn("key", key(F.col("text")))
    hints = hints.join(pages.select("doc_id", "page_number"), ["doc_id", "page_number"], "left_semi").dropDuplicates(["doc_id", "page_number", "key"])
    fresh = hints.join(headings.select("doc_id", "page_number", key(F.col("text")).alias("key")), ["doc_id", "page_number", "key"], "left_anti")
    return headings.select("doc_id", "page_number", "text", "level").unionByName(fresh.select("doc_id", "page_number", "text", "level"))
