"""Queries of the structure operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structure as B
from .registry import query


def _pages(t):
    """Documents with a numbered and a capital heading before their text."""
    i = F.col("doc_id")
    head = F.when(i % 2 == 0, F.concat(F.lit(" 1."), i % 9, F.lit(". Need\n"))).otherwise(F.lit("BUDGET & PLAN\n"))
    return t("documents").select("doc_id", (i % 3 + 1).cast("int").alias("page_number"), F.concat(head, F.lit("7 Plan "), i, F.lit("\n\n"), F.col("text")).alias("text"))


_LINES = """lines AS (SELECT doc_id, page_number, unnest(l) AS raw, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line_no FROM (SELECT doc_id, CAST(doc_id % 3 + 1 AS INT) AS page_number,
    string_split(CASE WHEN doc_id % 2 = 0 THEN ' 1.' || doc_id % 9 || '. Need' || chr(10) ELSE 'BUDGET & PLAN' || chr(10) END || '7 Plan ' || doc_id || chr(10) || chr(10) || text, chr(10)) AS l FROM {documents})),
    marked AS (SELECT doc_id, page_number, line_no, trim(raw, ' ' || chr(9) || chr(13)) AS text FROM lines)"""


@query(f"""WITH {_LINES}, h AS (SELECT *, regexp_extract(text, '^(\\d+(?:\\.\\d+)*)\\.?\\s+\\S.*$', 1) AS n FROM marked WHERE text <> '' AND length(text) <= 120)
    SELECT doc_id, page_number, line_no, text, CAST(CASE WHEN n <> '' THEN least(6, length(n) - length(replace(n, '.', '')) + 1) ELSE 1 END AS INT) AS level FROM h WHERE n <> '' OR (length(text) <= 80 AND regexp_matches(text, '^[A-Z0-9][A-Z0-9 \\-&/,.:''"()]{{2,}}$'))""".replace("{{2,}}", "{2,}"))
def detect_headings(t):
    return B.detect_headings(_pages(t))


def _markdown(t):
    """Whole texts between planted headings and tables."""
    i = F.col("doc_id")
    table = F.concat(F.lit("| a | b |\n|---|:-:|\n| "), i, F.lit(" | x |\n"))
    part = F.concat(F.lit("\n"), F.repeat(F.lit("#"), (i % 8 + 1).cast("int")), F.lit(" Part "), i, F.lit("\n"), F.when(i % 3 == 0, F.lit("")).otherwise(table), F.lit("after\n| lone |\n"))
    return t("documents").select("doc_id", F.concat(F.lit("# Top\n"), "text", part, "text", F.lit("\n#\n")).alias("markdown"))


_MD = r"""lines AS (SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS line_no, unnest(l) AS raw FROM (SELECT doc_id, string_split('# Top' || chr(10) || text || chr(10) || repeat('#', CAST(doc_id % 8 + 1 AS INT)) || ' Part ' || doc_id || chr(10)
    || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '| a | b |' || chr(10) || '|---|:-:|' || chr(10) || '| ' || doc_id || ' | x |' || chr(10) END || 'after' || chr(10) || '| lone |' || chr(10) || text || chr(10) || '#' || chr(10), chr(10)) AS l FROM {documents})),
    tabled AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (SELECT doc_id, line_no, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM lines) WHERE starts_with(line, '|') AND ends_with(line, '|'))"""


@query(rf"""WITH {_MD}, h AS (SELECT doc_id, line_no, length(regexp_extract(raw, '^\s*(#+)', 1)) AS marks, regexp_replace(regexp_replace(raw, '^\s*#+', ''), '^\s+|\s+$', '', 'g') AS text FROM lines)
    SELECT doc_id, line_no, CAST(least(6, marks) AS INT) AS level, text FROM h WHERE marks > 0 AND text <> ''""")
def markdown_headings(t):
    return B.markdown_headings(_markdown(t))


@query(f"WITH {_MD} SELECT doc_id, min(line_no) AS first_line, count(*) AS n_rows, CAST(max(length(line) - length(replace(line, '|', '')) - 1) AS INT) AS n_cols, CAST(-1 AS INT) AS page FROM tabled GROUP BY doc_id, run HAVING count(*) > 1")
def markdown_tables(t):
    return B.markdown_tables(_markdown(t))


@query(rf"""WITH {_MD} SELECT doc_id, line_no, array_to_string(list_transform(string_split(substr(line, 2, greatest(0, length(line) - 2)), '|'), lambda x: trim(x, ' ')), ';') AS cells FROM tabled WHERE NOT regexp_matches(line, '^\|(\s*:?-+:?\s*\|)+$')""")
def markdown_table_cells(t):
    return B.markdown_table_cells(_markdown(t)).select("doc_id", "line_no", F.array_join("cells", ";").alias("cells"))


@query(r"""WITH marked AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'start ' || text ELSE '' END || chr(10) || '2------------' || chr(10) || text || chr(10) || '5----------' || chr(10) AS md FROM {documents}),
    parts AS (SELECT doc_id, string_split_regex(md, '(?m)^\s*(\d+)-{10,}\s*$|(\d+)-{10,}') AS p, regexp_extract_all(md, '(\d+)-{10,}', 1) AS n FROM marked),
    each AS (SELECT doc_id, len(p) AS size, n, generate_subscripts(p, 1) AS i, regexp_replace(unnest(p), '^\s+|\s+$', '', 'g') AS text FROM parts)
    SELECT doc_id, CAST(i - 1 AS INT) AS place, CASE WHEN i = 1 THEN 1 ELSE TRY_CAST(n[i - 1] AS INT) END AS page_number, text FROM each WHERE i > 1 OR text <> '' OR size = 1""")
def split_page_markers(t):
    start = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("start "), "text")).otherwise(F.lit(""))
    return B.split_page_markers(t("documents").select("doc_id", F.concat(start, F.lit("\n2------------\n"), "text", F.lit("\n5----------\n")).alias("markdown")))


_CELLS = """SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INT) AS row_no, unnest(l) AS cells FROM (SELECT page_id AS doc_id, list_transform(list_filter(regexp_extract_all(html, '(?is)<(?:li)\\b[^>]*>(.*?)</(?:li)\\s*>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g')) <> ''), lambda x: trim(regexp_replace(regexp_replace(regexp_extract(x, '(?is)<a\\b[^>]*>(.*?)</a\\s*>', 1), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))) AS l FROM {pages})"""


@query(_CELLS)
def html_table_rows(t):
    rows = B.html_table_rows(t("pages").withColumnRenamed("page_id", "doc_id"), row_tag="li", cell_tags="a")
    return rows.select("doc_id", "row_no", F.array_join("cells", ";").alias("cells"))


@query("""WITH e AS (SELECT l_orderkey AS doc_id, CAST(greatest(1, l_linenumber % 3) AS INT) AS page_number, l_linenumber * 1000000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity) AS pos, 'x' || l_partkey AS text, l_linenumber % 5 AS k FROM {lineitem})
    SELECT doc_id, page_number, coalesce(string_agg(CASE k WHEN 0 THEN NULL WHEN 1 THEN '- ' || text WHEN 2 THEN NULL ELSE text END, chr(10) || chr(10) ORDER BY pos), '') AS text, coalesce(string_agg(CASE k WHEN 0 THEN '1:' || text WHEN 3 THEN '2:' || text END, '|' ORDER BY pos), '') AS headings FROM e GROUP BY 1, 2""")
def elements_to_pages(t):
    k = F.col("l_linenumber") % 5
    kind = F.when(k == 0, "Title").when(k == 1, "ListItem").when(k == 2, "Table").when(k == 3, "Header").otherwise("NarrativeText")
    nth = F.expr("row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity)")
    page = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_linenumber") % 3).cast("int")
    rows = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 1000000 + nth).alias("pos"), page.alias("page"), kind.alias("kind"), F.concat(F.lit("x"), "l_partkey").alias("text"))
    return B.elements_to_pages(rows)


def _table(t):
    """Whole texts as tables: lines are rows, their sentences cells, empty ones null; one cell has a bar and a line break."""
    cells = F.transform(F.split("text", "\n"), lambda x: F.transform(F.split(x, r"\. "), lambda c: F.nullif(c, F.lit(""))))
    return t("documents").select("doc_id", F.concat(F.array(F.array(F.lit("a|b\nc"), F.col("doc_id").cast("string"))), cells).alias("rows"))


_ROWS = """cleaned AS (SELECT doc_id, list_filter(list_concat([['a|b' || chr(10) || 'c', doc_id::VARCHAR]], list_transform(string_split(text, chr(10)), lambda x: string_split(x, '. '))), lambda r: len(list_filter(r, lambda c: trim(c, ' ') <> '')) > 0) AS rows FROM {documents} WHERE text IS NOT NULL)"""


@query(f"WITH {_ROWS} SELECT doc_id, CAST(len(rows) AS INT) AS n_rows, array_to_string(list_transform(rows, lambda r: array_to_string(r, ';')), chr(10)) AS cells FROM cleaned")
def clean_table_rows(t):
    rows = _table(t).where("rows IS NOT NULL").withColumn("rows", B.clean_table_rows(F.col("rows")))
    return rows.select("doc_id", F.size("rows").alias("n_rows"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ";")), "\n").alias("cells"))


@query(f"""WITH {_ROWS}, wide AS (SELECT doc_id, rows, list_max(list_transform(rows, lambda r: len(r))) AS width FROM cleaned),
    lined AS (SELECT doc_id, width, list_transform(rows, lambda r: '| ' || array_to_string(list_concat(list_transform(r, lambda c: replace(replace(replace(c, chr(13) || chr(10), ' '), chr(10), ' '), '|', '\\|')), list_transform(range(width - len(r)), lambda z: '')), ' | ') || ' |') AS l FROM wide)
    SELECT doc_id, array_to_string(list_concat(l[1:1], ['| ' || array_to_string(list_transform(range(width), lambda z: '---'), ' | ') || ' |'], l[2:]), chr(10)) AS markdown FROM lined""")
def table_to_markdown(t):
    return _table(t).where("rows IS NOT NULL").select("doc_id", B.table_to_markdown(B.clean_table_rows(F.col("rows"))).alias("markdown"))


_RULE = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"


@query(f"""SELECT l_orderkey AS doc_id, string_agg('<!-- page ' || l_linenumber || ' -->' || CASE WHEN l_linenumber % 3 > 0 THEN {_RULE} || CASE l_linenumber % 3 WHEN 1 THEN '# H' || chr(10) || chr(10) ELSE '' END || 'n' || n ELSE '' END, {_RULE} ORDER BY l_linenumber) AS markdown
    FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM {{lineitem}} GROUP BY ALL) GROUP BY 1""")
def document_to_markdown(t):
    k = F.col("page_number") % 3
    pages = t("lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_number")).agg(F.count("*").alias("n"))
    none = F.array().cast("array<string>")
    pages = pages.select("doc_id", "page_number", F.when(k == 1, F.array(F.lit("# H"))).otherwise(none).alias("headings"), F.when(k > 0, F.concat(F.lit("n"), "n")).otherwise(" ").alias("text"), none.alias("tables"))
    return B.document_to_markdown(pages)


@query(f"""WITH {_LINES}, base AS (SELECT doc_id, page_number, 'Need' AS text, 2 AS level FROM marked WHERE line_no = 0 AND doc_id % 2 = 0) SELECT doc_id, page_number, text, CAST(level AS INT) AS level FROM base
    UNION ALL SELECT doc_id, CAST(doc_id % 3 + 1 AS INT), 'Annex', 6 FROM {{documents}} WHERE doc_id % 3 <> 2 UNION ALL SELECT doc_id, CAST(doc_id % 3 + 1 AS INT), 'NEED', 1 FROM {{documents}} WHERE doc_id % 2 = 1""")
def merge_toc_hints(t):
    i = F.col("doc_id")
    page = (i % 3 + 1).cast("int").alias("page_number")
    docs = t("documents")
    headings = docs.where(i % 2 == 0).select("doc_id", page, F.lit("Need").alias("text"), F.lit(2).alias("level"))
    entry = lambda text, level, p=page: docs.select("doc_id", p, F.lit(text).alias("text"), F.lit(level).alias("level"))
    toc = entry(" NEED ", 0).unionByName(entry("Annex", 9, F.when(i % 3 == 2, 99).otherwise(i % 3 + 1).cast("int").alias("page_number"))).unionByName(entry("  ", 1))
    return B.merge_toc_hints(headings, toc, docs.select("doc_id", page))
