"""Queries of extraction results and scorecards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as X
from .registry import query


def _stamp(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def _responses(t):
    """Answers that hold the whole text as JSON, plain or in a fence, and answers that are no object."""
    k = F.col("doc_id") % 4
    good = F.to_json(F.struct(F.col("n_chars").alias("n"), "text"))
    return t("documents").select("doc_id", F.when(k == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(k == 1, good).when(k == 2, F.to_json(F.array("text"))).otherwise(F.concat(F.lit("not json {"), "text")).alias("response"))


@query("SELECT doc_id, doc_id % 4 >= 2 AS is_empty, CASE WHEN doc_id % 4 < 2 THEN n_chars END AS n, CASE WHEN doc_id % 4 < 2 THEN text END AS text FROM {documents}")
def parse_llm_json(t):
    rows = X.parse_llm_json(_responses(t)).select("doc_id", (F.col("json") == "{}").alias("is_empty"), F.from_json("json", "n bigint, text string").alias("v"))
    return rows.select("doc_id", "is_empty", "v.n", "v.text")


def _requirements(t):
    """Extraction outputs that quote the whole text, with planted breaks by document number."""
    i = F.col("doc_id")
    quote = F.regexp_extract(F.to_json(F.array("text"), {"ignoreNullFields": "false"}), r"(?s)^\[(.*)\]$", 1)
    json = F.concat(
        F.lit('{"award_summary":{"program_name":"P","funder_name":'), F.when(i % 5 == 0, F.lit("7")).otherwise(F.lit('"F"')), F.lit(',"award_min_usd":null,"award_max_usd":100},"reports":[{"title":"T","report_type":"'), F.when(i % 7 == 0, "other").otherwise("final"),
        F.lit('","due_offset_days":30,"period_months":12,"format":"pdf","narrative_sections":[{"key":"k","label":"l","field_type":"narrative","required":'), F.when(i % 3 == 0, F.lit('"yes"')).otherwise(F.lit("true")), F.lit("}]}],"),
        F.when(i % 11 == 0, F.lit("")).otherwise(F.lit('"citations":[{"field":"f","page":1,"quote":')), F.when(i % 11 == 0, F.lit("")).otherwise(F.concat(quote, F.lit("}],"))), F.lit('"uncertainties":[],"extra":1}'),
    )
    return t("documents").select("doc_id", json.alias("json"))


@query("""SELECT doc_id, concat_ws('; ', CASE WHEN doc_id % 11 = 0 THEN 'citations: not array' END, CASE WHEN doc_id % 5 = 0 THEN 'award_summary.funder_name: not string' END, CASE WHEN doc_id % 7 = 0 THEN 'reports.0.report_type: unknown value' END,
    CASE WHEN doc_id % 3 = 0 THEN 'reports.0.narrative_sections.0.required: not boolean' END, CASE WHEN doc_id % 11 <> 0 AND text IS NULL THEN 'citations.0.quote: not string' END) AS errors,
    NOT (doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 3 = 0 OR doc_id % 11 = 0 OR text IS NULL) AS valid FROM {documents}""")
def validate_requirements(t):
    return X.validate_requirements(_requirements(t)).select("doc_id", F.array_join("errors", "; ").alias("errors"), "valid")


def _reports(t):
    i = F.col("award_id")
    section = lambda k, most: F.struct(F.lit(k).alias("key"), F.lit(k.upper()).alias("label"), F.lit(True).alias("required"), most.alias("word_count_max"), F.lit(None).cast("int").alias("word_count_min"))
    none = F.array().cast("array<struct<key:string,label:string,required:boolean,word_count_max:int,word_count_min:int>>")
    report = lambda title, kind, off, sections: F.struct(F.lit(title).alias("title"), F.lit(kind).alias("report_type"), off.cast("int").alias("due_offset_days"), sections.alias("sections"))
    both = F.array(section("need", F.lit(200)), section("plan", F.lit(None).cast("int")))
    reports = F.array(report("Progress", "progress", 15 + i % 3, both), report("Final", "final", F.lit(90), none))
    return t("awards").select("award_id", "tenant_id", "period_start", F.when(i % 8 != 0, F.col("period_end")).alias("period_end"), F.when(i % 9 != 0, reports).alias("reports"))


_FAN = """fan AS (SELECT award_id, tenant_id, period_start, CASE WHEN award_id % 8 <> 0 THEN period_end END AS period_end, r AS report_no FROM {awards} LEFT JOIN range(0, 2) g(r) ON award_id % 8 <> 0 AND award_id % 9 <> 0 WHERE award_id % 8 = 0 OR r IS NOT NULL)"""


@query(f"""WITH {_FAN} SELECT award_id, tenant_id, CAST(report_no AS INT) AS report_no, CASE report_no WHEN 0 THEN 'Progress' WHEN 1 THEN 'Final' END AS title, CASE report_no WHEN 0 THEN 'progress' WHEN 1 THEN 'final' END AS report_type,
    strftime(period_end + CAST(CASE report_no WHEN 0 THEN 15 + award_id % 3 ELSE 90 END AS INT), '%Y-%m-%d 00:00:00') AS due_at, CASE WHEN report_no IS NOT NULL THEN 'upcoming' END AS status, CASE WHEN report_no IS NULL THEN 'award period is missing' END AS error FROM fan""")
def fan_out_reports(t):
    return _stamp(X.fan_out_reports(_reports(t)).drop("sections", "period_start", "period_end"), "due_at")


@query(f"""WITH {_FAN} SELECT award_id, CAST(report_no AS INT) AS report_no, CAST(f AS INT) AS field_no, CASE f WHEN 0 THEN 'need' ELSE 'plan' END AS key, CASE f WHEN 0 THEN 'NEED' ELSE 'PLAN' END AS label, true AS required, CAST(CASE WHEN f = 0 THEN 200 END AS INT) AS word_count_max, CAST(NULL AS INT) AS word_count_min
    FROM fan CROSS JOIN range(0, 2) h(f) WHERE report_no = 0""")
def fan_out_fields(t):
    return X.fan_out_fields(X.fan_out_reports(_reports(t)))


@query("SELECT award_id, CASE WHEN award_id % 10 <> 0 THEN strftime(period_end + CAST(30 + 15 * (award_id % 5) AS INT), '%Y-%m-%d 00:00:00') END AS due_at FROM {awards}")
def compute_due_at(t):
    end = F.when(F.col("award_id") % 10 == 0, "2024-13-01").otherwise(F.col("period_end").cast("string"))
    return _stamp(t("awards").select("award_id", X.compute_due_at(end, (30 + 15 * (F.col("award_id") % 5)).cast("int")).alias("due_at")), "due_at")


@query("""SELECT award_id, CASE WHEN award_id % 6 = 0 OR award_id % 7 = 0 OR award_id % 5 = 0 OR award_id % 11 = 0 THEN 'failed' WHEN award_id % 4 > 0 THEN 'manual_review' ELSE 'ok' END AS status,
    CASE WHEN award_id % 6 = 0 THEN 'missing_source_document' WHEN award_id % 7 = 0 THEN 'missing_period_end' WHEN award_id % 5 = 0 THEN 'no_response' WHEN award_id % 11 = 0 THEN 'timeout' WHEN award_id % 4 = 1 THEN 'e1' WHEN award_id % 4 = 2 THEN 'e1; e2' WHEN award_id % 4 = 3 THEN 'e1; e2; e3' END AS reason,
    CAST(award_id % 3 + CASE WHEN award_id % 6 <> 0 AND award_id % 7 <> 0 THEN 1 ELSE 0 END AS INT) AS attempts FROM {awards}""")
def extraction_status(t):
    i = F.col("award_id")
    awards = t("awards").select("award_id", F.when(i % 6 != 0, i).alias("source_document_id"), F.when(i % 7 != 0, F.col("period_end")).alias("period_end"), (i % 3).cast("int").alias("attempts"))
    errors = F.slice(F.array(*[F.lit(f"e{n}") for n in range(1, 5)]), 1, F.when(i % 4 == 3, 4).otherwise((i % 4).cast("int")))
    responses = t("awards").where("award_id % 5 <> 0").select("award_id", F.when(i % 11 == 0, "timeout").alias("worker_error"), errors.alias("errors"))
    return X.extraction_status(awards, responses)


_BAGS = """t AS (SELECT l_orderkey AS case_id, l_shipmode AS v, l_linenumber AS n, count(*) AS c FROM (SELECT *, 'm' || CAST(l_quantity AS INT) % 7 AS l_shipmode FROM {lineitem}) GROUP BY ALL),
    tt AS (SELECT l_orderkey AS case_id, l_shipmode AS v, count(*) AS c FROM (SELECT *, 'm' || CAST(l_quantity AS INT) % 7 AS l_shipmode FROM {lineitem}) GROUP BY ALL), pt AS (SELECT l_orderkey AS case_id, l_shipmode AS v, count(*) AS c FROM (SELECT *, 'm' || CAST(l_quantity AS INT) % 7 AS l_shipmode FROM {lineitem}) WHERE l_linenumber % 3 <> 0 GROUP BY ALL),
    ty AS (SELECT case_id, sum(least(coalesce(p.c, 0), coalesce(q.c, 0))) AS tp, sum(coalesce(p.c, 0)) + sum(coalesce(q.c, 0)) AS s FROM pt p FULL JOIN tt q USING (case_id, v) GROUP BY 1),
    tn AS (SELECT l_orderkey AS case_id, l_linenumber AS v, count(*) AS c FROM (SELECT *, 'm' || CAST(l_quantity AS INT) % 7 AS l_shipmode FROM {lineitem}) GROUP BY ALL), pn AS (SELECT l_orderkey AS case_id, CASE WHEN l_linenumber % 3 = 1 THEN NULL ELSE l_linenumber END AS v, count(*) AS c FROM (SELECT *, 'm' || CAST(l_quantity AS INT) % 7 AS l_shipmode FROM {lineitem}) WHERE l_linenumber % 3 <> 0 GROUP BY ALL),
    nn AS (SELECT coalesce(p.case_id, q.case_id) AS case_id, sum(least(coalesce(p.c, 0), coalesce(q.c, 0))) AS tp, sum(coalesce(p.c, 0)) + sum(coalesce(q.c, 0)) AS s FROM pn p FULL JOIN tn q ON p.case_id = q.case_id AND p.v IS NOT DISTINCT FROM q.v GROUP BY 1),
    kk AS (SELECT case_id, sum(CASE WHEN p.v IS NOT NULL AND q.v IS NOT NULL THEN 1 ELSE 0 END) AS tp, count(p.v) + count(q.v) AS s FROM pt p FULL JOIN tt q USING (case_id, v) GROUP BY 1)"""


def _moded(t):
    return t("lineitem").withColumn("l_shipmode", F.concat(F.lit("m"), F.col("l_quantity").cast("int") % 7))


def _bags(t):
    li = _moded(t)
    every = lambda rows, n: rows.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_list("l_shipmode").alias("types"), F.collect_list(F.struct(n.alias("v"))).alias("o"), F.collect_list("l_shipmode").alias("keys")).withColumn("offsets", F.col("o.v")).drop("o")
    head = lambda d, n: d.withColumns({"program_name": F.lit(" Rural Grant "), "funder_name": F.when(F.col("case_id") % n == 0, "X").otherwise("y"), "award_max": (F.col("case_id") % n).cast("long")})
    truth = head(every(li, F.col("l_linenumber")), 2)
    number = F.when(F.col("l_linenumber") % 3 != 1, F.col("l_linenumber"))
    return head(every(li.where("l_linenumber % 3 <> 0"), number), 3).withColumn("program_name", F.lit("rural grant")), truth


@query(f"""WITH {_BAGS}, f AS (SELECT c.case_id, CASE WHEN p.case_id IS NULL THEN 0 ELSE 1 + (c.case_id % 2 = 0 AND c.case_id % 3 = 0 OR c.case_id % 2 <> 0 AND c.case_id % 3 <> 0)::INT + (c.case_id % 2 = c.case_id % 3)::INT END AS h,
    coalesce(2.0 * ty.tp / ty.s, 1) AS d, coalesce(2.0 * nn.tp / nn.s, 1) AS e, coalesce(2.0 * kk.tp / kk.s, 1) AS k FROM (SELECT DISTINCT case_id FROM tt) c LEFT JOIN (SELECT DISTINCT case_id FROM pt) p USING (case_id) LEFT JOIN ty USING (case_id) LEFT JOIN nn USING (case_id) LEFT JOIN kk USING (case_id))
    SELECT case_id, round((h + d + e + k) / 6, 9) AS f1 FROM f""")
def field_match_f1(t):
    return X.field_match_f1(*_bags(t)).withColumn("f1", F.round("f1", 9))


@query("""SELECT count(*) AS n, round(avg(CASE WHEN doc_id % 12 <> 0 THEN 1.0 ELSE 0.0 END), 9) AS schema_compliance, round(avg((doc_id % 10) / 10.0 * 0.5 + 0.55), 9) AS mean_f1, avg(CASE WHEN doc_id % 12 <> 0 THEN 1.0 ELSE 0.0 END) >= 0.9 AND avg((doc_id % 10) / 10.0 * 0.5 + 0.55) >= 0.75 AS passed FROM {documents}""")
def extraction_scorecard(t):
    i = F.col("doc_id")
    return X.extraction_scorecard(t("documents").select((i % 12 != 0).alias("valid"), ((i % 10) / 10.0 * 0.5 + 0.55).alias("f1"))).withColumns({c: F.round(c, 9) for c in ("schema_compliance", "mean_f1")})


@query("""WITH p AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber = 1 THEN -1 ELSE l_linenumber END AS page, count(*) AS c FROM {lineitem} WHERE l_returnflag <> 'N' GROUP BY ALL), t AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber = 1 THEN -1 ELSE l_linenumber END AS page, count(*) AS c FROM {lineitem} WHERE l_linestatus = 'F' GROUP BY ALL),
    s AS (SELECT doc_id, CAST(sum(least(coalesce(p.c, 0), coalesce(t.c, 0))) AS BIGINT) AS tp, sum(coalesce(p.c, 0)) AS np, sum(coalesce(t.c, 0)) AS nt FROM p FULL JOIN t USING (doc_id, page) GROUP BY 1)
    SELECT doc_id, tp, round(CASE WHEN np > 0 THEN tp / np ELSE 0 END, 9) AS precision, round(CASE WHEN nt > 0 THEN tp / nt ELSE 0 END, 9) AS recall, round(CASE WHEN tp > 0 THEN 2.0 * tp / (np + nt) ELSE 0 END, 9) AS f1 FROM s""")
def table_f1(t):
    page = F.when(F.col("l_linenumber") != 1, F.col("l_linenumber")).alias("page")
    side = lambda cond: t("lineitem").where(cond).select(F.col("l_orderkey").alias("doc_id"), page)
    return X.table_f1(side("l_returnflag <> 'N'"), side("l_linestatus = 'F'")).withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def _headings(t, pos=None):
    li = _moded(t)
    pos = F.xxhash64(*li.columns) if pos is None else pos
    side = lambda rows, level: rows.select(F.col("l_orderkey").alias("doc_id"), pos.alias("pos"), F.concat(F.lit(" "), F.col("l_shipmode")).alias("text"), level.cast("int").alias("level"))
    return side(li.where("l_returnflag <> 'N'"), F.col("l_linenumber")), side(li, F.col("l_linenumber") % 3 + 1)


# expected headings of a text take the free ones of the nearest level one by one
@query("""WITH RECURSIVE li AS (SELECT l_orderkey AS doc_id, 'm' || CAST(l_quantity AS INT) % 7 AS x, l_linenumber AS n, l_returnflag <> 'N' AND x IS NOT NULL AS found FROM {lineitem}),
    g AS (SELECT doc_id, x, list(n % 3 + 1 ORDER BY n NULLS FIRST) AS want, coalesce(list(n ORDER BY n NULLS FIRST) FILTER (found), []) AS free FROM li GROUP BY ALL),
    given AS (SELECT doc_id, want, free, 1 AS i, 0 AS near FROM g UNION ALL SELECT doc_id, want, list_concat(free[:best - 1], free[best + 1:]), i + 1, near + coalesce(CAST(gap <= 1 AS INT), 0) FROM
        (SELECT *, list_min(gaps) AS gap, coalesce(list_position(gaps, list_min(gaps)), 1) AS best FROM (SELECT *, list_transform(free, lambda f: abs(f - want[i])) AS gaps FROM given WHERE i <= len(want) AND len(free) > 0))),
    s AS (SELECT doc_id, sum(i - 1) AS m, sum(near) AS w, sum(len(want)) AS n FROM given WHERE i > len(want) OR len(free) = 0 GROUP BY 1) SELECT o_orderkey AS doc_id, round(coalesce(m / n, 1.0), 9) AS exact, round(coalesce(w / n, 1.0), 9) AS within_one FROM {orders} LEFT JOIN s ON doc_id = o_orderkey""")
def heading_accuracy(t):
    pred, truth = _headings(t, F.col("l_linenumber"))
    got = X.heading_accuracy(pred, truth, t("orders").select(F.col("o_orderkey").alias("doc_id")))
    return got.withColumns({c: F.round(c, 9) for c in ("exact", "within_one")})


@query()
def heading_accuracy_within_one(t):
    pred, truth = _headings(t)
    return X.heading_accuracy(pred, truth, t("orders").select(F.col("o_orderkey").alias("doc_id")))


@query("SELECT doc_id, round(n_chars / greatest(500, 20 * (doc_id % 50) + 200 * (doc_id % 4)), 9) AS ratio FROM {documents}")
def token_efficiency(t):
    i = F.col("doc_id")
    return X.token_efficiency(t("documents").select("doc_id", "n_chars", (i % 50).alias("heading_chars"), (i % 4).alias("n_tables"))).withColumn("ratio", F.round("ratio", 9))


@query("""WITH r AS (SELECT source AS parser, CASE WHEN doc_id % 13 = 0 THEN 'timeout' WHEN doc_id % 17 = 0 THEN 'bad file' END AS error, doc_id % 3 = 0 AS ht, (doc_id % 10) / 10.0 AS f, CASE WHEN doc_id % 5 > 0 THEN n_chars ELSE 0 END AS nc, doc_id % 7 AS secs, doc_id % 4 + 1 AS pages FROM {documents})
    SELECT parser, count_if(error IS NULL) AS parsed, count_if(error IS NOT NULL) AS failed, round(avg(f) FILTER (error IS NULL AND ht), 9) AS table_f1, round(avg(f / 2) FILTER (error IS NULL AND ht), 9) AS heading, round(avg(nc / 1000.0) FILTER (error IS NULL AND nc > 0), 9) AS token_ratio,
    round(sum(secs) FILTER (error IS NULL) / sum(pages) FILTER (error IS NULL), 9) AS seconds_per_page, coalesce(string_agg(DISTINCT error, '; ' ORDER BY error), '') AS errors FROM r GROUP BY parser""")
def parser_scorecard(t):
    i = F.col("doc_id")
    error = F.when(i % 13 == 0, "timeout").when(i % 17 == 0, "bad file")
    n = F.when(i % 5 > 0, F.col("n_chars")).otherwise(0)
    rows = t("documents").select(F.col("source").alias("parser"), error.alias("error"), (i % 3 == 0).alias("has_truth"), ((i % 10) / 10.0).alias("table_f1"), ((i % 10) / 20.0).alias("heading"), n.alias("n_chars"), (n / 1000.0).alias("token_ratio"), (i % 7).cast("double").alias("seconds"), (i % 4 + 1).alias("pages"))
    return X.parser_scorecard(rows).withColumns({c: F.round(c, 9) for c in ("table_f1", "heading", "token_ratio", "seconds_per_page")})


@query("""SELECT c_custkey AS rubric_id, concat_ws('; ', CASE WHEN c_custkey % 4 = 0 THEN 'items: not 3 to 6' END, CASE WHEN c_custkey % 4 <> 0 AND c_custkey % 7 = 0 THEN 'items: repeated id' END,
    CASE WHEN c_custkey % 4 = 0 OR c_custkey % 5 = 0 THEN 'items: weights do not sum to 1' END, CASE WHEN c_custkey % 3 = 0 THEN 'items.0: fewer than 3 common failures' END) AS errors FROM {customer}""")
def validate_rubrics(t):
    k = F.col("c_custkey")
    scoring = F.array(*[F.struct(F.lit(s).alias("score"), F.lit("text").alias("desc")) for s in (0, 1, 2)])
    few = F.when(k % 3 == 0, F.array(F.lit("a"), F.lit(" "), F.lit("b"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    three = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    item = lambda name, weight, failures: F.struct(F.lit(name).alias("id"), F.lit("l").alias("label"), F.lit("d").alias("description"), weight.alias("weight"), scoring.alias("scoring"), failures.alias("common_failures"))
    last = F.when(k % 5 == 0, 0.5).otherwise(0.3)
    items = F.array(item("a", F.lit(0.3), few), item("b", F.lit(0.4), three), F.struct(F.when(k % 7 == 0, "a").otherwise("c").alias("id"), F.lit("l").alias("label"), F.lit("d").alias("description"), last.alias("weight"), scoring.alias("scoring"), three.alias("common_failures")))
    rubrics = t("customer").select(k.alias("rubric_id"), F.when(k % 4 == 0, F.slice(items, 1, 2)).otherwise(items).alias("items"))
    return X.validate_rubrics(rubrics).select("rubric_id", F.array_join("errors", "; ").alias("errors"))
