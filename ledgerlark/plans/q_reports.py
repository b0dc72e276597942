"""Queries of reports, fields, drafts and export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as H
from .registry import query
from .standins import AS_OF

_NOW = f"TIMESTAMP '{AS_OF}'"


def _now():
    return F.expr(_NOW)


def _text(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def _stamp(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


@query(f"""SELECT r.report_id, title, r.status, {_stamp('due_at')} AS due_at, program_name, coalesce(f.name, 'Unknown funder') AS funder_name, coalesce(n_fields, 0) AS n_fields, coalesce(n_approved, 0) AS n_approved
    FROM {{reports}} r JOIN {{awards}} a USING (award_id) LEFT JOIN {{funders}} f ON f.funder_id = a.funder_id LEFT JOIN (SELECT report_id, count(*) AS n_fields, count_if(human_approved) AS n_approved FROM {{report_fields}} GROUP BY 1) c ON c.report_id = r.report_id""")
def reports_dashboard(t):
    return _text(H.reports_dashboard(t("reports"), t("awards"), t("funders"), t("report_fields")), "due_at")


_DAYS = f"(epoch_us(due_at) - epoch_us({_NOW})) / 86400e6"


@query(f"SELECT count_if({_DAYS} >= 0 AND floor({_DAYS}) <= 30) AS due_soon, count_if(status = 'drafting') AS drafting, count_if(status = 'ready_for_review') AS ready_for_review FROM {{reports}}")
def report_summary(t):
    return H.report_summary(t("reports"), _now())


@query(f"""WITH d AS (SELECT report_id, x, CAST(floor(x) AS BIGINT) AS days, greatest(1, CAST(abs(ceil(x)) AS BIGINT)) AS late FROM (SELECT report_id, {_DAYS} + 0.3 * (report_id % 4) AS x FROM {{reports}}))
    SELECT report_id, days, CASE WHEN x < 0 THEN 'overdue' WHEN days <= 14 THEN 'soon' WHEN days <= 30 THEN 'upcoming' ELSE 'distant' END AS tone,
    CASE WHEN x < 0 THEN concat('Overdue by ', late, CASE WHEN late = 1 THEN ' day' ELSE ' days' END) WHEN days = 0 THEN 'Due today' ELSE concat('Due in ', days, CASE WHEN days = 1 THEN ' day' ELSE ' days' END) END AS label FROM d""")
def describe_due(t):
    shifted = F.timestamp_micros((F.unix_micros("due_at") + F.lit(25_920_000_000) * (F.col("report_id") % 4)).cast("long"))
    return H.describe_due(t("reports").withColumn("due_at", shifted), _now())


@query("SELECT report_id, field_no, CASE WHEN human_approved THEN 'approved' WHEN length(current_value) > 0 THEN 'ready_for_review' WHEN length(draft_value) > 0 THEN 'drafting' ELSE 'not_started' END AS status FROM {report_fields}")
def field_status(t):
    return H.field_status(t("report_fields"))


@query("""SELECT *, round(100.0 * approved / total, 9) AS percent, required_total > 0 AND required_total = required_approved AS all_required_approved FROM
    (SELECT report_id, count(*) AS total, count_if(human_approved) AS approved, count_if(required) AS required_total, count_if(required AND human_approved) AS required_approved FROM {report_fields} GROUP BY 1)""")
def report_progress(t):
    return H.report_progress(t("report_fields")).withColumn("percent", F.round("percent", 9))


@query("""SELECT DISTINCT 'funder' AS kind, CAST(a.funder_id AS VARCHAR) AS value, coalesce(f.name, 'Unknown funder') AS label FROM {awards} a LEFT JOIN {funders} f USING (funder_id)
    UNION ALL SELECT 'award', CAST(award_id AS VARCHAR), concat(program_name, ' (', coalesce(f.name, 'Unknown funder'), ')') FROM {awards} a LEFT JOIN {funders} f USING (funder_id)""")
def filter_options(t):
    return H.filter_options(t("awards"), t("funders"))


@query("""SELECT report_id, coalesce(b, '') AS blocking, b IS NULL AS approvable, CASE WHEN b IS NULL THEN 'ready_for_export' ELSE status END AS new_status FROM {reports} LEFT JOIN
    (SELECT report_id, string_agg(field_no, ',' ORDER BY field_no) AS b FROM {report_fields} WHERE required AND NOT human_approved GROUP BY 1) USING (report_id)""")
def approval_check(t):
    return H.approval_check(t("reports"), t("report_fields"))


@query("SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY report_id, field_no ORDER BY version DESC) AS n FROM {drafts}) WHERE n = 1")
def latest_drafts(t):
    return H.latest_drafts(t("drafts"))


@query("SELECT report_id, field_no, CAST(coalesce(max(version), 0) + 1 AS BIGINT) AS next_version FROM {report_fields} LEFT JOIN {drafts} USING (report_id, field_no) GROUP BY 1, 2")
def next_version(t):
    return H.next_version(t("report_fields"), t("drafts"))


@query("SELECT report_id, field_no, version, row_number() OVER (PARTITION BY report_id, field_no ORDER BY version DESC) AS place FROM {drafts}")
def draft_history(t):
    return H.draft_history(t("drafts")).select("report_id", "field_no", "version", "place")


@query("""WITH r AS (SELECT * FROM {reports} WHERE report_id % 50 <> 0), a AS (SELECT * FROM {awards} WHERE award_id % 37 <> 0), f AS (SELECT * FROM {funders} WHERE funder_id <> 5), t AS (SELECT * FROM {tenants} WHERE tenant_id % 29 <> 0), k AS (SELECT funder_id, string_agg(program_name, '|' ORDER BY program_name) AS programs FROM {known_programs} GROUP BY 1),
    j AS (SELECT x.report_id, x.field_no, x.label, r.award_id, a.award_id AS ha, f.funder_id AS hf, t.tenant_id AS ht, f.name AS fname, program_name, t.name AS tname, amount_usd, k.programs,
    CASE WHEN r.award_id IS NULL THEN 'report_not_found' WHEN a.award_id IS NULL THEN 'award_not_found' WHEN f.funder_id IS NULL THEN 'funder_not_found' WHEN t.tenant_id IS NULL THEN 'tenant_not_found' END AS failure
    FROM {report_fields} x LEFT JOIN r ON r.report_id = x.report_id LEFT JOIN a ON a.award_id = r.award_id LEFT JOIN f ON f.funder_id = a.funder_id LEFT JOIN k ON k.funder_id = f.funder_id LEFT JOIN t ON t.tenant_id = r.tenant_id)
    SELECT report_id, field_no, failure, CASE WHEN failure IS NULL THEN concat(fname, ' ', label) END AS query, label, concat('key_', field_no) AS key, 50 * field_no AS word_count_max, program_name, amount_usd, coalesce(amount_usd > 500000, false) AS high_stakes, fname AS funder_name,
    CASE WHEN hf % 3 = 0 THEN '["clear"]' WHEN hf IS NOT NULL THEN '[]' END AS rubric, programs AS known_programs, tname AS tenant_name FROM j""")
def draft_context(t):
    fields = t("report_fields").withColumns({"key": F.concat(F.lit("key_"), "field_no"), "word_count_max": F.lit(50) * F.col("field_no")})
    programs = t("known_programs").groupBy("funder_id").agg(F.array_join(F.sort_array(F.collect_list("program_name")), "|").alias("known_programs"))
    rubric = F.when(F.col("funder_id") % 3 == 0, '["clear"]').when(F.col("funder_id") % 3 == 1, '{"clear": 1}')
    funders = t("funders").where("funder_id <> 5").join(programs, "funder_id", "left").withColumn("rubric", rubric)
    got = H.draft_context(fields, t("reports").where("report_id % 50 <> 0"), t("awards").where("award_id % 37 <> 0"), funders, t("tenants").where("tenant_id % 29 <> 0"))
    return got.drop("field_type", "word_count_min", "org_type", "ein")


def _newest(t):
    i = F.col("report_id") + F.col("field_no")
    d = H.latest_drafts(t("drafts")).where(i % 9 != 0)
    return d.withColumns({"content": F.concat(F.lit("draft v"), "version"), "decision": F.when(i % 5 == 0, "block").otherwise("surface")})


_NEWEST = "n AS (SELECT report_id, field_no, version, eval_passed, concat('draft v', version) AS content, CASE WHEN (report_id + field_no) % 5 = 0 THEN 'block' ELSE 'surface' END AS decision FROM (SELECT *, row_number() OVER (PARTITION BY report_id, field_no ORDER BY version DESC) AS k FROM {drafts}) WHERE k = 1 AND (report_id + field_no) % 9 <> 0)"


@query(f"""WITH {_NEWEST} SELECT report_id, field_no, coalesce(eval_passed AND decision <> 'block', false) AS surfaced, CASE WHEN eval_passed AND decision <> 'block' THEN content ELSE draft_value END AS draft_value,
    CASE WHEN eval_passed AND decision <> 'block' THEN 'ready_for_review' ELSE 'idle' END AS draft_status FROM {{report_fields}} LEFT JOIN n USING (report_id, field_no)""")
def promote_drafts(t):
    return H.promote_drafts(t("report_fields"), _newest(t))


@query(f"""WITH {_NEWEST}, d AS (SELECT report_id * 10 + field_no AS draft_id, * FROM n), p AS (SELECT report_id, CASE WHEN report_id % 31 = 0 THEN 99 ELSE field_no END AS field_no, report_id * 10 + CASE WHEN report_id % 17 = 0 THEN 1 ELSE field_no END AS draft_id FROM {{report_fields}}),
    j AS (SELECT p.*, d.content, CASE WHEN x.report_id IS NULL THEN 'field_not_found' WHEN d.draft_id IS NULL OR d.report_id <> p.report_id OR d.field_no <> p.field_no THEN 'draft_not_found' WHEN NOT d.eval_passed THEN 'draft_not_surfaced' END AS reason
    FROM p LEFT JOIN {{report_fields}} x ON x.report_id = p.report_id AND x.field_no = p.field_no LEFT JOIN d ON d.draft_id = p.draft_id)
    SELECT report_id, field_no, draft_id, reason IS NULL AS applied, CASE WHEN reason IS NULL THEN content END AS current_value, reason FROM j""")
def approve_fields(t):
    drafts = _newest(t).withColumn("draft_id", F.col("report_id") * 10 + F.col("field_no")).withColumnRenamed("eval_passed", "surfaced")
    r = F.col("report_id")
    approvals = t("report_fields").select("report_id", F.when(r % 31 == 0, 99).otherwise(F.col("field_no")).alias("field_no"), (r * 10 + F.when(r % 17 == 0, 1).otherwise(F.col("field_no"))).alias("draft_id"))
    return H.approve_fields(t("report_fields"), approvals, drafts)


@query("""WITH d AS (SELECT doc_id AS draft_id, doc_id % 5 AS k, n_chars FROM {documents}) SELECT draft_id, CAST(pos AS INT) AS pos, CAST(CASE pos WHEN 0 THEN k ELSE k + 1 END AS INT) AS id, CAST(CASE WHEN pos = 0 THEN n_chars % 10 END AS INT) AS page, CASE pos WHEN 0 THEN 'e' ELSE 'q' END AS excerpt, CASE pos WHEN 0 THEN 's' ELSE 't' END AS source
    FROM d CROSS JOIN range(0, 2) r(pos)""")
def coerce_citations(t):
    k = F.col("doc_id") % 5
    json = F.concat(F.lit('[{"id":'), k, F.lit(',"page":"'), F.col("n_chars") % 10, F.lit('","excerpt":"e","source":"s"},{"id":"'), k + 1, F.lit('","page":"x","quote":"q","document_title":"t"},{"id":"[3]"},{"id":null}]'))
    return H.coerce_citations(t("documents").select(F.col("doc_id").alias("draft_id"), json.alias("citations")))


_SECT = """fx AS (SELECT *, CASE WHEN field_no % 2 = 0 THEN current_value || ' see [1] and [' || field_no || '] and [1]' END AS cv FROM {report_fields}),
    sec AS (SELECT report_id, field_no, label, CAST(row_number() OVER (PARTITION BY report_id ORDER BY required DESC, lower(label), field_no) AS INT) AS place, coalesce(nullif(trim(cv), ''), nullif(trim(draft_value), ''), '') AS body FROM fx WHERE human_approved),
    secs AS (SELECT *, CASE WHEN contains(body, '[1]') THEN CASE WHEN field_no BETWEEN 2 AND 3 THEN concat('1,', field_no) ELSE '1' END ELSE '' END AS cited_ids FROM sec)"""


def _citations(t):
    cites = t("report_fields").select("report_id", "field_no", F.posexplode(F.array(F.lit(3), F.lit(1), F.lit(2), F.lit(1))).alias("pos", "id"))
    return cites.withColumns({"page": F.col("id") * 10 + F.col("field_no") + F.col("pos"), "excerpt": F.concat(F.lit("words of field "), "field_no"), "source": F.when(F.col("id") == 1, "Letter")})


def _fields(t):
    return t("report_fields").withColumn("current_value", F.when(F.col("field_no") % 2 == 0, F.concat("current_value", F.lit(" see [1] and ["), F.col("field_no"), F.lit("] and [1]"))))


def _sections(t):
    return H.export_sections(_fields(t), _citations(t))


@query(f"WITH {_SECT} SELECT report_id, field_no, label, place, body, cited_ids FROM secs")
def export_sections(t):
    return _sections(t)


_PAY = f"""{_SECT}, ap AS (SELECT report_id, substr(max(concat('2024-0', field_no, '-1', report_id % 10, 'T00:00:00Z')), 1, 10) AS approval_date FROM {{report_fields}} WHERE human_approved GROUP BY 1),
    sl AS (SELECT report_id, string_agg(CASE WHEN body <> '' THEN concat(label, chr(10), chr(10), body) ELSE label END, chr(10) || chr(10) || '==========' || chr(10) || chr(10) ORDER BY place) AS body, count(*) AS n FROM sec GROUP BY 1),
    ci AS (SELECT report_id, 1 AS id, min_by(field_no, place) + 11 AS page, concat('words of field ', min_by(field_no, place)) AS excerpt, 'Letter' AS source FROM sec WHERE contains(body, '[1]') GROUP BY 1 UNION ALL SELECT report_id, 2, 24, 'words of field 2', NULL FROM sec WHERE contains(body, '[1]') AND field_no = 2),
    cl AS (SELECT report_id, string_agg(concat('[', id, '] p. ', page, coalesce(' — ' || source, ''), chr(10), '    "', excerpt, '"'), chr(10) ORDER BY id) AS cites, string_agg(concat_ws(':', id, page, excerpt, source), ';' ORDER BY id) AS ids FROM ci GROUP BY 1),
    pay AS (SELECT r.report_id, title, coalesce(f.name, 'Unknown funder') AS funder_name, t.name AS tenant_name, approval_date, sl.body, coalesce(n, 0) AS n, 'Citations' || chr(10) || cites AS cites, coalesce(ids, '') AS citations FROM {{reports}} r LEFT JOIN {{awards}} a USING (award_id) LEFT JOIN {{funders}} f ON f.funder_id = a.funder_id LEFT JOIN {{tenants}} t ON t.tenant_id = r.tenant_id
        LEFT JOIN ap ON ap.report_id = r.report_id LEFT JOIN sl ON sl.report_id = r.report_id LEFT JOIN cl ON cl.report_id = r.report_id WHERE r.status = 'ready_for_export')"""


def _payload(t):
    approvals = t("report_fields").where("human_approved").select("report_id", F.concat(F.lit("2024-0"), "field_no", F.lit("-1"), F.col("report_id") % 10, F.lit("T00:00:00Z")).alias("approved_at"))
    return H.export_payload(t("reports"), t("awards"), t("funders"), t("tenants"), _fields(t), approvals, _citations(t))


@query(f"WITH {_PAY} SELECT report_id, title, funder_name, tenant_name, approval_date, n AS n_sections, citations FROM pay")
def export_payload(t):
    listed = F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["id"].cast("string"), c["page"].cast("string"), c["excerpt"], c["source"])), ";")
    return _payload(t).withColumn("n_sections", F.size("sections").cast("long")).withColumn("citations", listed).drop("sections")


@query(f"""WITH {_PAY} SELECT report_id, concat_ws(chr(10) || chr(10) || '==========' || chr(10) || chr(10), concat_ws(chr(10), title, funder_name, tenant_name, concat('Approved: ', nullif(coalesce(approval_date, ''), ''))), body, cites, '{H.DISCLOSURE}') AS text FROM pay""".replace("concat('Approved: ', nullif(coalesce(approval_date, ''), ''))", "'Approved: ' || approval_date"))
def render_text(t):
    return H.render_text(_payload(t))


@query(f"WITH {_PAY} SELECT report_id, concat(replace(funder_name, ' ', '-'), '-', replace(title, ' ', '-'), '-', coalesce(approval_date, 'undated'), '.txt') AS filename FROM pay")
def export_filename(t):
    return H.export_filename(_payload(t), "txt")


@query(f"""SELECT award_id, program_name, coalesce(f.name, 'Unknown funder') AS funder_name, amount_usd, CAST(period_start AS VARCHAR) AS period_start, {_stamp('next_due')} AS next_due FROM {{awards}} a LEFT JOIN {{funders}} f USING (funder_id) LEFT JOIN (SELECT award_id, min(due_at) AS next_due FROM {{reports}} WHERE due_at >= {_NOW} GROUP BY 1) USING (award_id)""")
def awards_listing(t):
    return _text(H.awards_listing(t("awards"), t("funders"), t("reports"), _now()), "next_due").withColumn("period_start", F.col("period_start").cast("string"))


@query(f"""WITH ahead AS (SELECT * FROM {{reports}} WHERE due_at >= {_NOW}), due AS (SELECT tenant_id, count(*) AS n FROM ahead WHERE due_at <= {_NOW} + INTERVAL 14 DAY GROUP BY 1),
    fc AS (SELECT tenant_id, count(*) AS n, count_if(human_approved) AS a FROM {{report_fields}} JOIN ahead USING (report_id) GROUP BY 1), sp AS (SELECT o_custkey AS tenant_id, sum(o_orderkey % 100) AS c FROM {{orders}} WHERE date_trunc('month', CAST(o_orderdate AS DATE)) = DATE '1998-06-01' GROUP BY 1)
    SELECT tenant_id, monthly_token_budget_cents AS budget_cents, coalesce(due.n, 0) AS due_14d, coalesce(fc.n, 0) AS n_fields, coalesce(fc.a, 0) AS n_approved, CAST(coalesce(sp.c, 0) AS BIGINT) AS spent_cents, (SELECT count(*) FROM {{orders}} WHERE o_orderdate > {_NOW} - INTERVAL 7 DAY AND o_orderdate <= {_NOW}) AS new_opportunities
    FROM {{tenants}} LEFT JOIN due USING (tenant_id) LEFT JOIN fc USING (tenant_id) LEFT JOIN sp USING (tenant_id)""")
def dashboard_cards(t):
    o = t("orders")
    usage = o.select(F.col("o_custkey").alias("tenant_id"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 100).alias("cents"))
    return H.dashboard_cards(t("tenants"), t("reports"), t("report_fields"), usage, o.select(F.col("o_orderdate").cast("timestamp").alias("created_at")), _now())
