"""Reports, fields and drafts: dashboards, progress, approval, drafting requests and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Fixed values.
UNKNOWN_FUNDER, HIGH_STAKES_USD, SECTION_RULE = "Unknown funder", 500_000, "\n\n==========\n\n"
DISCLOSURE = "This report holds generated content that a person reviewed, approved and signed."
APPROVABLE = "ready_for_export"


def _filled(c: str) -> Column:
    """A column with blank text as null."""
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def reports_dashboard(reports: DataFrame, awards: DataFrame, funders: DataFrame, fields: DataFrame, award_id=None, status=None, funder_id=None) -> DataFrame:
    """Reports with program, funder and field counts, by due date."""
    rows = reports.select("report_id", "award_id", "title", "due_at", "status").join(awards.select("award_id", "funder_id", "program_name"), "award_id")
    for column, value in (("award_id", award_id), ("status", status), ("funder_id", funder_id)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows.join(funders.select("funder_id", F.col("name").alias("funder_name")), "funder_id", "left")
    counts = fields.groupBy("report_id").agg(F.count("*").alias("n_fields"), F.count_if("human_approved").alias("n_approved"))
    rows = rows.join(counts, "report_id", "left")
    zero = F.lit(0).cast("long")
    return rows.select(
        "report_id", "title", "status", "due_at", "program_name", F.coalesce("funder_name", F.lit(UNKNOWN_FUNDER)).alias("funder_name"), F.coalesce("n_fields", zero).alias("n_fields"), F.coalesce("n_approved", zero).alias("n_approved")
    ).orderBy("due_at", "report_id")


def _days(due: Column, as_of: Column) -> Column:
    return (F.unix_micros(due) - F.unix_micros(as_of)) / 86_400e6


def report_summary(reports: DataFrame, as_of: Column) -> DataFrame:
    """Counts of reports due within 30 days and not overdue, in drafting, and ready for review."""
    days = _days(F.col("due_at"), as_of)
    return reports.agg(F.count_if((days >= 0) & (F.floor(days) <= 30)).alias("due_soon"), F.count_if(F.col("status") == "drafting").alias("drafting"), F.count_if(F.col("status") == "ready_for_review").alias("ready_for_review"))


def describe_due(reports: DataFrame, as_of: Column) -> DataFrame:
    """(report_id, days, tone, label) of due dates."""
    exact = _days(F.col("due_at"), as_of)
    days = F.floor(exact)
    late = F.greatest(F.lit(1), F.abs(F.ceil(exact)))
    named = lambda n: F.concat(n.cast("string"), F.when(n == 1, " day").otherwise(" days"))
    label = F.when(exact < 0, F.concat(F.lit("Overdue by "), named(late))).when(days == 0, "Due today").otherwise(F.concat(F.lit("Due in "), named(days)))
    tone = F.when(exact < 0, "overdue").when(days <= 14, "soon").when(days <= 30, "upcoming").otherwise("distant")
    return reports.select("report_id", days.cast("long").alias("days"), tone.alias("tone"), label.alias("label"))


def field_status(fields: DataFrame) -> DataFrame:
    status = F.when(F.col("human_approved"), "approved").when(F.length("current_value") > 0, "ready_for_review").when(F.length("draft_value") > 0, "drafting").otherwise("not_started")
    return fields.select("report_id", "field_no", status.alias("status"))


def report_progress(fields: DataFrame) -> DataFrame:
    """Approved share overall and of required fields; "all required" needs one."""
    good, need = F.col("human_approved"), F.col("required")
    rows = fields.groupBy("report_id").agg(F.count("*").alias("total"), F.count_if(good).alias("approved"), F.count_if(need).alias("required_total"), F.count_if(need & good).alias("required_approved"))
    percent = F.when(F.col("total") > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 * F.col("approved") / F.col("total")))).otherwise(0.0)
    return rows.withColumns({"percent": percent, "all_required_approved": (F.col("required_total") > 0) & (F.col("required_total") == F.col("required_approved"))})


def filter_options(awards: DataFrame, funders: DataFrame) -> DataFrame:
    """(kind, value, label) of the dashboard's filters, by kind and label."""
    rows = awards.join(funders.select("funder_id", F.col("name").alias("funder_name")), "funder_id", "left").withColumn("funder_name", F.coalesce("funder_name", F.lit(UNKNOWN_FUNDER)))
    by_funder = rows.select(F.lit("funder").alias("kind"), F.col("funder_id").cast("string").alias("value"), F.col("funder_name").alias("label")).distinct()
    by_award = rows.select(F.lit("award").alias("kind"), F.col("award_id").cast("string").alias("value"), F.concat("program_name", F.lit(" ("), "funder_name", F.lit(")")).alias("label"))
    return by_funder.unionByName(by_award).orderBy("kind", "label", "value")


def approval_check(reports: DataFrame, fields: DataFrame) -> DataFrame:
    """(report_id, blocking, approvable, new_status): required fields without approval block; a report without required fields doesn't."""
    blockers = fields.where(F.col("required") & ~F.coalesce("human_approved", F.lit(False))).groupBy("report_id").agg(F.sort_array(F.collect_list("field_no")).alias("blocking"))
    rows = reports.select("report_id", "status").join(blockers, "report_id", "left")
    ok = F.col("blocking").isNull()
    return rows.select("report_id", F.coalesce(F.array_join("blocking", ","), F.lit("")).alias("blocking"), ok.alias("approvable"), F.when(ok, APPROVABLE).otherwise(F.col("status")).alias("new_status"))


def latest_drafts(drafts: DataFrame) -> DataFrame:
    """The draft of the highest version per field; a null version counts 0, a null field is skipped, of equal versions the greatest row counts."""
    rows = drafts.where("field_no IS NOT NULL")
    newest = rows.groupBy("report_id", "field_no").agg(F.max_by(F.struct(*rows.columns), F.struct(F.coalesce("version", F.lit(0)), F.struct(*rows.columns))).alias("d"))
    return newest.select("d.*")


def next_version(fields: DataFrame, drafts: DataFrame) -> DataFrame:
    last = drafts.groupBy("report_id", "field_no").agg(F.max("version").alias("last"))
    return fields.select("report_id", "field_no").join(last, ["report_id", "field_no"], "left").select("report_id", "field_no", (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("next_version"))


def draft_history(drafts: DataFrame) -> DataFrame:
    """All drafts with ``place``, 1 being the newest of its field; equal versions go by a hash of the row."""
    order = Window.partitionBy("report_id", "field_no").orderBy(F.desc("version"), F.xxhash64(*drafts.columns))
    return drafts.withColumn("place", F.row_number().over(order))


def _given(df: DataFrame, kinds: dict[str, str]) -> list[Column]:
    """Columns that ``df`` may lack; they are null then."""
    return [(F.col(c) if c in df.columns else F.lit(None).cast(kind)).alias(c) for c, kind in kinds.items()]


def draft_context(fields: DataFrame, reports: DataFrame, awards: DataFrame, funders: DataFrame, tenants: DataFrame) -> DataFrame:
    """All of a field's drafting request, or the first broken link as ``failure``.

    An award of another tenant than the report's isn't found.  A funder's ``rubric`` is JSON text; what is no array counts as an empty one.
    Its ``known_programs`` are of any type and come through as they are."""
    bounds, org = {"key": "string", "field_type": "string", "word_count_min": "int", "word_count_max": "int"}, {"org_type": "string", "ein": "string"}
    # reports are fewer than fields: their links are followed first, so that fields are shuffled for the report and the funder only
    due = reports.select("report_id", F.col("award_id").alias("r_award"), F.col("tenant_id").alias("r_tenant"), F.lit(True).alias("has_report"))
    a = awards.select(F.col("award_id").alias("r_award"), F.col("tenant_id").alias("r_tenant"), "funder_id", "amount_usd", "program_name", F.lit(True).alias("has_award"))
    due = due.join(a, ["r_award", "r_tenant"], "left")
    due = due.join(tenants.select(F.col("tenant_id").alias("r_tenant"), F.col("name").alias("tenant_name"), *_given(tenants, org), F.lit(True).alias("has_tenant")), "r_tenant", "left")
    rows = fields.select("report_id", "field_no", "label", *_given(fields, bounds)).join(due, "report_id", "left")
    # last, as a funder's list of programs may be long: no field is shuffled with one
    rows = rows.join(funders.select("funder_id", F.col("name").alias("funder_name"), *_given(funders, {"rubric": "string", "known_programs": "array<string>"}), F.lit(True).alias("has_funder")), "funder_id", "left")
    failure = F.when(F.col("has_report").isNull(), "report_not_found").when(F.col("has_award").isNull(), "award_not_found").when(F.col("has_funder").isNull(), "funder_not_found").when(F.col("has_tenant").isNull(), "tenant_not_found")
    query = F.trim(F.regexp_replace(F.concat_ws(" ", "funder_name", "label"), r"\s+", " "))
    rubric = F.when(F.json_array_length("rubric").isNotNull(), F.col("rubric")).otherwise("[]")
    return rows.select(
        "report_id", "field_no", failure.alias("failure"), F.when(failure.isNull(), query).alias("query"), "label", *bounds, "program_name", "amount_usd", F.coalesce(F.col("amount_usd") > HIGH_STAKES_USD, F.lit(False)).alias("high_stakes"),
        "funder_name", F.when(F.col("has_funder"), rubric).alias("rubric"), "known_programs", "tenant_name", *org,
    )


def promote_drafts(fields: DataFrame, drafts: DataFrame) -> DataFrame:
    """Fields after their newest drafts (content, eval_passed, decision): surfaced content replaces the draft value."""
    rows = fields.join(drafts.select("report_id", "field_no", "content", "eval_passed", "decision"), ["report_id", "field_no"], "left")
    shown = F.coalesce(F.col("eval_passed") & (F.col("decision") != "block"), F.lit(False))
    return rows.select("report_id", "field_no", shown.alias("surfaced"), F.when(shown, F.col("content")).otherwise(F.col("draft_value")).alias("draft_value"), F.when(shown, "ready_for_review").otherwise("idle").alias("draft_status"))


def approve_fields(fields: DataFrame, approvals: DataFrame, drafts: DataFrame) -> DataFrame:
    """One row per approval: applied with the content that becomes the current value, or a reason."""
    d = drafts.select(F.col("draft_id").alias("d_id"), F.col("report_id").alias("d_report"), F.col("field_no").alias("d_field"), "content", "surfaced")
    rows = approvals.join(fields.select("report_id", "field_no", F.lit(True).alias("has_field")), ["report_id", "field_no"], "left").join(d, F.col("draft_id") == F.col("d_id"), "left")
    theirs = (F.col("d_report") == F.col("report_id")) & (F.col("d_field") == F.col("field_no"))
    reason = F.when(F.col("has_field").isNull(), "field_not_found").when(~F.coalesce(theirs, F.lit(False)), "draft_not_found").when(~F.coalesce("surfaced", F.lit(False)), "draft_not_surfaced")
    return rows.select("report_id", "field_no", "draft_id", reason.isNull().alias("applied"), F.when(reason.isNull(), F.col("content")).alias("current_value"), reason.alias("reason"))


def coerce_citations(drafts: DataFrame, accept_brackets: bool = False) -> DataFrame:
    """(draft_id, pos, id, page, excerpt, source) from a JSON list; ids that are no integers drop out."""
    rows = drafts.select("draft_id", F.posexplode(F.from_json("citations", "array<map<string,string>>")).alias("pos", "c"))
    c = lambda k: F.col("c")[k]
    key = F.regexp_replace(c("id"), r"^\[|\]$", "") if accept_brackets else c("id")
    whole = lambda x: F.when(F.trim(x).rlike(r"^[+-]?\d+$"), F.trim(x).try_cast("int"))
    text = lambda *names: F.coalesce(*[F.nullif(c(n), F.lit("")) for n in names], F.lit(""))
    return rows.select("draft_id", "pos", whole(key).alias("id"), whole(c("page")).alias("page"), text("excerpt", "quote").alias("excerpt"), text("source", "document_title").alias("source")).where("id IS NOT NULL")


def export_sections(fields: DataFrame, citations: DataFrame) -> DataFrame:
    """Approved fields with body, place, and the ids they cite (first of an id, ascending, cited in the body only)."""
    body = F.coalesce(_filled("current_value"), _filled("draft_value"), F.lit(""))
    rows = fields.where("human_approved").withColumn("body", body)
    order = Window.partitionBy("report_id").orderBy(F.desc("required"), F.lower("label"), "field_no")
    rows = rows.withColumn("place", F.row_number().over(order)).select("report_id", "field_no", "label", "place", "body")
    refs = F.transform(F.regexp_extract_all("body", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda r: r.try_cast("int").cast(dict(citations.dtypes)["id"]))
    known = citations.groupBy("report_id", "field_no").agg(F.array_sort(F.collect_set("id")).alias("known"))
    ids = F.array_join(F.transform(F.filter("known", lambda x: F.coalesce(F.array_contains(refs, x), F.lit(False))), lambda x: x.cast("string")), ",")
    return rows.join(known, ["report_id", "field_no"], "left").withColumn("cited_ids", F.coalesce(ids, F.lit(""))).drop("known")


def _cited_once(sections: str, citations: str) -> Column:
    """Of a report's citations (field_no, id, pos, page, excerpt, source), those that the body of their own section cites, by id; of an id the first section's."""
    ids = lambda body: F.transform(F.array_distinct(F.regexp_extract_all(body, F.lit(r"\[(\d+)\]"), F.lit(1))), lambda r: r.try_cast("int"))
    refs = F.transform(sections, lambda s: F.struct(s["field_no"].alias("field_no"), s["place"].alias("place"), ids(s["body"]).alias("ids")))
    place = lambda c: F.get(F.filter(refs, lambda r: (r["field_no"] == c["field_no"]) & F.coalesce(F.array_contains(r["ids"], c["id"]), F.lit(False))), F.lit(0))["place"]
    known = F.filter(citations, lambda c: c["id"].isNotNull())
    found = F.transform(known, lambda c: F.struct(c["id"].alias("id"), place(c).alias("place"), c["pos"].alias("pos"), c["page"].alias("page"), c["excerpt"].alias("excerpt"), c["source"].alias("source")))
    # sorted by id, place and pos: each id's first row is what the report shows
    ordered = F.array_sort(F.filter(found, lambda c: c["place"].isNotNull()))
    once = F.transform(F.array(ordered), lambda x: F.filter(x, lambda c, i: (i == 0) | (F.get(x, i - 1)["id"] != c["id"])))
    return F.transform(F.get(once, F.lit(0)), lambda c: F.struct(c["id"].alias("id"), c["page"].alias("page"), c["excerpt"].alias("excerpt"), c["source"].alias("source")))


def export_payload(reports: DataFrame, awards: DataFrame, funders: DataFrame, tenants: DataFrame, fields: DataFrame, approvals: DataFrame, citations: DataFrame) -> DataFrame:
    """One row per report ready for export: names, latest approval date, ordered sections as in ``export_sections``, and its citations by id.

    Only the fields and citations of these reports are gathered, each once; the rest is done within a report's lists."""
    ready = reports.where(F.col("status") == APPROVABLE).select("report_id", "award_id", "tenant_id", "title")
    ids = ready.select("report_id")
    body = F.coalesce(_filled("current_value"), _filled("draft_value"), F.lit(""))
    by_place = F.struct(F.coalesce(~F.col("required"), F.lit(True)).alias("optional"), F.lower("label").alias("low"), "field_no", "label", body.alias("body"))
    listed = fields.where("human_approved").join(ids, "report_id", "left_semi").groupBy("report_id").agg(F.sort_array(F.collect_list(by_place)).alias("rows"))
    cited = citations.join(ids, "report_id", "left_semi").groupBy("report_id").agg(F.collect_list(F.struct("field_no", "id", "pos", "page", "excerpt", "source")).alias("cites"))
    dated = approvals.join(ids, "report_id", "left_semi").groupBy("report_id").agg(F.substring(F.max("approved_at"), 1, 10).alias("approval_date"))
    rows = ready.join(dated, "report_id", "left").join(listed, "report_id", "left").join(cited, "report_id", "left")
    rows = rows.join(awards.select("award_id", "funder_id"), "award_id", "left").join(funders.select("funder_id", F.col("name").alias("funder_name")), "funder_id", "left").join(tenants.select("tenant_id", F.col("name").alias("tenant_name")), "tenant_id", "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(dict(rows.dtypes)[c]))
    rows = rows.withColumns({"placed": F.transform(none("rows"), lambda s, i: F.struct((i + 1).alias("place"), s["field_no"].alias("field_no"), s["label"].alias("label"), s["body"].alias("body"))), "cites": none("cites")})
    sections = F.transform("placed", lambda s: F.struct(s["place"].alias("place"), s["label"].alias("label"), s["body"].alias("body")))
    return rows.select("report_id", "title", F.coalesce(_filled("funder_name"), F.lit(UNKNOWN_FUNDER)).alias("funder_name"), "tenant_name", "approval_date", sections.alias("sections"), _cited_once("placed", "cites").alias("citations"))


def render_text(payload: DataFrame) -> DataFrame:
    """(report_id, text): header, sections, citations (if any) and the disclosure, parted by rules."""
    head = F.concat_ws("\n", "title", "funder_name", _filled("tenant_name"), F.concat(F.lit("Approved: "), F.nullif("approval_date", F.lit(""))))
    parts = F.transform("sections", lambda s: F.when(s["body"] != "", F.concat(s["label"], F.lit("\n\n"), s["body"])).otherwise(s["label"]))
    after = lambda start, c, end="": F.coalesce(F.concat(F.lit(start), F.nullif(F.trim(c), F.lit("")), F.lit(end)), F.lit(""))
    page = lambda c: F.coalesce(F.concat(F.lit("p. "), c["page"]), F.lit("no page"))
    lines = F.transform("citations", lambda c: F.concat(F.lit("["), c["id"], F.lit("] "), page(c), after(" — ", c["source"]), after('\n    "', c["excerpt"], '"')))
    cites = F.when(F.size(lines) > 0, F.concat(F.lit("Citations\n"), F.array_join(lines, "\n")))
    blocks = F.concat(F.array(head), parts, F.array_compact(F.array(cites)), F.array(F.lit(DISCLOSURE)))
    return payload.select("report_id", F.array_join(blocks, SECTION_RULE).alias("text"))


def _slug(c: Column, fallback: str) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9._-]+", "-"), F.lit("-")), F.lit("")), F.lit(fallback))


def export_filename(payload: DataFrame, extension: str) -> DataFrame:
    name = F.concat_ws("-", _slug(F.col("funder_name"), "funder"), _slug(F.col("title"), "report"), _slug(F.col("approval_date"), "undated"))
    return payload.select("report_id", F.concat(name, F.lit(f".{extension}")).alias("filename"))


def awards_listing(awards: DataFrame, funders: DataFrame, reports: DataFrame, as_of: Column) -> DataFrame:
    """Awards with funder and next report due, newest first."""
    due = reports.where(F.col("due_at") >= as_of).groupBy("award_id").agg(F.min("due_at").alias("next_due"))
    rows = awards.join(funders.select("funder_id", F.col("name").alias("funder_name")), "funder_id", "left").join(due, "award_id", "left")
    return rows.select("award_id", "program_name", F.coalesce("funder_name", F.lit(UNKNOWN_FUNDER)).alias("funder_name"), "amount_usd", "period_start", "next_due").orderBy(F.desc("period_start"), "award_id")


def dashboard_cards(tenants: DataFrame, reports: DataFrame, fields: DataFrame, usage: DataFrame, opportunities: DataFrame, as_of: Column) -> DataFrame:
    """Per tenant: reports due in 14 days, approved and all fields of upcoming reports, the month's spend and budget, and this week's new opportunities (of all)."""
    ahead = reports.where(F.col("due_at") >= as_of)
    due = ahead.where(F.col("due_at") <= as_of + F.expr("INTERVAL 14 DAYS")).groupBy("tenant_id").agg(F.count("*").alias("due_14d"))
    counts = fields.join(ahead.select("report_id", "tenant_id"), "report_id").groupBy("tenant_id").agg(F.count("*").alias("n_fields"), F.count_if("human_approved").alias("n_approved"))
    spent = usage.where(F.date_trunc("month", "day") == F.date_trunc("month", as_of)).groupBy("tenant_id").agg(F.sum("cents").alias("spent_cents"))
    new = opportunities.agg(F.count_if((F.col("created_at") > as_of - F.expr("INTERVAL 7 DAYS")) & (F.col("created_at") <= as_of)).alias("new_opportunities"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = tenants.select("tenant_id", F.col("monthly_token_budget_cents").alias("budget_cents")).join(due, "tenant_id", "left").join(counts, "tenant_id", "left").join(spent, "tenant_id", "left")
    return rows.join(F.broadcast(new)).select("tenant_id", "budget_cents", zero("due_14d"), zero("n_fields"), zero("n_approved"), zero("spent_cents"), "new_opportunities")
