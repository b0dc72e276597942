"""Queries of tenants, audit and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tenancy as J
from .registry import query

_CENTS = "CAST(floor((tokens_in * 3 + tokens_out * 15) / 10000) AS BIGINT)"


def _cents():
    return F.floor((F.col("tokens_in") * 3 + F.col("tokens_out") * 15) / 10000).cast("long")


def _stamp(df, c="created_at"):
    return df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))


@query("SELECT chunk_id, tenant_id, funder_id FROM {chunks} WHERE tenant_id = 7 OR tenant_id IS NULL")
def tenant_view(t):
    return J.tenant_view(t("chunks").drop("content", "document_id"), 7, shared=True)


@query("SELECT report_id, tenant_id FROM {reports} WHERE false")
def tenant_view_without_tenant(t):
    return J.tenant_view(t("reports").select("report_id", "tenant_id"), None)


@query("""SELECT 'reports_awards' AS link, count(*) AS n_rows, count_if(r.tenant_id <> a.tenant_id) AS n_leaks FROM {reports} r JOIN {awards} a USING (award_id)
    UNION ALL SELECT 'deadlines_reports', count(*), count_if(CASE WHEN deadline_id % 100 = 0 THEN d.tenant_id + 1 ELSE d.tenant_id END <> r.tenant_id) FROM {deadlines} d JOIN {reports} r ON r.report_id = d.source_id""")
def isolation_report(t):
    leaky = t("deadlines").withColumn("tenant_id", F.when(F.col("deadline_id") % 100 == 0, F.col("tenant_id") + 1).otherwise(F.col("tenant_id")))
    return J.isolation_report({"reports_awards": (t("reports"), t("awards"), "award_id", "award_id"), "deadlines_reports": (leaky, t("reports"), "source_id", "report_id")})


@query("SELECT id, tenant_id, action, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM {audit_log} WHERE action = 'click' AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-20'")
def audit_report(t):
    return _stamp(J.audit_report(t("audit_log"), action="click", since=F.expr("TIMESTAMP '2024-01-05'"), until=F.expr("TIMESTAMP '2024-01-20'")).drop("metadata"))


@query("SELECT id, tenant_id, tenant_id % 7 AS user_id, action, metadata FROM {audit_log} WHERE tenant_id % 7 = 3")
def audit_csv(t):
    from .q_sources import _new_dir

    audit = t("audit_log").withColumn("user_id", F.col("tenant_id") % 7)
    path = _new_dir(audit.sparkSession) + "/audit"
    J.write_audit_csv(J.audit_report(audit, user_id=3), path)
    return audit.sparkSession.read.schema(audit.schema).option("header", True).option("escape", '"').csv(path).drop("created_at")


_DAILY = f"daily AS (SELECT tenant_id, CAST(ts AS DATE) AS day, model, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, CAST(sum({_CENTS}) AS BIGINT) AS cents FROM {{llm_calls}} GROUP BY ALL)"


@query(f"WITH {_DAILY} SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM daily")
def token_usage_daily(t):
    return J.token_usage_daily(t("llm_calls"), _cents()).withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {_DAILY}, s AS (SELECT tenant_id, sum(cents) AS spent FROM daily WHERE strftime(day, '%Y-%m') = '2024-01' GROUP BY 1), b AS (SELECT tenant_id, 20 AS budget, CAST(coalesce(spent, 0) AS BIGINT) AS spent FROM {{tenants}} LEFT JOIN s USING (tenant_id))
    SELECT *, round(spent / budget, 9) AS share, CASE WHEN spent >= budget THEN 'capped' WHEN spent / budget >= 0.8 THEN 'alert' ELSE 'ok' END AS status FROM b""")
def budget_status(t):
    tenants = t("tenants").withColumn("monthly_token_budget_cents", F.lit(20))
    return J.budget_status(J.token_usage_daily(t("llm_calls"), _cents()), tenants, "2024-01").withColumn("share", F.round("share", 9))


@query("""SELECT 'audit_log' AS name, count(*) AS n FROM {audit_log} WHERE tenant_id % 50 <> 0 UNION ALL SELECT 'reports', count(*) FROM {reports} WHERE tenant_id % 50 <> 0
    UNION ALL SELECT 'receipt', count(*) FROM {tenants} WHERE tenant_id % 50 = 0""")
def delete_tenant(t):
    gone = t("tenants").where("tenant_id % 50 = 0").select("tenant_id")
    left = J.delete_tenant({"audit_log": t("audit_log"), "reports": t("reports")}, gone, "audit_log", F.expr("TIMESTAMP '2024-02-01'"))
    out = None
    for name, df in left.items():
        part = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


_TREE = "sha256(string_agg(h, '' ORDER BY place, h))"


@query(f"""WITH leaf AS (SELECT tenant_id, sha256(concat_ws(chr(31), coalesce(action, chr(0)), CAST(created_at AS VARCHAR), CAST(id AS VARCHAR), coalesce(metadata, chr(0)), CAST(tenant_id AS VARCHAR))) AS h FROM {{audit_log}} WHERE tenant_id % 50 = 0),
    a AS (SELECT tenant_id, substr(place, 1, 6) AS place, {_TREE} AS h, count(*) AS n FROM (SELECT *, h AS place FROM leaf) GROUP BY ALL), b AS (SELECT tenant_id, substr(place, 1, 3) AS p, {_TREE} AS h, sum(n) AS n FROM a GROUP BY ALL),
    c AS (SELECT tenant_id, {_TREE} AS h, sum(n) AS n FROM (SELECT tenant_id, p AS place, h, n FROM b) GROUP BY ALL)
    SELECT tenant_id, CAST(coalesce(n, 0) AS BIGINT) AS n_audit, h AS audit_sha256 FROM (SELECT tenant_id FROM {{tenants}} WHERE tenant_id % 50 = 0) LEFT JOIN c USING (tenant_id)""")
def delete_tenant_receipt(t):
    gone = t("tenants").where("tenant_id % 50 = 0").select("tenant_id")
    return J.delete_tenant({"audit_log": t("audit_log")}, gone, "audit_log", F.expr("TIMESTAMP '2024-02-01'"))["receipt"].drop("deleted_at")


@query("""SELECT tenant_id, CAST(f AS INT) AS funder_id FROM {tenants} CROSS JOIN range(0, 3) r(f) WHERE tenant_id % 5 <> 0
    UNION ALL SELECT tenant_id, CAST(7 AS INT) FROM {tenants} WHERE tenant_id % 10 = 0 UNION ALL SELECT tenant_id, CAST(8 AS INT) FROM {tenants} WHERE tenant_id % 10 = 0""")
def replace_subscriptions(t):
    current = t("tenants").select("tenant_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("funder_id"))
    none = F.array().cast("array<int>")
    submitted = t("tenants").where("tenant_id % 5 = 0").select("tenant_id", F.when(F.col("tenant_id") % 10 == 0, F.array(F.lit(7), F.lit(8), F.lit(8))).otherwise(none).alias("funder_ids"))
    return J.replace_subscriptions(current, submitted)




def _events(t):
    k = F.col("event_id") % 7
    kinds = F.when(k == 0, "organization.created").when(k == 1, "organization.updated").when(k == 2, "organization.deleted").when(k <= 4, "user.updated").when(k == 5, "membership.created").otherwise("membership.deleted")
    return t("events").select(
        "event_id", F.col("ts").alias("at"), kinds.alias("kind"), (F.col("user_id") % 200).alias("org_id"), (F.col("user_id") % 150).alias("user_id"), F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("org "), F.col("event_id"))).alias("name"), F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("o-"), F.col("event_id"))).alias("slug"),
        F.when(k == 3, F.array(F.concat(F.lit("u"), F.col("event_id"), F.lit("@example.org")))).otherwise(F.array().cast("array<string>")).alias("emails"), F.lit("A").alias("first_name"), F.when(k == 3, F.lit(" ")).otherwise(F.lit("B")).alias("last_name"), F.when(F.col("event_id") % 2 == 0, "org:admin").otherwise("").alias("role"),
    )


def _membership(t):
    orgs = t("tenants").where("tenant_id < 30").select(F.col("tenant_id").alias("org_id"), "name", F.lit("old").alias("slug"), F.expr("CASE tenant_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'paused' ELSE 'churned' END").alias("status"))
    users = t("tenants").where("tenant_id < 40").select(F.col("tenant_id").alias("user_id"), F.lit("old@example.org").alias("email"), "name")
    members = t("tenants").where("tenant_id < 20").select(F.col("tenant_id").alias("org_id"), F.col("tenant_id").alias("user_id"), F.lit("viewer").alias("role"))
    return J.apply_membership_events(orgs, users, members, _events(t))


_E = "e AS (SELECT event_id, ts AS tm, (ts, event_id) AS seq, user_id % 200 AS org_id, user_id % 150 AS user_id, event_id % 7 AS k FROM {events})"
_ORGS = f"""{_E}, old AS (SELECT tenant_id AS org_id, name, 'old' AS slug, CASE tenant_id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'paused' ELSE 'churned' END AS status FROM {{tenants}} WHERE tenant_id < 30),
    made AS (SELECT org_id, min(seq) AS made FROM e WHERE k = 0 GROUP BY 1), known AS (SELECT coalesce(o.org_id, m.org_id) AS org_id, CASE WHEN o.org_id IS NULL THEN made END AS since FROM old o FULL JOIN made m USING (org_id)),
    c AS (SELECT e.* FROM e JOIN known USING (org_id) WHERE k < 3 AND (since IS NULL OR seq >= since)), gone AS (SELECT DISTINCT org_id FROM c WHERE k = 2),
    nm AS (SELECT org_id, arg_max(CASE WHEN event_id % 5 <> 0 THEN 'org ' || event_id WHEN k = 0 THEN 'Unnamed Organization' ELSE '' END, seq) AS nn, arg_max(CASE WHEN event_id % 3 <> 0 THEN 'o-' || event_id ELSE CAST(org_id AS VARCHAR) END, seq) AS ns FROM c WHERE k < 2 GROUP BY 1),
    orgs AS (SELECT org_id, coalesce(nn, name) AS name, coalesce(ns, slug) AS slug, CASE WHEN gone.org_id IS NOT NULL THEN 'churned' ELSE coalesce(status, 'active') END AS status FROM known LEFT JOIN old USING (org_id) LEFT JOIN nm USING (org_id) LEFT JOIN gone USING (org_id))"""
_USERS = """us AS (SELECT user_id, arg_max(CASE WHEN k = 3 THEN 'u' || event_id || '@example.org' ELSE '' END, (tm, event_id)) AS email, arg_max(CASE WHEN k = 3 THEN 'A' ELSE 'A B' END, (tm, event_id)) AS name FROM e WHERE k IN (3, 4) GROUP BY 1),
    users AS (SELECT user_id, CASE WHEN us.user_id IS NULL THEN 'old@example.org' ELSE us.email END AS email, coalesce(us.name, o.name) AS name FROM us FULL JOIN (SELECT tenant_id AS user_id, name FROM {tenants} WHERE tenant_id < 40) o USING (user_id))"""


@query(f"WITH {_ORGS} SELECT * FROM orgs")
def apply_membership_events(t):
    return _membership(t)["orgs"]


@query(f"WITH {_E}, {_USERS} SELECT * FROM users".replace("CASE WHEN us.user_id IS NULL THEN 'old@example.org' ELSE us.email END AS email", "coalesce(us.email, 'old@example.org') AS email"))
def apply_user_events(t):
    return _membership(t)["users"]


@query(f"""WITH {_ORGS}, {_USERS}, seen AS (SELECT coalesce(o.tenant_id, m.user_id) AS user_id, CASE WHEN o.tenant_id IS NULL THEN made END AS u_since FROM (SELECT tenant_id FROM {{tenants}} WHERE tenant_id < 40) o FULL JOIN (SELECT user_id, min(seq) AS made FROM e WHERE k IN (3, 4) GROUP BY 1) m ON o.tenant_id = m.user_id),
    ok AS (SELECT org_id, user_id, arg_max(k, seq) AS k, arg_max(event_id, seq) AS id FROM e JOIN known USING (org_id) JOIN seen USING (user_id) WHERE k >= 5 AND (since IS NULL OR seq > since) AND (u_since IS NULL OR seq > u_since) GROUP BY 1, 2), old_m AS (SELECT tenant_id AS org_id, tenant_id AS user_id FROM {{tenants}} WHERE tenant_id < 20)
    SELECT org_id, user_id, CASE WHEN id % 2 = 0 THEN 'admin' ELSE 'editor' END AS role FROM ok WHERE k = 5 UNION ALL SELECT org_id, user_id, 'viewer' FROM old_m ANTI JOIN ok USING (org_id, user_id)""")
def apply_member_events(t):
    return _membership(t)["members"]


@query("""SELECT 'status_enum' AS rule, count_if(status IN ('submitted', 'accepted')) AS n_violations FROM {reports} UNION ALL SELECT 'due_not_null', count_if(due_at IS NULL) FROM {reports}
    UNION ALL SELECT 'unique_draft', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM {lineitem} GROUP BY ALL HAVING count(*) > 1)) UNION ALL SELECT 'field_report', (SELECT count(*) FROM {report_fields} WHERE report_id NOT IN (SELECT report_id FROM {reports} WHERE report_id % 10 <> 0))""")
def constraint_report(t):
    reports = t("reports")
    checks = {"status_enum": F.col("status").isin("submitted", "accepted"), "due_not_null": F.col("due_at").isNull()}
    return J.constraint_report(checks, {"unique_draft": (t("lineitem"), ["l_orderkey", "l_linenumber"])}, {"field_report": (t("report_fields"), "report_id", reports.where("report_id % 10 <> 0"), "report_id")}, reports)
