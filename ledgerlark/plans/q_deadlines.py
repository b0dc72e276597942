"""Queries of deadlines and reminders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deadlines as I
from .registry import query
from .standins import AS_OF

_NOW = f"TIMESTAMP '{AS_OF}'"
_LEFT = f"(epoch_us(d.due_at) - epoch_us({_NOW})) / 86400e6"
_FLAGS = [flag for _, flag, _ in I.THRESHOLDS] + [I.SMS_FLAG]


def _now():
    return F.expr(_NOW)


def _due(df):
    return df.withColumn("due_at", F.date_format("due_at", "yyyy-MM-dd HH:mm:ss"))


@query("""SELECT tenant_id, source_type, source_id, strftime(due_at, '%Y-%m-%d %H:%M:%S') AS due_at, false AS acknowledged FROM (
    SELECT tenant_id, 'report' AS source_type, report_id AS source_id, due_at FROM {reports} UNION ALL SELECT c_custkey, 'opportunity', c_custkey, TIMESTAMP '1998-09-01' FROM {customer} WHERE c_custkey % 4 <> 0)
    WHERE source_type = 'opportunity' OR source_id NOT IN (SELECT source_id FROM {deadlines} WHERE deadline_id % 3 = 0)""")
def derive_deadlines(t):
    k = F.col("c_custkey")
    opportunities = t("customer").select(k.alias("tenant_id"), k.alias("opportunity_id"), F.when(k % 4 != 0, F.expr("TIMESTAMP '1998-09-01'")).alias("due_at"))
    return _due(I.derive_deadlines(t("reports"), opportunities, t("deadlines").where("deadline_id % 3 = 0")).drop(*_FLAGS))


_REM = f"""base AS (SELECT d.*, {_LEFT} AS lft, CAST(trunc({_LEFT}) AS INT) AS days, t.primary_email, t.primary_phone, t.tenant_id AS ht, r.title, coalesce(f.name, 'your funder') AS fname
    FROM {{deadlines}} d LEFT JOIN (SELECT * FROM {{tenants}} WHERE tenant_id % 13 <> 0) t USING (tenant_id) LEFT JOIN {{reports}} r ON r.report_id = d.source_id LEFT JOIN {{funders}} f ON f.funder_id = r.funder_id WHERE NOT acknowledged AND d.due_at > {_NOW}),
    skips AS (SELECT *, CASE WHEN ht IS NULL THEN 'tenant_not_found' WHEN primary_email IS NULL THEN 'no_tenant_email' END AS skip_reason FROM base),
    sends AS (SELECT s.*, channel, threshold FROM skips s JOIN (VALUES ('email', '30d', 30), ('email', '14d', 14), ('email', '7d', 7), ('email', '48h', 2), ('sms', '48h', 2)) v(channel, threshold, d) ON skip_reason IS NULL AND lft <= d AND
        CASE WHEN channel = 'sms' THEN NOT notified_48h_sms AND primary_phone IS NOT NULL WHEN d = 30 THEN NOT notified_30d WHEN d = 14 THEN NOT notified_14d WHEN d = 7 THEN NOT notified_7d ELSE NOT notified_1d END),
    lines AS (SELECT *, '"' || title || '" for ' || fname || ' is due in ' || days || CASE WHEN days = 1 THEN ' day' ELSE ' days' END AS line FROM sends)"""


@query(f"""WITH {_REM} SELECT deadline_id, tenant_id, channel, threshold, days, CASE WHEN channel = 'email' THEN '{I.SENDER}: ' || title || ' due ' || days || ' days, action required' END AS subject,
    CASE WHEN channel = 'email' THEN 'Your report ' || line || '. Due date: ' || strftime(due_at, '%Y-%m-%d') || '.' ELSE '{I.SENDER} reminder: ' || line || '.' END AS body, skip_reason FROM lines
    UNION ALL SELECT deadline_id, tenant_id, NULL, NULL, days, NULL, NULL, skip_reason FROM skips WHERE skip_reason IS NOT NULL""")
def due_reminders(t):
    return I.due_reminders(t("deadlines"), t("tenants").where("tenant_id % 13 <> 0"), t("reports"), t("funders"), _now())


_SENT = "sent AS (SELECT deadline_id, bool_or(deadline_id % 3 = 0) AS e30, bool_or(deadline_id % 5 = 0) AS s48 FROM {deadlines} GROUP BY 1)"


@query(f"WITH {_SENT} SELECT deadline_id, notified_30d OR e30 AS notified_30d, notified_14d, notified_7d, notified_1d, notified_48h_sms OR s48 AS notified_48h_sms, acknowledged FROM {{deadlines}} JOIN sent USING (deadline_id)")
def apply_notifications(t):
    i = F.col("deadline_id")
    results = t("deadlines").select("deadline_id", F.lit("email").alias("channel"), F.lit("30d").alias("threshold"), (i % 3 == 0).alias("ok")).unionByName(t("deadlines").select("deadline_id", F.lit("sms").alias("channel"), F.lit("48h").alias("threshold"), (i % 5 == 0).alias("ok")))
    return I.apply_notifications(t("deadlines"), results).select("deadline_id", *_FLAGS, "acknowledged")


@query(f"""WITH a AS (SELECT d.*, title, row_number() OVER (PARTITION BY d.tenant_id ORDER BY d.due_at, deadline_id) AS k, greatest(0, CAST(trunc((epoch_us(d.due_at) - epoch_us({_NOW})) / 86400e6) AS INT)) AS days FROM {{deadlines}} d LEFT JOIN {{reports}} r ON r.report_id = d.source_id WHERE NOT acknowledged AND d.due_at > {_NOW}),
    l AS (SELECT tenant_id, count(*) AS n, string_agg(title || ', due ' || strftime(due_at, '%Y-%m-%d') || ' (' || days || CASE WHEN days = 1 THEN ' day)' ELSE ' days)' END, chr(10) ORDER BY k) AS lines FROM a WHERE k <= 10 GROUP BY 1)
    SELECT tenant_id, coalesce(n, 0) AS n_deadlines, '{I.SENDER} weekly radar, ' || n || ' deadline' || CASE WHEN n <> 1 THEN 's' ELSE '' END || ' coming up' AS subject, lines, CASE WHEN n IS NULL THEN 'no_upcoming_deadlines' END AS skip_reason
    FROM {{tenants}} LEFT JOIN l USING (tenant_id) WHERE status = 'active' AND deadline_radar_enabled AND primary_email IS NOT NULL""")
def weekly_radar(t):
    return I.weekly_radar(t("tenants"), t("deadlines"), t("reports"), _now())


@query("""SELECT d.deadline_id, d.tenant_id, r.funder_id FROM {deadlines} d JOIN {reports} r ON r.report_id = d.source_id WHERE d.tenant_id % 3 = 1 AND (r.funder_id + d.tenant_id) % 4 = 0""")
def radar_subscribed(t):
    tenants = t("tenants").select("tenant_id", F.when(F.col("tenant_id") % 3 == 1, "Asia/Tokyo").otherwise("UTC").alias("time_zone"), F.lit(9).alias("send_hour"))
    subs = t("tenants").select("tenant_id").join(F.broadcast(t("funders").select("funder_id")), (F.col("funder_id") + F.col("tenant_id")) % 4 == 0)
    return I.radar_subscribed(t("deadlines"), t("reports"), subs, tenants, _now()).select("deadline_id", "tenant_id", "funder_id")


def _acked(t):
    token = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("deadline_id").cast("string"), 12, "0"))
    deadlines = t("deadlines").select("deadline_id", "tenant_id", token.alias("ack_token"), "acknowledged", F.lit(None).cast("timestamp").alias("acknowledged_at"))
    i = F.col("deadline_id")
    clicks = t("deadlines").where("deadline_id % 5 = 0").select(F.explode(F.array(token, token, F.when(i % 2 == 0, F.concat(F.lit("x"), i)).otherwise(F.concat(F.lit("ffffffff-0000-0000-0000-"), F.lpad(i.cast("string"), 12, "0"))))).alias("token"))
    return I.acknowledge(deadlines, clicks, _now())


@query("""SELECT deadline_id, acknowledged OR deadline_id % 5 = 0 AS acknowledged, CASE WHEN NOT acknowledged AND deadline_id % 5 = 0 THEN '1998-06-15 00:00:00' END AS acknowledged_at, CASE WHEN NOT acknowledged AND deadline_id % 5 = 0 THEN 'deadline.acknowledged' END AS action FROM {deadlines}""")
def acknowledge(t):
    got = _acked(t)
    return got["deadlines"].join(got["audit"].select(F.col("target_id").alias("deadline_id"), "action"), "deadline_id", "left").select("deadline_id", "acknowledged", F.date_format("acknowledged_at", "yyyy-MM-dd HH:mm:ss").alias("acknowledged_at"), "action")


@query("""WITH k AS (SELECT *, '00000000-0000-0000-0000-' || lpad(CAST(deadline_id AS VARCHAR), 12, '0') AS token FROM {deadlines} WHERE deadline_id % 5 = 0)
    SELECT token, CASE WHEN acknowledged THEN 'already_acknowledged' ELSE 'acknowledged' END AS outcome FROM k UNION ALL SELECT CASE WHEN deadline_id % 2 = 0 THEN 'x' || deadline_id ELSE 'ffffffff' || substr(token, 9) END, 'not_found' FROM k""")
def acknowledge_outcomes(t):
    return _acked(t)["outcomes"]
