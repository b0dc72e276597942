"""Deadlines: derivation, reminders, weekly digests and acknowledgements.  The clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: (days left, flag column, name) of the e-mails, and the days of the text message: fixed values.
THRESHOLDS = ((30, "notified_30d", "30d"), (14, "notified_14d", "14d"), (7, "notified_7d", "7d"), (2, "notified_1d", "48h"))
SMS_DAYS, SMS_FLAG, DIGEST_ROWS = 2, "notified_48h_sms", 10
NO_TITLE, NO_FUNDER, SENDER = "Compliance Report", "your funder", "Grants desk"


def days_left(as_of: Column) -> Column:
    return (F.unix_micros("due_at") - F.unix_micros(as_of)) / 86_400e6


def derive_deadlines(reports: DataFrame, opportunities: DataFrame, existing: DataFrame) -> DataFrame:
    """New deadlines, all flags false: one per report and per opportunity with a due date."""
    pick = lambda rows, kind, key: rows.where("due_at IS NOT NULL").select("tenant_id", F.lit(kind).alias("source_type"), F.col(key).alias("source_id"), "due_at")
    both = pick(reports, "report", "report_id").unionByName(pick(opportunities, "opportunity", "opportunity_id"))
    fresh = both.join(existing.select("source_type", "source_id"), ["source_type", "source_id"], "left_anti")
    return fresh.withColumns({flag: F.lit(False) for _, flag, _ in THRESHOLDS} | {SMS_FLAG: F.lit(False), "acknowledged": F.lit(False)})


def _named_days(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " day").otherwise(" days"))


def _reportish(deadlines: DataFrame, tenants: DataFrame, reports: DataFrame, funders: DataFrame) -> DataFrame:
    t = tenants.select("tenant_id", F.col("name").alias("tenant_name"), "primary_email", "primary_phone", F.lit(True).alias("has_tenant"))
    r = reports.select(F.lit("report").alias("source_type"), F.col("report_id").alias("source_id"), "title", "funder_id")
    rows = deadlines.join(t, "tenant_id", "left").join(r, ["source_type", "source_id"], "left").join(funders.select("funder_id", F.col("name").alias("funder_name")), "funder_id", "left")
    return rows.withColumns({"title": F.coalesce(F.nullif("title", F.lit("")), F.lit(NO_TITLE)), "funder_name": F.coalesce(F.nullif("funder_name", F.lit("")), F.lit(NO_FUNDER))})


def due_reminders(deadlines: DataFrame, tenants: DataFrame, reports: DataFrame, funders: DataFrame, as_of: Column) -> DataFrame:
    """One row per notification to send, with ``skip_reason`` instead for open deadlines that can't be sent.

    A deadline that was never notified emits every threshold it has passed at once."""
    rows = _reportish(deadlines.where(~F.col("acknowledged") & (F.col("due_at") > as_of)), tenants, reports, funders)
    left = days_left(as_of)
    rows = rows.withColumns({"left": left, "days": left.cast("int")})
    skip = F.when(F.col("has_tenant").isNull(), "tenant_not_found").when(F.nullif("primary_email", F.lit("")).isNull(), "no_tenant_email")
    mail = [F.when((F.col("left") <= d) & ~F.col(flag), F.struct(F.lit("email").alias("channel"), F.lit(name).alias("threshold"))) for d, flag, name in THRESHOLDS]
    text = F.when((F.col("left") <= SMS_DAYS) & ~F.col(SMS_FLAG) & F.nullif("primary_phone", F.lit("")).isNotNull(), F.struct(F.lit("sms").alias("channel"), F.lit("48h").alias("threshold")))
    rows = rows.withColumn("skip_reason", skip)
    rows = rows.withColumn("send", F.explode(F.when(F.col("skip_reason").isNull(), F.array_compact(F.array(*mail, text))).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("channel"), F.lit(None).cast("string").alias("threshold"))))))
    line = F.concat(F.lit('"'), "title", F.lit('" for '), "funder_name", F.lit(" is due in "), _named_days(F.col("days")))
    subject = F.when(F.col("send.channel") == "email", F.concat(F.lit(f"{SENDER}: "), "title", F.lit(" due "), F.col("days"), F.lit(" days, action required")))
    body = F.when(F.col("send.channel") == "email", F.concat(F.lit("Your report "), line, F.lit(". Due date: "), F.date_format("due_at", "yyyy-MM-dd"), F.lit("."))).when(F.col("send.channel") == "sms", F.concat(F.lit(f"{SENDER} reminder: "), line, F.lit(".")))
    return rows.select("deadline_id", "tenant_id", F.col("send.channel").alias("channel"), F.col("send.threshold").alias("threshold"), "days", subject.alias("subject"), body.alias("body"), "skip_reason")


def apply_notifications(deadlines: DataFrame, results: DataFrame) -> DataFrame:
    """Deadlines with the flags of successful sends (channel, threshold, ok) set; nothing sent leaves a row as it was."""
    flags = {("email", name): flag for _, flag, name in THRESHOLDS} | {("sms", "48h"): SMS_FLAG}
    sent = results.where("ok").groupBy(F.col("deadline_id").alias("s_id")).agg(*[F.bool_or((F.col("channel") == c) & (F.col("threshold") == n)).alias(f"s_{flag}") for (c, n), flag in flags.items()])
    rows = deadlines.join(sent, F.col("deadline_id") == F.col("s_id"), "left")
    return rows.withColumns({flag: F.col(flag) | F.coalesce(f"s_{flag}", F.lit(False)) for flag in flags.values()}).select(*deadlines.columns)


def weekly_radar(tenants: DataFrame, deadlines: DataFrame, reports: DataFrame, as_of: Column, n: int = DIGEST_ROWS) -> DataFrame:
    """One digest per active tenant with the radar on and an address: its next open deadlines, or why there is none."""
    who = tenants.where((F.col("status") == "active") & F.col("deadline_radar_enabled") & F.nullif("primary_email", F.lit("")).isNotNull())
    order = Window.partitionBy("tenant_id").orderBy("due_at", "deadline_id")
    ahead = deadlines.where(~F.col("acknowledged") & (F.col("due_at") > as_of)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    ahead = ahead.join(reports.select(F.lit("report").alias("source_type"), F.col("report_id").alias("source_id"), "title"), ["source_type", "source_id"], "left")
    days = F.greatest(F.lit(0), days_left(as_of).cast("int"))
    line = F.concat(F.coalesce(F.nullif("title", F.lit("")), F.lit(NO_TITLE)), F.lit(", due "), F.date_format("due_at", "yyyy-MM-dd"), F.lit(" ("), _named_days(days), F.lit(")"))
    lists = ahead.groupBy("tenant_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    rows = who.select("tenant_id", "name").join(lists, "tenant_id", "left")
    subject = F.concat(F.lit(f"{SENDER} weekly radar, "), F.col("n"), F.lit(" deadline"), F.when(F.col("n") != 1, "s").otherwise(""), F.lit(" coming up"))
    return rows.select("tenant_id", F.coalesce("n", F.lit(0)).alias("n_deadlines"), subject.alias("subject"), "lines", F.when(F.col("n").isNull(), "no_upcoming_deadlines").alias("skip_reason"))


def radar_subscribed(deadlines: DataFrame, reports: DataFrame, subscriptions: DataFrame, tenants: DataFrame, as_of: Column) -> DataFrame:
    """Deadlines of reports of funders that the tenant follows, for tenants whose local hour (time_zone, send_hour) is now; other kinds of
    deadlines have no report and are no part of it, even if their ``source_id`` is that of one."""
    hour = tenants.where(F.hour(F.from_utc_timestamp(as_of, F.col("time_zone"))) == F.col("send_hour")).select("tenant_id")
    rows = deadlines.where("source_type = 'report'").join(reports.select(F.col("report_id").alias("source_id"), "funder_id"), "source_id")
    return rows.join(subscriptions.select("tenant_id", "funder_id"), ["tenant_id", "funder_id"], "left_semi").join(hour, "tenant_id", "left_semi")


def acknowledge(deadlines: DataFrame, clicks: DataFrame, at: Column) -> dict[str, DataFrame]:
    """``deadlines`` after the clicks (token), ``audit`` with a row per first acknowledgement, and ``outcomes`` per token."""
    tokens = clicks.select("token").distinct().withColumn("good", F.coalesce(F.col("token").rlike(r"^[0-9a-fA-F-]{36}$"), F.lit(False)))
    first = tokens.where("good").select(F.col("token").alias("a_token"))
    rows = deadlines.join(first, F.col("ack_token") == F.col("a_token"), "left")
    new = F.col("a_token").isNotNull() & ~F.col("acknowledged")
    after = rows.select(*[c for c in deadlines.columns if c not in ("acknowledged", "acknowledged_at")], (F.col("acknowledged") | new).alias("acknowledged"), F.when(new, at).otherwise(F.col("acknowledged_at")).alias("acknowledged_at"))
    audit = rows.where(new).select("tenant_id", F.lit("deadline.acknowledged").alias("action"), F.col("deadline_id").alias("target_id"), at.alias("created_at"))
    known = deadlines.select(F.col("ack_token").alias("d_token"), "acknowledged")
    outcome = F.when(~F.col("good") | F.col("d_token").isNull(), "not_found").when(F.col("acknowledged"), "already_acknowledged").otherwise("acknowledged")
    return {"deadlines": after, "audit": audit, "outcomes": tokens.join(known, F.col("token") == F.col("d_token"), "left").select("token", outcome.alias("outcome"))}
