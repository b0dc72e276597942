"""Tenants: isolation, audit, usage, deletion, membership, and constraint checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window


def tenant_view(df: DataFrame, tenant_id, shared: bool = False) -> DataFrame:
    """Rows of one tenant, and shared ones where asked; without a tenant there are no rows.  Soft-deleted rows are hidden."""
    if tenant_id is None or tenant_id == "":
        return df.where(F.lit(False))
    mine = F.col("tenant_id") == F.lit(tenant_id)
    rows = df.where(mine | F.col("tenant_id").isNull() if shared else mine)
    return rows.where("deleted_at IS NULL") if "deleted_at" in df.columns else rows


def isolation_report(links: dict[str, tuple[DataFrame, DataFrame, str, str]]) -> DataFrame:
    """(link, n_rows, n_leaks) for each (child, parent, child key, parent key): children whose tenant isn't their parent's."""

    def one(name: str, child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
        c = child.select(F.col(key).alias("k"), F.col("tenant_id").alias("c_tenant"))
        p = parent.select(F.col(parent_key).alias("p_k"), F.col("tenant_id").alias("p_tenant"))
        rows = c.join(p, F.col("k") == F.col("p_k"))
        return rows.agg(F.lit(name).alias("link"), F.count("*").alias("n_rows"), F.count_if(~F.col("c_tenant").eqNullSafe(F.col("p_tenant"))).alias("n_leaks"))

    return reduce(DataFrame.unionByName, [one(n, *x) for n, x in links.items()])


def audit_report(audit: DataFrame, tenant_id=None, action: str | None = None, since: Column | None = None, until: Column | None = None, user_id=None) -> DataFrame:
    """Audit rows of a tenant, user, action and span of time, newest first."""
    for column, value in (("tenant_id", tenant_id), ("user_id", user_id), ("action", action)):
        audit = audit if value is None else audit.where(F.col(column) == value)
    audit = audit if since is None else audit.where(F.col("created_at") >= since)
    audit = audit if until is None else audit.where(F.col("created_at") < until)
    return audit.orderBy(F.desc("created_at"), F.desc("id"))


def write_audit_csv(report: DataFrame, path: str) -> None:
    """The report as CSV files with a header, which follow each other in its order."""
    report.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def token_usage_daily(calls: DataFrame, cents: Column) -> DataFrame:
    """(tenant_id, day, model) sums of tokens and cents."""
    return calls.groupBy("tenant_id", F.to_date("ts").alias("day"), "model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum(cents).alias("cents"))


def budget_status(usage: DataFrame, tenants: DataFrame, month: str, alert: float = 0.8) -> DataFrame:
    """Spend of a month (``yyyy-MM``) against the budget: ok, alert from ``alert`` on, capped from 1 on."""
    spent = usage.where(F.date_format("day", "yyyy-MM") == month).groupBy("tenant_id").agg(F.sum("cents").alias("spent"))
    rows = tenants.select("tenant_id", F.col("monthly_token_budget_cents").alias("budget")).join(spent, "tenant_id", "left").withColumn("spent", F.coalesce("spent", F.lit(0)))
    share = F.when(F.col("budget") > 0, F.col("spent") / F.col("budget"))
    return rows.withColumn("share", share).withColumn("status", F.when(F.col("share") >= 1, "capped").when(F.col("share") >= alert, "alert").otherwise("ok"))


def hash_tree(rows: DataFrame, key: str) -> DataFrame:
    """(key, n_rows, sha256) of the rows of each key, whatever their order or number.

    A leaf is the SHA-256 of a row's columns, by name, as text, parted by the unit separator (null is the character 0).  Leaves are grouped
    by their first six hexadecimal digits, those groups by three, and these by none; a node is the SHA-256 of
    what is in it, joined in order.  So no list is longer than a 4096th of a level, and a key with many rows is many groups."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(rows.columns)])
    nodes = rows.select(key, F.sha2(text, 256).alias("h")).select(key, F.col("h").alias("place"), "h", F.lit(1).cast("long").alias("n"))
    for digits in (6, 3, 0):
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "h"))), lambda x: x["h"]), "")
        nodes = nodes.groupBy(key, F.substring("place", 1, digits).alias("place")).agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n"))
    return nodes.select(key, F.col("n").alias("n_rows"), F.col("h").alias("sha256"))


def delete_tenant(tables: dict[str, DataFrame], gone: DataFrame, audit: str, at: Column) -> dict[str, DataFrame]:
    """Every table without the tenants of ``gone``, and ``receipt``: the number of each tenant's audit rows and their ``hash_tree``."""
    ids = gone.select("tenant_id").distinct()
    left = {name: df.join(ids, "tenant_id", "left_anti") for name, df in tables.items()}
    hashed = hash_tree(tables[audit].join(ids, "tenant_id", "left_semi"), "tenant_id")
    left["receipt"] = ids.join(hashed, "tenant_id", "left").select("tenant_id", F.coalesce("n_rows", F.lit(0)).alias("n_audit"), F.col("sha256").alias("audit_sha256"), at.alias("deleted_at"))
    return left


def replace_subscriptions(current: DataFrame, submitted: DataFrame) -> DataFrame:
    """Subscriptions after each submitting tenant's set (an array, empty to clear) replaced its old one."""
    kept = current.join(submitted.select("tenant_id"), "tenant_id", "left_anti").select("tenant_id", "funder_id")
    return kept.unionByName(submitted.select("tenant_id", F.explode("funder_ids").alias("funder_id")).distinct())


def _known(old: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """(key, old, made): what is there from the start, and what the first of ``events`` makes."""
    made = events.groupBy(key).agg(F.min("seq").alias("made"))
    return old.select(key, F.lit(True).alias("old")).join(made, key, "full_outer").withColumn("old", F.coalesce("old", F.lit(False)))


def apply_membership_events(orgs: DataFrame, users: DataFrame, members: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """State after events (event_id, at, kind, org_id, user_id, name, slug, emails, first_name, last_name, role), as if they were handled
    one by one in the order of time and id; kinds that aren't named here change nothing.

    Organisations (org_id, name, slug, status): created makes one, active, or changes name and slug; updated changes one
    that is there by then; deleted leaves one that is there by then as ``churned``; nothing else touches the status.
    A name that isn't given is ``Unnamed Organization`` when made and empty when updated, a slug the id.
    Users: made or changed.  Memberships: made, changed or removed where organisation and user are there by then.

    As only the first making decides whether an event counts, and only the last that counts what it leaves, each state is a
    first and a last by key: no list of events is kept."""
    is_ = lambda *kinds: F.col("kind").isin(*kinds)
    e = events.withColumn("seq", F.struct("at", "event_id"))
    o = e.where(is_("organization.created", "organization.updated", "organization.deleted"))
    org = _known(orgs, o.where(is_("organization.created")), "org_id")
    counts = o.join(org, "org_id").where(F.col("old") | (F.col("seq") >= F.col("made")))
    name = F.coalesce("name", F.when(is_("organization.created"), "Unnamed Organization").otherwise(""))
    named = F.max(F.when(~is_("organization.deleted"), F.struct("seq", name.alias("name"), F.coalesce("slug", F.col("org_id").cast("string")).alias("slug")))).alias("last")
    changed = counts.groupBy("org_id").agg(named, F.bool_or(is_("organization.deleted")).alias("gone"))
    rows = org.select("org_id").join(orgs, "org_id", "left").join(changed, "org_id", "left")
    status = F.when(F.col("gone"), "churned").otherwise(F.coalesce("status", F.lit("active")))
    new_orgs = rows.select("org_id", F.coalesce("last.name", "name").alias("name"), F.coalesce("last.slug", "slug").alias("slug"), status.alias("status"))
    u = e.where(is_("user.created", "user.updated"))
    user = _known(users, u, "user_id")
    full = F.trim(F.concat_ws(" ", F.nullif("first_name", F.lit("")), F.nullif("last_name", F.lit(""))))
    last = F.max(F.struct("seq", F.coalesce(F.get("emails", F.lit(0)), F.lit("")).alias("email"), F.nullif(full, F.lit("")).alias("name"))).alias("last")
    rows = users.join(u.groupBy("user_id").agg(last), "user_id", "full_outer")
    pick = lambda c: F.when(F.col("last").isNotNull(), F.col(f"last.{c}")).otherwise(F.col(c)).alias(c)
    new_users = rows.select("user_id", pick("email"), pick("name"))
    m = e.where(is_("membership.created", "membership.deleted")).select("org_id", "user_id", "seq", "kind", "role")
    for known, key in ((org, "org_id"), (user, "user_id")):
        m = m.join(known, key).where(F.col("old") | (F.col("seq") > F.col("made"))).drop("old", "made")
    role = F.coalesce(F.nullif(F.regexp_replace("role", "^org:", ""), F.lit("")), F.lit("editor"))
    m = m.groupBy("org_id", "user_id").agg(F.max(F.struct("seq", (F.col("kind") == "membership.deleted").alias("gone"), role.alias("role"))).alias("last"))
    kept = members.join(m, ["org_id", "user_id"], "left_anti").select("org_id", "user_id", "role").unionByName(m.where("NOT last.gone").select("org_id", "user_id", "last.role"))
    return {"orgs": new_orgs, "users": new_users, "members": kept}


def constraint_report(checks: dict[str, Column], unique: dict[str, tuple[DataFrame, list[str]]], foreign: dict[str, tuple[DataFrame, str, DataFrame, str]], rows: DataFrame) -> DataFrame:
    """(rule, n_violations): row rules over ``rows``, repeated keys, and children without a parent."""
    parts = [rows.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in checks.items()]).select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_violations")) for n in checks])).alias("r")).select("r.*")] if checks else []
    parts += [df.groupBy(*keys).count().where("count > 1").agg(F.lit(name).alias("rule"), F.count("*").alias("n_violations")) for name, (df, keys) in unique.items()]
    for name, (child, key, parent, parent_key) in foreign.items():
        lost = child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("p_key")), F.col(key) == F.col("p_key"), "left_anti")
        parts.append(lost.agg(F.lit(name).alias("rule"), F.count("*").alias("n_violations")))
    return reduce(DataFrame.unionByName, parts)
