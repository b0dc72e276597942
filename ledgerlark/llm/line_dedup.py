"""Line dedup by site-relative frequency.

For each host, the pages that contain a line are divided by the host's pages; lines over the
ratio (and on ``min_pages`` pages or more) are boilerplate and are dropped from every page of
the host.  A host's boilerplate is at most its mean lines per page divided by the ratio, so
it travels as one bounded list a host.

Counts are of (host, line) pairs, a line once a page, and are summed in part before the
shuffle.  Hosts with over 1 / ``TASKS`` of all pages, fewer than ``TASKS`` hosts, are broadcast
with the number of tasks that their pages are dealt out over, so a host with a third of all
pages is no single task at any size.

Defined cases: null text has no lines; a null host is a host of its own; blank lines are never
boilerplate and stay; a line that repeats within a page counts once and all its copies go;
repeated rows are separate pages; an empty table gives an empty result; columns of the input
stay, ``kept_text``, ``n_lines`` and ``n_dropped`` come in and replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .native import WHITE, without
from .storage import save

#: A host with more than one in so many of all pages is dealt out over that share of as many tasks.
TASKS = 1000


def page_lines(html: Column) -> Column:
    """Lines of a page: scripts, styles and comments go, block tags and line breaks part lines, other tags go."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "\n")
    text = F.regexp_replace(text, r"(?i)<(?!/?(?:a|abbr|b|code|em|i|q|s|small|span|strong|sub|sup|u)\b)[^<>]*>", "\n")
    lines = F.split(F.regexp_replace(text, r"<[^<>]*>", ""), r"[\r\n]+")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, host: Column, lines: Column, ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """``pages`` without the boilerplate lines of their hosts."""
    columns = pages.columns
    rows = pages.select(F.struct(*columns).alias("d_row"), F.xxhash64(*columns).alias("d_hash"), host.alias("d_host"), lines.alias("d_lines"))
    rows = rows.withColumn("d_keys", F.transform("d_lines", lambda x: F.when(F.length(without(x, WHITE)) > 0, F.xxhash64(x))))
    once = rows.select("d_host", F.explode(F.array_distinct(F.array_compact(F.coalesce("d_keys", F.array().cast("array<bigint>"))))).alias("key"))
    total = save(pages.select(host.alias("t_host")).groupBy("t_host").agg(F.count("*").alias("pages")))
    every = total.agg(F.sum("pages")).first()[0] or 0
    hot = total.where(F.col("pages") * TASKS > every).select(F.col("t_host").alias("h_host"), F.ceil(F.col("pages") * TASKS / every).cast("int").alias("h_tasks")) if every else total.select(F.col("t_host").alias("h_host"), F.lit(1).alias("h_tasks"))
    dealt = lambda df, name: df.join(F.broadcast(hot), F.col(name).eqNullSafe(F.col("h_host")), "left").withColumn("h_tasks", F.coalesce("h_tasks", F.lit(1))).drop("h_host")
    often = once.groupBy("d_host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = often.join(total, F.col("d_host").eqNullSafe(F.col("t_host"))).where(F.col("n") > F.col("pages") * ratio)
    # at most mean lines / ratio keys a host
    listed = save(often.groupBy("d_host").agg(F.collect_list("key").alias("b_keys")).withColumnRenamed("d_host", "b_host"))
    # written again, so that Spark knows its size and shuffles no pages for a small one
    listed = save(dealt(listed, "b_host").withColumn("b_salt", F.explode(F.sequence(F.lit(0), F.col("h_tasks") - 1))).drop("h_tasks"))
    salted = dealt(rows, "d_host").withColumn("d_salt", F.pmod("d_hash", F.col("h_tasks")).cast("int"))
    joined = salted.join(listed, F.col("d_host").eqNullSafe(F.col("b_host")) & (F.col("d_salt") == F.col("b_salt")), "left")
    kept = F.when(F.col("b_keys").isNull(), F.coalesce("d_lines", F.array().cast("array<string>"))).otherwise(
        F.filter(F.coalesce("d_lines", F.array().cast("array<string>")), lambda x, i: ~F.coalesce(F.array_contains("b_keys", F.get("d_keys", i)), F.lit(False)))
    )
    joined = joined.withColumn("d_kept", kept)
    n_lines = F.coalesce(F.size("d_lines"), F.lit(0))
    kept_columns = [F.col(f"d_row.{c}") for c in columns if c not in ("kept_text", "n_lines", "n_dropped")]
    return joined.select(*kept_columns, F.array_join("d_kept", "\n").alias("kept_text"), n_lines.alias("n_lines"), (n_lines - F.size("d_kept")).alias("n_dropped"))


def site_host(url: Column) -> Column:
    """The host of a url, lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def drop_page_boilerplate(pages: DataFrame, ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    return drop_boilerplate(pages, site_host(F.col("url")), page_lines(F.col("html")), ratio, min_pages)
