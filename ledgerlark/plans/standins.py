"""Grant tables derived from the given tables, as one SQL text for both engines.

``{name}`` stands for another table.  Where the engines differ, the second text is DuckDB's.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "1998-06-15 00:00:00"

_DUE = "CAST(30 + 15 * (award_id % 5) AS INT)"
_REPORTS = """SELECT award_id AS report_id, tenant_id, award_id, funder_id, concat('Report ', award_id) AS title, CAST(<due> AS TIMESTAMP) AS due_at,
    CASE award_id % 7 WHEN 0 THEN 'upcoming' WHEN 1 THEN 'drafting' WHEN 2 THEN 'ready_for_review' WHEN 3 THEN 'ready_for_export'
    WHEN 4 THEN 'submitted' WHEN 5 THEN 'accepted' ELSE 'revision_requested' END AS status FROM {awards}"""
_ASKED = """SELECT (conv_id * 1000 + turn) * 1000 + i AS query_id, CAST(conv_id % 20 AS BIGINT) AS tenant_id, CASE WHEN conv_id % 3 <> 0 THEN CAST(conv_id % 5 AS INT) END AS funder_id, trim(s) AS query
    FROM <parts> WHERE trim(s) <> ''"""
_JUDGE = "SELECT doc_id AS draft_id, CAST(i AS INT) AS sentence_index, ((doc_id * 31 + i * 17) % 101) / 100.0 AS support_score FROM {documents} "

TABLES: dict[str, str | tuple[str, str]] = {
    "tenants": """SELECT c_custkey AS tenant_id, c_name AS name, CASE WHEN c_custkey % 10 = 0 THEN 'paused' ELSE 'active' END AS status,
        CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('t', c_custkey, '@example.org') END AS primary_email,
        CASE WHEN c_custkey % 3 = 0 THEN concat('+1555', c_custkey) END AS primary_phone,
        c_custkey % 5 <> 0 AS deadline_radar_enabled, 10000 AS monthly_token_budget_cents FROM {customer}""",
    "funders": "SELECT n_nationkey AS funder_id, concat('Foundation ', n_nationkey) AS name, lower(n_name) AS slug FROM {nation}",
    "known_programs": "SELECT CAST(p_partkey % 25 AS INT) AS funder_id, concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), ' Grant') AS program_name FROM {part}",
    "awards": """SELECT o_orderkey AS award_id, o_custkey AS tenant_id, CAST(o_custkey % 25 AS INT) AS funder_id, concat('Program ', o_orderpriority) AS program_name,
        CAST(floor(o_totalprice * 5) AS BIGINT) AS amount_usd, CAST(o_orderdate AS DATE) AS period_start,
        CAST(CAST(o_orderdate AS DATE) + INTERVAL '12' MONTH AS DATE) AS period_end FROM {orders}""",
    "reports": (_REPORTS.replace("<due>", f"date_add(period_end, {_DUE})"), _REPORTS.replace("<due>", f"period_end + {_DUE}")),
    "drafts": """SELECT l_orderkey AS report_id, l_linenumber AS field_no, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, l_quantity) AS version, l_returnflag <> 'R' AS eval_passed,
        l_extendedprice AS score, CAST(l_quantity * 1000 AS BIGINT) AS tokens_in, CAST(l_quantity * 100 AS BIGINT) AS tokens_out FROM {lineitem}""",
    "report_fields": """SELECT l_orderkey AS report_id, l_linenumber AS field_no, concat('field_', l_linenumber) AS label, max(l_returnflag) <> 'R' AS required,
        max(l_linestatus) = 'F' AS human_approved, CASE WHEN count(*) > 1 THEN concat('v', count(*)) END AS current_value, min(l_returnflag) AS draft_value
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "deadlines": """SELECT report_id AS deadline_id, tenant_id, 'report' AS source_type, report_id AS source_id, due_at, report_id % 2 = 0 AS notified_30d,
        report_id % 4 = 0 AS notified_14d, report_id % 8 = 0 AS notified_7d, report_id % 16 = 0 AS notified_1d, false AS notified_48h_sms,
        report_id % 11 = 0 AS acknowledged FROM {reports}""",
    "llm_calls": "SELECT event_id AS call_id, user_id AS tenant_id, event_type AS model, CAST(floor(value * 100) AS BIGINT) AS tokens_in, CAST(floor(value * 10) AS BIGINT) AS tokens_out, CAST(ts AS TIMESTAMP) AS ts FROM {events}",
    "audit_log": "SELECT event_id AS id, user_id AS tenant_id, event_type AS action, props AS metadata, CAST(ts AS TIMESTAMP) AS created_at FROM {events}",
    "chunks": """SELECT doc_id AS chunk_id, doc_id AS document_id, CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id % 20 END AS tenant_id,
        CAST(doc_id % 5 AS INT) AS funder_id, text AS content FROM {documents}""",
    "chunk_vectors": "SELECT vec_id AS chunk_id, embedding FROM {embeddings}",
    "judge_scores": (_JUDGE + "LATERAL VIEW explode(sequence(0, 39)) s AS i", _JUDGE + "CROSS JOIN range(0, 40) s(i)"),
    "draft_texts": """SELECT doc_id AS draft_id, CAST(doc_id % 25 AS INT) AS funder_id, text AS content, CASE WHEN doc_id % 3 <> 0 THEN CAST(50 + doc_id % 7 * 100 AS INT) END AS word_count_max,
        CASE WHEN doc_id % 4 = 1 THEN CAST(40 + doc_id % 5 * 60 AS INT) END AS word_count_min FROM {documents}""",
    "requests": "SELECT item_id AS query_id, CAST(item_id % 20 AS BIGINT) AS tenant_id, CASE WHEN item_id % 3 <> 0 THEN CAST(item_id % 5 AS INT) END AS funder_id, text AS query FROM {benchmark}",
    # each sentence of a conversation is a request
    "asked": (
        _ASKED.replace("<parts>", "(SELECT conv_id, turn, i, s FROM {conversations} LATERAL VIEW posexplode(split(text, '[.!?\\n]+')) p AS i, s)"),
        _ASKED.replace("<parts>", "(SELECT conv_id, turn, unnest(w) AS s, generate_subscripts(w, 1) - 1 AS i FROM (SELECT conv_id, turn, regexp_split_to_array(text, '[.!?\\n]+') AS w FROM {conversations}))"),
    ),
}


def _text(name: str, duck: bool) -> str:
    sql = TABLES[name]
    return sql if isinstance(sql, str) else sql[duck]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a stand-in."""
    if name not in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = _text(name, False)
    return spark.sql(sql, **{x: table(spark, sf_dir, x) for x in set(re.findall(r"\{(\w+)\}", sql))})


def duck(sql: str) -> str:
    """``sql`` with the stand-ins it names (``{name}``) put before it."""
    order: list[str] = []

    def need(text: str) -> None:
        for x in re.findall(r"\{(\w+)\}", text):
            if x in TABLES and x not in order:
                need(_text(x, True))
                order.append(x)

    need(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", text)
    parts = [f"{x} AS ({plain(_text(x, True))})" for x in order]
    body = plain(sql).strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:]])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
