"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import remove_repeats

    found = remove_repeats(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan, spans_text

    found = scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(spans_text(F.col("base_spans")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    found = contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "item_words", "n_covered", "n_changed")


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import classes

    return classes(_read(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    judged = judge(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_page_boilerplate

    kept = drop_page_boilerplate(_read(spark, sf_dir, "pages"))
    return kept.select("page_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filters import judge_urls

    judged = judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    return mix_documents(_read(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "epoch")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_records, write_archives

    folder, index = write_archives(_read(spark, sf_dir, "pages"))
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_ids import ids_crc32, stored

    held = stored(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return held.select(F.col("key").alias("doc_id"), "start", "n_tokens", ids_crc32("payload").alias("ids_crc32"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle, restored

    made = fill_in_middle(_read(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plane_clusters import clusters

    found = clusters(_read(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .grid_join import near_vectors

    return near_vectors(_read(spark, sf_dir, "embeddings")).select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_secret_scan, op3_decontamination, op4_near_dedup, op5_quality_rules, op6_line_dedup, op7_url_filters, op8_mixing, op9_warc, op10_token_ids,
        op11_fill_in_middle, op12_centroid_clustering, op13_embedding_near_dedup,
    )
}


def _url_sql() -> str:
    from .url_filters import LIMIT, RULES, VOCABULARY

    def case(value) -> str:
        arms = [f"WHEN (host = '{on}' OR ends_with(host, '.{on}')) AND starts_with(path, '{start}') THEN '{value((says, on, start))}'" for says, on, start in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
        return "CASE " + " ".join(arms) + " END"

    weight = " + ".join(f"CASE WHEN regexp_matches(lower(url_decode(coalesce(url, ''))), '(^|[^\\p{{L}}\\p{{N}}]){term}([^\\p{{L}}\\p{{N}}]|$)') THEN {w} ELSE 0 END" for term, w in VOCABULARY.items())
    return f"""WITH parts AS (SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages)
        SELECT page_id, host, path, {case(lambda r: r[1] + r[2])} AS rule, coalesce({case(lambda r: r[0])}, CASE WHEN {weight} >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict FROM parts"""


_QUALITY_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS w FROM documents),
    g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
    r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1) GROUP BY 1),
    l AS (SELECT doc_id, len(x) AS n_lines, len(x) - len(list_distinct(x)) AS dup FROM (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda y: regexp_matches(y, '[^ \\t-\\r]')) AS x FROM d)),
    m AS (SELECT doc_id, t, len(w) AS n_words, length(regexp_replace(t, '[ \\t-\\r]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, dup AS n_dup_lines, n_lines, coalesce(r.n, 0) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 10 > n_lines * 3 OR word_chars > n_words * 14 OR word_chars < n_words * 2
        OR len(regexp_extract_all(t, '[A-Z]')) * 10 > word_chars * 4 OR len(regexp_extract_all(t, '[0-9]')) * 10 > word_chars * 3) AS kept FROM b"""
_SUBSTRING_SQL = """WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split(translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     '), ' '), lambda x: x <> '') AS w FROM documents),
    x AS (SELECT r, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
    g AS (SELECT r, i, word, CASE WHEN i <= n - 34 THEN md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) END AS k FROM x),
    c AS (SELECT r, i, word, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 THEN 1 ELSE 0 END AS again FROM g),
    v AS (SELECT r, i, word, max(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM c),
    s AS (SELECT r, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM v GROUP BY 1)
    SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s USING (r)"""
_LINES_SQL = r"""WITH t AS (SELECT page_id, lower(nullif(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')) AS host, regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', chr(10), 'g') AS h FROM pages),
    u AS (SELECT page_id, host, regexp_replace(regexp_replace(h, '(?i)</?(?:a|abbr|b|code|em|i|q|s|small|span|strong|sub|sup|u)\b[^<>]*>', '', 'g'), '<[^<>]*>', chr(10), 'g') AS h FROM t),
    p AS MATERIALIZED (SELECT row_number() OVER () AS r, page_id, host, list_filter(list_transform(string_split_regex(h, '[\r\n]+'), lambda x: trim(x)), lambda x: x <> '') AS lines FROM u),
    k AS (SELECT host, unnest(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^ \t-\r]')))) AS line FROM p),
    n AS (SELECT host, count(*) AS pages FROM p GROUP BY 1), o AS (SELECT host, line, count(*) AS c FROM k GROUP BY 1, 2),
    b AS (SELECT o.host, list(line) AS often FROM o JOIN n ON o.host IS NOT DISTINCT FROM n.host WHERE c >= 3 AND c > pages * 0.1 GROUP BY 1),
    q AS (SELECT page_id, lines, CASE WHEN often IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(often, x)) END AS kept FROM p LEFT JOIN b ON p.host IS NOT DISTINCT FROM b.host)
    SELECT page_id, CAST(len(lines) AS INTEGER) AS n_lines, CAST(len(lines) - len(kept) AS INTEGER) AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM q"""
# a digest is eight groups of five hex digits, each four letters of base 32
_WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept FROM pages), d AS (SELECT *, sha1(h) AS x FROM p)
    SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, {digest} AS payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to FROM d"""
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(x, {at}, 5) AS INTEGER) >> {by}) & 31) + 1, 1)"
_MIDDLE_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
    u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, CAST('0x' || substr(x, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(x, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(x, 25, 8) AS BIGINT) AS h4 FROM d),
    c AS (SELECT *, len(l) AS n, least(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS a, greatest(h1 % (len(l) + 1), h2 % (len(l) + 1)) AS b FROM u),
    p AS (SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS pre, coalesce(array_to_string(l[a + 1:b], ''), '') AS mid, coalesce(array_to_string(l[b + 1:n], ''), '') AS suf FROM c),
    f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM p)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    floor = "CAST((s - (s % n + n) % n) // n AS BIGINT)"
    parts = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        "x AS MATERIALIZED (SELECT r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept)",
        f"c0 AS MATERIALIZED (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM (SELECT v, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c FROM kept) WHERE c < {k})",
    ]
    for j in range(rounds + 1):
        parts.append(f"a{j} AS MATERIALIZED (SELECT r, min(struct_pack(d, c)) AS m FROM (SELECT r, c, CAST(sum((x.x - o.x) * (x.x - o.x)) AS BIGINT) AS d FROM x JOIN c{j} o USING (i) GROUP BY 1, 2) GROUP BY 1)")
        if j < rounds:
            parts.append(f"c{j + 1} AS MATERIALIZED (SELECT o.c, o.i, coalesce({floor}, o.x) AS x FROM c{j} o LEFT JOIN (SELECT m.c AS c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{j} JOIN x USING (r) GROUP BY 1, 2) t ON t.c = o.c AND t.i = o.i)")
    last = f"h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)"
    return f"""WITH {', '.join([*parts, last])} SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia, centroid_sha256
        FROM a{rounds} JOIN kept USING (r) JOIN h ON h.c = m.c"""


# vectors of other lengths never meet: the angle is only asked for where they are equal
_VECTORS_SQL = """WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS e, len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS good FROM embeddings),
    links AS MATERIALIZED (SELECT x.r AS a, y.r AS b FROM v x JOIN v y ON x.r <> y.r AND x.good AND y.good AND CASE WHEN len(x.e) = len(y.e) THEN list_cosine_similarity(x.e, y.e) >= 0.9 ELSE false END),
    reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1), least AS (SELECT a, min(vec_id) AS least FROM reach JOIN v ON v.r = b GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least(vec_id, least), vec_id) AS component_id, vec_id = coalesce(least(vec_id, least), vec_id) AS kept FROM v LEFT JOIN n ON n.a = r LEFT JOIN least ON least.a = r"""
SQL: dict[str, str] = {
    "op1_substring_dedup": _SUBSTRING_SQL, "op5_quality_rules": _QUALITY_SQL, "op6_line_dedup": _LINES_SQL, "op7_url_filters": _url_sql(),
    "op11_fill_in_middle": _MIDDLE_SQL, "op12_centroid_clustering": _clusters_sql(), "op13_embedding_near_dedup": _VECTORS_SQL,
    "op9_warc": _WARC_SQL.format(digest=" || ".join(_LETTER.format(at=5 * (i // 4) + 1, by=15 - 5 * (i % 4)) for i in range(32))),
}
