"""Checks of generated drafts, their gate, and the costs and drift of drafting."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Thresholds: fixed values.
SENTENCE_SUPPORT, FACTUALITY, RUBRIC, READING_EASE, WORD_RATIOS = 0.9, 0.9, 0.75, 40.0, (0.95, 1.05)
JUDGE_SUPPORT, COSINE_SUPPORT, SURFACE, FLAG, ITERATIONS = 0.7, 0.6, 8.0, 6.0, 5
CHECKS = ("factuality", "rubric", "hallucinations", "readability", "word_count")
#: Patterns of names: fixed values.
PROGRAM = r"\b(?:[A-Z][A-Za-z0-9]*(?:\s+|-)){1,6}(?:Program|Initiative|Award|Grant|Fund)\b"
ENTITIES = (r"(?i)\bCFDA[ #:]*([\d.]+)", r"\b([A-Z]{2,6})-(\d{4,})\b", r"(?i)\bPublic Law[ #]*(\d+-\d+)\b", r"\b(2 CFR \d+\.\d+)\b")
NAMED = r"\b([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+){1,4})\b(?=\s+(?:Program|Grant|Act|Fund|Initiative))"
_WORD = r"[\p{L}\p{N}_]+"


def split_sentences(drafts: DataFrame) -> DataFrame:
    """(draft_id, sentence_index, sentence): text after ``.``, ``!`` or ``?`` and white space starts a sentence; empty ones don't count."""
    parts = F.filter(F.transform(F.split("content", r"(?<=[.!?])\s+"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return drafts.select("draft_id", F.posexplode(parts).alias("sentence_index", "sentence"))


def words_of(content: Column) -> Column:
    return F.regexp_count(F.regexp_replace(content, r"\[\d+\]", ""), F.lit(_WORD)).cast("long")


def count_words(drafts: DataFrame) -> DataFrame:
    """(draft_id, word_count) without citation marks."""
    return drafts.select("draft_id", F.coalesce(words_of(F.col("content")), F.lit(0).cast("long")).alias("word_count"))


def word_count_check(drafts: DataFrame) -> DataFrame:
    """Word count against ``word_count_max`` and ``word_count_min``, with ratios, ``passed`` and ``reason``."""
    low, high = WORD_RATIOS
    n, most, least = F.col("word_count"), F.col("word_count_max"), F.col("word_count_min")
    rows = drafts.withColumn("word_count", F.coalesce(words_of(F.col("content")), F.lit(0).cast("long")))
    rows = rows.withColumns({"ratio_vs_max": F.when(most > 0, n / most), "ratio_vs_min": F.when(least > 0, n / least)})
    under = lambda bound, name: F.concat(F.lit("word_count "), n.cast("string"), F.lit(f" is below {low:.2f} of {name} "), bound.cast("string"))
    over = F.concat(F.lit("word_count "), n.cast("string"), F.lit(f" exceeds {high:.2f} of word_count_max "), most.cast("string"))
    reason = F.when(F.col("ratio_vs_max") < low, under(most, "word_count_max")).when(F.col("ratio_vs_max") > high, over).when(F.col("ratio_vs_min") < low, under(least, "word_count_min"))
    return rows.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull()).select("draft_id", "word_count", "ratio_vs_max", "ratio_vs_min", "passed", "reason")


#: Vowels, and the other letters.
VOWELS = "aeiouyáéíóúàèìòùâêîôûäëïöüñœæ"
_V, _N = f"[{VOWELS}]", rf"[\p{{L}}&&[^{VOWELS}]]"


def syllables_in(text: Column) -> Column:
    """Syllables of all words of a text, by this library's own rule: a word's groups of vowels, less a silent final e, at least one.

    An e is silent at the end of a word with more groups, but for words in ``le`` or ``ee``.  Counts of three patterns
    give the sum: groups, words without any, and words with a silent e; none of them looks back further than a letter."""
    text = F.lower(text)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    silent = rf"(?<!\p{{L}}){_N}*+(?:{_V}++{_N}++)++{_V}++(?<=(?<![le])e)(?!\p{{L}})"
    return (count(f"{_V}+") + count(rf"(?<!\p{{L}}){_N}++(?!\p{{L}})") - count(silent)).cast("long")


def text_counts(drafts: DataFrame) -> DataFrame:
    """(draft_id, n_words, n_sentences, n_syllables) of text without citation marks."""
    clean = F.regexp_replace(F.coalesce("content", F.lit("")), r"\[\d+\]", "")
    sentences = F.size(F.filter(F.split(clean, r"(?<=[.!?])\s+"), lambda x: F.trim(x) != ""))
    return drafts.select("draft_id", F.regexp_count(clean, F.lit(_WORD)).cast("long").alias("n_words"), sentences.cast("long").alias("n_sentences"), syllables_in(clean).alias("n_syllables"))


def readability(counts: DataFrame, least: float = READING_EASE) -> DataFrame:
    """Flesch reading ease from ``text_counts``; 0 without words."""
    ease = 206.835 - 1.015 * F.col("n_words") / F.col("n_sentences") - 84.6 * F.col("n_syllables") / F.col("n_words")
    score = F.when((F.col("n_words") > 0) & (F.col("n_sentences") > 0), ease).otherwise(0.0)
    return counts.select("draft_id", score.alias("score"), (score >= least).alias("passed"))


def readability_grade(counts: DataFrame) -> DataFrame:
    """Flesch-Kincaid grade from ``text_counts``, flagged outside 10 to 14."""
    grade = 0.39 * F.col("n_words") / F.col("n_sentences") + 11.8 * F.col("n_syllables") / F.col("n_words") - 15.59
    grade = F.when((F.col("n_words") > 0) & (F.col("n_sentences") > 0), grade).otherwise(0.0)
    return counts.select("draft_id", grade.alias("grade"), ((grade < 10) | (grade > 14)).alias("flagged"))


def program_mentions(drafts: DataFrame) -> DataFrame:
    """(draft_id, mention_no, mention): program-like names, distinct without case, first spelling and order kept."""
    found = F.regexp_extract_all("content", F.lit(PROGRAM), F.lit(0))
    rows = drafts.select("draft_id", F.posexplode(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", " "))).alias("pos", "mention"))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("draft_id", F.lower("mention")).orderBy("pos"))).where("nth = 1")
    return first.select("draft_id", (F.row_number().over(Window.partitionBy("draft_id").orderBy("pos")) - 1).alias("mention_no"), "mention")


def known_programs(drafts: DataFrame, funder_programs: DataFrame, awards: DataFrame) -> DataFrame:
    """(draft_id, program_name): the funder's programs and the tenant's awards' programs, distinct.

    The result is as long as the drafts times their programs.  Names are made distinct by funder and tenant, so that the
    pairs are written out last and never shuffled; only drafts with several funders or tenants have their own pairs compared."""
    of_funder, of_tenant = funder_programs.select("funder_id", "program_name").distinct(), awards.select("tenant_id", "program_name").distinct()
    rows = drafts.select("draft_id", "funder_id", "tenant_id").distinct().withColumn("n_rows", F.count("*").over(Window.partitionBy("draft_id")))
    one, several = rows.where("n_rows = 1"), rows.where("n_rows > 1")
    # of a tenant's names, those that the funder doesn't have
    theirs = of_funder.select(F.col("funder_id").alias("f_funder"), F.col("program_name").alias("f_name"))
    more = one.select("funder_id", "tenant_id").distinct().join(of_tenant, "tenant_id")
    more = more.join(theirs, (F.col("funder_id") == F.col("f_funder")) & F.col("program_name").eqNullSafe(F.col("f_name")), "left_anti")
    more = more.select(F.col("funder_id").alias("m_funder"), F.col("tenant_id").alias("m_tenant"), "program_name")
    pairs = lambda drafts, by, names: drafts.join(names, by).select("draft_id", "program_name")
    own = pairs(one, F.col("funder_id").eqNullSafe(F.col("m_funder")) & (F.col("tenant_id") == F.col("m_tenant")), more)
    mixed = pairs(several, "funder_id", of_funder).unionByName(pairs(several, "tenant_id", of_tenant)).distinct()
    return pairs(one, "funder_id", of_funder).unionByName(own).unionByName(mixed)


def ground_mentions(mentions: DataFrame, programs: DataFrame | list[DataFrame], chunks: DataFrame, drafts: DataFrame | None = None) -> DataFrame:
    """``mentions`` with ``grounded``: within a known program, or around one, or within a chunk of the draft, without case.

    ``programs`` are tables of (key, program_name): the key is draft_id, or a column of ``drafts`` such as the funder or
    the tenant, whose different mentions are then held against its different programs once, whatever the number of drafts.
    A draft without that key has no programs of it; empty programs count for nothing."""
    low = F.lower("mention")
    key = ["draft_id", "mention_no", "mention"]
    in_program = []
    for names in [programs] if isinstance(programs, DataFrame) else programs:
        (scope,) = [c for c in names.columns if c != "program_name"]
        rows = mentions.select(*key, low.alias("low"))
        if scope != "draft_id":
            rows = rows.join(drafts.select("draft_id", scope), "draft_id")
        known = names.where("program_name <> ''").select(F.col(scope).alias("p_scope"), F.lower("program_name").alias("p_name")).distinct()
        found = rows.select(scope, "low").distinct().join(known, (F.col(scope) == F.col("p_scope")) & (F.col("p_name").contains(F.col("low")) | F.col("low").contains(F.col("p_name"))), "left_semi")
        in_program.append(rows.join(found, [scope, "low"], "left_semi").select(*key))
    text = chunks.select(F.col("draft_id").alias("c_draft"), F.lower(F.coalesce(F.nullif("excerpt", F.lit("")), "content")).alias("c_text"))
    in_chunk = mentions.join(text, (F.col("draft_id") == F.col("c_draft")) & F.col("c_text").contains(low), "left_semi").select(*key)
    good = reduce(DataFrame.unionByName, in_program, in_chunk).distinct().withColumn("grounded", F.lit(True))
    return mentions.join(good, key, "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))


def hallucination_check(drafts: DataFrame, grounded: DataFrame) -> DataFrame:
    """Per draft: totals, ordered lists, score and verdict; no mention passes with 1."""
    pick = lambda want: F.transform(F.filter(F.sort_array(F.collect_list(F.struct("mention_no", "mention", "grounded"))), lambda x: x["grounded"] == want), lambda x: x["mention"])
    per = grounded.groupBy("draft_id").agg(F.count("*").alias("total"), pick(True).alias("g"), pick(False).alias("h"))
    rows = drafts.select("draft_id").join(per, "draft_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.select("draft_id", F.coalesce("total", F.lit(0)).alias("total_mentions"), F.coalesce("g", none).alias("grounded"), F.coalesce("h", none).alias("hallucinated"))
    bad = F.size("hallucinated")
    return rows.withColumn("score", F.when(F.col("total_mentions") > 0, 1 - bad / F.col("total_mentions")).otherwise(1.0)).withColumn("passed", bad == 0)


def entity_mentions(drafts: DataFrame, known: DataFrame) -> DataFrame:
    """(draft_id, entity, resolved): catalogue, award, law and regulation numbers, and named programs and acts, that a known
    name (draft_id, name) of the draft does or doesn't hold.  A name is two to five capitalised words and the first word
    of the eight characters that follow them."""
    lists = [F.regexp_extract_all("content", F.lit(p), F.lit(0)) for p in ENTITIES]
    part = lambda n: F.regexp_extract_all("content", F.lit(NAMED + r"(?=([\s\S]{0,8}))"), F.lit(n))
    named = F.zip_with(part(1), part(2), lambda name, rest: F.concat_ws(" ", name, F.regexp_extract(rest, r"\S+", 0)))
    rows = drafts.select("draft_id", F.explode(F.array_distinct(F.concat(*lists, named))).alias("entity"))
    low = F.lower("entity")
    names = known.where("name <> ''").select(F.col("draft_id").alias("k_draft"), F.lower("name").alias("k_name"))
    hit = rows.join(names, (F.col("draft_id") == F.col("k_draft")) & (F.col("k_name").contains(low) | low.contains(F.col("k_name"))), "left_semi").withColumn("resolved", F.lit(True))
    return rows.join(hit, ["draft_id", "entity"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(False)))


def resolve_citations(sentences: DataFrame, citations: DataFrame) -> DataFrame:
    """``sentences`` with ``cite``, ``evidence`` and ``state``: the first ``[n]``, looked up among the draft's citations by place."""
    key = lambda c: F.regexp_replace(c.cast("string"), r"^\[|\]$", "")
    cite = F.nullif(F.regexp_extract("sentence", r"\[(\d+)\]", 1), F.lit(""))
    first = citations.groupBy(F.col("draft_id").alias("c_draft"), key(F.col("id")).alias("c_key")).agg(F.min_by(F.coalesce(F.nullif("excerpt", F.lit("")), "content"), "pos").alias("evidence"))
    rows = sentences.withColumn("cite", cite).join(first, (F.col("draft_id") == F.col("c_draft")) & (F.col("cite") == F.col("c_key")), "left")
    state = F.when(F.col("cite").isNull(), "no_citation").when(F.col("c_key").isNull(), "unknown_citation").otherwise("eligible")
    return rows.withColumn("state", state).drop("c_draft", "c_key")


def factuality_check(sentences: DataFrame, scores: DataFrame, drafts: DataFrame) -> DataFrame:
    """Per draft over all sentences: mean and supported share; ineligible and unscored ones count 0, no sentence fails."""
    rows = sentences.join(scores, ["draft_id", "sentence_index"], "left")
    good = F.when(F.col("eligible"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("support_score").cast("double"), F.lit(0.0))))).otherwise(0.0)
    per = rows.groupBy("draft_id").agg(F.count("*").alias("n"), F.avg(good).alias("mean"), F.avg((good >= SENTENCE_SUPPORT).cast("double")).alias("share"))
    out = drafts.select("draft_id").join(per, "draft_id", "left").select("draft_id", F.coalesce("n", F.lit(0)).alias("n_sentences"), F.coalesce("mean", F.lit(0.0)).alias("mean_support"), F.coalesce("share", F.lit(0.0)).alias("supported_share"))
    return out.withColumn("passed", (F.col("n_sentences") > 0) & (F.col("supported_share") >= FACTUALITY))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def factuality_with_cosine(sentences: DataFrame, judge: DataFrame, vectors: DataFrame) -> DataFrame:
    """Per draft, share of sentences whose judge score and cosine to the evidence are both high enough."""
    rows = sentences.join(judge, ["draft_id", "sentence_index"], "left").join(vectors, ["draft_id", "sentence_index"], "left")
    good = (F.coalesce("support_score", F.lit(0.0)) >= JUDGE_SUPPORT) & (F.coalesce(cosine(F.col("sentence_vec"), F.col("chunk_vec")), F.lit(0.0)) >= COSINE_SUPPORT)
    return rows.groupBy("draft_id").agg(F.count("*").alias("n_sentences"), F.avg(good.cast("double")).alias("score"))


def normalize_rubric_weights(rubrics: DataFrame) -> DataFrame:
    """(rubric_id, item_id, weight) from text weights; bad or negative ones are 0, an all-zero rubric is even."""
    raw = F.greatest(F.coalesce(F.expr("try_cast(weight AS double)"), F.lit(0.0)), F.lit(0.0))
    raw = F.when(F.isnan(raw), 0.0).otherwise(raw)
    w = Window.partitionBy("rubric_id")
    rows = rubrics.withColumn("w", raw).withColumns({"s": F.sum("w").over(w), "n": F.count("*").over(w)})
    return rows.select("rubric_id", "item_id", F.when(F.col("s") > 0, F.col("w") / F.col("s")).otherwise(1.0 / F.col("n")).alias("weight"))


def rubric_check(drafts: DataFrame, weights: DataFrame, scores: DataFrame) -> DataFrame:
    """Per draft: weighted item scores from 0 to 2 as ``normalized`` (0 to 1) and ``overall`` (0 to 10); no rubric passes with 1.

    ``scores`` are (key, item_id, score): the key is draft_id, or a column of ``drafts`` that those scored alike share.  Each
    rubric is summed once a key, so the drafts themselves never meet its items; drafts of one id count together."""
    (key,) = [c for c in scores.columns if c not in ("item_id", "score")]
    given = scores.select(F.col(key).alias("s_key"), F.col("item_id").alias("s_item"), "score")
    graded = drafts.select(F.col(key).alias("g_key"), F.col("rubric_id").alias("g_rubric")).distinct().join(weights, F.col("g_rubric") == F.col("rubric_id"))
    graded = graded.join(given, (F.col("g_key") == F.col("s_key")) & (F.col("item_id") == F.col("s_item")), "left")
    item = F.least(F.lit(2.0), F.greatest(F.lit(0.0), F.coalesce(F.col("score").cast("double"), F.lit(0.0))))
    sums = graded.groupBy("g_key", "g_rubric").agg((F.sum(item * F.col("weight")) / 2).alias("part"))
    rows = drafts.select(*dict.fromkeys(["draft_id", key, "rubric_id"])).join(sums, F.col(key).eqNullSafe(F.col("g_key")) & (F.col("rubric_id") == F.col("g_rubric")))
    per = rows.groupBy("draft_id").agg(F.sum("part").alias("normalized"))
    out = drafts.select("draft_id").join(per, "draft_id", "left").withColumn("reason", F.when(F.col("normalized").isNull(), "no rubric supplied"))
    out = out.withColumn("normalized", F.coalesce("normalized", F.lit(1.0)))
    return out.withColumns({"overall": F.col("normalized") * 10, "passed": F.col("normalized") >= RUBRIC})


def eval_gate(**checks: DataFrame) -> DataFrame:
    """Conjunction of the five checks (each with draft_id, passed, reason), with ``reasons`` of failing ones in fixed order."""
    out = None
    for name in CHECKS:
        part = checks[name].select("draft_id", F.col("passed").alias(f"{name}_passed"), F.col("reason").alias(f"{name}_reason"))
        out = part if out is None else out.join(part, "draft_id")
    fails = [F.when(~F.col(f"{n}_passed"), F.concat(F.lit(f"{n}: "), F.coalesce(f"{n}_reason", F.lit("failed")))) for n in CHECKS]
    passed = [F.col(f"{n}_passed") for n in CHECKS]
    return out.select("draft_id", *passed, F.array_compact(F.array(*fails)).alias("reasons")).withColumn("passed", F.size("reasons") == 0)


def surface_decision_prototype(rows: DataFrame) -> DataFrame:
    """Earlier rule over content, bounds, n_hallucinated, factuality, rubric (of 2) and grade."""
    n = F.size(F.filter(F.split(F.regexp_replace("content", r"\[\d+\]", ""), r"\s+"), lambda x: x != ""))
    cut = lambda c, r: F.floor(c * F.lit(r) + F.lit(1e-9))
    bad_words = F.coalesce(n > cut(F.col("word_count_max"), 1.05), F.lit(False)) | F.coalesce(n < cut(F.col("word_count_min"), 0.95), F.lit(False))
    block = (F.col("n_hallucinated") > 0) | bad_words | (F.col("factuality") < 0.95)
    flag = (F.col("rubric") < 1.3) | (F.col("grade") < 10) | (F.col("grade") > 14)
    return rows.select("draft_id", n.cast("long").alias("word_count"), F.when(block, "block").when(flag, "flag").otherwise("surface").alias("decision"))


def surface_decision(critiques: DataFrame) -> DataFrame:
    """Decision from ``overall_score`` and the severities of ``fixes``."""
    high = F.coalesce(F.exists("fixes", lambda x: x == "high"), F.lit(False))
    score = F.col("overall_score")
    return critiques.select("draft_id", F.when((score >= SURFACE) & ~high, "surface").when(score >= FLAG, "surface_with_flag").otherwise("block").alias("decision"))


def select_iteration(iterations: DataFrame, cap: int = ITERATIONS) -> DataFrame:
    """The first ready iteration within the cap, else that of the best score, the earliest on ties."""
    order = Window.partitionBy("draft_id").orderBy(F.desc("ready"), F.when(F.col("ready"), F.col("iteration")), F.desc("score"), "iteration")
    rows = iterations.where(F.col("iteration") <= cap).withColumn("nth", F.row_number().over(order))
    return rows.where("nth = 1").drop("nth")


def draft_cost(calls: DataFrame, prices: DataFrame, default: tuple[float, float]) -> DataFrame:
    """(draft_id, tokens_in, tokens_out, cost_cents): cents are rounded half to even a call, then summed."""
    rows = calls.join(prices.select(F.col("model").alias("p_model"), "price_in", "price_out"), F.col("model") == F.col("p_model"), "left")
    cents = (F.col("tokens_in") * F.coalesce("price_in", F.lit(default[0])) + F.col("tokens_out") * F.coalesce("price_out", F.lit(default[1]))) / 1e6 * 100
    return rows.withColumn("cents", F.bround(cents, 0).cast("long")).groupBy("draft_id").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cents").alias("cost_cents"))


def citation_envelope(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Writer citations with the retrieved chunk of their number (``1``, ``"1"`` or ``"[1]"``), which becomes ``[1]``.

    Unmatched ones keep the id, and the document, chunk and section if any, that the writer gave, with their page (0 without one) in both page columns."""
    raw = F.col("id").cast("string")
    number = dict(citations.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint")
    marker = F.concat(F.lit("["), raw, F.lit("]")) if number else raw
    types = dict(chunks.dtypes)
    own = {"document_id": "document_id", "chunk_id": "chunk_id", "section_heading": "section"}
    given = [(F.col(c).try_cast(types[name]) if c in citations.columns else F.lit(None).cast(types[name])).alias(f"w_{name}") for name, c in own.items()]
    rows = citations.select("draft_id", F.coalesce(marker, F.lit("")).alias("marker"), F.regexp_replace(F.trim(raw), r"^\[|\]$", "").alias("key"), "excerpt", "page", *given)
    c = chunks.select(F.col("draft_id").alias("k_draft"), F.col("citation_id").cast("string").alias("k_id"), *own, "content", "page_start", "page_end")
    rows = rows.join(c, (F.col("draft_id") == F.col("k_draft")) & (F.col("key") == F.col("k_id")), "left")
    pick = lambda matched, other: F.when(F.col("k_id").isNotNull(), matched).otherwise(other)
    page = F.coalesce("page", F.lit(0))
    return rows.select(
        "draft_id", pick(F.concat(F.lit("["), "k_id", F.lit("]")), F.col("marker")).alias("id"), *[pick(F.col(name), F.col(f"w_{name}")).alias(name) for name in own],
        pick(F.coalesce(F.nullif("excerpt", F.lit("")), F.substring("content", 1, 240)), F.coalesce("excerpt", F.lit(""))).alias("excerpt"),
        pick(F.col("page_start"), page).alias("page_start"), pick(F.col("page_end"), page).alias("page_end"),
    )


def failure_reason(gates: DataFrame) -> DataFrame:
    """``surface_decision=block`` and the first three failing checks, joined and cut to 500."""
    parts = F.array_compact(F.array(F.when(F.col("decision") == "block", F.lit("surface_decision=block")), F.when(F.size("reasons") > 0, F.concat(F.lit("eval_failed:"), F.array_join(F.slice("reasons", 1, 3), ",")))))
    return gates.select("draft_id", F.substring(F.array_join(parts, "|"), 1, 500).alias("failure_reason"))


def drift_report(evals: DataFrame, sample: int = 5, days: int = 7, floor: float = 0.9, seed: int | None = None) -> DataFrame:
    """Per tenant and day: pass rate of a repeatable sample over a rolling window, and ``alert`` under the floor."""
    order = F.col("draft_id") if seed is None else F.xxhash64("draft_id", F.lit(seed))
    some = evals.withColumn("nth", F.row_number().over(Window.partitionBy("tenant_id", "day").orderBy(order, "draft_id"))).where(F.col("nth") <= sample)
    daily = some.groupBy("tenant_id", "day").agg(F.count("*").alias("n"), F.count_if("passed").alias("good"))
    window = Window.partitionBy("tenant_id").orderBy(F.unix_date("day")).rangeBetween(1 - days, 0)
    rate = F.sum("good").over(window) / F.sum("n").over(window)
    return daily.select("tenant_id", "day", "n", rate.alias("pass_rate")).withColumn("alert", F.col("pass_rate") < floor)
