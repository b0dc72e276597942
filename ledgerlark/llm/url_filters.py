"""URL filters: a weighted vocabulary found by Aho-Corasick, and allow and block rules.

Terms count only at boundaries (no letter or digit of any script beside them), in the url as it is read: percent
escapes and the host's punycode are decoded first.  A strict term weighs as much as the limit, a soft term half of
it, and each distinct term counts once: one strict or two distinct soft terms reject.  The vocabulary may be a
table (``vocabulary_of``); the built-in one is a small sample.

Defined cases: a null or empty url has an empty host and path, fits no rule and is allowed;
repeated rows are judged alone; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

LIMIT = 2
#: The vocabulary: own choice of terms, with their weights.
VOCABULARY = dict.fromkeys(
    "adult casino escort gambling hentai malware pharma phishing pills poker porn porno sexcam slots spam viagra warez webcamsex xxx".split(), LIMIT
) | dict.fromkeys("ads bet bets betting bonus cheap crack dating discount download farm free girls hot keygen loan loans offer sex torrent track tracker tracking win winner".split(), 1)
#: (verdict, host, start of path); the longest that fits decides.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    part = lambda n: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return F.translate(part(1), upper, lower), part(2)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    none = F.lit(None).cast("string")
    rule = verdict = F
    for says, on, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(start)
        rule = rule.when(fits, F.lit(on + start))
        verdict = verdict.when(fits, F.lit(says))
    return (rule, verdict) if rules else (none, none)


#: Bytes of a vocabulary's terms at most, as each task holds an automaton of about twenty times as many.
VOCABULARY_BYTES = 8 << 20


def vocabulary_of(rows: DataFrame, term_col: str = "term", weight_col: str = "weight", class_col: str | None = None) -> dict[str, int]:
    """The vocabulary of a table of terms, with a weight or a class (``strict`` or ``soft``); refuses one of over ``VOCABULARY_BYTES``.

    Terms are in lower case, empty and null ones are left out, and of a repeated term the greatest weight counts."""
    weight = F.col(weight_col).cast("int") if class_col is None else F.when(F.col(class_col) == "strict", LIMIT).when(F.col(class_col) == "soft", LIMIT // 2)
    terms = rows.select(F.lower(F.trim(term_col)).alias("term"), weight.alias("weight")).where("term <> '' AND weight > 0").groupBy("term").agg(F.max("weight").alias("weight"))
    size = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    if size > VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has {size} bytes, more than {VOCABULARY_BYTES}")
    return {r.term: r.weight for r in terms.collect()}


def readable(url: str) -> str:
    """The url with percent escapes and punycode labels of its host decoded, in lower case; what can't be decoded stays."""
    if "%" in url:
        url = unquote(url)
    url = url.lower()
    if "xn--" not in url:
        return url

    def label(found: re.Match) -> str:
        try:
            return found[1].encode("ascii").decode("punycode")
        except UnicodeError:
            return found[0]

    start = url.find("://") + 3 if "://" in url else 0
    end = re.compile(r"[/?#]|$").search(url, start).start()
    return url[:start] + re.sub(r"(?<![^.@])xn--([a-z0-9-]+)", label, url[start:end]) + url[end:]


def term_weight(vocabulary: dict[str, int] = VOCABULARY):
    """A vectorised function from url to the weight of its distinct terms."""

    @F.pandas_udf("int")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term, weight in vocabulary.items():
            automaton.add_word(term, (term, weight))
        automaton.make_automaton()
        letter = str.isalnum

        def of(url: str | None) -> int:
            if not url or not len(automaton):
                return 0
            url = readable(url)
            found = {}
            for end, (term, weight) in automaton.iter(url):
                start = end + 1 - len(term)
                if not (start and letter(url[start - 1])) and not letter(url[end + 1 : end + 2] or " "):
                    found[term] = weight
            return sum(found.values())

        for urls in batches:
            yield urls.map(of, na_action=None).astype("int32")

    return weigh


def judge_urls(pages: DataFrame, url_col: str = "url", rules=RULES, vocabulary: dict[str, int] = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``term_weight`` and ``verdict``."""
    host, path = host_and_path(F.col(url_col))
    pages = pages.withColumns({"host": host, "path": path, "term_weight": term_weight(vocabulary)(F.col(url_col))})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_terms = F.when(F.col("term_weight") >= limit, "block").otherwise("allow")
    return pages.withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_terms)})
