"""Quality rules as a short-circuit cascade.

A rule is an expression over the text.  Each rule's cost and selectivity are measured on a
bounded sample of the rows, and the rules are put in order of rejections per cost.  ``keep``
evaluates them as one nested condition over the text: a row that a rule rejects never meets the
next ones.  The order changes only what is evaluated, never the verdict.  ``judge`` reports
measures of every row, so rules over these alone cost nothing more and come first; the others
are costed, ordered, and evaluated only for rows that all before them let pass.

Defined cases: null text has no words (and so fails the word count); repeated rows are judged
alone; a null id is kept; an empty table gives an empty result; other columns are untouched,
but for those of ``judge``'s own results, which replace columns of their name.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .native import WHITE, let, total, without, word_windows, words
from .storage import save

#: Rows of the sample on which rules are costed, on average, and times that a rule is evaluated on each.
SAMPLE_ROWS, REPEATS = 1000, 2


def _repeat_words(w: Column, n: int) -> Column:
    """Words that lie in an n-word window found twice or more in ``w``."""

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, j: F.least(F.lit(n), F.coalesce(F.get(places, j + 1) - p, F.lit(n))))
        return total(gaps)

    def repeated(ordered: Column) -> Column:
        same = lambda x, j: (x["h"] == F.get(ordered, j)["h"]) & (j >= 0)
        places = F.transform(ordered, lambda x, j: F.when(F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)), x["i"]))
        return let(F.sort_array(F.array_compact(places)), covered)

    # words are hashed once, windows are hashes of those
    def of(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(ordered, repeated)).otherwise(F.lit(0))

    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(word_windows(h, n), of)).cast("long")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


class TextMeasures:
    """Measures of a text as expressions over it; one that no rule asks for is never evaluated."""

    def __init__(self, text: Column, words_: Column):
        self.text, self.words = text, words_

    n_words = property(lambda self: F.size(self.words).cast("long"))
    word_chars = property(lambda self: F.length(without(self.text, WHITE)).cast("long"))
    n_symbols = property(lambda self: (F.length(self.text) - F.length(without(self.text, "#*$%&|<>"))).cast("long"))
    lines = property(lambda self: F.filter(F.split(self.text, "\n"), lambda x: F.length(without(x, WHITE)) > 0))
    n_lines = property(lambda self: F.size(self.lines).cast("long"))
    n_dup_lines = property(lambda self: let(self.lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")))
    n_repeat_words = property(lambda self: _repeat_words(self.words, 5))


class _Split(TextMeasures):
    """The same over lines that are there."""

    lines = property(lambda self: F.col("q_lines"))


class _Ready(TextMeasures):
    """The same, as columns that are there; ``unready`` tells whether more than these was asked for."""

    unready = False

    def __getattribute__(self, name: str):
        if name in ("text", "words", "lines"):
            self.unready = True
        return super().__getattribute__(name)

    n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words = (property(lambda self, c=c: F.col(f"q_{c}")) for c in MEASURES)


@dataclass(frozen=True)
class Rule:
    """``rejects`` gives a condition over measures of a text; it must not be null."""

    name: str
    rejects: Callable[[TextMeasures], Column]


def base_failed(m: TextMeasures) -> Column:
    """Fewer than ten words, or over a fifth of them in repeated five-word windows."""
    return (m.n_words < 10) | (m.n_repeat_words * 100 > m.n_words * 20)


def _many(letters: str, tenths: int):
    return lambda m: (F.length(m.text) - F.length(without(m.text, letters))) * 10 > m.word_chars * tenths


def default_rules() -> list[Rule]:
    return [
        Rule("words", lambda m: m.n_words < 10),
        Rule("symbols", lambda m: m.n_symbols * 10 > m.n_words),
        Rule("repeated_lines", lambda m: m.n_dup_lines * 10 > m.n_lines * 3),
        Rule("repeated_words", lambda m: m.n_repeat_words * 100 > m.n_words * 20),
        Rule("word_length", lambda m: ~m.word_chars.between(m.n_words * 2, m.n_words * 14)),
        Rule("capitals", _many("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 4)),
        Rule("digits", _many("0123456789", 3)),
    ]


def passes(text: Column, rules: list[Rule]) -> Column:
    """True where no rule rejects; the rules are evaluated in order, up to the first that does."""

    def cascade(held: Column) -> Column:
        m = TextMeasures(held["text"], held["words"])
        return reduce(lambda rest, rule: F.when(rule.rejects(m), False).otherwise(rest), reversed(rules), F.lit(True))

    text = F.coalesce(text.cast("string"), F.lit(""))
    return let(text, lambda t: let(F.struct(t.alias("text"), words(t).alias("words")), cascade))


def ordered_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost on a sample of ``sample_rows`` rows on average, chosen by a hash of the row.

    A cost is the time of a pass over the sample less that of an empty pass, the least of two,
    to the nearest power of two, so that the order doesn't hang on chance; ties keep the given order."""
    if len(rules) < 2:
        return list(rules)
    share = min(1.0, sample_rows / max(docs.count(), 1))
    some = docs.where(F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = save(some.select(F.col(text_col).cast("string").alias("text")).coalesce(1)).select("text", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def timed(rule: Rule) -> tuple[int, float]:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            left = sample.agg(F.count_if(passes(F.col("text"), [rule]))).first()[0]
            took.append(time.perf_counter() - began)
        return left, min(took)

    rows, idle = timed(Rule("nothing", lambda m: F.length(m.text) < 0))
    worth = []
    for rule in rules:
        left, took = timed(rule)
        worth.append((rows - left) / 2 ** round(math.log2(max(took - idle, 0.02))))
    return [rule for _, _, rule in sorted(zip((-w for w in worth), range(len(rules)), rules))]


def measured_first(rules: list[Rule]) -> tuple[list[Rule], list[Rule]]:
    """The rules over reported measures alone, and the others."""
    held: tuple[list[Rule], list[Rule]] = [], []
    for rule in rules:
        m = _Ready(F.col("q_text"), F.col("q_words"))
        rule.rejects(m)
        held[m.unready].append(rule)
    return held


def judge(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``kept``, ``failed_rule`` (the first that rejects, in the cascade's order; null for
    rows that the base or no rule rejects) and ``n_rules_met``, the rules that were evaluated for the row."""
    free, dear = measured_first(rules or default_rules())
    dear = ordered_rules(docs, dear, text_col)
    rows = docs.select(F.struct("*").alias("q_row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("q_text"))
    m = _Split(F.col("q_text"), F.col("q_words"))
    rows = rows.withColumns({"q_words": words(F.col("q_text")), "q_lines": TextMeasures(F.col("q_text"), F.col("q_words")).lines}).withColumns({f"q_{c}": getattr(m, c) for c in MEASURES})
    ready = _Ready(F.col("q_text"), F.col("q_words"))
    rows = rows.withColumn("q_base", base_failed(ready))
    # a chain of conditions ends at the first that holds: what the base rejects meets no rule
    met = F.when(F.col("q_base"), F.struct(F.lit(None).cast("string").alias("rule"), F.lit(0).alias("met")))
    for k, rule in enumerate([*free, *dear], 1):
        met = met.when(rule.rejects(ready), F.struct(F.lit(rule.name).alias("rule"), F.lit(k).alias("met")))
    rows = rows.withColumn("q_met", met.otherwise(F.struct(F.lit(None).cast("string").alias("rule"), F.lit(len(free) + len(dear)).alias("met"))))
    results = {c: F.col(f"q_{c}") for c in MEASURES} | {"base_failed": F.col("q_base"), "failed_rule": F.col("q_met.rule"), "n_rules_met": F.col("q_met.met"), "kept": ~F.col("q_base") & F.col("q_met.rule").isNull()}
    kept = [F.col(f"q_row.{c}") for c in docs.columns if c not in results]
    return rows.select(*kept, *[c.alias(name) for name, c in results.items()])


def keep(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with its columns."""
    return docs.where(passes(F.col(text_col), ordered_rules(docs, rules or default_rules(), text_col)))
