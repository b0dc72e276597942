"""Secret scans: fixed patterns, and character Markov models for strings no pattern knows.

Two first-order character models, of random strings and of ordinary identifiers, are trained
from labelled tokens.  Random are the values of pattern matches in a sample of the documents and
generated strings; ordinary are the sample's other tokens of letters, digits and underscores
that two different texts or more hold, so that secrets no pattern knows aren't learnt as ordinary,
and a stock of names made of common parts, each of these once more in another form (capitals, identifiers of two
parts, numbers), for a sample of prose has few of them.  So there is a model for any table.  A fifth of both is held out.  A token is a secret if the log-likelihood ratio of the models is over
``MIN_RATIO`` and, for each of its character pairs, over a threshold that at most ``FALSE_ALARMS`` of
the held-out ordinary tokens reach (``MIN_PER_CHAR`` at least; no higher than half of what 95 % of the held-out
random strings reach, should the sample hold secrets that no pattern knows).  Model spans are added
where they overlap no pattern's match.  Tokens of fewer than 8 characters are not scored.

The sample is of ``TRAIN_ROWS`` rows on average, chosen by a hash of the row.  Positions come from
``\\G``-anchored matches that return the gap before each match, so one pass finds all and a text
without a match is left at once.  All of it is built-in functions; a model is a table of
``128 ** 2`` numbers, whatever the corpus.

Defined cases: null text is empty; very long tokens are scored whole; repeated rows are scanned
alone; an empty table's model is that of the stock and of generated strings; columns of the input
stay, those named like a result excepted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .native import let
from .storage import save

#: Kinds in order, with their pattern, the group whose length counts, and its least length: fixed values.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: What a text must hold for the pattern to be tried, where that is quicker to see.
HINTS = {
    "assign": lambda text: (text.contains(":") | text.contains("=")) & text.rlike(PATTERNS[0][1]),
    "access": lambda text: text.contains("AKIA") & text.rlike(r"AKIA[A-Z0-9]{16}"),
    "hex": lambda text: text.rlike("[0-9a-f]{24}"),
}
KINDS = [p[0] for p in PATTERNS] + ["random"]
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{8,}"
#: Rows of the sample, and generated strings.
TRAIN_ROWS, GENERATED = 10_000, 3000
#: Common parts of names, of which each pair makes an ordinary string.
PARTS = "user name value count index total report status handler request response config number account document message session content create update delete return search filter".split()
MIN_RATIO, MIN_PER_CHAR, FALSE_ALARMS = 12.0, 0.6, 0.0005
#: Weight of what was never seen, in the ordinary and the random model.
BACK_OFF = (5.0, 20.0)
_SPANS = "array<struct<start:int,end:int,value:string>>"


def find(text: Column, pattern: str, group: int = 0, keep=lambda value: F.lit(True)) -> Column:
    """Leftmost non-overlapping matches, as structs of start, end (code points) and the value of ``group``, for which ``keep`` holds.

    The list of spans grows by a copy, so only the matches that are kept are put in it."""
    anchored = rf"\G(?s:(.*?))({pattern})"
    pick = lambda n: F.regexp_extract_all(text, F.lit(anchored), F.lit(n))

    def spans(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

        def step(held: Column, x: Column) -> Column:
            begin = held["at"] + x["gap"]
            end = begin + x["size"]
            more = F.concat(held["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"))))
            return F.struct(end.alias("at"), F.when(x["keep"], more).otherwise(held["out"]).alias("out"))

        return F.aggregate(parts, start, step, lambda held: held["out"])

    parts = F.zip_with(
        F.arrays_zip(pick(1).alias("gap"), pick(2).alias("hit")),
        pick(group + 2),
        lambda a, v: F.struct(F.length(a["gap"]).alias("gap"), F.length(a["hit"]).alias("size"), v.alias("value"), keep(v).alias("keep")),
    )
    return let(parts, spans)


def _found(text: Column, pattern: str, hint, group: int, least: int) -> Column:
    hits = find(text, pattern, group, lambda value: F.length(value) >= least)
    return F.when(hint(text), hits).otherwise(F.array().cast(_SPANS))


def pattern_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``s_row``, the rows of ``docs``, with ``s_text``, a column of spans for each pattern, ``s_base`` with all of them and ``s_words``, the tokens."""
    docs = docs.select(F.struct("*").alias("s_row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("s_text"))
    docs = docs.withColumns({f"s_{kind}": _found(F.col("s_text"), pattern, HINTS[kind], group, least) for kind, pattern, group, least in PATTERNS})
    docs = docs.withColumn("s_base", F.array_sort(F.flatten(F.array(*[_kind(f"s_{k}", i) for i, k in enumerate(KINDS[:3])]))))
    return docs.withColumn("s_words", F.regexp_extract_all("s_text", F.lit(TOKEN), F.lit(0)))


def _apart(tokens: Column) -> Column:
    """Token spans that overlap no pattern's match."""
    return F.filter(tokens, lambda t: ~F.exists("s_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))


def _kind(spans: str, number: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end")))


def _pair(token: Column, i: Column) -> Column:
    """Number of the pair of characters from ``i``, counted from 1, of an ASCII token."""
    return F.ascii(F.substr(token, i, F.lit(1))) * 128 + F.ascii(F.substr(token, i + 1, F.lit(1)))


@dataclass(frozen=True)
class MarkovRatio:
    """Log-likelihood ratios of character pairs, random over ordinary, row by row of ASCII, and the least mean ratio of a secret's pairs."""

    table: tuple[float, ...]
    per_pair: float = MIN_PER_CHAR

    @classmethod
    def fit(cls, labelled: DataFrame) -> MarkovRatio | None:
        """From rows of ``token`` (of ``ALPHABET``, two characters or more) and ``label`` (1 random, 0 ordinary)."""
        pairs = labelled.select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: _pair(F.col("token"), i))).alias("pair"))
        counts = {(r["label"], r["pair"]): r["count"] for r in pairs.groupBy("label", "pair").count().collect()}  # at most 2 * 128**2 rows
        if len({label for label, _ in counts}) < 2:
            return None
        codes, size = [ord(c) for c in ALPHABET], len(ALPHABET)
        sums = {(label, a): sum(counts.get((label, a * 128 + b), 0) for b in codes) for label in (0, 1) for a in codes}
        seen = {b: sum(counts.get((0, a * 128 + b), 0) for a in codes) for b in codes}
        # what was never seen: any character for random strings, the usual characters for ordinary ones
        usual = {b: (n + 0.5) / (sum(seen.values()) + 0.5 * size) for b, n in seen.items()}
        random = lambda a, b: (counts.get((1, a * 128 + b), 0) + BACK_OFF[1] / size) / (sums[1, a] + BACK_OFF[1])
        plain = lambda a, b: (counts.get((0, a * 128 + b), 0) + BACK_OFF[0] * usual[b]) / (sums[0, a] + BACK_OFF[0])
        table = [0.0] * 128**2
        for a in codes:
            for b in codes:
                table[a * 128 + b] = round(math.log(random(a, b) / plain(a, b)), 6)
        return cls(tuple(table))

    def ratio(self, token: Column) -> Column:
        """The log-likelihood ratio of a token of two characters or more."""
        table = F.split(F.lit(",".join(map(str, self.table))), ",").cast("array<double>")
        return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda sum_, i: sum_ + F.get(table, _pair(token, i)))

    def secret(self, token: Column) -> Column:
        return let(self.ratio(token), lambda r: (r > MIN_RATIO) & (r > self.per_pair * (F.length(token) - 1)))


def generated(spark: SparkSession, n: int = GENERATED) -> DataFrame:
    """``n`` random strings (``token``): lower and upper hexadecimal, Base64 and its letters and digits, of 12 to 40 characters."""
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.base64(F.unhex(digest))
    token = F.element_at(F.array(digest, F.upper(digest), base64, F.regexp_replace(base64, "[+/=]", "")), (F.col("id") % 4 + 1).cast("int"))
    return spark.range(n).select(F.substring(token, F.lit(1), F.expr("12 + id div 4 % 29").cast("int")).alias("token"))


def stock(spark: SparkSession) -> DataFrame:
    """Ordinary strings (``token``) of eight characters or more: each pair of ``PARTS``."""
    part = lambda i: F.element_at(F.array(*map(F.lit, PARTS)), i.cast("int") + 1)
    rows = spark.range(len(PARTS) ** 2)
    return rows.select(F.concat(part(F.expr(f"id div {len(PARTS)}")), part(F.col("id") % len(PARTS))).alias("token")).where(F.length("token") >= 8)


def written_forms(token: Column) -> Column:
    """Other ways in which ordinary text has a token of two characters or more: capitals, identifiers of two parts, with a number, and plain numbers."""
    digits = F.lpad(F.shiftrightunsigned(F.xxhash64(token), 1).cast("string"), 19, "0")
    half = F.floor(F.length(token) / 2).cast("int")
    a, b = F.substring(token, F.lit(1), half), F.substr(token, half + 1)
    number = lambda start, n: F.substring(digits, start, n)
    snake, camel = F.concat_ws("_", a, b), F.concat(a, F.initcap(b))
    return F.array(F.upper(token), F.initcap(token), snake, camel, F.initcap(F.upper(snake)), F.upper(snake), F.concat_ws("_", token, number(9, 4)), F.concat(camel, number(9, 2)), F.substring(digits, F.lit(2), F.length(token)), F.concat_ws("-", number(2, 3), number(5, 4), number(9, 4)))


def labelled(docs: DataFrame, text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """``token``, ``label`` (1 random, 0 ordinary) and ``held_out`` (a fifth) from a sample of ``rows`` rows on average."""
    share = min(1.0, rows / max(docs.count(), 1))
    some = docs.where(F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = pattern_spans(some.select(text_col), text_col)
    matched = some.select(F.explode(F.flatten(F.array(*[f"s_{k}" for k in KINDS[:3]]))).alias("s")).select(F.col("s.value").alias("token"))
    matched = matched.where(F.length("token") >= 12).unionByName(generated(docs.sparkSession)).withColumn("label", F.lit(1))
    # tokens of texts without a match need no positions; a secret is seldom in two texts, an identifier often is
    plain = some.where(F.size("s_base") == 0).select(F.xxhash64("s_text").alias("of"), F.explode("s_words").alias("token")).where(F.col("token").rlike(r"^[A-Za-z0-9_]+$"))
    plain = plain.distinct().groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    plain = plain.unionByName(stock(docs.sparkSession)).distinct().withColumn("label", F.lit(0))
    both = matched.where(~F.col("token").rlike(rf"[^{ALPHABET}]")).unionByName(plain).withColumn("held_out", F.pmod(F.xxhash64("token"), F.lit(5)) == 0)
    # an ordinary token and one other form of it are held out together
    forms = written_forms(F.col("token"))
    form = F.get(forms, F.pmod(F.xxhash64("token", F.lit(1)), F.size(forms)).cast("int"))
    return both.select("label", "held_out", F.explode(F.when(F.col("label") == 0, F.array("token", form)).otherwise(F.array("token"))).alias("token"))


def train(docs: DataFrame, text_col: str = "text", rows: int = TRAIN_ROWS) -> MarkovRatio:
    """Models from the ``labelled`` tokens that aren't held out, with the threshold that those held out call for."""
    tokens = save(labelled(docs, text_col, rows))
    model = MarkovRatio.fit(tokens.where("NOT held_out"))
    mean = F.round(model.ratio(F.col("token")) / (F.length("token") - 1), 3)
    held = tokens.where("held_out").select("label", mean.alias("mean"))
    at = held.agg(F.percentile(F.when(F.col("label") == 0, F.col("mean")), 1 - FALSE_ALARMS).alias("plain"), F.percentile(F.when(F.col("label") == 1, F.col("mean")), 0.05).alias("random")).first()
    return replace(model, per_pair=max(MIN_PER_CHAR, min(at["plain"], at["random"] / 2)))


def scan(docs: DataFrame, text_col: str = "text", model: MarkovRatio | None = None) -> DataFrame:
    """``docs`` with ``n_assign``, ``n_access``, ``n_hex``, ``base_spans`` and ``spans`` (arrays of start, kind number, end, by start and kind)."""
    model = model or train(docs, text_col)
    found = pattern_spans(docs, text_col)
    # positions are sought only in texts that hold a secret token
    placed = _apart(find(F.col("s_text"), TOKEN, keep=model.secret))
    found = found.withColumn("s_any", F.exists("s_words", model.secret))
    found = found.withColumn("s_random", F.when(F.col("s_any"), placed).otherwise(F.array().cast(_SPANS)))
    added = _kind("s_random", KINDS.index("random"))
    counts = {f"n_{k}": F.size(f"s_{k}").cast("long") for k in KINDS[:3]}
    results = {**counts, "base_spans": F.col("s_base"), "spans": F.array_sort(F.concat("s_base", added))}
    kept = [F.col(f"s_row.{c}") for c in docs.columns if c not in results]
    return found.select(*kept, *[c.alias(name) for name, c in results.items()])


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")
