"""URL, line, mixing, WARC and token operators, and the pipeline, on small fixtures."""

import base64
import collections
import gzip
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlark.llm import line_dedup, mixing, token_ids, url_filters, warc
from ledgerlark.llm.storage import filesystem

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("no scheme/casino", "", "", None, "block"),
        ("https://WWW.Example.ORG/es/1?x", "www.example.org", "/es/1", "example.org/es/", "block"),
        ("https://example.org/en/12#a", "example.org", "/en/12", "example.org/en/1", "block"),
        ("https://example.org", "example.org", "", None, "allow"),
        ("https://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
        ("http://casino.example.com/fr/x", "casino.example.com", "/fr/x", "com/fr/", "allow"),
        ("http://casino.example.com/en/x", "casino.example.com", "/en/x", None, "block"),
        ("http://casinos.example.com/en/x", "casinos.example.com", "/en/x", None, "allow"),
        ("http://a.net/free-farm", "a.net", "/free-farm", None, "block"),
        ("http://a.net/free-free", "a.net", "/free-free", None, "allow"),
        ("a://b://c.net/d", "b:", "//c.net/d", None, "allow"),
        ("http://écasino.net/", "écasino.net", "/", None, "allow"),
        ("http://É.net/\n?q", "É.net", "/\n", None, "allow"),
    ],
)
def test_url_filters(spark, url, host, path, rule, verdict):
    rows = spark.createDataFrame([(1, url, "x", "y")], "page_id long, url string, host string, verdict string")
    r = url_filters.judge_urls(rows).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_url_vocabulary_from_a_table(spark):
    """Weights or classes, repeated, empty and null terms; escapes and punycode are read as what they stand for."""
    rows = spark.createDataFrame([("Café", "soft"), ("bonus", "soft"), ("bonus", "strict"), (" ", "strict"), (None, "soft"), ("x", "other"), ("казино", "strict")], "term string, kind string")
    vocabulary = url_filters.vocabulary_of(rows, class_col="kind")
    assert vocabulary == {"café": 1, "bonus": 2, "казино": 2}
    assert url_filters.vocabulary_of(spark.createDataFrame([("a", 3), ("A", 5), ("b", 0)], "term string, weight int")) == {"a": 5}
    urls = ["http://a.net/caf%C3%A9", "http://a.net/caf%C3%A9-b%6Fnus", "http://xn--80aswg.net/", "http://www.xn--80aedqt3a.net/x", "http://a.net/xn--80aedqt3a", "http://xn--.net/%zz", "http://a.net/%D0%BA%D0%B0%D0%B7%D0%B8%D0%BD%D0%BE", None]
    judged = url_filters.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string"), rules=(), vocabulary=vocabulary)
    got = {r.page_id: (r.term_weight, r.verdict) for r in judged.collect()}
    casino = "xn--" + "казино".encode("punycode").decode()
    assert url_filters.readable(f"http://www.{casino}.net/X") == "http://www.казино.net/x"
    one = url_filters.judge_urls(spark.createDataFrame([(0, f"http://www.{casino}.net/x")], "page_id int, url string"), rules=(), vocabulary=vocabulary).first()
    assert one.term_weight == 2 and got[0] == (1, "allow") and got[1] == (3, "block") and got[6] == (2, "block") and got[4] == got[5] == got[7] == (0, "allow")
    with pytest.raises(ValueError):
        url_filters.vocabulary_of(spark.range(2000).select(F.concat(F.col("id"), F.repeat(F.lit("x"), 5000)).alias("term"), F.lit(1).alias("weight")))


def test_line_dedup(spark):
    rng = np.random.default_rng(1)
    pages = [(i, ["a.org", "b.org", None][i % 3 if i < 30 else 0], [f"line {rng.integers(10**6)}", *(["Menu"] if i % 2 else []), *(["Cookies", "Cookies"] if i < 4 else []), " "]) for i in range(60)] + [(99, "a.org", None)]
    df = spark.createDataFrame(pages, "page_id long, host string, lines array<string>").withColumn("kept_text", F.lit(0)).withColumn("h_tasks", F.lit(0))
    got = {r.page_id: r for r in line_dedup.drop_boilerplate(df, F.col("host"), F.col("lines"), 0.1, 3).collect()}
    total = collections.Counter(h for _, h, _ in pages)
    n = collections.Counter((h, x) for _, h, ls in pages for x in set(ls or []))
    for i, host, lines in pages:
        kept = [x for x in lines or [] if not x.strip() or not (n[host, x] >= 3 and n[host, x] > total[host] * 0.1)]
        assert got[i].kept_text == "\n".join(kept) and got[i].n_dropped == len(lines or []) - len(kept)
    assert line_dedup.drop_boilerplate(df.where("false"), F.col("host"), F.col("lines")).count() == 0


def test_page_lines(spark):
    html = "<html><head><title>T</title><script>var t='</p>';</script></head><body><!-- x <p> --><p>One <b>bold</b> line</p><ul><li><a href='/'>Two</a></li></ul></body>"
    row = spark.createDataFrame([(html,), (None,)], "h string").select(line_dedup.page_lines(F.col("h")).alias("l")).collect()
    assert row[0].l == ["T", "One bold line", "Two"] and row[1].l == []


def fill(nodes, budget):
    """Water level over (capacity, weight) by bisection."""
    if sum(c for c, _ in nodes) <= budget:
        return [c for c, _ in nodes]
    low, high = 0.0, max(c / w for c, w in nodes)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(c, mid * w) for c, w in nodes) < budget else (low, mid)
    return [min(c, low * w) for c, w in nodes]


def mix_table(spark):
    rng = np.random.default_rng(2)
    rows = [(i, str(rng.choice(["en", "de"])) if i % 17 else None, f"src{rng.choice([0, 0, 0, 3, 11, 17])}", None if i % 23 == 0 else " ".join(["w"] * int(rng.integers(0, 60)))) for i in range(400)]
    return rows, spark.createDataFrame(rows + rows[:5], "doc_id long, lang string, source string, text string").withColumn("tokens", F.lit("clash")).withColumn("epoch", F.lit("clash"))


def test_budgets_fill_siblings_first(spark):
    rows, df = mix_table(spark)
    levels, weights = [F.col("lang"), F.col("source")], ({"en": 3.0, "de": 1.0}, {})
    got = mixing.budgets(df, levels, mixing.n_words(F.col("text")), weights, 9000, 2).collect()
    size = collections.Counter()
    for i, lang, source, text in rows + rows[:5]:
        size[lang, source] += len((text or "").split())
    families = sorted({a for a, _ in size}, key=str)
    tops = fill([(2 * sum(v for (a, _), v in size.items() if a == f), {"en": 3.0}.get(f, 1.0)) for f in families], 9000)
    want = {}
    for f, top in zip(families, tops):
        leaves = [k for k in size if k[0] == f]
        want |= dict(zip(leaves, fill([(2 * size[k], 1.0) for k in leaves], top)))
    assert {(r.l0, r.l1): pytest.approx(r.budget, rel=1e-6) for r in got} == want


def test_mix_takes_seeded_prefixes(spark):
    rows, df = mix_table(spark)
    mix = lambda seed: mixing.mix(df, [F.col("lang"), F.col("source")], mixing.n_words(F.col("text")), ({"en": 3.0, "de": 1.0},), 7000, 3, seed)
    got = mix(1).collect()
    assert got == got and sorted(mix(1).columns) == sorted(df.columns)
    key = lambda rs: sorted((r.doc_id, r.epoch) for r in rs)
    assert key(got) == key(mix(1).collect()) != key(mix(2).collect())
    budgets = {(r.l0, r.l1): r for r in mixing.budgets(df, [F.col("lang"), F.col("source")], mixing.n_words(F.col("text")), ({"en": 3.0, "de": 1.0},), 7000, 3).collect()}
    spent, copies = collections.Counter(), collections.Counter()
    for r in got:
        spent[r.lang, r.source] += len((r.text or "").split())
        copies[r.doc_id] = max(copies[r.doc_id], r.epoch + 1)
    for leaf, b in budgets.items():
        assert spent[leaf] <= b.budget + 1e-6 and spent[leaf] > b.budget - 61  # at most the next document short
        full = int(b.budget // b.tokens) if b.tokens else 1
        mine = [copies[i] for i, lang, source, _ in rows if (lang, source) == leaf]
        assert set(mine) <= {full, full + 1}
    assert mixing.mix(df.where("false"), [F.col("lang")], mixing.n_words(F.col("text"))).count() == 0


def test_mix_takes_the_rows_that_come_first(spark):
    """The very rows: by hand, a leaf's whole epochs and then its rows in the order of their hashes as long as the budget lasts."""
    _, df = mix_table(spark)
    names, seed = ["lang", "source"], 5
    weights, words = ({"en": 3.0, "de": 1.0},), mixing.n_words(F.col("text"))
    got = collections.Counter((r.doc_id, r.epoch) for r in mixing.mix(df, [F.col(n) for n in names], words, weights, 7000, 3, seed).collect())
    place = F.xxhash64(F.lit(seed), *names, F.xxhash64(F.struct(*df.columns)))
    rows = df.select("doc_id", *names, words.alias("t"), place.alias("place")).collect()
    want = collections.Counter()
    for b in mixing.budgets(df, [F.col(n) for n in names], words, weights, 7000, 3).collect():
        mine = [r for r in rows if (r.lang, r.source) == (b.l0, b.l1)]
        full = int(b.budget // b.tokens) if b.tokens else 1
        rest, buckets = b.budget - full * b.tokens if b.tokens else -1, -(-b.rows // mixing.BUCKET_ROWS)
        order = sorted({((r.place >> 20) % buckets, r.place) for r in mine})
        spent = 0
        for at in order:
            here = [r for r in mine if r.place == at[1]]  # equal rows tie
            for r in here:
                spent += r.t
                want.update((r.doc_id, e) for e in range(full))
                if spent <= rest:
                    want[r.doc_id, full] += 1
    assert got == want


def page_table(spark):
    rows = [(i, f"http://h{i}.net/é {i}", ["same", "", None, "a\r\n\r\nb", "é𝒳" * 50][i % 5] if i < 40 else f"page {i} " * 200) for i in range(60)] + [(None, None, "same"), (38, "http://again", "same")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("length", F.lit(1))


def test_warc_round_trip(spark):
    rows, df = page_table(spark)
    folder, index = warc.write_archives(df)
    assert set(index.columns) >= {"file", "offset", "length", "url", "payload_digest"}
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(rows)
    largest = collections.defaultdict(lambda: -1)
    for i, _, html in rows:
        largest[html or ""] = max(largest[html or ""], -1 if i is None else i)
    want = sorted((-1 if i is None else i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "revisit" if i is not None and i < largest[h or ""] else "response", largest[h or ""] if i is not None and i < largest[h or ""] else -1) for i, _, h in rows)
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == want
    assert {r.payload for r in got if r.record_type == "response"} == {h or "" for _, _, h in rows}
    few = warc.read_records(index.where("page_id % 7 = 0"), folder)
    assert sorted(r.page_id for r in few.collect()) == [i for i in range(60) if i % 7 == 0]
    assert warc.read_records(*warc.write_archives(df.where("false"))[::-1]).count() == 0
    only = warc.write_archives(df, revisit_min_bytes=10)
    assert warc.read_records(only[1].where("record_type = 'revisit'"), only[0]).agg(F.min("payload_bytes")).first()[0] >= 10


def test_warc_is_gzip_members(spark):
    _, df = page_table(spark)
    folder, index = warc.write_archives(df)
    files, root = filesystem(folder)
    name = index.first().file
    text = gzip.decompress(files.open_input_file(f"{root}/{name}").read()).decode()
    assert text.startswith("WARC/1.1\r\n") and text.count("WARC/1.1\r\n") == index.where(F.col("file") == name).count()


def test_ranges_join_neighbours():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 20 + warc.GAP_BYTES + 1, 5), ("b", 0, 5)]
    assert [(f, s, e, len(r)) for f, s, e, r in warc._ranges(rows)] == [("a", 0, 20, 2), ("a", rows[2][1], rows[2][1] + 5, 1), ("b", 0, 5, 1)]


TEXTS = [None, "", "Hello, world! it's 42 ÉCOLE İstanbul x\u00a0y o\u0301 “q” a_b # ###", "tab\tand\nnew\x0bline  double", "ΣΑΣ σας 日本語 emoji😀!", "Same words. same Words", "z" * 3000, "x\x1cy \u2028 z", "a.b,c *** don't WE'LL"] + [f"word{i} common text" for i in range(40)]


def test_ids_equal_the_tokenizers():
    encode, real = token_ids.WordEncoder(TOKENIZER, 2), Tokenizer.from_file(TOKENIZER)
    for _ in range(2):  # the second time from memory
        ids, n = encode(pa.array(TEXTS))
        for got, want in zip(np.split(ids, np.cumsum(n)[:-1]), real.encode_batch([t or "" for t in TEXTS], add_special_tokens=False), strict=True):
            assert got.tolist() == want.ids


def check_store(got, rows):
    """Stored ids are the tokenizer's; starts follow the keys, nulls first; occurrences number a key's rows in order."""
    real = Tokenizer.from_file(TOKENIZER)
    ids = {t: [*real.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows}
    got = sorted(got, key=lambda r: r.start)
    assert [r.key for r in got] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    assert sorted((str(r.key), np.frombuffer(r.payload, "<u2").tolist()) for r in got) == sorted((str(k), ids[t]) for k, t in rows)
    at, seen = 0, collections.Counter()
    for r in got:
        payload = np.frombuffer(r.payload, "<u2")
        assert (r.start, r.n_tokens, r.occurrence) == (at, len(payload), seen[r.key]) and r.crc == zlib.crc32(payload.astype("<u4").tobytes())
        at, seen[r.key] = at + len(payload), seen[r.key] + 1


def test_token_store(spark):
    rows = [(i * 3 - 20, t) for i, t in enumerate(TEXTS)] + [(None, "null key"), (-17, "again"), (-17, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("h", F.lit("clash"))
    check_store(token_ids.stored(df, TOKENIZER).withColumn("crc", token_ids.ids_crc32("payload")).collect(), rows)
    assert token_ids.stored(df.where("false"), TOKENIZER).count() == 0


def test_token_store_splits_a_hot_key(spark):
    """Rows of one key, and of null keys, are written by several tasks and numbered through."""
    rows = [(7, f"hot {i}") for i in range(300)] + [(None, f"none {i}") for i in range(200)] + [(i, f"cold {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = token_ids.stored(df, TOKENIZER).withColumn("crc", token_ids.ids_crc32("payload")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check_store(got, rows)


def test_unknown_keys_are_not_found(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(500)], "doc_id long, text string")
    folder, parts, _ = token_ids.write_ids(df, TOKENIZER)
    asked = spark.range(1000).select(F.col("id").alias("key"), F.lit(0).alias("occurrence"))
    assert sorted(r.key for r in token_ids.lookup(asked, folder, parts).collect()) == list(range(500))


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash(n):
    h = token_ids.key_hash(np.arange(n), np.zeros(n, np.int64))
    perfect = token_ids.PerfectHash.of(h)
    assert sorted(perfect(h).tolist()) == list(range(n))
    again = token_ids.PerfectHash.load(perfect.dump())
    assert (again(h) == perfect(h)).all()


def test_pipeline(spark, tmp_path):
    """Each stage keeps columns and takes effect; all but its randomised parts against the stages' own rules."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark leaks", "mixture", "token ids"]
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == columns
        path = str(tmp_path / name.replace(" ", "_"))
        after.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    assert set(seen[0]) > set(seen[1]) >= set(seen[2]) and set(seen[3]) <= set(seen[2])
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    words = {r.doc_id: r.text.split() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len([i for i in good if len(words[i]) >= 10 and i not in seen[0]]) <= 0.02 * len(good)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert sorted(r.doc_id for r in out) == seen[3]
    real = Tokenizer.from_file(TOKENIZER)
    text = {r.doc_id: r.text for r in docs.collect()}
    at = 0
    for r in sorted(out, key=lambda r: (r.doc_id, r.occurrence)):
        ids = real.encode(text[r.doc_id], add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
