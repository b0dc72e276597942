"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

1. *Weights.*  A shingle is five words; its weight is its count in the text times its inverse
   document frequency, taken as the mean of its words' own, log(1 + 1 / max(share, ``IDF_FLOOR``)) for a
   word's share of all documents.  So words below the floor weigh the same, and those above it
   are at most mean distinct words per document / ``IDF_FLOOR``, which bounds what is sent to tasks.
2. *Sampling.*  Shingles are dealt to ``SAMPLES`` bins by hash and each bin gives one sample of
   improved consistent weighted sampling, (shingle, t); an empty bin borrows from the next.
3. *Bands.*  ``ROWS`` samples make a band key; texts with one band key share a bucket, and
   every two texts that share a bucket are compared, once.
4. *Small buckets*, of ``SMALL`` texts at most, give all their pairs.
5. *Large buckets* are cut into tiles of bounded texts and characters.  Each two tiles are a
   cell, whose texts meet in one task; it gives the number of each text's links and the links
   that join its classes, not its pairs.  A pair belongs to the cell of its first common band,
   and to none if it shares a small bucket.
6. *Verify.*  Weighted Jaccard similarity of whole texts; pairs at ``SIMILARITY`` or more are
   links and components of links are classes.

The nodes are distinct texts, so copies cost a row each and no pairs.  Rows grow with bucket
sizes and with their squares only over many tiles; the comparisons of a large bucket do grow
with its square.  Popular partners are salted.

Defined cases: null text is empty text; equal texts (empty ones too) are one class; a text
with one to four words is one shingle; classes are of texts, so rows that repeat or have null
or equal ids each get their text's; null ids rank last; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, functions as F

from .storage import save
from .words import mix, pieces_of, split_words, windows, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
SAMPLES, ROWS = 128, 4
IDF_FLOOR = 0.001
PIECE_CHARS, GROUP_ROWS = 3_000_000, 200
#: Texts of a small bucket, and the bounds of a tile of a large one.
SMALL, TILE_ROWS, TILE_CHARS = 8, 2000, 4_000_000
#: Inverse document frequencies are kept in fixed point, so that sums don't depend on order.
_POINT = 1024.0


class Weigher:
    """TF-IDF weights of the shingles of texts."""

    def __init__(self, words: np.ndarray, idf: np.ndarray, rare: float):
        order = np.argsort(words)
        self.words, self.idf, self.rare = words[order], np.round(idf[order] * _POINT).astype(np.int64), int(round(rare * _POINT))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, shingle hash and weight of each distinct shingle of each text, by text and hash."""
        words = split_words(texts)
        h = word_hashes(words)
        if len(self.words) and len(h):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            idf = np.where(self.words[at] == h, self.idf[at], self.rare)
        else:
            idf = np.full(len(h), self.rare, np.int64)
        until = np.concatenate([[0], np.cumsum(idf)])
        count = np.diff(words.first)
        shingles = windows(h, SHINGLE)
        whole = np.flatnonzero(words.left()[: len(shingles)] >= SHINGLE)
        doc, hash_, weight = words.doc[whole], shingles[whole], until[whole + SHINGLE] - until[whole]
        short = np.flatnonzero((count > 0) & (count < SHINGLE))
        if len(short):
            first = words.first[short]
            doc = np.concatenate([doc, short])
            hash_ = np.concatenate([hash_, [windows(h[a : a + n], n)[0] for a, n in zip(first, count[short])]])
            weight = np.concatenate([weight, (until[first + count[short]] - until[first]) * SHINGLE // count[short]])
        order = np.lexsort((hash_, doc))
        doc, hash_, weight = doc[order], hash_[order], weight[order]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (np.diff(doc) != 0) | (hash_[1:] != hash_[:-1])
        at = np.flatnonzero(fresh)
        times = np.diff(np.append(at, len(doc)))
        return doc[at], hash_[at], weight[at] * times / (SHINGLE * _POINT)


def _fixed(weight: np.ndarray) -> np.ndarray:
    """Weights as whole numbers, whose sums don't depend on order."""
    return np.rint(weight * (SHINGLE * _POINT)).astype(np.int64)


def _uniform(h: np.ndarray, n: int) -> np.ndarray:
    """Uniform numbers in (0, 1] from hashes."""
    return ((mix(h + np.uint64(n * 0xC2B2AE3D27D4EB4F & (2**64 - 1))) >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def sample(doc: np.ndarray, hash_: np.ndarray, weight: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the samples, ``n_docs`` by ``SAMPLES``, and which texts have any.

    Shingles of a short text stand in several bins, each time with its own randomness, so that
    bins hold two or more."""
    n = np.bincount(doc, minlength=n_docs)
    times = (2 ** np.ceil(np.log2(np.maximum(2 * SAMPLES / np.maximum(n, 1), 1)))).astype(np.int64)[doc]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    doc, shingle, weight = (np.repeat(x, times) for x in (doc, hash_, weight))
    hash_ = mix(shingle + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    r = -np.log(_uniform(hash_, 1) * _uniform(hash_, 2))
    log_c = np.log(-np.log(_uniform(hash_, 3) * _uniform(hash_, 4)))
    beta = _uniform(hash_, 5)
    t = np.floor(np.log(weight) / r + beta)
    log_a = log_c - r * (t - beta) - r
    cell = doc * SAMPLES + (mix(hash_ ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(SAMPLES)).astype(np.int64)
    least = np.full(n_docs * SAMPLES, np.inf)
    np.minimum.at(least, cell, log_a)
    won = log_a == least[cell]
    codes = np.zeros(n_docs * SAMPLES, np.uint64)
    codes[cell[won]] = mix(shingle[won] ^ (t[won].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    codes, full = codes.reshape(n_docs, SAMPLES), np.isfinite(least).reshape(n_docs, SAMPLES)
    some = full.any(axis=1)
    # an empty bin takes the code of the next full one, marked with the distance
    twice = np.concatenate([full, full], axis=1)
    at = np.where(twice, np.arange(2 * SAMPLES), 4 * SAMPLES)
    ahead = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :SAMPLES]
    far = ahead - np.arange(SAMPLES)
    filled = np.take_along_axis(codes, ahead % SAMPLES, axis=1) + far.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return filled, some


def band_keys(codes: np.ndarray) -> np.ndarray:
    """Band keys of each row of codes."""
    bands = SAMPLES // ROWS
    parts = codes.reshape(len(codes), bands, ROWS)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(codes), bands)).copy()
    for i in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key


def _count_words(batches):
    for batch in batches:
        for rows in pieces_of(batch, "text", PIECE_CHARS):
            words = split_words(rows.column("text"))
            h = word_hashes(words)
            once = np.unique(mix(words.doc.astype(np.uint64)) ^ h, return_index=True)[1]
            value, count = np.unique(h[once].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(count.astype(np.int64))], ["word", "df"])


def weigher(docs: DataFrame, text_col: str = "text", floor: float = IDF_FLOOR) -> Weigher:
    """Document frequencies of the words of all documents."""
    n = docs.count()
    counts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_words, "word long, df long")
    common = counts.groupBy("word").agg(F.sum("df").alias("df")).where(F.col("df") >= n * floor).toPandas()
    return Weigher(common["word"].to_numpy(np.int64).view(np.uint64), np.log(1 + n / common["df"].to_numpy(np.float64)), float(np.log(1 + 1 / floor) if n * floor > 1 else np.log(1 + n)))


def _sign(held):
    def run(batches):
        for batch in batches:
            for rows in pieces_of(batch, "text", PIECE_CHARS):
                doc, hash_, weight = held.value(rows.column("text"))
                codes, some = sample(doc, hash_, weight, len(rows))
                keys = band_keys(codes)
                lists = [k if s else k[:0] for k, s in zip(keys.view(np.int64), some)]
                chars = pc.utf8_length(rows.column("text")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("row"), rows.column("digest"), chars, pa.array(lists, pa.list_(pa.int64()))], ["id", "row", "digest", "chars", "keys"])

    return run


def _verify(held):
    def run(batches):
        rep, vector = None, None
        for batch in batches:
            for rows in pieces_of(batch, "text", PIECE_CHARS):
                doc, hash_, weight = held.value(rows.column("text"))
                first = np.searchsorted(doc, np.arange(len(rows) + 1))
                a, b, out = rows.column("a").to_pylist(), rows.column("b").to_pylist(), []
                for i, (x, y) in enumerate(zip(a, b)):
                    part = slice(first[i], first[i + 1])
                    mine = hash_[part], _fixed(weight[part])
                    if x is None:
                        rep, vector = y, mine
                        continue
                    assert rep == y, "a pair without its partner's text"
                    at = np.searchsorted(vector[0], mine[0])
                    at = np.minimum(at, max(len(vector[0]) - 1, 0))
                    same = vector[0][at] == mine[0] if len(vector[0]) else np.zeros(len(mine[0]), bool)
                    both = np.minimum(mine[1][same], vector[1][at[same]]).sum()
                    union = mine[1].sum() + vector[1].sum() - both
                    out.append((x, y, float(both / union) if union else 0.0))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.binary(), pa.float64()))], ["a", "b", "similarity"])

    return run


def _links(pairs: DataFrame, texts: DataFrame, held, similarity: float) -> DataFrame:
    """The pairs (a, b) of digests whose texts are similar; b's text goes ahead of its partners', once a salt."""
    often = save(pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / GROUP_ROWS).cast("int")).select(F.col("b").alias("o_b"), "salts"))
    texts = texts.select(F.col("digest").alias("t_digest"), "text")
    ours = pairs.join(texts, F.col("a") == F.col("t_digest")).select("a", "b", "text")
    # most partners have one salt: only those with more are looked up
    hot = often.where("salts > 1")
    ours = ours.join(hot, F.col("b") == F.col("o_b"), "left").select("a", "b", "text", F.coalesce(F.pmod(F.xxhash64("a"), F.col("salts")), F.lit(0)).cast("int").alias("salt"))
    theirs = often.join(texts, F.col("o_b") == F.col("t_digest")).select(F.lit(None).cast("binary").alias("a"), F.col("o_b").alias("b"), "text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    rows = ours.unionByName(theirs).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return rows.select("a", "b", "text").mapInArrow(_verify(held), "a binary, b binary, similarity double").where(F.col("similarity") >= similarity)


def _cell_links(band: int, cross: bool, keys: np.ndarray, large: np.ndarray, tile: np.ndarray, first: np.ndarray, hash_: np.ndarray, weight: np.ndarray, similarity: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that join the classes of a cell's texts, and each text's number of links.

    ``keys``: band keys of the texts, ``large``: bits of the bands where their buckets are large,
    ``tile``: their tiles, of which only different ones are compared if ``cross``,
    ``first``: where their shingles begin."""
    n = len(keys)
    size, local = np.diff(first), np.unique(hash_, return_inverse=True)[1]
    until = np.concatenate([[0], np.cumsum(weight)])
    total = until[first[1:]] - until[first[:-1]]
    bits = np.uint64(1) << np.arange(keys.shape[1], dtype=np.uint64)
    early = bits[band] - np.uint64(1)
    mine, label, links, degree = np.zeros(local.max(initial=-1) + 1, np.int64), np.arange(n), [], np.zeros(n, np.int64)
    for x in range(n - 1):
        # texts whose weights differ by more can't be similar; the margin is for rounding
        near = np.minimum(total[x], total[x + 1 :]) >= (similarity - 1e-9) * np.maximum(total[x], total[x + 1 :])
        near &= size[x + 1 :] > 0
        if cross:
            near &= tile[x + 1 :] != tile[x]
        y = np.flatnonzero(near) + x + 1
        if not len(y) or not size[x]:
            continue
        common = np.where(keys[y] == keys[x], bits, np.uint64(0)).sum(axis=1, dtype=np.uint64)
        y = y[(common & ~large[x] == 0) & (common & early == 0)]
        if not len(y):
            continue
        part = slice(first[x], first[x + 1])
        mine[local[part]] = weight[part]
        begin = np.cumsum(size[y]) - size[y]
        at = np.arange(size[y].sum()) + np.repeat(first[y] - begin, size[y])
        both = np.add.reduceat(np.minimum(mine[local[at]], weight[at]), begin)
        mine[local[part]] = 0
        y = y[both / (total[x] + total[y] - both) >= similarity]
        degree[x] += len(y)
        degree[y] += 1
        for other, at in zip(*np.unique(label[y], return_index=True)):
            if other != label[x]:
                links.append((x, int(y[at])))
                label[label == other] = label[x]
    return links, degree


def _compare_cells(held, similarity: float):
    """Of rows sorted by cell: links (a, b), and texts a with their number of links in the cell."""

    def settle(key, rows):
        digest, keys, large, tile, vectors = zip(*rows)
        keys = np.array(keys, np.int64)
        band = int(np.flatnonzero(keys[0] == key[0])[0])
        first = np.concatenate([[0], np.cumsum([len(h) for h, _ in vectors])])
        hash_, weight = (np.concatenate(x) for x in zip(*vectors))
        links, degree = _cell_links(band, key[1] != key[2], keys, np.array(large, np.int64).view(np.uint64), np.array(tile), first, hash_, weight, similarity)
        a = [digest[max(x, y, key=digest.__getitem__)] for x, y in links] + [digest[x] for x in np.flatnonzero(degree)]
        b = [digest[min(x, y, key=digest.__getitem__)] for x, y in links] + [None] * (len(a) - len(links))
        n = [None] * len(links) + degree[degree > 0].tolist()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(n, pa.int64())], ["a", "b", "n"])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for piece in pieces_of(batch, "text", PIECE_CHARS):
                doc, hash_, weight = held.value(piece.column("text"))
                first = np.searchsorted(doc, np.arange(len(piece) + 1))
                cells = zip(*(piece.column(c).to_pylist() for c in ("key", "c1", "c2")))
                members = zip(*(piece.column(c).to_pylist() for c in ("digest", "keys", "large", "tile")))
                for i, (key, member) in enumerate(zip(cells, members)):
                    if key != now:
                        if len(rows) > 1:
                            yield settle(now, rows)
                        now, rows = key, []
                    if rows and rows[-1][0] == member[0]:
                        continue  # null ids can give a text twice
                    part = slice(first[i], first[i + 1])
                    rows.append((*member, (hash_[part].copy(), _fixed(weight[part]))))
        if len(rows) > 1:
            yield settle(now, rows)

    return run


def _large_links(band: DataFrame, buckets: DataFrame, keys: DataFrame, texts: DataFrame, held, similarity: float) -> DataFrame:
    """Links (a, b) that join the classes of large buckets, and their texts a with a number ``n`` of links."""
    tiles = F.greatest(F.ceil(F.col("n") / TILE_ROWS), F.ceil(F.col("chars") / TILE_CHARS)).cast("int")
    buckets = buckets.where(F.col("n") > SMALL).select(F.col("key").alias("k"), tiles.alias("tiles"))
    held_in = save(band.join(buckets, F.col("key") == F.col("k")).select("digest", "pos", "key", "tiles"))
    bits = held_in.groupBy("digest").agg(F.sum(F.expr("shiftleft(1L, pos)")).alias("large"))
    texts = keys.join(bits, "digest").join(texts, "digest").select(F.col("digest").alias("t_digest"), "keys", "large", "text")
    placed = held_in.withColumn("tile", F.pmod(F.xxhash64("digest"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("digest", "key", "tile", F.least("tile", "other").alias("c1"), F.greatest("tile", "other").alias("c2"))
    rows = placed.join(texts, F.col("digest") == F.col("t_digest")).select("digest", "key", "tile", "c1", "c2", "keys", "large", "text")
    rows = rows.repartition("key", "c1", "c2").sortWithinPartitions("key", "c1", "c2", "digest")
    return rows.mapInArrow(_compare_cells(held, similarity), "a binary, b binary, n long")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, of all nodes of links (a, b)."""
    nodes = links.select(F.col("a").alias("node")).union(links.select("b"))
    # with a loop at each node, one grouping gives both the old and the new label
    near = save(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).union(nodes.select("node", "node")).distinct())
    labels = save(near.groupBy("node").agg(F.min("other").alias("label")))
    while True:
        seen = near.join(labels.select(F.col("node").alias("l_node"), "label"), F.col("other") == F.col("l_node"))
        step = seen.groupBy("node").agg(F.min("label").alias("label"), F.max(F.when(F.col("other") == F.col("node"), F.col("label"))).alias("old"))
        # a label's own label is nearer to the least, so that rounds grow with the logarithm of a chain
        step = step.join(labels.select(F.col("node").alias("j_node"), F.col("label").alias("jump")), F.col("label") == F.col("j_node")).select("node", "old", F.least("label", "jump").alias("label"))
        moved = Observation()
        labels = save(step.observe(moved, F.count_if(F.col("old") != F.col("label")).alias("n"))).select("node", "label")
        if not moved.get["n"]:
            return labels


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id, row, digest) of all documents, ``row`` being a hash of all columns, and (k_digest, class, class_id, n_links) of all texts."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(*docs.columns).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    held = spark.sparkContext.broadcast(weigher(docs, text_col))
    id_type = docs.schema[id_col].dataType.simpleString()
    signed = save(rows.mapInArrow(_sign(held), f"id {id_type}, row long, digest binary, chars long, keys array<long>"))
    keys = signed.where(F.size("keys") > 0).groupBy("digest").agg(F.first("keys").alias("keys"), F.first("chars").alias("chars"))
    band = save(keys.select("digest", "chars", F.posexplode("keys").alias("pos", "key")))
    buckets = save(band.groupBy("key").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).where("n > 1"))
    shared = save(band.join(buckets.select(F.col("key").alias("k"), "n"), F.col("key") == F.col("k")).select("key", "digest", "n"))
    members = shared.where(F.col("n") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list("digest")).alias("m"))
    later = lambda b, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda a: F.struct(a.alias("a"), b.alias("b")))
    pairs = save(members.select(F.explode(F.flatten(F.transform("m", later))).alias("p")).select("p.a", "p.b").distinct())
    # one row a text that is in a bucket with others: that of its least id
    least = signed.groupBy("digest").agg(F.min("id").alias("id"))
    wanted = shared.select("digest").distinct().join(least, "digest").select(F.col("digest").alias("w_digest"), F.col("id").alias("w_id"))
    texts = save(rows.join(wanted, (F.col("digest") == F.col("w_digest")) & F.col("id").eqNullSafe(F.col("w_id")), "left_semi").select("digest", "text"))
    # null ids can give a text twice
    links = save(_links(pairs, texts, held, similarity).select("a", "b").distinct())
    large = save(_large_links(band, buckets, keys.select("digest", "keys"), texts, held, similarity))
    labels = components(links.unionByName(large.where("b IS NOT NULL").select("a", "b")))
    label = labels.select(F.col("node").alias("l_node"), "label")
    ends = links.select("a", F.lit(1).cast("long").alias("n")).unionByName(links.select(F.col("b").alias("a"), F.lit(1).cast("long").alias("n")))
    degree = ends.unionByName(large.where("b IS NULL").select("a", "n")).groupBy("a").agg(F.sum("n").alias("n_links"))
    texts_of = signed.groupBy("digest").agg(F.min("id").alias("least"))
    known = texts_of.join(label, F.col("digest") == F.col("l_node"), "left").withColumn("label", F.coalesce("label", "digest"))
    first = save(known.groupBy("label").agg(F.min("least").alias("class_id")).withColumnRenamed("label", "f_label"))
    known = known.join(first, F.col("label") == F.col("f_label")).join(degree.withColumnRenamed("a", "d_node"), F.col("digest") == F.col("d_node"), "left")
    known = save(known.select(F.col("digest").alias("k_digest"), F.col("label").alias("class"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return signed.select("id", "row", "digest"), known


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: ``id``, ``class_id`` (the least id of its class) and ``n_links`` (links of its text to different texts)."""
    signed, known = _classes(docs, id_col, text_col, similarity)
    return signed.join(known, F.col("digest") == F.col("k_digest")).select("id", "class_id", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: one of the least id, of rows that tie that of the least hash."""
    signed, known = _classes(docs, id_col, text_col, SIMILARITY)
    same = signed.groupBy("digest", "id", "row").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "n")).alias("first")
    chosen = save(same.join(known, F.col("digest") == F.col("k_digest")).groupBy("class").agg(first).select(F.col("first.id").alias("c_id"), F.col("first.row").alias("c_row"), F.col("first.n").alias("c_n")))
    # the row is a struct meanwhile, so that its columns may have any names
    kept = docs.select(F.struct("*").alias("c_doc"), F.col(id_col).alias("c_key"), F.xxhash64(*docs.columns).alias("c_hash"))
    kept = kept.join(chosen, (F.col("c_hash") == F.col("c_row")) & F.col("c_key").eqNullSafe(F.col("c_id")))
    # rows that are equal in all columns can only be told apart by dropping the others
    return kept.where("c_n = 1").select("c_doc.*").unionByName(kept.where("c_n > 1").select("c_doc.*").distinct())
