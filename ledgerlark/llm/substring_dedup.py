"""Substring dedup by repeated-phrase automata.

1. *Anchors.*  Of each ``n`` consecutive words, the ``k``-word phrase with the smallest hash
   is an anchor, so equal windows have equal anchors.  Anchors are counted over the corpus.
2. *Confirm.*  Windows whose anchor recurs are counted by a 96-bit hash of all their words;
   those with two starts or more are the recurring passages.
3. *Compile.*  One shard of documents, the owner, writes the words of each recurring anchor;
   a join brings them to every shard that the anchor reaches.  A shard is about ``SHARD_CHARS``
   of text, so its Aho-Corasick automaton is of a bounded size.
4. *Stream.*  All documents of a shard are streamed through its automaton.  A recurring window
   holds the place of a hit, so only windows around hits are held against the passages.

Only hashes and one phrase an anchor and shard are shuffled, counted once per shard before the
shuffle, so a phrase in a third of all rows costs one row per shard.  Shards carry their number
as data, and what belongs to a shard is read from the shared folder, a folder for each
partition of the input, sorted by shard; so a rerun task finds the same.

Defined cases: null text is empty text; a text with fewer than ``n`` words loses nothing;
repeated rows are separate documents (each repeats the other); null ids are kept; an empty
table gives an empty result; other columns are ignored; a text longer than a shard is a shard of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .storage import filesystem, save, shared_dir
from .words import pieces_of, sliding, split_words, windows, word_hashes

#: Words of the phrase that anchors a window, and code points of text that one automaton serves.
ANCHOR_WORDS = 8
SHARD_CHARS = 4_000_000


def _anchors(h: np.ndarray, left: np.ndarray, n: int):
    """Anchor hash of each window start, with 0 where the text ends too soon, and phrase hashes."""
    k = min(ANCHOR_WORDS, n)
    phrases = windows(h, k)
    span = n - k + 1
    least = sliding(phrases, span, np.minimum)
    return np.where(left[: len(least)] >= n, least, np.uint64(0)), phrases, span


def _check(h: np.ndarray) -> np.ndarray:
    """Second hashes of words, for the 32 further bits of a phrase or window."""
    return h ^ (h >> np.uint64(17))


def _low(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _number(batches):
    """Rows with the input partition and their shard, a running number in it."""
    from pyspark import TaskContext

    part, shard = TaskContext.get().partitionId(), -1
    for batch in batches:
        for rows in pieces_of(batch, "text", SHARD_CHARS):
            shard += 1
            yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("text"), *(pa.array(np.full(len(rows), x, np.int32)) for x in (part, shard))], ["id", "text", "part", "shard"])


def _shards(batch: pa.RecordBatch):
    """((part, shard), rows of it) pairs of a batch."""
    part, shard = (batch.column(c).to_numpy() for c in ("part", "shard"))
    cuts = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(shard) != 0)) + 1), len(shard)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield (int(part[a]), int(shard[a])), batch.slice(a, b - a)


def _row(shard: tuple[int, int], **columns) -> pa.RecordBatch:
    arrays = {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()}
    size = len(next(iter(arrays.values())))
    return pa.RecordBatch.from_pydict(arrays | {k: pa.array(np.full(size, v, np.int32)) for k, v in zip(("part", "shard"), shard)})


class _Beside:
    """What the shared folder holds for a shard; the last one is kept."""

    def __init__(self, uri: str, columns: tuple[str, ...], make=None):
        self.uri, self.columns, self.make, self.shard = uri, columns, make, None

    def __call__(self, shard: tuple[int, int]):
        if shard != self.shard:
            import pyarrow.parquet as pq
            from pyarrow import fs

            self.held = None  # the last automaton goes before the next one comes
            files, root = filesystem(self.uri)
            found = files.get_file_info(fs.FileSelector(f"{root}/part={shard[0]}", allow_not_found=True))
            tables = [pq.read_table(files.open_input_file(f.path), columns=list(self.columns), filters=[("shard", "=", shard[1])]) for f in found if f.path.endswith(".parquet")]
            self.held = self.make(pa.concat_tables(tables) if tables else None) if self.make else self.sorted(tables)
            self.shard = shard
        return self.held

    def sorted(self, tables: list[pa.Table]) -> list[np.ndarray]:
        """The columns as arrays in the order of the first, each value of it once."""
        got = [np.concatenate([t.column(c).to_numpy() for t in tables]) if tables else np.zeros(0, np.int64) for c in self.columns]
        first = np.unique(got[0], return_index=True)[1]
        return [x[first] for x in got]


def _automaton(table: pa.Table | None):
    """The automaton of a shard's phrases; null if it has none."""
    import ahocorasick

    if table is None or not len(table):
        return None
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for chunk in table.column("phrase").chunks:
        for phrase in chunk:
            automaton.add_word(f" {phrase.as_py()} ")
    automaton.make_automaton()
    return automaton


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _count_anchors(n: int):
    def run(batches):
        for batch in batches:
            for shard, rows in _shards(batch):
                words = split_words(rows.column("text"))
                h = word_hashes(words)
                least, phrases, span = _anchors(h, words.left(), n)
                if not len(least):
                    continue
                edge = np.zeros(span - 1, np.uint64)
                chosen = np.flatnonzero((phrases == sliding(np.concatenate([edge, least, edge]), span, np.maximum)[: len(phrases)]) & (phrases > 0))
                value, first, count = np.unique(phrases[chosen].view(np.int64), return_index=True, return_counts=True)
                check = _low(windows(_check(h), min(ANCHOR_WORDS, n))[chosen[first]])
                yield _row(shard, anchor=value, check=check, times=count.astype(np.int64))

    return run


def _phrases(n: int, anchors: str):
    """Words of the recurring anchors that a shard owns."""
    beside, k = _Beside(anchors, ("anchor", "check", "owner")), min(ANCHOR_WORDS, n)

    def run(batches):
        for batch in batches:
            for shard, rows in _shards(batch):
                anchor, check, owner = beside(shard)
                wanted = anchor[owner.astype(bool)]
                words = split_words(rows.column("text"))
                h = word_hashes(words)
                value, left = windows(h, k).view(np.int64), words.left()
                at = np.flatnonzero(_member(wanted, value) & (left[: len(value)] >= k))
                if not len(at):
                    continue
                value, first = np.unique(value[at], return_index=True)
                at = at[first]
                data = words.data.tobytes()
                text = [b" ".join(data[words.start[i] : words.end[i + k - 1]].split()).decode() for i in at.tolist()]
                yield pa.RecordBatch.from_pydict({"p_anchor": pa.array(value), "p_check": pa.array(_low(windows(_check(h), k)[at])), "phrase": pa.array(text, pa.string())})

    return run


def _count_windows(n: int, anchors: str):
    beside = _Beside(anchors, ("anchor",))

    def run(batches):
        for batch in batches:
            for shard, rows in _shards(batch):
                recurring = beside(shard)[0]
                words = split_words(rows.column("text"))
                h = word_hashes(words)
                least, _, _ = _anchors(h, words.left(), n)
                wanted = np.flatnonzero(_member(recurring, least.view(np.int64)) & (least > 0))
                hash_, check = (windows(x, n)[wanted] for x in (h, _check(h)))
                value, first, count = np.unique(hash_.view(np.int64), return_index=True, return_counts=True)
                yield _row(shard, hash=value, check=_low(check[first]), times=count.astype(np.int64))

    return run


def _around(ends: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """Window starts, as a mask, of a text of ``n_words`` whose window holds a phrase that ends before word ``ends``."""
    step = np.zeros(n_words + 1, np.int32)
    np.add.at(step, np.maximum(ends - n, 0), 1)
    np.add.at(step, ends - min(ANCHOR_WORDS, n) + 1, -1)
    return np.cumsum(step)[:n_words] > 0


def _locate(n: int, phrases: str, passages: str):
    automata, confirmed = _Beside(phrases, ("phrase",), _automaton), _Beside(passages, ("hash", "check"))

    def recurring(shard: tuple[int, int], words, split: list[list[str]]) -> np.ndarray:
        """Window starts whose window recurs, as a mask: windows around the automaton's hits, held against the passages."""
        near, automaton = np.zeros(len(words.start), bool), automata(shard)
        for w, first in zip(split, words.first.tolist()):
            if automaton is not None and len(w) >= n:
                hits = np.fromiter((e for e, _ in automaton.iter(f" {' '.join(w)} ")), dtype=np.int64)
                if len(hits):
                    ends = np.searchsorted(np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1), hits) + 1
                    near[first : first + len(w)] = _around(ends, n, len(w))
        at = np.flatnonzero(near & (words.left() >= n))
        if len(at):
            held, checks = confirmed(shard)
            h = word_hashes(words)
            hash_, check = windows(h, n)[at].view(np.int64), _low(windows(_check(h), n)[at])
            known = _member(held, hash_)
            known[known] = checks[np.searchsorted(held, hash_[known])] == check[known]
            near[:] = False
            near[at[known]] = True
        else:
            near[:] = False
        return near

    def piece(shard: tuple[int, int], ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        words = split_words(texts)
        split = [str(t, "utf-8").split(" ") if t else [] for t in _normal(words)]
        recurs = recurring(shard, words, split)
        spans, kept = [], []
        for w, first in zip(split, words.first.tolist()):
            starts = np.flatnonzero(recurs[first : first + len(w)])
            found: list = []
            if len(starts):
                fresh = np.concatenate([[True], np.diff(starts) > n])
                found = list(zip(starts[fresh].tolist(), (starts[np.concatenate([fresh[1:], [True]])] + n).tolist()))
            spans.append([{"start": a, "end": b} for a, b in found])
            rest, at_word = [], 0
            for a, b in found:
                rest += w[at_word:a]
                at_word = b
            kept.append(" ".join(rest + w[at_word:]) if found else " ".join(w))
        n_words = np.diff(words.first).astype(np.int64)
        removed = np.array([sum(x["end"] - x["start"] for x in s) for s in spans], np.int64)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n_words), pa.array(removed), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())],
            ["id", "n_words", "n_removed", "spans", "kept_text"],
        )

    def run(batches):
        for batch in batches:
            for shard, rows in _shards(batch):
                yield piece(shard, rows.column("id"), rows.column("text"))

    return run


def _normal(words):
    """Each text's words joined by one space, as bytes."""
    data = words.data.tobytes()
    for a, b in zip(words.first, words.first[1:]):
        yield b" ".join(data[words.start[a] : words.end[b - 1]].split()) if b > a else b""


def remove_repeats(docs: DataFrame, n: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id``, ``n_words``, ``n_removed``, ``spans`` (word ranges that lie
    in a recurring window of ``n`` words) and ``kept_text`` (the other words, joined by one space)."""
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shards = save(rows.mapInArrow(_number, f"id {id_type}, text string, part int, shard int"))
    texts = shards.select("text", "part", "shard")

    def beside(found: DataFrame) -> str:
        """A folder for each partition of the input, in the order of its shards."""
        path = shared_dir(spark)
        ordered = found.repartition("part").sortWithinPartitions("part", "shard")
        ordered.write.option("parquet.block.size", 1 << 20).partitionBy("part").parquet(path)  # small groups of rows: a shard reads its own
        return path

    def recurring(counts: DataFrame, *key: str) -> DataFrame:
        """Rows whose key occurs twice or more; the first shard owns the key."""
        same = Window.partitionBy(*key)
        owner = F.min(F.struct("part", "shard")).over(same) == F.struct("part", "shard")
        return counts.withColumn("total", F.sum("times").over(same)).withColumn("owner", owner).where("total > 1").drop("times", "total")

    places = "part int, shard int"
    anchors = beside(recurring(texts.mapInArrow(_count_anchors(n), f"anchor long, check int, times long, {places}"), "anchor", "check"))
    passages = beside(recurring(texts.mapInArrow(_count_windows(n, anchors), f"hash long, check int, times long, {places}"), "hash", "check").drop("owner"))
    phrases = texts.mapInArrow(_phrases(n, anchors), "p_anchor long, p_check int, phrase string").dropDuplicates(["p_anchor", "p_check"])
    reached = spark.read.schema("anchor long, check int, shard int, part int").parquet(anchors)
    named = reached.join(phrases, (F.col("anchor") == F.col("p_anchor")) & (F.col("check") == F.col("p_check")))
    phrases = beside(named.select("phrase", "part", "shard"))
    return shards.mapInArrow(_locate(n, phrases, passages), f"id {id_type}, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string")
