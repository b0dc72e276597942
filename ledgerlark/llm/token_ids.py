"""Token ids in binary shards, found by document key through minimal perfect hashes.

Format.  A shard is the raw little-endian ids (16 or 32 bits) of the documents of one range of
keys, in ascending order, and nothing else.  The index is split by key hash into parts of
bounded size; a part is a minimal perfect hash of its keys (levels of bit arrays; the rank of
a key's bit is its slot) and, by slot, a 32-bit fingerprint, the shard, the offset in ids
and the number of ids.  A lookup touches one part: hash, a few bits, one slot.

Encoding.  The pre-tokenizer never joins text across white space, so a text's ids are those
of its words, one after another; words are encoded once and remembered (up to
``MEMO_WORDS`` a worker), in blocks of letters-only stems whose pieces end in marked tokens.

Shards and index parts are written under the attempt's own name, and the index names shards,
so rerun tasks do no harm.  Defined cases: a null text is empty and has the end id only; null
keys come first; a key that repeats is stored as key and occurrence (0, 1, ..., equal texts
together); an empty table has no shards; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from .storage import filesystem, save, shared_dir, write_whole
from .words import Words, mix, pieces_of, split_words, word_hashes

END_ID = 1
#: Words whose ids a worker remembers, and parts of words with ids of their own.
MEMO_WORDS, STEM_WORDS = 1_000_000, 200_000
#: Words to an encoding call, code points of text handled at once, and most keys of an index part.
BLOCK_WORDS, PIECE_CHARS, PART_KEYS = 512, 2_000_000, 100_000
#: Bits to a key of a level of the hash, and levels before the rest is listed.
GAMMA, LEVELS = 2, 40
READ_BYTES, GAP_BYTES = 8 << 20, 64 << 10
#: Bytes that a reading task reads on average, as long as ``MOST_TASKS`` are enough, and those of the spans that are dealt out to tasks.
TASK_BYTES, SPAN_BYTES, MOST_TASKS = 16 << 20, 2 << 20, 20_000
#: Letters, then marks that can't join them or form a contraction: one or two pieces.
_STEM = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")


class _Memo:
    """Ids of words by two hashes of their bytes, in sorted arrays: about 30 bytes a word."""

    def __init__(self, kind: str):
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, kind)

    def __len__(self) -> int:
        return len(self.hash)

    def find(self, hash_: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The place of each word, or -1."""
        if not len(self):
            return np.full(len(hash_), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hash, hash_), len(self) - 1)
        return np.where((self.hash[at] == hash_) & (self.check[at] == check), at, -1)

    def add(self, hash_: np.ndarray, check: np.ndarray, begin: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        """Words that ``find`` doesn't know; of two with one hash, one is kept."""
        hash_ = np.concatenate([self.hash, hash_])
        self.hash, order = np.unique(hash_, return_index=True)
        self.check = np.concatenate([self.check, check])[order]
        self.begin = np.concatenate([self.begin, begin + len(self.flat)])[order]
        self.size = np.concatenate([self.size, size])[order]
        self.flat = np.concatenate([self.flat, flat])


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` at ``begin``, one after another."""
    until = np.cumsum(size)
    return flat[np.repeat(begin - (until - size), size) + np.arange(until[-1] if len(until) else 0)]


class WordEncoder:
    """Little-endian ids of texts, equal to the tokenizer's own, by remembered words."""

    def __init__(self, path: str, width: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), f"<u{width}"
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, vocab = model.get("end_of_word_suffix"), model["vocab"]
        self.by_word = bool(suffix)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[number for token, number in vocab.items() if token.endswith(suffix)]] = True
        # words of late have a small table of their own, so that the large one is seldom sorted anew
        self.memo, self.late = _Memo(self.kind), _Memo(self.kind)
        self.stems: dict[str, bytes] = {"": b""}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, stems: list[str]) -> dict[str, bytes]:
        """Ids of strings that are one piece each; where the ends don't tell the pieces apart, one by one."""
        out = {}
        for k in range(0, len(stems), BLOCK_WORDS):
            some = stems[k : k + BLOCK_WORDS]
            ids = self._ids([" ".join(some)])[0]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                data, at = ids.tobytes(), (cuts * ids.itemsize).tolist()
                out |= zip(some, (data[a:b] for a, b in zip([0, *at], at)))
            else:
                out |= zip(some, (x.tobytes() for x in self._ids(some)))
        return out

    def _learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of words not met before."""
        texts = [w.decode() for w in words]
        # the tokenizer folds case itself; folding ASCII here only saves calls
        split = [m.groups() if (m := _STEM.fullmatch(t.lower() if t.isascii() else t)) else None for t in texts]
        stems = self.stems
        new = list({x for p in split if p for x in p if x not in stems})
        pieces = self._pieces(new)
        if len(stems) < STEM_WORDS:
            stems |= pieces
            pieces = stems
        else:
            pieces |= {x: stems[x] for p in split if p for x in p if x in stems}
        rest = iter(self._ids([t for t, p in zip(texts, split) if not p]))
        return [pieces[p[0]] + pieces[p[1]] if p else next(rest).tobytes() for p in split]

    def _remember(self, *words: np.ndarray) -> None:
        if len(self.memo) + len(self.late) < MEMO_WORDS:
            self.late.add(*words)
            if len(self.late) * 8 > len(self.memo):
                late, self.late = self.late, _Memo(self.kind)
                self.memo.add(late.hash, late.check, late.begin, late.size, late.flat)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has; a distinct word of the array is looked up once."""
        if self.by_word:
            words = split_words(texts)
            h = word_hashes(words)
            of, distinct = pd.factorize(h)
            some = np.empty(len(distinct), np.int64)
            some[of[::-1]] = np.arange(len(h) - 1, -1, -1)
            size = words.end - words.start
            # words of up to eight bytes and of one length have hashes of their own
            long = np.flatnonzero(size > 8)
            second = word_hashes(Words(words.data, words.start[long], words.end[long], words.first), 1)
            check = np.zeros(len(distinct), np.uint64)
            check[of[long]] = second
            if not ((size[some][of] != size).any() or (check[of[long]] != second).any()):  # no two words of one hash
                return self._join(words, h[some], check ^ size[some].astype(np.uint64), of, some)
        ids = self._ids([t or "" for t in texts.to_pylist()])
        return np.concatenate([np.zeros(0, self.kind), *ids]), np.fromiter(map(len, ids), np.int64, len(ids))

    def _join(self, words: Words, h: np.ndarray, check: np.ndarray, of: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, late = self.memo.find(h, check), self.late.find(h, check)
        known, held = at >= 0, late >= 0
        begin, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        new = np.flatnonzero(~known & ~held)
        data = words.data.tobytes()
        fresh = self._learn([data[a:b] for a, b in zip(words.start[some[new]].tolist(), words.end[some[new]].tolist())]) if len(new) else []
        flat = np.frombuffer(b"".join(fresh), self.kind)
        size[new] = np.fromiter(map(len, fresh), np.int64, len(fresh)) // flat.itemsize
        begin[new] = np.cumsum(size[new]) - size[new] + len(self.memo.flat) + len(self.late.flat)
        begin[known], size[known] = self.memo.begin[at[known]], self.memo.size[at[known]]
        begin[held], size[held] = self.late.begin[late[held]] + len(self.memo.flat), self.late.size[late[held]]
        # the words that this array has, and no more, are put side by side
        own = _gather(np.concatenate([self.memo.flat, self.late.flat, flat]), begin, size)
        begin = np.cumsum(size) - size
        n = size[of]
        out = _gather(own, begin[of], n)
        if len(new):
            self._remember(h[new], check[new], np.cumsum(size[new]) - size[new], size[new].astype(np.int32), flat)
        until = np.concatenate([[0], np.cumsum(n)])
        return out, np.diff(until[words.first])


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, width: int) -> WordEncoder:
    """One encoder a worker and file."""
    if (path, width) not in _encoders:
        _encoders[path, width] = WordEncoder(path, width)
    return _encoders[path, width]


def key_hash(key: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """64-bit hash of integer keys and occurrences."""
    return mix(mix(key.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ (occurrence.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def _slot(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + np.uint64((level + 1) * 0xA0761D6478BD642F & (2**64 - 1))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit hashes."""

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray):
        self.bits, self.rest = bits, rest
        self.ranks, at = [], 0
        for b in bits:
            self.ranks.append(at + np.cumsum(b) - 1)
            at += int(b.sum())
        self.listed = at

    @classmethod
    def of(cls, h: np.ndarray) -> PerfectHash:
        bits = []
        while len(h) and len(bits) < LEVELS:
            size = max(1, GAMMA * len(h))
            slot = _slot(h, len(bits), size)
            alone = np.bincount(slot, minlength=size) == 1
            bits.append(alone)
            h = h[~alone[slot]]
        return cls(bits, np.sort(h))

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash; of a hash that isn't there, any slot or -1."""
        out = np.full(len(h), -1, np.int64)
        todo = np.arange(len(h))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.ranks)):
            slot = _slot(h[todo], level, len(bits))
            hit = bits[slot]
            out[todo[hit]] = ranks[slot[hit]]
            todo = todo[~hit]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, h[todo]), len(self.rest) - 1)
            same = self.rest[at] == h[todo]
            out[todo[same]] = self.listed + at[same]
        return out

    def dump(self) -> dict[str, np.ndarray]:
        return {"sizes": np.array([len(b) for b in self.bits], np.int64), "bits": np.packbits(np.concatenate(self.bits)) if self.bits else np.zeros(0, np.uint8), "rest": self.rest}

    @classmethod
    def load(cls, held) -> PerfectHash:
        sizes = held["sizes"]
        return cls(np.split(np.unpackbits(held["bits"])[: sizes.sum()].astype(bool), np.cumsum(sizes)[:-1]) if len(sizes) else [], held["rest"])


def _fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)).astype(np.uint32)


_ENTRY = "key long, occurrence int, shard string, start long, n_tokens long"


def _write_shards(folder: str, tokenizer: str, width: int, end_id: int):
    def run(batches):
        encode = encoder(tokenizer, width)
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        name, out, at, last, repeats = f"{uuid.uuid4().hex}.ids", None, 0, (), 0
        for batch in batches:
            for part in pieces_of(batch, "text", PIECE_CHARS):
                ids, n = encode(part.column("text"))
                n = n + 1
                until = np.cumsum(n)
                whole = np.full(until[-1], end_id, ids.dtype)
                own = np.ones(len(whole), bool)
                own[until - 1] = False
                whole[own] = ids
                out = out or files.open_output_stream(f"{root}/{name}")
                out.write(whole.tobytes())
                occurrence = []
                for key in part.column("key").to_pylist():
                    repeats = repeats + 1 if last == (key,) else 0
                    last = (key,)
                    occurrence.append(repeats)
                columns = [part.column("key"), pa.array(occurrence, pa.int32()), pa.array([name] * len(n), pa.string()), pa.array(until - n + at), pa.array(n)]
                at += int(until[-1])
                yield pa.RecordBatch.from_arrays(columns, ["key", "occurrence", "shard", "start", "n_tokens"])
        if out:
            out.close()

    return run


def _numbered(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with the occurrences of keys that several shards share counted on, and (shard, first, n_tokens)."""
    last = F.max_by("occurrence", F.struct(F.col("key").isNotNull(), "key", "occurrence"))
    # one row a shard, as many as writing tasks; a shard's last key may go on in the next ones
    shards = entries.groupBy("shard").agg(F.min(F.struct(F.col("key").isNotNull(), "key")).alias("least"), F.max(F.struct(F.col("key").isNotNull(), "key")).alias("most"), (last + 1).alias("last"), F.sum("n_tokens").alias("n_tokens"))
    order = Window.orderBy("least", "most", "shard").rowsBetween(Window.unboundedPreceding, -1)
    of_key = Window.partitionBy("most").orderBy("least", "shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.withColumn("first", F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).withColumn("here", F.coalesce(F.sum("last").over(of_key), F.lit(0)))
    ended = shards.groupBy("most").agg(F.sum("last").alias("there")).withColumnRenamed("most", "e_most")
    shards = shards.join(ended, F.col("least") == F.col("e_most"), "left")
    before = F.when(F.col("least") == F.col("most"), F.col("here")).otherwise(F.coalesce("there", F.lit(0)))
    shards = save(shards.select("shard", "first", "n_tokens", F.col("least.key").alias("least"), before.cast("int").alias("before")))
    on = shards.where("before > 0").select(F.col("shard").alias("b_shard"), "least", "before")
    more = F.when(F.col("key").eqNullSafe(F.col("least")), F.coalesce("before", F.lit(0))).otherwise(0)
    numbered = entries.join(on, F.col("shard") == F.col("b_shard"), "left").withColumn("occurrence", (F.col("occurrence") + more).cast("int"))
    return numbered.select(*entries.columns), shards.select("shard", "first", "n_tokens")


def _flat(rows: DataFrame) -> DataFrame:
    """A null key as key 0 with a negative occurrence, so that no integer goes through pandas as a float."""
    flat = F.when(F.col("key").isNull(), -1 - F.col("occurrence")).otherwise(F.col("occurrence"))
    return rows.withColumns({"occurrence": flat.cast("int"), "key": F.coalesce("key", F.lit(0)).cast("long")})


def _unflat(rows: DataFrame) -> DataFrame:
    null = F.col("occurrence") < 0
    return rows.withColumns({"key": F.when(~null, F.col("key")), "occurrence": F.when(null, -1 - F.col("occurrence")).otherwise(F.col("occurrence"))})


def _write_part(folder: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import io

        h = key_hash(rows["key"].to_numpy(), rows["occurrence"].to_numpy())
        perfect = PerfectHash.of(h)
        slot = perfect(h)
        order = np.argsort(slot)
        names, shard = np.unique(rows["shard"].to_numpy().astype(str), return_inverse=True)
        held = {"names": names, "shard": shard[order].astype(np.uint32), "start": rows["start"].to_numpy()[order], "n": rows["n_tokens"].to_numpy()[order], "fingerprint": _fingerprint(h)[order]}
        packed = io.BytesIO()
        np.savez(packed, **held, **perfect.dump())
        write_whole(f"{folder}/part-{rows['part'].iloc[0]}.npz", [packed.getvalue()])
        return pd.DataFrame({"part": rows["part"].iloc[:1], "keys": [len(rows)]})

    return run


def write_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = 2, end_id: int = END_ID, folder: str | None = None) -> tuple[str, int, DataFrame]:
    """Write shards and index of all rows; the folder, the number of index parts, and (shard, first, n_tokens) for each shard, ``first`` being the ids in all shards before it."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    files, root = filesystem(folder)
    files.create_dir(f"{root}/index", recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    # rows of one key are dealt out by their texts
    rows = rows.withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(F.asc_nulls_first("key"), "h").sortWithinPartitions(F.asc_nulls_first("key"), "h", "text").drop("h")
    entries, shards = _numbered(save(ordered.mapInArrow(_write_shards(f"{folder}/shards", tokenizer, width, end_id), _ENTRY)))
    entries = save(entries)
    count = entries.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // PART_KEYS))
    built = _flat(entries).withColumn("part", part_of(F.col("key"), F.col("occurrence"), parts)).groupBy("part").applyInPandas(_write_part(f"{folder}/index"), "part int, keys long")
    assert (built.agg(F.sum("keys")).first()[0] or 0) == count, "the index doesn't hold every key"
    return folder, parts, shards


def part_of(key, occurrence, parts: int):
    return F.pmod(F.xxhash64(key, occurrence), F.lit(parts)).cast("int")


def _lookup(folder: str):
    def run(batches):
        held = {}
        for rows in batches:
            for part, some in rows.groupby("part", sort=True):
                if part not in held:
                    files, root = filesystem(folder)
                    with files.open_input_file(f"{root}/part-{part}.npz") as f, np.load(f) as z:
                        held = {part: (PerfectHash.load(z), {k: z[k] for k in ("names", "shard", "start", "n", "fingerprint")})}
                perfect, at = held[part]
                h = key_hash(some["key"].to_numpy(), some["occurrence"].to_numpy())
                slot = perfect(h)
                good = (slot >= 0) & (at["fingerprint"][np.maximum(slot, 0)] == _fingerprint(h)) if len(at["n"]) else np.zeros(len(h), bool)
                slot = slot[good]
                yield pd.DataFrame({"key": some["key"][good], "occurrence": some["occurrence"][good], "shard": at["names"][at["shard"][slot]], "start": at["start"][slot], "n_tokens": at["n"][slot]})

    return run


def lookup(keys: DataFrame, folder: str, parts: int) -> DataFrame:
    """Where the ids of each key (columns ``key`` and ``occurrence``) are; keys not stored are left out."""
    keyed = _flat(keys).withColumn("part", part_of(F.col("key"), F.col("occurrence"), parts))
    return _unflat(keyed.repartition("part").sortWithinPartitions("part").mapInPandas(_lookup(f"{folder}/index"), _ENTRY))


def _read_payload(folder: str, width: int):
    names = ["key", "occurrence", "shard", "start", "n_tokens"]

    def run(batches):
        files, root = filesystem(f"{folder}/shards")
        source, opened = None, None
        for batch in batches:
            starts, sizes, shards = (batch.column(c).to_pylist() for c in ("start", "n_tokens", "shard"))
            at = 0
            while at < len(shards):
                shard, lo, hi = shards[at], starts[at], starts[at] + sizes[at]
                to = at + 1
                while to < len(shards) and shards[to] == shard and (starts[to] - hi) * width <= GAP_BYTES and (starts[to] + sizes[to] - lo) * width <= READ_BYTES:
                    hi = max(hi, starts[to] + sizes[to])
                    to += 1
                if shard != opened:
                    if source is not None:
                        source.close()
                    source, opened = files.open_input_file(f"{root}/{shard}"), shard
                data = source.read_at((hi - lo) * width, lo * width)
                out = [data[(starts[i] - lo) * width : (starts[i] + sizes[i] - lo) * width] for i in range(at, to)]
                # a batch holds one read, so that long texts don't add up
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, to - at) for c in names] + [pa.array(out, pa.binary())], [*names, "payload"])
                at = to

    return run


def read_ids(found: DataFrame, folder: str, width: int = 2) -> DataFrame:
    """``found`` (rows of ``lookup``) with ``payload``, the raw ids, by sorted range reads of the shards."""
    found = save(found)
    # tasks share out spans of shards, so what they get follows the bytes to be read and not the few bytes of the rows that ask
    # for them; spans are dealt by their hash, for which nothing is sampled and no bounds go through the driver
    tasks = max(1, min(MOST_TASKS, -(-(found.agg(F.sum("n_tokens")).first()[0] or 0) * width // TASK_BYTES)))
    spans = found.withColumn("span", F.floor(F.col("start") * width / SPAN_BYTES))
    ordered = spans.repartition(tasks, "shard", "span").drop("span").sortWithinPartitions("shard", "start")
    return ordered.mapInArrow(_read_payload(folder, width), _ENTRY + ", payload binary")


@F.pandas_udf(T.LongType())
def ids_crc32(payload: pd.Series) -> pd.Series:
    """crc32 of ids, taken as 32-bit, of a column of 16-bit payloads."""
    return payload.map(lambda x: zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes())).astype("int64")


def stored(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, write, index and read back: key, occurrence, global ``start``, ``n_tokens``, ``payload``."""
    folder, parts, shards = write_ids(docs, tokenizer, id_col, text_col)
    keys = docs.select(F.col(id_col).cast("long").alias("key")).groupBy("key").count().withColumn("occurrence", F.explode(F.sequence(F.lit(0), F.col("count").cast("int") - 1))).drop("count")
    payload = read_ids(lookup(keys, folder, parts), folder)
    first = shards.select(F.col("shard").alias("of_shard"), "first")
    return payload.join(first, F.col("shard") == F.col("of_shard")).select("key", "occurrence", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "payload")
