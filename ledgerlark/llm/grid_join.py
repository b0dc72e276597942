"""Near-duplicate vectors by an epsilon grid order join.

For unit vectors a cosine of ``c`` or more is a distance of ``sqrt(2 - 2c)`` or less, and a
projection on orthonormal axes never lengthens a distance.  So vectors are sorted by the cells
of a grid on their leading principal axes, the cells as wide as that distance, and numbered.
The sequence is cut into blocks with bounding boxes; intervals of blocks, from the whole
sequence down, are joined with each other as long as their boxes are near enough, level by
level as Spark joins; pairs of blocks that are left go on in a task, which halves them in the
same way and multiplies what is left.  Products in single precision find candidates, double
precision decides.  Nothing is left out: a pair is skipped only where its boxes prove it distant.

What is skipped hangs on the data.  Vectors in clusters lose most of their pairs; vectors
spread evenly over many dimensions lose few, and the work then grows with their square.

Equal vectors are one class from the start, so copies are never compared.  A task returns the
links that join components and each vector's number of links, not all links, so a group of n
near copies costs n rows.  The axes are fitted on about ``AXES_ROWS`` vectors chosen by their
hash (fewer of wide ones, ``AXES_BYTES`` in all); they decide what can be skipped, never what
is linked.

Vectors that are null, empty, zero or hold a null or non-finite component link with nothing:
they return with no links, as their own component, kept.  Vectors of different lengths don't
link.  Rows of one id are rows of their own; a null id is never the least of a component unless
it has no other, then ``component_id`` is null and its rows are kept.  An empty table gives no
rows.  Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .near_dedup import components
from .storage import save

LEAST = 0.9
#: Bytes of a block's vectors, leading axes, and bits by which a level's intervals are numbered.
BLOCK_BYTES, AXES, FAN_BITS = 2 << 20, 16, 4
#: Vectors that the axes are fitted on, and their bytes at most.
AXES_ROWS, AXES_BYTES = 20_000, 32 << 20
#: Vectors of an interval that is multiplied without being halved.
LEAF = 1024
#: Room for rounding in single-precision products and in boxes.
ROOM = 1e-4


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares neither overflow nor vanish."""
    v = values.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True, initial=0)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def principal_axes(sample: np.ndarray, count: int) -> np.ndarray:
    """The leading ``count`` principal axes of unit vectors, as columns."""
    centred = sample - sample.mean(axis=0)
    return np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :count]


def projected(u: np.ndarray, axes: np.ndarray | None, count: int) -> np.ndarray:
    """Coordinates on the axes, and the length of the rest: distances between such rows are no longer than between the vectors."""
    p = u[:, :count] if axes is None or len(axes) != u.shape[1] else u @ axes
    p = np.pad(p, ((0, 0), (0, count - p.shape[1])))
    return np.column_stack([p, np.sqrt(np.maximum(0.0, 1.0 - (p * p).sum(axis=1)))])


def _matrix(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, values) of a list array, for each length."""
    first = lists.offsets.to_numpy()
    size, flat = np.diff(first), lists.values.to_numpy(zero_copy_only=False)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield rows, flat[first[rows][:, None] + np.arange(d)]


def _grid(axes: np.ndarray | None, count: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            keys: list[bytes] = [b""] * len(batch)
            tie = batch.column("k1").to_numpy().view(np.uint64)
            for rows, values in _matrix(batch.column("vec")):
                cells = np.clip(np.floor(projected(unit(values), axes, count)[:, :count] / width) + 128, 0, 255).astype(np.uint8)
                for i, c in zip(rows.tolist(), cells):
                    keys[i] = values.shape[1].to_bytes(4, "big") + c.tobytes() + int(tie[i]).to_bytes(8, "big")
            columns = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.binary())], [*batch.schema.names, "cell"])

    return run


def _pack(axes: np.ndarray | None, count: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        (_, values), = _matrix(table["vec"].chunk(0))
        box = projected(unit(values), axes, count)
        row = {
            "block": [table["block"][0].as_py()], "dim": [values.shape[1]], "lo": [box.min(axis=0).tolist()], "hi": [box.max(axis=0).tolist()],
            "places": [table["pos"].to_numpy().tobytes()], "copies": [table["n"].to_numpy().tobytes()], "data": [values.tobytes()],
        }
        return pa.table(row, schema=pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("places", pa.binary()), ("copies", pa.binary()), ("data", pa.binary())]))

    return run


class Sequence:
    """A block in a task: its unit vectors and the boxes of its intervals."""

    def __init__(self, row: dict, dtype, axes: np.ndarray | None, count: int):
        self.place, self.copies = np.frombuffer(row["places"], np.int64), np.frombuffer(row["copies"], np.int64)
        self.u = unit(np.frombuffer(row["data"], dtype).reshape(len(self.place), -1))
        self.single, self.p, self.boxes = self.u.astype(np.float32), projected(self.u, axes, count), {}

    def box(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        if (a, b) not in self.boxes:
            self.boxes[a, b] = self.p[a:b].min(axis=0), self.p[a:b].max(axis=0)
        return self.boxes[a, b]


def near_intervals(x: Sequence, y: Sequence, reach: float) -> Iterator[tuple[int, int, int, int]]:
    """Pairs of short intervals that may hold near vectors; of a block with itself, each pair once."""
    todo = [(0, len(x.place), 0, len(y.place))]
    while todo:
        a, b, c, d = todo.pop()
        if x is y and c < a:
            continue
        (lo, hi), (low, high) = x.box(a, b), y.box(c, d)
        gap = np.maximum(0.0, np.maximum(lo - high, low - hi))
        if (gap * gap).sum() > reach + ROOM:
            continue
        if b - a <= LEAF and d - c <= LEAF:
            yield a, b, c, d
            continue
        # the two sides of a block's pair with itself are halved alike, so that they meet in equal intervals
        left = [(a, b)] if b - a <= LEAF else [(a, (a + b) // 2), ((a + b) // 2, b)]
        right = [(c, d)] if d - c <= LEAF else [(c, (c + d) // 2), ((c + d) // 2, d)]
        todo += [(*i, *j) for i in left for j in right]


def block_links(x: Sequence, y: Sequence, least: float) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Links (row of x, row of y) that join the components of two blocks, and for each row how many rows of the table it is linked with."""
    same = x is y
    degree_x, degree_y = np.zeros(len(x.place), np.int64), np.zeros(len(y.place), np.int64)
    label = np.arange(len(x.place) + (0 if same else len(y.place)))
    shift, links = 0 if same else len(x.place), []
    for a, b, c, d in near_intervals(x, y, 2 - 2 * least):
        rough = x.single[a:b] @ y.single[c:d].T >= least - ROOM
        if same and a == c:
            rough = np.triu(rough, 1)
        i, j = np.flatnonzero(rough.any(axis=1)), np.flatnonzero(rough.any(axis=0))
        if not len(i):
            continue
        near = rough[np.ix_(i, j)] & (x.u[a + i] @ y.u[c + j].T >= least)
        i, j = a + i, c + j
        degree_x[i] += near @ y.copies[j]
        degree_y[j] += near.T @ x.copies[i]
        for row, mine in zip(i.tolist(), near):
            at = j[mine]
            for other, k in zip(*np.unique(label[at + shift], return_index=True)):
                if other != label[row]:
                    links.append((row, int(at[k])))
                    label[label == other] = label[row]
    return links, (degree_x + degree_y if same else degree_x), (None if same else degree_y)


def _compare(dtype, axes: np.ndarray | None, count: int, least: float):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["block", "places", "copies", "data"]).to_pylist(), key=lambda r: r["block"])
        x, y = (Sequence(r, dtype, axes, count) for r in (rows[0], rows[-1])) if len(rows) > 1 else [Sequence(rows[0], dtype, axes, count)] * 2
        links, of_x, of_y = block_links(x, y, least)
        a, b, n = [x.place[i] for i, _ in links], [y.place[j] for _, j in links], [None] * len(links)
        for side, degree in ((x, of_x), (y, of_y)):
            if degree is not None:
                some = np.flatnonzero(degree)
                a, b, n = a + side.place[some].tolist(), b + [None] * len(some), n + degree[some].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    return run


def _gap(count: int):
    """Squared distance of the boxes (lo, hi) and (lo2, hi2)."""
    one = lambda i: F.greatest(F.lit(0.0), F.col("lo")[i] - F.col("hi2")[i], F.col("lo2")[i] - F.col("hi")[i])
    out = one(0) * one(0)
    for i in range(1, count + 1):
        out = out + one(i) * one(i)
    return out


def near_blocks(boxes: DataFrame, least: float, count: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """Pairs (dim, a, b), a <= b, of blocks whose boxes may hold near vectors, found from the whole sequence down.

    A level's intervals hold ``2 ** fan_bits`` of the level below; a pair of them is opened only
    if its boxes are near, so each level is an equi-join on the pair's intervals."""
    levels = [boxes.select("dim", "block", "lo", "hi")]
    top = boxes.agg(F.max("block")).first()[0] or 0
    while top:
        top >>= fan_bits
        fold = [F.array(*[f(F.col(c)[i]) for i in range(count + 1)]).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"))]
        levels.append(save(levels[-1].groupBy("dim", F.shiftright("block", fan_bits).alias("block")).agg(*fold)))
    pairs = levels[-1].select("dim", F.col("block").alias("a"), F.col("block").alias("b"))
    for level in levels[-2::-1]:
        under = level.withColumn("above", F.shiftright("block", fan_bits))
        x = under.select(F.col("dim").alias("x_dim"), F.col("above").alias("x_above"), F.col("block").alias("x"), "lo", "hi")
        y = under.select(F.col("dim").alias("y_dim"), F.col("above").alias("y_above"), F.col("block").alias("y"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        rows = pairs.join(x, (F.col("dim") == F.col("x_dim")) & (F.col("a") == F.col("x_above"))).join(y, (F.col("dim") == F.col("y_dim")) & (F.col("b") == F.col("y_above")))
        pairs = save(rows.where((F.col("x") <= F.col("y")) & (_gap(count) <= 2 - 2 * least + ROOM)).select("dim", F.col("x").alias("a"), F.col("y").alias("b")))
    return pairs


def _numbered(classes: DataFrame, axes: np.ndarray | None, count: int, width: float) -> DataFrame:
    """``classes`` with ``pos``, their place in grid order from 0."""
    kind = dict(classes.dtypes)
    schema = ", ".join(f"{c} {kind[c]}" for c in classes.columns) + ", cell binary"
    ordered = classes.mapInArrow(_grid(axes, count, width), schema).repartitionByRange("cell").sortWithinPartitions("cell")
    # a row's number holds its task's in the high bits; counts of tasks, one row each, turn it into a place
    ordered = save(ordered.drop("cell").withColumn("seq", F.monotonically_increasing_id()))
    sizes = sorted((r.task, r.n) for r in ordered.groupBy(F.shiftright("seq", 33).alias("task")).agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for task, n in sizes:
        starts.append((task, before))
        before += n
    first = classes.sparkSession.createDataFrame(starts, "task long, before long")
    rows = ordered.withColumn("task", F.shiftright("seq", 33)).join(F.broadcast(first), "task")
    return rows.select(*classes.columns, (F.col("before") + F.col("seq").bitwiseAND((1 << 33) - 1)).alias("pos"))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, block_rows: int | None = None, fan_bits: int = FAN_BITS) -> DataFrame:
    """(id, n_links, component_id, kept): for each row how many others are as near as ``least``, and the least id that links reach."""
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    element, dtype = ("float", np.float32) if single else ("double", np.float64)
    v = F.col(vector_col).cast(f"array<{element}>")
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    good = F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    keys = [F.when(good, F.xxhash64(F.lit(s), v)).alias(f"k{s}") for s in (1, 2)]
    rows = vectors.select(F.col(id_col).alias("id"), F.when(good, v).alias("vec"), *keys)
    classes = save(rows.where("vec IS NOT NULL").groupBy("k1", "k2").agg(F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("id").alias("least")))
    usual = classes.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "dim").first()
    if usual is None:
        return rows.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    count = min(AXES, usual.dim)
    share = max(1, -(-usual.c // min(AXES_ROWS, max(2, AXES_BYTES // (8 * usual.dim)))))
    sample = classes.where((F.size("vec") == usual.dim) & (F.pmod("k2", F.lit(share)) == 0)).select("vec").toPandas()
    axes = principal_axes(unit(np.stack(sample["vec"].to_numpy())), count) if len(sample) > 1 else None
    size = block_rows or min(8192, max(64, BLOCK_BYTES // (np.dtype(dtype).itemsize * usual.dim)))
    numbered = _numbered(classes, axes, count, float(np.sqrt(2 - 2 * least)) or 1.0)
    blocks = numbered.select(F.expr(f"pos div {size}").alias("block"), F.size("vec").alias("dim"), "pos", "n", "vec").groupBy("block", "dim").applyInArrow(
        _pack(axes, count), "block long, dim int, lo array<double>, hi array<double>, places binary, copies binary, data binary"
    )
    blocks = save(blocks)
    pairs = near_blocks(blocks, least, count, fan_bits)
    sides = pairs.select("dim", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("side"))
    held = blocks.select(F.col("dim").alias("d"), "block", "places", "copies", "data")
    tiles = sides.join(held, (F.col("side") == F.col("block")) & (F.col("dim") == F.col("d"))).select("dim", "a", "b", "block", "places", "copies", "data")
    found = save(tiles.groupBy("dim", "a", "b").applyInArrow(_compare(dtype, axes, count, least), "a long, b long, n long"))
    labels = components(found.where("b IS NOT NULL").select("a", "b")).select(F.col("node").alias("l_pos"), "label")
    degree = found.where("b IS NULL").groupBy(F.col("a").alias("d_pos")).agg(F.sum("n").alias("linked"))
    known = numbered.select("k1", "k2", "n", "least", "pos").join(labels, F.col("pos") == F.col("l_pos"), "left").join(degree, F.col("pos") == F.col("d_pos"), "left")
    known = known.where("n > 1 OR linked IS NOT NULL").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "least", F.coalesce("label", "pos").alias("label"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("links"))
    known = save(known)
    first = known.groupBy(F.col("label").alias("f_label")).agg(F.min("least").alias("first"))
    known = known.join(first, F.col("label") == F.col("f_label")).select("c1", "c2", "links", "first")
    found = rows.select("id", "k1", "k2").join(known, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.when(F.col("c1").isNull(), F.col("id")).otherwise(F.col("first"))
    return found.select("id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
