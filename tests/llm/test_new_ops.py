"""Fill-in-middle, bit-plane clusters and the grid order join against plain Python."""

import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlark.llm import fill_in_middle as fim, grid_join, plane_clusters as planes

TEXTS = [None, "", "\n", "a", "a\nb", "a\nb\n", "\n\n\n", "é\n𝒳𝒳\nß", "one <P> two\nthree", "x<S>", "<M>", "日本\n\n" * 7, "end < P>\n<S", "𝒳" * 50, "a\n" * 3000 + "é", "same\ntext", "same\ntext"]


def by_hand(i, text, unit="line", rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    x = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(part) for part in (units[:a], units[a:b], units[b:]))
    if not text or any(t in text for t in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return i, len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return i, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit, rate, spm, seed", [("line", 100, 50, 7), ("char", 100, 50, 7), ("line", 60, 10, 8), ("char", 100, 100, 1)])
def test_fill_in_middle(spark, unit, rate, spm, seed):
    rows = [(i, t, "x", 1) for k in range(6) for i, t in enumerate(TEXTS, 20 * k)] + [(None, "null\nid", "x", 1), (3, "again\nid", "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, h1 int")
    made = fim.fill_in_middle(docs, unit=unit, rate=rate, spm=spm, seed=seed).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    assert got == sorted(((*by_hand(i, t, unit, rate, spm, seed), t or "") for i, t, *_ in rows), key=repr)
    assert fim.fill_in_middle(docs.where("false"), unit=unit).count() == 0


def test_fill_in_middle_text_ids_and_sentinels(spark):
    docs = spark.createDataFrame([("a", "one\ntwo\n"), ("b", "x")], "key string, body string")
    made = fim.fill_in_middle(docs, "key", "body", sentinels=("[p]", "[s]", "[m]"))
    assert {r.id: r.back for r in made.withColumn("back", fim.restored(F.col("output"), F.col("form"), ("[p]", "[s]", "[m]"))).collect()} == {"a": "one\ntwo\n", "b": "x"}
    with pytest.raises(ValueError):
        fim.fill_in_middle(docs, "key", "body", sentinels=("aba", "c", "d"))


def test_sparse_index_is_exact():
    text = "aé日𝒳b\nß" * 20
    data = np.frombuffer(text.encode(), np.uint8)
    index, chars = fim.Exceptions.of(data), np.arange(len(text) + 1)
    cuts = np.array([len(text[:c].encode()) for c in chars])
    assert (index.bytes(chars) == cuts).all() and (index.chars(cuts) == chars).all()
    assert len(index.byte_at) == sum(ord(c) > 127 for c in text)


def test_planes_are_exact():
    rng = np.random.default_rng(2)
    for most in (1, 300, 2**27 - 1):
        v = rng.integers(-most - 1, most, (50, 64), endpoint=True)
        p = planes.pack(v)
        assert (planes.dots(p, planes.pack(v[:1])[0]) == v @ v[0]).all()
        assert (planes.unpack_sum(p) == v.sum(axis=0)).all()
    assert (planes.dots(planes.pack(v), planes.pack(np.ones((1, 64), np.int64))[0]) == v.sum(axis=1)).all()  # planes of different numbers


def k_means(rows, k, rounds, seed):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and -(2**17) <= x < 2**17 for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        best = [near(v)[1] for _, v in kept]
        for c in set(best):
            mine = [v for (_, v), b in zip(kept, best) if b == c]
            centroids[c] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, sum(x for _, x, y in found if y == c), total, name[c]) for i, d, c in found), key=repr)


def test_clusters(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(5, 64))
    rows = [(i, [float(np.float32(x)) for x in middle[i % 5] + 0.3 * rng.normal(size=64)]) for i in range(120)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (500, [0.0] * 64), (501, [-5.5] * 63 + [90.0])]
    odd = [(200, None), (201, []), (202, [1.0] * 63), (203, [1.0] * 65), (204, [1.0] * 63 + [None]), (205, [1.0] * 63 + [float("nan")]), (206, [1.0] * 63 + [float("inf")]), (207, [1.0] * 63 + [1e30])]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(*r, 0, 0) for r in rows + odd], f"vec_id long, embedding array<{kind}>, cluster int, norm int").repartition(3)
        for k, rounds in ((8, 10), (3, 0)):
            got = sorted((tuple(r) for r in planes.clusters(df, k=k, rounds=rounds).collect()), key=repr)
            assert got == k_means(rows + odd, k, rounds, 3)
    few = df.where("vec_id IN (500, 501)")
    assert sorted((tuple(r) for r in planes.clusters(few).collect()), key=repr) == k_means(rows[-2:], 8, 10, 3)
    assert planes.clusters(df.where("vec_id = 200")).count() == 0


def linked(rows, least=0.9):
    good = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    u = [np.array(v) / max(map(abs, v)) if good(v) else None for _, v in rows]
    u = [x / np.linalg.norm(x) if x is not None else None for x in u]
    near = [[j for j in range(len(rows)) if i != j and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= least] for i in range(len(rows))]
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in near[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        first = min(ids) if ids else None
        out.append((key, len(near[i]), first, key == first))
    return sorted(out, key=repr)


def vectors_of(seed, dims=24, n=260):
    """Clusters of near vectors with chains between them, copies, scaled and opposite ones, and lone ones."""
    rng = np.random.default_rng(seed)
    rows, middle = [], rng.normal(size=(12, dims))
    for i in range(n):
        v = middle[i % 12] + (0.08, 0.3, 2.0)[i % 3] * rng.normal(size=dims) if i % 4 else rng.normal(size=dims)
        rows.append((1000 - i, [float(np.float32(x)) for x in v]))
    a, b = np.eye(dims)[0], np.eye(dims)[1]
    rows += [(2000 + k, [float(np.float32(x)) for x in math.cos(0.4 * k) * a + math.sin(0.4 * k) * b]) for k in range(6)]
    rows += [(3000, rows[5][1]), (3001, rows[5][1]), (5, [2.0 * x for x in rows[7][1]]), (3003, [-x for x in rows[7][1]]), (995, rows[20][1]), (None, rows[5][1])]
    rows += [(4000, None), (4001, []), (4002, [0.0] * dims), (4003, [1.0] * (dims - 1) + [None]), (4004, [1.0] * (dims - 1) + [float("nan")]), (4005, [float("-inf")] * dims), (4006, [1.0, 2.0]), (4007, [1.0, 2.1]), (4008, [3.0]), (4009, [5.0]), (None, [1.0, 0.5, 0.0])]
    return rows


@pytest.mark.parametrize("kind, block_rows, fan_bits", [("float", 16, 1), ("double", 64, 4), ("double", None, 4)])
def test_near_vectors(spark, kind, block_rows, fan_bits):
    rows = vectors_of(block_rows or 1)
    df = spark.createDataFrame([(*r, 1, 1, 1) for r in rows], f"vec_id long, embedding array<{kind}>, label int, n int, k1 int").repartition(3)
    got = sorted((tuple(r) for r in grid_join.near_vectors(df, block_rows=block_rows, fan_bits=fan_bits).collect()), key=repr)
    assert got == linked(rows) and sum(r[1] for r in got) > 500
    assert grid_join.near_vectors(df.where("false")).count() == 0
    assert [tuple(r) for r in grid_join.near_vectors(df.where("vec_id = 4002")).collect()] == [(4002, 0, 4002, True)]


def test_very_large_and_small_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [1e308, -1e308]), (4, [5e-324, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, grid_join.near_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_text_ids(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.1]), ("c", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "key string, v array<float>")
    assert sorted(map(tuple, grid_join.near_vectors(df, "key", "v").collect())) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True)]


def test_intervals_in_a_task_lose_nothing(monkeypatch):
    """Halved to a few vectors, with most pairs of intervals skipped, the links and counts are those of all pairs."""
    monkeypatch.setattr(grid_join, "LEAF", 4)
    rng = np.random.default_rng(4)
    v = np.sort(rng.uniform(0, 2 * np.pi, 300))
    u = np.column_stack([np.cos(v), np.sin(v), 0.01 * rng.normal(size=300)])
    row = lambda a, b: {"places": np.arange(a, b).tobytes(), "copies": np.full(b - a, 2).tobytes(), "data": u[a:b].tobytes()}
    x, y = (grid_join.Sequence(row(*s), np.float64, None, 2) for s in ((0, 170), (170, 300)))
    w = grid_join.unit(u)
    near = w @ w.T >= 0.9
    np.fill_diagonal(near, False)
    for one, two, part in ((x, x, near[:170, :170]), (x, y, near[:170, 170:])):
        links, degree, other = grid_join.block_links(one, two, 0.9)
        assert (degree == 2 * part.sum(axis=1)).all() and (other is None or (other == 2 * part.sum(axis=0)).all())
        assert all(part[i, j] for i, j in links)
    met = sum((b - a) * (d - c) for a, b, c, d in grid_join.near_intervals(x, y, 0.2))
    assert met < 170 * 130 / 2
