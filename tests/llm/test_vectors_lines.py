"""Line dedup, vector codes and centroid clustering against brute force; and awkward tables."""

import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexarc.llm import op11_codes, op12_lines, op13_elkan
from lexarc.llm.common import Scratch, join_spread

BLANKS = " \t\n\x0b\f\r"


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_dedup(rows, min_chars=10, min_docs=2):
    """[(id, n_lines, n_dropped, text)], a line at a time."""
    where = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = fold(line.strip(BLANKS))
            if i is not None and len(key) >= min_chars:
                where.setdefault(key, set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [i is not None and len(w := where.get(fold(x.strip(BLANKS)), ())) >= min_docs and i != min(w) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone, strict=True) if not g)))
    return out


def same(got, want):
    return sorted(got, key=repr) == sorted(want, key=repr)


def dedup(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [tuple(r) for r in op12_lines.dedup_lines(df, Scratch(spark, "t"), **more).collect()]


def test_lines(spark):
    rows = [(3, "A common line here\nown words of three\n"), (1, "  a COMMON line here\t\nown words of one\na common line here"), (2, "a common line here"),
            (4, None), (5, ""), (6, "\n\n"), (None, "a common line here\nx"), (7, "short one\nshort one"), (8, "short one"),
            (9, "ÄRGER ÄRGER ÄRGER"), (10, "ärger ärger ärger"), (11, "ÄRGER äRGER ÄRGER"), (12, " a common line here"),
            (13, "ten chars!"), (14, "TEN CHARS!\r"), (15, "nine char"), (16, "nine char"), (17, "\U0001f600" * 9), (18, "\U0001f600" * 9), (19, "\U0001f600" * 10), (20, "\U0001f600" * 10)]
    got = dedup(spark, rows)
    assert same(got, plain_dedup(rows))
    by = {r[0]: r for r in got if r[0] is not None}
    assert by[1][2] == 0 and by[2][1:] == (1, 1, "") and by[3][2] == 1 and by[14][2] == 1 and by[16][2] == 0 and by[18][2] == 0 and by[20][2] == 1


def test_lines_of_one_id_twice(spark):
    rows = [(5, "a line of many words\nsecond line of many"), (5, "a line of many words\nthird line of many"), (5, "a line of many words\nthird line of many"), (2, "third line of many\nno other line has this"), (7, "a line of many words")]
    assert same(dedup(spark, rows), plain_dedup(rows))


@pytest.mark.parametrize("least", [2, 3, 5])
def test_lines_by_chance(spark, least):
    rnd = random.Random(least)
    pool = [f"{'the line number'} {i}" + " " * rnd.randrange(3) for i in range(40)] + ["", "x", "Licensed to all who read this", "LICENSED to all who read this "]
    rows = [(rnd.choice([None, *range(60)]), "\n".join(rnd.choice(pool) for _ in range(rnd.randrange(8)))) for _ in range(200)]
    assert same(dedup(spark, rows, min_docs=least), plain_dedup(rows, min_docs=least))


def test_hot_and_very_long_lines(spark, monkeypatch):
    monkeypatch.setattr("lexarc.llm.common.SLICES", 10)
    long = "\n".join(f"line {i} of a very long text" for i in range(60_000))
    rows = [(i, f"the one line that all documents hold\nonly in document number {i}") for i in range(300)] + [(1000, long), (1001, long + "\n" + "y" * 3_000_000)]
    assert same(dedup(spark, rows), plain_dedup(rows))


def test_lines_clashing_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "the same line twice", 9, 9, 9), (2, "the same line twice", 8, 8, 8)], "doc_id int, text string, id int, h1 int, gone int")
    assert [tuple(r) for r in op12_lines.dedup_lines(df, Scratch(spark, "t")).orderBy("id").collect()] == [(1, 1, 0, "the same line twice"), (2, 1, 1, "")]
    assert op12_lines.dedup_lines(df.limit(0), Scratch(spark, "t")).collect() == []


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr("lexarc.llm.common.SLICES", 4)
    rows = spark.range(1000).select(F.struct(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("x")).alias("k"), "id")
    facts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = join_spread(rows, facts, ["k"], "n").collect()
    want = {}
    for i in range(1000):
        want[i % 7 if i % 3 else None] = i
    assert sorted((r.id, r.top) for r in got) == [(i, want[i % 7 if i % 3 else None]) for i in range(1000)]


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def update(entries, members):
    return [tuple(sum(c) // len(m) for c in zip(*m, strict=True)) if m else e for e, m in zip(entries, members, strict=True)]


def nearest(x, entries):
    return min(range(len(entries)), key=lambda k: (sum((a - b) ** 2 for a, b in zip(x, entries[k], strict=True)), k))


def gap(x, y):
    return sum((a - b) ** 2 for a, b in zip(x, y, strict=True))


def plain_codes(rows, parts, entries, rounds, scale):
    rows = sorted(((i, [math.floor(scale * x) for x in v], w) for i, v, w in rows if usable(v) and v), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(rows[0][1]) // parts
    cut = lambda v, p: tuple(v[p * width:(p + 1) * width])
    books = [[cut(v, p) for _, v, _ in rows[:entries]] for p in range(parts)]
    for t in range(rounds + 1):
        at = [[nearest(cut(v, p), books[p]) for p in range(parts)] for _, v, _ in rows]
        if t < rounds:
            books = [update(books[p], [[cut(v, p) for (_, v, _), a in zip(rows, at, strict=True) if a[p] == k] for k in range(len(books[p]))]) for p in range(parts)]
    out = [(i, "".join(f"{k:02x}" for k in a), sum(gap(cut(v, p), books[p][a[p]]) for p in range(parts)), w) for (i, v, w), a in zip(rows, at, strict=True)]
    return out, books


def codes(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, books = op11_codes.compress(df, Scratch(spark, "t"), **more)
    return [(r.id, r.code, r.error, r.label.label) for r in got.collect()], books


def random_vectors(seed, n, width, kinds=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, width))
    return [(i, [float(x) for x in centres[rng.integers(kinds)] + rng.choice([0.0, 0.05, 1.0]) * rng.normal(size=width)], int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize(("width", "parts", "scale"), [(64, 16, 256), (64, 4, 256), (21, 3, 8), (8, 8, 4), (32, 2, 3)])
def test_codes(spark, width, parts, scale):
    rows = random_vectors(width, 150, width) + [(900, None, 1), (901, [None] * width, 1), (902, [math.nan] * width, 1), (903, [math.inf] * width, 1), (7, [0.5] * width, None), (7, [0.5] * width, None), (None, [0.25] * width, 2)]
    got, books = codes(spark, rows, parts=parts, entries=20, scale=scale)
    want, wanted = plain_codes(rows, parts, 20, 2, scale)
    assert same(got, want)
    assert books.tolist() == [[list(e) for e in b] for b in wanted]


def test_codes_skip_most_entries_but_no_tie():
    rng = np.random.default_rng(4)
    entries = rng.integers(-200, 200, size=(64, 4))
    entries[9], entries[40] = entries[3], entries[3]
    near = entries[rng.integers(64, size=500)] + rng.integers(-9, 9, size=(500, 4))
    x = np.concatenate([rng.integers(-200, 200, size=(500, 4)), entries])
    at, d, _ = op11_codes.nearest(x, entries, op11_codes.Shapes(entries))
    assert at.tolist() == [nearest(v, entries.tolist()) for v in x.tolist()] and d.tolist() == [gap(v, entries[a].tolist()) for v, a in zip(x.tolist(), at, strict=True)]
    at, _, measured = op11_codes.nearest(near, entries, op11_codes.Shapes(entries))
    assert at.tolist() == [nearest(v, entries.tolist()) for v in near.tolist()]
    assert measured < 0.1 * len(near) * len(entries)


def test_codes_bounds_stay_below_at_large_values():
    rng = np.random.default_rng(6)
    for size in (1, 1000, 1 << 24):
        x, e = rng.integers(-size, size + 1, size=(300, 16)), rng.integers(-size, size + 1, size=(64, 16))
        e[:32] = x[:32] + rng.integers(-1, 2, size=(32, 16))
        sx, se = op11_codes.Shapes(x), op11_codes.Shapes(e)
        exact = ((x[:, None] - e[None]) ** 2).sum(axis=2)
        for level in range(len(sx.means)):
            assert (op11_codes.below(sx, se, level, np.arange(300)[:, None], np.arange(64)[None]) <= exact).all()


def test_codes_few_empty_and_odd(spark):
    assert codes(spark, [])[0] == []
    assert codes(spark, [(1, None, 1), (2, [], 1)])[0] == []
    got, books = codes(spark, [(1, [1.0] * 16, None), (2, [2.0] * 16, 1), (3, [1.0] * 32, 1), (4, [1.0] * 15, 1)])
    assert sorted(got) == [(1, "00" * 16, 0, None), (2, "01" * 16, 0, 1)] and books.shape == (16, 2, 1)
    with pytest.raises(Exception, match="beyond"):
        codes(spark, [(1, [1e30] * 16, 1)])
    df = spark.createDataFrame([(1, [1.0] * 16, "x", 0, 0)], "vec_id int, embedding array<float>, label string, id int, v int")
    assert op11_codes.compress(df, Scratch(spark, "t"))[0].count() == 1


def plain_clusters(rows, k, rounds, width, scale):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v, _ in rows if usable(v) and len(v) == width]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in seeds[:k]]
    for t in range(rounds + 1):
        at = [nearest(v, c) for _, v in kept]
        if t < rounds:
            c = update(c, [[v for (_, v), a in zip(kept, at, strict=True) if a == j] for j in range(len(c))])
    return [(i, a, gap(v, c[a])) for (i, v), a in zip(kept, at, strict=True)], c


def clusters(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, c = op13_elkan.cluster(df, Scratch(spark, "t"), **more)
    got = got.collect()
    return [(r.id, r.cluster, r.distance) for r in got], [tuple(x) for x in c], sum(r.measured for r in got)


@pytest.mark.parametrize(("n", "scale", "rounds"), [(200, 1024, 10), (300, 2, 6), (5, 1024, 3), (60, 1, 0)])
def test_clusters(spark, n, scale, rounds):
    rows = random_vectors(n, n, 64, kinds=8) + [(900, None, 1), (901, [None] * 64, 1), (902, [math.nan] * 64, 1), (903, [1.0] * 63, 1), (3, [0.5] * 64, 1), (3, [0.5] * 64, 1), (None, [0.25] * 64, 2)]
    got, c, measured = clusters(spark, rows, rounds=rounds, scale=scale)
    want, wanted = plain_clusters(rows, 8, rounds, 64, scale)
    assert same(got, want) and c == wanted
    if n == 200:
        assert measured < 0.5 * len(got) * 8 * (rounds + 1)


def test_clusters_ties_and_empty_centroids(spark):
    rows = [(i, [float(i % 2)] * 64, 0) for i in range(40)]  # two points only: centroids coincide and stay empty
    got, c, _ = clusters(spark, rows)
    want, wanted = plain_clusters(rows, 8, 10, 64, 1024)
    assert same(got, want) and c == wanted
    line = [(i, [float(i)] + [0.0] * 63, 0) for i in range(64)]  # many vectors halfway between centroids
    got, c, _ = clusters(spark, line, scale=1)
    want, wanted = plain_clusters(line, 8, 10, 64, 1)
    assert same(got, want) and c == wanted


def test_bounds_skip_exactly():
    rng = np.random.default_rng(8)
    v = rng.integers(-3, 4, size=(400, 6))
    c = v[:8].copy()
    own, upper, lower, _, _ = op13_elkan.first_pass(v, c)
    for _ in range(12):
        step = rng.integers(-1, 2, size=c.shape) * (rng.random(8) < 0.6)[:, None]
        moved = np.sqrt(op13_elkan.apart(c + step, c).astype(float)) * (1 + op13_elkan.SLACK)
        c = c + step
        own, upper, lower, measured, _ = op13_elkan.next_pass(v, c, moved, own, upper, lower)
        exact = ((v[:, None] - c[None]) ** 2).sum(axis=2)
        assert own.tolist() == exact.argmin(axis=1).tolist()
        assert (lower <= np.sqrt(exact)).all() and (upper >= np.sqrt(exact.min(axis=1))).all()


def test_clusters_awkward_tables(spark):
    assert clusters(spark, [])[0] == [] and clusters(spark, [(1, None, 1)])[0] == []
    df = spark.createDataFrame([(1, [1.0] * 64, 5, 6)], "vec_id int, embedding array<float>, cluster int, id int")
    assert op13_elkan.cluster(df, Scratch(spark, "t"))[0].collect()[0].distance == 0


@pytest.mark.parametrize("module", [op11_codes, op12_lines, op13_elkan])
def test_queries_equal_sql(spark, sf, module):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    (name, f), = module.QUERIES.items()
    df = f(spark, sf)
    r = con.execute(module.SQL[name])
    names = [x[0] for x in r.description]
    assert names == df.columns
    assert same([tuple(x) for x in df.collect()], r.fetchall())
