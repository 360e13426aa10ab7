"""Packing, walking and merging along sequences of many blocks, and thresholded cosines, against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexarc.config import EngineConfig
from lexarc.operators import chains, segment, text, turns


@pytest.mark.parametrize("block", [1, 3, 16])
def test_running(spark, block):
    rnd = random.Random(block)
    rows = [(t, i + 1, rnd.choice([None, rnd.randrange(-9, 9)])) for t, n in ((1, 40), (2, 1), (3, 17)) for i in range(n)]
    df = spark.createDataFrame(rows, "t long, n int, v int")
    for how, f in (("sum", sum), ("min", min), ("max", max)):
        for backwards in (False, True):
            for strict in (False, True):
                got = {(r.t, r.n): r.x for r in chains.running(df, ["t"], "n", F.col("v"), "x", how, backwards, strict, block).collect()}
                for t, n, _ in rows:
                    there = [v for u, m, v in rows if u == t and v is not None and ((m >= n) if backwards else (m <= n)) and not (strict and m == n)]
                    assert got[t, n] == (f(there) if there else None)


@pytest.mark.parametrize("limit", [1, 7, 50, 10_000])
def test_first_reach(spark, limit):
    rnd = random.Random(limit)
    rows = [(t, i + 1, rnd.choice([1, 2, 30, rnd.randrange(1, 200)])) for t, n in ((1, 60), (2, 1), (3, 23)) for i in range(n)]
    got = {(r.t, r.n): r.x for r in chains.first_reach(spark.createDataFrame(rows, "t long, n int, v int"), ["t"], "n", "v", limit, "x").collect()}
    for t, n, _ in rows:
        want, total = None, 0
        for m, v in ((m, v) for u, m, v in rows if u == t and m >= n):
            total += v
            if total >= limit:
                want = m
                break
        assert got[t, n] == want


@pytest.mark.parametrize(("block", "far"), [(2, 3), (4, 3), (4, 40), (64, 5)])
def test_runs(spark, block, far):
    rnd = random.Random(block * far)
    rows = [(t, i + 1, i + 1 + rnd.randrange(1, far + 1)) for t, n in ((1, 300), (2, 1), (3, 65)) for i in range(n)]
    got = {(r.t, r.pos): r.run_no for r in chains.runs(spark.createDataFrame(rows, "t long, n int, s int"), ["t"], "n", "s", block=block).collect()}
    succ = {(t, n): s for t, n, s in rows}
    for t, n in ((1, 300), (2, 1), (3, 65)):
        at, run = 1, 0
        while at <= n:
            run += 1
            for m in range(at, min(succ[t, at], n + 1)):
                assert got[t, m] == run
            at = succ[t, at]


def plain_packing(lengths, config):
    out, chars, units = [], 0, 0
    for n in lengths:
        if not out or chars >= config.chunk_chars or units >= config.chunk_max_units:
            out.append(out[-1] + 1 if out else 1)
            chars, units = n, 1
        else:
            out.append(out[-1])
            chars, units = chars + n, units + 1
    return out


@pytest.mark.parametrize("most", [1, 6, 300])
def test_packing_of_long_transcripts(spark, most):
    rnd = random.Random(most)
    config = EngineConfig(chunk_max_units=most, chunk_chars=1800 if most < 300 else 30)
    lengths = {1: [rnd.choice([0, 3, 90, 700, 2000]) for _ in range(900)], 2: [5], 3: [0] * 257} if most < 300 else {1: [rnd.choice([0, 0, 1]) for _ in range(600)]}
    if most == 300:
        config = EngineConfig(chunk_max_units=40, chunk_chars=30)
    u = spark.createDataFrame([(t, i + 1, "x" * n) for t, ns in lengths.items() for i, n in enumerate(ns)], "transcript_id long, unit_no int, text string")
    got = {(r.transcript_id, r.unit_no): r.chunk_no for r in turns.number_chunks(u, config).collect()}
    assert got == {(t, i + 1): c for t, ns in lengths.items() for i, c in enumerate(plain_packing(ns, config))}


def test_packing_holds_no_transcript_in_a_row(spark):
    """Blocks of one long transcript are rows of their own, so that no row and no task has all of it."""
    kept = []

    def keep(df):
        kept.append(chains.keep_table(df))
        return kept[-1]

    n = 40_000
    u = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("transcript_id"), F.col("id").cast("int").alias("unit_no"), F.expr("repeat('x', cast(pmod(id * 37, 900) as int))").alias("text"))
    got = [r.chunk_no for r in turns.number_chunks(u, keep=keep).orderBy("unit_no").select("chunk_no").collect()]
    assert got == plain_packing([i * 37 % 900 for i in range(1, n + 1)], EngineConfig())
    assert max(r.n for r in kept[0].select(F.size("x0").alias("n")).collect()) == chains.BLOCK


def plain_walk(chunks, g, config):
    """chunks: (chunk_no, only, page, action); one fold over all of them."""
    out, s, p, q, t = {}, 0, 0, 0.0, 0
    for i, only, page, action in chunks:
        own = g.get((i, i), 0.0)
        num = sum(g.get((i, j), 0.0) for j in range(s, i))
        hold = num / math.sqrt(q * own) if q * own > 0 else 0.0
        joins = t > 0 and (action in ("continue", "brief_digression") if action is not None else only or (round(hold, 9) >= config.continue_similarity and page - p <= config.max_pages_continue))
        if joins:
            q += 2 * num + own
        else:
            s, p, q, t = i, page, own, t + 1
        out[i] = t
    return out


@pytest.mark.parametrize("seed", range(4))
def test_walk_over_a_band(spark, seed):
    rnd = random.Random(seed)
    config = EngineConfig(max_pages_continue=seed + 1)
    words = [f"word{i}" for i in range(12)]
    rows, decisions = [], []
    for t, n in ((1, 90), (2, 1), (3, 30)):
        page = 1
        for i in range(1, n + 1):
            page += rnd.choice([0, 0, 0, 1, 1, 4]) if seed != 3 else rnd.choice([0, 1, 2, -3])
            rows.append((t, i, f"C{i:03d}", rnd.random() < 0.15, max(0, page), " ".join(rnd.choice(words[:4] if rnd.random() < 0.6 else words) for _ in range(rnd.choice([0, 6, 10])))))
            if seed in (1, 3) and t == 1 and rnd.random() < 0.7:
                decisions.append((t, f"C{i:03d}", rnd.choice(["continue", "brief_digression", "new_topic", None])))
    c = spark.createDataFrame(rows, "transcript_id long, chunk_no int, chunk_id string, only_procedure boolean, start_page int, corpus string")
    d = spark.createDataFrame(decisions, "transcript_id long, chunk_id string, action string") if decisions else None
    weights = segment.chunk_weights(c, config)
    full = {(r.transcript_id, r.i, r.j): r.g for r in text.gram(weights, ["transcript_id"], "chunk_no").collect()}
    band = segment.band_gram(c, weights, config)
    found = {(r.transcript_id, r.i, r.j): r.g for r in band.collect()}
    assert all(full[k] == pytest.approx(v) for k, v in found.items()) and len(found) < len(full)
    assert {k for k in full if k[1] == k[2] + 1} <= set(found)
    got = {(r.transcript_id, r.chunk_no): r.group_no for r in segment.walk(c, band, config, d).collect()}
    acts = {(t, k): a or "new_topic" for t, k, a in decisions}
    for t in (1, 2, 3):
        want = plain_walk([(i, only, page, acts.get((t, k))) for u, i, k, only, page, _ in rows if u == t], {(i, j): v for (u, i, j), v in full.items() if u == t}, config)
        assert {i: got[t, i] for i in want} == want


def plain_merge(lengths, config):
    out, total = [], 0
    for n in lengths:
        if out and n < config.min_topic_chars and total < config.merge_below_chars:
            out.append(out[-1])
            total += n
        else:
            out.append(out[-1] + 1 if out else 1)
            total = n
    return out


def test_merging_long_runs(spark):
    rnd = random.Random(5)
    lengths = {1: [rnd.choice([14, 60, 349, 350, 7000]) for _ in range(700)], 2: [20] * 900, 3: [400]}
    c = spark.createDataFrame([(t, i + 1, "x" * n) for t, ns in lengths.items() for i, n in enumerate(ns)], "transcript_id long, chunk_no int, text string")
    groups = c.select("transcript_id", "chunk_no", F.col("chunk_no").alias("group_no"))
    got = {(r.transcript_id, r.group_no): r.merged_no for r in segment.merge_small(c, groups).collect()}
    assert got == {(t, i + 1): m for t, ns in lengths.items() for i, m in enumerate(plain_merge(ns, EngineConfig()))}


@pytest.mark.parametrize("threshold", [0.1, 0.32, 0.8])
def test_thresholded_cosines(spark, threshold):
    rnd = random.Random(3)

    def unit(name, n):
        rows = []
        for t in (1, 2):
            for i in range(n):
                v = {f"w{int(60 * rnd.random() ** 3)}": rnd.random() for _ in range(rnd.choice([1, 4, 12]))}
                norm = math.sqrt(sum(x * x for x in v.values()))
                rows += [(t, i, w, x / norm) for w, x in v.items()]
        return rows, spark.createDataFrame(rows, f"transcript_id long, {name} int, term string, weight double")

    (one, left), (two, right) = unit("l", 40), unit("r", 30)
    group = ["transcript_id"]
    pairs = text.cosine_candidates(left, right, group, threshold)
    got = {(r.transcript_id, r.l, r.r): r.s for r in text.cosines(pairs, left, right, group).collect() if r.s >= threshold}
    want, other = {}, {}
    for t, r, w, x in two:
        other.setdefault((t, w), []).append((r, x))
    for t, i, w, x in one:
        for r, y in other.get((t, w), ()):
            want[t, i, r] = want.get((t, i, r), 0) + x * y
    good = {k: v for k, v in want.items() if v >= threshold}
    assert got == pytest.approx(good)
    assert len(good) <= pairs.count() <= len(want)
    if threshold == 0.8:
        assert pairs.count() < 0.5 * len(want)


def test_products_of_short_transcripts_at_once(spark):
    rnd = random.Random(7)
    names = [f"w{chr(97 + i)}{i}" for i in range(14)] + ["Été_1", "the", "x"]
    rows = [(t, i + 1, rnd.randrange(1, 12), rnd.choice([None, "", "the a"]) if rnd.random() < 0.1 else " ".join(rnd.choice(names) for _ in range(rnd.choice([1, 5, 20])))) for t, n in ((1, 30), (2, 1), (3, 9), (4, 2)) for i in range(n)]
    rows = [(t, i, p, "the" if t == 4 else x) for t, i, p, x in rows]
    c = spark.createDataFrame(rows, "transcript_id long, chunk_no int, start_page int, corpus string")
    groups = c.select("transcript_id", "chunk_no", F.expr("1 + chunk_no div 3").cast("int").alias("group_no"))
    taken = lambda df, *cols: {tuple(r[k] for k in cols[:-1]): r[cols[-1]] for r in df.collect()}
    none = c.select("transcript_id").limit(0)
    for cap in (8000, 9, 1):
        config = EngineConfig(segment_vocabulary=cap, max_pages_continue=2)
        weights = segment.chunk_weights(c, config)
        plain, fast = text.gram(weights, ["transcript_id"], "chunk_no"), segment.short_gram(c, none, config)
        assert taken(fast, "transcript_id", "i", "j", "g") == pytest.approx(taken(plain, "transcript_id", "i", "j", "g"))
        band = segment.band_gram(c, weights, config)
        assert taken(segment.band_of(c, fast, config), "transcript_id", "i", "j", "g") == pytest.approx(taken(band, "transcript_id", "i", "j", "g"))
        key = ("transcript_id", "chunk_no", "group_no", "similarity")
        related = taken(segment.related_candidates(groups, weights, config), *key)
        assert taken(segment.related_in_gram(groups, fast, config), *key) == pytest.approx(related) and related
    chars = {t: sum(len(x or "") for u, _, _, x in rows if u == t) for t in (1, 2, 3, 4)}
    assert sorted(r[0] for r in segment.long_transcripts(c, 9).collect()) == [1]
    assert sorted(r[0] for r in segment.long_transcripts(c, 30, chars[3] - 1).collect()) == [t for t in chars if chars[t] >= chars[3]]
    assert {k[0] for k in taken(segment.short_gram(c, segment.long_transcripts(c, 9), EngineConfig()), "transcript_id", "i", "j", "g")} <= {2, 3, 4}


def test_long_transcripts_have_the_same_topics(spark, sf):
    from lexarc.plans.pipeline import Transcripts

    one, other = Transcripts.of(spark, sf), Transcripts.of(spark, sf)
    other.long = one.kept_chunks.select("transcript_id").distinct().filter("transcript_id % 2 = 0")
    other.kept_chunks = one.kept_chunks
    assert other.long_chunks is not None and one.long_chunks is None
    plan = one.chunk_gram()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    for f in (Transcripts.chunk_gram, lambda t: t.band, lambda t: t.groups, Transcripts.related_candidates):
        a, b = (sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in f(t).collect()) for t in (one, other))
        assert a == b and a
    one.drop(), other.drop()
