"""Suffix-array dedup with sparse suffixes.

Of the suffixes of all texts, only those that begin at content-selected positions are kept: the minimisers, over
windows of MIN_WORDS - SEED + 1 positions, of the hashes of SEED consecutive words. Any passage of MIN_WORDS words holds
one with its whole seed, wherever it stands. Seeds that occur once can't begin a repeat and go. The rest, with hashes of
the words that follow and precede, are sorted by seed and following words. A suffix stands for the passages of MIN_WORDS
words whose minimiser it is: l words on its left, its seed, and the other words on its right. Two of them that agree in
l and all their words are a repeat, whatever number of suffixes share the seed. Suffixes are compared in chunks of the
sorted rows; of the seeds at a chunk's ends, which may go on in the next, one row a passage is compared over all chunks.
Overlapping passages of a document merge to spans.

Positions count words between white space (`[^\\x20\\x09-\\x0D]+`); case counts. Texts that are equal as a whole are
sorted once, and repeat as a whole if they have MIN_WORDS words. A repeat may lie in the same text; where it overlaps
itself (a run of one word that is shorter than two passages) it may be missed. Null, empty and short
texts have no spans. Every row gives one row; repeated rows are copies of each other. Texts are told apart by their words, never
by their id: rows without an id are compared like all others, and texts that share an id have spans of their own. In a run of equal seeds
(one word over and over) every RUN-th position and the last are kept. Columns other than the id and the text are not
read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, bitmap, join_spread, position, read
from .wordhash import _U, _mix, word_hashes

MIN_WORDS, SEED, RUN = 50, 20, 16
#: Words of a passage beside its seed.
BESIDE = MIN_WORDS - SEED
#: Sorted suffixes compared at once (some 500 bytes each).
CHUNK = 16_384
#: Words kept on either side of a seed, at three bytes each.
SIDE, BYTES = 32, 3
SLICE = 256


def minimisers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions, seeds, reach) kept of a text with word hashes h.

    Reach holds the least and the most words on the left of a position in the passages that it stands for, as 32 * least + most.
    """
    m = len(h) - SEED + 1
    if len(h) < MIN_WORDS:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    s = np.zeros(m, dtype=np.uint64)
    for i in range(SEED):
        s = s * _U(0x9E3779B97F4A7C15) + h[i:i + m]
    s = _mix(s)
    views = np.lib.stride_tricks.sliding_window_view(s, MIN_WORDS - SEED + 1)
    at, first, count = np.unique(views.argmin(axis=1) + np.arange(len(views)), return_index=True, return_counts=True)
    reach = 32 * (at - first - count + 1) + at - first
    again = np.concatenate(([False], (s[at[1:]] == s[at[:-1]]) & (np.diff(at) == 1)))
    if again.any():
        begin = np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))
        last = np.concatenate((~again[1:], [True]))
        reach[again | ~last] = BESIDE  # those that stay stand for all passages around them
        keep = (~again) | ((np.arange(len(at)) - begin) % RUN == 0) | last
        at, reach = at[keep], reach[keep]
    return at, s[at], reach


def _sides(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the SIDE words after each seed and before it (nearest first); beyond the text a value of its own."""
    short = np.concatenate(([0] * SIDE, (h >> _U(40)).astype(np.uint32) | 1, [0] * (SIDE + SEED))).astype(np.uint32)
    right = short[at[:, None] + SIDE + SEED + np.arange(SIDE)]
    left = short[at[:, None] + SIDE - 1 - np.arange(SIDE)]
    pack = lambda a: np.ascontiguousarray(a.astype(">u4").view(np.uint8).reshape(len(a), SIDE, 4)[:, :, 4 - BYTES:]).reshape(len(a), SIDE * BYTES)
    return pack(right), pack(left)


def _passages(seed: np.ndarray, right: np.ndarray, left: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per suffix and number of words on its left, the hash of that passage, and whether the suffix stands for it."""

    def prefixes(a):
        w = a.reshape(len(a), SIDE, BYTES).astype(np.uint64)
        w = (w[:, :, 0] << _U(16)) | (w[:, :, 1] << _U(8)) | w[:, :, 2]
        out = np.zeros((len(a), BESIDE + 1), dtype=np.uint64)
        for k in range(BESIDE):
            out[:, k + 1] = _mix(out[:, k] + w[:, k] * _U(0x9E3779B97F4A7C15) + _U(k + 1))
        return out, (w != 0).cumprod(axis=1).sum(axis=1)[:, None]

    (l, words_left), (r, words_right) = prefixes(left), prefixes(right)
    k = np.arange(BESIDE + 1)
    keys = _mix(_mix(l * _U(0xD6E8FEB86659FD93) + r[:, ::-1] + k.astype(np.uint64)) + seed.view(np.uint64)[:, None])
    return keys, (k >= reach[:, None] // 32) & (k <= reach[:, None] % 32) & (k <= words_left) & (BESIDE - k <= words_right)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


NAMES = ["seed", "right", "left", "id", "pos", "reach"]
SCHEMA = "seed long, right binary, left binary, id long, pos int, reach int"


def _suffixes(texts: DataFrame, seeds, ids) -> DataFrame:
    """The suffixes whose seed is in one bitmap and whose row's pick is in the other, under their text's key."""
    (seed_bits, seed_marks), (id_bits, id_marks) = seeds, ids
    sc = texts.sparkSession.sparkContext
    shared = sc.broadcast((seed_marks, id_marks))  # of bounded size

    def run(batches):
        m, known = (np.unpackbits(x, bitorder="little") for x in shared.value)
        for big in batches:
            for a in range(0, big.num_rows, SLICE):
                b = big.slice(a, SLICE)
                b = b.take(pa.array(np.flatnonzero(known[np.asarray(b.column(2))])))
                out = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    h = word_hashes(t, fold_case=False)
                    at, s, reach = minimisers(h)
                    keep = m[_places(s, seed_bits)] == 1
                    at, s, reach = at[keep], s[keep], reach[keep]
                    if len(at):
                        out.append((s, *_sides(h, at), np.full(len(at), i), at, reach))
                if out:
                    s, right, left, i, at, reach = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), _binary(right), _binary(left), pa.array(i.astype(np.int64)), pa.array(at.astype(np.int32)), pa.array(reach.astype(np.int32))], names=NAMES)

    return texts.filter("text is not null").select(F.col("key").alias("id"), "text", position("pick", id_bits).alias("h")).mapInArrow(run, SCHEMA)


def _places(s: np.ndarray, bits: int) -> np.ndarray:
    return (s & _U(bits - 1)).astype(np.int64)


def _seed_bitmap(seeds: DataFrame, low: int = 1 << 20, high: int = 1 << 27):
    """As common.bitmap, with a seed's low bits as its place."""
    n, bits = seeds.count(), low
    while bits < min(high, 8 * n):
        bits *= 2
    marks = np.zeros(bits // 8, dtype=np.uint8)
    at = F.col("seed").bitwiseAND(F.lit(bits - 1)) + 1
    for r in seeds.select(at.alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("g")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("m")).toLocalIterator():
        begin = (r.g - 1) * 4096
        marks[begin:begin + 4096] = np.frombuffer(r.m, dtype=np.uint8)
    return bits, marks


def _compare(t: pa.Table) -> pa.RecordBatch:
    """(id, first, last, key) of sorted suffixes: repeats among them, and with their key passages that others may repeat."""
    cell = lambda k: np.frombuffer(b"".join(t.column(k).to_pylist()), dtype=np.uint8).reshape(-1, SIDE * BYTES)
    seed, i, at = (np.asarray(t.column(k)) for k in ("seed", "id", "pos"))
    keys, own = _passages(seed, cell("right"), cell("left"), np.asarray(t.column("reach")))
    least, most = np.full(len(seed), BESIDE + 1), np.full(len(seed), -1)
    ends = (seed == seed[0]) | (seed == seed[-1])
    open_ = []
    for l in range(BESIDE + 1):
        rows = np.flatnonzero(own[:, l])
        rows = rows[np.argsort(keys[rows, l], kind="stable")]
        same = np.concatenate(([False], keys[rows[1:], l] == keys[rows[:-1], l], [False])) if len(rows) else np.zeros(1, bool)
        twice = rows[same[1:] | same[:-1]]
        least[twice], most[twice] = np.minimum(least[twice], l), l
        once = rows[~same[:-1] & ends[rows]]
        open_.append((i[once], at[once] - l, at[once] - l + MIN_WORDS, keys[once, l]))
    k = np.flatnonzero(most >= 0)
    ids, first, last, key = (np.concatenate(x) for x in zip(*open_, strict=True))
    key = pa.concat_arrays([pa.nulls(len(k), pa.int64()), pa.array(key.view(np.int64))])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate((i[k], ids))), pa.array(np.concatenate((at[k] - most[k], first)).astype(np.int32)),
                                       pa.array(np.concatenate((at[k] - least[k] + MIN_WORDS, last)).astype(np.int32)), key], names=["id", "first", "last", "key"])


def _matches(ordered: DataFrame, chunk: int) -> DataFrame:
    """(id, first, last, key) as _compare gives them for each chunk of sorted suffixes."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= chunk:
                yield _compare(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield _compare(pa.Table.from_batches(held))

    return ordered.mapInArrow(run, "id long, first int, last int, key long")


def repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, n_words, copies, spans array<struct<start, end>>) for every row of docs, in words from 0, ends excluded."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("key", F.xxhash64("text")).withColumn("pick", F.coalesce("id", "key"))

    def profile(batches):
        for big in batches:
            for a in range(0, big.num_rows, SLICE):
                b = big.slice(a, SLICE)
                n, seeds = [], []
                for t in b.column(1).to_pylist():
                    h = word_hashes(t or "", fold_case=False)
                    n.append(len(h))
                    seeds.append(minimisers(h)[1].view(np.int64))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in seeds]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(n, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(seeds)))], names=["id", "whole", "key", "n_words", "seeds"])

    seen = scratch.keep(texts.select("id", "text", F.md5(F.col("text").cast("binary")).alias("whole"), "key").mapInArrow(profile, "id long, whole string, key long, n_words int, seeds array<long>"))
    classes = scratch.keep(seen.groupBy("whole", "n_words").agg(F.min("id").alias("rep"), F.min("key").alias("key"), F.count("*").alias("copies")))
    # one row stands for equal texts: that with the least id, or those without an id where there is none
    reps = classes.filter(f"n_words >= {MIN_WORDS}").select(F.coalesce("rep", "key").alias("pick"))
    once = seen.withColumn("pick", F.coalesce("id", "key")).join(reps, "pick", "left_semi").select(F.explode("seeds").alias("seed"))
    twice = scratch.keep(once.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1").select("seed"))
    rows = scratch.keep(_suffixes(texts, _seed_bitmap(twice), bitmap(reps, "pick")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "seed", "right", "id", "pos").sortWithinPartitions("seed", "right", "id", "pos")
    found = scratch.keep(_matches(ordered, chunk))
    scratch.drop(rows)
    open_ends = found.filter("key is not null")
    again = scratch.keep(open_ends.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"))
    across = join_spread(open_ends, again, ["key"], "n").select("id", "first", "last")
    spans = found.filter("key is null").select("id", "first", "last").unionByName(across)
    w = W.partitionBy("id").orderBy("first", "last")
    island = spans.distinct().withColumn("new", F.coalesce(F.col("first") > F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)).cast("int")).withColumn("k", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    merged = island.groupBy("id", "k").agg(F.min("first").alias("start"), F.max("last").alias("end")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    named = classes.join(merged.withColumnRenamed("id", "key"), "key", "left").select(
        "whole", "n_words", "copies", F.when((F.col("copies") > 1) & (F.col("n_words") >= MIN_WORDS), F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").alias("end")))).otherwise(
            F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)"))).alias("spans"))
    return seen.select(
        "id", F.coalesce("whole", F.lit("")).alias("whole"), "n_words").join(named.withColumn("whole", F.coalesce("whole", F.lit(""))), ["whole", "n_words"]).select("id", "n_words", "copies", "spans")


def cut(text: str, spans) -> str:
    """A text without the words in its spans, the others joined by blanks."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    gone = {i for s, e in spans for i in range(s, e)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repeats(read(spark, sf_dir, "documents"), Scratch(spark, "repeats"))
    return got.select(F.col("id").alias("doc_id"), "n_words", "copies", F.size("spans").alias("n_repeats"), F.expr("aggregate(spans, 0, (a, x) -> a + x.end - x.start)").alias("repeated_words"), "spans")


QUERIES, SQL = {"op9_suffix": op9_suffix}, {}
