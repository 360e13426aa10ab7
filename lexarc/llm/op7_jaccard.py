"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct k-word shingles as 64-bit hashes. Documents with equal sets form one class, of which
one representative goes on. All tokens have one global order, from rare to frequent: a fixed-size table of hashed counts
over the whole corpus says how frequent a token may be, ties go by hash. Rare tokens are told apart by the share of buckets
that are emptier than theirs, since in a large corpus all buckets hold many tokens. A pair with Jaccard similarity p of at least the
threshold misses at most tau = n - ceil(p n) tokens of either side. Each document's prefix in that order is extended
until rare tokens, which are indexed singly, and frequent ones, indexed as pairs within subclasses (the first token of a
subclass earns nothing), sum up to tau + 1. Then two linked documents have an indexed single or pair in common.

Members of an index entry are compared in two passes, so that entries of near copies never become all pairs. First each
member is verified against the entry's first, its previous, and its most shared member, and components are formed. Then
only entries that still hold several components go on: their members meet in blocks, where parity bitmaps bound the
symmetric difference from below, and pairs of different components within the bound are verified in rounds, likeliest
first. A pair that shares several entries is taken in the least of them only. An entry's largest component never meets
itself, so the work follows its other members. No link between different components can be lost, and links within one
would change nothing. Verification intersects the whole sets.

Entries of tokens so frequent that many members must be expected are dealt to slots by id, which all members know from
the corpus counts alone; the first pass works slot by slot, and the second lets blocks of all slots meet.

Null, empty and blank texts have an empty set and no links; their component is their own id. Texts with fewer than k
words have one shingle, the whole sequence. Repeated ids count as one document with several texts. Every row gives one
row; a null id keeps a null component unless its text equals that of another row. Columns other than the id and the text
are not read, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, bitmap, position, read, release
from .components import connected_components
from .wordhash import _U, _mix, word_hashes

#: Buckets of the corpus counts, in blocks.
BUCKET_BITS, BLOCK = 22, 65_536
BLOCK_ROWS = 512
#: Up to so many ids of eight bytes go to every executor.
BROADCAST_IDS = 100_000
#: Pairs of two components that the first round of the second pass verifies, and how much each further round takes more.
FIRST_PAIRS, PAIRS_GROW = 16, 64
#: Least keys of a member that travel with it, to tell whether a pair has met before.
LEAST_KEYS = 8
#: Members to be expected in a slot of a frequent entry; the low bits of a key hold the logarithm of its number of slots.
SLOT_ROWS, SLOT_BITS = 1_024, 5
#: Bits of the largest parity bitmap.
MOST_CELLS = 1 << 17
SLICE = 256
#: Classes of rare tokens by the counts of their buckets.
RARE_CLASSES = 120


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles."""
    h = word_hashes(text) if text else np.zeros(0, dtype=np.uint64)
    if not len(h):
        return h
    take = max(1, len(h) - k + 1)
    total = np.full(take, min(len(h), k), dtype=np.uint64)
    for i in range(min(k, len(h))):
        total = _mix(total + h[i:i + take] * _U(2 * i + 3))
    return np.unique(total)


def partner_sizes(n: int, percent: int) -> tuple[int, int]:
    return -(-percent * n // 100), 100 * n // percent


def expected(bound: float) -> np.ndarray:
    """Logarithm of the slots of an entry by the level of its rarer token; rare tokens, within the bound, have one slot."""
    count = bound * 2.0 ** (np.arange(256) / 4)
    slots = np.ceil(np.log2(np.maximum(1, count / max(SLOT_ROWS, bound))))
    slots[0] = 0
    return np.minimum(slots, (1 << SLOT_BITS) - 1).astype(np.uint64)


def prefix_keys(s: np.ndarray, level: np.ndarray, percent: int, slots: np.ndarray | None = None) -> np.ndarray:
    """Index entries of a set: s sorted, level 0 or below for rare tokens, the rarest least, and above for frequent ones, slots as expected() gives them."""
    slots = np.zeros(256, dtype=np.uint64) if slots is None else slots
    low_bits = _U((1 << SLOT_BITS) - 1)
    n = len(s)
    low, high = partner_sizes(n, percent)
    if n == 0 or (low == n and high == n):
        return np.zeros(0, dtype=np.uint64)  # only an equal set could link
    need = n - low + 1
    rare = np.flatnonzero(level <= 0)
    singles = s[rare[np.argsort(level[rare], kind="stable")[:need]]]
    out = [_mix(singles) & ~low_bits]
    if len(singles) == need:
        return np.unique(out[0])
    rest = np.flatnonzero(level > 0)
    rest = rest[np.argsort(level[rest], kind="stable")]
    rest, known = s[rest], level[rest]
    need -= len(singles)
    for size in range(low.bit_length(), high.bit_length() + 1):
        groups = max(1, (100 - percent) * (1 << size) // 400)
        sub = (rest >> _U(20)) % _U(groups)
        order = np.argsort(sub, kind="stable")
        first = np.zeros(len(rest), bool)
        first[order[np.concatenate(([True], np.diff(sub[order]) != 0))]] = True
        reach = np.searchsorted(np.cumsum(~first), need) + 1
        t, g, f = rest[:reach], sub[:reach], known[:reach]
        order = np.argsort(g, kind="stable")
        t, g, f = t[order], g[order], f[order]
        ends = np.searchsorted(g, g, side="right")
        left = np.repeat(np.arange(len(t)), ends - np.arange(len(t)) - 1)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(ends - np.arange(len(t)) - 1) - (ends - np.arange(len(t)) - 1), ends - np.arange(len(t)) - 1)
        a, b = np.minimum(t[left], t[right]), np.maximum(t[left], t[right])
        out.append((_mix(_mix(a + _U(size)) + b) & ~low_bits) | slots[np.minimum(f[left], f[right])])
    return np.unique(np.concatenate(out))


def parity_bits(s: np.ndarray) -> bytes:
    """Parity of the tokens in each of one to two times as many cells; two sets differ in no fewer tokens than cells."""
    cells = min(MOST_CELLS, 1 << max(6, len(s).bit_length()))
    return np.packbits(np.bincount((s & _U(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1, bitorder="little").tobytes()


def fold(bits: np.ndarray, to: int) -> np.ndarray:
    while bits.shape[-1] > to:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _nested(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), _signed(flat))


def packed(counts: np.ndarray) -> bytes:
    """32-bit counts in planes of bytes, compressed: most are small."""
    return pa.compress(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    planes = pa.decompress(data, decompressed_size=4 * BLOCK, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(4, -1).T).view("<u4")[:, 0]


def _sliced(batches):
    for big in batches:
        for at in range(0, big.num_rows, SLICE):
            yield big.slice(at, SLICE)
    release()


def _profile(docs: DataFrame, k: int) -> DataFrame:
    """Rows (id, n, fp1, fp2, null, null) for documents, and (null, ..., block, counts) for the corpus counts."""

    def run(batches):
        total, waiting = np.zeros(1 << BUCKET_BITS, dtype=np.uint32), []
        names = ["id", "n", "fp1", "fp2", "block", "counts"]

        def flush():
            if waiting:
                at = (np.concatenate(waiting) >> _U(64 - BUCKET_BITS)).astype(np.int32)
                waiting.clear()
                for begin in range(0, len(total), len(total) // 8):  # a part at a time, since bincount makes wide sums
                    part = total[begin:begin + len(total) // 8]
                    part += np.bincount(at[(at >= begin) & (at < begin + len(part))] - begin, minlength=len(part)).astype(np.uint32)

        for b in _sliced(batches):
            sets = [shingle_set(t, k) for t in b.column(1).to_pylist()]
            waiting += sets
            if sum(map(len, waiting)) > 1_000_000:
                flush()
            m = len(sets)
            fp = np.array([[x.sum(dtype=np.uint64), _mix(x ^ _U(0x5DEECE66D)).sum(dtype=np.uint64)] for x in sets], dtype=np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int32()), _signed(fp[:, 0].copy()), _signed(fp[:, 1].copy()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names=names)
        flush()
        m = len(total) // BLOCK
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(range(m), pa.int32()),
                                          pa.array([packed(total[i * BLOCK:(i + 1) * BLOCK]) for i in range(m)], pa.binary())], names=names)

    return docs.mapInArrow(run, "id long, n int, fp1 long, fp2 long, block int, counts binary")


def levels(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Level of each bucket: up to 0 where its count is within what rare tokens alone would give, by the share of such buckets
    that hold more, above 0 on a log scale; and that bound."""
    usual = float(np.median(counts))
    bound = max(16.0, usual + 8 * np.sqrt(usual + 1))
    high = counts > bound
    below = np.cumsum(np.bincount(counts[~high].astype(np.int64), minlength=1))
    rank = (-(RARE_CLASSES * (below[-1] - below)) // max(1, below[-1])).astype(np.int8)
    level = rank[np.where(high, 0, counts)]
    level[high] = np.clip(1 + 4 * np.log2(counts[high] / bound), 1, 127).astype(np.int8)
    return level, bound


def _levels(profile: DataFrame) -> tuple[np.ndarray, float]:
    """levels() of the corpus counts."""

    def add(key, table):
        total = np.zeros(BLOCK, dtype=np.uint64)
        for x in table.column("counts").to_pylist():
            total += unpacked(x)
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([packed(np.minimum(total, 0xFFFFFFFF))], pa.binary())})

    parts = profile.filter("block is not null").select("block", "counts", F.pmod(F.xxhash64("counts"), F.lit(32)).alias("s"))
    once = parts.groupBy("block", "s").applyInArrow(add, "block int, counts binary")
    out = np.zeros(1 << BUCKET_BITS, dtype=np.uint32)
    for r in once.groupBy("block").applyInArrow(add, "block int, counts binary").toLocalIterator():  # a fixed number of buckets
        out[r.block * BLOCK:(r.block + 1) * BLOCK] = unpacked(r.counts)
    return levels(out)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    right = pairs.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    both = right.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a")
    both = both.select("a", "b", (F.size("ta") + F.size("tb")).alias("sum"), F.size(F.array_intersect("ta", "tb")).alias("common"))
    return both.filter(100 * F.col("common") >= percent * (F.col("sum") - F.col("common"))).select("a", "b")


def _within_bound(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs whose bitmaps leave a link possible: the least overlap of a link leaves (1 - p) / (1 + p) of both sizes."""

    def run(batches):
        for b in _sliced(batches):
            keep = []
            for i, (x, y, n) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
                small = min(len(x), len(y))
                if (100 + percent) * int(np.bitwise_count(fold(x, small) ^ fold(y, small)).sum()) <= (100 - percent) * n:
                    keep.append(i)
            b = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"])

    right = pairs.join(bits.select(F.col("id").alias("b"), F.col("bits").alias("y"), F.col("n").alias("m")), "b")
    both = right.join(bits.select(F.col("id").alias("a"), F.col("bits").alias("x"), "n"), "a")
    return both.select("a", "b", "x", "y", (F.col("n") + F.col("m")).alias("n")).mapInArrow(run, "a long, b long")


def _token_sets(texts: DataFrame, pairs: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(id, tokens) of the documents in pairs. Few ids are sent along; of many, a bitmap of bounded size spares the other texts before the exact join."""
    involved = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    if involved.count() <= BROADCAST_IDS:
        def all_tokens(batches):
            for b in _sliced(batches):
                yield pa.RecordBatch.from_arrays([b.column(0), _nested([shingle_set(t, k) for t in b.column(1).to_pylist()])], names=["id", "tokens"])

        return scratch.keep(texts.join(F.broadcast(involved), "id", "left_semi").mapInArrow(all_tokens, "id long, tokens array<long>"))
    bits, marks = bitmap(involved, "id")
    marked = texts.sparkSession.sparkContext.broadcast(marks)  # of bounded size

    def tokens(batches):
        m = np.unpackbits(marked.value, bitorder="little")
        for b in _sliced(batches):
            b = b.take(pa.array(np.flatnonzero(m[np.asarray(b.column(2))])))
            yield pa.RecordBatch.from_arrays([b.column(0), _nested([shingle_set(t, k) for t in b.column(1).to_pylist()])], names=["id", "tokens"])

    sets = texts.filter("id is not null").withColumn("h", position("id", bits)).mapInArrow(tokens, "id long, tokens array<long>")
    return scratch.keep(sets.join(involved, "id", "left_semi"))


def spanning_pairs(gaps: np.ndarray, ca: np.ndarray, cb: np.ndarray, more: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a matrix of gaps (negative: no candidate) between members of components ca and cb: the pairs of a minimum spanning
    forest over the components, and the `more` smallest of each two components. The last array tells which components have more."""
    r, c = np.nonzero(gaps >= 0)
    if not len(r):
        return r, c, np.zeros(0, bool)
    names, code = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    x, y = code[: len(ca)][r], code[len(ca):][c]
    pair = np.minimum(x, y) * len(names) + np.maximum(x, y)
    g = gaps[r, c]
    order = np.lexsort((c, r, g, pair))
    r, c, pair, g = r[order], c[order], pair[order], g[order]
    first = np.concatenate(([True], pair[1:] != pair[:-1]))
    begin = np.flatnonzero(first)
    count = np.diff(np.concatenate((begin, [len(pair)])))
    rank = np.arange(len(pair)) - np.repeat(begin, count)
    take = rank < more
    far = np.iinfo(np.int32).max
    d = np.full((len(names), len(names)), far, dtype=np.int32)
    which = np.zeros_like(d)
    x, y = pair[begin] // len(names), pair[begin] % len(names)
    d[x, y] = d[y, x] = g[begin]
    which[x, y] = which[y, x] = begin
    outside = np.ones(len(names), bool)
    near, via = np.full(len(names), far, dtype=np.int32), np.zeros(len(names), dtype=np.int64)
    for _ in range(len(names)):
        u = int(np.where(outside, near, far).argmin())
        if near[u] == far or not outside[u]:
            u = int(outside.argmax())
        else:
            take[which[u, via[u]]] = True
        outside[u] = False
        closer = outside & (d[u] < near)
        near[closer], via[closer] = d[u][closer], u
    return r[take], c[take], np.repeat(count, count)[take] > max(more, 1)


def _hot(key: str = "key") -> Column:
    """Whether an entry is dealt to slots."""
    return F.col(key).bitwiseAND((1 << SLOT_BITS) - 1) > 0


def _slot(key: str = "key", member: str = "id") -> Column:
    return F.expr(f"pmod(xxhash64({member}), shiftleft(1L, cast({key} & {(1 << SLOT_BITS) - 1} as int)))")


def _blocks(entries: DataFrame, bits: DataFrame, comps: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(key, major, block, rows, low, high): the members of entries that hold several components, in blocks by size.

    A block holds members of the entry's largest component only (major), or only others.
    """
    named = entries.join(comps, "id", "left").select("key", "slot", "id", "n", F.coalesce("component_id", "id").alias("comp"))
    sizes = named.groupBy("key", "comp").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("most")).filter("comps > 1").select("key", F.col("most.comp").alias("most"))
    w = W.partitionBy("key", "slot").orderBy("n", "id")
    near = _hot() | F.coalesce(100 * F.lag("n").over(w) >= percent * F.col("n"), F.lit(False)) | F.coalesce(percent * F.lead("n").over(w) <= 100 * F.col("n"), F.lit(False))
    rows = named.join(mixed, "key").withColumn("near", near).filter("near").drop("near")  # others have no partner of their size
    rows = scratch.keep(rows.withColumn("major", F.col("comp") == F.col("most")).drop("most"))
    alike = rows.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")).filter("x <> y")
    rows = scratch.keep(rows.join(alike.groupBy("m", "who").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"))  # entries with the same members need one look
    least = rows.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LEAST_KEYS).alias("least"))  # of one document's keys
    w = W.partitionBy("key", "slot", "major").orderBy("n", "id")
    placed = rows.withColumn("block", F.shiftleft(F.col("slot"), 32) + F.floor((F.row_number().over(w) - 1) / BLOCK_ROWS))
    member = F.struct("n", "id", "comp", "bits", F.filter("least", lambda x: x < F.col("key")).alias("least"))
    return placed.join(bits.join(least, "id"), "id").groupBy("key", "major", "block").agg(F.collect_list(member).alias("rows"), F.min("n").alias("low"), F.max("n").alias("high"))


def _cross_pairs(entries: DataFrame, bits: DataFrame, comps: DataFrame, percent: int, more: int, scratch: Scratch) -> DataFrame:
    """(a, b, cut): pairs of different components within an entry that their bitmaps let pass, as spanning_pairs picks them.

    cut tells that two components have further pairs. A pair is taken in the least entry that it shares, but for pairs whose
    least keys have nothing in common, which may come again.
    """
    blocks = scratch.keep(_blocks(entries, bits, comps, percent, scratch))
    slim = blocks.select("key", "major", "block", "low", "high")
    one, two = (slim.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("major", "block", "low", "high"))) for x in "ij")
    meet = one.join(two, "key").filter(f"not major_i and (major_j or block_i <= block_j) and {percent} * low_j <= 100 * high_i and {percent} * low_i <= 100 * high_j")
    meet = meet.select("key", "major_j", "block_i", "block_j")
    left = blocks.filter("not major").select("key", F.col("block").alias("block_i"), F.col("rows").alias("left"))
    right = blocks.select("key", F.col("major").alias("major_j"), F.col("block").alias("block_j"), F.col("rows").alias("right"))
    same = meet.filter("not major_j and block_i = block_j").join(left, ["key", "block_i"]).filter("size(left) > 1").select("left", F.lit(None).cast(blocks.schema["rows"].dataType).alias("right"))
    meet = meet.filter("major_j or block_i < block_j").join(left, ["key", "block_i"]).join(right, ["key", "major_j", "block_j"]).select("left", "right").unionByName(same)

    def columns(cell):
        rows = cell.values
        bits = rows.field("bits").to_pylist()
        return *(np.asarray(rows.field(c)) for c in ("n", "id", "comp")), [np.frombuffer(x, dtype=np.uint64) for x in bits], np.array([len(x) // 8 for x in bits]), rows.field("least").to_pylist()

    def compare(batches):
        for big in batches:
            for at in range(big.num_rows):
                one = big.slice(at, 1)
                na, ia, ca, xa, sa, ka = columns(one.column(0)[0])
                alone = not one.column(1)[0].is_valid
                nb, ib, cb, xb, sb, kb = (na, ia, ca, xa, sa, ka) if alone else columns(one.column(1)[0])
                gaps = np.full((len(na), len(nb)), -1, dtype=np.int32)
                for size in np.unique(sb):
                    where = np.flatnonzero(sb == size)
                    stack = np.stack([xb[i] for i in where])
                    for r in range(len(na)):
                        fits = np.flatnonzero((cb[where] != ca[r]) & (percent * np.maximum(nb[where], na[r]) <= 100 * np.minimum(nb[where], na[r])) & ((where > r) if alone else True))
                        if not len(fits):
                            continue
                        small = min(size, sa[r])
                        to = where[fits]
                        gap = np.maximum(np.bitwise_count(fold(stack[fits], small) ^ fold(xa[r], small)).sum(axis=1, dtype=np.int64), np.abs(nb[to] - na[r]))
                        ok = (100 + percent) * gap <= (100 - percent) * (nb[to] + na[r])
                        gaps[r, to[ok]] = gap[ok]
                before_b = [frozenset(k) for k in kb]
                for r, c in np.argwhere(gaps >= 0):
                    if not before_b[c].isdisjoint(ka[r]):
                        gaps[r, c] = -1
                r, c, cut = spanning_pairs(gaps, ca, cb, more)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ia[r], ib[c])), pa.array(np.maximum(ia[r], ib[c])), pa.array(cut)], names=["a", "b", "cut"])
        release()

    found = scratch.keep(meet.mapInArrow(compare, "a long, b long, cut boolean").groupBy("a", "b").agg(F.max("cut").alias("cut")))
    scratch.drop(blocks)
    return found


def _settle(entries: DataFrame, bits: DataFrame, texts: DataFrame, comps: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """Components after all links within entries. Two components need one link, so the likeliest pairs go first.

    Each round verifies a spanning forest over an entry's components and the nearest pairs of each two. Entries where two have
    further pairs go on, with more of them; the rounds end when every pair of different components that their bitmaps
    let pass has been verified.
    """
    more, tried = FIRST_PAIRS, None
    while True:
        found = _cross_pairs(entries, bits, comps, percent, more, scratch)
        new = found.select("a", "b") if tried is None else found.select("a", "b").join(tried, ["a", "b"], "left_anti")
        new = scratch.keep(new)
        if not new.isEmpty():
            good = scratch.keep(_verified(new, _token_sets(texts, new, k, scratch), percent))
            if not good.isEmpty():
                comps = scratch.keep(connected_components(good.union(comps.select(F.col("id").alias("a"), F.col("component_id").alias("b"))), scratch))
        cut = found.filter("cut")
        if cut.isEmpty():
            return comps
        entries = scratch.keep(entries.join(entries.join(cut.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select("key").distinct(), "key", "left_semi"))
        tried = new if tried is None else scratch.keep(tried.union(new))
        more *= PAIRS_GROW


def jaccard_join(docs: DataFrame, scratch: Scratch, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, component_id) for every row of docs: size of its set and the smallest id reachable by links."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    profile = scratch.keep(_profile(texts, k))
    level, bound = _levels(profile)
    slots = expected(bound)
    table = docs.sparkSession.sparkContext.broadcast(level)  # 2^22 bytes at any input size
    rows = scratch.keep(profile.filter("block is null").select("id", "n", "fp1", "fp2"))
    scratch.drop(profile)
    classes = scratch.keep(rows.filter("n > 0").groupBy("n", "fp1", "fp2").agg(F.min("id").alias("rep")))
    reps = classes.filter("rep is not null").select(F.col("rep").alias("id")).distinct()

    def index(batches):
        lev = table.value
        for b in _sliced(batches):
            sets = [shingle_set(t, k) for t in b.column(1).to_pylist()]
            keys = [prefix_keys(x, lev[(x >> _U(64 - BUCKET_BITS)).astype(np.int64)], percent, slots) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int32()), _nested(keys), pa.array([parity_bits(x) for x in sets], pa.binary())], names=["id", "n", "keys", "bits"])

    indexed = scratch.keep(texts.mapInArrow(index, "id long, n int, keys array<long>, bits binary").filter("size(keys) > 0").join(reps, "id", "left_semi"))
    bits = indexed.select("id", "n", "bits")
    w = W.partitionBy("key", "slot").orderBy("n", "id")
    shared = scratch.keep(indexed.select("id", "n", F.explode("keys").alias("key")).withColumn("slot", _slot()).select(
        "key", "slot", "id", "n", F.lag("id").over(w).alias("last"), F.lag("n").over(w).alias("last_n"), F.first("id").over(w).alias("first"), F.first("n").over(w).alias("first_n"),
        F.count("*").over(W.partitionBy("key", "slot")).alias("m")).filter((F.col("m") > 1) | _hot()))
    # the member whose entries are shared most is likeliest the original of near copies
    score = shared.groupBy("id").agg(F.sum("m").alias("score"))
    many = shared.filter((F.col("m") > 3) | _hot()).select("key", "slot", "id", "n")
    hub = many.join(score, "id").groupBy("key", "slot").agg(F.max(F.struct("score", "id", "n")).alias("h")).select("key", "slot", F.col("h.id").alias("hub"), F.col("h.n").alias("hub_n"))
    stars = [shared.filter("last is not null").select("id", "n", F.col("last").alias("o"), F.col("last_n").alias("m")), shared.select("id", "n", F.col("first").alias("o"), F.col("first_n").alias("m")),
             many.join(hub, ["key", "slot"]).select("id", "n", F.col("hub").alias("o"), F.col("hub_n").alias("m"))]
    pairs = reduce(DataFrame.unionByName, stars).filter(f"o <> id and {percent} * greatest(n, m) <= 100 * least(n, m)").select(F.least("id", "o").alias("a"), F.greatest("id", "o").alias("b")).distinct()
    near = scratch.keep(_within_bound(pairs, bits, percent))
    links = scratch.keep(_verified(near, _token_sets(texts, near, k, scratch), percent))
    comps = scratch.keep(connected_components(links, scratch))
    comps = _settle(many, bits.select("id", "bits"), texts, comps, k, percent, scratch)
    scratch.drop(shared, indexed)
    named = classes.join(comps.select(F.col("id").alias("rep"), F.col("component_id").alias("found")), "rep", "left").select("n", "fp1", "fp2", F.coalesce("found", "rep").alias("component_id"))
    return rows.join(named, ["n", "fp1", "fp2"], "left").select("id", "n", F.coalesce("component_id", "id").alias("component_id"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jaccard_join(read(spark, sf_dir, "documents"), Scratch(spark, "jaccard"))
    return got.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")


QUERIES, SQL = {"op7_jaccard": op7_jaccard}, {}
