"""Vector code compression: every part of a vector becomes the number of its nearest codebook entry, in whole numbers.

Vectors are cut into equal parts and each part position has a codebook. The nearest entry is found coarse to fine. The mean of
a part and the length of what is left beside it bound the distance to an entry from below; halves, quarters and so on bound it
more closely. An entry goes only if its bound, lowered by more than rounding can have raised it, is strictly above the exact
distance to an entry that was measured, so an entry that could win or tie is never lost. What is left gets its exact integer
distance, and ties go to the lower number: the result is that of measuring everything.

A round is one pass over the vectors that adds up one row a part and entry in each task; only codebooks, of fixed size, pass
through the driver.

Vectors that are null or hold null or non-finite components are left out, and so are those that can't be cut into equal parts
or have another length than the kept vector of the smallest id; an integer beyond 2^24 in size raises an error. Rows that
repeat an id are vectors of their own; first entries of equal ids go by their components, and rows without an id come last as
first entries. With fewer vectors than entries there are as many entries as vectors; an empty table gives no row. A null label
is a label of its own. Columns other than the three are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_spread, read
from .vectors import finite, floor_means, lists, matrix, scaled

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Relative slack of bounds: far above the rounding of double precision.
SLACK = 1e-11


def levels(width: int) -> list[list[int]]:
    """Starts of the blocks of a part, coarse to fine, down to blocks of two: one block, two, four and so on."""
    found, blocks = [], 1
    while blocks == 1 or width // blocks >= 2:
        found.append([b * width // blocks for b in range(blocks)])
        blocks *= 2
    return found


class Shapes:
    """Block means times the root of their length, length of the residual, and whole length, of rows at each level."""

    def __init__(self, x: np.ndarray):
        y = x.astype(np.float64)
        self.size = np.sqrt((y * y).sum(axis=1))
        self.means, self.rest = [], []
        for starts in levels(x.shape[1]):
            length = np.diff([*starts, x.shape[1]])
            mean = np.add.reduceat(y, starts, axis=1) / length
            self.means.append(mean * np.sqrt(length))
            self.rest.append(np.sqrt(np.square(y - np.repeat(mean, length, axis=1)).sum(axis=1)))


def below(x: Shapes, e: Shapes, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lower bounds of the squared distances of rows i and entries j (arrays that broadcast), lowered by the slack."""
    give = SLACK * (x.size[i] + e.size[j])
    total = np.square(np.maximum(np.abs(x.rest[level][i] - e.rest[level][j]) - give, 0))
    for b in range(x.means[level].shape[1]):
        total += np.square(np.maximum(np.abs(x.means[level][i, b] - e.means[level][j, b]) - give, 0))
    return total * (1 - SLACK)


def nearest(x: np.ndarray, entries: np.ndarray, e: Shapes) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest entry, exact squared distance, exact distances taken) for each row of integers x."""
    def exact(i, j):
        d = x[i] - entries[j]
        return np.einsum("nd,nd->n", d, d)

    def least(i, values):
        """Place of the first least value of each row; pairs go by row and entry, and each row has one at least."""
        begin = np.flatnonzero(np.diff(i, prepend=-1))
        low = np.repeat(np.minimum.reduceat(values, begin), np.diff([*begin, len(i)]))
        at = np.flatnonzero(values == low)
        return at[np.flatnonzero(np.diff(i[at], prepend=-1))]

    rows, s, taken = np.arange(len(x)), Shapes(x), len(x)
    low = below(s, e, 0, rows[:, None], np.arange(len(entries))[None, :])
    best = exact(rows, low.argmin(axis=1))
    i, j = np.nonzero(low <= best[:, None])
    for level in range(1, len(s.means)):
        low = below(s, e, level, i, j)
        likely = least(i, low)
        best, taken = np.minimum(best, exact(i[likely], j[likely])), taken + len(likely)
        keep = low <= best[i]
        i, j = i[keep], j[keep]
    d = exact(i, j)
    at = least(i, d)
    return j[at], d[at], taken + len(i)


def _parts(batch: pa.RecordBatch, books: np.ndarray) -> np.ndarray:
    """(part, row, place) of a batch's vectors."""
    parts, _, width = books.shape
    return matrix(batch.column("v"), parts * width).reshape(-1, parts, width).transpose(1, 0, 2)


def _sums(books: np.ndarray):
    """Rows (part, entry, n, total) of a task: as many as the codebooks have entries, at most."""
    def run(batches):
        parts, entries, width = books.shape
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        shapes = [Shapes(x) for x in books]
        for b in batches:
            for p, x in enumerate(_parts(b, books)):
                if len(x):
                    at, _, _ = nearest(x, books[p], shapes[p])
                    n[p] += np.bincount(at, minlength=entries)
                    np.add.at(total[p], at, x)
        p, k = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(n[p, k]), lists(total[p, k], pa.int64())], names=["part", "entry", "n", "total"])
    return run


def _encode(books: np.ndarray):
    def run(batches):
        shapes = [Shapes(x) for x in books]
        digits = np.array([f"{k:02x}" for k in range(books.shape[1])])
        for b in batches:
            code, error, taken = [], np.zeros(b.num_rows, np.int64), 0
            for p, x in enumerate(_parts(b, books)):
                if len(x):
                    at, d, some = nearest(x, books[p], shapes[p])
                    code.append(digits[at])
                    error, taken = error + d, taken + some
            text = ["".join(c) for c in zip(*code, strict=True)]
            share = taken / max(1, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(text, pa.string()), pa.array(error), pa.array(np.full(b.num_rows, share))], names=["id", "label", "code", "error", "measured"])
    return run


def compress(vectors: DataFrame, scratch: Scratch, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): (id, label, code, error, measured) for every kept vector, and codebooks by (part, entry, place).

    label is a struct of the label, so that null ones are equal. measured is the number of exact distances taken for a vector,
    as a mean of its batch; without bounds it would be parts times entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    kind = vectors.schema[label_col].dataType.simpleString()
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.struct(F.col(label_col).alias("label")).alias("label"), F.col(vector_col).alias("x")).filter(
        finite(F.col("x")) & (F.size("x") > 0) & (F.size("x") % parts == 0))
    rows = scratch.keep(kept.select("id", "label", scaled(F.col("x"), scale).alias("v"), F.size("x").alias("size")))
    order = [F.col("id").asc_nulls_last(), "v"]
    length = rows.orderBy(*order).select("size").first()
    if length is None:
        return rows.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0.0).alias("measured")), np.zeros((parts, 0, 0), np.int64)
    rows = rows.filter(F.col("size") == length.size)
    # at most as many rows as there are entries come to the driver
    first = np.array([r.v for r in rows.orderBy(*order).select("v").limit(entries).collect()], dtype=np.int64)
    books = first.reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        means = floor_means(rows.select("v").mapInArrow(_sums(books), "part int, entry int, n long, total array<long>"), ["part", "entry"], books.shape[2])
        for (p, k), x in means.items():
            books[p, k] = x
    return scratch.keep(rows.select("id", "label", "v").mapInArrow(_encode(books), f"id long, label struct<label: {kind}>, code string, error long, measured double")), books


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "codes")
    rows, books = compress(read(spark, sf_dir, "embeddings"), scratch)
    sums = scratch.keep(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    sha = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return join_spread(rows, sums, ["label"], "n").select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The rounds one after another, every distance measured."""
    steps = [f"""e AS MATERIALIZED (SELECT vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v, len(embedding) // {parts} AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))]) = len(embedding))""",
             "v AS MATERIALIZED (SELECT vec_id, (i - 1) // width AS p, (i - 1) % width AS o, x FROM (SELECT vec_id, width, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM e))",
             f"c0 AS MATERIALIZED (SELECT p, k, o, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM e QUALIFY k < {entries}) USING (vec_id))"]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT vec_id, p, k, d FROM (SELECT vec_id, v.p, k, CAST(sum((v.x - c{t}.x) * (v.x - c{t}.x)) AS BIGINT) AS d FROM v JOIN c{t} ON v.p = c{t}.p AND v.o = c{t}.o GROUP BY vec_id, v.p, k)
  QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) = 1)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT p, k, o, coalesce((s - (((s % n) + n) % n)) // n, c{t}.x) AS x FROM c{t} LEFT JOIN
  (SELECT p, k, o, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{t} JOIN v USING (vec_id, p) GROUP BY p, k, o) USING (p, k, o))""")
    return "WITH " + ",\n".join(steps) + f""",
r AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, o)) FROM c{rounds}) AS codebooks_sha256
FROM r JOIN e USING (vec_id)"""


QUERIES, SQL = {"op11_codes": op11_codes}, {"op11_codes": sql()}
