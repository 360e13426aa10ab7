"""Centroid clustering with Elkan's bounds, in whole numbers.

Every vector caches an upper bound of its distance to its own centroid and a lower bound of its distance to each centroid.
After a round the bounds move by as much as the centroids did. A centroid is not looked at while the upper bound is strictly
below its lower bound, or strictly below half the distance between the two centroids. All roots are rounded away from a wrong
skip, so a centroid that could win or tie is always measured, and what is measured is an exact integer distance: the result is
that of measuring everything. Ties go to the smaller number.

A round is one pass over the kept table of vectors and bounds, which it writes anew, and an aggregate of one sum a cluster and
task. Only centroids pass through the driver.

Vectors that are null, of another length, or hold null or non-finite components are left out; an integer beyond 2^24 in size
raises an error. Rows that repeat an id are vectors of their own. First centroids of equal hash (repeated ids) go by their
components; rows without an id come last as first centroids. With fewer vectors than centroids there are as many centroids as
vectors; an empty table gives no row. Columns other than the two are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read
from .vectors import finite, floor_means, lists, matrix, scaled

WIDTH, SCALE, CENTROIDS, ROUNDS = 64, 1024, 8, 10
#: Relative slack of every root: far above the rounding of double precision, far below what a skip gains.
SLACK = 1e-12
STATE = "id long, v array<int>, cluster int, upper double, lower array<double>, measured long, distance long"


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two integer matrices, row by row."""
    d = a - b
    return np.einsum("nd,nd->n", d, d)


def first_pass(v: np.ndarray, c: np.ndarray) -> tuple:
    """(cluster, upper, lower, measured, distance) with all distances measured."""
    squared = np.stack([apart(v, np.broadcast_to(x, v.shape)) for x in c], axis=1)
    own = squared.argmin(axis=1)
    root = np.sqrt(squared.astype(np.float64))
    best = squared[np.arange(len(v)), own]
    return own, root[np.arange(len(v)), own] * (1 + SLACK), root * (1 - SLACK), np.full(len(v), len(c)), best


def next_pass(v: np.ndarray, c: np.ndarray, moved: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple:
    """The same by bounds: moved has for each centroid an upper bound of its last step."""
    k, n = len(c), np.arange(len(v))
    upper = (upper + moved[own]) * (1 + SLACK)
    lower = np.maximum((lower - moved) * (1 - SLACK), 0)
    between = np.stack([np.sqrt(apart(np.broadcast_to(x, c.shape), c).astype(np.float64)) for x in c]) * (1 - SLACK)
    own, first, measured = own.copy(), own.copy(), np.zeros(len(v), dtype=np.int64)
    best = np.full(len(v), -1, dtype=np.int64)  # exact squared distance to the own centroid, once measured
    for j in range(k):
        may = (j != first) & ~(upper < lower[n, j]) & ~(upper < 0.5 * between[own, j])
        rows = np.flatnonzero(may & (best < 0))
        if len(rows):  # the upper bound is made exact before another centroid is measured
            best[rows] = apart(v[rows], c[own[rows]])
            upper[rows] = np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK)
            lower[rows, own[rows]] = np.sqrt(best[rows].astype(np.float64)) * (1 - SLACK)
            measured[rows] += 1
        rows = np.flatnonzero(may & ~(upper < lower[n, j]) & ~(upper < 0.5 * between[own, j]))
        if not len(rows):
            continue
        d = apart(v[rows], np.broadcast_to(c[j], (len(rows), v.shape[1])))
        root = np.sqrt(d.astype(np.float64))
        measured[rows] += 1
        lower[rows, j] = root * (1 - SLACK)
        wins = (d < best[rows]) | ((d == best[rows]) & (j < own[rows]))
        won = rows[wins]
        own[won], best[won], upper[won] = j, d[wins], root[wins] * (1 + SLACK)
    return own, upper, lower, measured, best


def _step(c: np.ndarray, moved: np.ndarray | None, last: bool):
    """A pass over batches of the state; the last one measures every own distance."""
    def run(batches):
        for b in batches:
            v = matrix(b.column("v"), c.shape[1])
            if moved is None:
                own, upper, lower, measured, best = first_pass(v, c)
                before = np.zeros(len(v), dtype=np.int64)
            else:
                lower = np.asarray(b.column("lower").flatten(), dtype=np.float64).reshape(len(v), -1)
                own, upper, lower, measured, best = next_pass(v, c, moved, np.asarray(b.column("cluster"), dtype=np.int64), np.asarray(b.column("upper")), lower)
                before = np.asarray(b.column("measured"))
            if last:
                rows = np.flatnonzero(best < 0)
                best[rows] = apart(v[rows], c[own[rows]])
                measured[rows] += 1
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("v"), pa.array(own, pa.int32()), pa.array(upper), lists(lower, pa.float64()), pa.array(before + measured), pa.array(best, mask=best < 0)],
                names=["id", "v", "cluster", "upper", "lower", "measured", "distance"])
    return run


def cluster(vectors: DataFrame, scratch: Scratch, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, salt: str = "3:",
            id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(rows, centroids): (id, cluster, distance, measured) for every kept vector, distance squared, and the final centroids.

    measured is the number of distances that were taken for the vector; without bounds it would be k times rounds + 1.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x")).filter(finite(F.col("x")) & (F.size("x") == width))
    state = scratch.keep(rows.select("id", scaled(F.col("x"), scale).alias("v")))
    # at most k rows come to the driver
    first = state.select(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256).alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    c = np.array([r.v for r in first], dtype=np.int64).reshape(-1, width)
    if not len(c):
        return state.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("measured")), []
    moved = None
    for turn in range(rounds + 1):
        after = scratch.keep(state.mapInArrow(_step(c, moved, turn == rounds), STATE))
        scratch.drop(state)
        state = after
        if turn < rounds:
            means = floor_means(state.select("cluster", F.lit(1).alias("n"), F.col("v").alias("total")), ["cluster"], width)
            new = np.array([means.get((j,), c[j].tolist()) for j in range(len(c))], dtype=np.int64)
            moved = np.sqrt(apart(new, c).astype(np.float64)) * (1 + SLACK)
            c = new
    return state.select("id", "cluster", "distance", "measured"), c.tolist()


def op13_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(read(spark, sf_dir, "embeddings"), Scratch(spark, "elkan"))
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = [(j, sums[j], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j in sums]
    # one row a centroid
    named = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return rows.join(named, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def sql(k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> str:
    """The rounds one after another, every distance measured."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, unnest(range(1, {width + 1})) AS i, unnest([CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]) AS x FROM embeddings
  WHERE len(embedding) = {width} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(CAST(x AS DOUBLE))]) = {width})""",
             f"""c0 AS MATERIALIZED (SELECT c, i, x FROM v JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM (SELECT DISTINCT vec_id FROM v) QUALIFY c < {k}) USING (vec_id))"""]
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT vec_id, c, d FROM (SELECT vec_id, c, CAST(sum((v.x - c{t}.x) * (v.x - c{t}.x)) AS BIGINT) AS d FROM v JOIN c{t} USING (i) GROUP BY vec_id, c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if t < rounds:
            steps.append(f"""c{t + 1} AS MATERIALIZED (SELECT c, i, coalesce((s - (((s % n) + n) % n)) // n, c{t}.x) AS x FROM c{t} LEFT JOIN
  (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM a{t} JOIN v USING (vec_id) GROUP BY c, i) USING (c, i))""")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c) USING (c)"""


QUERIES, SQL = {"op13_elkan": op13_elkan}, {"op13_elkan": sql()}
