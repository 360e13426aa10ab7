"""Embedding near-duplicates by navigable small-world graphs per shard.

Vectors are compared within their label. Equal vectors of a label form one class first. Each label's classes are dealt
to shards of bounded size by a hash of their id, and each shard builds a hierarchical navigable small-world graph. Every
class queries every shard of its label, in blocks of bounded size. A query whose whole beam is similar enough has not
reached the edge of its neighbourhood and goes again with a beam twice as wide, or, where most beams are full, by a product with
the shard. Then every block is audited: a fixed number of
its queries go against all vectors of the shard, and if one of them lacks more than 1 - AUDIT_RECALL of its own true links, the
whole block goes again with wider beams. A query whose beam would be wider than WIDEST is multiplied with all vectors of the
shard. Candidates count when their cosine in double precision reaches the threshold.

Links are counted, not listed: a query's own search of each shard says how many vectors it links with there, and of the
links of a block and a shard only a spanning forest goes on to the components. So what a block passes on is bounded by its
queries and the shard, however dense a cluster is. `recall` is the least share of its true links that an audited query of
the label found at last.

Vectors that are null, empty, zero, or hold null or non-finite values, and those without a label or id, link with nothing.
Vectors of different length don't compare. Every row gives one row; equal rows link with each other, and rows that repeat
an id are vectors of their own, which count and link as if their ids differed. Columns other than the three are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_spread, read
from .components import connected_components
from .hnsw import BATCH, Graph

THRESHOLD = 0.93
SHARD, BLOCK = 8_192, 4_096
BEAM, WIDEST, AUDITS, AUDIT_RECALL = 32, 512, 64, 0.999
#: Slack of single precision below the threshold, before the check in double precision.
SLACK = 1e-4
#: Queries whose pairs are held at once.
SLICE = 256


def _unit(table: pa.Table, name: str = "v") -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a table in double precision, and as unit vectors in single precision."""
    flat = np.asarray(table.column(name).combine_chunks().flatten(), dtype=np.float64)
    x = flat.reshape(table.num_rows, -1)
    return x, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def range_search(graph: Graph, unit: np.ndarray, threshold: float) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray, float]:
    """(hits, exact, recall): by query its (nodes, similarities) of at least threshold - SLACK, where beams, widened as the module
    describes, have found them all; the queries that need a product with the whole shard; and the least audited recall."""
    n, floor = len(graph.x), threshold - SLACK
    found = lambda a, t: 1.0 if exact[a] or not len(t) else len(np.intersect1d(hits[int(a)][0], t)) / len(t)
    audit = np.arange(0, len(unit), max(1, len(unit) // AUDITS))[:AUDITS]
    truth = [np.flatnonzero(t) for t in unit[audit] @ graph.x.T >= threshold - SLACK / 2]
    todo, width, exact = np.arange(len(unit)), np.full(len(unit), min(BEAM, n)), np.zeros(len(unit), bool)
    hits: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    while len(todo):
        again = [todo[:0]]
        for ef in np.unique(width[todo]):
            same = todo[width[todo] == ef]
            if ef >= n:
                exact[same] = True
                continue
            full = []
            for at in range(0, len(same), BATCH):
                rows = same[at:at + BATCH]
                ids, sim = graph.search(unit[rows], int(ef))
                for i, r in enumerate(rows):
                    near = sim[i] >= floor
                    hits[int(r)] = ids[i][near], sim[i][near]
                full.append(rows[sim[:, -1] >= floor])
            full = np.concatenate(full)
            # where most beams are full the shard is dense, and one product costs less than ever wider beams
            if 2 * len(full) > len(same):
                exact[full] = True
            else:
                again.append(full)
        todo = np.concatenate(again)
        recall = 1.0 if len(todo) else min(found(a, t) for a, t in zip(audit, truth, strict=True))
        if recall < AUDIT_RECALL:
            todo = np.flatnonzero(~exact)
        width[todo] = np.where(2 * width[todo] > WIDEST, n, np.minimum(n, 2 * width[todo]))
    return hits, exact, recall


def found_pairs(graph: Graph, unit: np.ndarray, threshold: float, hits: dict, exact: np.ndarray):
    """(query, node, similarity) arrays of a few queries at a time; products with the whole shard are taken slice by slice."""
    for at in range(0, len(unit), SLICE):
        rows = np.arange(at, min(len(unit), at + SLICE))
        whole, walked = rows[exact[rows]], rows[~exact[rows]]
        sim = unit[whole] @ graph.x.T
        i, j = np.nonzero(sim >= threshold - SLACK)
        yield (np.concatenate([whole[i], *(np.full(len(hits[int(r)][0]), r) for r in walked)]),
               np.concatenate([j, *(hits[int(r)][0] for r in walked)]), np.concatenate([sim[i, j], *(hits[int(r)][1] for r in walked)]))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, least id reachable) for every id but the least ones, over the links of arrays a and b."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[:len(a)], at[len(a):], np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, root[x], root[y])
        np.minimum.at(low, root[y], root[x])
        while not np.array_equal(low, low[low]):
            low = low[low]
        low = low[root]
        if np.array_equal(low, root):
            break
        root = low
    rest = root != np.arange(len(ids))
    return ids[rest], ids[root[rest]]


def near_duplicates(vectors: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, recall) for every row of vectors."""
    kind = vectors.schema[label_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    whole = F.size("v") > 0
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & whole & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False))).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(17), "v"))
    classes = scratch.keep(rows.filter("ok").groupBy("label", "h1", "h2").agg(F.min_by("v", "id").alias("v"), F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn(
        "dim", F.size("v")).withColumn("class", F.monotonically_increasing_id()))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    dealt = classes.select("class", "rep", "h1", "label", "dim", "v", "copies").join(sizes, ["label", "dim"]).withColumn("shards", F.ceil(F.col("n") / shard).cast("int")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    dealt = scratch.keep(dealt.withColumn("shard", F.pmod(F.xxhash64("h1"), F.col("shards")).cast("int")).withColumn("block", F.pmod(F.xxhash64("h1", F.lit(3)), F.col("blocks")).cast("int")))

    def grow(key, table):
        table = table.sort_by([("rep", "ascending"), ("class", "ascending")])
        order = np.random.default_rng(5).permutation(table.num_rows)
        table = table.take(pa.array(order))
        x, unit = _unit(table)
        return pa.table({"label": pa.array([key[0].as_py()], table.schema.field("label").type), "dim": pa.array([key[1].as_py()], pa.int32()), "shard": pa.array([key[2].as_py()], pa.int32()), "blocks": table.column("blocks").slice(0, 1).combine_chunks(),
                         "ids": pa.array([table.column("class").to_pylist()], pa.list_(pa.int64())), "copies": pa.array([table.column("copies").to_pylist()], pa.list_(pa.int64())), "exact": pa.array([x.tobytes()], pa.binary()), "graph": pa.array([Graph.build(unit).dump()], pa.binary())})

    graphs = scratch.keep(dealt.select("label", "dim", "shard", "blocks", "class", "rep", "v", "copies").groupBy("label", "dim", "shard").applyInArrow(grow, f"label {kind}, dim int, shard int, blocks int, ids array<long>, copies array<long>, exact binary, graph binary"))

    def ask(key, index, queries):
        """Rows (a, others, recall) for queries, and (a, root) for the forest of the links."""
        if not index.num_rows or not queries.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "others": pa.array([], pa.int64()), "recall": pa.array([], pa.float64())})
        x, unit = _unit(queries)
        ids = np.array(index.column("ids")[0].as_py(), dtype=np.int64)
        y = np.frombuffer(index.column("exact")[0].as_py(), dtype=np.float64).reshape(len(ids), -1)
        own, copies = np.asarray(queries.column("class")), np.array(index.column("copies")[0].as_py())
        graph = Graph.load(index.column("graph")[0].as_py())
        hits, exact, recall = range_search(graph, unit, threshold)
        norm_x, norm_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
        others, node, root = np.zeros(len(own), dtype=np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, j, sim in found_pairs(graph, unit, threshold, hits, exact):
            keep = own[i] != ids[j]
            # single precision decides but for what lies within its slack
            close = np.flatnonzero(keep & (sim < threshold + SLACK))
            for k in range(0, len(close), 65536):
                c = close[k:k + 65536]
                keep[c] = np.einsum("nd,nd->n", x[i[c]], y[j[c]]) / (norm_x[i[c]] * norm_y[j[c]]) >= threshold
            i, j = i[keep], j[keep]
            others += np.bincount(i, weights=copies[j], minlength=len(own)).astype(np.int64)
            node, root = forest(np.concatenate([node, own[i]]), np.concatenate([root, ids[j]]))
        return pa.table({"a": np.concatenate([own, node]), "root": pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array(root.astype(np.int64))]),
                         "others": pa.concat_arrays([pa.array(others), pa.nulls(len(node), pa.int64())]), "recall": pa.concat_arrays([pa.array(np.full(len(own), recall)), pa.nulls(len(node), pa.float64())])})

    index = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("label", "dim", "shard", "block", "ids", "copies", "exact", "graph")
    queries = dealt.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", "class", "v")
    keys = ["label", "dim", "shard", "block"]
    told = scratch.keep(index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(ask, "a long, root long, others long, recall double"))
    comps = connected_components(told.filter("root is not null").select("a", F.col("root").alias("b")), scratch)
    degree = told.filter("root is null").groupBy("a").agg(F.sum("others").alias("others"), F.min("recall").alias("recall"))
    scratch.drop(dealt, graphs)
    named = classes.select("label", "h1", "h2", "class", "rep", "copies").join(degree.withColumnRenamed("a", "class"), "class", "left").join(comps.withColumnRenamed("id", "class"), "class", "left")
    named = scratch.keep(named.withColumn("component", F.coalesce("component_id", "class")).drop("component_id"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("n"))
    named = join_spread(named, least, ["component"], "n").select(
        "label", "h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "recall", F.lit(True).alias("ok"))
    return rows.select("id", "label", "h1", "h2", "ok").join(named, ["label", "h1", "h2", "ok"], "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), "recall")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(read(spark, sf_dir, "embeddings"), Scratch(spark, "vectors"))
    return got.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"), "recall")


QUERIES, SQL = {"op5_embeddings": op5_embeddings}, {}
