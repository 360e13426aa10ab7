"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

Each whole text gives a fixed vector of statistics. Standardised, they pass through cosines of random projections, which
approximate a Gaussian kernel. Every partition of labelled rows sums its share of the normal equations; the sums have a
fixed size and give the ridge weights. A separate fold of the labelled rows is counted in a fixed grid of raw scores,
over which an isotonic fit turns a raw score into a probability.

A null text counts as empty. Rows with a null label or id do not train; a document with several labels counts with
their mean. Without labels (or with one class only) every score is the mean label, or 0.5. Every document row gives
one row. All labelled rows train; no sample is taken. Of columns other than the id, the text and the label none is read,
whatever their names; `keep_above` passes them through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bitmap, crc_mod, position, read, release
from .textstats import points, tables

FEATURES = 256
RIDGE = 1.0
GRID = 400
SEED = 20_240_101
THRESHOLD = 0.3
SLICE = 512
STATS = 20


def statistics(text: str) -> np.ndarray:
    """Fixed-size description of a text: sizes, character classes, word and line repetition."""
    c, t = points(text), tables()
    n = max(1, len(c))
    words = text.split()
    nw = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    nl = max(1, len(lines))
    letters, upper, digits, spaces, symbols = (int(t[k][c].sum()) for k in ("letter", "upper", "digit", "space", "symbol"))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    top = max(counts.values(), default=0)
    low = np.minimum(c, 255)
    hist = np.bincount(low, minlength=256) / n
    seen = hist[hist > 0]
    h = low[1:].astype(np.int64) * 256 + low[:-1]
    after_letter = t["letter"][c[:-1]] & t["symbol"][c[1:]] if n > 1 else np.zeros(1, bool)
    odd = hist[[35, 36, 37, 38, 42, 64, 94, 126]].sum()
    return np.array([
        np.log1p(n), np.log1p(len(words)), letters / n, upper / max(1, letters), digits / n, spaces / n, symbols / n,
        odd, hist[33], hist[124], hist[44] + hist[46], len(counts) / nw, top / nw, len(set(lines)) / nl, np.log1p(nl) - np.log1p(nw),
        letters / nw, float(-(seen * np.log(seen)).sum()), after_letter.mean() if n > 1 else 0.0,
        float((c[1:] == c[:-1]).mean()) if n > 1 else 0.0, len(np.unique(h)) / n ** 0.6 if n > 1 else 0.0])


def describe(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, stats array<double>)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                m = np.array([statistics(x or "") for x in b.column(1).to_pylist()]).reshape(-1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(m) + 1, STATS, dtype=np.int32)), pa.array(m))], names=[id_col, "stats"])

    return df.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, stats array<double>")


class Kernel:
    """Standardisation and the random projections."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.w = rng.normal(size=(STATS, FEATURES)) / np.sqrt(STATS / 2)
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(z), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, STATS)


def _sum_vectors(df: DataFrame) -> DataFrame:
    """Sums (k, v array<double>) by k in two steps, the first over at most 64 groups a key."""

    def add(key, table):
        rows = table.column("v").combine_chunks()
        total = np.asarray(rows.flatten()).reshape(len(rows), -1).sum(axis=0)
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total.tolist()], pa.list_(pa.float64()))})

    first = df.withColumn("s", F.col("part") % 64).groupBy("k", "s").applyInArrow(add, "k int, v array<double>")
    return first.groupBy("k").applyInArrow(add, "k int, v array<double>")


def _partials(rows: DataFrame, fold) -> DataFrame:
    """Runs fold(stats, y) over each partition; it returns the vectors to be summed, by number."""

    def run(batches):
        from pyspark import TaskContext

        total = None
        for b in batches:
            if b.num_rows:
                got = fold(_matrix(b.column(0)), np.asarray(b.column(1)))
                total = got if total is None else [a + x for a, x in zip(total, got, strict=True)]
        if total is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), pa.array([x.tolist() for x in total], pa.list_(pa.float64()))], names=["part", "k", "v"])

    return _sum_vectors(rows.select("stats", "y").mapInArrow(run, "part int, k int, v array<double>"))


def _collect(df: DataFrame, n: int) -> list[np.ndarray] | None:
    got = {r.k: np.array(r.v) for r in df.collect()}
    return [got[i] for i in range(n)] if got else None


def pool_adjacent(y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Isotonic fit of sums y over counts n, in order."""
    blocks: list[list[float]] = []
    for a, b in zip(y, n, strict=True):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a2, b2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a2, blocks[-1][1] + b2, blocks[-1][2] + k2]
    return np.concatenate([[a / b] * int(k) for a, b, k in blocks]) if blocks else np.zeros(0)


class Classifier:
    def __init__(self, kernel: Kernel | None, weights: np.ndarray | None, xs: np.ndarray, ys: np.ndarray, default: float):
        self.kernel, self.weights, self.xs, self.ys, self.default = kernel, weights, xs, ys, default

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(stats), self.default)
        raw = self.kernel(stats) @ self.weights
        level = np.interp(raw, self.xs, self.ys) if len(self.xs) else np.clip(raw, 0, 1)
        # within a level of the isotonic fit the raw score still orders the documents
        return np.clip(0.98 * level + 0.02 * np.clip(raw, 0, 1), 0, 1)


def fit(rows: DataFrame) -> Classifier:
    """rows(stats, y, calibrate boolean): fits on the rows without `calibrate`, calibrates on the others."""
    train, held = rows.filter("not calibrate"), rows.filter("calibrate")
    sums = _collect(_partials(train, lambda x, y: [np.array([len(x), y.sum()]), x.sum(axis=0), (x * x).sum(axis=0)]), 3)
    if sums is None or not 0 < sums[0][1] < sums[0][0]:
        return Classifier(None, None, np.zeros(0), np.zeros(0), 0.5 if sums is None else float(sums[0][1] / sums[0][0]))
    n = sums[0][0]
    mean = sums[1] / n
    kernel = Kernel(mean, np.sqrt(np.maximum(sums[2] / n - mean ** 2, 1e-8)))

    def normal(x, y):
        z = kernel(x)
        return [*(z.T @ z), z.T @ y]

    got = _collect(_partials(train, normal), FEATURES + 2)
    weights = np.linalg.solve(np.array(got[:-1]) + RIDGE * np.eye(FEATURES + 1), got[-1])

    def histogram(x, y):
        at = np.clip(((kernel(x) @ weights + 0.5) / 2 * GRID).astype(int), 0, GRID - 1)
        return [np.bincount(at, weights=y, minlength=GRID), np.bincount(at, minlength=GRID).astype(float)]

    hist = _collect(_partials(held, histogram), 2)
    if hist is None:
        return Classifier(kernel, weights, np.zeros(0), np.zeros(0), 0.5)
    used = np.flatnonzero(hist[1])
    # half a row of either class at the ends keeps the levels inside (0, 1)
    y = np.concatenate([[0.0], hist[0][used], [1.0]])
    k = np.concatenate([[1.0], hist[1][used], [1.0]])
    xs = (np.concatenate([[used[0] - 1], used, [used[-1] + 1]]) + 0.5) / GRID * 2 - 0.5
    return Classifier(kernel, weights, xs, pool_adjacent(y, k), 0.5)


def classify(stats: DataFrame, classifier: Classifier, id_col: str = "doc_id") -> DataFrame:
    """(id_col, score) for (id_col, stats)."""
    kind = stats.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(classifier.score(_matrix(b.column(1))))], names=[id_col, "score"])

    return stats.select(id_col, "stats").mapInArrow(run, f"`{id_col}` {kind}, score double")


def _labelled(stats: DataFrame, labels: DataFrame, folds: int) -> DataFrame:
    """(stats, y, calibrate) of the documents with a label outside fold 0."""
    y = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    return stats.filter(crc_mod("doc_id", folds) != 0).join(y, "doc_id").select("stats", "y", (crc_mod("doc_id", folds) == 1).alias("calibrate"))


def score_documents(docs: DataFrame, labels: DataFrame, scratch: Scratch, folds: int = 5) -> DataFrame:
    """(doc_id, score) for each row of docs, learned from labels(doc_id, quality) outside fold 0."""
    stats = scratch.keep(describe(docs.select("doc_id", "text")))
    return classify(stats, fit(scratch.keep(_labelled(stats, labels, folds))))


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, folds: int = 5) -> Classifier:
    """The classifier alone. A bitmap of the labelled ids spares the other documents the statistics."""
    bits, marks = bitmap(labels.filter("doc_id is not null and quality is not null"), "doc_id")
    marked = docs.sparkSession.sparkContext.broadcast(marks)  # of bounded size
    kind = docs.schema["doc_id"].dataType.simpleString()

    def labelled(batches):
        m = np.unpackbits(marked.value, bitorder="little")
        for b in batches:
            b = b.take(pa.array(np.flatnonzero(m[np.asarray(b.column(2))])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["doc_id", "text"])
        release()

    some = docs.filter("doc_id is not null").select("doc_id", "text", position("doc_id", bits).alias("h")).mapInArrow(labelled, f"doc_id {kind}, text string")
    return fit(scratch.keep(_labelled(describe(some), labels, folds)))


def keep_above(docs: DataFrame, classifier: Classifier, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose text scores at least the threshold, with all their columns."""
    place = docs.columns.index(text_col)

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                score = classifier.score(np.array([statistics(x or "") for x in b.column(place).to_pylist()]))
                yield b.take(pa.array(np.flatnonzero(score >= threshold)))
        release()

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), Scratch(spark, "quality"))
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES, SQL = {"op8_quality": op8_quality}, {}
