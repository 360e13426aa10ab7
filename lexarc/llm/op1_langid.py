"""Language identification as multilingual mixture inference.

Training counts letter trigrams (hashed to a fixed number of buckets, with word ends as blanks) for each language
over all labelled rows outside the held-out fold. A document is a mixture: each trigram comes from language l with
probability pi_l. Expectation-maximisation estimates pi from the trigram likelihoods; the set of languages grows one at
a time, by the language with the steepest likelihood gain, as long as the likelihood penalised by half a log of the
trigram count for each further language rises. The prediction is the language with the largest share.

A null text, or one without letters, is `und` with score 0 and no proportions; so is every text if nothing could be
learned. Every row gives one row, repeated ones too. Equal shares go to the language that comes first in order. Texts
are processed whole. Rows without an id are never held out. Columns other than the id, the text and the label are not read,
whatever their names. The model has languages x buckets numbers of four bytes, one vector a language, summed where the counts
are; labels beyond `MODEL_BYTES` (2,048 languages) raise an error, since the model goes to every executor.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, read
from .textstats import points, tables

BUCKETS = 1 << 15
MODEL_BYTES = 1 << 28
EM_ROUNDS = 20
SLICE = 512


def trigrams(text: str) -> np.ndarray:
    """Bucket of each trigram with a letter in its middle; everything but letters is a blank."""
    c = points(text.lower())
    if not len(c):
        return np.zeros(0, dtype=np.int64)
    c = np.where(tables()["letter"][c], c, 32).astype(np.uint32)
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    h = c[:-2] * np.uint32(2654435761) ^ c[1:-1] * np.uint32(2246822519) ^ c[2:] * np.uint32(3266489917)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(2654435761)
    return (h[c[1:-1] != 32] >> np.uint32(17)).astype(np.int64)


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, bucket, n) summed over all rows with a language and a text."""

    def count(batches):
        sums = defaultdict(lambda: np.zeros(BUCKETS, dtype=np.int64))
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    picked = rows.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return picked.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def model(counts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their smoothed trigram probabilities (buckets x languages)."""

    def vector(key, table):  # at most a row a bucket
        p = np.full(BUCKETS, 0.5)
        p[np.asarray(table.column("bucket"))] += np.asarray(table.column("n"))
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "p": pa.array([(p / p.sum()).astype(np.float32).tobytes()], pa.binary())})

    vectors = counts.groupBy("lang").applyInArrow(vector, "lang string, p binary").persist()
    n = vectors.count()
    if 4 * BUCKETS * n > MODEL_BYTES:
        raise ValueError(f"{n} languages; the model holds {MODEL_BYTES // (4 * BUCKETS)}")
    rows = sorted(vectors.toLocalIterator(), key=lambda r: r.lang)
    vectors.unpersist()
    p = np.zeros((BUCKETS, n), dtype=np.float32)
    for i, r in enumerate(rows):
        p[:, i] = np.frombuffer(r.p, dtype=np.float32)
    return [r.lang for r in rows], p


def mixture(u: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Proportions of the languages in a text with trigram buckets u, seen n times each."""
    q, total = p[u].astype(np.float64), n.sum()
    langs = q.shape[1]
    pi = np.zeros(langs)
    best = int(np.argmax(n @ np.log(q)))
    pi[best], chosen, like = 1.0, [best], float(n @ np.log(q[:, best]))
    penalty = 0.5 * np.log(total + 1)
    while len(chosen) < langs:
        gain = (n / (q[:, chosen] @ pi[chosen])) @ q / total
        gain[chosen] = -np.inf
        new = int(np.argmax(gain))
        if gain[new] <= 1:
            break
        trial = [*chosen, new]
        share, qs = np.append(pi[chosen] * 0.8, 0.2), q[:, trial]
        for _ in range(EM_ROUNDS):
            share = share * ((n / (qs @ share)) @ qs) / total
        now = float(n @ np.log(qs @ share))
        if now - like <= penalty:
            break
        chosen, like = trial, now
        pi[:] = 0
        pi[chosen] = share
    return pi


def identify(df: DataFrame, langs: list[str], p: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, proportions array<double> by langs)."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(p)  # languages x buckets numbers, bounded above

    def predict(batches):
        p = shared.value
        for big in batches:
            for at in range(0, big.num_rows, SLICE):
                b = big.slice(at, SLICE)
                lang, score, shares = [], [], []
                for text in b.column(1).to_pylist():
                    g = trigrams(text) if text else ()
                    if not len(g) or not langs:
                        lang.append("und"), score.append(0.0), shares.append(None)
                        continue
                    n = np.bincount(g, minlength=BUCKETS)
                    u = np.flatnonzero(n)
                    pi = mixture(u, n[u].astype(np.float64), p)
                    k = int(np.argmax(pi))
                    lang.append(langs[k]), score.append(float(min(1.0, pi[k]))), shares.append(pi.tolist())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.list_(pa.float64()))],
                                                 names=[id_col, "lang_pred", "score", "proportions"])

    return df.select(id_col, F.col(text_col).alias("text")).mapInArrow(predict, f"`{id_col}` {kind}, lang_pred string, score double, proportions array<double>")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    langs, p = model(learn(docs.filter(crc_mod("doc_id", 4) != 2)))
    return identify(docs, langs, p).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "proportions")


QUERIES, SQL = {"op1_langid": op1_langid}, {}
