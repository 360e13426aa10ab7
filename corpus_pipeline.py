"""Corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, tokens.

Each stage takes the documents that its predecessor kept and returns documents with the same columns; the last returns
their tokens. Rows without a doc_id are judged by their text. Stages whose result comes out of Python return it as a written
table, since only what `Scratch.keep` writes passes through Python in small batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarc.llm.common import Scratch, read
from lexarc.llm.op2_secrets import redact
from lexarc.llm.op3_bpe import encode_decode
from lexarc.llm.op7_jaccard import jaccard_join
from lexarc.llm.op8_quality import THRESHOLD, keep_above, learn
from lexarc.llm.op10_decontaminate import flagged

#: The rule for near-duplicate stages on word shingles: five words, a similarity of 0.8.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at its threshold or above."""
    scratch = Scratch(spark, "pipeline-quality")
    return scratch.keep(keep_above(docs, learn(docs, read(spark, sf_dir, "labels"), scratch), THRESHOLD))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; of repeated rows one.

    A row without an id goes by a hash of its text, above all usual ids.
    """
    scratch = Scratch(spark, "pipeline-jaccard")
    key = "key_" + "_".join(docs.columns)  # a name that no column has
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.expr(f"shiftrightunsigned(xxhash64(text), 2) + {1 << 62}")))
    groups = scratch.keep(jaccard_join(keyed, scratch, SHINGLE_WORDS, SIMILAR_PERCENT, id_col=key))
    ids = scratch.keep(groups.filter("id = component_id").groupBy(F.col("id").alias(key)).agg(F.count("*").alias("rows")))
    held = keyed.join(ids.filter("rows = 1").select(key).hint("shuffle_hash"), key, "left_semi")
    again = ids.filter("rows > 1").select(key)
    if not again.isEmpty():
        held = held.unionByName(keyed.join(again, key, "left_semi").dropDuplicates([key, "text"]))
    return held.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without an id are judged by their text."""
    return flagged(docs, read(spark, sf_dir, "benchmark"), Scratch(spark, "pipeline-leaks")).filter("n_items = 0").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind; n_chars follows."""
    safe = redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
    return Scratch(spark, "pipeline-secrets").keep(safe)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of each document."""
    import public_tokenizers as P

    got = encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
    return Scratch(spark, "pipeline-bpe").keep(got)


STAGES = [("quality", quality), ("jaccard", near_duplicates), ("decontaminate", decontaminate), ("secrets", secrets), ("bpe", tokens)]

#: SQL expresses none of the learned stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = made if hasattr(made, "_lexarc_path") else scratch.keep(made)
    return STAGES[-1][1](spark, docs, sf_dir)
