"""PDF files to word boxes and page texts, where a decoder is installed."""

from __future__ import annotations

import importlib.util
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .artifacts import keep
from .pages import PAGES, PLACE, PageSource, located, page_rows


def decoder_available() -> bool:
    return importlib.util.find_spec("pymupdf") is not None


def openable(path: str) -> bool:
    """Whether Python itself can open a path: a file or folder without wildcards in a store that pyarrow knows."""
    if re.search(r"[*?\[{]", path):
        return False
    try:
        located(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def pages(spark: SparkSession, path: str, words: bool = True) -> DataFrame:
    """(path, pdf_page_index, raw_text, skipped, words), a row a page; skipped pages have no words.

    Files are decoded in parallel, large ones in several tasks. Filters reach the files, but where only Spark's own reader
    can open a path: then a task takes whole files and Spark filters their pages.
    """
    if not decoder_available():
        raise ImportError("reading PDF files needs the pymupdf package on driver and executors")
    if openable(path):
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(PageSource)
        return spark.read.format(PageSource.name()).option("path", path).option("words", str(words)).load()

    def decode(batches):
        for b in batches:
            for full, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield from page_rows(full, data, words=words)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, PAGES)


def _keyed(decoded: DataFrame) -> DataFrame:
    return decoded.withColumn("transcript_id", F.abs(F.xxhash64("path")))


def word_boxes(decoded: DataFrame) -> DataFrame:
    return _keyed(decoded).select("transcript_id", "pdf_page_index", F.explode("words").alias("w")).select("transcript_id", "pdf_page_index", "w.word_no", *(f"w.{c}" for c in PLACE), "w.text")


def page_texts(decoded: DataFrame) -> DataFrame:
    return _keyed(decoded).select("transcript_id", "pdf_page_index", "raw_text")


def tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(word boxes, page texts) of PDF files, which are decoded once and kept."""
    decoded = keep(pages(spark, path), name="pdf_pages")
    return word_boxes(decoded), page_texts(decoded)
