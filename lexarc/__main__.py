"""spark-submit entry: words and page texts (Parquet folders, or PDF files) to artifacts."""

from __future__ import annotations

import argparse
import json
import re
import uuid

from pyspark.sql import SparkSession

from .config import EngineConfig
from .operators import completeness, reports, search, segment
from .plans.pipeline import Transcripts
from .sources import pdf
from .sources.artifacts import publish, snapshot


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexarc")
    p.add_argument("--words", help="Parquet folder of word boxes")
    p.add_argument("--texts", help="Parquet folder of page texts")
    p.add_argument("--pdf", help="PDF file or folder, where a decoder is installed")
    p.add_argument("--answers", help="JSON lines that answer the decision requests of an earlier run")
    p.add_argument("--output-dir", required=True)
    p.add_argument("--run-name")
    a = p.parse_args(args)
    if a.run_name and not re.fullmatch(r"\w[\w.-]*", a.run_name):
        p.error("a run's name has letters, digits, dots, dashes and underscores only")
    spark = SparkSession.builder.appName("lexarc").getOrCreate()
    words, texts = pdf.tables(spark, a.pdf) if a.pdf else (spark.read.parquet(a.words), spark.read.parquet(a.texts))
    t = Transcripts(words, texts, EngineConfig.from_env())
    requests = t.keep(segment.decision_requests(t.kept_chunks, t.config), "decision_requests")
    answers = spark.read.schema(segment.ANSWERS).json(a.answers) if a.answers else spark.createDataFrame([], segment.ANSWERS)
    if a.answers:
        t.decisions = t.keep(segment.decisions_of(requests, answers), "decisions")
    out = a.output_dir.rstrip("/")
    # all artifacts are written beside the earlier ones, and take their place together
    new, index = f"{out}/.new-{uuid.uuid4().hex}", f"topic_index/run_name={a.run_name or 'latest'}"
    totals = reports.Totals()
    totals.of(t.lines, "canonical_transcript").write.parquet(f"{new}/canonical_transcript")
    totals.of(t.chunks.select("transcript_id", "chunk_id", "source_range", "source_ids", "text"), "chunks").write.parquet(f"{new}/chunks")
    totals.of(t.index.select("transcript_id", *reports.PUBLIC), "topic_index").write.parquet(f"{new}/{index}")
    reports.markdown_rows(t.index).write.parquet(f"{new}/topic_index_markdown")
    search.postings(t.index).write.partitionBy("bucket").parquet(f"{new}/topic_postings")
    completeness.report(t.pages, t.rows, t.lines, t.chunks).write.json(f"{new}/completeness_report")
    summary = reports.run_summary(t.index, t.lines, t.chunks, t.pages)
    reports.full_summary(summary, t.index, a.pdf or a.words, t.config.decision_provider).write.json(f"{new}/run_summary")
    spark.createDataFrame([totals.row()], ", ".join(f"{k} long" for k in totals.row())).write.json(f"{new}/run_totals")
    requests.write.json(f"{new}/decision_requests")
    segment.exchange_status(requests, answers).write.json(f"{new}/decision_status")
    names = ["canonical_transcript", "chunks", index, "topic_index_markdown", "topic_postings", "completeness_report", "run_summary", "run_totals", "decision_requests", "decision_status"]
    publish(spark, new, out, names)
    if a.run_name:
        snapshot(spark, out, a.run_name)
    for r in summary.orderBy("transcript_id").limit(20).collect():
        print(json.dumps(r.asDict(), ensure_ascii=False, sort_keys=True))


if __name__ == "__main__":
    main()
