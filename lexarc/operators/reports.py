"""Sinks and comparisons of runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .speakers import testimony_range

PUBLIC = ["topic_id", "topic", "start_page", "start_line", "end_page", "end_line", "supporting_source_reference", "supporting_evidence", "source_ids", "related_topic_ids", "recurrence_of", "is_procedural", "transition_type", "confidence"]
CHRONOLOGICAL = ["start_page", "start_line", "end_page", "end_line", "topic_no"]
# The topics that the sampled evaluation looks at, by place.
SAMPLED = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 19, 20, 22, 24, 26, 27, 28]


def json_rows(topics: DataFrame) -> DataFrame:
    """(transcript_id, n, entry): index entries as JSON with sorted keys."""
    w = W.partitionBy("transcript_id").orderBy(*CHRONOLOGICAL)
    return topics.select("transcript_id", F.row_number().over(w).alias("n"), F.to_json(F.struct(*sorted(PUBLIC)), {"ignoreNullFields": "false"}).alias("entry"))


def json_document(topics: DataFrame, transcript_id: int) -> str:
    """One transcript's index as indented JSON with sorted keys, for a reader rather than a later stage."""
    rows = topics.filter(F.col("transcript_id") == transcript_id).orderBy(*CHRONOLOGICAL).select(*PUBLIC).collect()
    return json.dumps([r.asDict() for r in rows], ensure_ascii=False, indent=2, sort_keys=True)


def markdown_rows(topics: DataFrame) -> DataFrame:
    """(transcript_id, n, row): lines of the topic table."""
    w = W.partitionBy("transcript_id").orderBy(*CHRONOLOGICAL)
    ev = "replace(replace(supporting_evidence, '|', '/'), '\\n', ' ')"
    return topics.select("transcript_id", F.row_number().over(w).alias("n"), F.expr(
        f"concat('| ', replace(topic, '|', '/'), ' | P', start_page, ':L', start_line, ' | P', end_page, ':L', end_line, ' | ', case when length({ev}) > 220 then concat(substring({ev}, 1, 217), '...') else {ev} end, ' |')").alias("row"))


def run_summary(topics: DataFrame, lines: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    x = pages.groupBy("transcript_id").agg(F.count("*").alias("total_pdf_pages"))
    for other in (lines.groupBy("transcript_id").agg(F.count("*").alias("extracted_lines"), F.count_if("is_testimony").alias("testimony_lines")), testimony_range(lines), chunks.groupBy("transcript_id").agg(F.count("*").alias("chunks")),
                  topics.groupBy("transcript_id").agg(F.count("*").alias("topic_count"))):
        x = x.join(other, "transcript_id", "left")
    return x.fillna(0, ["extracted_lines", "testimony_lines", "chunks", "topic_count"])


def full_summary(summary: DataFrame, topics: DataFrame, source: str, provider: str) -> DataFrame:
    """The summary as a run leaves it: with its time, source, decision provider and index entries."""
    entry = F.struct(*CHRONOLOGICAL, F.struct(*PUBLIC).alias("entry"))
    entries = topics.groupBy("transcript_id").agg(F.array_sort(F.collect_list(entry)).alias("x")).select("transcript_id", F.col("x.entry").alias("topics"))
    return summary.join(entries, "transcript_id", "left").withColumns({"ran_at": F.current_timestamp(), "source": F.lit(source), "decision_provider": F.lit(provider or "none")})


class Totals:
    """Counts of a whole run, observed while its artifacts are written, so that no table is read again for them.

    `of` returns the frame to write; its counts are there once it has been written. Only single numbers reach the driver.
    """

    COUNTS = {
        "canonical_transcript": {"extracted_lines": "count(*)", "testimony_lines": "count_if(is_testimony)"},
        "chunks": {"chunks": "count(*)"},
        "topic_index": {"topic_count": "count(*)", "procedural_topics": "count_if(is_procedural)"},
    }

    def __init__(self):
        self.seen: dict[str, Observation] = {}

    def of(self, df: DataFrame, artifact: str) -> DataFrame:
        self.seen[artifact] = Observation(artifact)
        return df.observe(self.seen[artifact], *(F.expr(c).alias(n) for n, c in self.COUNTS[artifact].items()))

    def row(self) -> dict[str, int]:
        return {k: v for o in self.seen.values() for k, v in o.get.items()}


def fingerprint(topics: DataFrame) -> DataFrame:
    """(transcript_id, n_topics, sha256) over all public fields of each transcript's index rows as JSON, in order."""
    row = F.to_json(F.struct(*sorted(PUBLIC)), {"ignoreNullFields": "false"})
    rows = F.array_sort(F.collect_list(F.struct("topic_no", row.alias("r"))))
    return topics.groupBy("transcript_id").agg(F.count("*").alias("n_topics"), F.sha2(F.array_join(F.transform(rows, lambda x: x["r"]), "\n").cast("binary"), 256).alias("sha256"))


#: Rows in a leaf of a run's hash tree, and transcripts on a shelf of it.
LEAF, SHELF = 256, 1000
LEVELS = {"root": [], "shelf": ["shelf"], "transcript": ["shelf", "transcript_id"], "leaf": ["shelf", "transcript_id", "leaf"]}

LEVELS_ABOVE = {"root": [], "shelf": [], "transcript": ["shelf"], "leaf": ["shelf", "transcript_id"]}


def hashed_rows(artifact: DataFrame, order: str | None) -> DataFrame:
    """(shelf, transcript_id, leaf, place, sha256) of each row, as JSON with sorted keys; order is its number within the transcript."""
    place = F.col(order) if order else F.lit(1)
    row = F.to_json(F.struct(*sorted(artifact.columns)), {"ignoreNullFields": "false"})
    return artifact.select(F.expr(f"transcript_id div {SHELF}").alias("shelf"), F.col("transcript_id").cast("long").alias("transcript_id"), place.cast("int").alias("place"), F.sha2(row.cast("binary"), 256).alias("sha256")).withColumn(
        "leaf", F.expr(f"cast((place - 1) div {LEAF} as int)"))


def hash_tree(artifact: DataFrame, order: str | None) -> DataFrame:
    """(level, shelf, transcript_id, leaf, sha256): a hash for each leaf of rows, each transcript, each shelf of transcripts, and the whole.

    A node's hash is that of its children's in order, so that two runs differ below a node if and only if its hashes differ. A
    node has as many children as a leaf has rows, or as a transcript has leaves.
    """
    below, order_by, out = hashed_rows(artifact, order), "place", []
    for level in reversed(LEVELS):
        keys = LEVELS[level]
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_by, "sha256"))), lambda x: x["sha256"]), "")
        below = below.groupBy(*keys).agg(F.sha2(joined.cast("binary"), 256).alias("sha256"))
        if keys:
            order_by = keys[-1]
        out.append(below.select(F.lit(level).alias("level"), *[F.col(c).cast("long").alias(c) if c in keys else F.lit(None).cast("long").alias(c) for c in LEVELS["leaf"]], "sha256"))
    leaf, transcript, shelf, root = out
    return root.unionByName(shelf).unionByName(transcript).unionByName(leaf)


def changed_leaves(one: DataFrame, other: DataFrame) -> DataFrame:
    """(shelf, transcript_id, leaf) that differ between two hash trees; a level is looked at below nodes that differ only."""
    found = None
    for level, keys in LEVELS.items():
        a, b = (x.filter(F.col("level") == level).select(*keys, F.col("sha256").alias(name)) for x, name in ((one, "h1"), (other, "h2")))
        if found is not None and LEVELS_ABOVE[level]:
            a, b = (x.join(found, LEVELS_ABOVE[level], "left_semi") for x in (a, b))
        if not keys:
            a, b = a.withColumn("k", F.lit(0)), b.withColumn("k", F.lit(0))
        found = a.join(b, keys or ["k"], "full").filter("h1 is null or h2 is null or h1 <> h2").select(*keys)
        if not keys and found.isEmpty():  # one row
            return one.limit(0).select(*LEVELS["leaf"])
    return found


def changed_rows(one: DataFrame, other: DataFrame, order: str | None, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(transcript_id, place, side) of an artifact's rows that differ between two runs: changed, first (only there) or second.

    Rows are hashed only in leaves that differ. trees are the stored trees of both, where there are any.
    """
    left, right = trees or (hash_tree(one, order), hash_tree(other, order))
    leaves = changed_leaves(left, right)
    keys = ["transcript_id", "leaf", "place"]
    a, b = (hashed_rows(x, order).join(leaves, ["shelf", "transcript_id", "leaf"], "left_semi").select(*keys, F.col("sha256").alias(name)) for x, name in ((one, "h1"), (other, "h2")))
    side = F.expr("case when h2 is null then 'first' when h1 is null then 'second' else 'changed' end")
    return a.join(b, keys, "full").filter("h1 is null or h2 is null or h1 <> h2").select("transcript_id", "place", side.alias("side"))


def diff(one: DataFrame, other: DataFrame) -> DataFrame:
    """Index rows that only one of two runs has, compared by all public fields, with their side."""
    cols = ["transcript_id", "topic_id", "topic", "start_page", "start_line", "end_page", "end_line"]
    a, b = one.select("transcript_id", *PUBLIC), other.select("transcript_id", *PUBLIC)
    return a.exceptAll(b).select(*cols, F.lit("first").alias("side")).unionByName(b.exceptAll(a).select(*cols, F.lit("second").alias("side")))


def location_accuracy(topics: DataFrame, lines: DataFrame) -> DataFrame:
    """(transcript_id, reviewed, passed, location_accuracy_pct) over the sampled places."""
    w = W.partitionBy("transcript_id").orderBy(*CHRONOLOGICAL)
    here = lines.select("transcript_id", "page", "line").distinct()
    x = topics.withColumn("at", F.row_number().over(w) - 1).filter(F.col("at").isin(SAMPLED))
    x = x.join(here.toDF("transcript_id", "start_page", "start_line").withColumn("s", F.lit(1)), ["transcript_id", "start_page", "start_line"], "left").join(here.toDF("transcript_id", "end_page", "end_line").withColumn("e", F.lit(1)), ["transcript_id", "end_page", "end_line"], "left")
    ok = F.expr("coalesce(s = 1 and e = 1 and start_page * 1000 + start_line <= end_page * 1000 + end_line, false)")
    return x.groupBy("transcript_id").agg(F.count("*").alias("reviewed"), F.count_if(ok).alias("passed")).withColumn("location_accuracy_pct", F.round(100.0 * F.col("passed") / F.col("reviewed"), 1))
