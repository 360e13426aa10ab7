"""What a transcript has and lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .layout import KEY, duplicate_lines, missing_lines, warnings
from .roles import pages_without_footer
from .speakers import testimony_range, transcript_warnings


def page_role_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("transcript_id", "page_role").agg(F.count("*").alias("n_pages"))


def testimony_pages(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(transcript_id, page): pages of the testimony range that exist; without a range, transcript pages."""
    p = pages.filter("transcript_page is not null").join(testimony_range(lines), "transcript_id", "left")
    return p.filter("case when testimony_start is not null and testimony_end is not null then transcript_page between testimony_start and testimony_end else page_role = 'transcript' and transcript_page <> 0 end").select(
        "transcript_id", F.col("transcript_page").alias("page")).distinct()


def line_gaps(pages: DataFrame, r: DataFrame, lines: DataFrame) -> DataFrame:
    """(transcript_id, page, missing_lines, missing_in_canonical): what a testimony page's record lacks, and what its lines lack."""
    own = lines.filter("is_testimony")
    silent = own.groupBy("transcript_id", "page").agg(F.expr("array_sort(array_except(sequence(1, max(line)), collect_set(line)))").alias("silent"))
    # the first record with a page's number counts, also that of a page whose lines were not taken, which lacks none
    lacks = F.coalesce(F.when(F.col("kept"), F.col("missing_lines")), F.array().cast("array<int>"))
    first = pages.filter("transcript_page is not null").join(missing_lines(r), KEY, "left").groupBy("transcript_id", F.col("transcript_page").alias("page")).agg(F.min_by(lacks, "pdf_page_index").alias("listed"))
    x = silent.join(first, ["transcript_id", "page"], "left").withColumn("listed", F.array_sort(F.coalesce("listed", F.array().cast("array<int>"))))
    return x.filter("size(silent) > 0 or size(listed) > 0").select("transcript_id", "page", F.col("listed").alias("missing_lines"), F.col("silent").alias("missing_in_canonical"))


def page_continuity(lines: DataFrame) -> DataFrame:
    """(transcript_id, page, problem): pages missing from the range, and pages whose lines aren't 1 to the last in order."""
    span = testimony_range(lines).filter("testimony_start is not null and testimony_end >= testimony_start")
    expected = span.select("transcript_id", F.explode(F.expr("sequence(testimony_start, testimony_end)")).alias("page"))
    own = lines.filter("is_testimony")
    absent = expected.join(own.select("transcript_id", "page").distinct(), ["transcript_id", "page"], "left_anti").withColumn("problem", F.lit("page missing"))
    broken = own.groupBy("transcript_id", "page").agg(F.expr("transform(array_sort(collect_list(struct(ord, line))), x -> x.line)").alias("seen")).filter("seen <> sequence(1, array_max(seen))").select("transcript_id", "page", F.lit("lines not consecutive").alias("problem"))
    return absent.unionByName(broken)


def extraction_warnings(pages: DataFrame, r: DataFrame, lines: DataFrame, per_page: int = 5, overall: int = 200) -> DataFrame:
    """(transcript_id, n, warning): transcript-wide warnings, then each page's first ones; numbered, up to a limit."""
    kept = pages.filter("kept").select(*KEY, "transcript_page")
    w = W.partitionBy(*KEY).orderBy("y", "warning")
    page = warnings(r).join(kept, KEY).withColumn("k", F.row_number().over(w)).filter(F.col("k") <= per_page).select(
        "transcript_id", F.lit(2).alias("part"), "pdf_page_index", "k", F.expr("concat('p', coalesce(cast(transcript_page as string), 'None'), ': ', warning)").alias("warning"))
    wide = pages_without_footer(pages).select("transcript_id", F.lit(0).alias("part"), "pdf_page_index", F.lit(0).alias("k"), "warning").unionByName(
        transcript_warnings(lines).select("transcript_id", F.lit(1).alias("part"), F.lit(0).alias("pdf_page_index"), F.lit(0).alias("k"), "warning"))
    v = W.partitionBy("transcript_id").orderBy("part", "pdf_page_index", "k", "warning")
    return page.unionByName(wide).withColumn("n", F.row_number().over(v)).filter(F.col("n") <= overall).select("transcript_id", "n", "warning")


def report(pages: DataFrame, r: DataFrame, lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per transcript. gaps, duplicate_lines and page_roles have the pages, lines and counts themselves."""
    ints = lambda c: F.expr(f"array_sort(collect_set({c}))")
    p = pages.groupBy("transcript_id").agg(F.count("*").alias("total_pdf_pages"), F.expr("array_sort(collect_set(page_role) filter (where page_role <> 'transcript'))").alias("non_testimony_roles"))
    roles = page_role_counts(pages).groupBy("transcript_id").agg(F.expr("map_from_entries(array_sort(collect_list(struct(page_role, n_pages))))").alias("page_roles"))
    ln = lines.groupBy("transcript_id").agg(ints("page").alias("extracted_pages"), ints("case when is_testimony then page end").alias("extracted_testimony_pages"), F.count("*").alias("extracted_lines"), F.count_if("is_testimony").alias("extracted_testimony_lines"))
    tp = testimony_pages(pages, lines).groupBy("transcript_id").agg(ints("page").alias("testimony_pages"))
    ch = chunks.groupBy("transcript_id").agg(F.count("*").alias("chunks_created"))
    gaps = line_gaps(pages, r, lines).groupBy("transcript_id").agg(F.sum(F.expr("case when size(missing_lines) > 0 then 1 else 0 end + case when size(missing_in_canonical) > 0 then 1 else 0 end")).alias("gaps_detected"), F.array_sort(F.collect_list(F.struct("page", "missing_lines", "missing_in_canonical"))).alias("gaps"))
    twice = duplicate_lines(r).join(pages.filter("kept"), KEY).groupBy(*KEY, "transcript_page").agg(ints("line").alias("lines"))
    dup = twice.groupBy("transcript_id").agg(F.count("*").alias("duplicate_pages"), F.array_sort(F.collect_list(F.struct("pdf_page_index", F.col("transcript_page").alias("page"), "lines"))).alias("duplicate_lines"))
    warn = extraction_warnings(pages, r, lines).groupBy("transcript_id").agg(F.count("*").alias("n_warnings"), F.expr("transform(array_sort(collect_list(struct(n, warning))), x -> x.warning)").alias("warnings"))
    x = p
    for other in (roles, ln, tp, testimony_range(lines), ch, gaps, dup, warn):
        x = x.join(other, "transcript_id", "left")
    for name in ("gaps", "duplicate_lines", "warnings"):
        x = x.withColumn(name, F.coalesce(name, F.array().cast(x.schema[name].dataType)))
    return x.fillna(0, ["chunks_created", "gaps_detected", "duplicate_pages", "n_warnings", "extracted_lines", "extracted_testimony_lines"])
