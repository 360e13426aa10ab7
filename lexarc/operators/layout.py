"""Positioned words to numbered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = ["transcript_id", "pdf_page_index"]
# Where columns begin, in points.
NUMBER_X_MAX, TIMESTAMP_X_MIN, FOOTER_Y_MIN = 95, 490, 720


def row_buckets(words: DataFrame) -> DataFrame:
    """Words that aren't blank, with the even y that their row gathers at (ties to even)."""
    return words.filter("trim(text) <> ''").withColumn("y", F.expr("cast(bround(y0 / 2, 0) * 2 as int)"))


def rows(words: DataFrame) -> DataFrame:
    """One row per visual row: its words by x, its columns, and what each holds."""
    r = row_buckets(words).groupBy(*KEY, "y").agg(F.array_sort(F.collect_list(F.struct("x0", "word_no", "text", "y0"))).alias("words"))
    r = r.withColumn("row_text", F.expr("array_join(transform(words, w -> w.text), ' ')")).withColumn("left", F.expr(f"filter(words, w -> w.x0 <= {NUMBER_X_MAX})")).withColumn(
        "body_all", F.expr(f"filter(words, w -> w.x0 > {NUMBER_X_MAX} and w.x0 < {TIMESTAMP_X_MIN})")).withColumn("stamps", F.expr(f"filter(words, w -> w.x0 >= {TIMESTAMP_X_MIN})"))
    printed = F.regexp_extract("row_text", r"(?i)Page\s+([0-9]+)\s*$", 1)
    r = r.withColumn("printed", F.when(printed != "", printed.cast("int"))).withColumn("is_footer", F.expr(f"""printed is not null
        and forall(filter(words, w -> w.x0 > {NUMBER_X_MAX}), w -> w.y0 >= {FOOTER_Y_MIN} or w.x0 > 400)
        and (forall(words, w -> w.y0 > 700) or lower(trim(row_text)) like 'page %')"""))
    r = r.withColumn("token", F.expr("trim(get(left, 0).text)")).withColumn("line_no", F.expr("case when not is_footer and token rlike '^[0-9]+$' and try_cast(token as int) between 1 and 25 then cast(token as int) end"))
    r = r.withColumn("cue", F.expr("case when get(body_all, 0).text in ('Q', 'A') and get(body_all, 0).x0 between 135 and 160 then get(body_all, 0).text end"))
    r = r.withColumn("body", F.expr("trim(array_join(transform(case when cue is not null then slice(body_all, 2, size(body_all)) else body_all end, w -> w.text), ' '))"))
    return r.withColumn("timestamp", F.expr("nullif(regexp_extract(get(stamps, 0).text, '(?:^|[^0-9A-Za-z_])([0-9]{1,2}:[0-9]{2})(?![0-9A-Za-z_])', 1), '')"))


def footers(r: DataFrame) -> DataFrame:
    """(key, transcript_page): the last footer of each page that has one."""
    return r.filter("is_footer").groupBy(*KEY).agg(F.max_by("printed", "y").alias("transcript_page"))


def fold_lines(r: DataFrame) -> DataFrame:
    """Numbered lines: bodies of rows with one number joined from above, last timestamp and cue."""
    return r.filter("line_no is not null").groupBy(*KEY, F.col("line_no").alias("line")).agg(
        F.expr("array_join(transform(array_sort(collect_list(case when body <> '' then struct(y, body) end)), x -> x.body), ' ')").alias("text"),
        F.expr("max_by(timestamp, y) filter (where timestamp is not null)").alias("timestamp"), F.expr("max_by(cue, y) filter (where cue is not null)").alias("cue"))


def warnings(r: DataFrame) -> DataFrame:
    """(key, y, warning): text without a number, and second rows of a number."""
    loose = r.filter("not is_footer and line_no is null and body <> '' and printed is null").select(*KEY, "y", F.expr("concat('Unnumbered text at y=', y, ': ', substring(body, 1, 80))").alias("warning"))
    w = W.partitionBy(*KEY, "line_no").orderBy("y").rowsBetween(W.unboundedPreceding, -1)
    twice = r.filter("line_no is not null").withColumn("before", F.expr("count_if(body <> '')").over(w)).filter("body <> '' and before > 0").select(*KEY, "y", F.expr("concat('Duplicate visual row for line ', line_no)").alias("warning"))
    return loose.unionByName(twice)


def duplicate_lines(r: DataFrame) -> DataFrame:
    return r.filter("line_no is not null").groupBy(*KEY, F.col("line_no").alias("line")).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def missing_lines(r: DataFrame) -> DataFrame:
    """(key, missing_lines): numbers below a page's last one that no row has."""
    return r.filter("line_no is not null").groupBy(*KEY).agg(F.expr("array_except(sequence(1, max(line_no)), collect_set(line_no))").alias("missing_lines"))
