"""Checks of topics against the lines that they cite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .turns import ordered_join

KEY = ["transcript_id", "topic_no"]


def span_lines(topics: DataFrame, lines: DataFrame) -> DataFrame:
    """Lines between each topic's bounds, joined by page so that a transcript's lines meet only topics on their page."""
    pages = topics.select(*KEY, F.expr("start_page * 1000 + start_line").alias("lo"), F.expr("end_page * 1000 + end_line").alias("hi"), F.explode(F.expr("sequence(least(start_page, end_page), greatest(start_page, end_page))")).alias("page"))
    return pages.join(lines.select("transcript_id", "page", "line", "ord", "source_id", "speaker", "text"), ["transcript_id", "page"]).filter("page * 1000 + line between lo and hi").drop("lo", "hi")


def validate(topics: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds provenance_ok and provenance_notes to topics."""
    here = lines.select("transcript_id", "page", "line").distinct()
    start, end = here.toDF("transcript_id", "start_page", "start_line").withColumn("start_ok", F.lit(True)), here.toDF("transcript_id", "end_page", "end_line").withColumn("end_ok", F.lit(True))
    known = lines.select("transcript_id", F.col("source_id").alias("sid")).distinct().withColumn("known", F.lit(True))
    ids = topics.select(*KEY, F.posexplode("source_ids").alias("n", "sid")).join(known, ["transcript_id", "sid"], "left").filter("known is null").groupBy(*KEY).agg(F.min_by("sid", "n").alias("unknown"))
    text = span_lines(topics, lines).groupBy(*KEY).agg(F.lower(ordered_join("text", "ord")).alias("span_text"))
    x = topics.join(start, ["transcript_id", "start_page", "start_line"], "left").join(end, ["transcript_id", "end_page", "end_line"], "left").join(ids, KEY, "left").join(text, KEY, "left")
    x = x.withColumn("said", F.expr("slice(filter(split(trim(lower(supporting_evidence)), '\\\\s+'), w -> length(w) > 4), 1, 12)"))
    x = x.withColumn("hits", F.expr("size(filter(said, w -> contains(coalesce(span_text, ''), regexp_replace(w, '^[.,;:…]+|[.,;:…]+$', ''))))"))
    notes = F.expr("""filter(array(case when start_ok is null then concat('start does not exist: P', start_page, ':L', start_line) end, case when end_ok is null then concat('end does not exist: P', end_page, ':L', end_line) end,
        case when start_page * 1000 + start_line > end_page * 1000 + end_line then 'start is after end' end, case when unknown is not null then concat('unknown source_id ', unknown) end,
        case when supporting_evidence <> '' and size(said) > 0 and hits < greatest(1, size(said) div 4) then 'supporting_evidence does not match source span text' end), x -> x is not null)""")
    return x.withColumn("provenance_notes", notes).withColumn("provenance_ok", F.size("provenance_notes") == 0).drop("start_ok", "end_ok", "unknown", "span_text", "said", "hits")


def clamp(places: DataFrame, lines: DataFrame) -> DataFrame:
    """places(transcript_id, place_no, page, line) with the nearest line that exists, on the nearest page if need be.

    Of equally near pages the lower one counts, of equally near lines the earlier one. Places and what they may move to go in
    one order, so that the nearest on either side is the last one seen, and no place meets more than two of them.
    """
    t, asked = "transcript_id", F.col("place_no").isNotNull()
    pages = lines.select(t, F.col("page").alias("at")).distinct()
    x = places.select(t, "place_no", "page", "line", F.col("page").alias("at")).unionByName(pages, allowMissingColumns=True)
    seen = F.last(F.when(~asked, F.col("at")), ignorenulls=True)
    up, down = (W.partitionBy(t).orderBy(o("at"), asked).rowsBetween(W.unboundedPreceding, 0) for o in (F.asc, F.desc))
    x = x.withColumn("low", seen.over(up)).withColumn("high", seen.over(down)).filter(asked)
    x = x.withColumn("p", F.expr("case when high is null or at - low <= high - at then low else high end")).filter("p is not null")

    own = lines.groupBy(t, F.col("page").alias("p"), F.col("line").alias("at")).agg(F.min("ord").alias("ord"))
    y = x.select(t, "p", "place_no", "page", "line", F.col("line").alias("at")).unionByName(own, allowMissingColumns=True)
    seen = F.last(F.when(~asked, F.struct("at", "ord")), ignorenulls=True)
    up, down = (W.partitionBy(t, "p").orderBy(o("at"), asked).rowsBetween(W.unboundedPreceding, 0) for o in (F.asc, F.desc))
    y = y.withColumn("low", seen.over(up)).withColumn("high", seen.over(down)).filter(asked)
    far = "case when {0} is not null then named_struct('far', abs({0}.at - line), 'ord', {0}.ord, 'at', {0}.at) end"
    y = y.withColumn("to", F.least(F.expr(far.format("low")), F.expr(far.format("high"))))
    return y.select(t, "place_no", "page", "line", F.col("p").alias("clamped_page"), F.col("to.at").alias("clamped_line"))


def validate_or_repair(topics: DataFrame, lines: DataFrame) -> DataFrame:
    """Valid topics, and invalid ones whose clamped bounds are valid."""
    checked = validate(topics, lines)
    bad = checked.filter("not provenance_ok").drop("provenance_ok", "provenance_notes")
    places = bad.select("transcript_id", F.col("topic_no"), F.explode(F.expr("array(struct(0 as side, start_page as page, start_line as line), struct(1 as side, end_page as page, end_line as line))")).alias("x")).select(
        "transcript_id", (F.col("topic_no") * 2 + F.col("x.side")).alias("place_no"), "x.page", "x.line")
    to = clamp(places, lines).select("transcript_id", F.expr("place_no div 2").cast("int").alias("topic_no"), F.expr("place_no % 2").alias("side"), F.struct("clamped_page", "clamped_line").alias("c")).groupBy(*KEY).agg(
        F.expr("max(c) filter (where side = 0)").alias("s"), F.expr("max(c) filter (where side = 1)").alias("e"))
    moved = bad.join(to, KEY).filter("s.clamped_page * 1000 + s.clamped_line <= e.clamped_page * 1000 + e.clamped_line")
    for side, x in (("start", "s"), ("end", "e")):
        moved = moved.withColumn(f"{side}_page", F.col(f"{x}.clamped_page")).withColumn(f"{side}_line", F.col(f"{x}.clamped_line"))
    repaired = validate(moved.drop("s", "e"), lines).filter("provenance_ok").withColumn("repaired", F.lit(True))
    return checked.filter("provenance_ok").withColumn("repaired", F.lit(False)).unionByName(repaired)


def source_lines(topics: DataFrame, lines: DataFrame) -> DataFrame:
    """A topic's own lines in its span; all of the span if it has none."""
    x = span_lines(topics, lines).join(topics.select(*KEY, F.explode("source_ids").alias("source_id")).distinct().withColumn("own", F.lit(True)), [*KEY, "source_id"], "left")
    return x.withColumn("any", F.max(F.col("own").isNotNull()).over(W.partitionBy(*KEY))).filter("own or not any").drop("own", "any")


def check(topics: DataFrame, lines: DataFrame) -> DataFrame:
    """One verification row per topic."""
    own = source_lines(topics, lines)
    ids = own.select(*KEY, "source_id").distinct().withColumn("there", F.lit(True))
    missing = topics.select(*KEY, F.posexplode("source_ids").alias("n", "source_id")).join(ids, [*KEY, "source_id"], "left").filter("there is null").groupBy(*KEY).agg(
        F.count("*").alias("n_missing"), F.expr("slice(transform(array_sort(collect_list(struct(n, source_id))), x -> x.source_id), 1, 20)").alias("missing_source_ids"))
    ends = own.join(topics.select(*KEY, "start_page", "start_line", "end_page", "end_line"), KEY).groupBy(*KEY).agg(F.count("*").alias("line_count"), F.expr("bool_or(page = start_page and line = start_line)").alias("start_exists"), F.expr("bool_or(page = end_page and line = end_line)").alias("end_exists"))
    x = topics.select(*KEY, "topic_id", F.size("source_ids").alias("n_ids")).join(ends, KEY, "left").join(missing, KEY, "left")
    x = x.select(*KEY, "topic_id", F.coalesce("line_count", F.lit(0)).alias("line_count"), F.coalesce("start_exists", F.lit(False)).alias("start_exists"), F.coalesce("end_exists", F.lit(False)).alias("end_exists"),
                 (F.col("n_ids") - F.coalesce("n_missing", F.lit(0))).alias("source_ids_resolved"), F.coalesce("missing_source_ids", F.array().cast("array<string>")).alias("missing_source_ids"))
    return x.withColumn("ok", F.expr("size(missing_source_ids) = 0 and line_count > 0 and start_exists and end_exists")).withColumn("verification_status", F.expr("case when ok then 'verified' else 'failed' end"))


def unavailable(topics: DataFrame) -> DataFrame:
    """What a check says without a transcript."""
    return topics.select(*KEY, "topic_id", F.lit(0).alias("line_count"), F.lit(None).cast("boolean").alias("start_exists"), F.lit(None).cast("boolean").alias("end_exists"), F.lit(0).alias("source_ids_resolved"),
                         F.array().cast("array<string>").alias("missing_source_ids"), F.lit(False).alias("ok"), F.lit("unavailable").alias("verification_status"))


def audit(topics: DataFrame, lines: DataFrame) -> DataFrame:
    """Counts of faults over a transcript's index, in chronological order."""
    known = lines.select("transcript_id", "source_id").distinct()
    lost = topics.select(*KEY, F.explode("source_ids").alias("source_id")).join(known, ["transcript_id", "source_id"], "left_anti").groupBy(*KEY).agg(F.count("*").alias("lost"))
    w = W.partitionBy("transcript_id").orderBy("start_page", "start_line", "end_page", "end_line", "topic_no")
    x = validate(topics, lines).join(lost, KEY, "left").withColumn("at", F.expr("start_page * 1000 + start_line")).withColumn("before", F.lag("at").over(w))
    return x.groupBy("transcript_id").agg(
        F.count("*").alias("topics_checked"), F.sum(F.expr("size(filter(provenance_notes, n -> n like 'start does%' or n like 'end does%' or n like 'start is%'))")).alias("invalid_refs"),
        F.sum(F.expr("coalesce(lost, 0) + case when size(source_ids) = 0 then 1 else 0 end")).alias("missing_sids"), F.sum(F.expr("case when provenance_ok then 0 else 1 end")).alias("evidence_mismatches"), F.sum(F.expr("case when at < before then 1 else 0 end")).alias("order_violations"))


def duplicate_assignments(topics: DataFrame) -> DataFrame:
    """(transcript_id, source_id, n_topics): lines that several topics of a transcript hold."""
    own = topics.select(*KEY, F.explode("source_ids").alias("source_id")).distinct()
    return own.groupBy("transcript_id", "source_id").agg(F.count("*").alias("n_topics")).filter("n_topics > 1")
