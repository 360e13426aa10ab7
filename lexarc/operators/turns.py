"""Turns, question/answer units and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import EngineConfig
from .chains import BLOCK, Keep, block_of, keep_table, runs

# Phrases that mark procedure.
PROCEDURAL_PHRASES = ["objection", "same objection", "form of the question", "go off the record", "off the record", "on the record", "back on the record", "this concludes today", "deposition concluded", "take a break",
                      "going off the record", "the videographer", "the reporter", "could you sit up", "read that back", "let's go off"]


def ordered_join(value: str, order: str, sep: str = " ") -> Column:
    """Values joined in order; null ones are left out."""
    return F.expr(f"array_join(transform(array_sort(collect_list(case when {value} is not null then struct({order} as o, {value} as v) end)), x -> x.v), '{sep}')")


def turns(lines: DataFrame) -> DataFrame:
    """Maximal runs of testimony lines with one speaker."""
    w = W.partitionBy("transcript_id").orderBy("ord")
    x = lines.filter("is_testimony").withColumn("new", F.expr("case when speaker = lag(speaker) over (partition by transcript_id order by ord) and speaker_kind = lag(speaker_kind) over (partition by transcript_id order by ord) then 0 else 1 end"))
    x = x.withColumn("turn_no", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return x.groupBy("transcript_id", "turn_no").agg(
        F.expr("coalesce(nullif(min_by(speaker, ord), ''), 'UNKNOWN')").alias("speaker"), F.min_by("speaker_kind", "ord").alias("speaker_kind"), F.count("*").alias("n_lines"),
        ordered_join("nullif(trim(text), '')", "ord").alias("text"), F.min_by("page", "ord").alias("start_page"), F.min_by("line", "ord").alias("start_line"), F.max_by("page", "ord").alias("end_page"), F.max_by("line", "ord").alias("end_line"),
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.expr("transform(array_sort(collect_list(struct(ord, source_id))), x -> x.source_id)").alias("source_ids"))


def procedural_reason(text: str = "text", kind: str = "speaker_kind") -> Column:
    low = f"lower({text})"
    said = " or ".join("contains({}, '{}')".format(low, p.replace("'", "\\'")) for p in PROCEDURAL_PHRASES)
    return F.expr(f"""case when {kind} in ('REPORTER', 'VIDEOGRAPHER') then lower({kind}) when {kind} = 'PROCEEDING' then 'parenthetical'
        when {kind} = 'ATTORNEY' and (contains({low}, 'objection') or contains({low}, 'form')) then 'objection'
        when {said} then case when {kind} in ('ATTORNEY', 'REPORTER', 'VIDEOGRAPHER', 'PROCEEDING', 'BY') then 'colloquy_or_procedure' when contains({low}, 'objection') then 'objection' end end""")


def number_units(t: DataFrame) -> DataFrame:
    """Turns with their unit: a question opens one if the turns before hold testimony, or nothing but procedure."""
    before = W.partitionBy("transcript_id").orderBy("turn_no").rowsBetween(W.unboundedPreceding, -1)
    x = t.withColumn("reason", procedural_reason())
    x = x.withColumn("seen_qa", F.expr("bool_or(speaker_kind in ('Q', 'A', 'WITNESS'))").over(before)).withColumn("all_procedure", F.expr("bool_and(reason is not null or trim(text) = '')").over(before))
    x = x.withColumn("opens", F.expr("case when turn_no = 1 or (speaker_kind = 'Q' and (seen_qa or all_procedure)) then 1 else 0 end"))
    return x.withColumn("unit_no", F.sum("opens").over(W.partitionBy("transcript_id").orderBy("turn_no").rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("seen_qa", "all_procedure", "opens")


def units(t: DataFrame) -> DataFrame:
    """Question/answer units of turns."""
    u = number_units(t).groupBy("transcript_id", "unit_no").agg(
        F.expr("min_by(reason, turn_no) filter (where reason is not null)").alias("procedural_reason"), F.expr("bool_and(speaker_kind in ('ATTORNEY', 'REPORTER', 'VIDEOGRAPHER', 'PROCEEDING', 'BY'))").alias("only_procedure"),
        F.expr("bool_or(speaker_kind in ('Q', 'A', 'WITNESS'))").alias("has_qa"), ordered_join("nullif(text, '')", "turn_no").alias("text"), F.count("*").alias("n_turns"),
        F.min_by("start_page", "turn_no").alias("start_page"), F.min_by("start_line", "turn_no").alias("start_line"), F.max_by("end_page", "turn_no").alias("end_page"), F.max_by("end_line", "turn_no").alias("end_line"),
        F.expr("flatten(transform(array_sort(collect_list(struct(turn_no, source_ids))), x -> x.source_ids))").alias("source_ids"))
    return u.withColumn("is_procedural", F.expr("(only_procedure and procedural_reason is not null) or (coalesce(procedural_reason in ('objection', 'reporter', 'videographer', 'parenthetical'), false) and not has_qa)")).withColumn(
        "unit_id", F.expr("concat('QA', lpad(cast(unit_no as string), greatest(4, length(cast(unit_no as string))), '0'))")).drop("only_procedure", "has_qa")


def number_chunks(u: DataFrame, config: EngineConfig = EngineConfig(), keep: Keep = keep_table) -> DataFrame:
    """Units with their chunk. Where a chunk that begins at a unit would end shows in the few units after it, so units are
    looked at in blocks that reach a little into the next; chunks are the runs that follow from unit 1."""
    most = config.chunk_max_units
    x = u.select("transcript_id", "unit_no", F.length("text").alias("len")).withColumn("home", block_of("unit_no"))
    x = x.withColumn("seen_in", F.explode(F.expr(f"sequence(greatest(0, cast((unit_no - {most}) div {BLOCK} as int)), home)")))
    w = W.partitionBy("transcript_id", "seen_in").orderBy("unit_no")
    full = [F.when(F.sum("len").over(w.rowsBetween(0, k)) >= config.chunk_chars, F.col("unit_no") + k + 1) for k in range(most - 1)]
    x = x.withColumn("succ", F.coalesce(*full, F.col("unit_no") + most)).filter("seen_in = home")
    numbers = runs(x, ["transcript_id"], "unit_no", "succ", keep).select("transcript_id", F.col("pos").alias("unit_no"), F.col("run_no").alias("chunk_no"))
    return u.join(numbers, ["transcript_id", "unit_no"])


def chunks(numbered: DataFrame) -> DataFrame:
    """Chunks of numbered units: range, text with tags, text to compare by."""
    c = numbered.withColumn("tagged", F.expr("concat('[P', start_page, ':L', start_line, '-P', end_page, ':L', end_line, '] ', text)")).groupBy("transcript_id", "chunk_no").agg(
        F.count("*").alias("n_units"), F.bool_and("is_procedural").alias("only_procedure"), ordered_join("tagged", "unit_no", "\\n").alias("text"), F.expr("nullif(array_join(transform(array_sort(collect_list(case when not is_procedural then struct(unit_no as o, text as v) end)), x -> x.v), ' '), '')").alias("substance"),
        F.min_by("start_page", "unit_no").alias("start_page"), F.min_by("start_line", "unit_no").alias("start_line"), F.max_by("end_page", "unit_no").alias("end_page"), F.max_by("end_line", "unit_no").alias("end_line"),
        F.min("unit_no").alias("first_unit"), F.max("unit_no").alias("last_unit"), F.expr("flatten(transform(array_sort(collect_list(struct(unit_no, source_ids))), x -> x.source_ids))").alias("source_ids"))
    from .speakers import range_id

    return c.withColumn("source_range", range_id("start_page", "start_line", "end_page", "end_line")).withColumn("chunk_id", F.expr("concat('C', lpad(cast(chunk_no as string), greatest(3, length(cast(chunk_no as string))), '0'))")).withColumn(
        "corpus", F.expr("case when trim(coalesce(substance, '')) <> '' then substance when text <> '' then text else 'empty' end")).drop("substance")
