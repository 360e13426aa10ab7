"""Source ids, speakers and the testimony range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def range_id(sp: str, sl: str, ep: str, el: str) -> Column:
    return F.expr(f"""case when {sp} <> {ep} then concat('P', {sp}, ':L', {sl}, '-P', {ep}, ':L', {el}) when {sl} = {el} then concat('P', {sp}, ':L', {sl}) else concat('P', {sp}, ':L', {sl}, '-L', {el}) end""")


def parse_id(col: str, strict: bool = False) -> Column:
    """struct(sp, sl, ep, el) of the three forms; a malformed id is null, or an error if strict."""
    one, across = "^P([0-9]+):L([0-9]+)(?:-L([0-9]+))?$", "^P([0-9]+):L([0-9]+)-P([0-9]+):L([0-9]+)$"
    part = lambda pattern, g: f"cast(regexp_extract({col}, '{pattern}', {g}) as int)"
    bad = f"raise_error(concat('Invalid source_id: ', {col}))" if strict else "null"
    return F.expr(f"""case when {col} rlike '{across}' then named_struct('sp', {part(across, 1)}, 'sl', {part(across, 2)}, 'ep', {part(across, 3)}, 'el', {part(across, 4)})
        when {col} rlike '{one}' then named_struct('sp', {part(one, 1)}, 'sl', {part(one, 2)}, 'ep', {part(one, 1)}, 'el', cast(coalesce(nullif(regexp_extract({col}, '{one}', 3), ''), regexp_extract({col}, '{one}', 2)) as int))
        else {bad} end""")


def inline_speaker(col: str = "text") -> Column:
    """struct(label, kind, rest) that a line's own text names."""
    t = f"trim({col})"
    before, after = f"trim(substring_index({t}, ':', 1))", f"case when contains({t}, ':') then trim(substring({t}, instr({t}, ':') + 1)) else '' end"
    the = "(?i)^THE\\\\s+(WITNESS|REPORTER|VIDEOGRAPHER|COURT)\\\\s*:"
    who = f"upper(regexp_extract({t}, '{the}', 1))"
    s = lambda a, b, c: f"named_struct('label', {a}, 'kind', {b}, 'rest', {c})"
    return F.expr(f"""case
        when {t} = '' then {s("''", "'UNKNOWN'", "''")}
        when {t} rlike '(?i)^BY\\\\s+(MR\\\\.|MS\\\\.|MRS\\\\.)\\\\s+[A-Z]' then {s(before, "'BY'", after)}
        when {t} rlike '{the}' then {s(f"concat('THE ', {who})", f"case when {who} = 'COURT' then 'PROCEEDING' else {who} end", after)}
        when {t} rlike '(?i)^(MR\\\\.|MS\\\\.|MRS\\\\.)\\\\s+[A-Z][A-Z.\\\\-\\']+' and (contains(substring({t}, 1, 40), ':') or startswith({t}, 'MR.') or startswith({t}, 'MS.'))
            and {t} rlike '^(MR\\\\.|MS\\\\.|MRS\\\\.)\\\\s+[^\\\\s]+:' then {s(before, "'ATTORNEY'", after)}
        when {t} rlike '^Q\\\\s*:' then {s("'Q'", "'Q'", f"trim(regexp_replace({t}, '^Q\\\\s*:\\\\s*', ''))")}
        when {t} rlike '^A\\\\s*:' then {s("'A'", "'A'", f"trim(regexp_replace({t}, '^A\\\\s*:\\\\s*', ''))")}
        when startswith({t}, '(') then {s("'PROCEEDING'", "'PROCEEDING'", t)}
        else {s("''", "'UNKNOWN'", t)} end""")


def with_order(lines: DataFrame) -> DataFrame:
    """Canonical order: physical page, then line."""
    return lines.withColumn("ord", F.row_number().over(W.partitionBy("transcript_id").orderBy("pdf_page_index", "line")))


def carry_forward(lines: DataFrame) -> DataFrame:
    """Adds speaker and speaker_kind: cues and labels hold until the next; blank lines have none and end nothing."""
    w = W.partitionBy("transcript_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    x = lines.withColumn("own", inline_speaker("text")).withColumn("blank", F.expr("trim(text) = '' and cue is null"))
    x = x.withColumn("set", F.expr("case when blank then null when cue is not null then named_struct('label', cue, 'kind', cue) when own.kind <> 'UNKNOWN' and own.label <> '' then named_struct('label', own.label, 'kind', own.kind) end"))
    x = x.withColumn("now", F.last("set", ignorenulls=True).over(w))
    return x.withColumn("speaker", F.expr("case when blank then '' else coalesce(now.label, 'UNKNOWN') end")).withColumn("speaker_kind", F.expr("case when blank then 'UNKNOWN' else coalesce(now.kind, 'UNKNOWN') end")).withColumn(
        "text", F.expr("case when blank or cue is not null or own.rest = '' then text else own.rest end")).drop("own", "blank", "set", "now")


#: Whether a line closes a testimony, and what its range is made of: the first or last page with such a line.
CLOSING = "contains(up, 'THIS CONCLUDES TODAY') or contains(up, 'DEPOSITION CONCLUDED')"
RANGE = {"testimony_start": ("min_by", "speaker_kind = 'Q' and page_role = 'transcript'"), "closing": ("max_by", "closes"), "last_qa": ("max_by", "speaker_kind in ('Q', 'A', 'WITNESS') and page_role = 'transcript'")}
RANGE_END = "coalesce(closing, case when testimony_start is not null then last_qa end)"


def testimony_range(lines: DataFrame) -> DataFrame:
    """(transcript_id, testimony_start, testimony_end)."""
    r = lines.withColumn("up", F.upper("text")).withColumn("closes", F.expr(CLOSING)).groupBy("transcript_id").agg(*(F.expr(f"{how}(page, ord) filter (where {cond})").alias(name) for name, (how, cond) in RANGE.items()))
    return r.select("transcript_id", "testimony_start", F.expr(RANGE_END).alias("testimony_end"))


def flag_testimony(lines: DataFrame) -> DataFrame:
    """Adds is_testimony. The range is looked up over the transcript as it lies, so that lines are neither made twice nor joined."""
    w = W.partitionBy("transcript_id")
    found = {name: F.expr(f"{how}(page, case when {cond} then ord end)").over(w) for name, (how, cond) in RANGE.items()}
    x = lines.withColumn("up", F.upper("text")).withColumn("closes", F.expr(CLOSING)).withColumns(found).withColumn("testimony_end", F.expr(RANGE_END))
    return x.withColumn("is_testimony", F.expr("coalesce(page_role = 'transcript' and page between testimony_start and testimony_end, false)")).drop("up", "closes", *RANGE, "testimony_end")


def transcript(words_lines: DataFrame) -> DataFrame:
    """Canonical lines with order, ids, speakers and the testimony flag."""
    return flag_testimony(carry_forward(with_order(words_lines))).withColumn("source_id", F.expr("concat('P', page, ':L', line)"))


def transcript_warnings(lines: DataFrame) -> DataFrame:
    each = lines.groupBy("transcript_id").agg((F.count("*") != F.count_distinct("source_id")).alias("twice"), F.bool_or("is_testimony").alias("any"))
    return each.select("transcript_id", F.explode(F.expr("filter(array(case when twice then 'Duplicate source_id values were produced during extraction.' end, case when not any then 'No testimony lines detected; check extraction.' end), x -> x is not null)")).alias("warning"))
