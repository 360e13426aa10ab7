"""Transcripts out of the conversations table: numbered lines, positioned words and page texts.

Twenty conversations make a transcript, ten words a line, twenty-five lines a page. Arithmetic on the keys adds the rest of what
transcripts hold: counsel, rulings, breaks, blank and lost lines, pages without a number, and administrative pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WORDS_PER_LINE, LINES_PER_PAGE, CONVERSATIONS = 10, 25, 20
#: Inserted before a turn when (7 conv_id + 13 turn) mod 29 is its place in this list.
INSERTED = ["BY MR. STONE:", "MR. STONE: Objection. Form.", "(A brief recess was taken.)", "THE VIDEOGRAPHER: We are going off the record.", "", "THE COURT: Please go on.", "MS. BLAKE: I have no information.",
            "THE WITNESS: I heard the objection and I will answer it now.", "MR. VAN DYKE: Hi there.", "Q: Is that right?", "A: Yes it is."]
CLOSING = "THE VIDEOGRAPHER: This concludes today's deposition."
#: Administrative pages at a transcript's end, by their distance from the last page.
ADMIN_PAGES = ["Administrative information redacted", "INDEX\nWITNESS EXAMINATION PAGE", "Company Certificate and Disclosure Statement", "Certification\nI am a shorthand reporter", "ERRATA SHEET", "Witness signature line",
               "Federal Rules of Civil Procedure Rule 30 review by the witness", "[answer - yes] 1:2 3:4 5:6 7:8 9:10 11:12 13:14 15:16 17:18 19:20 21:22 23:24 25:1 2:3 4:5 6:7", "E R R A T A", "I N D E X"]


def numbered_lines(conversations: DataFrame) -> DataFrame:
    """(transcript_id, ord, page, line, cue, text, timestamp): what a printed transcript holds, in order."""
    t = conversations.filter("conv_id is not null and turn is not null").select(
        F.expr(f"cast(conv_id div {CONVERSATIONS} as bigint)").alias("transcript_id"), "conv_id", "turn", "role", F.expr("filter(split(coalesce(text, ''), '\\\\s+'), w -> w <> '')").alias("words"))
    body = t.select("transcript_id", "conv_id", "turn", "role", "words", F.explode(F.expr(f"sequence(0, greatest(0, cast(ceil(size(words) / {WORDS_PER_LINE}) as int) - 1))")).alias("wrap")).select(
        "transcript_id", "conv_id", "turn", "wrap", F.expr("case when wrap = 0 and role = 'user' then 'Q' when wrap = 0 and role = 'assistant' then 'A' end").alias("cue"),
        F.expr(f"concat(case when wrap = 0 and role = 'system' then 'THE REPORTER: ' else '' end, array_join(slice(words, wrap * {WORDS_PER_LINE} + 1, {WORDS_PER_LINE}), ' '))").alias("text"))
    place = F.expr("cast(pmod(7 * conv_id + 13 * turn, 29) as int)")
    extra = t.withColumn("k", place).filter(f"k < {len(INSERTED)}").select(
        "transcript_id", "conv_id", "turn", F.lit(-1).alias("wrap"), F.lit(None).cast("string").alias("cue"), F.element_at(F.array(*map(F.lit, INSERTED)), F.col("k") + 1).alias("text"))
    closing = t.filter(f"pmod(conv_id, {CONVERSATIONS}) = 18 and turn = 0 and transcript_id % 2 = 0").select(
        "transcript_id", "conv_id", "turn", F.lit(-2).alias("wrap"), F.lit(None).cast("string").alias("cue"), F.lit(CLOSING).alias("text"))
    w = W.partitionBy("transcript_id").orderBy("conv_id", "turn", "wrap")
    lines = body.unionByName(extra).unionByName(closing).withColumn("ord", F.row_number().over(w))
    lines = lines.withColumn("page", F.expr(f"1 + (ord - 1) div {LINES_PER_PAGE}").cast("int")).withColumn("line", F.expr(f"1 + (ord - 1) % {LINES_PER_PAGE}").cast("int"))
    stamp = F.expr("case when line % 5 = 1 then concat(lpad(cast((9 + ord div 240) % 24 as string), 2, '0'), ':', lpad(cast((ord div 4) % 60 as string), 2, '0')) end")
    return lines.filter("pmod(ord * 31 + transcript_id, 97) <> 5").select("transcript_id", "ord", "page", "line", "cue", "text", stamp.alias("timestamp"))


def word_boxes(lines: DataFrame) -> DataFrame:
    """(transcript_id, pdf_page_index, word_no, x0, y0, x1, y1, text): the words of the pages with their places."""
    at = "50D + 25D * line"
    words = F.expr(f"""filter(concat(
        array(named_struct('x0', 70D, 'y0', {at}, 'text', cast(line as string))),
        case when cue is not null then array(named_struct('x0', 145.5D, 'y0', {at} + 0.5D, 'text', cue)) else array() end,
        transform(filter(split(text, ' '), w -> w <> ''), (w, i) -> named_struct('x0', 176.8D + 24D * i, 'y0', {at}, 'text', w)),
        case when timestamp is not null then array(named_struct('x0', 500D, 'y0', {at}, 'text', case when ord % 10 = 1 then concat('(', timestamp, ')') else timestamp end)) else array() end,
        case when line = 11 then array(named_struct('x0', 470D, 'y0', {at}, 'text', ' ')) else array() end,
        case when line = 3 and page % 7 = 0 then array(named_struct('x0', 70D, 'y0', {at} + 11D, 'text', '3'), named_struct('x0', 176.8D, 'y0', {at} + 11D, 'text', 'again')) else array() end
        ), x -> x.text is not null)""")
    body = lines.select("transcript_id", F.col("page").alias("p"), F.explode(words).alias("w"))
    pages = lines.select("transcript_id", F.col("page").alias("p")).distinct()
    marks = pages.select("transcript_id", "p", F.explode(F.expr("""concat(
        case when p % 17 <> 0 then array(named_struct('x0', 450D, 'y0', 740D, 'text', 'Page'), named_struct('x0', 480D, 'y0', 740D, 'text', cast(p as string))) else array() end,
        case when p % 5 = 0 then array(named_struct('x0', 200D, 'y0', 30D, 'text', 'CONFIDENTIAL')) else array() end)""")).alias("w"))
    w = W.partitionBy("transcript_id", "p").orderBy("w.y0", "w.x0", "w.text")
    return body.unionByName(marks).select("transcript_id", (F.col("p") - 1).alias("pdf_page_index"), F.row_number().over(w).alias("word_no"),
                                          "w.x0", "w.y0", (F.col("w.x0") + 20).alias("x1"), (F.col("w.y0") + 12).alias("y1"), "w.text")


def page_texts(lines: DataFrame) -> DataFrame:
    """(transcript_id, pdf_page_index, raw_text): the plain text of each page, administrative pages last."""
    printed = F.expr("concat(cast(line as string), case when cue is not null then concat('      ', cue, '      ') else '      ' end, text)")
    x = lines.withColumn("last", F.max("page").over(W.partitionBy("transcript_id"))).groupBy("transcript_id", "page", "last").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", printed.alias("s")))), lambda x: x["s"]), "\n").alias("s"))
    x = x.withColumn("s", F.concat("s", F.expr("case when page % 17 <> 0 then concat('\\nPage ', page) else '' end")))
    own = F.array(F.struct((F.col("page") - 1).alias("at"), F.col("s").alias("raw_text")))
    admin = F.transform(F.array(*map(F.lit, ADMIN_PAGES)), lambda s, i: F.struct((F.col("page") + i).cast("int").alias("at"), s.alias("raw_text")))
    return x.select("transcript_id", F.explode(F.when(F.col("page") == F.col("last"), F.concat(own, admin)).otherwise(own)).alias("x")).select("transcript_id", F.col("x.at").alias("pdf_page_index"), "x.raw_text")
