"""Page roles, and which lines they let through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .layout import KEY, fold_lines, footers

# Roles whose pages give no lines.
SKIPPED = ["word_index", "procedural_appendix", "reporter_certificate", "redacted_administrative", "unnumbered"]
# What the text of such a page holds; a word index has ranges in brackets and many colons.
SKIP_PHRASES = {
    "redacted_administrative": ["ADMINISTRATIVE INFORMATION REDACTED"],
    "procedural_appendix": ["FEDERAL RULES OF CIVIL PROCEDURE", "REVIEW BY THE WITNESS"],
    "reporter_certificate": ["COMPANY CERTIFICATE AND DISCLOSURE"],
}
WORD_INDEX, WORD_INDEX_COLONS = r"\[[^\]]+\s-\s[^\]]+\]", 15


def _compact(raw: str) -> str:
    return f"trim(regexp_replace({raw}, '\\\\s+', ' '))"


def page_role(raw: str = "raw_text", page: str = "transcript_page", has_lines: str = "has_lines", compact: str | None = None, up: str | None = None) -> Column:
    """The first rule that a page's text meets; compact and up are columns with the text on one line, and that in capitals, where there are any."""
    compact = compact or _compact(raw)
    up = up or f"upper({compact})"
    has = lambda *xs: " and ".join(f"contains({up}, '{x}')" for x in xs)
    held = lambda role: f"when {has(*SKIP_PHRASES[role])} then '{role}'"
    index = WORD_INDEX.replace("\\", "\\\\")
    return F.expr(f"""case
        {held('redacted_administrative')}
        when {compact} rlike '{index}' and length({compact}) - length(replace({compact}, ':', '')) >= {WORD_INDEX_COLONS} then 'word_index'
        {held('procedural_appendix')}
        {held('reporter_certificate')}
        when contains({compact}, 'I N D E X') or ({up} rlike '(^|[^A-Z0-9_])INDEX([^A-Z0-9_]|$)' and {has('WITNESS', 'EXAMINATION')}) then 'index'
        when {has('CERTIFICATION', 'SHORTHAND REPORTER')} then 'csr_certificate'
        when contains({compact}, 'E R R A T A') or {has('ERRATA SHEET')} or {has('WITNESS SIGNATURE')} or {has('SOLEMNLY DECLARE UNDER PENALTY')} then 'errata_declaration'
        when {has('DEPOSITION CONCLUDED')} or {has('WHEREUPON, THE DEPOSITION')} then 'transcript'
        when not {has_lines} then 'unnumbered'
        when {page} <= 6 and {has('MR.')} and not contains({raw}, '      Q') then 'appearances_and_preliminaries'
        else 'transcript' end""")


def classify(texts: DataFrame, r: DataFrame) -> DataFrame:
    """Pages with their role. A first pass over the text alone takes skipped pages out before their rows count."""
    # the text's forms are columns, since each rule that repeats an expression has it worked out anew
    plain = texts.withColumn("compact", F.expr(_compact("raw_text"))).withColumn("up", F.upper("compact"))
    forms = {"compact": "compact", "up": "up"}
    preview = plain.withColumn("preview", page_role("raw_text", "cast(null as int)", "true", **forms))
    numbered = r.filter("line_no is not null").select(*KEY).distinct().withColumn("has", F.lit(True))
    p = preview.join(footers(r), KEY, "left").join(numbered, KEY, "left").withColumn("has_lines", F.coalesce("has", F.lit(False)))
    skipped = ", ".join(f"'{x}'" for x in SKIPPED)
    p = p.withColumn("page_role", F.when(F.expr(f"preview in ({skipped})"), F.col("preview")).otherwise(page_role(**forms)))
    page = F.expr(f"case when preview = 'redacted_administrative' then pdf_page_index + 1 when page_role in ({skipped}) then null else transcript_page end")
    return p.withColumn("transcript_page", page).withColumn("kept", F.expr(f"page_role not in ({skipped})")).select(*KEY, "page_role", "transcript_page", "kept", "raw_text")


def canonical_lines(r: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines of kept pages with a footer: (transcript_id, pdf_page_index, page, line, page_role, text, timestamp, cue)."""
    pages = pages.filter("kept and transcript_page is not null").select(*KEY, "page_role", F.col("transcript_page").alias("page"))
    return fold_lines(r).join(pages, KEY)


def pages_without_footer(pages: DataFrame) -> DataFrame:
    return pages.filter("kept and transcript_page is null").select(*KEY, F.expr("concat('PDF page ', pdf_page_index + 1, ' (', page_role, \") has numbered lines but no 'Page N' footer\")").alias("warning"))
