"""Every registered query of the transcript engine: name, DataFrame, and the same as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import completeness, layout, provenance, reports, roles, search, segment, speakers, text, topics, turns
from ..operators.layout import KEY
from . import oracle as O
from .pipeline import Transcripts

QUERY, TERM, TOP = "objection heard, answer right", "the", 8
TOPIC = ["transcript_id", "topic_no"]
REGISTRY: dict[str, tuple] = {}
#: Places for the nearest-line lookup: some exist, some lack the line, some the page.
PLACES = [(1, 7), (2, 30), (3, 5), (17, 4), (500, 12), (34, 1)]
#: Topics made to fail in known ways, as multiples of their number.
BROKEN = {2: "evidence", 3: "source", 5: "page"}


def query(sql: str | None, name: str | None = None):
    """Registers a function of Transcripts under its name, with its last SELECT."""
    def put(f):
        REGISTRY[name or f.__name__] = (f, sql)
        return f
    return put


def both(run: DataFrame, doctored: DataFrame) -> DataFrame:
    """Results over the run's own data and over data with planted cases, told apart by a column."""
    return run.select(F.lit("run").alias("data"), "*").unionByName(doctored.select(F.lit("doctored").alias("data"), "*"))


def _words(col: str) -> str:
    return f"transform({col}, w -> w.text)"


@query("SELECT transcript_id, pdf_page_index, word_no, x0, y0, x1, y1, text FROM words")
def scan_page_words(t):
    return t.words


@query("SELECT transcript_id, topic_id, topic, start_page, start_line, end_page, end_line FROM idx")
def scan_topic_index(t):
    return t.index.select("transcript_id", "topic_id", "topic", "start_page", "start_line", "end_page", "end_line")


@query("SELECT transcript_id, pdf_page_index, word_no, y FROM buckets")
def layout_row_bucket(t):
    return layout.row_buckets(t.words).select(*KEY, "word_no", "y")


@query("SELECT transcript_id, pdf_page_index, y, row_text FROM gathered")
def layout_row_text(t):
    return t.rows.select(*KEY, "y", "row_text")


@query("SELECT transcript_id, pdf_page_index, y, list_transform(lefts, lambda w: w.t) AS numbers, list_transform(bodies, lambda w: w.t) AS bodies, list_transform(stamps, lambda w: w.t) AS stamps FROM cols")
def layout_columns(t):
    return layout.rows(t.words).select(*KEY, "y", F.expr(_words("left")).alias("numbers"), F.expr(_words("body_all")).alias("bodies"), F.expr(_words("stamps")).alias("stamps"))


@query("SELECT * FROM footers")
def page_footer_number(t):
    return layout.footers(t.rows)


@query("SELECT transcript_id, pdf_page_index, y, line_no FROM vrows WHERE line_no IS NOT NULL")
def layout_line_number(t):
    return t.rows.filter("line_no is not null").select(*KEY, "y", "line_no")


@query("SELECT transcript_id, pdf_page_index, y, cue, body FROM vrows WHERE cue IS NOT NULL")
def speaker_cue(t):
    return t.rows.filter("cue is not null").select(*KEY, "y", "cue", "body")


@query("SELECT transcript_id, pdf_page_index, y, timestamp FROM vrows WHERE len(stamps) > 0")
def line_timestamp(t):
    return layout.rows(t.words).filter("size(stamps) > 0").select(*KEY, "y", "timestamp")


@query("SELECT transcript_id, pdf_page_index, line, text, timestamp, cue FROM folded")
def canonical_line_fold(t):
    return layout.fold_lines(t.rows)


@query("SELECT * FROM warned")
def layout_warnings(t):
    return layout.warnings(t.rows)


@query("SELECT * FROM dups")
def duplicate_lines(t):
    return layout.duplicate_lines(t.rows)


@query("SELECT * FROM missing")
def missing_lines(t):
    return layout.missing_lines(t.rows)


@query("SELECT transcript_id, pdf_page_index, page_role, transcript_page FROM pages")
def page_role(t):
    return t.pages.select(*KEY, "page_role", "transcript_page")


@query("SELECT transcript_id, pdf_page_index, page_role FROM pages WHERE kept")
def page_role_filter(t):
    return t.pages.filter("kept").select(*KEY, "page_role")


@query("SELECT transcript_id, pdf_page_index, 'PDF page ' || (pdf_page_index + 1) || ' (' || page_role || ') has numbered lines but no ''Page N'' footer' AS warning FROM pages WHERE kept AND transcript_page IS NULL")
def pages_without_footer(t):
    return roles.pages_without_footer(t.pages)


@query("SELECT transcript_id, page, line, source_id FROM lines")
def source_ids(t):
    return t.lines.select("transcript_id", "page", "line", "source_id")


@query(f"SELECT transcript_id, turn_no, {O.rid('start_page', 'start_line', 'end_page', 'end_line')} AS range_id FROM turns")
def range_ids(t):
    return t.turns.select("transcript_id", "turn_no", speakers.range_id("start_page", "start_line", "end_page", "end_line").alias("range_id"))


@query("SELECT transcript_id, turn_no, start_page AS sp, start_line AS sl, end_page AS ep, end_line AS el FROM turns")
def parse_source_ids(t):
    return range_ids(t).withColumn("p", speakers.parse_id("range_id")).select("transcript_id", "turn_no", "p.*")


@query("SELECT transcript_id, pdf_page_index, line, own.label AS label, own.kind AS kind, own.rest AS rest FROM inl")
def inline_speaker_parse(t):
    return t.canonical.withColumn("own", speakers.inline_speaker()).select(*KEY, "line", "own.*")


@query("SELECT transcript_id, pdf_page_index, line, speaker, speaker_kind, text FROM lines")
def speaker_carry_forward(t):
    return t.lines.select(*KEY, "line", "speaker", "speaker_kind", "text")


@query("SELECT * FROM trange")
def testimony_range(t):
    return speakers.testimony_range(t.lines)


@query("SELECT transcript_id, source_id, page, line FROM lines WHERE is_testimony")
def testimony_lines(t):
    return t.lines.filter("is_testimony").select("transcript_id", "source_id", "page", "line")


TROUBLED = "case when ord <= 2 then 'P1:L1' else source_id end"


@query(f""", troubled AS (SELECT * REPLACE ({TROUBLED} AS source_id, is_testimony AND transcript_id % 2 = 1 AS is_testimony) FROM lines)
SELECT 'run' AS data, transcript_id, warning FROM wide UNION ALL
SELECT 'doctored', transcript_id, unnest(list_filter([CASE WHEN count(*) <> count(DISTINCT source_id) THEN 'Duplicate source_id values were produced during extraction.' END,
  CASE WHEN NOT bool_or(is_testimony) THEN 'No testimony lines detected; check extraction.' END], lambda x: x IS NOT NULL)) AS warning FROM troubled GROUP BY transcript_id""")
def transcript_warnings(t):
    """Of the run, and over lines with a repeated id and every second transcript without testimony."""
    doctored = t.lines.withColumn("source_id", F.expr(TROUBLED)).withColumn("is_testimony", F.expr("is_testimony and transcript_id % 2 = 1"))
    return both(speakers.transcript_warnings(t.lines), speakers.transcript_warnings(doctored))


@query("SELECT transcript_id, turn_no, speaker, speaker_kind, n_lines, source_ids FROM turns", "turns")
def turns_query(t):
    return t.turns.select("transcript_id", "turn_no", "speaker", "speaker_kind", "n_lines", "source_ids")


@query("SELECT transcript_id, turn_no, text, start_page, start_line, end_page, end_line FROM turns")
def turn_text(t):
    return t.turns.select("transcript_id", "turn_no", "text", "start_page", "start_line", "end_page", "end_line")


@query("SELECT transcript_id, turn_no, speaker_kind, reason FROM reasoned")
def procedural_reason(t):
    return t.turns.select("transcript_id", "turn_no", "speaker_kind", turns.procedural_reason().alias("reason"))


@query("SELECT transcript_id, turn_no, unit_no FROM uturns")
def qa_units(t):
    return turns.number_units(t.turns).select("transcript_id", "turn_no", "unit_no")


@query("SELECT transcript_id, unit_id, is_procedural, procedural_reason, n_turns FROM units")
def unit_procedural_flag(t):
    return t.units.select("transcript_id", "unit_id", "is_procedural", "procedural_reason", "n_turns")


@query("SELECT transcript_id, unit_no, chunk_no FROM numbered")
def chunks(t):
    return t.numbered.select("transcript_id", "unit_no", "chunk_no")


@query("SELECT transcript_id, chunk_id, source_range, text, source_ids FROM chunks")
def chunk_text(t):
    return t.chunks.select("transcript_id", "chunk_id", "source_range", "text", "source_ids")


@query("SELECT transcript_id, chunk_no, corpus FROM chunks")
def chunk_corpus(t):
    return t.chunks.select("transcript_id", "chunk_no", "corpus")


@query(f"SELECT doc_id, {O.toks('text')} AS tokens FROM documents", "tokens")
def tokens_query(t):
    return t.documents.select("doc_id", text.tokens("text").alias("tokens"))


@query(f""", {O.terms('dterms', 'documents', 'doc_id', 'text')} SELECT * FROM dterms""")
def ngrams(t):
    return text.term_counts(t.documents, ["doc_id"], "text")


@query("SELECT transcript_id, chunk_no, term, round(weight, 9) AS weight FROM weights")
def tfidf(t):
    return t.weights.select("transcript_id", "chunk_no", "term", F.round("weight", 9).alias("weight"))


@query("SELECT transcript_id, term, cf, rank FROM vocab")
def vocab_topk(t):
    return text.top_terms(text.row_term_counts(t.kept_chunks, ["transcript_id", "chunk_no"], "corpus"), ["transcript_id"], t.config.segment_vocabulary)


@query("SELECT transcript_id, i, j, round(g, 9) AS g FROM gram")
def chunk_gram(t):
    return t.chunk_gram().select("transcript_id", "i", "j", F.round("g", 9).alias("g"))


@query("SELECT transcript_id, chunk_no, round(similarity, 9) AS similarity FROM adjacent")
def adjacent_similarity(t):
    return segment.adjacent_similarity(t.band).withColumn("similarity", F.round("similarity", 9))


@query("SELECT transcript_id, topic_no, phrases FROM phr")
def keyphrases(t):
    return text.keyphrases(topics.spans(t.topic_units), TOPIC, "text", 6, t.config.phrase_vocabulary)


@query("SELECT transcript_id, chunk_no, only_procedure FROM chunks")
def procedural_chunks(t):
    return t.chunks.select("transcript_id", "chunk_no", "only_procedure")


@query("SELECT * FROM groups")
def topic_walk(t):
    return t.groups


@query(f""", decided AS (SELECT *, CASE WHEN chunk_no % 3 = 0 THEN 'continue' WHEN chunk_no % 3 = 1 THEN 'new_topic' END AS action FROM chunks), {O.walk('dgroups', 'decided')} SELECT * FROM dgroups""")
def topic_walk_decisions(t):
    d = t.kept_chunks.filter("chunk_no % 3 <> 2").select("transcript_id", "chunk_id", F.expr("case when chunk_no % 3 = 0 then 'continue' else 'new_topic' end").alias("action"))
    return segment.walk(t.kept_chunks, t.band, t.config, d, t.step)


REQUESTS_SQL = """, requests AS (SELECT *, sha256(CAST(to_json({'transcript_id': transcript_id, 'chunk_ids': chunk_ids, 'source_ranges': source_ranges, 'texts': texts}) AS VARCHAR)) AS request_key FROM (
  SELECT transcript_id, CAST(1 + (chunk_no - 1) // 8 AS INT) AS batch_no, list(chunk_id ORDER BY chunk_no) AS chunk_ids, list(source_range ORDER BY chunk_no) AS source_ranges,
  list(substring(text, 1, 4000) ORDER BY chunk_no) AS texts FROM chunks GROUP BY 1, 2))"""


@query(REQUESTS_SQL + " SELECT *, '' AS provider, 0.0::DOUBLE AS temperature FROM requests")
def decision_requests(t):
    return segment.decision_requests(t.kept_chunks, t.config)


def _answers(requests: DataFrame) -> DataFrame:
    """Answers to most requests of two thirds of the transcripts, and one that fails; and answers to what nobody asks."""
    made = F.expr("transform(chunk_ids, (c, i) -> struct(c as chunk_id, if(i % 2 = 0, 'new_topic', 'continue') as action, concat('About ', c) as topic_label))")
    given = requests.filter("transcript_id % 3 < 2 and not (transcript_id % 3 = 1 and batch_no = 2)").select("request_key", made.alias("decisions"))
    failed = requests.filter("transcript_id % 3 = 1 and batch_no = 2").select("request_key", F.lit(None).cast(given.schema["decisions"].dataType).alias("decisions"))
    stale = requests.filter("batch_no = 1").select(F.concat(F.lit("old-"), "request_key").alias("request_key"), F.array().cast(given.schema["decisions"].dataType).alias("decisions"))
    return given.unionByName(failed).unionByName(stale)


@query(REQUESTS_SQL + """ SELECT request_key, transcript_id, batch_no, CASE WHEN transcript_id % 3 = 2 THEN 'open' WHEN transcript_id % 3 = 1 AND batch_no = 2 THEN 'failed' ELSE 'answered' END AS status FROM requests
UNION ALL SELECT 'old-' || request_key, NULL, NULL, 'stale' FROM requests WHERE batch_no = 1""")
def decision_status(t):
    requests = t.step(segment.decision_requests(t.kept_chunks, t.config))
    return segment.exchange_status(requests, _answers(requests))


@query("""SELECT transcript_id, chunk_id, CASE WHEN (chunk_no - 1) % 8 % 2 = 0 THEN 'new_topic' ELSE 'continue' END AS action, 'About ' || chunk_id AS topic_label FROM chunks c
WHERE transcript_id % 3 = 0 OR (transcript_id % 3 = 1 AND NOT EXISTS (SELECT 1 FROM chunks d WHERE d.transcript_id = c.transcript_id AND d.chunk_no > 8))""")
def decisions_taken(t):
    """A transcript with a failed request has no decisions."""
    requests = t.step(segment.decision_requests(t.kept_chunks, t.config))
    return segment.decisions_of(requests, _answers(requests))


@query("""SELECT transcript_id, i AS chunk_no, gj AS group_no, round(num / sqrt(q * own), 6) AS similarity FROM (
  SELECT g.transcript_id, g.i, b.group_no AS gj, sum(g.g) AS num FROM gram g JOIN groups a ON a.transcript_id = g.transcript_id AND a.chunk_no = g.i JOIN groups b ON b.transcript_id = g.transcript_id AND b.chunk_no = g.j
  WHERE b.group_no < a.group_no AND g.i = (SELECT min(chunk_no) FROM groups x WHERE x.transcript_id = a.transcript_id AND x.group_no = a.group_no) GROUP BY ALL) n
  JOIN (SELECT g.transcript_id, a.group_no AS gj, sum(CASE WHEN g.i = g.j THEN g.g ELSE 2 * g.g END) AS q FROM gram g JOIN groups a ON a.transcript_id = g.transcript_id AND a.chunk_no = g.i JOIN groups b ON b.transcript_id = g.transcript_id AND b.chunk_no = g.j AND b.group_no = a.group_no GROUP BY ALL) USING (transcript_id, gj)
  JOIN (SELECT transcript_id, i, g AS own FROM gram WHERE i = j) USING (transcript_id, i) WHERE round(num / sqrt(q * own), 9) >= 0.32""")
def related_candidates(t):
    return t.related_candidates().withColumn("similarity", F.round("similarity", 6))


@query("SELECT * FROM merged")
def merge_small_groups(t):
    return t.merged


@query("SELECT * FROM assigned")
def split_oversized(t):
    return t.assigned


@query("SELECT transcript_id, topic_id, start_page, start_line, end_page, end_line, source_ids, chunk_ids FROM spans")
def topic_spans(t):
    return topics.spans(t.topic_units).select("transcript_id", "topic_id", "start_page", "start_line", "end_page", "end_line", "source_ids", "chunk_ids")


@query("SELECT transcript_id, topic_no, question FROM questions")
def first_question(t):
    return topics.first_question(t.topic_units, turns.number_units(t.turns))


@query(f"SELECT transcript_id, turn_no, {O.label('text')} AS label FROM turns")
def normalize_label(t):
    return topics.normalized(t.kept_turns, F.col("text"), "label").select("transcript_id", "turn_no", "label")


@query("SELECT transcript_id, topic_no, topic0 AS topic FROM recs")
def topic_labels(t):
    return t.records.select(*TOPIC, "topic")


@query("SELECT transcript_id, topic_no, is_procedural, reason FROM spans")
def topic_procedural(t):
    return topics.spans(t.topic_units).select(*TOPIC, "is_procedural", "reason")


ALIKE_SQL = """, alike AS (SELECT * REPLACE ('f' || (topic_no % 3) AS fingerprint) FROM checked),
aheld AS (SELECT *, first_value(topic_no) OVER w AS h_no, first_value(topic_id) OVER w AS h_id, first_value(end_page) OVER w AS h_end, first_value(provenance_ok) OVER w AS h_ok FROM alike WINDOW w AS (PARTITION BY transcript_id, fingerprint ORDER BY topic_no)),
alinked AS (SELECT * EXCLUDE (topic0), h_no <> topic_no AND h_ok AS l, h_no <> topic_no AND h_ok AND start_page - h_end >= 4 AS later, topic0 || CASE WHEN h_no <> topic_no AND h_ok AND start_page - h_end >= 4 THEN ' (later span)' ELSE '' END AS topic FROM aheld)"""


def alike(t) -> DataFrame:
    """All topics, where every third has the same fingerprint."""
    return topics.link_recurrence(provenance.validate(t.records.withColumn("fingerprint", F.expr("concat('f', topic_no % 3)")), t.lines), t.config)


@query(ALIKE_SQL + """ SELECT 'run' AS data, transcript_id, topic_no, topic, fingerprint, recurrence_of, related_topic_ids, transition_type FROM linked UNION ALL
SELECT 'doctored', transcript_id, topic_no, topic, fingerprint, CASE WHEN later THEN h_id END, CASE WHEN l THEN [h_id] ELSE [] END, CASE WHEN l THEN 'related_distinct' ELSE 'new_topic' END FROM alinked""")
def topic_recurrence(t):
    cols = [*TOPIC, "topic", "fingerprint", "recurrence_of", "related_topic_ids", "transition_type"]
    return both(t.linked.select(*cols), alike(t).select(*cols))


@query("SELECT * FROM ev")
def topic_evidence(t):
    return topics.evidence(topics.spans(t.topic_units), t.lines, t.config.evidence_chars)


@query("SELECT transcript_id, topic_no, confidence, supporting_source_reference FROM recs0")
def topic_confidence(t):
    return t.records.select(*TOPIC, "confidence", "supporting_source_reference")


GAPS = """, silent AS (SELECT transcript_id, page, list_filter(range(1, max(line) + 1), lambda n: NOT list_contains(list(line), n)) AS s FROM lines WHERE is_testimony GROUP BY ALL),
listed AS (SELECT p.transcript_id, p.transcript_page AS page, arg_min(CASE WHEN kept THEN coalesce(m.missing_lines, []) ELSE [] END, p.pdf_page_index) AS l FROM pages p LEFT JOIN missing m USING (transcript_id, pdf_page_index)
  WHERE transcript_page IS NOT NULL GROUP BY ALL),
gaps AS (SELECT s.transcript_id, s.page, coalesce(l, []) AS missing_lines, s.s AS missing_in_canonical FROM silent s LEFT JOIN listed USING (transcript_id, page) WHERE len(s.s) > 0 OR len(coalesce(l, [])) > 0)"""
TPAGES = """, tpages AS (SELECT DISTINCT p.transcript_id, p.transcript_page AS page FROM pages p LEFT JOIN trange r USING (transcript_id) WHERE p.transcript_page IS NOT NULL
  AND CASE WHEN testimony_start IS NOT NULL AND testimony_end IS NOT NULL THEN p.transcript_page BETWEEN testimony_start AND testimony_end ELSE page_role = 'transcript' AND p.transcript_page <> 0 END)"""
WARN = """, pw AS (SELECT w.transcript_id, 2 AS part, w.pdf_page_index, row_number() OVER (PARTITION BY w.transcript_id, w.pdf_page_index ORDER BY y, warning) AS k, 'p' || coalesce(p.transcript_page::VARCHAR, 'None') || ': ' || warning AS warning
  FROM warned w JOIN pages p USING (transcript_id, pdf_page_index) WHERE p.kept),
allw AS (SELECT * FROM pw WHERE k <= 5 UNION ALL SELECT transcript_id, 1, 0, 0, warning FROM wide UNION ALL
  SELECT transcript_id, 0, pdf_page_index, 0, 'PDF page ' || (pdf_page_index + 1) || ' (' || page_role || ') has numbered lines but no ''Page N'' footer' FROM pages WHERE kept AND transcript_page IS NULL),
warnings AS (SELECT * FROM (SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY part, pdf_page_index, k, warning) AS n, warning FROM allw) WHERE n <= 200)"""


@query(GAPS + TPAGES + WARN + """ SELECT p.transcript_id, total_pdf_pages, non_testimony_roles, page_roles, extracted_pages, extracted_testimony_pages, extracted_lines, extracted_testimony_lines, testimony_pages, testimony_start, testimony_end,
  coalesce(chunks_created, 0) AS chunks_created, coalesce(gaps_detected, 0) AS gaps_detected, coalesce(duplicate_pages, 0) AS duplicate_pages, coalesce(n_warnings, 0) AS n_warnings,
  coalesce(gaps, '[]') AS gaps, coalesce(duplicate_lines, '[]') AS duplicate_lines, coalesce(warnings, []) AS warnings
FROM (SELECT transcript_id, count(*) AS total_pdf_pages, list(DISTINCT page_role ORDER BY page_role) FILTER (WHERE page_role <> 'transcript') AS non_testimony_roles FROM pages GROUP BY 1) p
LEFT JOIN (SELECT transcript_id, '{' || string_agg('"' || page_role || '":' || n, ',' ORDER BY page_role) || '}' AS page_roles FROM (SELECT transcript_id, page_role, count(*) AS n FROM pages GROUP BY 1, 2) GROUP BY 1) USING (transcript_id)
LEFT JOIN (SELECT transcript_id, list(DISTINCT page ORDER BY page) AS extracted_pages, list(DISTINCT page ORDER BY page) FILTER (WHERE is_testimony) AS extracted_testimony_pages, count(*) AS extracted_lines, count(*) FILTER (WHERE is_testimony) AS extracted_testimony_lines FROM lines GROUP BY 1) USING (transcript_id)
LEFT JOIN (SELECT transcript_id, list(page ORDER BY page) AS testimony_pages FROM tpages GROUP BY 1) USING (transcript_id) LEFT JOIN trange USING (transcript_id) LEFT JOIN (SELECT transcript_id, count(*) AS chunks_created FROM chunks GROUP BY 1) USING (transcript_id)
LEFT JOIN (SELECT transcript_id, sum((len(missing_lines) > 0)::INT + (len(missing_in_canonical) > 0)::INT)::BIGINT AS gaps_detected,
  '[' || string_agg('{"page":' || page || ',"missing_lines":[' || array_to_string(missing_lines, ',') || '],"missing_in_canonical":[' || array_to_string(missing_in_canonical, ',') || ']}', ',' ORDER BY page) || ']' AS gaps FROM gaps GROUP BY 1) USING (transcript_id)
LEFT JOIN (SELECT transcript_id, count(*) AS duplicate_pages, '[' || string_agg('{"pdf_page_index":' || pdf_page_index || coalesce(',"page":' || transcript_page, '') || ',"lines":[' || array_to_string(l, ',') || ']}', ',' ORDER BY pdf_page_index) || ']' AS duplicate_lines
  FROM (SELECT transcript_id, pdf_page_index, transcript_page, list(DISTINCT line ORDER BY line) AS l FROM dups JOIN pages USING (transcript_id, pdf_page_index) WHERE kept GROUP BY ALL) GROUP BY 1) USING (transcript_id)
LEFT JOIN (SELECT transcript_id, count(*) AS n_warnings, list(warning ORDER BY n) AS warnings FROM warnings GROUP BY 1) USING (transcript_id)""")
def completeness_report(t):
    found = completeness.report(t.pages, t.rows, t.lines, t.chunks)
    return found.withColumns({c: F.to_json(c) for c in ("gaps", "duplicate_lines", "page_roles")})


@query(GAPS + " SELECT * FROM gaps")
def line_gaps(t):
    return completeness.line_gaps(t.pages, t.rows, t.lines)


@query("SELECT transcript_id, page_role, count(*) AS n_pages FROM pages GROUP BY 1, 2")
def page_role_counts(t):
    return completeness.page_role_counts(t.pages)


@query(TPAGES + " SELECT * FROM tpages")
def testimony_pages(t):
    return completeness.testimony_pages(t.pages, t.lines)


@query(WARN + " SELECT * FROM warnings")
def extraction_warnings(t):
    return completeness.extraction_warnings(t.pages, t.rows, t.lines)


def broken(records: DataFrame) -> DataFrame:
    """Records with faults: others' evidence, unknown sources, pages past the end."""
    return records.withColumn("supporting_evidence", F.expr("case when topic_no % 2 = 0 then 'Zzyzxq qqxwvut xxkcdzz nothing whatever' else supporting_evidence end")).withColumn(
        "source_ids", F.expr("case when topic_no % 3 = 0 then concat(source_ids, array('P999:L9')) else source_ids end")).withColumn("start_page", F.expr("case when topic_no % 5 = 0 then start_page + 400 else start_page end"))


BROKEN_SQL = f""", broken AS (SELECT * REPLACE (CASE WHEN topic_no % 2 = 0 THEN 'Zzyzxq qqxwvut xxkcdzz nothing whatever' ELSE supporting_evidence END AS supporting_evidence, CASE WHEN topic_no % 3 = 0 THEN list_concat(source_ids, ['P999:L9']) ELSE source_ids END AS source_ids,
  CASE WHEN topic_no % 5 = 0 THEN start_page + 400 ELSE start_page END AS start_page) FROM recs),
{O.validated('bchecked', 'broken')}"""


@query(BROKEN_SQL + " SELECT transcript_id, topic_no, provenance_ok, provenance_notes FROM bchecked")
def provenance_validate(t):
    return provenance.validate(broken(t.records), t.lines).select(*TOPIC, "provenance_ok", "provenance_notes")


PLACES_SQL = "(VALUES " + ", ".join(f"({i}, {p}, {n})" for i, (p, n) in enumerate(PLACES)) + ") v(place_no, page, line)"
CLAMP = """SELECT transcript_id, place_no, page, line, p AS clamped_page, l AS clamped_line FROM (SELECT x.*, l.page AS p, l.line AS l, row_number() OVER (PARTITION BY x.transcript_id, place_no ORDER BY abs(l.page - x.page), l.page, abs(l.line - x.line), l.ord) AS r FROM {0} x JOIN lines l ON l.transcript_id = x.transcript_id) WHERE r = 1"""


@query(f", places AS (SELECT transcript_id, place_no, page, line FROM (SELECT DISTINCT transcript_id FROM lines) t CROSS JOIN {PLACES_SQL}) " + CLAMP.format("places"))
def clamp_boundary(t):
    places = F.array(*(F.struct(F.lit(i).alias("place_no"), F.lit(p).alias("page"), F.lit(n).alias("line")) for i, (p, n) in enumerate(PLACES)))
    return provenance.clamp(t.lines.select("transcript_id").distinct().select("transcript_id", F.explode(places).alias("x")).select("transcript_id", "x.*"), t.lines)


@query(BROKEN_SQL + f""", ends AS (SELECT transcript_id, topic_no * 2 AS place_no, start_page AS page, start_line AS line FROM bchecked WHERE NOT provenance_ok UNION ALL SELECT transcript_id, topic_no * 2 + 1, end_page, end_line FROM bchecked WHERE NOT provenance_ok),
clamped AS ({CLAMP.format('ends')}),
moved AS (SELECT b.* EXCLUDE (provenance_ok, provenance_notes) REPLACE (s.clamped_page AS start_page, s.clamped_line AS start_line, e.clamped_page AS end_page, e.clamped_line AS end_line) FROM bchecked b JOIN clamped s ON s.transcript_id = b.transcript_id AND s.place_no = b.topic_no * 2
  JOIN clamped e ON e.transcript_id = b.transcript_id AND e.place_no = b.topic_no * 2 + 1 WHERE s.clamped_page * 1000 + s.clamped_line <= e.clamped_page * 1000 + e.clamped_line),
{O.validated('mchecked', 'moved')}
SELECT transcript_id, topic_no, start_page, start_line, end_page, end_line, false AS repaired FROM bchecked WHERE provenance_ok UNION ALL SELECT transcript_id, topic_no, start_page, start_line, end_page, end_line, true FROM mchecked WHERE provenance_ok""")
def validate_topics_repair(t):
    return provenance.validate_or_repair(broken(t.records), t.lines).select(*TOPIC, "start_page", "start_line", "end_page", "end_line", "repaired")


@query("SELECT transcript_id, topic_id, topic, start_page, start_line, end_page, end_line, supporting_source_reference, supporting_evidence, source_ids, related_topic_ids, recurrence_of, is_procedural, transition_type, confidence FROM idx")
def topic_index(t):
    return t.index.select("transcript_id", *reports.PUBLIC)


@query("SELECT i.transcript_id, i.topic_no, l.source_id FROM idx i JOIN lines l ON l.transcript_id = i.transcript_id AND l.page * 1000 + l.line BETWEEN i.start_page * 1000 + i.start_line AND i.end_page * 1000 + i.end_line")
def span_source_ids(t):
    return provenance.span_lines(t.index, t.lines).select(*TOPIC, "source_id")


@query("""SELECT transcript_id, page, 'page missing' AS problem FROM (SELECT transcript_id, unnest(range(testimony_start, testimony_end + 1)) AS page FROM trange WHERE testimony_start IS NOT NULL) e WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.transcript_id = e.transcript_id AND l.page = e.page AND l.is_testimony)
UNION ALL SELECT transcript_id, page, 'lines not consecutive' FROM (SELECT transcript_id, page, list(line ORDER BY ord) AS seen FROM lines WHERE is_testimony GROUP BY 1, 2) WHERE seen <> range(1, list_max(seen) + 1)""")
def page_continuity(t):
    return completeness.page_continuity(t.lines)


@query(BROKEN_SQL + """, lost AS (SELECT transcript_id, topic_no, count(*) AS lost FROM (SELECT transcript_id, topic_no, unnest(source_ids) AS sid FROM broken) x WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.transcript_id = x.transcript_id AND l.source_id = x.sid) GROUP BY ALL),
seq AS (SELECT *, start_page * 1000 + start_line AS loc, lag(start_page * 1000 + start_line) OVER (PARTITION BY transcript_id ORDER BY start_page, start_line, end_page, end_line, topic_no) AS before FROM bchecked LEFT JOIN lost USING (transcript_id, topic_no))
SELECT transcript_id, count(*) AS topics_checked, sum(len(list_filter(provenance_notes, lambda n: n LIKE 'start does%' OR n LIKE 'end does%' OR n LIKE 'start is%')))::BIGINT AS invalid_refs, sum(coalesce(lost, 0) + CASE WHEN len(source_ids) = 0 THEN 1 ELSE 0 END)::BIGINT AS missing_sids,
  sum(CASE WHEN provenance_ok THEN 0 ELSE 1 END)::BIGINT AS evidence_mismatches, sum(CASE WHEN loc < before THEN 1 ELSE 0 END)::BIGINT AS order_violations FROM seq GROUP BY 1""")
def provenance_audit(t):
    return provenance.audit(broken(t.records), t.lines)


@query("""SELECT data, transcript_id, source_id, count(DISTINCT topic_no) AS n_topics FROM (SELECT 'run' AS data, transcript_id, topic_no, unnest(source_ids) AS source_id FROM idx UNION ALL
  SELECT 'doctored', transcript_id, topic_no, unnest(CASE WHEN topic_no % 2 = 1 THEN list_concat(source_ids, ['P2:L2', 'P3:L1']) ELSE source_ids END) FROM idx) GROUP BY 1, 2, 3 HAVING count(DISTINCT topic_no) > 1""")
def duplicate_assignments(t):
    """Of the run, and over an index in which every second topic holds two more lines."""
    doctored = t.index.withColumn("source_ids", F.expr("case when topic_no % 2 = 1 then concat(source_ids, array('P2:L2', 'P3:L1')) else source_ids end"))
    return both(provenance.duplicate_assignments(t.index), provenance.duplicate_assignments(doctored))


@query(f"""SELECT transcript_id, count(*) FILTER (WHERE contains(lower(topic), '{TERM}') OR contains(lower(supporting_evidence), '{TERM}') OR contains(lower(array_to_string(source_ids, ' ')), '{TERM}')) AS count,
  transcript_id % 2 = 0 AS transcript_available, CASE WHEN transcript_id % 2 = 1 THEN '{search.NO_TRANSCRIPT}' END AS transcript_unavailable_reason FROM idx GROUP BY 1, 3, 4""")
def filter_envelope(t):
    """With every second transcript's lines absent."""
    return search.envelope(t.index, search.filter_topics(t.index, TERM), t.lines.filter("transcript_id % 2 = 0"))


@query(f"SELECT transcript_id, topic_id, topic FROM idx WHERE contains(lower(topic), '{TERM}') OR contains(lower(supporting_evidence), '{TERM}') OR contains(lower(array_to_string(source_ids, ' ')), '{TERM}')")
def filter_topics(t):
    return search.filter_topics(t.index, TERM).select("transcript_id", "topic_id", "topic")


@query("SELECT transcript_id, topic_id, topic FROM idx WHERE NOT is_procedural")
def filter_procedural(t):
    return search.filter_topics(t.index, procedural=False).select("transcript_id", "topic_id", "topic")


@query("""SELECT 'T002' AS asked, transcript_id, topic_id FROM idx WHERE topic_id = 'T002' UNION ALL SELECT '-1', transcript_id, topic_id FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY start_page DESC, start_line DESC, end_page DESC, end_line DESC, topic_no DESC) AS r FROM idx) WHERE r = 1
UNION ALL SELECT '0', transcript_id, topic_id FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY start_page, start_line, end_page, end_line, topic_no) AS r FROM idx) WHERE r = 1""")
def topic_lookup(t):
    return reduce(DataFrame.unionByName, [search.lookup(t.index, x).select(F.lit(x).alias("asked"), "transcript_id", "topic_id") for x in ("T002", "-1", "0")])


@query(ALIKE_SQL + """ SELECT 'run' AS data, a.transcript_id, a.topic_id, r.topic_id AS related_id, r.topic AS related_topic FROM (SELECT transcript_id, topic_id, unnest(related_topic_ids) AS rid FROM idx) a JOIN idx r ON r.transcript_id = a.transcript_id AND r.topic_id = a.rid UNION ALL
SELECT 'doctored', a.transcript_id, a.topic_id, r.topic_id, r.topic FROM (SELECT transcript_id, topic_id, h_id AS rid FROM alinked WHERE provenance_ok AND l) a JOIN alinked r ON r.transcript_id = a.transcript_id AND r.topic_id = a.rid AND r.provenance_ok""")
def topic_related(t):
    return both(search.related(t.index), search.related(alike(t).filter("provenance_ok")))


@query("SELECT transcript_id, topic_no, page, line, source_id, speaker, text FROM topiclines")
def topic_source_lines(t):
    return provenance.source_lines(t.index, t.lines).select(*TOPIC, "page", "line", "source_id", "speaker", "text")


@query(O.search(QUERY, TOP))
def topic_search(t):
    return search.ranked_stored(t.postings, t.index, QUERY, TOP)


@query("""SELECT transcript_id, topic_no, topic_id, line_count, start_exists, end_exists, len(source_ids) - len(gone) AS source_ids_resolved, gone[1:20] AS missing_source_ids, len(gone) = 0 AND line_count > 0 AND start_exists AND end_exists AS ok,
  CASE WHEN len(gone) = 0 AND line_count > 0 AND start_exists AND end_exists THEN 'verified' ELSE 'failed' END AS verification_status FROM (
  SELECT i.transcript_id, i.topic_no, i.topic_id, i.source_ids, coalesce(n, 0) AS line_count, coalesce(s, false) AS start_exists, coalesce(e, false) AS end_exists, list_filter(i.source_ids, lambda x: NOT list_contains(coalesce(ids, []), x)) AS gone FROM idx i LEFT JOIN (
    SELECT t.transcript_id, t.topic_no, count(*) AS n, bool_or(t.page = start_page AND t.line = start_line) AS s, bool_or(t.page = end_page AND t.line = end_line) AS e, list(t.source_id) AS ids FROM topiclines t JOIN idx USING (transcript_id, topic_no) GROUP BY ALL) USING (transcript_id, topic_no))""")
def provenance_check(t):
    return provenance.check(t.index, t.lines)


@query(f"""SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY start_page, start_line, end_page, end_line, topic_no) AS n, CAST(to_json({{{', '.join(f"'{c}': {c}" for c in sorted(reports.PUBLIC))}}}) AS VARCHAR) AS entry FROM idx""")
def topic_index_json(t):
    return reports.json_rows(t.index)


@query("""SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY start_page, start_line, end_page, end_line, topic_no) AS n, '| ' || replace(topic, '|', '/') || ' | P' || start_page || ':L' || start_line || ' | P' || end_page || ':L' || end_line || ' | ' ||
  CASE WHEN length(supporting_evidence) > 220 THEN substring(replace(replace(supporting_evidence, '|', '/'), chr(10), ' '), 1, 217) || '...' ELSE replace(replace(supporting_evidence, '|', '/'), chr(10), ' ') END || ' |' AS row FROM idx""")
def topic_index_md_rows(t):
    return reports.markdown_rows(t.index)


@query("""SELECT p.transcript_id, total_pdf_pages, coalesce(extracted_lines, 0) AS extracted_lines, coalesce(testimony_lines, 0) AS testimony_lines, testimony_start, testimony_end, coalesce(chunks, 0) AS chunks, coalesce(topic_count, 0) AS topic_count
FROM (SELECT transcript_id, count(*) AS total_pdf_pages FROM pages GROUP BY 1) p LEFT JOIN (SELECT transcript_id, count(*) AS extracted_lines, count(*) FILTER (WHERE is_testimony) AS testimony_lines FROM lines GROUP BY 1) USING (transcript_id)
LEFT JOIN trange USING (transcript_id) LEFT JOIN (SELECT transcript_id, count(*) AS chunks FROM chunks GROUP BY 1) USING (transcript_id) LEFT JOIN (SELECT transcript_id, count(*) AS topic_count FROM idx GROUP BY 1) USING (transcript_id)""")
def run_summary(t):
    return reports.run_summary(t.index, t.lines, t.chunks, t.pages)


def _json(cols: list[str]) -> str:
    return f"""CAST(to_json({{{', '.join(f"'{c}': {c}" for c in sorted(cols))}}}) AS VARCHAR)"""


@query(f"SELECT transcript_id, count(*) AS n_topics, sha256(string_agg({_json(reports.PUBLIC)}, chr(10) ORDER BY topic_no)) AS sha256 FROM idx GROUP BY 1")
def run_fingerprint(t):
    return reports.fingerprint(t.index)


#: Artifacts of a run in its hash tree: columns, the number of a row within its transcript, and where SQL has them.
ARTIFACTS = {
    "canonical_transcript": (["transcript_id", "ord", "page", "line", "source_id", "speaker", "speaker_kind", "text", "is_testimony"], "ord", "lines"),
    "chunks": (["transcript_id", "chunk_no", "chunk_id", "source_range", "text", "source_ids"], "chunk_no", "chunks"),
    "topic_index": (["transcript_id", "topic_no", *reports.PUBLIC], "topic_no", "idx"),
    "topic_index_markdown": (["transcript_id", "n", "row"], "n", "mdrows"),
}
MD_SQL = """, mdrows AS (SELECT transcript_id, row_number() OVER (PARTITION BY transcript_id ORDER BY start_page, start_line, end_page, end_line, topic_no) AS n, '| ' || replace(topic, '|', '/') || ' | P' || start_page || ':L' || start_line || ' | P' || end_page || ':L' || end_line || ' | ' ||
  CASE WHEN length(supporting_evidence) > 220 THEN substring(replace(replace(supporting_evidence, '|', '/'), chr(10), ' '), 1, 217) || '...' ELSE replace(replace(supporting_evidence, '|', '/'), chr(10), ' ') END || ' |' AS row FROM idx)"""


def artifacts(t) -> dict[str, DataFrame]:
    made = {"canonical_transcript": t.lines, "chunks": t.kept_chunks, "topic_index": t.index, "topic_index_markdown": reports.markdown_rows(t.index)}
    return {name: df.select(*ARTIFACTS[name][0]) for name, df in made.items()}


def _tree_sql() -> str:
    steps, last = [], []
    for k, (name, (cols, order, source)) in enumerate(ARTIFACTS.items()):
        steps.append(f"""r{k} AS (SELECT transcript_id // {reports.SHELF} AS shelf, transcript_id, ({order} - 1) // {reports.LEAF} AS leaf, {order} AS place, sha256({_json(cols)}) AS h FROM {source}),
l{k} AS (SELECT shelf, transcript_id, leaf, sha256(string_agg(h, '' ORDER BY place)) AS h FROM r{k} GROUP BY ALL), t{k} AS (SELECT shelf, transcript_id, sha256(string_agg(h, '' ORDER BY leaf)) AS h FROM l{k} GROUP BY ALL),
s{k} AS (SELECT shelf, sha256(string_agg(h, '' ORDER BY transcript_id)) AS h FROM t{k} GROUP BY ALL)""")
        last += [f"SELECT '{name}' AS artifact, 'leaf' AS level, CAST(shelf AS BIGINT) AS shelf, CAST(transcript_id AS BIGINT) AS transcript_id, CAST(leaf AS BIGINT) AS leaf, h AS sha256 FROM l{k}",
                 f"SELECT '{name}', 'transcript', shelf, transcript_id, NULL, h FROM t{k}", f"SELECT '{name}', 'shelf', shelf, NULL, NULL, h FROM s{k}",
                 f"SELECT '{name}', 'root', NULL, NULL, NULL, sha256(string_agg(h, '' ORDER BY shelf)) FROM s{k} HAVING count(*) > 0"]
    return MD_SQL + ", " + ",\n".join(steps) + "\n" + "\nUNION ALL ".join(last)


@query(_tree_sql())
def run_tree(t):
    """The hash trees of a run's artifacts."""
    return reduce(DataFrame.unionByName, [reports.hash_tree(df, ARTIFACTS[name][1]).select(F.lit(name).alias("artifact"), "*") for name, df in artifacts(t).items()])


@query(MD_SQL + """ SELECT 'canonical_transcript' AS artifact, transcript_id, ord AS place, 'changed' AS side FROM lines WHERE ord % 50 = 7 UNION ALL SELECT 'chunks', transcript_id, chunk_no, 'first' FROM chunks WHERE chunk_no % 5 = 4
UNION ALL SELECT 'topic_index', transcript_id, topic_no, 'changed' FROM idx WHERE topic_no % 3 = 1 UNION ALL SELECT 'topic_index_markdown', transcript_id, n + 1000, 'second' FROM mdrows WHERE n = 2
UNION ALL SELECT DISTINCT 'completeness_report', transcript_id, 1, 'changed' FROM pages WHERE transcript_id % 2 = 0""")
def run_tree_diff(t):
    """Against a run with a planted change in each artifact."""
    one = artifacts(t) | {"completeness_report": t.step(completeness.report(t.pages, t.rows, t.lines, t.kept_chunks))}
    other = dict(one)
    other["canonical_transcript"] = one["canonical_transcript"].withColumn("text", F.expr("if(ord % 50 = 7, concat(text, ' !'), text)"))
    other["chunks"] = one["chunks"].filter("chunk_no % 5 <> 4")
    other["topic_index"] = one["topic_index"].withColumn("confidence", F.expr("if(topic_no % 3 = 1, confidence + 1, confidence)"))
    md = one["topic_index_markdown"]
    other["topic_index_markdown"] = md.unionByName(md.filter("n = 2").withColumn("n", F.col("n") + 1000))
    other["completeness_report"] = one["completeness_report"].withColumn("extracted_lines", F.expr("if(transcript_id % 2 = 0, extracted_lines + 1, extracted_lines)"))
    orders = {name: order for name, (_, order, _) in ARTIFACTS.items()} | {"completeness_report": None}
    trees = [{n: t.step(reports.hash_tree(run[n], orders[n])) for n in run} for run in (one, other)]
    return reduce(DataFrame.unionByName, [reports.changed_rows(one[n], other[n], orders[n], (trees[0][n], trees[1][n])).select(F.lit(n).alias("artifact"), "transcript_id", "place", "side") for n in one])


@query("SELECT transcript_id, topic_id, topic, start_page, start_line, end_page, end_line, 'first' AS side FROM idx WHERE topic_no % 4 = 0")
def run_diff(t):
    return reports.diff(t.index, t.index.filter("topic_no % 4 <> 0"))


@query(f"""SELECT transcript_id, count(*) AS reviewed, count(*) FILTER (WHERE ok) AS passed, round(100.0 * count(*) FILTER (WHERE ok) / count(*), 1) AS location_accuracy_pct FROM (
  SELECT *, EXISTS (SELECT 1 FROM lines l WHERE l.transcript_id = i.transcript_id AND l.page = start_page AND l.line = start_line) AND EXISTS (SELECT 1 FROM lines l WHERE l.transcript_id = i.transcript_id AND l.page = end_page AND l.line = end_line) AND start_page * 1000 + start_line <= end_page * 1000 + end_line AS ok
  FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY start_page, start_line, end_page, end_line, topic_no) - 1 AS place FROM idx) i WHERE place IN ({', '.join(map(str, O.SAMPLED))})) GROUP BY 1""")
def location_accuracy(t):
    return reports.location_accuracy(t.index, t.lines)


def _bind(f):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = Transcripts.run(spark, sf_dir)
        t.documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
        return f(t)
    return run


def queries() -> dict:
    return {name: _bind(f) for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: (O.STEPS + sql) for name, (_, sql) in REGISTRY.items() if sql}
