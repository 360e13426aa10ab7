"""The queries once more as plain SQL, for an independent engine to run over the same tables.

STEPS is a chain of named subqueries from the conversations table to the topic index; a query adds its own last SELECT.
"""

from __future__ import annotations

from ..functions.stopwords import PHRASE_STOPS, STOP_WORDS
from ..operators.reports import SAMPLED
from ..operators.turns import PROCEDURAL_PHRASES
from ..sources.adapter import ADMIN_PAGES, CLOSING, INSERTED

TOKEN = r"[\p{L}\p{N}_]{2,}"


def _s(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(xs) -> str:
    return "[" + ", ".join(_s(x).replace("\n", "' || chr(10) || '") for x in xs) + "]"


def _in(xs) -> str:
    return "(" + ", ".join(_s(x) for x in xs) + ")"


def role(raw: str, page: str, has: str) -> str:
    c = f"trim(regexp_replace({raw}, '\\s+', ' ', 'g'))"
    u = f"upper({c})"
    w = lambda *xs: " AND ".join(f"contains({u}, {_s(x)})" for x in xs)
    return f"""CASE WHEN {w('ADMINISTRATIVE INFORMATION REDACTED')} THEN 'redacted_administrative'
      WHEN regexp_matches({c}, '\\[[^\\]]+\\s-\\s[^\\]]+\\]') AND length({c}) - length(replace({c}, ':', '')) >= 15 THEN 'word_index'
      WHEN {w('FEDERAL RULES OF CIVIL PROCEDURE', 'REVIEW BY THE WITNESS')} THEN 'procedural_appendix' WHEN {w('COMPANY CERTIFICATE AND DISCLOSURE')} THEN 'reporter_certificate'
      WHEN contains({c}, 'I N D E X') OR (regexp_matches({u}, '\\bINDEX\\b') AND {w('WITNESS', 'EXAMINATION')}) THEN 'index' WHEN {w('CERTIFICATION', 'SHORTHAND REPORTER')} THEN 'csr_certificate'
      WHEN contains({c}, 'E R R A T A') OR {w('ERRATA SHEET')} OR {w('WITNESS SIGNATURE')} OR {w('SOLEMNLY DECLARE UNDER PENALTY')} THEN 'errata_declaration'
      WHEN {w('DEPOSITION CONCLUDED')} OR {w('WHEREUPON, THE DEPOSITION')} THEN 'transcript' WHEN NOT {has} THEN 'unnumbered'
      WHEN {page} <= 6 AND {w('MR.')} AND NOT contains({raw}, '      Q') THEN 'appearances_and_preliminaries' ELSE 'transcript' END"""


SKIP = "('word_index', 'procedural_appendix', 'reporter_certificate', 'redacted_administrative', 'unnumbered')"
PROC = "('ATTORNEY', 'REPORTER', 'VIDEOGRAPHER', 'PROCEEDING', 'BY')"


def reason(t: str, k: str) -> str:
    low = f"lower({t})"
    said = " OR ".join(f"contains({low}, {_s(p)})" for p in PROCEDURAL_PHRASES)
    return f"""CASE WHEN {k} IN ('REPORTER', 'VIDEOGRAPHER') THEN lower({k}) WHEN {k} = 'PROCEEDING' THEN 'parenthetical' WHEN {k} = 'ATTORNEY' AND (contains({low}, 'objection') OR contains({low}, 'form')) THEN 'objection'
      WHEN {said} THEN CASE WHEN {k} IN {PROC} THEN 'colloquy_or_procedure' WHEN contains({low}, 'objection') THEN 'objection' END END"""


def label(x: str) -> str:
    t = f"trim(regexp_replace(regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '(?i)^(okay|all right|alright|so|and|now|uh|um)[,.]?\\s+', ''), '^[-:;,. ]+', ''))"
    c = f"(CASE WHEN length({t}) > 115 THEN regexp_replace(substring({t}, 1, 115), ' [^ ]*$', '') || '...' ELSE {t} END)"
    return f"(SELECT CASE WHEN l = '' THEN 'Untitled testimony segment' ELSE upper(substring(l, 1, 1)) || substring(l, 2) END FROM (SELECT {c} AS l))"


def toks(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{TOKEN}'), lambda w: w NOT IN {_in(STOP_WORDS)})"


def terms(name: str, source: str, keys: str, text: str) -> str:
    return f"""{name}_k AS (SELECT {keys}, {toks(text)} AS k FROM {source}),
{name} AS (SELECT {keys}, term, count(*) AS tf FROM (SELECT {keys}, unnest(k) AS term FROM {name}_k UNION ALL
      SELECT {keys}, unnest(list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) FROM {name}_k WHERE len(k) > 1) GROUP BY {keys}, term)"""


def rid(sp: str, sl: str, ep: str, el: str) -> str:
    return f"CASE WHEN {sp} <> {ep} THEN 'P' || {sp} || ':L' || {sl} || '-P' || {ep} || ':L' || {el} WHEN {sl} = {el} THEN 'P' || {sp} || ':L' || {sl} ELSE 'P' || {sp} || ':L' || {sl} || '-L' || {el} END"


def pad(p: str, n: str, k: int) -> str:
    return f"'{p}' || lpad({n}::VARCHAR, greatest({k}, length({n}::VARCHAR))::INT, '0')"


def speaker(t: str) -> str:
    before, after = f"trim(split_part({t}, ':', 1))", f"CASE WHEN contains({t}, ':') THEN trim(substring({t}, instr({t}, ':') + 1)) ELSE '' END"
    the = "(?i)^THE\\s+(WITNESS|REPORTER|VIDEOGRAPHER|COURT)\\s*:"
    who = f"upper(regexp_extract({t}, '{the}', 1))"
    s = lambda a, b, c: f"struct_pack(label := {a}, kind := {b}, rest := {c})"
    return f"""CASE WHEN {t} = '' THEN {s("''", "'UNKNOWN'", "''")} WHEN regexp_matches({t}, '(?i)^BY\\s+(MR\\.|MS\\.|MRS\\.)\\s+[A-Z]') THEN {s(before, "'BY'", after)}
      WHEN regexp_matches({t}, '{the}') THEN {s(f"'THE ' || {who}", f"CASE WHEN {who} = 'COURT' THEN 'PROCEEDING' ELSE {who} END", after)}
      WHEN regexp_matches({t}, '(?i)^(MR\\.|MS\\.|MRS\\.)\\s+[A-Z][A-Z.''-]+') AND (contains(substring({t}, 1, 40), ':') OR starts_with({t}, 'MR.') OR starts_with({t}, 'MS.')) AND regexp_matches({t}, '^(MR\\.|MS\\.|MRS\\.)\\s+\\S+:') THEN {s(before, "'ATTORNEY'", after)}
      WHEN regexp_matches({t}, '^Q\\s*:') THEN {s("'Q'", "'Q'", f"trim(regexp_replace({t}, '^Q\\s*:\\s*', ''))")} WHEN regexp_matches({t}, '^A\\s*:') THEN {s("'A'", "'A'", f"trim(regexp_replace({t}, '^A\\s*:\\s*', ''))")}
      WHEN starts_with({t}, '(') THEN {s("'PROCEEDING'", "'PROCEEDING'", t)} ELSE {s("''", "'UNKNOWN'", t)} END"""


def evidence(name: str, source: str) -> str:
    return f"""{name}_in AS (SELECT t.transcript_id, t.topic_no, l.ord, l.speaker_kind IN ('Q', 'A', 'WITNESS', 'ATTORNEY') AS voiced, l.speaker, trim(l.text) AS said FROM {source} t JOIN lines l ON l.transcript_id = t.transcript_id
      AND l.page * 1000 + l.line BETWEEN t.start_page * 1000 + t.start_line AND t.end_page * 1000 + t.end_line WHERE trim(l.text) <> ''),
{name}_any AS (SELECT *, bool_or(voiced) OVER (PARTITION BY transcript_id, topic_no) AS any_voiced FROM {name}_in),
{name}_s AS (SELECT *, CASE WHEN any_voiced THEN speaker || ': ' || said ELSE said END AS s FROM {name}_any WHERE voiced OR NOT any_voiced),
{name}_b AS (SELECT *, coalesce(sum(length(s)) OVER (PARTITION BY transcript_id, topic_no ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {name}_s),
{name}_t AS (SELECT transcript_id, topic_no, string_agg(s, ' ' ORDER BY ord) AS t FROM {name}_b WHERE before <= 420 GROUP BY ALL),
{name} AS (SELECT s.transcript_id, s.topic_no, coalesce(regexp_replace(substring(t, 1, 420), ' [^ ]*$', '') || CASE WHEN length(t) > 420 THEN '…' ELSE '' END, '') AS supporting_evidence FROM {source} s LEFT JOIN {name}_t USING (transcript_id, topic_no))"""


def validated(name: str, source: str) -> str:
    at = "'[.,;:…]'"
    return f"""{name}_text AS (SELECT t.transcript_id, t.topic_no, lower(string_agg(l.text, ' ' ORDER BY l.ord)) AS span_text FROM {source} t JOIN lines l ON l.transcript_id = t.transcript_id
      AND l.page * 1000 + l.line BETWEEN t.start_page * 1000 + t.start_line AND t.end_page * 1000 + t.end_line GROUP BY ALL),
{name}_ids AS (SELECT transcript_id, topic_no, arg_min(sid, n) AS unknown FROM (SELECT transcript_id, topic_no, unnest(source_ids) AS sid, generate_subscripts(source_ids, 1) AS n FROM {source}) x
      WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.transcript_id = x.transcript_id AND l.source_id = x.sid) GROUP BY ALL),
{name}_w AS (SELECT s.*, x.span_text, i.unknown, EXISTS (SELECT 1 FROM lines l WHERE l.transcript_id = s.transcript_id AND l.page = s.start_page AND l.line = s.start_line) AS start_ok,
      EXISTS (SELECT 1 FROM lines l WHERE l.transcript_id = s.transcript_id AND l.page = s.end_page AND l.line = s.end_line) AS end_ok,
      list_filter(string_split_regex(trim(lower(supporting_evidence)), '\\s+'), lambda w: length(w) > 4)[1:12] AS said
      FROM {source} s LEFT JOIN {name}_text x USING (transcript_id, topic_no) LEFT JOIN {name}_ids i USING (transcript_id, topic_no)),
{name}_h AS (SELECT *, len(list_filter(said, lambda w: contains(coalesce(span_text, ''), regexp_replace(regexp_replace(w, '^[.,;:…]+', ''), '[.,;:…]+$', '')))) AS hits FROM {name}_w),
{name} AS (SELECT * EXCLUDE (span_text, unknown, start_ok, end_ok, said, hits), notes AS provenance_notes, len(notes) = 0 AS provenance_ok FROM (SELECT *, list_filter([
      CASE WHEN NOT start_ok THEN 'start does not exist: P' || start_page || ':L' || start_line END, CASE WHEN NOT end_ok THEN 'end does not exist: P' || end_page || ':L' || end_line END,
      CASE WHEN start_page * 1000 + start_line > end_page * 1000 + end_line THEN 'start is after end' END, CASE WHEN unknown IS NOT NULL THEN 'unknown source_id ' || unknown END,
      CASE WHEN supporting_evidence <> '' AND len(said) > 0 AND hits < greatest(1, len(said) // 4) THEN 'supporting_evidence does not match source span text' END], lambda n: n IS NOT NULL) AS notes FROM {name}_h)
      )""".replace("* EXCLUDE (span_text, unknown, start_ok, end_ok, said, hits), notes", "* EXCLUDE (span_text, unknown, start_ok, end_ok, said, hits, notes), notes")


def walk(name: str, chunks: str) -> str:
    """Recursion over the chunks of each transcript; chunks has an action column."""
    return f"""{name}_r AS (
  SELECT transcript_id, chunk_no AS i, 1 AS group_no, chunk_no AS s, start_page AS p, coalesce((SELECT g FROM gram WHERE gram.transcript_id = c.transcript_id AND gram.i = 1 AND gram.j = 1), 0) AS q FROM {chunks} c WHERE chunk_no = 1
  UNION ALL
  SELECT transcript_id, i, CASE WHEN stays THEN group_no ELSE group_no + 1 END, CASE WHEN stays THEN s ELSE i END, CASE WHEN stays THEN p ELSE page END, CASE WHEN stays THEN q + 2 * num + own ELSE own END
  FROM (SELECT *, CASE WHEN action IS NOT NULL THEN action IN ('continue', 'brief_digression') ELSE only_procedure OR (round(CASE WHEN q * own > 0 THEN num / sqrt(q * own) ELSE 0 END, 9) >= 0.18 AND page - p <= 8) END AS stays
    FROM (SELECT r.transcript_id, c.chunk_no AS i, r.group_no, r.s, r.p, r.q, c.start_page AS page, c.only_procedure, c.action,
        coalesce((SELECT sum(g) FROM gram WHERE gram.transcript_id = c.transcript_id AND gram.i = c.chunk_no AND gram.j >= r.s AND gram.j < c.chunk_no), 0) AS num,
        coalesce((SELECT g FROM gram WHERE gram.transcript_id = c.transcript_id AND gram.i = c.chunk_no AND gram.j = c.chunk_no), 0) AS own
      FROM {name}_r r JOIN {chunks} c ON c.transcript_id = r.transcript_id AND c.chunk_no = r.i + 1) y) z),
{name} AS (SELECT transcript_id, i AS chunk_no, group_no FROM {name}_r)"""


COURTESY = r"(?i)^(thank you[.,!]?|terrific[.,!]?|okay[.,!]?|sure thing[.,!]?|sure[.,!]?|correct[.,!]?|right[.,!]?|all right[.,!]?|alright[.,!]?)\s*"
CLEAN = "said"
for _ in range(3):
    CLEAN = f"trim(regexp_replace({CLEAN}, '{COURTESY}', ''))"
NW = "(CASE WHEN trim(c) = '' THEN 0 ELSE len(string_split_regex(trim(c), '\\s+')) END)"

STEPS = f"""WITH RECURSIVE
conv AS (SELECT conv_id // 20 AS transcript_id, conv_id, turn, role, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda w: w <> '') AS words FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
wrapped AS (SELECT transcript_id, conv_id, turn, role, words, unnest(range(0, greatest(1, ceil(len(words) / 10)::BIGINT))) AS wrap FROM conv),
loose AS (SELECT transcript_id, conv_id, turn, wrap, CASE WHEN wrap = 0 AND role = 'user' THEN 'Q' WHEN wrap = 0 AND role = 'assistant' THEN 'A' END AS cue,
      CASE WHEN wrap = 0 AND role = 'system' THEN 'THE REPORTER: ' ELSE '' END || array_to_string(words[wrap * 10 + 1:wrap * 10 + 10], ' ') AS text FROM wrapped
  UNION ALL SELECT transcript_id, conv_id, turn, -1, NULL, ({_list(INSERTED)})[(7 * conv_id + 13 * turn) % 29 + 1] FROM conv WHERE (7 * conv_id + 13 * turn) % 29 < {len(INSERTED)}
  UNION ALL SELECT transcript_id, conv_id, turn, -2, NULL, {_s(CLOSING)} FROM conv WHERE conv_id % 20 = 18 AND turn = 0 AND transcript_id % 2 = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY conv_id, turn, wrap) AS ord FROM loose),
printed AS (SELECT transcript_id, ord, 1 + (ord - 1) // 25 AS page, 1 + (ord - 1) % 25 AS line, cue, text,
      CASE WHEN (ord - 1) % 25 % 5 = 0 THEN lpad(((9 + ord // 240) % 24)::VARCHAR, 2, '0') || ':' || lpad(((ord // 4) % 60)::VARCHAR, 2, '0') END AS timestamp FROM placed WHERE (ord * 31 + transcript_id) % 97 <> 5),
sp AS (SELECT *, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM printed),
loose_boxes AS (SELECT transcript_id, page AS p, 70.0::DOUBLE AS x0, 50.0 + 25.0 * line AS y0, line::VARCHAR AS text FROM sp
  UNION ALL SELECT transcript_id, page, 145.5, 50.0 + 25.0 * line + 0.5, cue FROM sp WHERE cue IS NOT NULL
  UNION ALL SELECT transcript_id, page, 176.8::DOUBLE + 24.0 * (generate_subscripts(ws, 1) - 1), 50.0 + 25.0 * line, unnest(ws) FROM sp
  UNION ALL SELECT transcript_id, page, 500.0, 50.0 + 25.0 * line, CASE WHEN ord % 10 = 1 THEN '(' || timestamp || ')' ELSE timestamp END FROM sp WHERE timestamp IS NOT NULL
  UNION ALL SELECT transcript_id, page, 470.0, 50.0 + 25.0 * line, ' ' FROM sp WHERE line = 11
  UNION ALL SELECT transcript_id, page, 70.0, 50.0 + 25.0 * line + 11.0, '3' FROM sp WHERE line = 3 AND page % 7 = 0
  UNION ALL SELECT transcript_id, page, 176.8, 50.0 + 25.0 * line + 11.0, 'again' FROM sp WHERE line = 3 AND page % 7 = 0
  UNION ALL SELECT DISTINCT transcript_id, page, 450.0, 740.0, 'Page' FROM sp WHERE page % 17 <> 0
  UNION ALL SELECT DISTINCT transcript_id, page, 480.0, 740.0, page::VARCHAR FROM sp WHERE page % 17 <> 0
  UNION ALL SELECT DISTINCT transcript_id, page, 200.0, 30.0, 'CONFIDENTIAL' FROM sp WHERE page % 5 = 0),
words AS (SELECT transcript_id, p - 1 AS pdf_page_index, row_number() OVER (PARTITION BY transcript_id, p ORDER BY y0, x0, text) AS word_no, x0::DOUBLE AS x0, y0::DOUBLE AS y0, x0::DOUBLE + 20 AS x1, y0::DOUBLE + 12 AS y1, text FROM loose_boxes),
texts AS (SELECT transcript_id, page - 1 AS pdf_page_index, string_agg(line || CASE WHEN cue IS NOT NULL THEN '      ' || cue || '      ' ELSE '      ' END || text, chr(10) ORDER BY ord) || CASE WHEN page % 17 <> 0 THEN chr(10) || 'Page ' || page ELSE '' END AS raw_text FROM printed GROUP BY transcript_id, page
  UNION ALL SELECT transcript_id, p + i - 1, ({_list(ADMIN_PAGES)})[i] FROM (SELECT transcript_id, max(page) AS p FROM printed GROUP BY 1), range(1, {len(ADMIN_PAGES) + 1}) r(i)),
buckets AS (SELECT *, (round_even(y0 / 2, 0) * 2)::INT AS y FROM words WHERE trim(text) <> ''),
gathered AS (SELECT transcript_id, pdf_page_index, y, string_agg(text, ' ' ORDER BY x0, word_no) AS row_text, list(struct_pack(x0 := x0, t := text, y0 := y0) ORDER BY x0, word_no) AS ws FROM buckets GROUP BY ALL),
cols AS (SELECT *, list_filter(ws, lambda w: w.x0 <= 95) AS lefts, list_filter(ws, lambda w: w.x0 > 95 AND w.x0 < 490) AS bodies, list_filter(ws, lambda w: w.x0 >= 490) AS stamps,
      nullif(regexp_extract(row_text, '(?i)Page\\s+([0-9]+)\\s*$', 1), '')::INT AS printed FROM gathered),
foot AS (SELECT *, printed IS NOT NULL AND len(list_filter(ws, lambda w: w.x0 > 95 AND NOT (w.y0 >= 720 OR w.x0 > 400))) = 0 AND (len(list_filter(ws, lambda w: w.y0 <= 700)) = 0 OR lower(trim(row_text)) LIKE 'page %') AS is_footer, trim(lefts[1].t) AS token FROM cols),
cued AS (SELECT *, CASE WHEN NOT is_footer AND regexp_matches(token, '^[0-9]+$') AND try_cast(token AS INT) BETWEEN 1 AND 25 THEN token::INT END AS line_no,
      CASE WHEN bodies[1].t IN ('Q', 'A') AND bodies[1].x0 BETWEEN 135 AND 160 THEN bodies[1].t END AS cue FROM foot),
vrows AS (SELECT *, trim(array_to_string(list_transform(CASE WHEN cue IS NOT NULL THEN bodies[2:] ELSE bodies END, lambda w: w.t), ' ')) AS body,
      nullif(regexp_extract(stamps[1].t, '\\b([0-9]{{1,2}}:[0-9]{{2}})\\b', 1), '') AS timestamp FROM cued),
footers AS (SELECT transcript_id, pdf_page_index, arg_max(printed, y) AS transcript_page FROM vrows WHERE is_footer GROUP BY ALL),
folded AS (SELECT transcript_id, pdf_page_index, line_no AS line, coalesce(string_agg(body, ' ' ORDER BY y) FILTER (WHERE body <> ''), '') AS text, arg_max(timestamp, y) FILTER (WHERE timestamp IS NOT NULL) AS timestamp, arg_max(cue, y) FILTER (WHERE cue IS NOT NULL) AS cue
      FROM vrows WHERE line_no IS NOT NULL GROUP BY ALL),
warned AS (SELECT transcript_id, pdf_page_index, y, 'Unnumbered text at y=' || y || ': ' || substring(body, 1, 80) AS warning FROM vrows WHERE NOT is_footer AND line_no IS NULL AND body <> '' AND printed IS NULL
  UNION ALL SELECT transcript_id, pdf_page_index, y, 'Duplicate visual row for line ' || line_no FROM (SELECT *, count(*) FILTER (WHERE body <> '') OVER (PARTITION BY transcript_id, pdf_page_index, line_no ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM vrows WHERE line_no IS NOT NULL) WHERE body <> '' AND before > 0),
dups AS (SELECT transcript_id, pdf_page_index, line_no AS line, count(*) AS n_rows FROM vrows WHERE line_no IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
missing AS (SELECT transcript_id, pdf_page_index, list_filter(range(1, max(line_no) + 1), lambda n: NOT list_contains(list(line_no), n)) AS missing_lines FROM vrows WHERE line_no IS NOT NULL GROUP BY ALL),
preview AS (SELECT *, {role('raw_text', 'NULL::INT', 'true')} AS preview FROM texts),
page_in AS (SELECT p.*, f.transcript_page, EXISTS (SELECT 1 FROM vrows v WHERE v.transcript_id = p.transcript_id AND v.pdf_page_index = p.pdf_page_index AND v.line_no IS NOT NULL) AS has_lines FROM preview p LEFT JOIN footers f USING (transcript_id, pdf_page_index)),
page_roles AS (SELECT * EXCLUDE (transcript_page), transcript_page AS footer, CASE WHEN preview IN {SKIP} THEN preview ELSE {role('raw_text', 'transcript_page', 'has_lines')} END AS page_role FROM page_in),
pages AS (SELECT transcript_id, pdf_page_index, page_role, CASE WHEN preview = 'redacted_administrative' THEN pdf_page_index + 1 WHEN page_role IN {SKIP} THEN NULL ELSE footer END AS transcript_page, page_role NOT IN {SKIP} AS kept FROM page_roles),
canon AS (SELECT f.*, p.page_role, p.transcript_page AS page, row_number() OVER (PARTITION BY transcript_id ORDER BY pdf_page_index, line) AS ord FROM folded f JOIN pages p USING (transcript_id, pdf_page_index) WHERE p.kept AND p.transcript_page IS NOT NULL),
inl AS (SELECT *, trim(text) = '' AND cue IS NULL AS blank, {speaker('trim(text)')} AS own FROM canon),
sets AS (SELECT *, CASE WHEN blank THEN NULL WHEN cue IS NOT NULL THEN cue WHEN own.kind <> 'UNKNOWN' AND own.label <> '' THEN own.label END AS set_label, CASE WHEN blank THEN NULL WHEN cue IS NOT NULL THEN cue WHEN own.kind <> 'UNKNOWN' AND own.label <> '' THEN own.kind END AS set_kind FROM inl),
spoken AS (SELECT transcript_id, pdf_page_index, line, page, page_role, ord, timestamp, cue, CASE WHEN blank THEN '' ELSE coalesce(last_value(set_label IGNORE NULLS) OVER w, 'UNKNOWN') END AS speaker, CASE WHEN blank THEN 'UNKNOWN' ELSE coalesce(last_value(set_kind IGNORE NULLS) OVER w, 'UNKNOWN') END AS speaker_kind,
      CASE WHEN blank OR cue IS NOT NULL OR own.rest = '' THEN text ELSE own.rest END AS text FROM sets WINDOW w AS (PARTITION BY transcript_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
trange AS (SELECT transcript_id, testimony_start, coalesce(closing, CASE WHEN testimony_start IS NOT NULL THEN last_qa END) AS testimony_end FROM (SELECT transcript_id, arg_min(page, ord) FILTER (WHERE speaker_kind = 'Q' AND page_role = 'transcript') AS testimony_start,
      arg_max(page, ord) FILTER (WHERE contains(upper(text), 'THIS CONCLUDES TODAY') OR contains(upper(text), 'DEPOSITION CONCLUDED')) AS closing, arg_max(page, ord) FILTER (WHERE speaker_kind IN ('Q', 'A', 'WITNESS') AND page_role = 'transcript') AS last_qa FROM spoken GROUP BY 1)),
lines AS (SELECT s.*, coalesce(page_role = 'transcript' AND page BETWEEN testimony_start AND testimony_end, false) AS is_testimony, 'P' || page || ':L' || line AS source_id FROM spoken s JOIN trange USING (transcript_id)),
wide AS (SELECT transcript_id, unnest(list_filter([CASE WHEN count(*) <> count(DISTINCT source_id) THEN 'Duplicate source_id values were produced during extraction.' END, CASE WHEN NOT bool_or(is_testimony) THEN 'No testimony lines detected; check extraction.' END], lambda x: x IS NOT NULL)) AS warning FROM lines GROUP BY 1),
changes AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER w AND speaker_kind = lag(speaker_kind) OVER w THEN 0 ELSE 1 END AS fresh FROM lines WHERE is_testimony WINDOW w AS (PARTITION BY transcript_id ORDER BY ord)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY transcript_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS turn_no FROM changes),
turns AS (SELECT transcript_id, turn_no::INT AS turn_no, coalesce(nullif(arg_min(speaker, ord), ''), 'UNKNOWN') AS speaker, arg_min(speaker_kind, ord) AS speaker_kind, count(*) AS n_lines, coalesce(string_agg(nullif(trim(text), ''), ' ' ORDER BY ord), '') AS text,
      arg_min(page, ord) AS start_page, arg_min(line, ord) AS start_line, arg_max(page, ord) AS end_page, arg_max(line, ord) AS end_line, min(ord) AS first_ord, max(ord) AS last_ord, list(source_id ORDER BY ord) AS source_ids FROM runs GROUP BY transcript_id, turn_no),
reasoned AS (SELECT *, {reason('text', 'speaker_kind')} AS reason FROM turns),
opened AS (SELECT *, CASE WHEN turn_no = 1 OR (speaker_kind = 'Q' AND (bool_or(speaker_kind IN ('Q', 'A', 'WITNESS')) OVER w OR bool_and(reason IS NOT NULL OR trim(text) = '') OVER w)) THEN 1 ELSE 0 END AS opens FROM reasoned WINDOW w AS (PARTITION BY transcript_id ORDER BY turn_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
uturns AS (SELECT * EXCLUDE (opens), (sum(opens) OVER (PARTITION BY transcript_id ORDER BY turn_no ROWS UNBOUNDED PRECEDING))::INT AS unit_no FROM opened),
units0 AS (SELECT transcript_id, unit_no, arg_min(reason, turn_no) FILTER (WHERE reason IS NOT NULL) AS procedural_reason, bool_and(speaker_kind IN {PROC}) AS only_p, bool_or(speaker_kind IN ('Q', 'A', 'WITNESS')) AS has_qa, coalesce(string_agg(nullif(text, ''), ' ' ORDER BY turn_no), '') AS text, count(*) AS n_turns,
      arg_min(start_page, turn_no) AS start_page, arg_min(start_line, turn_no) AS start_line, arg_max(end_page, turn_no) AS end_page, arg_max(end_line, turn_no) AS end_line, flatten(list(source_ids ORDER BY turn_no)) AS source_ids FROM uturns GROUP BY 1, 2),
units AS (SELECT * EXCLUDE (only_p, has_qa), (only_p AND procedural_reason IS NOT NULL) OR (coalesce(procedural_reason IN ('objection', 'reporter', 'videographer', 'parenthetical'), false) AND NOT has_qa) AS is_procedural, {pad('QA', 'unit_no', 4)} AS unit_id FROM units0),
packed AS (SELECT transcript_id, unit_no, 1 AS chunk_no, length(text) AS ch, 1 AS n FROM units WHERE unit_no = 1
  UNION ALL SELECT u.transcript_id, u.unit_no, CASE WHEN p.ch >= 1800 OR p.n >= 6 THEN p.chunk_no + 1 ELSE p.chunk_no END, CASE WHEN p.ch >= 1800 OR p.n >= 6 THEN length(u.text) ELSE p.ch + length(u.text) END, CASE WHEN p.ch >= 1800 OR p.n >= 6 THEN 1 ELSE p.n + 1 END
      FROM packed p JOIN units u ON u.transcript_id = p.transcript_id AND u.unit_no = p.unit_no + 1),
numbered AS (SELECT u.*, p.chunk_no, {pad('C', 'p.chunk_no', 3)} AS chunk_id FROM units u JOIN packed p USING (transcript_id, unit_no)),
chunks0 AS (SELECT transcript_id, chunk_no, any_value(chunk_id) AS chunk_id, count(*) AS n_units, bool_and(is_procedural) AS only_procedure, string_agg('[P' || start_page || ':L' || start_line || '-P' || end_page || ':L' || end_line || '] ' || text, chr(10) ORDER BY unit_no) AS text,
      coalesce(string_agg(text, ' ' ORDER BY unit_no) FILTER (WHERE NOT is_procedural), '') AS substance, arg_min(start_page, unit_no) AS start_page, arg_min(start_line, unit_no) AS start_line, arg_max(end_page, unit_no) AS end_page, arg_max(end_line, unit_no) AS end_line, min(unit_no) AS first_unit, max(unit_no) AS last_unit,
      flatten(list(source_ids ORDER BY unit_no)) AS source_ids FROM numbered GROUP BY 1, 2),
chunks AS (SELECT * EXCLUDE (substance), {rid('start_page', 'start_line', 'end_page', 'end_line')} AS source_range, CASE WHEN trim(substance) <> '' THEN substance WHEN text <> '' THEN text ELSE 'empty' END AS corpus FROM chunks0),
{terms('cterms', 'chunks', 'transcript_id, chunk_no', 'corpus')},
vocab AS (SELECT * FROM (SELECT transcript_id, term, sum(tf)::BIGINT AS cf, row_number() OVER (PARTITION BY transcript_id ORDER BY sum(tf) DESC, term) AS rank FROM cterms GROUP BY 1, 2) WHERE rank <= 8000),
ckept AS (SELECT c.* FROM cterms c JOIN vocab USING (transcript_id, term)),
cdf AS (SELECT transcript_id, term, count(*) AS df FROM ckept GROUP BY 1, 2),
cn AS (SELECT transcript_id, count(*) AS n FROM chunks GROUP BY 1),
craw AS (SELECT c.transcript_id, c.chunk_no, c.term, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM ckept c JOIN cdf USING (transcript_id, term) JOIN cn USING (transcript_id)),
weights AS (SELECT transcript_id, chunk_no, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY transcript_id, chunk_no)) AS weight FROM craw),
gram AS (SELECT a.transcript_id, a.chunk_no AS i, b.chunk_no AS j, sum(a.weight * b.weight) AS g FROM weights a JOIN weights b ON a.transcript_id = b.transcript_id AND a.term = b.term AND a.chunk_no >= b.chunk_no GROUP BY ALL),
wchunks AS (SELECT *, NULL::VARCHAR AS action FROM chunks),
{walk('groups', 'wchunks')},
glen AS (SELECT transcript_id, group_no, sum(length(text)) AS len FROM groups JOIN chunks USING (transcript_id, chunk_no) GROUP BY 1, 2),
mrec AS (SELECT transcript_id, group_no, 1 AS merged_no, len FROM glen WHERE group_no = 1
  UNION ALL SELECT g.transcript_id, g.group_no, CASE WHEN g.len < 350 AND m.len < 6000 THEN m.merged_no ELSE m.merged_no + 1 END, CASE WHEN g.len < 350 AND m.len < 6000 THEN m.len + g.len ELSE g.len END FROM mrec m JOIN glen g ON g.transcript_id = m.transcript_id AND g.group_no = m.group_no + 1),
merged AS (SELECT transcript_id, group_no, merged_no FROM mrec),
adjacent AS (SELECT transcript_id, i AS chunk_no, g AS similarity FROM gram WHERE i = j + 1),
sized AS (SELECT c.transcript_id, c.chunk_no, m.merged_no, a.similarity, max(c.end_page) OVER w - min(c.start_page) OVER w > 10 AND count(*) OVER w > 2 AS big, row_number() OVER (w ORDER BY c.chunk_no) AS k FROM chunks c JOIN groups USING (transcript_id, chunk_no) JOIN merged m USING (transcript_id, group_no) LEFT JOIN adjacent a USING (transcript_id, chunk_no)
      WINDOW w AS (PARTITION BY c.transcript_id, m.merged_no)),
assigned AS (SELECT transcript_id, chunk_no, (sum(CASE WHEN k = 1 THEN 1 WHEN big AND round(coalesce(similarity, 0), 9) < 0.18 THEN 1 ELSE 0 END) OVER (PARTITION BY transcript_id ORDER BY chunk_no ROWS UNBOUNDED PRECEDING))::INT AS topic_no FROM sized),
tunits AS (SELECT n.*, a.topic_no FROM numbered n JOIN assigned a USING (transcript_id, chunk_no)),
spans AS (SELECT transcript_id, topic_no, {pad('T', 'topic_no', 3)} AS topic_id, arg_min(start_page, unit_no) AS start_page, arg_min(start_line, unit_no) AS start_line, arg_max(end_page, unit_no) AS end_page, arg_max(end_line, unit_no) AS end_line, count(*) AS n_units, bool_and(is_procedural) AS is_procedural,
      coalesce(arg_min(procedural_reason, unit_no) FILTER (WHERE procedural_reason IS NOT NULL), 'procedure') AS reason, string_agg(text, ' ' ORDER BY unit_no) AS text, flatten(list(source_ids ORDER BY unit_no)) AS source_ids, list(DISTINCT chunk_id ORDER BY chunk_id) AS chunk_ids FROM tunits GROUP BY 1, 2),
{terms('tterms', 'spans', 'transcript_id, topic_no', 'text')},
tcap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, topic_no ORDER BY tf DESC, term) AS rank FROM tterms) WHERE rank <= 4000),
phr AS (SELECT transcript_id, topic_no, list(term ORDER BY tf DESC, term)[1:6] AS phrases FROM tcap WHERE length(term) >= 4 AND term NOT IN {_in(PHRASE_STOPS)} GROUP BY 1, 2),
qu AS (SELECT u.transcript_id, u.topic_no, u.unit_no, u.text AS unit_text FROM tunits u WHERE NOT u.is_procedural),
qt AS (SELECT q.transcript_id, q.topic_no, q.unit_no, t.turn_no, t.speaker_kind, trim(t.text) AS said FROM qu q JOIN uturns t USING (transcript_id, unit_no) WHERE trim(t.text) <> ''),
cands AS (SELECT * FROM (SELECT transcript_id, topic_no, unit_no, 1 AS class, turn_no, {CLEAN} AS c FROM qt WHERE speaker_kind = 'Q') WHERE NOT starts_with(c, '--') AND {NW} >= 3
  UNION ALL SELECT * FROM (SELECT transcript_id, topic_no, unit_no, 2 AS class, turn_no, said AS c FROM qt WHERE speaker_kind IN ('WITNESS', 'A')) WHERE NOT starts_with(c, '--') AND {NW} >= 4
  UNION ALL SELECT * FROM (SELECT transcript_id, topic_no, unit_no, 3 AS class, 0 AS turn_no, trim(unit_text) AS c FROM qu) WHERE NOT starts_with(c, '--') AND {NW} >= 3),
bestq AS (SELECT transcript_id, topic_no, arg_min(c, unit_no::BIGINT * 1000000000 + class * 100000000 + turn_no) AS best FROM cands GROUP BY 1, 2),
questions AS (SELECT transcript_id, topic_no, coalesce(best, other) AS question FROM (SELECT transcript_id, topic_no, arg_min(text, unit_no) AS other FROM tunits GROUP BY 1, 2) LEFT JOIN bestq USING (transcript_id, topic_no)),
lab0 AS (SELECT s.*, coalesce(phrases, []) AS phrases, question, {label('question')} AS q, array_to_string(coalesce(phrases, [])[1:3], '; ') AS topical FROM spans s LEFT JOIN phr USING (transcript_id, topic_no) JOIN questions USING (transcript_id, topic_no)),
lab AS (SELECT *, CASE WHEN starts_with(lower(q), 'untitled') THEN {label("CASE WHEN topical = '' THEN 'Testimony segment' ELSE upper(substring(topical, 1, 1)) || substring(topical, 2) END")}
      WHEN topical <> '' AND NOT contains(lower(q), lower(topical)) AND length(q) <= 75 THEN {label("q || ' (' || topical || ')'")} ELSE q END AS composed FROM lab0),
recs0 AS (SELECT * EXCLUDE (composed, q, topical), CASE WHEN is_procedural THEN 'Procedural interruption (' || reason || ')' ELSE composed END AS topic0, substring(sha1(array_to_string(phrases[1:4], ' ')), 1, 10) AS fingerprint,
      round(least(0.95, 0.55 + 0.05 * ln(1 + n_units)), 3) AS confidence, 'Deposition P' || start_page || ':L' || start_line || ' - P' || end_page || ':L' || end_line AS supporting_source_reference FROM lab),
{evidence('ev', 'recs0')},
recs AS (SELECT r.*, e.supporting_evidence FROM recs0 r JOIN ev e USING (transcript_id, topic_no)),
{validated('checked', 'recs')},
held AS (SELECT *, first_value(topic_no) OVER w AS h_no, first_value(topic_id) OVER w AS h_id, first_value(end_page) OVER w AS h_end, first_value(provenance_ok) OVER w AS h_ok FROM checked WINDOW w AS (PARTITION BY transcript_id, fingerprint ORDER BY topic_no)),
linked AS (SELECT * EXCLUDE (topic0, h_no, h_id, h_end, h_ok), CASE WHEN h_no <> topic_no AND h_ok AND start_page - h_end >= 4 THEN h_id END AS recurrence_of, CASE WHEN h_no <> topic_no AND h_ok THEN [h_id] ELSE [] END AS related_topic_ids,
      CASE WHEN h_no <> topic_no AND h_ok THEN 'related_distinct' ELSE 'new_topic' END AS transition_type, topic0 || CASE WHEN h_no <> topic_no AND h_ok AND start_page - h_end >= 4 THEN ' (later span)' ELSE '' END AS topic FROM held),
idx AS (SELECT * FROM linked WHERE provenance_ok),
inspan AS (SELECT t.transcript_id, t.topic_no, l.page, l.line, l.ord, l.source_id, l.speaker, l.text, list_contains(t.source_ids, l.source_id) AS own FROM idx t JOIN lines l ON l.transcript_id = t.transcript_id AND l.page * 1000 + l.line BETWEEN t.start_page * 1000 + t.start_line AND t.end_page * 1000 + t.end_line),
topiclines AS (SELECT * EXCLUDE (own, any_own) FROM (SELECT *, bool_or(own) OVER (PARTITION BY transcript_id, topic_no) AS any_own FROM inspan) WHERE own OR NOT any_own)
"""


def search(q: str, k: int) -> str:
    return f""", sdocs AS (SELECT transcript_id, topic_no AS doc, topic || ' ' || supporting_evidence AS t FROM idx UNION ALL SELECT DISTINCT transcript_id, 0, {_s(q)} FROM idx),
{terms('sterms', 'sdocs', 'transcript_id, doc', 't')},
sdf AS (SELECT transcript_id, term, count(*) AS df FROM sterms GROUP BY 1, 2), sn AS (SELECT transcript_id, count(*) AS n FROM sdocs GROUP BY 1),
sraw AS (SELECT s.transcript_id, s.doc, s.term, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM sterms s JOIN sdf USING (transcript_id, term) JOIN sn USING (transcript_id)),
sw AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY transcript_id, doc)) AS weight FROM sraw),
ssim AS (SELECT a.transcript_id, a.doc AS topic_no, sum(a.weight * b.weight) AS s FROM sw a JOIN sw b ON a.transcript_id = b.transcript_id AND a.term = b.term AND b.doc = 0 WHERE a.doc <> 0 GROUP BY 1, 2),
srank AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY round(s, 9) DESC, topic_no) AS rank FROM ssim)
SELECT transcript_id, rank, topic_id, topic, round(s, 4) AS similarity FROM srank JOIN idx USING (transcript_id, topic_no) WHERE rank <= {k} AND s > 0"""
