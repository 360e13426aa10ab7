"""Hand-made cases with results that follow from the rules."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexarc.config import EngineConfig
from lexarc.operators import completeness, layout, provenance, reports, roles, search, segment, speakers, text, topics, turns
from lexarc.sources.artifacts import ArtifactMissing, load, load_or_none, stored_report


def column(spark, value, expr):
    return spark.createDataFrame([(value,)], "text string").select(expr.alias("x")).first().x


def lines_of(spark, rows):
    """rows: (cue, text), one page."""
    return spark.createDataFrame([(1, 0, 7, i + 1, "transcript", t, None, c) for i, (c, t) in enumerate(rows)], "transcript_id long, pdf_page_index int, page int, line int, page_role string, text string, timestamp string, cue string")


def test_ids(spark):
    df = spark.createDataFrame([(12, 4, 12, 4), (12, 4, 12, 12), (24, 1, 25, 25)], "a int, b int, c int, d int").withColumn("id", speakers.range_id("a", "b", "c", "d"))
    got = [(r.id, tuple(r.p)) for r in df.withColumn("p", speakers.parse_id("id")).collect()]
    assert got == [("P12:L4", (12, 4, 12, 4)), ("P12:L4-L12", (12, 4, 12, 12)), ("P24:L1-P25:L25", (24, 1, 25, 25))]
    assert column(spark, "page-12-line-4", speakers.parse_id("text")) is None
    with pytest.raises(PySparkException):
        column(spark, "page-12-line-4", speakers.parse_id("text", strict=True))


def words(spark, rows):
    return spark.createDataFrame([(1, 0, i, float(x), float(y), 0.0, 0.0, t) for i, (x, y, t) in enumerate(rows)], "transcript_id long, pdf_page_index int, word_no int, x0 double, y0 double, x1 double, y1 double, text string")


def test_rows_gather_at_even_places(spark):
    assert [r.y for r in layout.row_buckets(words(spark, [(1, 5, "a"), (1, 7, "b"), (1, 9, " ")])).orderBy("word_no").collect()] == [4, 8]


def test_cue_needs_its_place(spark):
    r = layout.rows(words(spark, [(70, 100, "1"), (176.8, 100, "A"), (70, 200, "2"), (145.5, 200, "A"), (180, 200, "Yes")])).orderBy("y").collect()
    assert [(x.cue, x.body) for x in r] == [(None, "A"), ("A", "Yes")]


@pytest.mark.parametrize("text, label, kind, rest", [("THE COURT: Sit.", "THE COURT", "PROCEEDING", "Sit."), ("MR. VAN DYKE: Hi", "", "UNKNOWN", "MR. VAN DYKE: Hi"), ("MR. BLOOD: Vague.", "MR. BLOOD", "ATTORNEY", "Vague."),
                                                     ("BY MR. STONE:", "BY MR. STONE", "BY", ""), ("(Recess.)", "PROCEEDING", "PROCEEDING", "(Recess.)"), ("Q: Why", "Q", "Q", "Why"), ("", "", "UNKNOWN", "")])
def test_inline_speaker(spark, text, label, kind, rest):
    assert tuple(column(spark, text, speakers.inline_speaker())) == (label, kind, rest)


def test_speakers_carry_forward(spark):
    got = speakers.carry_forward(speakers.with_order(lines_of(spark, [("Q", "Why"), (None, ""), (None, "more"), (None, "(Recess.)"), (None, "still")]))).orderBy("ord").collect()
    assert [(r.speaker, r.speaker_kind) for r in got] == [("Q", "Q"), ("", "UNKNOWN"), ("Q", "Q"), ("PROCEEDING", "PROCEEDING"), ("PROCEEDING", "PROCEEDING")]


def test_blank_lines_break_turns(spark):
    got = turns.turns(speakers.transcript(lines_of(spark, [("Q", "a"), (None, "b"), (None, ""), ("Q", "c"), ("A", "d")]))).orderBy("turn_no").collect()
    assert [(r.speaker, r.text) for r in got] == [("Q", "a b"), ("UNKNOWN", ""), ("Q", "c"), ("A", "d")]


@pytest.mark.parametrize("kind, text, reason", [("ATTORNEY", "I have no information.", "objection"), ("ATTORNEY", "Vague.", None), ("Q", "Let's take a break.", None), ("ATTORNEY", "Let's take a break.", "colloquy_or_procedure"), ("A", "I heard the objection.", "objection")])
def test_procedural_reason(spark, kind, text, reason):
    assert spark.createDataFrame([(text, kind)], "text string, speaker_kind string").select(turns.procedural_reason().alias("x")).first().x == reason


def test_unit_numbers(spark):
    t = spark.createDataFrame([(1, i + 1, k, "some words" if k != "UNKNOWN" else "") for i, k in enumerate(["Q", "A", "ATTORNEY", "Q", "UNKNOWN", "Q"])], "transcript_id long, turn_no int, speaker_kind string, text string")
    assert [r.unit_no for r in turns.number_units(t).orderBy("turn_no").collect()] == [1, 1, 1, 2, 2, 3]


@pytest.mark.parametrize("lengths, chunks", [([700] * 5, [1, 1, 1, 2, 2]), ([100] * 8, [1] * 6 + [2, 2]), ([1799, 1, 1], [1, 1, 2]), ([1800, 1], [1, 2]), ([5000, 5000], [1, 2])])
def test_packing(spark, lengths, chunks):
    u = spark.createDataFrame([(1, i + 1, "x" * n) for i, n in enumerate(lengths)], "transcript_id long, unit_no int, text string")
    assert [r.chunk_no for r in turns.number_chunks(u).orderBy("unit_no").collect()] == chunks


@pytest.mark.parametrize("text, label", [("  so,  what   is that? ", "What is that?"), ("And so it was", "So it was"), ("-- talking about?", "Talking about?"), ("   ", "Untitled testimony segment")])
def test_labels(spark, text, label):
    assert topics.normalized(spark.createDataFrame([(text,)], "text string"), F.col("text"), "label").first().label == label


def test_long_label_is_cut(spark):
    got = topics.normalized(spark.createDataFrame([("word " * 40,)], "text string"), F.col("text"), "label").first().label
    assert got.endswith("...") and len(got) == 117


def topic(spark, sp, sl, ep, el, ids, evidence):
    return spark.createDataFrame([(1, 1, "T001", sp, sl, ep, el, ids, evidence)], "transcript_id long, topic_no int, topic_id string, start_page int, start_line int, end_page int, end_line int, source_ids array<string>, supporting_evidence string")


def test_evidence_and_provenance(spark):
    lines = speakers.transcript(lines_of(spark, [("Q", "Did you read it?"), ("A", "Yes.")]))
    assert topics.evidence(topic(spark, 7, 1, 7, 2, ["P7:L1", "P7:L2"], ""), lines, 420).first().supporting_evidence == "Q: Did you read it? A:"
    good = topic(spark, 7, 1, 7, 2, ["P7:L1", "P7:L2"], "Q: Did you read it? A:")
    assert provenance.validate(good, lines).first().provenance_ok
    far = provenance.validate(topic(spark, 999, 1, 999, 2, ["P999:L1"], "nothing there whatever"), lines).first()
    assert not far.provenance_ok and len(far.provenance_notes) == 4
    c = provenance.check(good, lines).first()
    assert (c.line_count, c.start_exists, c.end_exists, c.verification_status) == (2, True, True, "verified")
    assert provenance.unavailable(good).first().verification_status == "unavailable"


def test_confidence(spark):
    df = spark.createDataFrame([(n,) for n in (1, 6, 30)], "n_units int").select(F.expr("round(least(0.95D, 0.55D + 0.05D * ln(1 + n_units)), 3)").alias("c"))
    assert [r.c for r in df.collect()] == [0.585, 0.647, 0.722]


def test_gap_is_found_and_tail_is_not(spark):
    rows = [("Q" if i == 0 else "A" if i == 1 else None, "some text") for i in range(17)]
    full = speakers.transcript(lines_of(spark, rows))
    assert completeness.page_continuity(full).count() == 0
    assert completeness.page_continuity(full.filter("line <> 10")).first().problem == "lines not consecutive"


def test_empty_tables(spark, sf):
    from lexarc.plans.pipeline import Transcripts
    from lexarc.sources import adapter

    printed = adapter.numbered_lines(spark.read.parquet(f"{sf}/conversations.parquet").filter("false"))
    t = Transcripts(adapter.word_boxes(printed), adapter.page_texts(printed))
    assert t.index.count() == 0 and t.chunks.count() == 0


def test_lookup_by_place(spark):
    t = spark.createDataFrame([(1, i, f"T00{i}", i, 1, i, 2) for i in (1, 2, 3)], "transcript_id long, topic_no int, topic_id string, start_page int, start_line int, end_page int, end_line int")
    assert [search.lookup(t, x).first().topic_id for x in ("T002", "0", "-1")] == ["T002", "T001", "T003"]
    assert search.lookup(t, "nothing").count() == 0


def test_artifacts(spark, tmp_path):
    assert load_or_none(spark, str(tmp_path / "none")) is None
    with pytest.raises(ArtifactMissing):
        load(spark, str(tmp_path / "none"))
    (tmp_path / "a.json").write_text('[{"chunk_id": "C001",\n "text": "x"}]')
    assert load(spark, str(tmp_path / "a.json"), "chunk_id string, text string", "json").first().chunk_id == "C001"


def test_stored_report(spark, tmp_path):
    assert stored_report(spark, str(tmp_path / "none.json")).first().available is False
    (tmp_path / "r.json").write_text('{"location_accuracy_pct": 100.0}')
    r = stored_report(spark, str(tmp_path / "r.json"), "location_accuracy_pct double").first()
    assert r.available and r.location_accuracy_pct == 100.0


def test_json_and_detail(spark, sf):
    import json

    from lexarc.plans.pipeline import Transcripts

    t = Transcripts.of(spark, sf)
    rows = json.loads(reports.json_document(t.index, 0))
    assert rows and list(rows[0]) == sorted(rows[0]) and rows[0]["topic_id"] == "T001"
    d = search.detail(t.index, t.lines, "T001")
    assert d["source_lines"].count() == len(rows[0]["source_ids"]) and search.detail(t.index, None, "T001")["transcript_available"] is False
    with pytest.raises(ValueError):
        search.ranked(t.index, "x")


def test_config():
    assert EngineConfig.from_env({"LEXARC_CHUNK_CHARS": "0", "LEXARC_CHUNK_MAX_UNITS": "3"}) == EngineConfig(chunk_max_units=3)


def test_roles(spark):
    df = spark.createDataFrame([("Administrative   information redacted",), ("I N D E X",), ("MR. STONE: hello",), ("plain words",)], "raw_text string")
    got = [r.x for r in df.select(roles.page_role("raw_text", "3", "true").alias("x")).collect()]
    assert got == ["redacted_administrative", "index", "appearances_and_preliminaries", "transcript"]


def test_walk_uses_decisions_only_with_coverage(spark):
    c = spark.createDataFrame([(1, i, f"C00{i}", False, i) for i in range(1, 5)], "transcript_id long, chunk_no int, chunk_id string, only_procedure boolean, start_page int")
    g = spark.createDataFrame([(1, i, i, 1.0) for i in range(1, 5)], "transcript_id long, i int, j int, g double")
    few = spark.createDataFrame([(1, "C002", "continue")], "transcript_id long, chunk_id string, action string")
    most = spark.createDataFrame([(1, "C002", "continue"), (1, "C003", "continue")], "transcript_id long, chunk_id string, action string")
    number = lambda d: [r.group_no for r in segment.walk(c, g, decisions=d).orderBy("chunk_no").collect()]
    assert number(None) == [1, 2, 3, 4] and number(few) == [1, 2, 3, 4] and number(most) == [1, 1, 1, 2]


def test_given_labels(spark):
    t = spark.createDataFrame([(1, "so, what is that?", ["tea", "time"], None), (2, "so, what is that?", ["tea"], "and Lunch"), (3, "", ["tea", "time"], None), (4, "", [], None)], "no int, question string, phrases array<string>, given string")
    assert {r.no: r.label for r in topics.composed_label(t).collect()} == {1: "What is that? (tea; time)", 2: "Lunch", 3: "Tea; time", 4: "Testimony segment"}


def test_runs_are_shared_until_the_input_changes(spark, sf, tmp_path):
    from lexarc.plans.pipeline import Transcripts

    turns = spark.read.parquet(f"{sf}/conversations.parquet").filter("conv_id < 2")
    turns.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    one = Transcripts.run(spark, str(tmp_path))
    assert one.lines.count() > 0 and Transcripts.run(spark, str(tmp_path)) is one
    turns.filter("conv_id < 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "conversations.parquet"))
    assert Transcripts.run(spark, str(tmp_path)) is not one
    one.drop()


def test_command_line(spark, sf, tmp_path):
    """A run leaves every artifact, and its index passes the checks."""
    from lexarc import __main__ as cli
    from lexarc.operators import provenance
    from lexarc.plans.pipeline import Transcripts
    from lexarc.sources.artifacts import missing

    t = Transcripts.of(spark, sf)
    t.words.write.parquet(str(tmp_path / "words"))
    t.texts.write.parquet(str(tmp_path / "texts"))
    out = str(tmp_path / "out")
    assert len(missing(spark, out)) == 6
    cli.main(["--words", str(tmp_path / "words"), "--texts", str(tmp_path / "texts"), "--output-dir", out, "--run-name", "first"])
    assert missing(spark, out) == [] and missing(spark, f"{out}/runs/first") == []
    kept = spark.read.json(f"{out}/runs/first/run_summary")
    assert kept.filter("ran_at is null or source is null or decision_provider <> 'none' or size(topics) <> topic_count").count() == 0 < kept.count()
    index, lines = load(spark, f"{out}/topic_index"), load(spark, f"{out}/canonical_transcript")
    assert spark.read.json(f"{out}/run_totals").first().asDict() == {
        "extracted_lines": lines.count(), "testimony_lines": lines.filter("is_testimony").count(), "chunks": load(spark, f"{out}/chunks").count(),
        "topic_count": index.count(), "procedural_topics": index.filter("is_procedural").count()}
    told = spark.read.json(f"{out}/decision_status")
    assert told.count() == told.filter("status = 'open'").count() > 0
    answers = spark.read.json(f"{out}/decision_requests").selectExpr("request_key", "transform(chunk_ids, c -> named_struct('chunk_id', c, 'action', 'continue', 'topic_label', 'All of it')) as decisions")
    answers.write.json(str(tmp_path / "answers"))
    cli.main(["--words", str(tmp_path / "words"), "--texts", str(tmp_path / "texts"), "--output-dir", str(tmp_path / "other"), "--answers", str(tmp_path / "answers")])
    assert {r.status for r in spark.read.json(str(tmp_path / "other" / "decision_status")).collect()} == {"answered"}
    decided = load(spark, str(tmp_path / "other" / "topic_index"))
    assert decided.filter("topic = 'All of it'").count() > 0
    with pytest.raises(SystemExit):
        cli.main(["--words", "w", "--texts", "t", "--output-dir", out, "--run-name", "../first"])
    index, lines = load(spark, f"{out}/topic_index"), load(spark, f"{out}/canonical_transcript")
    assert index.filter("run_name = 'first'").count() == index.count() > 0
    ids = index.selectExpr("explode(source_ids) as s")
    assert ids.count() == ids.distinct().count()
    assert {r.verification_status for r in provenance.check(index.withColumn("topic_no", F.substring("topic_id", 2, 9).cast("int")), lines).collect()} == {"verified"}


def test_decision_requests(spark):
    """Eight chunks a request, in order, each cut to a bounded length."""
    c = spark.createDataFrame([(1, i, f"C{i:03}", f"P{i}:L1", "x" * 4500 if i == 9 else "y") for i in range(10, 0, -1)], "transcript_id long, chunk_no int, chunk_id string, source_range string, text string")
    got = segment.decision_requests(c, EngineConfig(decision_provider="own", temperature=0.5)).orderBy("batch_no").collect()
    assert [(r.batch_no, r.provider, r.temperature, r.chunk_ids) for r in got] == [(1, "own", 0.5, [f"C{i:03}" for i in range(1, 9)]), (2, "own", 0.5, ["C009", "C010"])]
    assert [len(x) for x in got[1].texts] == [4000, 1]


def test_diff_sees_every_public_field(spark, sf):
    from lexarc.plans.pipeline import Transcripts

    index = Transcripts.run(spark, sf).index.cache()
    other = index.withColumn("confidence", F.expr("case when topic_no = 1 then confidence + 0.1 else confidence end"))
    n = index.filter("topic_no = 1").count()
    assert {r.side: r["count"] for r in reports.diff(index, other).groupBy("side").count().collect()} == {"first": n, "second": n}


STUB = """
class Page:
    def __init__(self, text):
        self.text = text

    def get_text(self, kind="text"):
        note(kind + ": " + self.text[:20])
        return self.text if kind == "text" else [(10.0 * k, 5.0, 10.0 * k + 8, 9.0, w, 0, 0, k) for k, w in enumerate(self.text.split())]


def note(what):
    import builtins

    with builtins.open(LOG, "a") as f:
        f.write(what + "\\n")


def open(stream, filetype):
    text = bytes(stream).decode()
    note("opened")
    return [Page(x) for x in text.split("\\n")]
"""


@pytest.fixture(scope="module")
def decoder(spark, tmp_path_factory):
    """The log of a decoder that reads one page a line, and notes each file that it opens and each page that it reads."""
    from lexarc.sources import pdf

    if pdf.decoder_available():
        pytest.skip("a real decoder is installed")
    at = tmp_path_factory.mktemp("decoder")
    (at / "pymupdf.py").write_text(f"LOG = {str(at / 'log')!r}\n{STUB}")
    spark.sparkContext.addPyFile(str(at / "pymupdf.py"))
    return at / "log"


@pytest.fixture
def files(decoder, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.pdf").write_text("1 Q Why\n2 A So")
    (tmp_path / "files" / "b.pdf").write_text("")  # holds no page
    (tmp_path / "files" / "c.pdf").write_text("only\nadministrative  information\tredacted 1 2 3")
    decoder.write_text("")
    return str(tmp_path / "files")


def test_pdf_files_are_decoded_once(spark, decoder, files):
    """Each file is opened once, and skipped pages give their text, but no words."""
    from lexarc.sources import pdf

    words, texts = pdf.tables(spark, files)
    assert sorted((r.pdf_page_index, r.raw_text) for r in texts.collect()) == [(0, "1 Q Why"), (0, "only"), (1, "2 A So"), (1, "administrative  information\tredacted 1 2 3")]
    assert [(r.pdf_page_index, r.word_no, r.x0, r.y1, r.text) for r in words.join(texts.filter("raw_text <> 'only'"), ["transcript_id", "pdf_page_index"], "left_semi").orderBy("pdf_page_index", "word_no").collect()] == [
        (0, 0, 0.0, 9.0, "1"), (0, 1, 10.0, 9.0, "Q"), (0, 2, 20.0, 9.0, "Why"), (1, 0, 0.0, 9.0, "2"), (1, 1, 10.0, 9.0, "A"), (1, 2, 20.0, 9.0, "So")]
    log = decoder.read_text().splitlines()
    assert log.count("opened") == 2 and sorted(x for x in log if x.startswith("words")) == ["words: 1 Q Why", "words: 2 A So", "words: only"]


def test_filters_reach_the_pages(spark, decoder, files):
    from lexarc.sources import pdf

    one = pdf.pages(spark, files).filter(f"path = 'file:{files}/c.pdf' and not skipped")
    assert [(r.pdf_page_index, r.raw_text, [w.text for w in r.words]) for r in one.collect()] == [(0, "only", ["only"])]
    assert decoder.read_text().splitlines() == ["opened", "text: only", "words: only", "text: administrative  info"]
    decoder.write_text("")
    second = pdf.pages(spark, files, words=False).filter("pdf_page_index >= 1")
    assert sorted((r.raw_text, r.skipped, r.words) for r in second.collect()) == [("2 A So", False, None), ("administrative  information\tredacted 1 2 3", True, None)]
    assert sorted(decoder.read_text().splitlines()) == ["opened"] * 2 + ["text: 2 A So", "text: administrative  info"]


def test_pages_of_every_reader_are_the_same(spark, decoder, files):
    """Files in several shares, and files that only Spark's reader opens."""
    from lexarc.sources import pdf

    rows = lambda df: sorted((r.path, r.pdf_page_index, r.raw_text, r.skipped, r.words) for r in df.collect())
    whole = rows(pdf.pages(spark, files).filter("words is not null"))
    shared = spark.read.format("transcript_pages").option("path", files).option("split_bytes", "5").load()
    assert shared.rdd.getNumPartitions() > 3
    assert len(whole) == 3 and rows(shared.filter("words is not null")) == whole == rows(pdf.pages(spark, files + "/*.pdf").filter("words is not null"))
    assert [r.raw_text for r in pdf.pages(spark, files).filter("path = 'none'").collect()] == []


def test_skipped_pages_agree_with_their_roles(spark):
    from lexarc.operators.roles import SKIPPED, page_role
    from lexarc.sources.pages import skipped

    index = "[a\u00a0- b] [cat -\tdog]" + " 1:2" * 15
    texts = ["", "plain", "Administrative information\nredacted", "administrative informationredacted", index, index[:-1].replace(":2", "", 1), index.replace("cat -\tdog", "cat"), index.replace("\t", "\u00a0"),
             "Federal Rules of Civil Procedure", "federal rules of civil  procedure: review by the witness", "COMPANY CERTIFICATE AND DISCLOSURE STATEMENT", "I N D E X"]
    rows = spark.createDataFrame([(x,) for x in texts], "raw_text string").select("raw_text", page_role("raw_text", "cast(null as int)", "true").alias("role")).collect()
    assert [skipped(r.raw_text) for r in rows] == [r.role in SKIPPED for r in rows] and sum(skipped(x) for x in texts) == 4


def test_terms_of_rows_that_share_a_key(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (1, "alpha gamma"), (None, "beta"), (None, "beta beta"), (2, ""), (3, None), (4, "alpha")], "k int, t string")
    got = {(r.k, r.term): r.tf for r in text.term_counts(docs, ["k"], "t").collect()}
    assert got == {(1, "alpha"): 3, (1, "beta"): 1, (1, "alpha beta"): 1, (1, "beta alpha"): 1, (1, "gamma"): 1, (1, "alpha gamma"): 1, (None, "beta"): 3, (None, "beta beta"): 1, (4, "alpha"): 1}
    phrases = text.keyphrases(docs, ["k"], "t", 2, 10).collect()
    assert sorted((r.k or 0, r.phrases) for r in phrases) == [(0, ["beta"]), (0, ["beta", "beta beta"]), (1, ["alpha", "alpha beta"]), (1, ["alpha", "alpha gamma"]), (4, ["alpha"])]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "beta gamma")], "g int, d int, t string")
    assert "Exchange" not in plan_of(text.term_counts(docs, ["d"], "t"))
    assert "Exchange" not in plan_of(text.keyphrases(docs, ["d"], "t", 2, 10))
    assert plan_of(text.tfidf(docs, ["g"], "d", "t", 10)).count("Exchange hashpartitioning") == 1


def test_page_text_is_put_on_one_line_once(spark):
    texts = spark.createDataFrame([(1, 0, "Page 1")], "transcript_id long, pdf_page_index int, raw_text string")
    rows = layout.rows(words(spark, [(70, 100, "1"), (176.8, 100, "A")]))
    plan = roles.classify(texts, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(raw_text") == 1


def test_lines_are_made_once_for_their_testimony(spark):
    plan = plan_of(speakers.transcript(lines_of(spark, [("Q", "Is it?"), ("A", "Yes.")])))
    assert "Join" not in plan


def test_page_texts_are_made_in_one_pass(spark, sf):
    from lexarc.plans.pipeline import Transcripts

    t = Transcripts.of(spark, sf)
    assert plan_of(t.texts).count("Exchange hashpartitioning") == 1
    assert not {"words", "left", "body_all", "stamps"} & set(t.rows.columns)
