"""Runs as a whole: publishing, snapshots, hash trees, stored postings, nearest places."""

import random

import pytest
from pyspark.sql import functions as F

from lexarc.operators import completeness, provenance, reports, search, segment
from lexarc.plans.pipeline import Transcripts
from lexarc.sources import artifacts


def test_a_dropped_run_begins_anew(spark, sf):
    one = Transcripts.run(spark, sf)
    assert Transcripts.run(spark, sf) is one
    n = one.rows.count()
    one.drop()
    two = Transcripts.run(spark, sf)
    assert two is not one and two.rows.count() == n
    artifacts.remove(spark, two.folder)  # the shared folder was cleared
    three = Transcripts.run(spark, sf)
    assert three is not two and three.rows.count() == n
    three.drop()


def test_snapshot_keeps_the_earlier_run_until_the_copy_is_whole(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    for name in artifacts.RUN_ARTIFACTS:
        at = f"{out}/{name}/run_name=first" if name == "topic_index" else f"{out}/{name}"
        df = spark.range(3)
        df.write.json(at) if name in artifacts.JSON_ARTIFACTS else df.write.parquet(at)
    artifacts.snapshot(spark, out, "first")
    assert artifacts.missing(spark, f"{out}/runs/first") == []
    artifacts.snapshot(spark, out, "first")  # takes its place
    artifacts.remove(spark, f"{out}/run_summary")
    with pytest.raises(Exception, match="run_summary"):
        artifacts.snapshot(spark, out, "first")
    assert artifacts.missing(spark, f"{out}/runs/first") == [] and sorted(x.name for x in (tmp_path / "out" / "runs").iterdir() if not x.name.endswith(".crc")) == ["first"]
    told = {r.artifact: (r.present, r.bytes > 0) for r in artifacts.inventory(spark, out).collect()}
    assert told["chunks"] == (True, True) and told["run_summary"] == (False, False)


def test_publish_removes_nothing_before_all_is_there(spark, tmp_path):
    new, out = str(tmp_path / "new"), str(tmp_path / "out")
    spark.range(1).write.parquet(f"{out}/a")
    spark.range(2).write.parquet(f"{new}/a")
    with pytest.raises(artifacts.ArtifactMissing):
        artifacts.publish(spark, new, out, ["a", "b"])
    assert spark.read.parquet(f"{out}/a").count() == 1
    spark.range(3).write.parquet(f"{new}/b/part=1")
    artifacts.publish(spark, new, out, ["a", "b/part=1"])
    assert spark.read.parquet(f"{out}/a").count() == 2 and spark.read.parquet(f"{out}/b").count() == 3 and not artifacts.exists(spark, new)


def test_hash_tree_opens_changed_leaves_only(spark):
    df = spark.range(5000).select((F.col("id") % 3 + 999).alias("transcript_id"), (F.col("id") / 3).cast("int").alias("n"), F.col("id").cast("string").alias("s")).withColumn("n", F.col("n") + 1)
    other = df.withColumn("s", F.expr("if(transcript_id = 1000 and n in (5, 300), 'x', s)")).filter("not (transcript_id = 1001 and n = 1600)")
    trees = reports.hash_tree(df, "n"), reports.hash_tree(other, "n")
    assert {r.level: r["count"] for r in trees[0].groupBy("level").count().collect()} == {"root": 1, "shelf": 2, "transcript": 3, "leaf": 21}
    leaves = sorted(tuple(r) for r in reports.changed_leaves(*trees).collect())
    assert leaves == [(1, 1000, 0), (1, 1000, 1), (1, 1001, 6)]
    assert sorted(tuple(r) for r in reports.changed_rows(df, other, "n").collect()) == [(1000, 5, "changed"), (1000, 300, "changed"), (1001, 1600, "first")]
    assert reports.changed_rows(df, df, "n").count() == 0 and reports.changed_leaves(reports.hash_tree(df.limit(0), "n"), reports.hash_tree(df.limit(0), "n")).count() == 0
    assert reports.changed_rows(df.limit(0), df, "n").count() == 5000


def test_fingerprint_tells_fields_apart(spark):
    cols = {"start_page": 1, "start_line": 1, "end_page": 1, "end_line": 1, "confidence": 0.5}
    row = lambda topic, ref: spark.range(1).select(F.lit(1).alias("transcript_id"), F.lit(1).alias("topic_no"), *[
        (F.lit(cols[c]) if c in cols else F.array(F.lit("a")) if c in ("source_ids", "related_topic_ids") else F.lit(topic) if c == "topic" else F.lit(ref) if c == "supporting_source_reference" else F.lit(None).cast("string")).alias(c) for c in reports.PUBLIC])
    assert reports.fingerprint(row("a|b", "c")).first().sha256 != reports.fingerprint(row("a", "b|c")).first().sha256


def test_search_reads_postings_of_its_terms_only(spark, sf, tmp_path):
    t = Transcripts.run(spark, sf)
    stored = t.postings
    best = search.ranked_stored(stored, t.index, "objection heard")
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "supporting_evidence" not in plan and "PartitionFilters: [isnotnull(bucket" in plan.replace("bucket#", "bucket") or "PartitionFilters: [bucket" in plan
    assert [tuple(r) for r in best.orderBy("transcript_id", "rank").collect()] == [tuple(r) for r in search.ranked(t.index, "objection heard").orderBy("transcript_id", "rank").collect()]
    assert search.ranked_stored(stored, t.index, "zzqqxxw").count() == 0 and search.ranked_stored(stored, t.index, "the").count() == 0  # an unknown word; stop words only


def test_nearest_places(spark):
    rnd = random.Random(1)
    lines = [(t, p, n, i) for t in (1, 2) for i, (p, n) in enumerate(sorted({(rnd.randrange(1, 40) * 2, rnd.randrange(1, 26)) for _ in range(200)}, key=lambda x: (x[0] % 10, x)))]
    lines += [(1, 4, 5, 1000), (1, 4, 5, 1001)]
    places = [(t, k, rnd.randrange(0, 90), rnd.randrange(0, 30)) for t in (1, 2, 3) for k in range(150)]
    got = {(r.transcript_id, r.place_no): (r.clamped_page, r.clamped_line) for r in provenance.clamp(spark.createDataFrame(places, "transcript_id long, place_no int, page int, line int"), spark.createDataFrame(lines, "transcript_id long, page int, line int, ord int")).collect()}
    want = {}
    for t, k, p, n in places:
        own = [x for x in lines if x[0] == t]
        if own:
            page = min({x[1] for x in own}, key=lambda q: (abs(q - p), q))
            want[t, k] = page, min((x for x in own if x[1] == page), key=lambda x: (abs(x[2] - n), x[3]))[2]
    assert got == want


def test_first_page_record_counts_skipped_pages_too(spark):
    pages = spark.createDataFrame([(1, 0, "redacted_administrative", 7, False), (1, 1, "transcript", 7, True), (1, 2, "transcript", 8, True)], "transcript_id long, pdf_page_index int, page_role string, transcript_page int, kept boolean")
    rows = spark.createDataFrame([(1, i, n, True) for i in (0, 1, 2) for n in (1, 3)], "transcript_id long, pdf_page_index int, line_no int, x boolean")
    lines = spark.createDataFrame([(1, p, n, True) for p in (7, 8) for n in (1, 2, 3)], "transcript_id long, page int, line int, is_testimony boolean")
    assert [(r.page, r.missing_lines) for r in completeness.line_gaps(pages, rows, lines).collect()] == [(8, [2])]


def test_envelope(spark):
    topics = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)], "transcript_id long, topic_no int")
    lines = spark.createDataFrame([(1,), (3,)], "transcript_id long")
    got = {r.transcript_id: (r["count"], r.transcript_available, r.transcript_unavailable_reason) for r in search.envelope(topics, topics.filter("topic_no = 1 and transcript_id < 3"), lines).collect()}
    assert got == {1: (1, True, None), 2: (1, False, search.NO_TRANSCRIPT), 3: (0, True, None)}
    assert {r.transcript_available for r in search.envelope(topics, topics, None).collect()} == {False}


def test_one_failed_batch_of_decisions(spark):
    c = spark.createDataFrame([(t, i, f"C{i:03}", f"P{i}:L1", f"text {t} {i}") for t in (1, 2, 3) for i in range(1, 11)], "transcript_id long, chunk_no int, chunk_id string, source_range string, text string")
    requests = segment.decision_requests(c)
    keys = {(r.transcript_id, r.batch_no): r.request_key for r in requests.collect()}
    assert len(set(keys.values())) == 6
    yes = lambda *ids: [(i, "continue", None) for i in ids]
    rows = [(keys[1, 1], yes("C001", "C002", "C001") + [("C002", "new_topic", "Last")]), (keys[1, 2], yes("C009")), (keys[2, 1], yes("C001")), (keys[2, 2], None), (keys[3, 1], yes("C001")), ("gone", yes("C001")), (keys[1, 2], None)]
    answers = spark.createDataFrame(rows, segment.ANSWERS)
    told = sorted((r.transcript_id or 0, r.batch_no or 0, r.status) for r in segment.exchange_status(requests, answers).collect())
    assert told == [(0, 0, "stale"), (1, 1, "answered"), (1, 2, "answered"), (2, 1, "answered"), (2, 2, "failed"), (3, 1, "answered"), (3, 2, "open")]
    got = sorted(tuple(r) for r in segment.decisions_of(requests, answers).collect())
    assert got == [(1, "C001", "continue", None), (1, "C002", "new_topic", "Last"), (1, "C009", "continue", None)]
    # a chunk that changes makes its request a new one, and the old answer stale
    changed = segment.decision_requests(c.withColumn("text", F.expr("if(transcript_id = 1 and chunk_no = 3, 'other', text)")))
    assert {r.status for r in segment.exchange_status(changed, answers).filter("transcript_id = 1 and batch_no = 1").collect()} == {"open"}
