import datetime
import random

from pyspark.sql import functions as F

from lexarc.operators import speakers, turns
from lexarc.streaming.turns import arriving_turns, closed_turns


def test_turns_close_across_batches(spark, tmp_path):
    schema = "transcript_id long, ord long, speaker string, speaker_kind string, text string"
    batches = [[(1, 1, "Q", "Q", "Did you"), (1, 2, "Q", "Q", "read it?")], [(1, 3, "Q", "Q", "Well?"), (1, 4, "A", "A", "Yes."), (2, 1, "Q", "Q", "Why?")], [(1, 5, "Q", "Q", "When?"), (2, 2, "", "UNKNOWN", ""), (2, 3, "A", "A", "So.")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = closed_turns(stream).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.sql("select * from closed").collect())
    assert got == [(1, 1, "Q", "Q", 3, "Did you read it? Well?"), (1, 2, "A", "A", 1, "Yes."), (2, 1, "Q", "Q", 1, "Why?"), (2, 2, "UNKNOWN", "UNKNOWN", 1, "")]


def test_shuffled_lines_give_the_turns_of_the_batch(spark, tmp_path):
    """Lines come up to eight minutes late, over batches; another transcript's much later line lets the last turns close."""
    rnd = random.Random(4)
    start = datetime.datetime(2026, 1, 5, 9, 0)
    rows = []
    for t in (1, 2):
        for i in range(120):
            cue = rnd.choice(["Q", "A", None, None, None])
            text = rnd.choice(["", "MR. STONE: Objection.", "THE WITNESS: I see.", "(Recess.)", "more of it", "and then"])
            rows.append((t, i + 1, start + datetime.timedelta(minutes=i), cue, text))
    schema = "transcript_id long, ord long, at timestamp, cue string, text string"
    arrival = sorted(rows, key=lambda r: r[2] + datetime.timedelta(minutes=rnd.uniform(0, 8)))
    batches = [arrival[k:k + 30] for k in range(0, len(arrival), 30)] + [[(9, 1, start + datetime.timedelta(hours=9), "Q", "far ahead")], [(9, 2, start + datetime.timedelta(hours=9, minutes=1), None, "still")]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i:02d}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = arriving_turns(stream).writeStream.format("memory").queryName("arrived").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = sorted(tuple(r) for r in spark.sql("select * from arrived where transcript_id < 9").collect())
    lines = speakers.carry_forward(spark.createDataFrame(rows, schema).select("transcript_id", "ord", "cue", "text")).withColumn("is_testimony", F.lit(True))
    lines = lines.selectExpr("*", "1 as page", "cast(ord as int) as line", "concat('P1:L', ord) as source_id")
    want = sorted((r.transcript_id, r.turn_no, r.speaker, r.speaker_kind, r.n_lines, r.text) for r in turns.turns(lines).collect())
    assert got == want
