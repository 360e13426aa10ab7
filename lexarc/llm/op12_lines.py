"""Line dedup with DataFrame functions only.

Every text is cut at line feeds. A line's key is the line without blanks at its ends and with A-Z in lower case, and goes
by a 128-bit hash. Keys long enough are counted by documents; where enough documents hold one, its lines stay in the
document of the smallest id and go in all others. Texts are put together again by position.

Only hashes, ids and positions pass through the first shuffles: a partial aggregate finds the least and the greatest id of
each key, a join deals keys of very many lines to slots, and the positions that go meet their document's text at last.

A null text is an empty one, and has one empty line. Rows without an id neither count as documents nor lose lines. Rows that
share an id are one document: a line that two of them repeat is no repetition, and each of them loses what the document
loses; equal rows give equal results. Of ties there are none: the smallest id is one id. An empty table gives no row. Columns
other than the two are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_spread, read

#: Code points of a key that counts, and documents that must hold it.
MIN_CHARS, MIN_DOCS = 10, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(" \t\n\x0b\f\r"))
    # lower() would change letters outside A-Z too, so it serves lines of single bytes only
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def dedup_lines(docs: DataFrame, scratch: Scratch, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, text) for every row of docs; text is what stays."""
    if min_docs < 2:
        raise ValueError("min_docs is 2 at least")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    known = rows.filter("id is not null").withColumn("body_hash", F.xxhash64("body"))
    # no line is longer than its text
    lines = known.filter(F.length("body") >= min_chars).select("id", "body_hash", F.posexplode(F.split("body", "\n", -1)).alias("at", "line"))
    lines = lines.select("id", "body_hash", "at", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars).select(
        "id", "body_hash", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(12), "key").alias("h2"))
    shared = scratch.keep(lines.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n")).filter("first_id < last_id").drop("last_id"))
    if min_docs > 2:
        pairs = join_spread(lines.select("id", "h1", "h2"), shared, ["h1", "h2"], "n").groupBy("h1", "h2", "id").agg(F.count("*").alias("n"))
        shared = scratch.keep(pairs.groupBy("h1", "h2").agg(F.min("id").alias("first_id"), F.sum("n").alias("n"), F.count("*").alias("docs")).filter(f"docs >= {min_docs}").drop("docs"))
    gone = join_spread(lines, shared, ["h1", "h2"], "n").filter("id <> first_id").groupBy("id", "body_hash").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    held = known.join(gone, ["id", "body_hash"], "left").select("id", "body", "gone").unionByName(rows.filter("id is null").withColumn("gone", F.lit(None).cast("array<int>")))
    # what stays are the runs of lines before, between and after those that go
    x = held.select("id", "body", F.split("body", "\n", -1).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    run = F.expr("""flatten(transform(sequence(0, size(gone)), i -> transform(array(if(i = 0, 0, gone[i - 1] + 1)), b -> slice(lines, b + 1, if(i = size(gone), size(lines), gone[i]) - b))[0]))""")
    return x.select("id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
                    F.when(F.size("gone") == 0, F.col("body")).otherwise(F.array_join(run, "\n")).alias("text"))


def op12_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(read(spark, sf_dir, "documents"), Scratch(spark, "lines"))
    return got.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


SQL_OP12 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS place, unnest(lines) AS line FROM d),
k AS (SELECT r, doc_id, place, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.*, s.first_id IS NOT NULL AND doc_id IS NOT NULL AND doc_id <> s.first_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""

QUERIES, SQL = {"op12_lines": op12_lines}, {"op12_lines": SQL_OP12}
