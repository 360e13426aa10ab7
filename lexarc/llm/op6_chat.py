"""Chat formatting with multi-party perspective rotation.

Each dialogue is rendered once for every participant: that speaker's turns become the assistant's, the others are named
users, and system turns stay as they are. Masks are the character spans of the assistant's words with their end marks.

Turns go by number (nulls first), then role, then text; repeated rows stay. A null role is a participant of its own, shown as
`unknown` like one of that name, and a null text is empty. Rows without a conversation id belong to no dialogue and are left
out. A dialogue with system turns only has no participant, and no row. Markup inside a text or a role is broken up, and line
breaks in a role become blanks, so that neither can close or forge a turn. Columns other than the four are not read, whatever
their names. Dialogues may have any number of turns and participants; the pieces of a dialogue meet only in the row that
holds its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import read

BEGIN, END = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, n_turns, n_masked, text, spans array<struct<start, end>>) of turns(conv_id, turn, role, text)."""
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    t = turns.filter("conv_id is not null").select("conv_id", "turn", F.coalesce(F.concat(F.lit("="), "role"), F.lit("")).alias("role"), plain(F.coalesce("text", F.lit(""))).alias("body"))
    name = lambda c: F.when(F.col(c) == "", F.lit("unknown")).otherwise(plain(F.regexp_replace(F.substr(c, F.lit(2)), r"[\r\n]+", " ")))
    people = t.filter("role <> '=system'").select("conv_id", F.col("role").alias("who")).distinct()
    each = t.join(people, "conv_id").withColumn("own", F.col("role") == F.col("who"))
    head = F.concat(F.lit(BEGIN), F.when(F.col("own"), F.lit("assistant")).when(F.col("role") == "=system", F.lit("system")).otherwise(F.concat(F.lit("user name="), name("role"))), F.lit("\n"))
    order = W.partitionBy("conv_id", "who").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    placed = each.select("conv_id", "who", "own", "turn", "role", "body", head.alias("head")).withColumn("n", F.row_number().over(order)).withColumn(
        "size", F.length("head") + F.length("body") + F.lit(len(END) + 1)).withColumn("ends", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    start = F.col("ends") - F.lit(len(END) + 1) - F.length("body")
    return placed.groupBy("conv_id", "who").agg(
        F.count("*").alias("n_turns"), F.sum(F.col("own").cast("long")).alias("n_masked"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat("head", "body", F.lit(END + "\n")).alias("s")))), lambda x: x["s"]), "").alias("text"),
        F.array_sort(F.collect_list(F.when(F.col("own"), F.struct(start.alias("start"), (F.col("ends") - 1).alias("end"))))).alias("spans")).withColumn("perspective", name("who")).select("conv_id", "perspective", "n_turns", "n_masked", "text", "spans")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rotate(read(spark, sf_dir, "conversations"))
    return got.select("conv_id", "perspective", "n_turns", "n_masked", "text", F.array_join(F.transform("spans", lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias("masks"))


SQL_OP6 = rf"""
WITH t AS (SELECT conv_id, turn, coalesce('=' || role, '') AS role, CASE WHEN role IS NULL THEN 'unknown' ELSE replace(regexp_replace(role, '[\r\n]+', ' ', 'g'), '<|', '< |') END AS name, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations WHERE conv_id IS NOT NULL),
e AS (SELECT t.*, p.who, p.perspective, t.role = p.who AS own,
        '{BEGIN}' || CASE WHEN t.role = p.who THEN 'assistant' WHEN t.role = '=system' THEN 'system' ELSE 'user name=' || t.name END || chr(10) AS head
      FROM t JOIN (SELECT DISTINCT conv_id, role AS who, name AS perspective FROM t WHERE role <> '=system') p USING (conv_id)),
s AS (SELECT *, row_number() OVER w AS n, sum(length(head) + length(body) + {len(END) + 1}) OVER (w ROWS UNBOUNDED PRECEDING) AS ends
      FROM e WINDOW w AS (PARTITION BY conv_id, who ORDER BY turn NULLS FIRST, role, body))
SELECT conv_id, perspective, count(*) AS n_turns, CAST(sum(CASE WHEN own THEN 1 ELSE 0 END) AS BIGINT) AS n_masked,
       string_agg(head || body || '{END}' || chr(10), '' ORDER BY n) AS text,
       string_agg(CAST(ends - {len(END) + 1} - length(body) AS BIGINT) || '-' || CAST(ends - 1 AS BIGINT), ',' ORDER BY n) FILTER (WHERE own) AS masks
FROM s GROUP BY conv_id, who, perspective
"""

QUERIES, SQL = {"op6_chat": op6_chat}, {"op6_chat": SQL_OP6}
