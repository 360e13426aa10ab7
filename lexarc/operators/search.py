"""The query service: filters, lookups and ranked search over topic indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import text as T


def filter_topics(topics: DataFrame, q: str | None = None, procedural: bool | None = None) -> DataFrame:
    """Topics whose label, evidence or sources contain q, whatever its case; procedural ones, others, or both."""
    if procedural is not None:
        topics = topics.filter(F.col("is_procedural") == F.lit(procedural))
    if q:
        low = F.lit(q.lower())
        topics = topics.filter(F.contains(F.lower("topic"), low) | F.contains(F.lower("supporting_evidence"), low) | F.contains(F.lower(F.array_join("source_ids", " ")), low))
    return topics


def lookup(topics: DataFrame, topic_id: str) -> DataFrame:
    """In each transcript the topic with this id; if there is none and it is an integer, the topic at this place, counted from the end if negative."""
    w = W.partitionBy("transcript_id")
    x = topics.withColumn("named", F.max(F.col("topic_id") == F.lit(topic_id)).over(w))
    try:
        place = int(topic_id)
    except ValueError:
        return x.filter(F.col("topic_id") == F.lit(topic_id)).drop("named")
    x = x.withColumn("n", F.count("*").over(w)).withColumn("at", F.row_number().over(w.orderBy("start_page", "start_line", "end_page", "end_line", "topic_no")) - 1)
    return x.filter(F.when(F.col("named"), F.col("topic_id") == F.lit(topic_id)).otherwise(F.col("at") == (F.lit(place) if place >= 0 else F.col("n") + F.lit(place)))).drop("named", "n", "at")


def related(topics: DataFrame) -> DataFrame:
    """(transcript_id, topic_id, related_id, related_topic)."""
    other = topics.select("transcript_id", F.col("topic_id").alias("related_id"), F.col("topic").alias("related_topic"))
    return topics.select("transcript_id", "topic_id", F.explode("related_topic_ids").alias("related_id")).join(other, ["transcript_id", "related_id"])


def detail(topics: DataFrame, lines: DataFrame | None, topic_id: str) -> dict[str, DataFrame | bool]:
    """A topic of each transcript, the topics related to it, and its source lines; without a transcript no lines."""
    from .provenance import source_lines

    one = lookup(topics, topic_id)
    return {"topic": one, "related": related(topics).join(one.select("transcript_id", "topic_id"), ["transcript_id", "topic_id"], "left_semi"),
            "source_lines": source_lines(one, lines) if lines is not None else one.limit(0), "transcript_available": lines is not None}


#: Folders that postings are kept in, by a hash of the term.
POSTING_BUCKETS = 64


def postings(topics: DataFrame) -> DataFrame:
    """(bucket, transcript_id, term, topic_no, tf, df, n, square): an inverted index over topic names and evidence.

    df counts the topics of the transcript that hold the term, n all of them. square is the squared length of the topic's
    weights once a query has become one more document and none of its terms is the topic's.
    """
    docs = topics.select("transcript_id", "topic_no", F.concat_ws(" ", "topic", "supporting_evidence").alias("t"))
    counts = T.row_term_counts(docs, ["transcript_id", "topic_no"], "t")
    x = counts.join(counts.groupBy("transcript_id", "term").agg(F.count("*").alias("df")), ["transcript_id", "term"]).join(docs.groupBy("transcript_id").agg(F.count("*").alias("n")), "transcript_id")
    x = x.withColumn("square", F.sum(F.expr("pow(tf * (ln((2 + n) / (1 + df)) + 1), 2)")).over(W.partitionBy("transcript_id", "topic_no")))
    return x.select("transcript_id", "term", "topic_no", "tf", "df", "n", "square", _bucket(F.col("term")).alias("bucket"))


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(POSTING_BUCKETS)).cast("int")


def ranked_stored(stored: DataFrame, topics: DataFrame, q: str, k: int = 8) -> DataFrame:
    """The k topics of each transcript nearest to q, by stored postings; term weights come from its topics and the query together.

    Only the query's own terms are read. As the query counts as a document, its terms occur in one more; a topic's length is
    set right by the terms that both have, and of the topics themselves only names are read.
    """
    if len(q) < 2:
        raise ValueError("a query has at least two characters")
    # one row a term of the query
    asked = T.row_term_counts(topics.sparkSession.range(1).withColumn("q", F.lit(q)), ["id"], "q")
    asked = asked.select("term", F.col("tf").alias("tq"), _bucket(F.col("term")).alias("b")).collect()
    buckets, terms, total = sorted({r.b for r in asked}), sorted(r.term for r in asked), sum(r.tq * r.tq for r in asked)
    hits = stored.filter(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    tq = F.create_map(*[x for r in asked for x in (F.lit(r.term), F.lit(r.tq))])[F.col("term")] if asked else F.lit(0)
    hits = hits.withColumn("tq", tq).withColumn("idf", F.expr("ln((2 + n) / (2 + df)) + 1")).withColumn("idf_alone", F.expr("ln((2 + n) / (1 + df)) + 1"))
    # terms that no topic holds occur in the query only
    mine = hits.select("transcript_id", "term", "tq", "idf", F.expr("ln((2 + n) / 2) + 1").alias("idf_new")).distinct().groupBy("transcript_id").agg(
        F.expr(f"sum(tq * tq * (idf * idf - idf_new * idf_new)) + {total} * max(idf_new * idf_new)").alias("q_square"))
    sim = hits.groupBy("transcript_id", "topic_no").agg(F.expr("sum(tf * idf * tq * idf)").alias("dot"), F.expr("max(square) + sum(tf * tf * (idf * idf - idf_alone * idf_alone))").alias("d_square"))
    sim = sim.join(mine, "transcript_id").select("transcript_id", "topic_no", F.expr("dot / sqrt(d_square * q_square)").alias("s"))
    w = W.partitionBy("transcript_id").orderBy(F.desc(F.round("s", 9)), "topic_no")
    best = sim.withColumn("rank", F.row_number().over(w)).filter((F.col("rank") <= k) & (F.col("s") > 0))
    return topics.select("transcript_id", "topic_no", "topic_id", "topic").join(best, ["transcript_id", "topic_no"]).select("transcript_id", "rank", "topic_id", "topic", F.round("s", 4).alias("similarity"))


def ranked(topics: DataFrame, q: str, k: int = 8) -> DataFrame:
    """ranked_stored, by postings made for this search."""
    return ranked_stored(postings(topics), topics, q, k)


# Fixed value: why an answer has no lines.
NO_TRANSCRIPT = "The canonical transcript is not available, so source lines and checks against them are not."


def envelope(topics: DataFrame, found: DataFrame, lines: DataFrame | None) -> DataFrame:
    """(transcript_id, count, transcript_available, transcript_unavailable_reason): what goes with the topics found, of every transcript that has topics."""
    all_ids = topics.select("transcript_id").distinct()
    counts = found.groupBy("transcript_id").agg(F.count("*").alias("count"))
    x = all_ids.join(counts, "transcript_id", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    if lines is None:
        x = x.withColumn("there", F.lit(False))
    else:
        x = x.join(lines.select("transcript_id").distinct().withColumn("there", F.lit(True)), "transcript_id", "left")
    there = F.coalesce("there", F.lit(False))
    return x.select("transcript_id", "count", there.alias("transcript_available"), F.when(~there, F.lit(NO_TRANSCRIPT)).alias("transcript_unavailable_reason"))
