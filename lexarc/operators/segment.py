"""Chunks to topics: the walk along a transcript, small groups merged, long ones split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import EngineConfig
from . import text as T
from .chains import Keep, first_reach, keep_table, running, runs

# Chunks in a request for decisions, and characters of each.
REQUEST_CHUNKS, REQUEST_CHARS = 8, 4000
#: Chunks and characters up to which a transcript is compared at once; the products of longer ones are joins over their terms.
SHORT_CHUNKS, SHORT_CHARS = 256, 1 << 22


def chunk_weights(c: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    return T.tfidf(c, ["transcript_id"], "chunk_no", "corpus", config.segment_vocabulary)


def chunk_gram(c: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    return T.gram(chunk_weights(c, config), ["transcript_id"], "chunk_no")


def long_transcripts(c: DataFrame, chunks: int = SHORT_CHUNKS, chars: int = SHORT_CHARS) -> DataFrame:
    """(transcript_id) of those that aren't bounded in chunks and text."""
    n = c.groupBy("transcript_id").agg(F.count("*").alias("n"), F.sum(F.length("corpus")).alias("chars"))
    return n.filter(f"n > {chunks} or chars > {chars}").select("transcript_id")


def short_gram(c: DataFrame, long: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(transcript_id, i, j, g), as chunk_gram has it, of all transcripts but the long ones."""
    return T.short_gram(c.join(long, "transcript_id", "left_anti"), "transcript_id", "chunk_no", "corpus", config.segment_vocabulary)


def band_of(c: DataFrame, g: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The products of a gram that band_gram has."""
    t, p = "transcript_id", _pages(c)
    x = g.join(p.select(t, F.col("chunk_no").alias("i"), "low"), [t, "i"]).join(p.select(t, F.col("chunk_no").alias("j"), "top"), [t, "j"])
    return x.filter(f"low - top <= {config.max_pages_continue} or i = j + 1").select(t, "i", "j", "g")


def adjacent_similarity(g: DataFrame) -> DataFrame:
    """(transcript_id, chunk_no, similarity) with the chunk before; rows of unit length make products cosines."""
    return g.filter("i = j + 1").select("transcript_id", F.col("i").alias("chunk_no"), F.col("g").alias("similarity"))


def _pages(c: DataFrame) -> DataFrame:
    """(transcript_id, chunk_no, page, low, top): the least page from a chunk on, and the greatest one up to it.

    Both never fall along a transcript, also where printed page numbers do.
    """
    x = c.select("transcript_id", "chunk_no", F.col("start_page").alias("page"))
    x = running(x, ["transcript_id"], "chunk_no", F.col("page"), "low", "min", backwards=True)
    return running(x, ["transcript_id"], "chunk_no", F.col("page"), "top", "max")


def _near(a: DataFrame, b: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Rows of a(keys, i, low, top_i) with those of b(keys, j, top) that are no more than limit pages before; met by page buckets."""
    width = limit + 1
    late = a.withColumn("bucket", F.explode(F.expr(f"sequence(cast(floor((low - {limit}) / {width}) as int), cast(floor(top_i / {width}) as int))")))
    early = b.withColumn("bucket", F.expr(f"cast(floor(top / {width}) as int)"))
    return late.join(early, [*keys, "bucket"]).filter(f"j <= i and low - top <= {limit}").drop("bucket")


def band_pairs(c: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(transcript_id, i, j): a chunk with itself and with the chunks before that a topic can hold together with it by its pages."""
    p = _pages(c)
    a = p.select("transcript_id", F.col("chunk_no").alias("i"), "low", F.col("top").alias("top_i"))
    return _near(a, p.select("transcript_id", F.col("chunk_no").alias("j"), "top"), ["transcript_id"], config.max_pages_continue).select("transcript_id", "i", "j")


def band_gram(c: DataFrame, weights: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(transcript_id, i, j, g) for the pairs of the band, and of neighbours over any gap, whose rows share a term."""
    t, limit = "transcript_id", config.max_pages_continue
    p = _pages(c)
    w = weights.join(p.drop("page"), [t, "chunk_no"])
    a = w.select(t, "term", F.col("chunk_no").alias("i"), "low", F.col("top").alias("top_i"), F.col("weight").alias("wi"))
    b = w.select(t, "term", F.col("chunk_no").alias("j"), "top", F.col("weight").alias("wj"))
    near = _near(a, b, [t, "term"], limit)
    leap = p.select(t, F.col("chunk_no").alias("i"), "low").join(p.select(t, F.col("chunk_no").alias("j"), (F.col("chunk_no") + 1).alias("i"), "top"), [t, "i"]).filter(f"low - top > {limit}").select(t, "i", "j")
    far = leap.join(a.select(t, "i", "term", "wi"), [t, "i"]).join(b.select(t, "j", "term", "wj"), [t, "j", "term"])
    cols = [t, "i", "j", "wi", "wj"]
    return near.select(*cols).unionByName(far.select(*cols)).groupBy(t, "i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("g"))


def _actions(c: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """(transcript_id, chunk_no, chunk_id, only, page, action): decisions count where they cover half of a transcript's chunks."""
    d = c.select("transcript_id", "chunk_no", "chunk_id", F.col("only_procedure").alias("only"), F.col("start_page").alias("page"))
    if decisions is None:
        return d.withColumn("action", F.lit(None).cast("string"))
    covered = decisions.join(c.select("transcript_id", "chunk_id"), ["transcript_id", "chunk_id"]).groupBy("transcript_id").agg(F.count_distinct("chunk_id").alias("covered"))
    total = c.groupBy("transcript_id").agg(F.count("*").alias("total"))
    usable = covered.join(total, "transcript_id").filter("covered >= greatest(1, total div 2)").select("transcript_id")
    return d.join(decisions.join(usable, "transcript_id", "left_semi").select("transcript_id", "chunk_id", F.coalesce("action", F.lit("new_topic")).alias("action")), ["transcript_id", "chunk_id"], "left")


def walk(c: DataFrame, g: DataFrame, config: EngineConfig = EngineConfig(), decisions: DataFrame | None = None, keep: Keep = keep_table) -> DataFrame:
    """(transcript_id, chunk_no, group_no), by the products of band_gram.

    An open topic is the run of chunks since it opened, so its centroid's cosine with the next chunk follows from sums of
    products within the run. For each chunk these sums, taken as if a topic opened there, say where that topic would end.
    Beyond the band the page limit holds, so there only chunks that join by a decision or as mere procedure go on. The topics are
    the runs that follow from the first chunk.
    """
    t = "transcript_id"
    d = _actions(c, decisions).withColumn("always", F.expr("case when action is not null then action in ('continue', 'brief_digression') else only end"))
    d = running(d, [t], "chunk_no", F.when(~F.col("always"), F.col("chunk_no")), "next_stop", "min", backwards=True, strict=True)
    late = d.select(t, F.col("chunk_no").alias("i"), "always", F.col("action").isNotNull().alias("decided"), F.col("page").alias("page_i"))
    x = band_pairs(c, config).join(g, [t, "i", "j"], "left").withColumn("g", F.coalesce("g", F.lit(0.0)))
    back, ahead = W.partitionBy(t, "i"), W.partitionBy(t, "j").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("own", F.max(F.expr("case when i = j then g end")).over(back))
    x = x.withColumn("num", F.sum(F.expr("case when j < i then g else 0D end")).over(back.orderBy(F.desc("j")).rowsBetween(W.unboundedPreceding, 0)))
    x = x.withColumn("q", F.sum(F.col("own") + 2 * F.col("num")).over(ahead))
    x = x.filter("i > j").join(late, [t, "i"]).join(d.select(t, F.col("chunk_no").alias("j"), F.col("page").alias("page_j")), [t, "j"])
    alike = f"round(case when q * own > 0 then num / sqrt(q * own) else 0D end, 9) >= {config.continue_similarity} and page_i - page_j <= {config.max_pages_continue}"
    ends = x.groupBy(t, F.col("j").alias("chunk_no")).agg(F.min(F.expr(f"case when not (always or (not decided and {alike})) then i end")).alias("stop"), F.max("i").alias("last"))
    beyond = d.select(t, F.col("chunk_no").alias("last"), F.col("next_stop").alias("far_stop"))
    n = d.groupBy(t).agg((F.max("chunk_no") + 1).alias("end"))
    succ = d.select(t, "chunk_no").join(ends, [t, "chunk_no"], "left").withColumn("last", F.coalesce("last", "chunk_no")).join(beyond, [t, "last"]).join(n, t).select(t, "chunk_no", F.coalesce("stop", "far_stop", "end").alias("succ"))
    return runs(succ, [t], "chunk_no", "succ", keep).select(t, F.col("pos").alias("chunk_no"), F.col("run_no").alias("group_no"))


def merge_small(c: DataFrame, groups: DataFrame, config: EngineConfig = EngineConfig(), keep: Keep = keep_table) -> DataFrame:
    """(transcript_id, group_no, merged_no): groups with little text join the one before, unless that is long."""
    t = "transcript_id"
    lengths = groups.join(c, [t, "chunk_no"]).groupBy(t, "group_no").agg(F.sum(F.length("text")).alias("len"))
    x = first_reach(lengths, [t], "group_no", "len", config.merge_below_chars, "full_at")
    x = running(x, [t], "group_no", F.when(F.col("len") >= config.min_topic_chars, F.col("group_no")), "next_large", "min", backwards=True, strict=True)
    n = lengths.groupBy(t).agg((F.max("group_no") + 1).alias("end"))
    succ = x.join(n, t).select(t, "group_no", F.least(F.col("full_at") + 1, "next_large", "end").alias("succ"))
    return runs(succ, [t], "group_no", "succ", keep).select(t, F.col("pos").alias("group_no"), F.col("run_no").alias("merged_no"))


def split_oversized(c: DataFrame, groups: DataFrame, merged: DataFrame, similarity: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(transcript_id, chunk_no, topic_no): groups over many pages are cut wherever neighbours differ."""
    x = c.join(groups, ["transcript_id", "chunk_no"]).join(merged, ["transcript_id", "group_no"]).join(similarity, ["transcript_id", "chunk_no"], "left")
    w = W.partitionBy("transcript_id", "merged_no")
    x = x.withColumn("long", F.expr(f"max(end_page) over (partition by transcript_id, merged_no) - min(start_page) over (partition by transcript_id, merged_no) > {config.max_topic_pages} and count(*) over (partition by transcript_id, merged_no) > 2"))
    x = x.withColumn("opens", F.when(F.row_number().over(w.orderBy("chunk_no")) == 1, 1).when(F.expr(f"long and round(coalesce(similarity, 0D), 9) < {config.continue_similarity}"), 1).otherwise(0))
    return x.select("transcript_id", "chunk_no", F.sum("opens").over(W.partitionBy("transcript_id").orderBy("chunk_no").rowsBetween(W.unboundedPreceding, 0)).cast("int").alias("topic_no"))


def openers_and_centroids(groups: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(transcript_id, l, term, weight) of the chunks that open a group, and (transcript_id, r, term, weight) of the groups' centroids; both of unit length."""
    t = "transcript_id"
    first = groups.groupBy(t, "group_no").agg(F.min("chunk_no").alias("chunk_no")).filter("group_no > 1")
    left = weights.join(first, [t, "chunk_no"], "left_semi").select(t, F.col("chunk_no").alias("l"), "term", "weight")
    sums = weights.join(groups, [t, "chunk_no"]).groupBy(t, F.col("group_no").alias("r"), "term").agg(F.sum("weight").alias("raw"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(t, "r")))
    return left, sums.select(t, "r", "term", (F.col("raw") / length).alias("weight"))


def related_pairs(groups: DataFrame, weights: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(transcript_id, l, r): openers and earlier groups that may be alike enough."""
    left, right = openers_and_centroids(groups, weights)
    own = groups.select("transcript_id", F.col("chunk_no").alias("l"), F.col("group_no").alias("own"))
    return T.cosine_candidates(left, right, ["transcript_id"], config.related_similarity).join(own, ["transcript_id", "l"]).filter("r < own").drop("own")


def related_candidates(groups: DataFrame, weights: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(transcript_id, chunk_no, group_no, similarity): for a chunk that opens a group, earlier groups whose centroid resembles it."""
    left, right = openers_and_centroids(groups, weights)
    s = T.cosines(related_pairs(groups, weights, config), left, right, ["transcript_id"]).withColumnRenamed("s", "similarity")
    return s.filter(F.round("similarity", 9) >= config.related_similarity).select("transcript_id", F.col("l").alias("chunk_no"), F.col("r").alias("group_no"), "similarity")


def related_in_gram(groups: DataFrame, g: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """What related_candidates gives, by the products of all chunks: those with a group and within it are sums of them."""
    t = "transcript_id"
    at = lambda chunk, group: groups.select(t, F.col("chunk_no").alias(chunk), F.col("group_no").alias(group))
    x = g.join(at("i", "gi"), [t, "i"]).join(at("j", "gj"), [t, "j"])
    first = groups.groupBy(t, F.col("group_no").alias("gi")).agg(F.min("chunk_no").alias("i"))
    num = x.filter("gj < gi").join(first, [t, "gi", "i"], "left_semi").groupBy(t, "i", "gj").agg(F.sum("g").alias("num"))
    q = x.filter("gi = gj").groupBy(t, "gj").agg(F.sum(F.expr("case when i = j then g else 2 * g end")).alias("q"))
    s = num.join(q, [t, "gj"]).select(t, F.col("i").alias("chunk_no"), F.col("gj").alias("group_no"), F.expr("num / sqrt(q)").alias("similarity"))
    return s.filter(F.round("similarity", 9) >= config.related_similarity)


#: What a provider answers: one row a request, with null decisions where it failed.
ANSWERS = "request_key string, decisions array<struct<chunk_id string, action string, topic_label string>>"


def decision_requests(chunks: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(transcript_id, batch_no, request_key, provider, temperature, chunk_ids, source_ranges, texts): what a decision provider is
    asked, in bounded batches. The key is a hash of what is asked, so that an answer holds as long as its chunks stay the same."""
    asked = F.expr(f"struct(chunk_no, chunk_id, source_range, substring(text, 1, {REQUEST_CHARS}) as text)")
    x = chunks.withColumn("batch_no", F.expr(f"1 + (chunk_no - 1) div {REQUEST_CHUNKS}").cast("int")).groupBy("transcript_id", "batch_no").agg(F.array_sort(F.collect_list(asked)).alias("x")).select(
        "transcript_id", "batch_no", F.lit(config.decision_provider).alias("provider"), F.lit(config.temperature).alias("temperature"),
        F.col("x.chunk_id").alias("chunk_ids"), F.col("x.source_range").alias("source_ranges"), F.col("x.text").alias("texts"))
    return x.withColumn("request_key", F.sha2(F.to_json(F.struct("transcript_id", "chunk_ids", "source_ranges", "texts")).cast("binary"), 256))


def _matched(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Requests with their answer; of several answers to one request a good one counts."""
    best = answers.groupBy("request_key").agg(F.max("decisions").alias("decisions")).withColumn("there", F.lit(True))
    return requests.select("transcript_id", "batch_no", "request_key").join(best, "request_key", "left")


def exchange_status(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """(request_key, transcript_id, batch_no, status): answered, failed (an answer without decisions), open (none yet), or stale
    (an answer to what is no longer asked, without a transcript)."""
    status = F.expr("case when decisions is not null then 'answered' when there then 'failed' else 'open' end")
    stale = answers.select("request_key").distinct().join(requests, "request_key", "left_anti")
    return _matched(requests, answers).select("request_key", "transcript_id", "batch_no", status.alias("status")).unionByName(stale.withColumn("status", F.lit("stale")), allowMissingColumns=True)


def decisions_of(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """(transcript_id, chunk_id, action, topic_label), as `walk` takes them: of transcripts whose requests all have a good answer.

    A chunk that is decided on twice has its last decision.
    """
    x = _matched(requests, answers)
    whole = x.groupBy("transcript_id").agg(F.bool_and(F.col("decisions").isNotNull()).alias("whole")).filter("whole").select("transcript_id")
    each = x.join(whole, "transcript_id", "left_semi").select("transcript_id", "batch_no", F.posexplode("decisions").alias("n", "d")).filter("coalesce(d.chunk_id, '') <> ''")
    return each.groupBy("transcript_id", F.col("d.chunk_id").alias("chunk_id")).agg(F.max_by("d", F.struct("batch_no", "n")).alias("d")).select("transcript_id", "chunk_id", "d.action", "d.topic_label")
