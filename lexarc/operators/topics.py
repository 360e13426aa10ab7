"""Topic records: bounds, labels, recurrence, evidence, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..config import EngineConfig
from . import text as T
from .turns import ordered_join

# Words that open an answer or a label without saying anything.
COURTESY = r"(?i)^(thank you[.,!]?|terrific[.,!]?|okay[.,!]?|sure thing[.,!]?|sure[.,!]?|correct[.,!]?|right[.,!]?|all right[.,!]?|alright[.,!]?)\s*"
FILLER = r"(?i)^(okay|all right|alright|so|and|now|uh|um)[,.]?\s+"
UNTITLED = "Untitled testimony segment"
KEY = ["transcript_id", "topic_no"]


def n_words(col: Column) -> Column:
    return F.when(F.trim(col) == "", 0).otherwise(F.size(F.split(F.trim(col), r"\s+")))


def capital(col: Column) -> Column:
    return F.concat(F.upper(F.substring(col, 1, 1)), F.substring(col, 2, 1_000_000))


def normalized(df: DataFrame, source: Column, name: str) -> DataFrame:
    """df with a label made of the source: one line, no filler before it, a bounded length, a capital.

    Each step is a column of its own, since an expression that repeats its input grows with every step.
    """
    blank = F.trim(F.regexp_replace(source, r"\s+", " "))
    plain = F.trim(F.regexp_replace(F.regexp_replace(blank, FILLER, ""), "^[-:;,. ]+", ""))
    t = F.col(name)
    short = F.when(F.length(t) > 115, F.concat(F.regexp_replace(F.substring(t, 1, 115), " [^ ]*$", ""), F.lit("..."))).otherwise(t)
    return df.withColumn(name, plain).withColumn(name, short).withColumn(name, F.when(t == "", F.lit(UNTITLED)).otherwise(capital(t)))


def topic_units(numbered: DataFrame, assigned: DataFrame) -> DataFrame:
    return numbered.join(assigned, ["transcript_id", "chunk_no"])


def spans(units: DataFrame) -> DataFrame:
    """Bounds, text and sources of each topic."""
    return units.groupBy(*KEY).agg(
        F.min_by("start_page", "unit_no").alias("start_page"), F.min_by("start_line", "unit_no").alias("start_line"), F.max_by("end_page", "unit_no").alias("end_page"), F.max_by("end_line", "unit_no").alias("end_line"),
        F.count("*").alias("n_units"), F.bool_and("is_procedural").alias("is_procedural"), F.expr("coalesce(min_by(procedural_reason, unit_no) filter (where procedural_reason is not null), 'procedure')").alias("reason"),
        ordered_join("text", "unit_no").alias("text"), F.expr("flatten(transform(array_sort(collect_list(struct(unit_no, source_ids))), x -> x.source_ids))").alias("source_ids"),
        F.expr("transform(array_sort(collect_set(struct(chunk_no, chunk_id))), x -> x.chunk_id)").alias("chunk_ids")).withColumn("topic_id", F.expr("concat('T', lpad(cast(topic_no as string), greatest(3, length(cast(topic_no as string))), '0'))"))


def first_question(units: DataFrame, turns: DataFrame) -> DataFrame:
    """(key, question): per unit in order its first real question, else a full answer, else its text; at last the first unit."""
    u = units.filter("not is_procedural").select(*KEY, "unit_no", F.col("text").alias("unit_text"))
    t = turns.select("transcript_id", "unit_no", "turn_no", "speaker_kind", F.trim("text").alias("said")).filter("said <> ''")
    clean = F.col("said")
    for _ in range(3):
        clean = F.trim(F.regexp_replace(clean, COURTESY, ""))
    spoken = u.join(t, ["transcript_id", "unit_no"])
    asked = spoken.filter("speaker_kind = 'Q'").withColumn("c", clean).filter((~F.startswith("c", F.lit("--"))) & (n_words(F.col("c")) >= 3)).select(*KEY, "unit_no", F.lit(1).alias("class"), "turn_no", "c")
    told = spoken.filter("speaker_kind in ('WITNESS', 'A')").withColumn("c", F.col("said")).filter((~F.startswith("c", F.lit("--"))) & (n_words(F.col("c")) >= 4)).select(*KEY, "unit_no", F.lit(2).alias("class"), "turn_no", "c")
    whole = u.withColumn("c", F.trim("unit_text")).filter((~F.startswith("c", F.lit("--"))) & (n_words(F.col("c")) >= 3)).select(*KEY, "unit_no", F.lit(3).alias("class"), F.lit(0).alias("turn_no"), "c")
    best = asked.unionByName(told).unionByName(whole).groupBy(*KEY).agg(F.expr("min(struct(unit_no, class, turn_no, c)).c").alias("best"))
    return units.groupBy(*KEY).agg(F.min_by("text", "unit_no").alias("other")).join(best, KEY, "left").select(*KEY, F.coalesce("best", "other").alias("question"))


def composed_label(t: DataFrame) -> DataFrame:
    """t(question, phrases, given) with its label: the given one, or the question, with the phrases where it is short, or they alone."""
    q, topical = F.col("label_q"), F.col("label_topical")
    t = normalized(t, F.coalesce("given", "question"), "label_q").withColumn("label_topical", F.array_join(F.slice(F.coalesce("phrases", F.array().cast("array<string>")), 1, 3), "; "))
    alone = F.when(topical == "", F.lit("Testimony segment")).otherwise(capital(topical))
    both = (topical != "") & ~F.contains(F.lower(q), F.lower(topical)) & (F.length(q) <= 75)
    t = t.withColumn("label_more", F.when(F.col("given").isNull(), F.when(F.startswith(F.lower(q), F.lit("untitled")), alone).when(both, F.concat(q, F.lit(" ("), topical, F.lit(")")))))
    t = normalized(t, F.col("label_more"), "label_made")
    return t.withColumn("label", F.when(F.col("label_more").isNotNull(), F.col("label_made")).otherwise(q)).drop("label_q", "label_topical", "label_more", "label_made")


def evidence(topics: DataFrame, lines: DataFrame, limit: int) -> DataFrame:
    """(key, evidence): what was said in a topic's span until the limit is crossed, cut at a word."""
    pages = topics.select(*KEY, F.expr("start_page * 1000 + start_line").alias("lo"), F.expr("end_page * 1000 + end_line").alias("hi"), F.explode(F.expr("sequence(least(start_page, end_page), greatest(start_page, end_page))")).alias("page"))
    inside = pages.join(lines.select("transcript_id", "page", "line", "ord", "speaker", "speaker_kind", F.trim("text").alias("said")), ["transcript_id", "page"]).filter("page * 1000 + line between lo and hi and said <> ''")
    inside = inside.withColumn("voiced", F.expr("speaker_kind in ('Q', 'A', 'WITNESS', 'ATTORNEY')"))
    inside = inside.withColumn("any", F.bool_or("voiced").over(W.partitionBy(*KEY))).filter("voiced or not any").withColumn("s", F.expr("case when any then concat(speaker, ': ', said) else said end"))
    before = F.coalesce(F.sum(F.length("s")).over(W.partitionBy(*KEY).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    text = inside.withColumn("before", before).filter(F.col("before") <= limit).groupBy(*KEY).agg(ordered_join("s", "ord").alias("t"))
    cut = F.expr(f"concat(regexp_replace(substring(t, 1, {limit}), ' [^ ]*$', ''), case when length(t) > {limit} then '…' else '' end)")
    return topics.select(*KEY).join(text, KEY, "left").select(*KEY, F.coalesce(cut, F.lit("")).alias("supporting_evidence"))


def records(units: DataFrame, turns: DataFrame, lines: DataFrame, config: EngineConfig = EngineConfig(), labels: DataFrame | None = None) -> DataFrame:
    """Topics before validation. labels(transcript_id, chunk_id, topic_label) may name topics by their first labelled chunk."""
    t = spans(units)
    t = t.withColumn("phrases", T.phrases("text", 6, config.phrase_vocabulary)).join(first_question(units, turns), KEY)
    if labels is None:
        t = t.withColumn("given", F.lit(None).cast("string"))
    else:
        named = units.select(*KEY, "chunk_no", "chunk_id").distinct().join(labels.filter("coalesce(topic_label, '') <> ''"), ["transcript_id", "chunk_id"]).groupBy(*KEY).agg(F.min_by("topic_label", "chunk_no").alias("given"))
        t = t.join(named, KEY, "left")
    t = composed_label(t).withColumn("topic", F.when(F.col("is_procedural"), F.expr("concat('Procedural interruption (', reason, ')')")).otherwise(F.col("label"))).drop("label", "given")
    t = t.withColumn("fingerprint", F.expr("substring(sha1(array_join(slice(coalesce(phrases, cast(array() as array<string>)), 1, 4), ' ')), 1, 10)"))
    t = t.withColumn("confidence", F.expr("round(least(0.95D, 0.55D + 0.05D * ln(1 + n_units)), 3)"))
    t = t.withColumn("supporting_source_reference", F.expr(f"concat('{config.deposition_name} P', start_page, ':L', start_line, ' - P', end_page, ':L', end_line)"))
    return t.join(evidence(t, lines, config.evidence_chars), KEY)


def link_recurrence(t: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Links each topic to the first with its fingerprint, if that one is valid; t has provenance_ok."""
    w = W.partitionBy("transcript_id", "fingerprint").orderBy("topic_no")
    x = t.withColumn("holder", F.first(F.struct("topic_no", "topic_id", "end_page", "provenance_ok")).over(w)).withColumn("linked", F.expr("holder.topic_no <> topic_no and holder.provenance_ok"))
    later = F.expr(f"linked and start_page - holder.end_page >= {config.recurrence_gap_pages}")
    return x.withColumn("recurrence_of", F.when(later, F.col("holder.topic_id"))).withColumn("related_topic_ids", F.expr("case when linked then array(holder.topic_id) else cast(array() as array<string>) end")).withColumn(
        "transition_type", F.expr("case when linked then 'related_distinct' else 'new_topic' end")).withColumn("topic", F.when(later, F.concat("topic", F.lit(" (later span)"))).otherwise(F.col("topic"))).drop("holder", "linked")
