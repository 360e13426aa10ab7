"""Tokens, n-grams, TF-IDF, similarity and key phrases."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce
from heapq import nsmallest

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.stopwords import PHRASE_STOPS, STOP_WORDS

# Fixed value: keys shared by several rows, up to which they are broadcast.
SHARED_KEYS = 100_000
#: Same characters as in `tokens`: letters, numbers and the underscore.
WORD, STOPS = re.compile(r"\w{2,}"), frozenset(STOP_WORDS)


def tokens(col: str) -> Column:
    """Lower-case runs of two or more word characters that aren't stop words."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return F.expr(f"filter(regexp_extract_all(lower({col}), '[\\\\p{{L}}\\\\p{{N}}_]{{2,}}', 0), w -> not w in ({stop}))")


def terms(token_col: str = "tokens") -> Column:
    """Tokens, and pairs of neighbouring ones."""
    return F.expr(f"concat({token_col}, case when size({token_col}) > 1 then transform(sequence(1, size({token_col}) - 1), i -> concat({token_col}[i - 1], ' ', {token_col}[i])) else cast(array() as array<string>) end)")


def words_of(low: str) -> list[str]:
    """What `tokens` gives for a text in lower case, for use within tasks."""
    return [w for w in WORD.findall(low) if w not in STOPS]


def terms_of(low: str) -> list[str]:
    words = words_of(low)
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _sorted_terms(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, sorted, starts): a row's terms in order, and where each of them first stands.

    No row is filtered by its terms, since a filter is worked out below these steps, with the tokens anew for each term.
    """
    x = docs.select(*keys, tokens(text).alias("tokens")).select(*keys, F.sort_array(terms()).alias("sorted"))
    first = "filter(sequence(0, size(sorted) - 1), i -> i = 0 or get(sorted, i) <> get(sorted, i - 1))"
    return x.select(*keys, "sorted", F.expr(f"case when size(sorted) > 0 then {first} else cast(array() as array<int>) end").alias("starts"))


def row_term_counts(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term, tf) of each row for itself, counted over its sorted terms, so that nothing is shuffled."""
    x = _sorted_terms(docs, keys, text)
    return x.select(*keys, F.explode(F.expr("transform(starts, (p, k) -> struct(get(sorted, p) as term, cast(coalesce(get(starts, k + 1), size(sorted)) - p as bigint) as tf))")).alias("x")).select(*keys, "x.term", "x.tf")


def term_counts(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, term, tf). Rows with keys of their own are counted for themselves; only rows that share keys are gathered."""
    often = docs.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    n = often.count()
    if not n:
        return row_term_counts(docs, keys, text)
    shared = often.toDF(*(f"{k}_shared" for k in keys))
    shared = F.broadcast(shared) if n <= SHARED_KEYS else shared
    same = reduce(lambda a, b: a & b, (docs[k].eqNullSafe(shared[f"{k}_shared"]) for k in keys))
    several = row_term_counts(docs.join(shared, same, "left_semi"), keys, text).groupBy(*keys, "term").agg(F.sum("tf").alias("tf"))
    return row_term_counts(docs.join(shared, same, "left_anti"), keys, text).unionByName(several)


def top_terms(counts: DataFrame, group: list[str], cap: int) -> DataFrame:
    """The cap most frequent terms of each group, ties in order of the term."""
    cf = counts.groupBy(*group, "term").agg(F.sum("tf").alias("cf"))
    return cf.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(F.desc("cf"), "term"))).filter(F.col("rank") <= cap)


def tfidf(docs: DataFrame, group: list[str], doc: str, text: str, cap: int) -> DataFrame:
    """(group, doc, term, weight), rows of unit length over the cap most frequent terms of each group, ties in order of the term.

    Texts are dealt by group once, before they become terms; all that follows stays where they are.
    """
    x = docs.select(*group, doc, text).withColumn("n", F.count("*").over(W.partitionBy(*group)))
    x = row_term_counts(x, [*group, doc, "n"], text)
    each = W.partitionBy(*group, "term")
    x = x.withColumn("cf", F.sum("tf").over(each)).withColumn("df", F.count("*").over(each))
    x = x.withColumn("rank", F.dense_rank().over(W.partitionBy(*group).orderBy(F.desc("cf"), "term"))).filter(F.col("rank") <= cap)
    w = x.withColumn("raw", F.expr("tf * (ln((1 + n) / (1 + df)) + 1)"))
    return w.withColumn("norm", F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(*group, doc)))).select(*group, doc, "term", (F.col("raw") / F.col("norm")).alias("weight"))


def gram(weights: DataFrame, group: list[str], doc: str) -> DataFrame:
    """(group, i, j, g) for i >= j whose rows share a term."""
    a, b = weights.withColumnRenamed(doc, "i").withColumnRenamed("weight", "wi"), weights.withColumnRenamed(doc, "j").withColumnRenamed("weight", "wj")
    return a.join(b, [*group, "term"]).filter("i >= j").groupBy(*group, "i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("g"))


def short_gram(docs: DataFrame, group: str, doc: str, text: str, cap: int) -> DataFrame:
    """What `gram(tfidf(...))` gives, for groups that are bounded in rows and text: a group's texts are met at once, as a
    matrix of at most its rows by cap terms, so that only texts and products go over the network, and no terms."""
    x = docs.select(group, doc, F.lower(text).alias("low"))
    to = x.select(group, F.col(doc).alias("i"), F.col(doc).alias("j"), F.lit(0.0).alias("g")).schema

    def products(table):
        import numpy as np
        import pyarrow as pa

        ids: dict[str, int] = {}
        each = [np.array([ids.setdefault(w, len(ids)) for w in words_of(low or "")], dtype=np.int64) for low in table.column("low").to_pylist()]
        n, v = len(each), len(ids)
        place = np.empty(v, dtype=np.int64)
        place[[ids[w] for w in sorted(ids)]] = np.arange(v)
        each = [place[e] for e in each]
        # codes in order of the terms: a word, then its pairs, since a blank comes before all characters of words
        codes = [np.concatenate([e * (v + 1), e[:-1] * (v + 1) + e[1:] + 1]) for e in each]
        row = np.repeat(np.arange(n), [len(x) for x in codes])
        known, term = np.unique(np.concatenate(codes), return_inverse=True)
        if len(known) > cap:  # the most frequent ones, ties in order of the term
            cf = np.bincount(term, minlength=len(known))
            least = np.partition(cf, -cap)[-cap]
            more = np.flatnonzero(cf > least)
            kept = np.concatenate([more, np.flatnonzero(cf == least)[: cap - len(more)]])
            to_new = np.full(len(known), -1)
            to_new[kept] = np.arange(len(kept))
            term = to_new[term]
            row, term = row[term >= 0], term[term >= 0]
        width = min(len(known), cap)
        tf = np.bincount(row * width + term, minlength=n * width).reshape(n, width).astype(np.float64)
        raw = tf * (np.log((1 + n) / (1 + np.count_nonzero(tf, axis=0))) + 1)
        norm = np.sqrt((raw * raw).sum(axis=1, keepdims=True))
        w = np.divide(raw, norm, out=np.zeros_like(raw), where=norm > 0)
        g = w @ w.T
        no = table.column(doc).to_numpy()
        i, j = np.nonzero((no[:, None] >= no[None, :]) & (g > 0))
        cols = [pa.repeat(table.column(group)[0], len(i)), pa.array(no[i]), pa.array(no[j]), pa.array(g[i, j])]
        return pa.table([c.cast(f) for c, f in zip(cols, (table.schema.field(group).type, table.schema.field(doc).type, table.schema.field(doc).type, pa.float64()))], names=[group, "i", "j", "g"])

    return x.groupBy(group).applyInArrow(products, to)


def cosine_candidates(left: DataFrame, right: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """(group, l, r): pairs of unit vectors left(group, l, term, weight) and right(group, r, term, weight) that may reach threshold.

    Terms go from rare to frequent. The product of two vectors whose first common term is x is at most the product of what
    each weighs from x on. So a pair that reaches the threshold shares a term up to which neither has too little left, and
    only these terms are joined: frequent ones seldom are among them.
    """
    least = threshold - 1e-6
    both = left.select(*group, "term").unionByName(right.select(*group, "term")).groupBy(*group, "term").agg(F.count("*").alias("df"))

    def front(side: DataFrame, name: str) -> DataFrame:
        w = W.partitionBy(*group, name).orderBy(F.desc("df"), F.desc("term")).rowsBetween(W.unboundedPreceding, 0)
        x = side.join(both, [*group, "term"]).withColumn("rest", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(w)))
        return x.filter(F.col("rest") >= least).select(*group, "term", name, F.col("rest").alias(f"rest_{name}"))

    return front(left, "l").join(front(right, "r"), [*group, "term"]).filter(F.col("rest_l") * F.col("rest_r") >= least).select(*group, "l", "r").distinct()


def cosines(pairs: DataFrame, left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """pairs(group, l, r) with their exact product s; pairs without a common term are left out."""
    x = pairs.join(left.withColumnRenamed("weight", "wl"), [*group, "l"]).join(right.withColumnRenamed("weight", "wr"), [*group, "r", "term"])
    return x.groupBy(*group, "l", "r").agg(F.sum(F.col("wl") * F.col("wr")).alias("s"))


def phrases(text: str, n: int, cap: int) -> Column:
    """A text's most frequent terms of four characters or more, ties in order of the term; null if there are none."""
    stops = frozenset(PHRASE_STOPS)

    @F.udf("array<string>", useArrow=True)
    def ranked(low):
        often = [(-k, t) for t, k in Counter(terms_of(low or "")).items()]
        often = sorted(often)[:cap] if len(often) > cap else often
        return [t for _, t in nsmallest(n, (x for x in often if len(x[1]) >= 4 and x[1] not in stops))] or None

    return ranked(F.lower(text))


def keyphrases(docs: DataFrame, keys: list[str], text: str, n: int, cap: int) -> DataFrame:
    """(keys, phrases) of the rows that have any; one row has one text, whose terms are counted and ranked in the row itself."""
    x = docs.select(*keys, phrases(text, n, cap).alias("phrases"))  # not filtered, since the phrases would be found anew for it
    return x.select(*keys, F.explode(F.expr("case when phrases is not null then array(phrases) else cast(array() as array<array<string>>) end")).alias("phrases"))
