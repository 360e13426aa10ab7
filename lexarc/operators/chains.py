"""Steps along a numbered sequence, without gathering a sequence in one row or one task.

Sequences are rows with keys and a position that counts from 1 without gaps. They are cut into blocks of bounded length, and
what runs through a whole sequence is worked out in the blocks first and then over one row a block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.artifacts import keep as keep_table

BLOCK = 256
Keep = Callable[[DataFrame], DataFrame]


def block_of(pos: str, block: int = BLOCK) -> Column:
    return F.expr(f"cast(({pos} - 1) div {block} as int)")


def running(df: DataFrame, keys: list[str], pos: str, value: Column, name: str, how: str = "sum", backwards: bool = False, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """Adds the sum, min or max of value over a row and all before it (backwards: after it; strict: without the row itself)."""
    agg, both = {"sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)), "min": (F.min, F.least), "max": (F.max, F.greatest)}[how]
    own, whole, rest = f"{name}_own", f"{name}_whole", f"{name}_rest"
    order = F.desc if backwards else F.asc
    x = df.withColumn("block_no", block_of(pos, block))
    inside = W.partitionBy(*keys, "block_no").orderBy(order(pos)).rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    blocks = x.groupBy(*keys, "block_no").agg(agg(value).alias(whole))
    before = W.partitionBy(*keys).orderBy(order("block_no")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "block_no", agg(whole).over(before).alias(rest))
    return x.withColumn(own, agg(value).over(inside)).join(blocks, [*keys, "block_no"]).withColumn(name, both(F.col(own), F.col(rest))).drop("block_no", own, rest)


def first_reach(df: DataFrame, keys: list[str], pos: str, value: str, limit: int, name: str) -> DataFrame:
    """Adds the first position from a row on up to which value, always positive, sums up to the limit; null if there is none.

    Running sums fall into buckets as wide as the limit, so the position lies in the next bucket or opens a later one.
    """
    x = running(df, keys, pos, F.col(value), "so_far").withColumn("want", F.expr(f"so_far - {value} + {limit}"))
    sums = x.select(*keys, F.col(pos).alias("reached"), F.col("so_far").alias("sum_there"), F.expr(f"so_far div {limit}").alias("bucket"))
    asked = x.select(*keys, pos, "want", F.expr(f"want div {limit}").alias("bucket"))
    there = asked.join(sums, [*keys, "bucket"]).filter("sum_there >= want").groupBy(*keys, pos).agg(F.min("reached").alias("near"))
    # the sums before a row lie in the bucket before, so the last sum of these two buckets is there unless the row is the first
    last = sums.groupBy(*keys, "bucket").agg(F.max("reached").alias("ends"))
    beyond = asked.select(*keys, pos, F.explode(F.expr("array(bucket - 1, bucket)")).alias("bucket")).join(last, [*keys, "bucket"]).groupBy(*keys, pos).agg((F.max("ends") + 1).alias("far"))
    total = sums.groupBy(*keys).agg(F.max("reached").alias("count"))
    found = asked.select(*keys, pos).join(there, [*keys, pos], "left").join(beyond, [*keys, pos], "left").join(total, keys)
    found = found.select(*keys, pos, F.expr("coalesce(near, case when coalesce(far, 1) <= count then coalesce(far, 1) end)").alias(name))
    return df.join(found, [*keys, pos])


# Arrays are read by get(), since filters that Spark infers may look at rows that a later filter drops.
#: For each place of a block the place that is twice as many steps on, or the first one outside, and the steps taken.
_TWICE = "transform({x}, e -> if(e.to <= hi, named_struct('to', get({x}, e.to - lo).to, 'steps', e.steps + get({x}, e.to - lo).steps), e))"


def runs(items: DataFrame, keys: list[str], pos: str, succ: str, keep: Keep = keep_table, block: int = BLOCK) -> DataFrame:
    """(keys, pos, run_no): the runs that begin at position 1 and, each, where the run before ends.

    succ is the position after the run that would begin at a row; beyond the sequence it ends there. Within a block the steps
    are doubled on arrays. Over blocks only places that are entered from outside count, and their steps are doubled by joins:
    as many rounds as the logarithm of the blocks of the longest sequence, none if each has one block.
    """
    levels = max(1, (block - 1).bit_length())
    cut = items.select(*keys, F.col(pos).cast("int").alias("pos"), F.col(succ).alias("succ")).withColumn("block_no", block_of("pos", block))
    kept = keep(cut.groupBy(*keys, "block_no").agg(F.expr("transform(array_sort(collect_list(struct(pos, succ))), x -> named_struct('to', cast(x.succ as int), 'steps', 1))").alias("x0")))
    blocks = kept.withColumn("lo", F.expr(f"block_no * {block} + 1")).withColumn("hi", F.expr("lo + size(x0) - 1"))
    reached = kept.filter("block_no = 0").select(*keys, F.lit(1).alias("pos"), F.lit(0).alias("rank"))
    rounds = (kept.agg(F.max("block_no")).first()[0] or 0).bit_length()
    if rounds:
        whole = blocks.select(*keys, "block_no", "lo", F.expr(f"aggregate(sequence(1, {levels}), x0, (x, k) -> {_TWICE.format(x='x')})").alias("x"))
        entered = whole.select(*keys, F.explode(F.expr("array_distinct(transform(x, e -> e.to))")).alias("pos")).union(reached.select(*keys, "pos")).distinct().withColumn("block_no", block_of("pos", block))
        jump = keep(entered.join(whole, [*keys, "block_no"]).withColumn("e", F.expr("get(x, pos - lo)")).filter("e is not null").select(*keys, "pos", F.col("e.to").alias("to"), F.col("e.steps").alias("steps")))
        for k in range(rounds):
            further = reached.join(jump, [*keys, "pos"]).select(*keys, F.col("to").alias("pos"), (F.col("rank") + F.col("steps")).alias("rank"))
            reached = keep(reached.union(further))
            if k + 1 < rounds:
                then = jump.select(*keys, F.col("pos").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
                jump = keep(jump.join(then, [*keys, "to"]).select(*keys, "pos", F.col("to2").alias("to"), (F.col("steps") + F.col("steps2")).alias("steps")))
    entry = reached.withColumn("block_no", block_of("pos", block))
    x = blocks.join(entry, [*keys, "block_no"]).filter("pos <= hi")
    starts = F.expr(f"""aggregate(sequence(1, {levels}), named_struct('x', x0, 's', array(pos)), (a, k) -> named_struct('x', {_TWICE.format(x='a.x')},
        's', concat(a.s, filter(transform(a.s, p -> get(a.x, p - lo).to), p -> p <= hi))), a -> sort_array(a.s))""")
    begun = x.select(*keys, "rank", "lo", "x0", starts.alias("starts")).select(*keys, "rank", "lo", "x0", F.posexplode("starts").alias("i", "start"))
    return begun.select(*keys, F.explode(F.expr("sequence(start, get(x0, start - lo).to - 1)")).alias("pos"), (F.col("rank") + F.col("i") + 1).alias("run_no"))
