"""Benchmark decontamination by templates, with DataFrame functions only.

A text's first template is its sequence of words, lower-cased, in which numbers, in digits or words, become <n> and units
behind a number <u>. The second also has <e> for every run of capitalised words, since names of any length may change and
begin sentences; a window of it with slots counts if three words are left in it. Windows of eight words of both templates of
every benchmark item are hash-joined with those of the documents.
Matched windows are then checked against the texts' own words: words that fill the slots must follow the item's: along an
alignment the same benchmark value always has the same document value, of the same type (two benchmark values may get the
same new one), or the windows that hold that value don't count. An item counts as leaked into a document if, by one of the
templates, at least half of its distinct windows are found, so an item asked again with other numbers, names or units is
caught, in whatever case if the names are the same, and a chance window is not. The word "one" is a number only beside
another number word, and names in lower case are words, so that other names in lower case are not caught.

Most documents hold no window at all, and a window of eight words has a part of six that begins at a multiple of three.
So a first look hashes only those parts of every text, of both templates, and joins them with all parts of the items;
documents without a common part can't hold a window, and only the others are hashed at every word. Nothing is lost by it.

Items shorter than a window are compared as one window of their own length if they have at least five words; shorter
ones are never matched. Null and empty texts match nothing. Every document row gives one row. Items that repeat count
once each. Rows without an id are judged by their text; rows that repeat an id count as one document with several texts.
Other columns of the documents pass through `flagged`, but for n_items and item_ids, which are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

WINDOW, SHORTEST = 8, 5
#: Places of the parts that the first look hashes, and their words.
STRIDE = 3
PART = WINDOW - STRIDE + 1
MIN_SHARE = 0.5
#: Up to this many distinct benchmark windows (16 bytes each) go to every executor; beyond it both sides are shuffled.
BROADCAST_WINDOWS = 200_000
# Units of measurement that may follow a number.
UNITS = ["km", "kilometers", "kilometres", "miles", "m", "meters", "metres", "cm", "mm", "inches", "feet", "kg", "kilograms", "g", "grams", "mg", "pounds", "lb", "lbs", "l", "liters", "litres", "ml",
         "seconds", "minutes", "hours", "days", "weeks", "months", "years", "percent", "dollars", "euros", "cents", "mph", "kmh"]


# Number words; "one" is one of them only beside another.
NUMBERS = ["zero", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]
SCALES = ["hundred", "thousand", "million", "billion"]
#: Words besides slots that a window of the second template must have.
WORDS_LEFT = 3
#: A slot's value, behind its marker: letters, digits, further words of it, and marks between digits.
#: Possessive, so that values of any length need no deep stack.
VALUE = "([\u0001-\u0003])[\\p{L}\\p{N}\u0001\u0002]++(?:(?<=\\d)[.,:/](?=\\d)[\\p{L}\\p{N}\u0001\u0002]++)*+"
SLOT = "^[\u0001-\u0003]"


def numbered(text: Column) -> Column:
    """The text with numbers behind the marker \\x01 and units behind \\x03. Number words in a row are one number."""
    tens, scales = "|".join(TENS), "|".join(SCALES)
    # what seldom fits is looked at first, and what stands before a place behind its first character
    named = rf"(?i)(?=[ztfsenhmbo][ewhiolun])\b(?=ze|tw|t[eh][inor]|f[io]|s[ie]|[en]i|el|hu|mi|bi|on)(?:{'|'.join(NUMBERS)}|{tens}|{scales}|one(?=[ -](?:{scales})\b)|one(?<=\b(?:{tens}|{scales})[ -]one))\b"
    marks = F.regexp_replace(F.regexp_replace(text, named, "\u0001$0"), r"\d++(?:[.,:/]\d++)*+", "\u0001$0")
    whole = F.regexp_replace(marks, "(\u0001[\\p{L}\\p{N}.,:/]+)[ -](?=\u0001\\p{L})", "$1")
    return F.regexp_replace(whole, "(?i)(\u0001(?:[\\d.,:/]+[ -]?|(?<![\\p{L}\\p{N}\u0001]\u0001)[\\p{L}\\d.,:/\u0001]++[ -]))(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")\b", "$1 \u0003$2")


def marked(text: Column, every: bool) -> Column:
    """A numbered text; for the second template with \\x02 before each capitalised word, and none but that between words in a row."""
    if not every:
        return text
    names = F.regexp_replace(text, "\\p{Lu}(?<![\\p{L}\\p{N}\u0001-\u0003]\\p{Lu})", "\u0002$0")
    return F.regexp_replace(names, "(\u0002[\\p{L}\\p{N}]+)[ -](?=\u0002)", "$1")


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, "[^\\p{L}\\p{N}\u0001-\u0003]+"), "")


def words(text: Column, every: bool = False) -> Column:
    """Words of a numbered text with their markers, lower-cased; anything but letters, digits and markers separates."""
    return _split(F.regexp_replace(F.lower(marked(text, every)), r"(?<=\d)[.,:/](?=\d)", ""))


def template(text: Column, every: bool = False) -> Column:
    """The same words of a numbered text with each slot's value dropped. A marker carries its type."""
    return _split(F.regexp_replace(F.lower(marked(text, every)), VALUE, "$1"))


def windows(values: str, size: int) -> str:
    """Hashes of all windows of a size over an array column, as SQL."""
    return f"case when size({values}) >= {size} then transform(sequence(1, size({values}) - {size - 1}), i -> xxhash64(slice({values}, i, {size}))) else array() end"


def consistent(filled: DataFrame) -> DataFrame:
    """Of (doc_id, item_id, at, every, own, filled), the rows without a benchmark value that gets several new ones.

    An alignment is a document, an item, a template and the distance between their windows; values are compared over all its windows.
    Its rows are bounded by the item's length.
    """
    pairs = filled.select("doc_id", "item_id", "at", "every", F.explode(F.filter(F.arrays_zip(F.col("own").alias("b"), F.col("filled").alias("d")), lambda x: x["b"].rlike(SLOT))).alias("x"))
    broken = pairs.groupBy("doc_id", "item_id", "at", "every", F.col("x.b").alias("b")).agg(F.count_distinct("x.d").alias("n")).filter("n > 1").groupBy("doc_id", "item_id", "at", "every").agg(F.collect_list("b").alias("broken"))
    return filled.join(broken, ["doc_id", "item_id", "at", "every"], "left").filter("broken is null or not arrays_overlap(own, broken)").drop("broken")


def _windows_with_words(texts: DataFrame, key: str, sizes: list[int], every: bool = False) -> DataFrame:
    """(key, hash, position, own words) for each window of the sizes over (key, text)."""
    t = texts.select(key, numbered(F.col("text")).alias("text")).select(key, template(F.col("text"), every).alias("t"), words(F.col("text"), every).alias("w")).filter("size(t) = size(w)")
    return reduce(DataFrame.unionByName, [t.select(key, F.posexplode(F.expr(windows("t", s))).alias("p", "hash"), "w").select(key, "hash", "p", F.slice("w", F.col("p") + 1, s).alias("own")) for s in sizes])


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, every, hash, item_p, own words, slots, total): the distinct windows that count of each item with at least SHORTEST words, by both templates; total counts all."""
    texts = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))

    def each(every):
        length = F.size(template(numbered(F.col("text")), every))
        parts = [_windows_with_words(texts.filter(length >= WINDOW), "item_id", [WINDOW], every),
                 *(_windows_with_words(texts.filter(length == s), "item_id", [s], every) for s in range(SHORTEST, WINDOW))]
        return reduce(DataFrame.unionByName, parts).withColumn("every", F.lit(every))

    once = each(False).unionByName(each(True)).groupBy("item_id", "every", "hash").agg(F.min(F.struct("p", "own")).alias("x"))
    once = once.select("item_id", "every", "hash", F.col("x.p").alias("item_p"), F.col("x.own").alias("own")).withColumn("slots", F.exists("own", lambda x: x.rlike(SLOT)))
    left = F.size(F.filter("own", lambda x: ~x.rlike(SLOT)))
    return once.join(once.groupBy("item_id", "every").agg(F.count("*").alias("total")), ["item_id", "every"]).filter(~F.col("every") | ~F.col("slots") | (left >= WORDS_LEFT))


def _both(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, t, e): both templates of (keys, text)."""
    return texts.select(*keys, numbered(F.col("text")).alias("text")).select(*keys, template(F.col("text")).alias("t"), template(F.col("text"), True).alias("e"))


def _hashed(both: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, hash) of the windows of the sizes of both templates."""
    return both.select("doc_id", F.explode(F.concat(*(F.expr(windows(t, size)) for size in sizes for t in "te"))).alias("hash"))


def _few(df: DataFrame) -> DataFrame:
    """A table of ids or hashes, sent to every executor if a count finds it small."""
    return F.broadcast(df) if df.count() <= BROADCAST_WINDOWS else df


def parts(texts: DataFrame, sizes: list[tuple[int, int]], *keys: str) -> DataFrame:
    """(keys, hash) of the windows of each (size, stride) of both templates of (keys, text). A template is one line of words here."""
    pattern = "\\G(?=((?:[^ ]++ ){{{}}}))(?:[^ ]++ ){{{}}}"
    held = texts.select(*keys, numbered(F.col("text")).alias("text"))
    line = lambda every: F.concat(F.ltrim(F.regexp_replace(F.regexp_replace(F.lower(marked(F.col("text"), every)), VALUE, "$1"), "[^\\p{L}\\p{N}\u0001-\u0003]+", " ")), F.lit(" "))
    lines = held.select(*keys, line(False).alias("t"), line(True).alias("e"))
    found = F.concat(*(F.regexp_extract_all(x, F.lit(pattern.format(size, stride)), F.lit(1)) for size, stride in sizes for x in "te"))
    return lines.select(*keys, F.explode(found).alias("part")).select(*keys, F.xxhash64("part").alias("hash"))


def candidates(texts: DataFrame, items: DataFrame, lengths: list[int], scratch: Scratch) -> DataFrame:
    """The rows (doc_id, text) that share a part of a window, or a whole short item, with the benchmark."""
    sizes = [(PART, STRIDE) if s == WINDOW else (s, 1) for s in lengths]
    own = scratch.keep(parts(items, [(s, 1) for s, _ in sizes]).distinct())
    near = scratch.keep(parts(texts, sizes, "doc_id").join(_few(own), "hash", "left_semi").select("doc_id").distinct())
    return scratch.keep(texts.join(_few(near), "doc_id", "left_semi"))


def leaks(docs: DataFrame, items: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, share): items whose windows a document with an id holds, by the share of them that it holds."""
    bench = scratch.keep(benchmark_windows(items))
    keys = bench.select("hash").distinct()
    lengths = [r[0] for r in bench.select(F.size("own")).distinct().collect()] or [WINDOW]  # WINDOW - SHORTEST + 1 values at most
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    texts = candidates(texts, items.select("item_id", "text").filter("item_id is not null and text is not null"), lengths, scratch)
    hits = scratch.keep(_hashed(_both(texts, "doc_id"), lengths).join(_few(keys), "hash").distinct())
    place = ["doc_id", "item_id", "every", "item_p", "total"]
    share = (F.count_distinct("item_p") / F.max("total")).alias("share")
    seen = hits.join(bench.filter("not slots"), "hash").select(place)
    # a window with slots needs the values that fill them: only documents with enough hits of an item, were all of them
    # consistent, are read again
    slotted = bench.filter("slots")
    near = hits.join(bench.select("hash", *place[1:]), "hash").groupBy("doc_id", "item_id", "every").agg(share).filter(F.col("share") >= MIN_SHARE).select("doc_id", "item_id", "every")
    near = scratch.keep(near.join(slotted.select("item_id", "every"), ["item_id", "every"], "left_semi"))
    asked = scratch.keep(near.select("doc_id").distinct())
    if not asked.isEmpty():
        again = scratch.keep(texts.join(_few(asked), "doc_id", "left_semi"))
        for e in (False, True):
            own = slotted.filter(F.col("every") == e)
            filled = _windows_with_words(again, "doc_id", lengths, e).withColumnRenamed("own", "filled").join(own, "hash").join(near, ["doc_id", "item_id", "every"], "left_semi").withColumn("at", F.col("p") - F.col("item_p"))
            seen = seen.unionByName(consistent(scratch.keep(filled)).select(place))
    return seen.groupBy("doc_id", "item_id", "every").agg(share).filter(F.col("share") >= MIN_SHARE).groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def flagged(docs: DataFrame, items: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs(doc_id, text, ...) with n_items and item_ids: the items that each holds. Rows without an id are judged by their text."""
    docs = docs.drop("n_items", "item_ids")

    def join(rows, key):
        found = leaks(rows, items, scratch, id_col=key).groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("item_ids"))  # bounded by the benchmark
        return rows.join(_few(scratch.keep(found)), key, "left").select(*docs.columns, F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"))

    out, lost = join(docs.filter("doc_id is not null"), "doc_id"), docs.filter("doc_id is null")
    if lost.isEmpty():
        return out
    key = "text_" + "_".join(docs.columns)  # a name that no column has
    return out.unionByName(join(lost.withColumn(key, F.md5(F.col("text").cast("binary"))), key))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = flagged(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), Scratch(spark, "leaks"))
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), "n_items", "item_ids")


QUERIES, SQL = {"op10_decontaminate": op10_decontaminate}, {}
