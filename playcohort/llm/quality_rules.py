"""Quality rules whose thresholds follow the corpus: fences from quantile sketches per group.

Every document gets a few counts (words, their characters, symbols, repeated lines, words in
repeated five-word windows). Fixed base rules come first. For the documents that pass them
four ratios are sketched per language and source: an integer histogram that is exact up to
4,095 thousandths and keeps twelve leading bits beyond, so a sketch has a bounded number of
buckets, and adding counts merges sketches in any order to the same result.

Every sketch is smoothed by its parent: the language's sketch gets ``weight`` documents at
even quantiles of the corpus', the sketch of a language and source as many at those of its
smoothed language. A small group so follows its parents and a large one itself, without a
size at which that changes. The fence of a ratio is a high quantile of the smoothed sketch
plus a multiple of its distance to a lower one (``RULES``); no fence has a fixed value. A
document is kept when all its ratios lie within the fences of its group.

Only built-in expressions: whole texts are turned into counts where they are read, nothing
but narrow rows is shuffled, and the histogram is summed before the shuffle. The thresholds
join the documents as a written table, so Spark knows its size before it broadcasts it, and
splits a hot group where it does not.

A null text has no words and fails the base rules. Null languages and sources are groups.
Repeated rows count like others. An empty table gives an empty table. Only the named columns
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playcohort.llm.common import text_of
from playcohort.session import staged

WHITE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
SPAN = 5
#: More than any array holds, and far from the overflow of start plus length.
REST = 2**30

#: Ratio -> (numerator, denominator), as thousandths.
RATIOS = {
    "word_length": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
}

#: Ratio -> (lower level, upper level, reach): the fence is the quantile at the upper level plus
#: ``reach`` times its distance to the lower one; levels in hundredths. Lengths of words and
#: symbols are compared with the bulk of the group; repetition, which most documents have
#: none of, with its tail.
RULES = {
    "word_length": (50, 90, 3),
    "symbol_share": (50, 90, 3),
    "dup_line_share": (90, 99, 1),
    "repeat_share": (90, 99, 1),
}
#: Ratios whose low values are outside too, by the mirrored levels.
LOWER = {"word_length"}
#: Documents that a parent's sketch counts for.
WEIGHT = 100


def repeated(hashes: Column) -> Column:
    """Places covered by the windows of ``SPAN`` places whose hash occurs more than once."""
    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<int>")
    same = F.zip_with(
        ordered,
        F.slice(ordered, 2, REST),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(none),
    )
    places = F.sort_array(F.array_distinct(F.flatten(same)))
    covers = F.zip_with(
        places, F.slice(places, 2, REST), lambda a, b: F.least(F.coalesce(b - a, F.lit(SPAN)), F.lit(SPAN))
    )
    return F.aggregate(covers, F.lit(0), lambda total, n: total + n)


def counted(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and the counts of each document."""
    keep = keep or []
    text = text_of(text_col)
    cut = docs.select(
        *keep,
        text.alias("_text"),
        F.array_remove(F.split(text, WHITE), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("_lines"),
    )
    hashed = cut.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda word: F.xxhash64(word)).alias("_h"),
    )
    # Hashes of two, four and five words in a row; those that run over the end are cut off.
    both = lambda a, b: F.xxhash64(a, b)
    two = hashed.withColumn("_two", F.zip_with("_h", F.slice("_h", 2, REST), both))
    four = two.withColumn("_four", F.zip_with("_two", F.slice("_two", 3, REST), both))
    windows = F.slice(F.zip_with("_four", F.slice("_h", SPAN, REST), both), 1, F.greatest(F.size("_h") - SPAN + 1, F.lit(0)))
    five = four.withColumn("_five", windows)
    again = F.size(F.array_distinct("_five")) < F.size("_five")
    return five.withColumn(
        "n_repeat_words", F.when(again, repeated(F.col("_five"))).otherwise(F.lit(0)).cast("long")
    ).drop("_h", "_two", "_four", "_five")


def base_failed() -> Column:
    """The fixed rules: too few words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def thousandths(numerator: str, denominator: str) -> Column:
    return F.when(F.col(denominator) > 0, F.expr(f"({numerator} * 1000) div {denominator}")).otherwise(F.lit(0))


def bucket(value: Column) -> Column:
    """The value with its twelve leading bits kept."""
    drop = F.greatest(F.length(F.bin(value)) - 12, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(rows: DataFrame, group: list[str]) -> DataFrame:
    """Histogram of every ratio in every group: ``group``, ratio, bucket, n."""
    entries = F.explode(
        F.array(*[F.struct(F.lit(r).alias("ratio"), bucket(F.col(r)).alias("bucket")) for r in RATIOS])
    )
    return (
        rows.select(*group, entries.alias("_e"))
        .groupBy(*group, "_e.ratio", "_e.bucket")
        .agg(F.count("*").alias("n"))
    )


def merged(sketch: DataFrame, group: list[str]) -> DataFrame:
    """Sketches of coarser groups."""
    return sketch.groupBy(*group, "ratio", "bucket").agg(F.sum("n").alias("n"))


def upto(group: list[str]) -> Column:
    """Documents of a sketch up to and with a bucket."""
    return F.sum("n").over(Window.partitionBy(*group, "ratio").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))


def of_all(group: list[str]) -> Column:
    return F.sum("n").over(Window.partitionBy(*group, "ratio"))


def even_quantiles(sketch: DataFrame, group: list[str], weight: int) -> DataFrame:
    """A sketch of ``weight`` documents at even quantiles (the middles of equal shares) of each one."""
    ranked = sketch.select(*group, "ratio", "bucket", "n", upto(group).alias("_upto"), of_all(group).alias("_all"))
    share = lambda x: F.expr(f"({2 * weight} * ({x}) + _all) div (2 * _all)")
    return ranked.select(*group, "ratio", "bucket", (share("_upto") - share("_upto - n")).alias("n")).where("n > 0")


def smoothed(sketch: DataFrame, group: list[str], parent: DataFrame, parent_group: list[str]) -> DataFrame:
    """Each sketch with the documents that its parent stands for."""
    given = parent.withColumnsRenamed({**{c: f"_{c}" for c in parent_group}, "ratio": "_ratio"})
    same = F.col("ratio") == F.col("_ratio")
    for c in parent_group:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    from_parent = sketch.select(*group, "ratio").distinct().join(given, same).select(*group, "ratio", "bucket", "n")
    return merged(sketch.unionByName(from_parent), group)


def thresholds(sketch: DataFrame, weight: int) -> DataFrame:
    """Fences of every (language, source): ``<ratio>_high``, and ``<ratio>_low`` where low values count."""
    corpus = even_quantiles(merged(sketch, []), [], weight)
    by_lang = smoothed(merged(sketch, ["lang"]), ["lang"], corpus, [])
    group = ["lang", "source"]
    by_source = smoothed(sketch, group, even_quantiles(by_lang, ["lang"], weight), ["lang"])
    ranked = by_source.select(*group, "ratio", "bucket", upto(group).alias("_upto"), of_all(group).alias("_all"))

    def at(ratio: str, level: int) -> Column:
        reached = (F.col("ratio") == ratio) & (F.col("_upto") * 100 >= F.col("_all") * level)
        return F.min(F.when(reached, F.col("bucket")))

    def fence(ratio: str, low: int, high: int, reach: int) -> Column:
        return at(ratio, high) + reach * (at(ratio, high) - at(ratio, low))

    highs = [fence(r, *rule).alias(f"{r}_high") for r, rule in RULES.items()]
    lows = [fence(r, 100 - RULES[r][0], 100 - RULES[r][1], RULES[r][2]).alias(f"{r}_low") for r in RATIOS if r in LOWER]
    return ranked.groupBy(*group).agg(*highs, *lows)


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    weight: int = WEIGHT,
) -> DataFrame:
    """One row per document: id, the counts, ``base_failed``, ``kept`` and the ratios."""
    named = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text")
    )
    rows = counted(named, "text", ["id", "lang", "source"])
    rows = rows.select("*", *[thousandths(*pair).alias(name) for name, pair in RATIOS.items()])
    rows = staged(rows.withColumn("base_failed", base_failed()))
    sketch = staged(sketches(rows.where(~F.col("base_failed")), ["lang", "source"]))
    limits = staged(thresholds(sketch, weight)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    inside = F.lit(True)
    for r in RATIOS:
        # Fences are made of buckets.
        inside &= bucket(F.col(r)) <= F.col(f"{r}_high")
        if r in LOWER:
            inside &= bucket(F.col(r)) >= F.col(f"{r}_low")
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    return rows.join(limits, same, "left").select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        kept.alias("kept"),
        *RATIOS,
    )
