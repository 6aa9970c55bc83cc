"""Licence notices in documents, by a trained paragraph classifier.

Paragraphs (lines) are classified into licence families by a sparse multinomial logistic
regression over word unigrams and bigrams. It is fitted here on generated wordings of every
family (``licence_texts``: names and identifiers in frames, sentences of the licence texts), each
family with the same weight, on wordings that deny a licence (a class ``negated``) and, for
the class ``unknown``, on paragraphs of the corpus and on sentences that use the same words
otherwise. The vocabulary is that of the wordings without n-grams of common words only (words
in over ``common`` of the corpus paragraphs that share no bigram with a wording), so an
n-gram that can move a score has a rare word, and a paragraph without any rare word has at most
the mark of a denial: unknown. That makes looking only at paragraphs with a rare word exact.

Words are counted, ``unknown`` is learned and the least probability is taken on all paragraphs of
the corpus. Those with the same n-grams of the wordings are one row with their number; all
together they weigh at most ``corpus_weight``, so a large corpus does not drown the wordings.

``unknown`` is calibrated on the half of the corpus paragraphs kept from fitting: a family must reach a
probability that at most ``alpha`` of them reach (and one half). A prediction counts if it is
confirmed by a template: ``confirm`` of the bigrams of a sentence, name or identifier of the
family must be in the paragraph. A paragraph that is only a name is a mention, not a notice.

Notices wrapped over several lines are found in runs of lines without a blank one between: from
each line on, the line and as many following words as the longest sentence has are classified
and compared with the sentences. Lines that are covered by a sentence themselves end a run as
blank ones do. A wrapped notice is reported at the last line from which its sentence is covered
best, and a line inside it with the name of its family belongs to it, so copies that follow each
other without a blank line may count as one. Only documents that hold ``confirm`` of the bigrams
of some sentence are looked at again, which leaves out none.

Only DataFrame expressions and MLlib. Texts are read once to count the n-grams of the wordings and
once to find paragraphs with rare words; only n-grams and those paragraphs move.

Null and empty texts have no paragraphs. Repeated rows give equal rows. With an empty table
the result is empty. Only the named columns are read.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from playcohort.llm import licence_texts
from playcohort.llm.common import text_of
from playcohort.session import staged

UNKNOWN = "unknown"
NEGATED = "negated"
#: Stands among the n-grams of a paragraph that denies a licence; no word has this form.
DENIAL = "<denied>"

#: What all corpus paragraphs of the fit weigh together, at most; one weighs 1 in a smaller corpus.
CORPUS_WEIGHT = 2_000.0

# The same words without a licence.
OTHER_USES = [
    "A driving license is required for this position.",
    "The license fee was raised for the third time this year.",
    "She was licensed as a pilot in her youth.",
    "The Apache flew low over the valley.",
    "Researchers at MIT released a new version of their paper.",
    "The general public was not admitted to the rights committee.",
    "They reserved a table for all of us.",
    "He works for a public library in the domain of education.",
    "The terms of the agreement were published on Monday.",
    "A copy of the notice was sent to every person.",
    "Creative people share common interests.",
    "The software foundation was founded without any charge.",
    "Version 2.0 of the program was released yesterday.",
    "This is a version of the story under another title.",
    "The source of the river is subject to dispute.",
    "All files are reserved for the documentation department.",
]


# Characters one by one: a class of single characters is looked up in a table of bits, one of ranges
# is asked range by range, which takes several times as long.
_PLAIN = "abcdefghijklmnopqrstuvwxyz0123456789"
_OTHER = f"[^{_PLAIN}.+-]"
#: Between words: signs other than ``.+-`` with all signs around them, and ``.+-`` at either end of
#: the text. A letter fails every branch at its first step.
BETWEEN_WORDS = rf"(?:{_OTHER}|[.+-]++(?:{_OTHER}|\z)|^[.+-]++)[^{_PLAIN}]*+"


def words(paragraph: Column) -> Column:
    """Lower-cased words; versions and hyphenated names stay whole."""
    return F.filter(F.split(F.lower(paragraph), BETWEEN_WORDS), lambda w: w != "")


def bigrams(tokens: Column) -> Column:
    following = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(tokens, following, lambda a, b: F.concat_ws(" ", a, b))
    return F.slice(pairs, 1, F.greatest(F.size(tokens) - 1, F.lit(0)))


def ngrams(tokens: Column) -> Column:
    return F.array_distinct(F.concat(tokens, bigrams(tokens)))


def marks(tokens: Column) -> Column:
    """The stems of taught identifiers (``gpl*`` of GPL-3.0-or-later and GPLv3) and a mark where
    a licence is denied."""
    denied = F.concat_ws(" ", tokens).rlike(licence_texts.NEGATION)
    mark = F.when(denied, F.array(F.lit(DENIAL))).otherwise(F.array().cast("array<string>"))
    named = F.filter(tokens, lambda w: w.isin(licence_texts.identifying()))
    stems = F.transform(named, lambda w: F.concat(F.regexp_replace(w, "-?v?[0-9].*$", ""), F.lit("*")))
    return F.concat(stems, mark)


def marked(tokens: Column) -> Column:
    """The n-grams that are classified: those of the words, and the marks."""
    return F.array_distinct(F.concat(ngrams(tokens), marks(tokens)))


def constant_rows(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """``family`` and ``tokens`` of fixed texts, as one literal of the plan."""
    listed = json.dumps([{"family": family, "paragraph": text} for family, text in rows])
    entries = F.from_json(F.lit(listed), "array<struct<family string, paragraph string>>")
    return spark.range(1).select(F.inline(entries)).select("family", words(F.col("paragraph")).alias("tokens"))


def listed_texts(spark: SparkSession, texts: Callable[[str], list[str]]) -> DataFrame:
    return constant_rows(spark, [(family, text) for family in licence_texts.NAMES for text in texts(family)])


def parts(tokens: Column) -> Column:
    """The bigrams of a template; of one word, the word."""
    return F.array_distinct(F.when(F.size(tokens) > 1, bigrams(tokens)).otherwise(tokens))


def crops(tokens: Column) -> Column:
    """The words of a notice, and without its first and last ones, as in other contexts."""
    size = F.size(tokens)
    shorter = F.greatest(size - 1, F.lit(1))
    return F.array_distinct(F.array(tokens, F.slice(tokens, 1, shorter), F.slice(tokens, 2, shorter)))


class Classifier:
    """A fitted model: vocabulary, regression, rare words and the least probability of a family."""

    def __init__(self, rare: list[str], vectors: CountVectorizerModel, regression, families: list[str], least: float):
        self.rare, self.vectors, self.regression = rare, vectors, regression
        self.families, self.least = families, least

    def predict(self, paragraphs: DataFrame) -> DataFrame:
        """``paragraphs`` (with ``tokens``) with ``family`` (maybe unknown) and ``probability``."""
        return self.classify(paragraphs.withColumn("_grams", marked(F.col("tokens"))))

    def classify(self, counted: DataFrame) -> DataFrame:
        """The same for rows with their ``_grams``."""
        scored = self.regression.transform(self.vectors.transform(counted))
        chance = vector_to_array("_probability")
        known = F.slice(chance, 1, len(self.families))
        names = F.array(*[F.lit(f) for f in self.families])
        best = F.array_max(known)
        family = F.when(best >= self.least, F.element_at(names, F.array_position(known, best).cast("int")))
        return scored.withColumn("probability", best).withColumn("family", F.coalesce(family, F.lit(UNKNOWN))).drop(
            "_grams", "_counts", "_raw", "_probability", "_predicted"
        )


def corpus_grams(docs: DataFrame, text_col: str, listed: list[str], seed: int) -> DataFrame:
    """All paragraphs with a word, as the ``grams`` of them that are ``listed`` (sorted), whether
    their text is ``held`` from fitting (by a hash of it), and how many there are."""
    text = text_of(text_col)
    held = F.pmod(F.xxhash64(F.lit(seed), text), F.lit(2)) == 0
    # Inside of the explode the words are worked out once, and not again for the filter.
    lines = docs.select(held.alias("held"), F.explode(F.transform(F.split(text, "\n"), words)).alias("tokens"))
    rows = lines.where(F.size("tokens") > 0)
    single, pairs = [g for g in listed if " " not in g], [g for g in listed if " " in g]
    # Without a listed word there is no listed n-gram: a denial, a stem and a pair all have one.
    own = F.filter("tokens", lambda w: w.isin(single))
    none = F.array().cast("array<string>")
    of_pairs = F.when(F.size(own) > 1, F.filter(bigrams(F.col("tokens")), lambda g: g.isin(pairs))).otherwise(none)
    of_marks = F.filter(marks(F.col("tokens")), lambda g: g.isin(single))
    grams = F.when(F.size(own) > 0, F.sort_array(F.array_distinct(F.concat(own, of_pairs, of_marks)))).otherwise(none)
    return rows.select("held", grams.alias("grams")).groupBy("held", "grams").agg(F.count(F.lit(1)).alias("n"))


def least_probability(scored: DataFrame, alpha: float) -> float:
    """The probability that more than ``alpha`` of the paragraphs (``probability``, ``n``) do not exceed,
    or one half if that is larger. Counted in 50,000 steps, the largest value of the step is taken."""
    total = scored.agg(F.sum("n")).first()[0] or 0
    high = scored.where(F.col("probability") > 0.5).groupBy(F.floor(F.col("probability") * 100_000).alias("step"))
    steps = high.agg(F.sum("n").alias("n"), F.max("probability").alias("p")).orderBy(F.desc("step")).collect()
    above = 0
    for r in steps:
        above += r["n"]
        if above > alpha * total:
            return float(r["p"])
    return 0.5


def train(
    docs: DataFrame,
    text_col: str = "text",
    corpus_weight: float = CORPUS_WEIGHT,
    common: float = 0.01,
    alpha: float = 0.001,
    penalty: float = 1e-4,
    family_weight: float = 400.0,
    seed: int = 0,
) -> Classifier:
    spark = docs.sparkSession
    families = sorted(licence_texts.NAMES)
    named = [(family, text) for family in families for text in licence_texts.wordings(family)]
    whole = {text for texts in licence_texts.SENTENCES.values() for text in texts}
    taught = staged(
        constant_rows(spark, [pair for pair in named if pair[1] in whole]).select("family", F.explode(crops(F.col("tokens"))).alias("tokens"))
        .unionByName(constant_rows(spark, [pair for pair in named if pair[1] not in whole]))
        .unionByName(constant_rows(spark, [(NEGATED, text) for family in families for text in licence_texts.negated(family)]))
    )
    other = constant_rows(spark, [(UNKNOWN, text) for text in OTHER_USES])
    # The n-grams of the wordings; the list has a bound.
    grams = sorted(r["gram"] for r in taught.select(F.explode(marked(F.col("tokens"))).alias("gram")).distinct().collect())
    # Marks are of rare words or count for nothing alone.
    made = {g for g in grams if g.endswith("*") or g == DENIAL}
    pairs = [g for g in grams if " " in g]
    corpus = staged(corpus_grams(docs, text_col, grams, seed))
    # Words of the notices that the corpus rarely uses. The corpus has licence notices of its own,
    # as many as it likes, so lines with a bigram of one are left out.
    plain = corpus.where(~F.exists("grams", lambda g: g.isin(pairs)))
    size = max(1, plain.agg(F.sum("n")).first()[0] or 0)
    used = plain.select(F.explode("grams").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = {r["word"] for r in used.where(F.col("n") > common * size).collect()}
    rare = [g for g in grams if g not in made and " " not in g and g not in frequent]
    known = set(rare)
    vocabulary = [g for g in grams if g in made or not known.isdisjoint(g.split(" "))]
    rare += sorted(made)
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="_grams", outputCol="_counts")
    vectors.setBinary(True)
    # Corpus paragraphs with a whole bigram of a notice may be notices and are not used as unknown.
    whole_pairs = [g for g in vocabulary if " " in g]
    clean = corpus.where(~F.exists("grams", lambda g: g.isin(whole_pairs))) if whole_pairs else corpus
    in_fit = F.filter("grams", lambda g: g.isin(vocabulary))
    clean = staged(clean.groupBy("held", in_fit.alias("_grams")).agg(F.sum("n").alias("n")))
    names = F.array(*[F.lit(f) for f in [*families, NEGATED, UNKNOWN]])
    # A family weighs the same however many wordings it has.
    number = {r["family"]: r["count"] for r in taught.groupBy("family").count().collect()}
    weight = F.lit(1.0)
    for family, count in number.items():
        weight = F.when(F.col("family") == family, F.lit(family_weight / count)).otherwise(weight)
    fitted = clean.where(~F.col("held"))
    share = min(1.0, corpus_weight / max(1, fitted.agg(F.sum("n")).first()[0] or 0))
    rows = taught.unionByName(other).select("family", marked(F.col("tokens")).alias("_grams"), weight.alias("weight"))
    rows = rows.unionByName(fitted.select(F.lit(UNKNOWN).alias("family"), "_grams", (share * F.col("n")).alias("weight")))
    label = (F.array_position(names, F.col("family")) - 1).cast("double")
    ready = staged(rows.select("_grams", label.alias("label"), "weight"))
    regression = LogisticRegression(
        featuresCol="_counts", labelCol="label", weightCol="weight", probabilityCol="_probability",
        rawPredictionCol="_raw", predictionCol="_predicted", family="multinomial", elasticNetParam=1.0,
        regParam=penalty, standardization=False, maxIter=50,
    ).fit(vectors.transform(ready))
    model = Classifier(rare, vectors, regression, families, 0.5)
    model.least = least_probability(model.classify(clean.where("held")), alpha)
    return model


def wrapped(docs: DataFrame, longest: int) -> DataFrame:
    """Every line that is followed by another: its words and the next ``longest`` of its run."""
    none = F.array().cast("array<string>")

    def following(lines: Column, i: Column) -> Column:
        # A line of a run has a word at least, so no more lines can be needed.
        rest = F.slice(lines, i + 2, longest)
        blank = F.array_position(F.transform(rest, lambda t: F.size(t) == 0), True).cast("int")
        return F.when(blank > 0, F.slice(rest, 1, blank - 1)).otherwise(rest)

    # The words so far and the lines they need.
    nothing = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
    count = lambda so_far, t: F.struct(
        (so_far["words"] + F.size(t)).alias("words"), (so_far["lines"] + (so_far["words"] < longest).cast("int")).alias("lines")
    )
    runs = F.transform(
        "lines",
        lambda t, i: F.struct(
            i.alias("at"), t.alias("_first"), F.when(F.size(t) > 0, following(F.col("lines"), i)).otherwise(F.array(none)).alias("_rest")
        ),
    )
    rows = docs.select("row", F.inline(runs)).withColumn("_words", F.slice(F.flatten("_rest"), 1, longest))
    rows = rows.where(F.size("_words") > 0)
    return rows.select(
        "row", "at", (F.col("at") + F.aggregate("_rest", nothing, count)["lines"]).alias("last"),
        F.concat("_first", "_words").alias("tokens"),
    )


def find_licences(
    docs: DataFrame,
    model: Classifier | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    confirm: float = 0.6,
) -> DataFrame:
    """One row per document: id, ``notices`` (paragraph number from 0, family, probability), sorted."""
    model = model or train(docs, text_col)
    spark = docs.sparkSession
    lines = F.split(text_of(text_col), "\n")
    numbered = F.transform(lines, lambda line, i: F.struct(i.alias("at"), words(line).alias("tokens")))
    held = docs.select(
        F.col(id_col).alias("id"),
        F.filter(numbered, lambda p: F.exists(p["tokens"], lambda w: w.isin(model.rare))).alias("paragraphs"),
        text_of(text_col).alias("text"),
    )
    # Documents that may hold a wrapped notice keep the words of all their lines.
    given = [r["tokens"] for r in listed_texts(spark, lambda f: licence_texts.SENTENCES.get(f, [])).collect()]
    names = [" ".join(r["tokens"]) for r in listed_texts(spark, licence_texts.NAMES.get).collect()]
    listed = F.array(*[F.array(*[F.lit(f"{a} {b}") for a, b in sorted(set(zip(t, t[1:])))]) for t in given])
    pairs = F.array(*[F.lit(g) for g in sorted({f"{a} {b}" for t in given for a, b in zip(t, t[1:])})])
    covers = lambda own: F.exists(listed, lambda t: F.size(F.array_intersect(t, own)) >= confirm * F.size(t))
    # The one-element array makes the bigrams a variable, computed once.
    may_wrap = F.exists(F.array(F.array_intersect(bigrams(words(F.col("text"))), pairs)), covers)
    split = F.transform(F.split("text", "\n"), words)
    held = held.select(
        "id", "paragraphs", F.when((F.size("paragraphs") > 0) & may_wrap, split).alias("lines")
    )
    held = staged(held.withColumn("row", F.monotonically_increasing_id()))
    # Fixed texts: a few dozen a family.
    whole = listed_texts(spark, lambda f: licence_texts.SENTENCES.get(f, []))
    by_family = (
        listed_texts(spark, licence_texts.confirming).withColumn("short", F.lit(True)).unionByName(whole.withColumn("short", F.lit(False)))
        .groupBy(F.col("family").alias("_family"))
        .agg(
            F.collect_list(F.when(F.col("short"), parts(F.col("tokens")))).alias("_templates"),
            F.collect_list(F.when(~F.col("short"), parts(F.col("tokens")))).alias("_sentences"),
        )
    )

    def confirmed(paragraphs: DataFrame) -> DataFrame:
        """The classified paragraphs, how far a template covers each and how far a sentence does."""
        # A name alone is a mention.
        stated = paragraphs.where(~F.concat_ws(" ", "tokens").isin(names))
        predicted = model.predict(stated).where(F.col("family") != UNKNOWN)
        compared = predicted.join(F.broadcast(by_family), F.col("family") == F.col("_family"))
        own = compared.withColumn("_own", ngrams(F.col("tokens")))
        cover = lambda c: F.array_max(F.transform(c, lambda t: F.size(F.array_intersect(t, F.col("_own"))) / F.size(t)))
        both = own.withColumns({"covered": cover("_templates"), "whole": F.coalesce(cover("_sentences"), F.lit(0.0))})
        return both.select("row", "at", "last", "family", "probability", "covered", "whole")

    single = held.select("row", F.inline("paragraphs")).withColumn("last", F.col("at"))
    found = staged(confirmed(single).where(F.col("covered") >= confirm))
    alone = found.where(F.col("whole") >= confirm).groupBy(F.col("row").alias("_row")).agg(F.collect_set("at").alias("_alone"))
    open_docs = held.where(F.col("lines").isNotNull()).select("row", "lines")
    open_docs = open_docs.join(alone, F.col("row") == F.col("_row"), "left").select(
        "row",
        F.transform(
            "lines",
            lambda t, i: F.when(F.array_contains(F.coalesce("_alone", F.array().cast("array<int>")), i), F.array().cast("array<string>")).otherwise(t),
        ).alias("lines"),
    )
    starts = wrapped(open_docs, max(map(len, given)))
    starts = starts.where(F.exists(F.array(bigrams(F.col("tokens"))), covers))
    # Of the neighbouring lines from which a sentence is seen, the last with the best cover.
    near = Window.partitionBy("row", "family").orderBy("at")
    before = F.when(F.lag("at").over(near) == F.col("at") - 1, F.lag("whole").over(near))
    after = F.when(F.lead("at").over(near) == F.col("at") + 1, F.lead("whole").over(near))
    seen = confirmed(starts).where(F.col("whole") >= confirm)
    best = seen.withColumns({"_before": F.coalesce(before, F.lit(0.0)), "_after": F.coalesce(after, F.lit(0.0))})
    best = staged(best.where((F.col("whole") >= F.col("_before")) & (F.col("whole") > F.col("_after"))).select(found.columns))
    # A line with the name only, inside of a wrapped sentence, belongs to it.
    spans = best.select(F.col("row").alias("_row"), F.col("family").alias("_of"), F.col("at").alias("_from"), F.col("last").alias("_to"))
    inside = (F.col("row") == F.col("_row")) & (F.col("family") == F.col("_of")) & F.col("at").between(F.col("_from"), F.col("_to"))
    free = found.join(spans, inside & (F.col("whole") < confirm), "left_anti")
    found = free.unionByName(best)
    lists = found.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct(F.col("at").cast("long").alias("paragraph"), "family", "probability"))).alias("notices")
    )
    none = F.array().cast(lists.schema["notices"].dataType)
    return held.join(lists.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left").select(
        F.col("id").alias(id_col), F.coalesce("notices", none).alias("notices")
    )
