"""Documents that contain passages of a benchmark.

A window is ``width`` consecutive words of an item, or all words of a shorter one. The words
of a document inside any occurrence of a window are hit. This is a containment join of
threshold one, so one token of a window is a sufficient prefix: the rarest of its shingles
in the whole corpus. Documents look up their own shingles among those prefixes; the place of
the shingle in the window gives the only possible start of an occurrence, which the bounds
of the document must allow; the words are then compared in full.

The window table is cut into blocks of about ``block_windows`` rows. A block is what is sent
to the tasks (its size is bounded by that parameter); the documents are read for one block
after the other. With one block they are never shuffled. With more they are written once with
a row number, each block leaves what it found as narrow rows of the documents it hit, and the
merged rows join the documents at the end. Occurrence counts of the shingles are summed over the whole corpus.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased: digits, letters
a-z and everything outside ASCII. Null and empty texts have no words and no hits; an item
without words has no windows. Repeated documents and items count like others, items of equal
id as one. Items without an id take part under the empty id. Empty tables give empty results
or none hit.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playcohort.llm.common import add_columns, bounded_batches, fresh, map_rows, text_of
from playcohort.session import staged

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    # bytes.lower() changes A-Z only.
    return WORD.findall(text.encode().lower()) if text else []


def windows_of(words: list[bytes], width: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def shingles_of(window: bytes, size: int) -> list[bytes]:
    words = window.split(b" ")
    size = min(size, len(words))
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def sizes_by_first(shingles) -> dict[bytes, tuple[int, ...]]:
    """First word of a shingle -> the numbers of words that shingles with it have."""
    sizes: dict[bytes, set[int]] = {}
    for shingle in shingles:
        words = shingle.split(b" ")
        sizes.setdefault(words[0], set()).add(len(words))
    return {word: tuple(sorted(found)) for word, found in sizes.items()}


def occurrences(words: list[bytes], sizes: dict[bytes, tuple[int, ...]], shingles) -> Iterator[tuple[int, bytes]]:
    """(position, shingle) for every place of ``words`` that starts one of ``shingles``."""
    for i in [i for i, word in enumerate(words) if word in sizes]:
        for size in sizes[words[i]]:
            if i + size <= len(words) and (shingle := b" ".join(words[i : i + size])) in shingles:
                yield i, shingle


def corpus_counts(docs: DataFrame, shingles: set[bytes]) -> dict[bytes, int]:
    """How often each of ``shingles`` occurs in all texts of ``docs`` (one string column)."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((sizes_by_first(shingles), frozenset(shingles)))
    target = pa.schema([("shingle", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, wanted = shared.value
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(shingle for _, shingle in occurrences(words_of(text), sizes, wanted))
        yield pa.RecordBatch.from_pydict({"shingle": list(counts), "n": list(counts.values())}, schema=target)

    summed = docs.mapInArrow(count, "shingle binary, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    # At most one row per shingle of the block.
    counts = {bytes(row["shingle"]): row["n"] for row in summed.collect()}
    shared.unpersist()
    return counts


def prefix_index(rows: list[tuple[str, bytes]], counts: dict[bytes, int], size: int) -> dict:
    """Rarest shingle -> {(its place, words of the window) -> {window -> its items}}."""
    index: dict = {}
    for item, window in rows:
        shingles = shingles_of(window, size)
        place = min(range(len(shingles)), key=lambda i: (counts.get(shingles[i], 0), shingles[i]))
        length = window.count(b" ") + 1
        entry = index.setdefault(shingles[place], {}).setdefault((place, length), {})
        entry.setdefault(window, []).append(item)
    return index


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Starts and ends of the union of ``spans``, one after the other."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def mark(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 13,
    shingle: int = 3,
    block_windows: int = 200_000,
    prefix: str = "",
) -> DataFrame:
    """``docs`` with ``n_words``, ``hits`` (starts and ends of the hit word ranges) and ``items``.

    The names get ``prefix`` in front; together they must be new to ``docs``.
    """
    rows = staged(
        map_rows(
            benchmark.select(
                F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"),
                text_of(item_text_col).alias("text"),
            ),
            lambda c: (
                lambda pairs: {"item": [item for item, _ in pairs], "window": [window for _, window in pairs]}
            )([(item, w) for item, text in zip(c["item"], c["text"]) for w in windows_of(words_of(text), width)]),
            "item string, window binary",
        ).distinct()
    )
    blocks = max(1, -(-rows.count() // block_windows))
    n_words, hits, items = (f"{prefix}{name}" for name in ("n_words", "hits", "items"))
    added = (
        T.StructType()
        .add(n_words, "long")
        .add(hits, T.ArrayType(T.LongType(), containsNull=False))
        .add(items, T.ArrayType(T.StringType(), containsNull=False))
    )
    # Item and window are hashed together, so a window that many items share is dealt out.
    block_of = F.pmod(F.xxhash64("item", "window"), F.lit(blocks))
    texts = docs.select(F.col(text_col).cast("string"))
    spark = docs.sparkSession

    def finder(number: int) -> Callable[[list], dict[str, list]]:
        """What finds the windows of one block in a list of texts."""
        block = [(r["item"], bytes(r["window"])) for r in rows.where(block_of == number).collect()]
        wanted = {s for _, window in block for s in shingles_of(window, shingle)}
        index = prefix_index(block, corpus_counts(texts, wanted), shingle)
        shared = spark.sparkContext.broadcast((sizes_by_first(index), index))

        def find(found_texts: list) -> dict[str, list]:
            sizes, lookup = shared.value
            out: dict[str, list] = {n_words: [], hits: [], items: []}
            for text in found_texts:
                words = words_of(text)
                spans, names = [], set()
                for at, token in occurrences(words, sizes, lookup):
                    for (place, length), windows in lookup[token].items():
                        start = at - place
                        if start >= 0 and start + length <= len(words):
                            owners = windows.get(b" ".join(words[start : start + length]))
                            if owners:
                                spans.append((start, start + length))
                                names.update(owners)
                out[n_words].append(len(words))
                out[hits].append(merged(spans))
                out[items].append(sorted(names))
            return out

        return find

    if blocks == 1:
        return add_columns(docs, [text_col], finder(0), added)
    # Rows are written once, with a number; of a block only what it found is kept.
    row = fresh(docs, "_row")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    texts = numbered.select(F.col(text_col).cast("string"))
    narrow = numbered.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text"))

    def found_in(number: int) -> DataFrame:
        find = finder(number)
        seen = add_columns(narrow, ["text"], find, added).drop("text")
        # The first block tells the words of every row.
        return staged(seen if number == 0 else seen.where(F.size(hits) > 0))

    everything = reduce(DataFrame.unionByName, [found_in(number) for number in range(blocks)])
    summed = everything.groupBy("row").agg(
        F.max(n_words).alias(n_words),
        F.flatten(F.collect_list(hits)).alias(hits),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items),
    )
    together = map_rows(
        summed,
        lambda c: {**c, hits: [merged(list(zip(spans[::2], spans[1::2]))) for spans in c[hits]]},
        T.StructType().add("row", "long").add(n_words, "long").add(hits, added[hits].dataType).add(items, added[items].dataType),
    ).withColumnRenamed("row", f"{row}_found")
    return numbered.join(staged(together), F.col(row) == F.col(f"{row}_found")).select(*docs.columns, n_words, hits, items)


def hit_words(hits: Column) -> Column:
    """Words in the ranges of ``hits``."""
    signed = F.transform(hits, lambda at, i: F.when(i % 2 == 0, -at).otherwise(at))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda total, at: total + at)


def contaminated(hits: Column, n_words: Column, share: int = 20) -> Column:
    """Whether any word is hit and at least one in ``share``."""
    return (hit_words(hits) > 0) & (hit_words(hits) * share >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    prefix = "_bench_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    found = mark(docs, benchmark, prefix=prefix, **options)
    bad = contaminated(F.col(f"{prefix}hits"), F.col(f"{prefix}n_words"))
    return found.where(~bad).select(*docs.columns)
