import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from playcohort.llm import decontaminate
from playcohort.llm.queries import op5_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=13):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[i : i + width])].add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((doc, len(w), len(hit), sorted(found)))
    return out


def test_whole_table_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {
        (doc, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n)
        for doc, n, hit, found in brute(docs, items)
    }
    assert {tuple(r) for r in op5_decontamination(spark, sf).collect()} == want
    assert any(row[-1] for row in want)


DOCS = [
    (None, None), (1, ""), (2, "One two THREE four"), (3, "x one two three four y one two"), (3, "x one two three four y one two"),
    (4, "Ä ä É one-two+three four five six seven eight"), (5, "7 " * 5000 + "one two three four"), (6, "é 9 é 9 é 9"), (7, "three four one two"),
]
ITEMS = [
    (1, "one two three four"), (1, "one two three four"), (2, "two"), (3, None), (4, "..."), (None, "é 9 é"),
    (10, "three four five six seven eight nine"), (11, "four five six seven eight"),
]


@pytest.mark.parametrize("block_windows, shingle, width", [(200_000, 3, 13), (2, 3, 4), (1, 1, 3), (3, 5, 2)])
def test_blocks_shingles_and_odd_rows(spark, block_windows, shingle, width):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("hits_before", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("window", F.lit(0))
    got = decontaminate.mark(docs, items, width=width, shingle=shingle, block_windows=block_windows)
    rows = got.select("doc_id", "n_words", decontaminate.hit_words(F.col("hits")).alias("n"), "items").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, brute(DOCS, ITEMS, width)))


def test_contaminated_documents_go(spark):
    docs = spark.createDataFrame([(*row, 1) for row in DOCS], "doc_id long, text string, _bench_hits int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.decontaminate(docs, items)
    assert kept.columns == docs.columns
    want = sorted(str(doc) for doc, n, hit, _ in brute(DOCS, ITEMS) if not (hit > 0 and 20 * hit >= n))
    assert sorted(str(r.doc_id) for r in kept.collect()) == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).count() == len(DOCS)
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0
