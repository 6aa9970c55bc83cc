from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from playcohort.llm import jaccard_join
from playcohort.llm.queries import op3_jaccard_join


def brute(docs):
    """Links and class of every document, from the definition."""
    sets = []
    for _, text in docs:
        words = (text or "").lower().split()
        size = min(5, len(words))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set())
    owners = defaultdict(list)
    for i, found in enumerate(sets):
        for shingle in found:
            owners[shingle].append(i)
    copies = defaultdict(list)
    for i, (_, text) in enumerate(docs):
        copies[text or ""].append(i)
    root = list(range(len(docs)))
    links = []
    for i, found in enumerate(sets):
        common = Counter(j for shingle in found for j in owners[shingle])
        near = {j for j, n in common.items() if 9 * n >= 4 * (len(found) + len(sets[j]))}
        links.append((near | set(copies[docs[i][1] or ""])) - {i})
    for i in range(len(docs)):
        stack = [i]
        while stack:
            for j in links[stack.pop()]:
                if root[j] > root[i]:
                    root[j] = root[i]
                    stack.append(j)
    return links, root


def check(got, docs):
    links, root = brute(docs)
    ids = [doc for doc, _ in docs]
    of_class = defaultdict(set)
    for i, r in enumerate(root):
        of_class[r].add(ids[i])
    rows = {r.doc_id: r for r in got}
    assert len(rows) == len(docs)
    for i, doc in enumerate(ids):
        assert rows[doc].n_links == len(links[i])
        assert rows[doc].n_text_links == len({docs[j][1] or "" for j in links[i]} - {docs[i][1] or ""})
        assert rows[doc].class_id == min(of_class[root[i]])


def test_whole_table_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op3_jaccard_join(spark, sf).collect(), docs)


def groups(rng):
    """A group of copies, two groups of near copies, chains and texts that share a passage."""
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    passage = word(40)
    docs = [" ".join(word(30))] * 25
    for size in (40, 30):
        base = word(120)
        for _ in range(size):
            text = list(base)
            for at in rng.integers(0, 120, 2):
                text[at] = word(1)[0]
            docs.append(" ".join(text))
    chain = word(90)
    docs += [" ".join(chain[i : i + 60]) for i in range(0, 30, 3)]
    docs += [" ".join([*passage, *word(60)]) for _ in range(30)]
    docs += ["", " \n", "", None, "a", "a", "A", "a b c d", "a b c d e"]
    return list(enumerate(docs))


@pytest.mark.parametrize("block_texts", [1024, 7])
def test_blocks_and_bins_give_every_link(spark, block_texts):
    docs = groups(np.random.default_rng(5))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("root", F.lit("clash"))
    check(jaccard_join.classes_of(frame, block_texts=block_texts).collect(), docs)


def test_keep_one_of_each_class(spark):
    docs = groups(np.random.default_rng(6))
    frame = spark.createDataFrame([(i, t, i) for i, t in docs] + [(0, docs[0][1], 0), (None, "b c", -1), (None, "b c", -1)], "doc_id long, text string, _row long")
    kept = jaccard_join.keep_one(frame)
    assert kept.columns == frame.columns
    _, root = brute(docs)
    ids = sorted((r.doc_id for r in kept.collect() if r.doc_id is not None))
    assert ids == sorted(set(root))
    assert kept.where("doc_id is null").count() == 1


def test_empty_table_and_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.classes_of(empty).count() == 0
    assert jaccard_join.keep_one(empty).count() == 0


def test_prefix_is_the_longest_with_the_recall():
    length = jaccard_join.prefix_length(0.8, 0.999, 32, 12)
    assert 1 - (1 - 0.8**length) ** 32 >= 0.999 > 1 - (1 - 0.8 ** (length + 1)) ** 32
    with pytest.raises(ValueError):
        jaccard_join.prefix_length(0.1, 0.999, 2, 12)


def test_pairs_at_the_threshold_count():
    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    assert jaccard_join.similar([a], [b], Fraction(4, 5)).all()
    assert not jaccard_join.similar([a], [np.arange(2, 10, dtype=np.uint64)], Fraction(4, 5)).any()
