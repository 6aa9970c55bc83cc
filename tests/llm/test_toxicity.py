import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from playcohort.llm import toxicity
from playcohort.llm.queries import op6_toxicity

BAD = ["blorp", "snarg", "vexit"]


def corpus(n, seed, kinds=("blorp", "snarg", "vexit")):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        sentences = [" ".join(f"w{x}" for x in rng.integers(0, 300, rng.integers(4, 12))) for _ in range(rng.integers(1, 12))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.integers(1, 3)):
                at = rng.integers(len(sentences))
                sentences[at] += f" {rng.choice(kinds)}{rng.choice(['', 'ed', 'ing'])}"
        rows.append((i, ". ".join(sentences) + ".", toxic))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(800, 1)
    return toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows], [1.0] * len(rows), 5000)


def test_held_out_documents(model):
    rows = corpus(400, 2)
    right = sum((model.score(t) >= 0.7) == bool(y) for _, t, y in rows)
    assert right >= 0.98 * len(rows)


def test_score_is_the_noisy_or_of_its_sentences(model):
    for _, text, _ in corpus(20, 3):
        product = math.prod(1 - p for _, _, p in model.sentence_scores(text))
        assert model.score(text) == pytest.approx(1 - product, abs=1e-12)
        spans = [text[a:b] for a, b, _ in model.sentence_scores(text)]
        assert "".join(spans) == text


def test_offending_sentences_are_located(spark, model):
    docs = spark.createDataFrame([(0, "All fine here. You blorped it! More words w1 w2."), (1, None)], "doc_id int, text string")
    found = {r.doc_id: r.offending for r in toxicity.locate(docs, model).collect()}
    assert [(s.start, s.end) for s in found[0]] == [(14, 30)] and found[1] == []


def test_labels_of_one_kind_or_none():
    assert toxicity.fit(["a", "b"], [0, 0], [1.0, 1.0], 10).score("a. b.") < 1e-6
    assert toxicity.fit([], [], [], 10).score("x") < 1e-6
    assert toxicity.fit(["a"], [1], [1.0], 10).score("x") > 1 - 1e-6


def test_training_reads_usable_labels_only(spark):
    rows = corpus(400, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, "x"), (0, None)], "doc_id long, text string")
    # Labels of every third document are wrong and must not be seen.
    labels = spark.createDataFrame(
        [(i, y if i % 3 else 1 - y) for i, _, y in rows] + [(1, None), (None, 1), (10**6, 1), (2, rows[2][2])], "doc_id long, toxic int"
    )
    fitted = toxicity.train(docs, labels, usable=F.col("doc_id") % 3 != 0)
    assert sum((fitted.score(t) >= 0.7) == bool(y) for _, t, y in rows) >= 0.97 * len(rows)


def test_odd_rows_and_filter(spark, model):
    rows = [(None, None, 1.0), (1, "", 1.0), (1, "", 1.0), (2, "blorp. " * 20_000, 1.0), (3, "w1 w2.", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _score double")
    got = {r.doc_id: r.p for r in toxicity.score(docs, model, name="p").collect()}
    assert got[None] == got[1] < 0.1 and got[2] > 0.999
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 3]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_query_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    rows = op6_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    known = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    clean = [s for s, y in known if y == 0]
    assert sum(s >= 0.7 for s in clean) <= 0.03 * len(clean)
    above = [s > c for s, y in known if y for c in clean]
    assert sum(above) / len(above) > 0.8
