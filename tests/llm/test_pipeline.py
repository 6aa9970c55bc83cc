import corpus_pipeline
from pyspark.sql import functions as F

from playcohort.llm import decontaminate, jaccard_join, queries
from playcohort.llm.secret_scan import base_spans
from playcohort.session import staged

import __spark_entry__ as entry


def test_stages_one_by_one(spark, sf):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "packing"]
    first = docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        given, docs = docs, staged(stage(spark, docs, sf))
        before[name] = (given, docs)
        if name != "packing":
            assert docs.columns == first.columns
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            assert ids <= {r.doc_id for r in given.select("doc_id").collect()} and len(ids) == docs.count()

    scores = {r.doc_id: r.predicted for r in queries.op6_toxicity(spark, sf).collect()}
    assert {r.doc_id for r in before["toxicity"][1].collect()} == {i for i, p in scores.items() if not p}

    given, kept = before["n-gram Jaccard join"]
    classes = {r.class_id for r in jaccard_join.classes_of(given).collect()}
    assert {r.doc_id for r in kept.collect()} == classes

    given, kept = before["benchmark decontamination"]
    marked = decontaminate.mark(given, spark.read.parquet(f"{sf}/benchmark.parquet"))
    bad = marked.where(decontaminate.contaminated(marked["hits"], marked["n_words"])).select("doc_id").collect()
    assert given.count() - kept.count() == len(bad)

    given, kept = before["secret scans"]
    old, new = ({r.doc_id: r for r in df.collect()} for df in (given, kept))
    assert set(old) == set(new)
    for i, r in new.items():
        assert not base_spans(r.text) and r.n_chars == len(r.text)
        if "[SECRET]" not in r.text:
            assert r == old[i]

    assert {r.doc_id for r in before["packing"][1].collect()} == set(new)


def test_registered(spark, sf):
    registered = entry.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in registered if k.startswith("op")}
    assert registered["pipeline"] is corpus_pipeline.run
    out = registered["pipeline"](spark, sf)
    assert out.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] and out.count() > 0


def chained(spark, docs, sf):
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, out, sf))
        if name != "packing":
            assert out.columns == docs.columns
    return out


def test_odd_documents_go_through_all_stages(spark, sf):
    """Nulls in every column, empty and long texts, repeated rows, and columns with clashing names."""
    given = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    odd = spark.createDataFrame(
        [
            (None, None, None, None, None), (None, None, None, None, None), (-1, "", "en", "s", 0), (-2, " \n\t", "en", "s", 3),
            (-3, "word " * 60_000, "en", "s", 300_000), (-4, "same text here", "en", "s", 14), (-4, "same text here", "en", "s", 14),
            (-5, "é🙂 ß", None, "s", 4), (None, "only a text without a name of its own", "en", None, None),
        ],
        given.schema,
    )
    clashing = given.unionByName(odd)
    for name in ("row", "key", "text_crc32", "start", "score", "hits", "root", "_row", "spans"):
        clashing = clashing.withColumn(name, F.lit("clash"))
    rows = chained(spark, clashing, sf).collect()
    ids = {r.doc_id for r in rows}
    # Of repeated texts one document stays; a text without words is a document of one id.
    assert {-3, -4, -5} <= ids and ids <= {r.doc_id for r in clashing.select("doc_id").collect()}
    spans = {}
    for r in rows:
        spans.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    whole = [sorted(s) for (_, n), s in spans.items() if sum(length for _, length in s) == n]
    assert all(a + n == b for s in whole for (a, n), (b, _) in zip(s, s[1:]))
    assert sum(r.length for r in rows if r.doc_id == -3) == next(r.doc_tokens for r in rows if r.doc_id == -3)


def test_empty_documents(spark, sf):
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    assert chained(spark, empty, sf).count() == 0
