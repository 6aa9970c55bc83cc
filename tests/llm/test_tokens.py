import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from playcohort.llm import tokens
from playcohort.llm.queries import op7_token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_whole_table_against_the_library(spark, sf, processor):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_token_counts(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(processor.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


@pytest.mark.parametrize("chunk, overlap", [(8, 2), (20, 1), (50, 8), (200, 30)])
def test_spliced_counts(spark, sf, processor, chunk, overlap):
    pairs = tokens.adjacent_pairs(processor)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(25).collect()]
    texts += ["a" * 500, " " * 300, "ab " * 200, "日本語のテキスト" * 40, "🙂" * 60, "<s> x </s>" * 30, "\n\n\t  x" * 50, "▁" * 90]
    texts += ["é" * 80, "x", "", "0123456789" * 40, "ﬁ№ " * 40]
    for text in texts:
        text = text[:1500]
        assert tokens.spliced_count(processor, text, pairs, chunk, overlap) == len(processor.encode(text)), text[:40]


def test_overlaps_widen_where_nothing_is_proven(processor):
    pairs = tokens.adjacent_pairs(processor)
    text = "er" * 400
    assert all(text[i : i + 2] in pairs for i in range(len(text) - 1))
    assert tokens.spliced_count(processor, text, pairs, 30, 4) == len(processor.encode(text))


def test_odd_rows(spark, processor):
    rows = [(None, None), (1, ""), (1, ""), (2, "word " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_bytes", F.lit("x"))
    got = sorted(tokens.token_counts(docs, MODEL, chunk=1000).collect(), key=str)
    n = len(processor.encode("word " * 20_000))
    assert sorted(map(tuple, got), key=str) == sorted([(None, 0, 0), (1, 0, 0), (1, 0, 0), (2, 100_000, n)], key=str)
    assert tokens.token_counts(docs.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError):
        tokens.token_counts(docs, MODEL, chunk=5, overlap=5)
