import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playcohort.llm import packing
from playcohort.llm.queries import END_ID, RANKS, WINDOW, op9_packing

JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def reference(tokenizer, text, end):
    return np.asarray(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


def check(pieces, ids_of, window):
    """Every id of every document lies in one piece; sequences have no gap and no overflow."""
    for doc, group in pieces.groupby("doc_id"):
        ids, group = ids_of[doc], group.sort_values("start")
        assert list(group.start) == list(np.cumsum([0, *group.length[:-1]]))
        assert group.length.sum() == len(ids) and (group.doc_tokens == len(ids)).all()
        for start, length, crc in zip(group.start, group.length, group.ids_crc32):
            assert zlib.crc32(ids[start : start + length].tobytes()) == crc
    pieces = pieces.sort_values(["sequence_id", "offset"])
    before = pieces.groupby("sequence_id").length.cumsum() - pieces.length
    assert (pieces.offset == before).all()
    assert pieces.groupby("sequence_id").length.sum().max() <= window


def test_whole_table_against_the_tokenizer(spark, sf, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    pieces = op9_packing(spark, sf).toPandas()
    ids_of = {row.doc_id: reference(tokenizer, row.text, END_ID) for row in docs}
    assert set(pieces.doc_id) == set(ids_of)
    check(pieces, ids_of, WINDOW)


def test_ranks_give_the_ids_of_the_tokenizer(tokenizer):
    rng = random.Random(3)
    latin = [chr(c) for c in [*range(0x250), *range(0x1E00, 0x1F00), *range(0x2010, 0x2028), 0x20AC]]
    odd = list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0'sd1²½.,-—")
    texts = ["".join(rng.choices(rng.choice([latin, odd, odd + latin[97:123]]), k=rng.randint(0, 60))) for _ in range(4000)]
    texts += ["<|endoftext|> a", "日本語 text", "🙂 ok", "a<|endoftext|>", "𝔘 x", "", "x" * 3000]
    encode = packing.id_encoder(JSON, RANKS, public_tokenizers.PATTERN)
    for text, got in zip(texts, encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_odd_rows(spark, tokenizer):
    rows = [(None, "a b"), (1, None), (1, None), (2, ""), (3, "word " * 3000), (3, "word " * 3000), (2**53 + 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit(9)).withColumn("start", F.lit(9))
    cut = packing.pieces(docs, JSON, 64, END_ID)
    packed = packing.pack(cut, 64).collect()
    total = sum(len(reference(tokenizer, text, END_ID)) for _, text in rows)
    assert sum(row.length for row in packed) == total
    assert sum(row.id == 2**53 + 1 for row in packed) == 1
    assert sum(row.id is None for row in packed) == 1
    places = {(row.sequence_id, row.offset) for row in packed}
    assert len(places) == len(packed)
    empty = packing.pack(packing.pieces(docs.limit(0), JSON, 64, END_ID), 64)
    assert empty.count() == 0 and "sequence_id" in empty.columns


def test_sequences_round_trip(spark, tokenizer):
    rows = [(i, "word " * (i * 7 % 90)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack(packing.pieces(docs, JSON, 32, END_ID, with_ids=True), 32)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed, 32, 0).collect()}
    assert all(len(ids) == 32 for ids in whole.values())
    parts = {}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
        parts.setdefault(r.id, []).append((r.start, r.ids))
    for i, text in rows:
        assert sum((ids for _, ids in sorted(parts[i])), []) == reference(tokenizer, text, END_ID).tolist()


def test_sum_of_squares_is_the_best_choice():
    rng = np.random.default_rng(1)
    window = 12
    sizes = rng.integers(1, window + 1, 400)
    where, offset, fills = packing.sum_of_squares(sizes, window)
    state = {}
    for size, number, level in zip(sizes, where, offset):
        counts = np.bincount([f for f in state.values() if f < window], minlength=window + 1)

        def after(old):
            new = counts.copy()
            if old:
                new[old] -= 1
            if old + size < window:
                new[old + size] += 1
            return int((new[1:window] ** 2).sum())

        options = [h for h in range(window - size + 1) if h == 0 or counts[h]]
        assert after(level) == min(map(after, options))
        assert state.get(number, 0) == level
        state[number] = level + size
    assert [state[i] for i in range(len(fills))] == list(fills)


def test_little_padding():
    sizes = np.random.default_rng(0).gamma(1.5, 400, 60_000).astype(int) % 2047 + 1
    _, _, fills = packing.sum_of_squares(sizes, 2048)
    assert 1 - fills.sum() / (2048 * len(fills)) < 0.01
