import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from playcohort.llm.queries import op10_sharding
from playcohort.llm.sharding import proportional_shards, write_shards


def check(rows, docs, n_shards):
    assert len(rows) == len(docs)
    sizes = Counter(r.shard for r in rows)
    counts = [sizes.get(k, 0) for k in range(n_shards)]
    assert max(counts) - min(counts) <= 1 and set(sizes) <= set(range(n_shards))
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    of_text = lambda t: (len((t or "").encode()), zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r.n_bytes, r.text_crc32) for r in rows) == Counter((d[0], *of_text(d[1])) for d in docs)


def test_whole_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_sharding(spark, sf).collect()
    for r in rows:
        assert (r.size, r.text_crc32) == (len(docs[r.doc_id].encode()) + 8, zlib.crc32(docs[r.doc_id].encode()))
        assert (r.law, r.grown_shard) == ("rows", None)
    by_shard = Counter(r.shard for r in rows)
    assert max(by_shard.values()) - min(by_shard.get(k, 0) for k in range(24)) <= 1


def test_every_shard_has_the_mixture(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 == 0 else f"s{i % 40}") for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = proportional_shards(docs, 24).collect()
    check(got, rows, 24)
    total = Counter(s for _, _, s in rows)
    for shard in range(24):
        part = Counter(r.source for r in got if r.shard == shard)
        assert all(abs(part.get(s, 0) - n / 24) < 2 for s, n in total.items())
    again = {(r.doc_id, r.shard, r.slot) for r in proportional_shards(docs.repartition(5), 24).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in got}
    other = {(r.doc_id, r.shard, r.slot) for r in proportional_shards(docs, 24, seed=1).collect()}
    assert other != again


def spread(rows, n_shards):
    """The same shards and slots from lists of (stratum, draw, id)."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    sizes = Counter(r[0] for r in order)
    seen, placed = Counter(), []
    for position, (stratum, draw, key) in enumerate(order):
        rank, each = seen[stratum], sizes[stratum] // n_shards
        seen[stratum] += 1
        if rank < each * n_shards:
            shard, place = rank // each, (rank % each + 0.5) / each
        else:
            shard, place = position % n_shards, (draw % 2**30 + 0.5) / 2**30
        placed.append((shard, place, draw, stratum is not None, stratum or "", key))
    slots, out = Counter(), {}
    for shard, *_, key in sorted(placed):
        out[key] = (shard, slots[shard])
        slots[shard] += 1
    return out


def within_a_row(got, total, n_shards):
    """Every shard holds the share of every stratum, rounded down or up."""
    parts = Counter((r.source, r.shard) for r in got)
    for s, n in total.items():
        for k in range(n_shards):
            assert n // n_shards <= parts.get((s, k), 0) <= -(-n // n_shards)


def test_against_lists(spark):
    rows = [(i, f"t{i}", None if i % 11 == 0 else "hot" if i % 2 else f"s{i % 97}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = proportional_shards(docs, 24, seed=3).collect()
    check(got, rows, 24)
    within_a_row(got, Counter(s for _, _, s in rows), 24)
    text = F.col("text")
    hashed = docs.select(
        "source",
        F.xxhash64(F.lit(3), "doc_id", F.crc32(text.cast("binary")), F.octet_length(text).cast("long")),
        "doc_id",
    )
    assert {r.doc_id: (r.shard, r.slot) for r in got} == spread([tuple(r) for r in hashed.collect()], 24)


@pytest.mark.parametrize(
    "source",
    [
        lambda i: f"one{i}" if i < 10_000 else "web",
        lambda i: "huge" if i < 12_000 else f"s{i % 400}",
        lambda i: f"s{int((2 * i) ** 0.5)}",
    ],
    ids=["10,000 one-row sources", "one huge and many equal", "200 sources of all sizes"],
)
def test_mixture_of_long_tails(spark, source):
    rows = [(i, "", source(i)) for i in range(20_000)]
    got = proportional_shards(spark.createDataFrame(rows, "doc_id long, text string, source string"), 24).collect()
    check(got, rows, 24)
    within_a_row(got, Counter(s for _, _, s in rows), 24)


def test_odd_rows(spark):
    rows = [(None, None, None), (None, None, None), (1, "", "a"), (1, "", "a"), (2, "é" * 50_000, None), (3, "x", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("rank", F.lit("x"))
    check(proportional_shards(docs, 4).collect(), rows, 4)
    check(proportional_shards(docs, 24).collect(), rows, 24)
    assert proportional_shards(docs.limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        proportional_shards(docs, 0)


def test_written_shards(spark, tmp_path):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("s").alias("source"))
    shards = proportional_shards(docs, 4)
    write_shards(docs, shards, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4
