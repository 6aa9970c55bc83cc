import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from playcohort.llm import simhash
from playcohort.llm.queries import op12_simhash_dedup


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, reach=3):
    """(id, fingerprint) rows to the smallest id that each reaches, all pairs compared."""
    fps = np.array([fp for _, fp in rows], dtype=np.uint64)
    label = list(range(len(rows)))
    stack_seen = set()
    for start in range(len(rows)):
        if start in stack_seen:
            continue
        group, stack = [], [start]
        stack_seen.add(start)
        while stack:
            at = stack.pop()
            group.append(at)
            for k in np.flatnonzero(np.bitwise_count(fps ^ fps[at]) <= reach).tolist():
                if k not in stack_seen:
                    stack_seen.add(k)
                    stack.append(k)
        least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
        for k in group:
            label[k] = least
    return label


def test_whole_table_against_brute_force(spark, sf):
    docs = [(r.doc_id, brute_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(d, f"{fp:016x}", c) for (d, fp), c in zip(docs, brute_components(docs))}
    got = op12_simhash_dedup(spark, sf)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(docs) and set(rows) == want


def drawn(seed, n, near):
    """Random fingerprints, chains of them at 1 to 4 bits, and a crowd around one of them."""
    rng = random.Random(seed)
    found = {0, 2**64 - 1, 1, 7, 15}
    while len(found) < n:
        fp = rng.getrandbits(64)
        found.add(fp)
        for _ in range(near):
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                fp ^= 1 << bit
            found.add(fp)
    crowd = rng.getrandbits(64)
    for _ in range(n // 2):
        fp = crowd
        for bit in rng.sample(range(64), rng.randint(0, 5)):
            fp ^= 1 << bit
        found.add(fp)
    return sorted(found)


def components_of(fps, links):
    parent = {fp: fp for fp in fps}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in links:
        parent[root(u)] = root(v)
    groups = {}
    for fp in fps:
        groups.setdefault(root(fp), []).append(fp)
    return sorted(sorted(g) for g in groups.values())


def test_links_in_cells_of_any_size(spark):
    fps = drawn(1, 3_000, 3)
    signed = [(fp - 2**64 if fp >= 2**63 else fp,) for fp in fps]
    df = spark.createDataFrame(signed, "fp long")
    label = brute_components(list(enumerate(fps)))
    want = {}
    for fp, c in zip(fps, label):
        want.setdefault(c, []).append(fp)
    want = sorted(sorted(g) for g in want.values())
    for block_rows in (8192, 40):
        rows = simhash.linked(df, 3, block_rows).collect()
        links = {(r.u % 2**64, r.v % 2**64) for r in rows}
        assert all((u ^ v).bit_count() <= 3 for u, v in links)
        assert components_of(fps, links) == want
    # A crowd is connected by few links, not by its pairs.
    crowd = max(want, key=len)
    assert len(crowd) > 1_000
    assert simhash.linked(df, 3).count() < 40 * len(fps)


def test_no_cell_is_missed():
    """Any two fingerprints at 3 bits meet in a cell, and in one only by half."""
    rng = random.Random(2)
    low = 0x55555555

    def cells(fp):
        out = []
        for i in (0, 1):
            half = fp >> 32 * i & (2**32 - 1)
            own = (half & low) + (half >> 1 & low)
            visits = set()
            for move in simhash.steps(1):
                counts = [own >> 2 * s & 3 for s in range(16)]
                for s, change in move:
                    counts[s] += change
                if all(0 <= c <= 2 for c in counts):
                    visits.add(sum(c << 2 * s for s, c in enumerate(counts)))
            out.append((own, visits))
        return out

    for _ in range(2_000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 3):
            b ^= 1 << bit
        assert any(own_a in visits_b or own_b in visits_a for (own_a, visits_a), (own_b, visits_b) in zip(cells(a), cells(b)))


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    texts = [None, "", " \t\n", "one", "One", "one two", "one two three", "one two three four", "É é ß 🙂", long, long.upper(), "a b c"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "alone here"), (None, "one"), (3, "one"), (3, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("cell", F.lit(1))
    got = simhash.components(docs).collect()
    known = [(i, brute_fingerprint(t)) for i, t in rows]
    want = [(i, fp - 2**64 if fp >= 2**63 else fp, c) for (i, fp), c in zip(known, brute_components(known))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert simhash.components(docs.limit(0)).count() == 0
