"""Stored lookup tables and stored answers."""

import glob
import os

import pytest
from pyspark.sql import types as T

from playcohort.sources import lookup

SCHEMA = T.StructType().add("name", "string").add("value", "integer").add("tags", T.ArrayType(T.StringType()))
ANSWER = T.StructType().add("value", "integer")


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/_part=*/*.parquet")}


def test_only_touched_parts_are_written(spark, tmp_path):
    path = str(tmp_path / "store")
    assert lookup.stored(spark, path, SCHEMA).count() == 0
    rows = [(f"k{i}", i, [f"t{i}"]) for i in range(200)]
    lookup.upsert_stored(path, table(spark, rows), "name", SCHEMA, parts=16)
    before = files(path)
    assert len(before) == 16
    new = [("k3", -3, None), ("new", 7, [])]
    touched = lookup.upsert_stored(path, table(spark, new), "name", SCHEMA, parts=16)
    after = files(path)
    assert 1 <= len(touched) <= 2
    inside = {f for f in before if any(f"_part={p}/" in f for p in touched)}
    assert all(after[f] == before[f] for f in set(before) - inside) and not inside & set(after)
    want = {**{n: (v, t) for n, v, t in rows}, "k3": (-3, None), "new": (7, [])}
    assert {r.name: (r.value, r.tags) for r in lookup.stored(spark, path, SCHEMA).collect()} == want
    assert lookup.upsert_stored(path, table(spark, []), "name", SCHEMA, parts=16) == []
    assert files(path) == after


def counting(folder, bad=(), down=None):
    """A service that notes each call in a file, fails on bad keys, and altogether while down."""

    def fetch(rows):
        import os
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(r["name"] for r in rows))
        if down and os.path.exists(down):
            raise SystemExit("the task is lost")
        if any(r["name"] in bad for r in rows):
            raise RuntimeError("bad key")
        return [{"value": int(r["name"][1:])} for r in rows]

    return fetch


def calls(folder):
    return [open(f).read().split("\n") for f in glob.glob(f"{folder}/*")]


def test_one_bad_key_costs_one_answer(spark, tmp_path):
    keys = spark.createDataFrame([(f"k{i}",) for i in range(100)], "name string").coalesce(1)
    got = lookup.enrich_with(keys, counting(tmp_path, bad={"k17"}), ANSWER, halve=True).collect()
    assert {r.name: r.value for r in got} == {f"k{i}": None if i == 17 else i for i in range(100)}
    # Two batches; the bad one is halved down to the key: at most two calls a level.
    assert 2 + 10 <= len(calls(tmp_path)) <= 2 + 2 * 6


def test_answers_are_kept_and_not_asked_for_again(spark, tmp_path):
    asked, later, path, down = tmp_path / "asked", tmp_path / "later", str(tmp_path / "answers"), str(tmp_path / "down")
    asked.mkdir()
    later.mkdir()
    keys = spark.createDataFrame([(f"k{i}",) for i in range(60)] + [("k5",)], "name string")
    fetch = counting(asked, down=down)
    some = lookup.enrich_stored(keys.where("name < 'k3'"), fetch, ANSWER, path, batch_size=5, wave_batches=2).count()
    known = {n for call in calls(asked) for n in call}
    assert some == len(known) and all(len(c) <= 5 for c in calls(asked))
    # The tasks are lost in the middle: what was answered before stays.
    open(down, "w").close()
    with pytest.raises(Exception):  # noqa: B017
        lookup.enrich_stored(keys, fetch, ANSWER, path, batch_size=5, wave_batches=2)
    fetch = counting(later)
    got = lookup.enrich_stored(keys, fetch, ANSWER, path, batch_size=5, wave_batches=2).collect()
    assert sorted((r.name, r.value) for r in got) == sorted([(f"k{i}", i) for i in range(60)] + [("k5", 5)])
    again = [n for call in calls(later) for n in call]
    assert len(again) == len(set(again)) and not known & set(again) and known | set(again) == {f"k{i}" for i in range(60)}
    done = len(calls(later))
    lookup.enrich_stored(keys, fetch, ANSWER, path, batch_size=5).count()
    assert len(calls(later)) == done
