"""Roll-ups kept across batches give the matrix of the whole history."""

from pyspark.sql import functions as F

from checks import mappings as m
from playcohort.operators.rollups import slot_rollup, track_rollup
from playcohort.plans.features import build_feature_matrix
from playcohort.plans.increments import add_batch, compact, merged_rollups

SF = "/root/testdata/sf0.001"


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_matrix_after_increments_is_the_one_from_scratch(spark, tmp_path):
    plays = m.plays_l(spark, SF)
    part = F.pmod(F.xxhash64("userid", "timestamp", "track_name"), F.lit(3))
    path = str(tmp_path / "rollups")
    for i in range(3):
        add_batch(path, f"b{i}", plays.where(part == i))
    kept = merged_rollups(spark, path)
    given = m.artist_genres(spark, SF), m.audio_features(spark, SF)
    options = {"with_stability": False}
    want = build_feature_matrix(plays, *given, **options)
    got = build_feature_matrix(plays, *given, rollups=kept, **options)
    assert got.columns == want.columns
    a, b = ({r.userid: r for r in frame.collect()} for frame in (got, want))
    assert a.keys() == b.keys() and len(a) > 5
    for user, row in a.items():
        for x, y in zip(row, b[user]):
            assert x == y or (isinstance(x, float) and abs(x - y) <= 1e-9 * max(1, abs(y)))


def test_repeated_batch_nulls_and_compaction(spark, plays, tmp_path):
    one = plays([("u", "2020-01-01 00:00:00", "a", "t"), ("u", "2020-01-01 00:05:00", None, None), (None, "2020-01-01", "a", "t")])
    two = plays([("u", "2020-01-01 00:10:00", "a", "t"), ("v", None, "a", "t")])
    path, target = str(tmp_path / "r"), str(tmp_path / "c")
    for name, batch in (("1", one), ("2", one), ("2", two), ("3", one.limit(0))):
        add_batch(path, name, batch)
    whole = one.unionByName(two)
    for folder in (path, target):
        if folder == target:
            compact(spark, path, target)
        slots, tracks = merged_rollups(spark, folder)
        want = slot_rollup(whole)
        assert rows(slots) == rows(want.select(slots.columns)) and slots.count() == 1
        want = track_rollup(whole)
        assert rows(tracks) == rows(want.select(tracks.columns)) and tracks.count() == 3


def test_tracks_kept_by_batch_give_the_same_matrix(spark, tmp_path):
    plays, path = m.plays_l(spark, SF), str(tmp_path / "rollups")
    half = F.pmod(F.xxhash64("track_name"), F.lit(2))
    for name, part in (("a", plays.where(half == 0)), ("b", plays.where(half == 1)), ("c", plays.where(half == 1))):
        add_batch(path, name, part)
    whole, kept = merged_rollups(spark, path), merged_rollups(spark, path, whole_tracks=False)
    plan = kept[1]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and kept[1].count() > whole[1].count()
    given = m.artist_genres(spark, SF), m.audio_features(spark, SF)
    one, two = (
        {r.userid: r for r in build_feature_matrix(plays, *given, rollups=r, with_stability=False).collect()} for r in (whole, kept)
    )
    assert one.keys() == two.keys() and len(one) > 5
    for user, row in one.items():
        for x, y in zip(row, two[user]):
            assert x == y or (isinstance(x, float) and abs(x - y) <= 1e-9 * max(1, abs(y)))
