"""Hand-computed cases."""

import math

import pytest
from pyspark.sql import functions as F

from playcohort.functions.columns import artist_key, track_key
from playcohort.functions.quantiles import exact_quantiles
from playcohort.operators import audio, diversity, engagement, explore, prep, profiles, quality
from playcohort.operators import sessions, temporal, topk
from playcohort.operators.density import connected_components, density_cluster
from playcohort.plans.clustering import run_clustering
from playcohort.schemas import ARTIST_GENRES, AUDIO_FEATURES
from playcohort.sources import ingest, lookup, parquet, tsv


def by_user(df):
    return {r["userid"]: r for r in df.collect()}


def test_gap_of_exactly_the_limit_continues_the_session(plays):
    p = plays(
        [
            ("u", "2024-01-01 00:00:00", "a", "t"),
            ("u", "2024-01-01 00:30:00", "a", None),
            ("u", "2024-01-01 01:00:00.000001", "a", "t"),
        ]
    )
    rows = sorted(sessions.session_table(p, 30).collect(), key=lambda r: r["session_id"])
    assert [(r["session_id"], r["track_count"], r["duration_min"]) for r in rows] == [
        (1, 1, 30.0),
        (2, 1, 0.0),
    ]
    ids = [r["session_id"] for r in sessions.sessionize(p, 30).orderBy("timestamp").collect()]
    assert ids == [1, 1, 2]


@pytest.mark.parametrize("gap", [7, 30, 45, 360, 0.5])
def test_sessions_agree_with_a_plain_scan(spark, plays, gap):
    import datetime
    import random

    rng = random.Random(7)
    rows, want = [], {}
    for user in "abc":
        t = datetime.datetime(1969, 12, 30, 22, 0)
        stamps = []
        for _ in range(120):
            t += datetime.timedelta(seconds=rng.choice([0, 20, 30, 400, 1800, 2700, 21600, 30000]))
            stamps.append(t)
        rows += [(user, str(s), "x", "y") for s in stamps]
        breaks = sum((b - a).total_seconds() > gap * 60 for a, b in zip(stamps, stamps[1:]))
        want[user] = breaks + 1
    clock = sessions.listening_clock(plays(rows), gap)
    assert {r["userid"]: r["sessions"] for r in clock.collect()} == want


def test_one_event_user_has_defined_features(plays):
    p = plays([("u", "2024-03-02 07:15:00", "a", "t")])
    e = engagement.engagement_features(p).first()
    assert (e["total_scrobbles"], e["unique_tracks"], e["track_replay_rate"]) == (1, 1, 1.0)
    assert (e["session_count"], e["avg_session_length_min"]) == (1, 0.0)
    assert (e["novelty_ratio"], e["top_artist_play_share"]) == (1.0, 1.0)
    assert e["discovery_velocity_30d"] == pytest.approx(1 / 30)
    t = temporal.temporal_features(p, with_stability=False).first()
    assert t["temporal_hour_entropy"] == 0.0
    assert (t["morning_ratio"], t["evening_ratio"], t["weekend_ratio"]) == (1.0, 0.0, 1.0)
    assert (t["listening_days"], t["avg_daily_plays"]) == (1, 1.0)


def test_novelty_cutoff_is_inclusive_and_exact_inside_a_slot(plays):
    p = plays(
        [
            ("u", "2024-01-01 10:05:00", "old", "t"),
            ("u", "2024-01-01 10:10:00", "new", "t"),
            ("u", "2024-03-31 10:10:00", "new", "t"),
        ]
    )
    # The last play is 90 days after 10:10, so 10:05 is outside and 10:10 inside.
    e = engagement.engagement_features(p).first()
    assert e["novelty_ratio"] == 1.0
    assert e["discovery_velocity_90d"] == pytest.approx(1 / 90)


def test_missing_names(plays):
    p = plays(
        [
            ("u", "2024-01-01 00:00:00", None, "t"),
            ("u", "2024-01-01 00:01:00", "a", None),
            ("u", "2024-01-01 00:02:00", "a", "t"),
            ("v", "2024-01-01 00:02:00", None, None),
        ]
    )
    e = by_user(engagement.engagement_features(p))
    assert (e["u"]["total_scrobbles"], e["u"]["unique_tracks"]) == (3, 1)
    assert e["u"]["track_replay_rate"] == 3.0
    assert (e["v"]["unique_tracks"], e["v"]["track_replay_rate"]) == (0, 0.0)
    d = by_user(diversity.artist_diversity(p))
    assert set(d) == {"u"} and d["u"]["artist_entropy"] == 0.0


def test_top_n_share_with_ties(plays):
    rows = []
    for i, n in enumerate([3, 2, 2, 2, 1]):
        rows += [("u", f"2024-01-01 0{i}:00:{k:02d}", f"a{i}", "t") for k in range(n)]
    d = diversity.artist_diversity(plays(rows), top_n=3).first()
    assert d["artist_concentration_3"] == pytest.approx(7 / 10)
    want = -sum(c / 10 * math.log2(c / 10) for c in [3, 2, 2, 2, 1])
    assert d["artist_entropy"] == pytest.approx(want)


def test_genres_empty_blank_null_and_duplicate_lookup_rows(spark, plays):
    p = plays(
        [("u", "2024-01-01", "A ", "t"), ("u", "2024-01-02", "b", "t"), ("v", "2024-01-02", "c", "t"),
         ("w", "2024-01-02", "d", "t")]
    )
    g = spark.createDataFrame(
        [("a", "1", ["x", ""], 1), ("b", "2", ["x", "y"], 1), ("b", "2", ["y"], 1), ("c", "3", [], 1)],
        ARTIST_GENRES,
    )
    d = by_user(diversity.genre_diversity(p, g))
    # Rows after the join for u: one for A, two for b; tags 2 + 2 + 1.
    assert d["u"]["avg_genre_tags_per_play"] == pytest.approx(5 / 3)
    assert d["u"]["unique_genres"] == 2 and d["u"]["genre_entropy"] == pytest.approx(1.0)
    assert tuple(d["v"])[1:] == (0, 0.0, 0.0, 0.0) and tuple(d["w"])[1:] == (0, 0.0, 0.0, 0.0)


def test_audio_needs_all_values_and_keeps_unmatched_users(spark, plays):
    p = plays([("u", "2024-01-01", "a", "t"), ("u", "2024-01-02", "a", "t"), ("u", "2024-01-02", "a", "s"),
               ("v", "2024-01-02", "a", None), ("v", "2024-01-02", "a", "gap")])
    row = lambda k, v: (k, "id", v, v, v, v, v, v, v, v, 0.0, 1, 4)
    gap = ("a|||gap", "id", None, *[1.0] * 7, 0.0, 1, 4)
    f = spark.createDataFrame([row("a|||t", 1.0), row("a|||s", 4.0), gap], AUDIO_FEATURES)
    d = by_user(audio.audio_profile(p, f))
    assert d["u"]["mean_energy"] == 2.0 and d["v"]["mean_energy"] is None


def test_keys_strip_all_whitespace(spark):
    df = spark.createDataFrame([("\t Ab C　\n", " T"), (None, "T")], "a string, t string")
    got = df.select(artist_key(F.col("a")), track_key(F.col("a"), F.col("t"))).collect()
    assert tuple(got[0]) == ("ab c", "ab c|||t") and tuple(got[1]) == (None, None)


def test_tsv_lines(spark, tmp_path):
    lines = [
        " u \t2009-05-04T23:08:57Z\tm\t A \tn\tT",
        "u\t2009-05-04T23:08:57Z\tm\tA",
        "u\t2009-05-04T23:08:57Z\tm\tA\tn\tT\textra",
        "u\tyesterday\tm\tA\tn\tT",
        "u\t2009-05-04T23:08:57Z\tm\t\tn\tT",
        "u\t2009-05-04T23:08:57Z\tm\t  \tn\tNone",
        "u\t2009-05-04T23:08:57Z\tm\tA \"B\tn\tT",
        "",
    ]
    path = tmp_path / "plays.tsv"
    path.write_text("\n".join(lines))
    rows = tsv.read_plays_tsv(spark, str(path)).collect()
    got = sorted((r["userid"], r["artist_name"], r["track_name"] or "-") for r in rows)
    assert got == [("u", "", "-"), ("u", "A", "-"), ("u", "A", "T"), ("u", 'A "B', "T")]
    header = tmp_path / "profiles.tsv"
    header.write_text("userid\tgender\tage\tcountry\tsignup\nu\tf\tx\tNA\tAug 13, 2006\nv\t\t31\tJapan\n")
    people = {r["userid"]: r for r in tsv.read_profiles_tsv(spark, str(header), skip_header=True).collect()}
    assert people["u"]["age"] is None and people["u"]["country"] is None
    assert str(people["u"]["signup"]) == "2006-08-13 00:00:00"
    assert people["v"]["gender"] is None and people["v"]["age"] == 31.0 and people["v"]["signup"] is None


def test_missing_parquet_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        parquet.read_parquet(spark, str(tmp_path / "nothing"))


def test_merge_keeps_the_first_source_and_treats_nulls_as_equal(plays):
    log = plays([("u", "2024-01-01", "a", None), ("u", "2024-01-01", "a", None)])
    recent = plays([("u", "2024-01-01", "a", None), ("u", "2024-01-02", "a", "t")])
    out = ingest.merge_dedup([log.withColumn("artist_mbid", F.lit("id")), recent]).collect()
    assert sorted((str(r["timestamp"])[:10], r["artist_mbid"]) for r in out) == [
        ("2024-01-01", "id"), ("2024-01-02", "")]


def test_failed_batches_and_missing_answers_become_nulls(spark):
    keys = spark.createDataFrame([(f"k{i:03d}",) for i in range(120)], "artist_key string").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def fetch(rows):
        calls.add(1)
        assert len(rows) <= 50
        if any(r["artist_key"] == "k060" for r in rows):
            raise RuntimeError("down")
        return [None if r["artist_key"] == "k001" else {"spotify_artist_id": r["artist_key"], "genres": ["g"]}
                for r in rows]

    from playcohort.plans.enrichment import ARTIST_ANSWER

    rows = lookup.artist_answers(lookup.enrich_with(keys, fetch, ARTIST_ANSWER)).collect()
    found = [r for r in rows if r["spotify_artist_id"]]
    assert len(rows) == 120 and len(found) == 120 - 50 - 1 and calls.value == 3
    assert all(r["genres"] == [] for r in rows if not r["spotify_artist_id"])


def test_track_answers_keep_resolved_keys_only(spark):
    rows = [("a|||t", "id1", "id1", 0.5), ("a|||u", "id2", None, None), ("a|||v", None, None, None)]
    df = spark.createDataFrame(rows, "track_key string, resolved_id string, track_spotify_id string, energy double")
    got = {r["track_key"]: r["track_spotify_id"] for r in lookup.track_answers(df).collect()}
    assert got == {"a|||t": "id1", "a|||u": None}


def test_sample_is_capped_and_repeatable(plays):
    p = plays([(f"u{i}", "2024-01-01", "a", "t") for i in range(5)])
    assert parquet.sample_users(p, 50).count() == 5
    one, two = parquet.sample_users(p, 2).collect(), parquet.sample_users(p, 2).collect()
    assert len(one) == 2 and sorted(map(str, one)) == sorted(map(str, two))
    with pytest.raises(ValueError):
        parquet.user_universe(None)


def test_unknown_period_and_algorithm(plays, spark):
    with pytest.raises(ValueError):
        topk.top_artists_by_period(plays([]), F.current_timestamp(), "decade")
    with pytest.raises(ValueError):
        run_clustering(spark.range(1).selectExpr("'u' userid", "1.0 x"), "spectral")


def test_impute_drops_empty_columns_and_scale_zeroes_constants(spark):
    m = spark.createDataFrame(
        [("a", 1.0, None, 5.0, 1), ("b", None, None, 5.0, 2), ("c", 2.0, None, 5.0, 3), ("d", 4.0, None, 5.0, 10)],
        "userid string, x double, empty double, flat double, n int",
    ).withColumn("age", F.lit(3.0))
    scaled, names = prep.preprocess(m)
    assert names == ["x", "flat", "n"]
    imputed, _ = prep.median_impute(m)
    got = {r["userid"]: r for r in imputed.collect()}
    assert got["b"]["x"] == 2.0 and all(r["flat"] == 0.0 for r in scaled.collect())
    sd = scaled.agg(F.stddev_pop("n"), F.avg("n")).first()
    assert sd[0] == pytest.approx(1.0) and sd[1] == pytest.approx(0.0)


def test_quantiles_match_percentile_on_large_groups(spark):
    rows = spark.range(200_000).selectExpr(
        "if(id % 3 = 0, 'a', 'b') AS k",
        "CASE WHEN id % 2 = 0 THEN 0D ELSE cast(xxhash64(id) % 1000003 AS double) / 7 END AS v",
    )
    probs = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "q9": 0.99, "lo": 0.0, "hi": 1.0}
    got = {r["k"]: r for r in exact_quantiles(rows, ["k"], "v", probs).collect()}
    want = rows.groupBy("k").agg(F.percentile("v", list(probs.values())).alias("p")).collect()
    for r in want:
        assert [got[r["k"]][n] for n in probs] == pytest.approx(r["p"], rel=1e-12)


def test_correlation_of_constant_and_partly_missing_columns(spark):
    m = spark.createDataFrame(
        [(1.0, 2.0, 7.0), (2.0, None, 7.0), (3.0, 6.0, 7.0), (4.0, 9.0, 7.0)], "a double, b double, c double")
    r = {(x["feat_a"], x["feat_b"]): x["correlation"] for x in explore.correlation_matrix(m).collect()}
    assert r["a", "a"] == 1.0 and r["a", "c"] is None and r["c", "c"] is None
    xs, ys = [1, 3, 4], [2, 6, 9]
    mx, my = sum(xs) / 3, sum(ys) / 3
    cov = sum((x - mx) * (y - my) for x, y in zip(xs, ys))
    want = cov / math.sqrt(sum((x - mx) ** 2 for x in xs) * sum((y - my) ** 2 for y in ys))
    assert r["a", "b"] == pytest.approx(want)
    pairs = explore.high_correlation_pairs(explore.correlation_matrix(m)).collect()
    assert [(p["feat_a"], p["feat_b"]) for p in pairs] == [("b", "a")]


def test_histogram_of_a_constant(spark):
    rows = explore.feature_histogram(spark.range(4).selectExpr("2.0D AS x"), ["x"], 10).collect()
    assert len(rows) == 10 and {r["bin"]: r["n"] for r in rows}[5] == 4


def test_single_member_cluster_and_single_cluster(spark):
    pts = spark.createDataFrame(
        [("a", [0.0, 0.0], 0), ("b", [0.0, 1.0], 0), ("c", [5.0, 0.0], 1), ("n", [9.0, 9.0], -1)],
        "userid string, features array<double>, cluster int")
    got = {r["userid"]: r["silhouette"] for r in quality.silhouette_samples(pts).collect()}
    assert set(got) == {"a", "b", "c"} and got["c"] == 0.0
    assert got["a"] == pytest.approx((5 - 1) / 5)
    one = pts.where("cluster = 0")
    assert quality.davies_bouldin(one) == 0.0 and quality.calinski_harabasz(one) == 0.0
    assert quality.silhouette_exact(one).first()[0] == 0.0


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 200).selectExpr("id AS u", "id - 1 AS v").union(
        spark.createDataFrame([(500, 501), (777, 777)], "u long, v long"))
    comp = {r["id"]: r["component"] for r in connected_components(links).collect()}
    assert {comp[i] for i in range(200)} == {0}
    assert (comp[501], comp[777]) == (500, 777)


def test_names_and_advice(spark):
    m = spark.createDataFrame(
        [("a", 1.0, 0.9, 0.1, 0.6), ("b", 1.0, 0.1, 0.9, 0.1), ("n", 1.0, 0.5, 0.5, 0.2)],
        "userid string, artist_entropy double, novelty_ratio double, track_replay_rate double, weekend_ratio double")
    labels = spark.createDataFrame([("a", 0), ("b", 1), ("n", -1)], "userid string, cluster int")
    names = {r["cluster"]: r["cluster_name"] for r in profiles.cluster_names(m, labels).collect()}
    assert names == {0: "Low-Replay / Explorer / Weekend", 1: "High-Replay / Loyalist / Weekday", -1: "Noise"}
    report = profiles.segment_report(m, labels)
    advice = {}
    for r in profiles.segment_recommendations(report).orderBy("cluster", "position").collect():
        advice.setdefault(r["cluster"], []).append(r["recommendation"])
    assert advice[0] == [profiles.ADVICE_NEW_ARTISTS, profiles.ADVICE_DEEP_GENRE, profiles.ADVICE_WEEKEND]
    assert advice[1] == [profiles.ADVICE_FAVOURITES, profiles.ADVICE_OFFLINE, profiles.ADVICE_DEEP_GENRE]


def test_activity_grid_is_dense(spark, plays):
    p = plays([("u", "2024-01-01 05:00:00", "a", "t")])
    labels = spark.createDataFrame([("u", 2), ("z", 3)], "userid string, cluster int")
    rows = profiles.activity_heatmap(p, labels).collect()
    assert len(rows) == 2 * 168
    assert [(r["cluster"], r["dow"], r["hour"]) for r in rows if r["plays"]] == [(2, 0, 5)]


def test_fewer_users_than_components_give_zero_scores(plays):
    row = temporal.temporal_features(plays([("u", "2024-01-01 05:00:00", "a", "t")])).first()
    assert [row[f"temporal_stability_pc{i}"] for i in range(1, 6)] == [0.0] * 5


def test_density_labels_on_blocks_smaller_than_the_table(spark):
    rows = [(i, [float(i // 20) * 10 + (i % 20) * 0.01, 0.0]) for i in range(60)] + [(99, [500.0, 0.0])]
    pts = spark.createDataFrame(rows, "userid long, features array<double>")
    whole = {r[0]: r[1] for r in density_cluster(pts, 0.1, 5, 3).collect()}
    split = {r[0]: r[1] for r in density_cluster(pts, 0.1, 5, 3, block_rows=7).collect()}
    assert whole == split and whole[99] == -1
    assert [whole[i] for i in (0, 20, 40)] == [0, 1, 2]


def test_blocks_of_the_outer_join_read_joined_plays_once_stored(spark, sf):
    from checks.queries import QUERIES

    plan = QUERIES["feature_block_outer_join"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "l_partkey" in plan and "l_orderkey" not in plan
