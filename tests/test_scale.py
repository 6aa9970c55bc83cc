"""Plans and results under one very heavy key."""

import ast
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from playcohort.operators import density, diversity, engagement, quality, rollups, sessions, topk
from playcohort.session import scratch_dir
from playcohort.sources import ingest

PACKAGE = Path(__file__).resolve().parent.parent / "playcohort"


def final_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def heavy(spark):
    """One user owns half of 200,000 plays; a third of all plays have no artist."""
    return spark.range(200_000).selectExpr(
        "if(id % 2 = 0, 'hot', concat('u', id % 500)) AS userid",
        "timestamp_seconds(1600000000 + id * 97 % 90000000) AS timestamp",
        "'' AS artist_mbid",
        "if(id % 3 = 0, NULL, concat('a', id % 1009)) AS artist_name",
        "'' AS track_mbid",
        "if(id % 5 = 0, NULL, concat('t', id % 4001)) AS track_name",
    )


def test_heavy_user_features_match_a_plain_computation(heavy):
    got = {r["userid"]: r for r in engagement.engagement_features(heavy).collect()}
    rows = heavy.where("userid = 'hot'").orderBy("timestamp").toPandas()
    gaps = rows["timestamp"].diff().dt.total_seconds().dropna()
    hot = got["hot"]
    assert hot["total_scrobbles"] == len(rows)
    assert hot["session_count"] == int((gaps > 1800).sum()) + 1
    assert hot["unique_tracks"] == len(rows.dropna(subset=["artist_name", "track_name"]).groupby(
        ["artist_name", "track_name"]))
    cutoff = rows["timestamp"].max() - __import__("pandas").Timedelta(days=90)
    first = rows.groupby("artist_name", dropna=False)["timestamp"].transform("min")
    recent = rows["timestamp"] >= cutoff
    assert hot["novelty_ratio"] == pytest.approx((recent & (first >= cutoff)).sum() / recent.sum())


def test_partial_aggregation_before_every_roll_up_shuffle(heavy):
    plan = final_plan(sessions.slot_sessions(heavy))
    before = plan[plan.index("Exchange hashpartitioning(userid"):]
    assert "partial_count" in before


def test_rank_filters_run_before_the_shuffle(heavy):
    for df in (topk.top_tracks_per_user(heavy), ingest.merge_dedup([heavy, heavy])):
        plan = final_plan(df)
        assert len(re.findall(r"WindowGroupLimit.*Partial", plan)) == 1
        partial = plan.index("Partial")
        assert "Exchange" in plan[:partial]


def test_filters_and_columns_reach_the_scan(spark, heavy):
    path = scratch_dir(spark)
    heavy.write.parquet(path)
    stored = spark.read.parquet(path)
    df = ingest.lookback_filter(stored, F.lit("2022-01-01").cast("timestamp"), 1).select("userid")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThanOrEqual(time" in plan
    plan = final_plan(diversity.artist_diversity(stored))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert schema == "userid:string,artist_name:string"


#: The functions that may fetch rows: a count, a level, one row of moments, a row per column,
#: per pivot, per block of some thousand points, per centre, per counted cluster, or the seeds.
FETCHES = {
    "operators/cluster.py:advance", "operators/cluster.py:kmeans_sweep", "operators/cluster.py:mean_variance", "operators/density.py:connected_components",
    "operators/pairwise.py:reach_of_blocks", "operators/explore.py:correlation_matrix",
    "operators/hierarchy.py:condense", "operators/pairwise.py:pivot_blocks", "operators/prep.py:fit_medians",
    "operators/prep.py:fit_moments", "operators/prep.py:vector_size", "operators/quality.py:_dense_means",
    "operators/quality.py:davies_bouldin", "operators/quality.py:fit_centroids",
    "operators/quality.py:silhouette_by_labelling", "plans/clustering.py:score_table",
    "plans/clustering.py:run_clustering", "plans/clustering.py:score", "sources/lookup.py:upsert_stored",
}


def test_library_collects_only_model_sized_results():
    """``collect``/``first`` stay in the functions named above; ``toPandas`` is nowhere."""
    found = set()
    for path in PACKAGE.rglob("*.py"):
        if "llm" in path.parts:  # has its own tests
            continue
        text = path.read_text()
        assert "toPandas" not in text and ".rdd" not in text and "localCheckpoint" not in text
        assert "crossJoin" not in text
        for function in ast.walk(ast.parse(text)):
            if not isinstance(function, ast.FunctionDef):
                continue
            for call in ast.walk(function):
                name = getattr(call.func, "attr", "") if isinstance(call, ast.Call) else ""
                if name in ("collect", "first") and getattr(call.func.value, "id", "") != "F":
                    found.add(f"{path.relative_to(PACKAGE)}:{function.name}")
    assert found <= FETCHES


def test_no_row_at_a_time_functions():
    for path in PACKAGE.rglob("*.py"):
        assert not re.search(r"F\.udf|pandas_udf|mapPartitions", path.read_text())


def test_rows_without_a_lookup_key_are_spread(spark, heavy):
    """A null key must not send a third of the rows to one task of a shuffled join."""
    rollup = heavy.groupBy("userid", "artist_name", "track_name").agg(F.count(F.lit(1)).alias("plays"))
    lookup = heavy.where("artist_name IS NOT NULL").groupBy("artist_name").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = diversity.lookup_join(rollup, F.col("artist_name"), lookup, "artist_name")
        assert "hashpartitioning(_place" in final_plan(joined)
        nulls = joined.where("artist_name IS NULL").groupBy(F.spark_partition_id()).count().collect()
        assert len(nulls) > 1 and joined.count() == rollup.count()
        assert joined.where("artist_name IS NULL AND n IS NOT NULL").count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_silhouette_sums_are_added_before_they_are_taken_apart(spark):
    points = spark.range(60).selectExpr(
        "id AS vec_id", "array(double(id % 3), double(id)) AS features", "cast(id % 3 AS int) AS cluster")
    plan = final_plan(quality.silhouette_samples(points, "vec_id", block_rows=20))
    above = plan[: plan.index("FlatMapGroupsInPandas")]
    # Nothing is exploded between the kernel and the first exchange above it.
    assert "Generate" not in above[above.rindex("Exchange") :]


def test_distances_keep_their_digits_under_a_large_offset(spark):
    def points(shift):
        return spark.range(40).selectExpr(
            "id AS vec_id", f"array(id % 4 * 10 + id * 0.001 + {shift}, {shift} - id * 0.002) AS features",
            "cast(id % 4 AS int) AS cluster")

    near, far = (quality.silhouette_exact(points(s), "vec_id").first()[0] for s in ("0D", "1e6D"))
    assert near == pytest.approx(far, abs=1e-6)
    labels = [
        {r["vec_id"]: r["cluster"] for r in density.density_cluster(points(s), 0.03, 3, 2, "vec_id", rows).collect()}
        for s in ("0D", "1e6D") for rows in (7, 1000)
    ]
    assert all(found == labels[0] for found in labels) and set(labels[0].values()) == {0, 1, 2, 3}


def test_chains_across_blocks_are_one_cluster(spark):
    points = spark.range(400).selectExpr("id AS vec_id", "array(id * 1.0D, 0D) AS features")
    found = density.density_cluster(points, 1.5, 10, 1, "vec_id", 90).select("cluster").distinct().collect()
    assert [r["cluster"] for r in found] == [0]


def test_many_small_clusters(spark):
    """20,000 clusters: no table of all pairs of centres."""
    points = spark.range(40_000).selectExpr(
        "id AS vec_id", "array(double(id div 2), double(id % 2) / 10) AS features", "cast(id div 2 AS int) AS cluster")
    assert quality.davies_bouldin(points) == pytest.approx(0.1, rel=1e-6)


def test_silhouettes_of_many_clusters_are_those_of_few(spark, monkeypatch):
    """The sparse sums give the rows of the dense ones, and 3,000 clusters fit."""
    points = spark.range(700).selectExpr(
        "id AS vec_id", "cast(id % 60 - 1 AS int) AS cluster",
        "array(id % 60 * 3 + sin(id) * (id % 7), cos(id * 5) * (id % 5), id % 11) AS features")
    rows = lambda n: sorted(map(tuple, quality.silhouette_samples(points, "vec_id", n).collect()))
    dense = rows(None)
    replicates = [r[1] for r in sorted(quality.silhouette_replicates(points, 3, 0.8, "vec_id").collect())]
    monkeypatch.setattr(quality, "DENSE_SLOTS", 5)
    for n in (None, 90):
        sparse = rows(n)
        assert [r[:2] for r in sparse] == [r[:2] for r in dense]
        assert [r[2] for r in sparse] == pytest.approx([r[2] for r in dense], abs=1e-9)
    again = [r[1] for r in sorted(quality.silhouette_replicates(points, 3, 0.8, "vec_id").collect())]
    assert again == pytest.approx(replicates, abs=1e-9)
    pairs = spark.range(6_000).selectExpr(
        "id AS vec_id", "array(double(id div 2), double(id % 2) / 10) AS features", "cast(id div 2 AS int) AS cluster")
    got = quality.silhouette_samples(pairs, "vec_id", 1500)
    assert got.count() == 6_000
    # The other point is a tenth away, the two of the next pair 1 and sqrt(1.01).
    assert got.agg(F.avg("silhouette")).first()[0] == pytest.approx(1 - 0.2 / (1 + 1.01**0.5), abs=1e-9)


def test_worst_partners_in_blocks_of_any_size(spark):
    points = spark.range(3_000).selectExpr(
        "id AS vec_id", "cast(id % 300 AS int) AS cluster",
        "array(id % 300 + sin(id) * (id % 7), id % 17 + cos(id) * (id % 5), pow(id % 300, 2) / 50) AS features")
    rows = points.collect()
    x, at = np.array([r.features for r in rows]), np.array([r.cluster for r in rows])
    c = np.array([x[at == k].mean(axis=0) for k in range(300)])
    s = np.array([np.sqrt(((x[at == k] - c[k]) ** 2).sum(axis=1)).mean() for k in range(300)])
    m = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))
    np.fill_diagonal(m, np.inf)
    want = ((s[:, None] + s[None]) / m).max(axis=1).mean()
    for rows_ in (None, 100, 12):
        assert quality.davies_bouldin(points, block_rows=rows_) == pytest.approx(want, rel=1e-9)
    assert quality.davies_bouldin(points, quality.fit_centroids(points)) == pytest.approx(want, rel=1e-9)


def test_edge_plays_are_reduced_where_they_lie(spark, heavy):
    from playcohort.session import staged

    clock = staged(sessions.listening_clock(heavy, 30, 90))
    plan = final_plan(engagement.edge_plays(heavy, clock))
    join = plan.index("BroadcastHashJoin")
    # The only exchange of plays is that of the counts, above the join.
    assert "Exchange hashpartitioning" not in plan[join:]
    none = clock.withColumn("edge_slot", F.lit(None).cast("bigint"))
    assert engagement.edge_plays(heavy, none).count() == 0


def test_scratch_tables_can_be_released(spark, tmp_path, monkeypatch):
    from playcohort import session

    monkeypatch.setattr(session, "run_folder", lambda _: f"{tmp_path}/run")
    assert session.staged(spark.range(3)).count() == 3
    assert list((tmp_path / "run").iterdir())
    session.release(spark)
    assert not (tmp_path / "run").exists()


def test_covariances_of_axes_form_no_pairs_of_rows_and_count_repeated_users(spark):
    from pyspark.sql import functions as F

    from checks import queries

    users = "if(id % 11 = 0, null, concat('u', if(id % 7 = 0, id % 3, id)))"
    rows = spark.range(200).selectExpr(f"{users} AS userid", "array(sin(id), cos(id * 2), sin(id * id)) AS features")
    long = rows.select("userid", F.posexplode("features").alias("axis", "score"))
    one, two = long.alias("one"), long.alias("two")
    want = one.join(two, "userid").where("one.axis < two.axis").groupBy("one.axis", "two.axis")
    want = {(r[0], r[1]): r[2] for r in want.agg(F.covar_samp("one.score", "two.score")).collect()}
    found = queries.axis_covariances(rows)
    got = {(r.one, r.two): r.c for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_artists_and_tracks_come_from_one_shuffle_by_user(heavy):
    """No roll-up of tracks or artists is shuffled by its own keys, and a key for a lookup travels once."""
    plan = final_plan(engagement.engagement_features(heavy))
    assert "Exchange hashpartitioning(userid" in plan
    assert not re.search(r"Exchange hashpartitioning\([^)]*(artist|track)_name", plan)
    lookup = heavy.groupBy(F.concat("artist_name", F.lit("x")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    joined = diversity.lookup_join(heavy.select("userid", "artist_name"), F.col("artist_name"), lookup, "name")
    assert not re.search(r"AS _key#", final_plan(joined))


def test_stored_tracks_and_artists_of_a_split_user(spark, heavy):
    """The heavy user's rows are split by the join and put together again; rows of several batches,
    of users without a clock and without names are as in the plain roll-ups."""
    small = {"skewJoin.skewedPartitionThresholdInBytes": "1k", "skewJoin.skewedPartitionFactor": "1.1", "advisoryPartitionSizeInBytes": "8k"}
    kept = {k: spark.conf.get(f"spark.sql.adaptive.{k}") for k in small}
    for k, v in small.items():
        spark.conf.set(f"spark.sql.adaptive.{k}", v)
    try:
        plays = heavy.unionByName(heavy.limit(3).withColumns({"userid": F.lit(None).cast("string")}))
        plays = plays.unionByName(heavy.limit(2).withColumns({"userid": F.lit("v"), "timestamp": F.lit(None).cast("timestamp")}))
        clock = engagement.staged(sessions.listening_clock(plays))
        batches = [rollups.track_rollup(plays.where(F.col("timestamp") < "2021-06-01")), rollups.plain_tracks(plays.where(F.col("timestamp") >= "2021-06-01"))]
        joined = rollups.tracks_by_user(batches[0].unionByName(batches[1]), clock)
        joined.collect()
        assert "skew=true" in final_plan(joined)
        stored = engagement.staged(rollups.with_artists(joined))
        known = rollups.track_rollup(plays.where("userid <> 'v'"))
        tracks = stored.select(known.columns)
        assert tracks.exceptAll(known).count() == 0 and tracks.count() == known.count()
        artists, want = rollups.dated_artists(stored), rollups.artists_from_tracks(known)
        assert artists.select(want.columns).exceptAll(want).count() == 0 and artists.count() == want.count()
        assert artists.join(clock, "userid").where("NOT now_us <=> last_us").count() == 0
    finally:
        for k, v in kept.items():
            spark.conf.set(f"spark.sql.adaptive.{k}", v)
