"""Invariants of the randomised and iterative parts."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks import mappings as m
from checks.queries import user_vectors
from playcohort.operators import cluster, density, importance, prep, quality, temporal
from playcohort.operators.pairwise import point_arrays
from playcohort.plans import clustering, report
from playcohort.plans.enrichment import run_enrichment


@pytest.fixture(scope="module")
def points(spark, sf):
    return m.vectors(spark, sf)


def columns_of(df, n):
    a = vector_to_array("features")
    return df.select(*[a[i].alias(f"c{i}") for i in range(n)])


def test_principal_axes(spark, sf):
    vectors = user_vectors(spark, sf).cache()
    reduced, info = prep.pca_reduce(vectors, 0.95)
    shares = info.explained_variance_ratio
    assert shares == sorted(shares, reverse=True)
    assert sum(shares) > 0.95 >= sum(shares[:-1])
    scores = columns_of(reduced, info.components)
    pairs = scores.agg(F.covar_pop("c0", "c1"), F.avg("c0"), F.var_pop("c0"), F.var_pop("c1")).first()
    assert pairs[0] == pytest.approx(0.0, abs=1e-8) and pairs[1] == pytest.approx(0.0, abs=1e-8)
    assert pairs[2] >= pairs[3]
    again, _ = prep.pca_reduce(vectors, 0.95)
    key = lambda df: sorted((r["userid"], tuple(round(v, 9) for v in r["features"])) for r in df.collect())
    assert key(reduced) == key(again)


def test_stability_scores_are_uncorrelated(spark, sf):
    block = temporal.temporal_features(m.plays_e(spark, sf)).cache()
    pcs = [f"temporal_stability_pc{i}" for i in range(1, 6)]
    v = block.agg(*[F.var_pop(c).alias(c) for c in pcs], F.covar_pop(pcs[0], pcs[1]).alias("cov")).first()
    variances = [v[c] for c in pcs]
    assert variances == sorted(variances, reverse=True) and variances[0] > 0
    assert v["cov"] == pytest.approx(0.0, abs=1e-9)


def test_sweep(spark, points):
    vectors = quality.as_vectors(points)
    sweep = cluster.kmeans_sweep(vectors, (3, 5), n_init=2, id_col="vec_id")
    assert sorted(sweep.inertias) == [3, 4, 5]
    assert sweep.inertias[3] > sweep.inertias[5]
    assert sweep.best_k == max(sweep.silhouettes, key=sweep.silhouettes.get)
    assert sweep.labels.select("cluster").distinct().count() == sweep.best_k
    labelled = points.select("vec_id", "features").join(sweep.labels, "vec_id")
    alone = quality.silhouette_exact(labelled, "vec_id").first()[0]
    assert alone == pytest.approx(sweep.silhouettes[sweep.best_k], abs=1e-9)
    assert quality.inertia(labelled) == pytest.approx(sweep.inertias[sweep.best_k], rel=5e-3)
    table = quality.elbow_table(spark, sweep.inertias, sweep.silhouettes).collect()
    assert [r["k"] for r in table] == [3, 4, 5]


def test_models_advance_like_each_alone(spark, points):
    rows = points.select("vec_id", "features").collect()
    x = np.array([list(r.features) for r in rows], dtype=float)
    arrays = point_arrays(points.select("vec_id", "features"), "vec_id").repartition(5)
    far = np.full((1, x.shape[1]), 1e6)
    starts = {"three": x[:3], "five": x[10:15], "empty": np.concatenate([x[:2], far])}
    fits = {name: cluster.Model(c.copy()) for name, c in starts.items()}
    reads = cluster.advance(arrays, fits, 1e-9)
    assert reads == max(m.rounds for m in fits.values()) and all(m.settled for m in fits.values())
    for name, centres in starts.items():
        for turn in range(300):
            gap = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
            at = gap.argmin(axis=1)
            moved = np.array([x[at == c].mean(axis=0) if (at == c).any() else centres[c] for c in range(len(centres))])
            if ((moved - centres) ** 2).sum() <= 1e-9:
                break
            centres = moved
        assert fits[name].rounds == turn + 1
        assert fits[name].cost == pytest.approx(gap.min(axis=1).sum(), rel=1e-9)
        assert fits[name].centres == pytest.approx(centres, abs=1e-9)
        assert fits[name].sizes.tolist() == np.bincount(at, minlength=len(centres)).tolist()
    assert fits["empty"].sizes[2] == 0 and (fits["empty"].centres[2] == far).all()


def test_sweep_of_repeated_rows(spark):
    """Fewer different rows than centres."""
    rows = spark.range(30).selectExpr("id AS userid", "array(double(id % 2), 1D) AS features")
    sweep = cluster.kmeans_sweep(rows, (2, 4), n_init=2)
    assert sweep.best_k == 2 and sweep.inertias == {2: 0.0, 3: 0.0, 4: 0.0}
    with pytest.raises(ValueError):
        cluster.kmeans_sweep(rows.limit(0), (2, 3), n_init=1)


def test_block_size_does_not_change_results(points):
    whole = quality.silhouette_exact(points, "vec_id").first()[0]
    split = quality.silhouette_exact(points, "vec_id", block_rows=64).first()[0]
    assert split == pytest.approx(whole, abs=1e-12)
    a = density.neighbour_distances(points, 5, "vec_id").orderBy("vec_id").collect()
    b = density.neighbour_distances(points, 5, "vec_id", block_rows=64).orderBy("vec_id").collect()
    assert [r[1] for r in a] == pytest.approx([r[1] for r in b], abs=1e-9)


def test_subsamples_have_the_exact_size(points):
    chosen = quality.subsample_memberships(points.select("vec_id", "cluster"), 4, 0.8, "vec_id")
    sizes = {r["count"] for r in chosen.groupBy("replicate").count().collect()}
    assert sizes == {int(points.count() * 0.8)}


def test_importance_sums_to_one_and_finds_the_signal(spark):
    rows = spark.range(300).selectExpr(
        "cast(id AS string) AS userid", "cast(id % 3 AS double) AS signal",
        "cast(xxhash64(id) % 100 AS double) AS noise")
    labels = rows.selectExpr("userid", "cast(signal AS int) - 1 AS cluster")
    got = importance.feature_importance(rows, labels, n_trees=20).collect()
    assert got[0]["feature"] == "signal"
    assert sum(r["importance"] for r in got) == pytest.approx(1.0)


def forest_rows(spark, n):
    """Label by two of five columns; the others are noise, one of them constant."""
    return spark.range(n).selectExpr(
        "id", "cast((id % 10 >= 5) AS int) + 2 * cast((pmod(xxhash64(id, 1), 100) >= 70) AS int) AS label",
        "array(double(id % 10), double(pmod(xxhash64(id, 1), 100)), double(pmod(xxhash64(id, 2), 100)), 3D, "
        "double(pmod(xxhash64(id, 3), 50))) AS x")


def test_forest_of_whole_trees_and_of_split_ones(spark):
    rows = forest_rows(spark, 1500)
    shares = {}
    for group_rows in (32_768, 200):
        trees = importance.grow_forest(rows, 5, 12, 1, group_rows).collect()
        assert sorted(t.tree for t in trees) == list(range(12))
        for t in trees:
            assert t.left_over == pytest.approx(0.0, abs=1e-6)
            assert sum(t.decreases) == pytest.approx(t.root, rel=1e-9) and t.decreases[3] == 0.0
        table = importance.importances(spark.createDataFrame(trees), list("abcde"))
        shares[group_rows] = {r.feature: r.importance for r in table.collect()}
        assert sum(shares[group_rows].values()) == pytest.approx(1.0)
        assert min(shares[group_rows][f] for f in "ab") > 2 * max(shares[group_rows][f] for f in "ce")
    assert shares[200] == pytest.approx(shares[32_768], abs=0.1)


def test_equal_rows_with_two_labels_stay_a_leaf(spark):
    rows = spark.range(400).selectExpr("id", "cast(id % 2 AS int) AS label", "array(1D, 2D) AS x")
    for group_rows in (1000, 50):
        trees = importance.grow_forest(rows, 2, 3, 1, group_rows).collect()
        assert all(t.left_over == pytest.approx(t.root) and sum(t.decreases) == 0.0 for t in trees)
    table = importance.importances(importance.grow_forest(rows, 2, 3, 1), ["a", "b"]).collect()
    assert {r.importance for r in table} == {0.0}


def test_deep_trees_against_plain_growing():
    """A staircase: each split takes one row, far deeper than thirty levels."""
    n = 200
    x = np.arange(n, dtype=float)[:, None]
    decrease, root, left = importance.grow(x, np.arange(n) % 2, np.ones(n), np.random.default_rng(1), 1)
    assert root == pytest.approx(n / 2) and left == 0.0 and decrease[0] == pytest.approx(root)


def test_pipeline_and_selection(spark, sf):
    matrix = m.saved_matrix(spark, sf)
    km = clustering.run_clustering(matrix, "kmeans", k_range=(3, 4), n_init=1)
    dens = clustering.run_clustering(matrix, "density", eps=4.0, min_cluster_size=5, use_viz=False)
    assert km.assignments.count() == matrix.count() and "umap_x" in km.assignments.columns
    assert km.score["clusters"] in (3, 4) and -1 <= km.score["silhouette"] <= 1 and km.score["noise_points"] == 0
    mean, spread = clustering.stability(km, replicates=3).first()
    assert -1 <= mean <= 1 and spread >= 0
    table = clustering.compare([km, dens]).collect()
    best = clustering.select_best([km, dens])
    assert table[0]["silhouette"] == best.score["silhouette"]


def test_report_has_every_table(spark, sf):
    matrix, labels = m.saved_matrix(spark, sf), m.labels(spark, sf)
    plane = prep.embed_2d(user_vectors(spark, sf))
    tables = report.build_report(
        m.plays_l(spark, sf), m.artist_genres(spark, sf), matrix, labels, m.profiles(spark, sf), plane,
        n_trees=5)
    assert len(tables) == 14 and all(df.count() > 0 for df in tables.values())
    shares = tables["genre_share"].groupBy("cluster").agg(F.sum("proportion").alias("s")).collect()
    assert [r["s"] for r in shares] == pytest.approx([1.0] * len(shares))


def test_enrichment_end_to_end_and_resume(spark, sf, tmp_path):
    tsv = tmp_path / "plays.tsv"
    tsv.write_text("u\t2009-05-04T23:08:57Z\tm\tA\tn\tT\nu\t2009-05-04T23:09:57Z\tm\tB\tn\tT\n")
    people = tmp_path / "people.tsv"
    people.write_text("u\tf\t31\tJapan\tAug 13, 2006\n")
    asked = spark.sparkContext.accumulator(0)

    def artists(rows):
        asked.add(len(rows))
        return [{"spotify_artist_id": r["artist_key"], "genres": ["g"], "popularity": 1} for r in rows]

    def tracks(rows):
        return [{"resolved_id": "t", "track_spotify_id": "t", "energy": 0.5} for r in rows]

    as_of = F.lit("2010-01-01").cast("timestamp")
    out = run_enrichment(
        spark, str(tmp_path / "one"), as_of=as_of, plays_tsv=str(tsv), profiles_tsv=str(people),
        fetch_artists=artists, fetch_tracks=tracks)
    assert {k: v.count() for k, v in out.items()} == {
        "scrobbles": 2, "profiles": 1, "artist_genres": 2, "audio_features": 2, "users_to_fetch": 1}
    assert asked.value == 2
    again = run_enrichment(
        spark, str(tmp_path / "two"), as_of=as_of, plays_tsv=str(tsv), previous=str(tmp_path / "one"),
        fetch_artists=artists)
    assert again["artist_genres"].count() == 2 and asked.value == 2
    kept = [
        run_enrichment(
            spark, str(tmp_path / name), as_of=as_of, plays_tsv=str(tsv), lookups=str(tmp_path / "lookups"),
            fetch_artists=artists, fetch_tracks=tracks)
        for name in ("three", "four")
    ]
    assert asked.value == 4
    for out in kept:
        assert out["artist_genres"].count() == 2 and out["audio_features"].count() == 2
