"""DuckDB statements the queries are compared with.

Each statement is written from the definitions, on the plays themselves, without the
roll-ups the library uses. Shared parts are named and pulled in where they are mentioned.
"""

from __future__ import annotations

import re

# Fixed values, written out again so that a wrong entry in the library shows.
NAME_TAGS = [
    ("artist_entropy", "Diverse", "Focused"),
    ("genre_entropy", "Genre-Diverse", "Genre-Focused"),
    ("track_replay_rate", "High-Replay", "Low-Replay"),
    ("novelty_ratio", "Explorer", "Loyalist"),
    ("discovery_velocity_30d", "Fast-Discovery", "Slow-Discovery"),
    ("temporal_hour_entropy", "All-Hours", "Routine-Hours"),
    ("weekend_ratio", "Weekend", "Weekday"),
    ("avg_tracks_per_session", "Long-Sessions", "Short-Sessions"),
]
REPORT_FEATURES = [
    "artist_entropy", "genre_entropy", "unique_artists", "track_replay_rate", "novelty_ratio",
    "discovery_velocity_30d", "avg_tracks_per_session", "weekend_ratio", "temporal_hour_entropy",
]
ADVICE_NEW_ARTISTS = "→ Prioritise new artist recommendations and discovery playlists"
ADVICE_FAVOURITES = "→ Emphasise \"More like your favourites\" and artist radio"
ADVICE_OFFLINE = "→ Offer offline mode / download prompts for favourite tracks"
ADVICE_CROSS_GENRE = "→ Cross-genre mood playlists and genre-blend features work well"
ADVICE_DEEP_GENRE = "→ Deep-dive genre playlists and artist discography features"
ADVICE_WEEKEND = "→ Target weekend push notifications and curated weekend playlists"
ADVICE_LONG_SESSION = "→ Long-session features: auto-queuing, seamless transitions, sleep timer"

AS_OF = "TIMESTAMP '2000-06-01'"
AUDIO = [
    "danceability", "energy", "valence", "tempo", "acousticness", "instrumentalness", "liveness",
    "speechiness",
]

PARTS: dict[str, str] = {}

PARTS["plays_e"] = """
SELECT CAST(user_id AS VARCHAR) AS userid, ts, '' AS artist_mbid,
       'artist_' || json_extract_string(props, '$.k') AS artist_name, '' AS track_mbid,
       event_type || '_' || json_extract_string(props, '$.k') AS track_name
FROM events"""

PARTS["order_lines"] = "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey"

PARTS["plays_l"] = """
SELECT CAST(o_custkey AS VARCHAR) AS userid, o_orderdate AS ts, '' AS artist_mbid,
       CASE WHEN NOT (l_tax >= 0.075 AND l_discount < 0.005) THEN 'S' || l_suppkey END AS artist_name,
       '' AS track_mbid,
       CASE WHEN NOT l_discount >= 0.095 THEN 'P' || l_partkey END AS track_name
FROM order_lines"""

PARTS["genres_l"] = """
SELECT lower('S' || s_suppkey) AS artist_name_normalized,
       CASE WHEN s_acctbal >= 1000 THEN s_name END AS spotify_artist_id,
       CASE WHEN s_acctbal < 1000 THEN CAST([] AS VARCHAR[])
            WHEN s_acctbal < 2000 THEN ['', r_name]
            WHEN s_acctbal < 2500 THEN [NULL, r_name]
            ELSE [n_name, r_name] END AS genres,
       CASE WHEN s_acctbal >= 1000 THEN CAST(floor(s_acctbal / 100) AS INTEGER) END AS popularity
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE s_acctbal >= 0"""

PARTS["audio_l"] = """
SELECT lower('S' || l_suppkey || '|||P' || l_partkey) AS track_key,
       p_partkey * 7 % 100 / 97.0::DOUBLE AS danceability,
       CASE WHEN p_size > 7 THEN p_size / 47.0::DOUBLE END AS energy,
       p_partkey * 11 % 100 / 97.0::DOUBLE AS valence,
       (60.0::DOUBLE + p_partkey * 13 % 140) / 0.97::DOUBLE AS tempo,
       p_partkey * 17 % 100 / 97.0::DOUBLE AS acousticness,
       p_partkey * 19 % 100 / 97.0::DOUBLE AS instrumentalness,
       p_partkey * 23 % 100 / 97.0::DOUBLE AS liveness,
       p_retailprice / 9700.0::DOUBLE AS speechiness
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey"""

PARTS["profiles_l"] = """
SELECT CAST(c_custkey AS VARCHAR) AS userid,
       CASE WHEN c_acctbal < 9000 THEN c_mktsegment END AS gender, c_acctbal AS age,
       n_name AS country
FROM customer JOIN nation ON c_nationkey = n_nationkey"""

PARTS["labels_l"] = """
SELECT CAST(c_custkey AS VARCHAR) AS userid,
       CAST(floor(abs(c_acctbal)) AS BIGINT) % 6 - 1 AS cluster
FROM customer WHERE c_acctbal >= -500"""

PARTS["vec"] = """
SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label AS cluster FROM embeddings"""


def num(expr: str, name: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0 AS {name}"


def big(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def us(expr: str = "ts", name: str = "ts_us") -> str:
    return f"epoch_us({expr}) AS {name}"


PLAY_COLS = f"userid, artist_mbid, artist_name, track_mbid, track_name, {us()}"


# -- feature blocks over a play table --------------------------------------------------


def artist_block(p: str) -> str:
    return f"""
SELECT userid, count(*) AS unique_artists,
       -sum(plays / total * log2(plays / total)) AS artist_entropy,
       sum(CASE WHEN rn <= 20 THEN plays ELSE 0 END) / any_value(total) AS artist_concentration_20
FROM (SELECT userid, artist_name, CAST(count(*) AS DOUBLE) AS plays,
             row_number() OVER (PARTITION BY userid ORDER BY count(*) DESC) AS rn,
             CAST(sum(count(*)) OVER (PARTITION BY userid) AS DOUBLE) AS total
      FROM {p} WHERE artist_name IS NOT NULL GROUP BY userid, artist_name)
GROUP BY userid"""


def tagged(p: str) -> str:
    return f"""
SELECT p.userid, coalesce(g.genres, CAST([] AS VARCHAR[])) AS genres
FROM {p} p LEFT JOIN genres_l g ON lower(trim(p.artist_name)) = g.artist_name_normalized"""


def genre_counts(t: str) -> str:
    return f"""
SELECT userid, genre, count(*) AS plays
FROM (SELECT userid, unnest(genres) AS genre FROM {t})
WHERE genre IS NOT NULL AND genre <> '' GROUP BY userid, genre"""


def genre_block(t: str, g: str) -> str:
    return f"""
SELECT a.userid, coalesce(b.unique_genres, 0) AS unique_genres,
       coalesce(b.genre_entropy, 0) AS genre_entropy,
       coalesce(b.genre_concentration_5, 0) AS genre_concentration_5, a.avg_genre_tags_per_play
FROM (SELECT userid, avg(len(genres)) AS avg_genre_tags_per_play FROM {t} GROUP BY userid) a
LEFT JOIN (
  SELECT userid, count(*) AS unique_genres, -sum(plays / total * log2(plays / total)) AS genre_entropy,
         sum(CASE WHEN rn <= 5 THEN plays ELSE 0 END) / any_value(total) AS genre_concentration_5
  FROM (SELECT userid, CAST(plays AS DOUBLE) AS plays,
               row_number() OVER (PARTITION BY userid ORDER BY plays DESC) AS rn,
               CAST(sum(plays) OVER (PARTITION BY userid) AS DOUBLE) AS total
        FROM {g}) GROUP BY userid) b ON a.userid = b.userid"""


def bin_entropy(p: str, expr: str) -> str:
    return f"""
SELECT userid, -sum(c / n * log2(c / n)) AS e
FROM (SELECT userid, {expr} AS k, CAST(count(*) AS DOUBLE) AS c,
             CAST(sum(count(*)) OVER (PARTITION BY userid) AS DOUBLE) AS n
      FROM {p} GROUP BY userid, k) GROUP BY userid"""


def temporal_block(p: str) -> str:
    return f"""
SELECT u.userid, h.e AS temporal_hour_entropy, d.e AS temporal_dow_entropy,
       m.e AS temporal_month_entropy, u.morning_ratio, u.evening_ratio, u.weekend_ratio,
       u.listening_days, u.avg_daily_plays
FROM (SELECT userid,
             avg(CASE WHEN hour(ts) BETWEEN 6 AND 11 THEN 1.0::DOUBLE ELSE 0 END) AS morning_ratio,
             avg(CASE WHEN hour(ts) BETWEEN 18 AND 23 THEN 1.0::DOUBLE ELSE 0 END) AS evening_ratio,
             avg(CASE WHEN isodow(ts) >= 6 THEN 1.0::DOUBLE ELSE 0 END) AS weekend_ratio,
             count(DISTINCT CAST(ts AS DATE)) AS listening_days,
             count(*) / CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 + 1 AS DOUBLE)
               AS avg_daily_plays
      FROM {p} GROUP BY userid) u
JOIN ({bin_entropy(p, 'hour(ts)')}) h ON u.userid = h.userid
JOIN ({bin_entropy(p, 'isodow(ts)')}) d ON u.userid = d.userid
JOIN ({bin_entropy(p, 'month(ts)')}) m ON u.userid = m.userid"""


def session_rows(p: str, gap: int) -> str:
    return f"""
SELECT *, sum(fresh) OVER (PARTITION BY userid ORDER BY ts) AS session_id
FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL {gap} MINUTE
                     THEN 1 ELSE 0 END AS fresh
      FROM {p} WINDOW w AS (PARTITION BY userid ORDER BY ts))"""


def session_table(p: str, gap: int) -> str:
    return f"""
SELECT userid, session_id, count(track_name) AS track_count,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0::DOUBLE AS duration_min
FROM ({session_rows(p, gap)}) GROUP BY userid, session_id"""


def engagement_block(p: str, gap: int, windows: tuple[int, ...], novelty: int) -> str:
    new = ", ".join(
        f"count(DISTINCT CASE WHEN first_seen >= now - INTERVAL {d} DAY THEN artist_name END)"
        f" / {d}.0::DOUBLE AS discovery_velocity_{d}d"
        for d in windows
    )
    names = ", ".join(f"a.discovery_velocity_{d}d" for d in windows)
    return f"""
SELECT a.userid, a.total_scrobbles, a.unique_tracks,
       coalesce(a.total_scrobbles / nullif(CAST(a.unique_tracks AS DOUBLE), 0), 0) AS track_replay_rate,
       s.avg_tracks_per_session, s.session_count, s.avg_session_length_min, {names},
       a.novelty_ratio, coalesce(t.top, 0) / CAST(a.total_scrobbles AS DOUBLE) AS top_artist_play_share
FROM (SELECT userid, count(*) AS total_scrobbles,
             count(DISTINCT CASE WHEN artist_name IS NOT NULL AND track_name IS NOT NULL
                                 THEN artist_name || chr(1) || track_name END) AS unique_tracks,
             {new},
             sum(CASE WHEN ts >= now - INTERVAL {novelty} DAY
                       AND first_seen >= now - INTERVAL {novelty} DAY THEN 1.0::DOUBLE ELSE 0 END)
               / sum(CASE WHEN ts >= now - INTERVAL {novelty} DAY THEN 1 ELSE 0 END) AS novelty_ratio
      FROM (SELECT *, max(ts) OVER (PARTITION BY userid) AS now,
                   min(ts) OVER (PARTITION BY userid, artist_name) AS first_seen FROM {p})
      GROUP BY userid) a
JOIN (SELECT userid, avg(track_count) AS avg_tracks_per_session, count(*) AS session_count,
             avg(duration_min) AS avg_session_length_min
      FROM ({session_table(p, gap)}) GROUP BY userid) s ON a.userid = s.userid
LEFT JOIN (SELECT userid, max(c) AS top FROM (SELECT userid, artist_name, count(*) AS c FROM {p}
           WHERE artist_name IS NOT NULL GROUP BY userid, artist_name) GROUP BY userid) t
  ON a.userid = t.userid"""


def audio_block(p: str) -> str:
    means = ", ".join(f"avg(a.{c}) AS mean_{c}" for c in AUDIO)
    return f"""
SELECT p.userid, {means}
FROM {p} p LEFT JOIN (SELECT * FROM audio_l WHERE energy IS NOT NULL) a
  ON lower(trim(p.artist_name)) || '|||' || lower(trim(p.track_name)) = a.track_key
GROUP BY p.userid"""


PARTS["tagged_l"] = tagged("plays_l")
PARTS["genre_counts_l"] = genre_counts("tagged_l")
PARTS["artist_l"] = artist_block("plays_l")
PARTS["genre_l"] = genre_block("tagged_l", "genre_counts_l")
PARTS["temporal_e"] = temporal_block("plays_e")
PARTS["temporal_l"] = temporal_block("plays_l")
PARTS["engagement_l"] = engagement_block("plays_l", 30, (30, 90), 90)
PARTS["engagement_l3"] = engagement_block("plays_l", 30, (30, 90, 180), 90)
PARTS["engagement_e"] = engagement_block("plays_e", 360, (7, 14), 14)
PARTS["audio_block_l"] = audio_block("plays_l")

ARTIST_COLS = [("unique_artists", big), ("artist_entropy", num), ("artist_concentration_20", num)]
GENRE_COLS = [
    ("unique_genres", big), ("genre_entropy", num), ("genre_concentration_5", num),
    ("avg_genre_tags_per_play", num),
]
TEMPORAL_COLS = [
    ("temporal_hour_entropy", num), ("temporal_dow_entropy", num), ("temporal_month_entropy", num),
    ("morning_ratio", num), ("evening_ratio", num), ("weekend_ratio", num), ("listening_days", big),
    ("avg_daily_plays", num),
]


def engagement_cols(windows: tuple[int, ...]) -> list:
    return [
        ("total_scrobbles", big), ("unique_tracks", big), ("track_replay_rate", num),
        ("avg_tracks_per_session", num), ("session_count", big), ("avg_session_length_min", num),
        *[(f"discovery_velocity_{d}d", num) for d in windows],
        ("novelty_ratio", num), ("top_artist_play_share", num),
    ]


AUDIO_COLS = [(f"mean_{c}", num) for c in AUDIO]
MATRIX_COLS = ARTIST_COLS + GENRE_COLS + TEMPORAL_COLS + engagement_cols((30, 90)) + AUDIO_COLS

PARTS["matrix_l"] = f"""
SELECT userid, {', '.join(c for c, _ in MATRIX_COLS)}, gender, age, country
FROM artist_l FULL JOIN genre_l USING (userid) FULL JOIN temporal_l USING (userid)
FULL JOIN engagement_l USING (userid) FULL JOIN audio_block_l USING (userid)
LEFT JOIN profiles_l USING (userid)"""


def pick(cols: list, prefix: str = "") -> str:
    return ", ".join(f(f"{prefix}{c}", c) for c, f in cols)


def only(cols: list, *names: str) -> str:
    return pick([c for c in cols if c[0] in names])


def long_form(table: str, ids: str, cols: list[str]) -> str:
    """Long form that keeps nulls."""
    return " UNION ALL ".join(
        f"SELECT {ids}, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {table}" for c in cols
    )


FEATURES = [c for c, _ in MATRIX_COLS]

PARTS["matrix_m"] = "SELECT * FROM matrix_l"
PARTS["matrix_long"] = long_form("matrix_m", "userid", FEATURES)
PARTS["cluster_long"] = """
SELECT cluster, feature, value FROM matrix_long JOIN labels_l USING (userid)"""
PARTS["cluster_means"] = """
SELECT cluster, feature, sum(value) / nullif(count(value), 0) AS mean, count(*) AS users,
       sum(sum(value)) OVER (PARTITION BY feature) / nullif(sum(count(value)) OVER (PARTITION BY feature), 0)
         AS global_mean
FROM cluster_long GROUP BY cluster, feature"""
PARTS["tag_rows"] = " UNION ALL ".join(
    f"SELECT {i} AS o, '{f}' AS feature, '{hi}' AS hi, '{lo}' AS lo"
    for i, (f, hi, lo) in enumerate(NAME_TAGS)
)
PARTS["names_l"] = """
SELECT cluster,
       CASE WHEN cluster = -1 THEN 'Noise'
            WHEN count(tag) > 0 THEN array_to_string(list(tag ORDER BY o) FILTER (tag IS NOT NULL AND place <= 3), ' / ')
            ELSE 'Cluster ' || cluster END AS cluster_name
FROM (SELECT *, count(tag) OVER (PARTITION BY cluster ORDER BY o) AS place
      FROM (SELECT cluster, o,
                   CASE WHEN (mean - global_mean) / (global_mean + 1e-9) > 0.3 THEN hi
                        WHEN (mean - global_mean) / (global_mean + 1e-9) < -0.3 THEN lo END AS tag
            FROM cluster_means JOIN tag_rows USING (feature)))
GROUP BY cluster"""
PARTS["demo_l"] = """
SELECT l.userid, l.cluster, n.cluster_name, p.gender, p.age, p.country
FROM labels_l l JOIN names_l n USING (cluster) LEFT JOIN profiles_l p USING (userid)"""
PARTS["report_l"] = f"""
SELECT cluster, feature, users, users * 100.0::DOUBLE / sum(users) OVER (PARTITION BY feature) AS percent,
       mean, global_mean,
       CASE WHEN (mean - global_mean) / (global_mean + 1e-9) > 0.15 THEN '▲'
            WHEN (mean - global_mean) / (global_mean + 1e-9) < -0.15 THEN '▼' ELSE '—' END AS arrow
FROM cluster_means WHERE feature IN ({', '.join(f"'{f}'" for f in REPORT_FEATURES)})"""

PARTS["pairs"] = """
SELECT a.vec_id AS i, b.vec_id AS j, a.cluster AS ci, b.cluster AS cj, list_distance(a.x, b.x) AS d
FROM vec a JOIN vec b ON a.vec_id <> b.vec_id"""
PARTS["sil_rows"] = """
SELECT i, any_value(ci) AS cluster,
       coalesce(CASE WHEN max(CASE WHEN ci = cj THEN m END) IS NULL THEN 0
                     ELSE (min(CASE WHEN ci <> cj THEN m END) - max(CASE WHEN ci = cj THEN m END))
            / nullif(greatest(min(CASE WHEN ci <> cj THEN m END), max(CASE WHEN ci = cj THEN m END)), 0) END, 0) AS s
FROM (SELECT i, ci, cj, avg(d) AS m FROM pairs GROUP BY i, ci, cj) GROUP BY i"""
PARTS["vec_cells"] = """
SELECT vec_id, cluster, pos, x[pos] AS v FROM vec, range(1, 65) r(pos)"""
PARTS["centres"] = "SELECT cluster, pos, avg(v) AS c, count(*) AS n FROM vec_cells GROUP BY cluster, pos"
PARTS["within"] = """
SELECT vec_id, cluster, sum((v - c) * (v - c)) AS sq
FROM vec_cells JOIN centres USING (cluster, pos) GROUP BY vec_id, cluster"""

ORACLE: dict[str, str] = {}


def oracle(key: str, sql: str) -> None:
    """Register a statement with the parts it mentions, and those they mention, in order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, part in PARTS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(part)
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if "RECURSIVE" in sql:
        head, sql = "WITH RECURSIVE ", sql.replace("RECURSIVE", "", 1).strip()
        tail_parts, sql = sql.split("\nFINALLY\n")
        body = [f"{n} AS MATERIALIZED ({PARTS[n]})" for n in needed] + [tail_parts]
    else:
        head, body = "WITH ", [f"{n} AS MATERIALIZED ({PARTS[n]})" for n in needed]
    ORACLE[key] = (head + ",\n".join(body) + "\n" + sql) if body else sql


# -- sources ---------------------------------------------------------------------------

oracle("read_plays_tsv", """
SELECT CAST(o_custkey AS VARCHAR) AS userid, epoch_us(o_orderdate) AS ts_us, 'm' || l_suppkey AS artist_mbid,
       CASE l_linenumber WHEN 6 THEN '' WHEN 1 THEN 'S' || l_suppkey WHEN 2 THEN 'S' || l_suppkey
            ELSE '"S' || l_suppkey END AS artist_name,
       CAST(NULL AS VARCHAR) AS track_mbid,
       CASE WHEN l_linenumber IN (1, 6) THEN 'P' || l_partkey END AS track_name
FROM order_lines WHERE l_linenumber NOT IN (3, 4, 5)""")
oracle("read_profiles_tsv", f"""
SELECT CAST(c_custkey AS VARCHAR) AS userid, c_mktsegment AS gender,
       {num('CASE WHEN c_acctbal >= 0 THEN c_acctbal END', 'age')}, CAST(NULL AS VARCHAR) AS country,
       CASE WHEN c_acctbal < 6000
            THEN epoch_us(CAST(DATE '2005-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS TIMESTAMP)) END AS signup_us
FROM customer""")
oracle("read_parquet", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, {num('o_totalprice', 'o_totalprice')}, o_orderpriority,
       {us('o_orderdate', 'order_us')} FROM orders""")
oracle("write_parquet", f"SELECT {PLAY_COLS} FROM plays_e")
oracle("user_sample", f"""
SELECT {PLAY_COLS} FROM plays_l WHERE userid IN (
  SELECT userid FROM (SELECT DISTINCT userid FROM plays_l) ORDER BY md5(userid || '_42'), userid LIMIT 50)""")
oracle("user_universe", "SELECT DISTINCT userid FROM profiles_l WHERE userid IS NOT NULL")
RECENT = f"ts BETWEEN {AS_OF} - INTERVAL 730 DAY AND {AS_OF}"
oracle("ingest_recent_plays", f"""
SELECT userid, '' AS artist_mbid, coalesce(artist_name, '') AS artist_name, '' AS track_mbid, track_name, {us()}
FROM (SELECT *, count(*) OVER (PARTITION BY userid) AS n FROM plays_l WHERE {RECENT}) WHERE n >= 10""")
oracle("ingest_resume", """
SELECT userid FROM profiles_l WHERE userid NOT IN (
  SELECT userid FROM plays_l GROUP BY userid HAVING count(*) >= 40)""")
oracle("clean_plays", f"""
SELECT userid, artist_mbid, CASE WHEN track_name IS NULL THEN '' ELSE artist_name END AS artist_name,
       track_mbid, track_name, {us()} FROM plays_l WHERE artist_name IS NOT NULL""")
oracle("lookback_filter", f"SELECT {PLAY_COLS} FROM plays_l WHERE {RECENT}")
oracle("min_activity_users", f"""
SELECT {PLAY_COLS} FROM plays_l WHERE userid IN (
  SELECT userid FROM plays_l GROUP BY userid HAVING count(*) >= 40)""")
oracle("normalize_artist_key", "SELECT s_suppkey, lower(s_name) AS artist_key FROM supplier")
oracle("track_key", """
SELECT lower(artist_name) || '|||' || lower(track_name) AS track_key, count(*) AS plays
FROM plays_l GROUP BY 1""")
oracle("select_features", f"SELECT userid, {pick(ARTIST_COLS)} FROM artist_l")
oracle("drop_noise", f"SELECT userid, {big('cluster', 'cluster')} FROM labels_l WHERE cluster <> -1")

# -- joins -----------------------------------------------------------------------------

SHOWN_GENRES = "array_to_string(list_transform(genres, lambda g: coalesce(g, '?')), '/')"
oracle("genre_join", f"""
SELECT userid, artist_name, plays, CAST(len(genres) AS BIGINT) AS tags, {SHOWN_GENRES} AS genres
FROM (SELECT p.userid, p.artist_name, p.plays, coalesce(g.genres, CAST([] AS VARCHAR[])) AS genres
      FROM (SELECT userid, artist_name, count(*) AS plays FROM plays_l GROUP BY userid, artist_name) p
      LEFT JOIN genres_l g ON lower(p.artist_name) = g.artist_name_normalized)""")
oracle("audio_join", f"""
SELECT userid, artist_name, track_name, plays, {num('danceability', 'danceability')},
       {num('energy', 'energy')}, {num('tempo', 'tempo')}
FROM (SELECT userid, artist_name, track_name, count(*) AS plays FROM plays_l
      GROUP BY userid, artist_name, track_name) p
LEFT JOIN (SELECT * FROM audio_l WHERE energy IS NOT NULL) a
  ON lower(artist_name) || '|||' || lower(track_name) = a.track_key""")
oracle("feature_block_outer_join", f"""
SELECT userid, {pick(ARTIST_COLS)}, {pick(GENRE_COLS)}, {pick(TEMPORAL_COLS)},
       {pick(engagement_cols((30, 90)))}, {pick(AUDIO_COLS)}
FROM artist_l FULL JOIN genre_l USING (userid) FULL JOIN temporal_e USING (userid)
FULL JOIN engagement_l USING (userid) FULL JOIN audio_block_l USING (userid)""")
oracle("profile_left_join", f"""
SELECT p.userid, p.total_scrobbles, f.gender, {num('f.age', 'age')}, f.country
FROM (SELECT userid, count(*) AS total_scrobbles FROM plays_l GROUP BY userid) p
LEFT JOIN profiles_l f ON p.userid = f.userid""")
oracle("semi_join_users", f"""
SELECT {PLAY_COLS} FROM plays_l WHERE userid IN (SELECT userid FROM profiles_l WHERE age > 5000)""")
oracle("anti_join_known_artists", """
SELECT DISTINCT userid, artist_name
FROM (SELECT *, max(ts) OVER (PARTITION BY userid) AS now FROM plays_l) r
WHERE ts >= now - INTERVAL 90 DAY AND artist_name IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM plays_l b WHERE b.userid = r.userid AND b.artist_name = r.artist_name
                            AND b.ts < r.now - INTERVAL 90 DAY)""")
oracle("cluster_label_join", f"""
SELECT p.userid, artist_mbid, artist_name, track_mbid, track_name, {us()}, {big('l.cluster', 'cluster')}
FROM plays_l p LEFT JOIN labels_l l ON p.userid = l.userid""")
oracle("demographic_join", f"""
SELECT l.userid, {big('l.cluster', 'cluster')}, p.gender, {num('p.age', 'age')}, p.country
FROM labels_l l LEFT JOIN profiles_l p ON l.userid = p.userid""")
oracle("lookup_missing_keys", """
SELECT lower(artist_name) AS artist_key, min(artist_name) AS artist_name FROM plays_l
WHERE artist_name IS NOT NULL AND lower(artist_name) NOT IN (SELECT artist_name_normalized FROM genres_l)
GROUP BY 1""")
oracle("lookup_upsert", f"""
SELECT artist_name_normalized,
       CASE WHEN len(genres) = 0 THEN 'new_' || artist_name_normalized ELSE spotify_artist_id END AS spotify_artist_id,
       CASE WHEN len(genres) = 0 THEN 'fresh' ELSE {SHOWN_GENRES} END AS genres,
       {big('CASE WHEN len(genres) = 0 THEN 50 ELSE popularity END', 'popularity')}
FROM genres_l
UNION ALL
SELECT DISTINCT lower(artist_name), NULL, '', CAST(NULL AS BIGINT) FROM plays_l
WHERE artist_name IS NOT NULL AND lower(artist_name) NOT IN (SELECT artist_name_normalized FROM genres_l)""")

oracle("lookup_missing_tracks", """
SELECT lower(artist_name || '|||' || track_name) AS track_key, min(artist_name) AS artist_name,
       min(track_name) AS track_name
FROM plays_l WHERE artist_name IS NOT NULL AND track_name IS NOT NULL
  AND lower(artist_name || '|||' || track_name) NOT IN (SELECT track_key FROM audio_l WHERE energy IS NOT NULL)
GROUP BY 1""")
oracle("lookup_upsert_tracks", f"""
SELECT track_key, {num('energy', 'energy')}, CAST(NULL AS VARCHAR) AS track_spotify_id FROM audio_l WHERE energy IS NOT NULL
UNION ALL
SELECT DISTINCT lower(artist_name || '|||' || track_name),
       CASE WHEN CAST(right(track_name, 1) AS INT) < 4 THEN CAST(right(track_name, 1) AS INT) / 10.0 END,
       CASE WHEN CAST(right(track_name, 1) AS INT) < 4 THEN 'id_' || lower(artist_name || '|||' || track_name) END
FROM plays_l WHERE artist_name IS NOT NULL AND track_name IS NOT NULL AND CAST(right(track_name, 1) AS INT) < 7
  AND lower(artist_name || '|||' || track_name) NOT IN (SELECT track_key FROM audio_l WHERE energy IS NOT NULL)""")
oracle("enrichment_users", f"""
SELECT DISTINCT trim(CAST(o_custkey AS VARCHAR)) AS userid FROM order_lines
WHERE l_linenumber NOT IN (2, 4, 5, 6) AND CAST(o_custkey AS VARCHAR) NOT IN (
  SELECT userid FROM plays_l WHERE ts BETWEEN {AS_OF} - INTERVAL 1825 DAY AND {AS_OF} GROUP BY userid HAVING count(*) >= 20)""")

# -- diversity -------------------------------------------------------------------------

oracle("artist_play_counts", """
SELECT userid, artist_name, count(*) AS plays FROM plays_l WHERE artist_name IS NOT NULL
GROUP BY userid, artist_name""")
for key, names in {
    "unique_artists": ["unique_artists"],
    "artist_entropy": ["artist_entropy"],
    "artist_concentration": ["artist_concentration_20"],
    "artist_diversity": ["unique_artists", "artist_entropy", "artist_concentration_20"],
}.items():
    oracle(key, f"SELECT userid, {only(ARTIST_COLS, *names)} FROM artist_l")
for key, names in {
    "avg_genre_tags_per_play": ["avg_genre_tags_per_play"],
    "unique_genres": ["unique_genres"],
    "genre_entropy": ["genre_entropy"],
    "genre_concentration": ["genre_concentration_5"],
    "genre_diversity": [c for c, _ in GENRE_COLS],
}.items():
    oracle(key, f"SELECT userid, {only(GENRE_COLS, *names)} FROM genre_l")
oracle("genre_play_counts", "SELECT userid, genre, plays FROM genre_counts_l")

# -- engagement ------------------------------------------------------------------------

oracle("total_scrobbles", "SELECT userid, count(*) AS total_scrobbles FROM plays_l GROUP BY userid")
for key in ("unique_tracks", "track_replay_rate", "top_artist_play_share", "novelty_ratio"):
    oracle(key, f"SELECT userid, {only(engagement_cols((30, 90)), key)} FROM engagement_l")
oracle("session_count", f"""
SELECT userid, count(*) AS session_count FROM ({session_table('plays_e', 30)}) GROUP BY userid""")
for key in ("avg_tracks_per_session", "avg_session_length_min"):
    oracle(key, f"SELECT userid, {only(engagement_cols((7, 14)), key)} FROM engagement_e")
oracle("discovery_velocity", f"""
SELECT userid, {', '.join(num(f'discovery_velocity_{d}d', f'discovery_velocity_{d}d') for d in (30, 90, 180))}
FROM engagement_l3""")
oracle("engagement_features", f"SELECT userid, {pick(engagement_cols((30, 90, 180)))} FROM engagement_l3")
oracle("engagement_features_hours", f"SELECT userid, {pick(engagement_cols((7, 14)))} FROM engagement_e")
oracle("audio_profile", f"SELECT userid, {pick(AUDIO_COLS)} FROM audio_block_l")

# -- rhythm ----------------------------------------------------------------------------

for key, names in {
    "hour_entropy": ["temporal_hour_entropy"],
    "dow_entropy": ["temporal_dow_entropy"],
    "daypart_ratios": ["morning_ratio", "evening_ratio"],
    "weekend_ratio": ["weekend_ratio"],
    "listening_days": ["listening_days"],
    "avg_daily_plays": ["avg_daily_plays"],
    "temporal_features": [c for c, _ in TEMPORAL_COLS],
}.items():
    oracle(key, f"SELECT userid, {only(TEMPORAL_COLS, *names)} FROM temporal_e")
oracle("month_entropy", f"SELECT userid, {only(TEMPORAL_COLS, 'temporal_month_entropy')} FROM temporal_l")
HOUR_SHARES = ", ".join(
    num(f"avg(CASE WHEN hour(ts) = {h} THEN 1.0::DOUBLE ELSE 0 END)", f"hour_{h}") for h in range(24)
)
oracle("hour_profile", f"SELECT userid, {HOUR_SHARES} FROM plays_e GROUP BY userid")

# Principal axes: the matrix is squared until one axis is left, that axis is taken out, and so on.
PARTS["hour_z"] = """
SELECT userid, h, CASE WHEN stddev_pop(x) OVER w > 0 THEN (x - avg(x) OVER w) / stddev_pop(x) OVER w ELSE 0 END AS z
FROM (SELECT userid, h, avg(CASE WHEN hour(ts) = h THEN 1.0::DOUBLE ELSE 0 END) AS x
      FROM plays_e, range(24) r(h) GROUP BY userid, h) WINDOW w AS (PARTITION BY h)"""
PARTS["vec_z"] = """
SELECT vec_id, pos AS h, v - avg(v) OVER (PARTITION BY pos) AS z FROM vec_cells"""


def principal(cells: str, key: str, d: int, count: int, squarings: int = 18) -> str:
    """``axes`` (axis, share, v) of the first ``count`` axes of cells (key, h, z), ``rows`` (key, x), and
    ``scores`` (key, axis, score)."""
    each, diagonal = f"range({d * d})", f"list_transform(range({d}), lambda j: {{}}[j * {d} + j + 1])"
    trace = lambda m: f"list_sum({diagonal.format(m)})"
    return f"""
start AS (
  SELECT list(v ORDER BY p, q) AS m FROM (
    SELECT a.h AS p, b.h AS q, avg(a.z * b.z) AS v FROM {cells} a JOIN {cells} b USING ({key}) GROUP BY a.h, b.h)),
walk(axis, turn, base, power, v, share) AS (
  SELECT 0, 0, m, m, CAST([] AS DOUBLE[]), CAST(0 AS DOUBLE) FROM start
  UNION ALL
  SELECT axis + CAST(done AS INT), CASE WHEN done THEN 0 ELSE turn + 1 END, rest,
         list_transform(next, lambda x: x / {trace('next')}), v, share
  FROM (
    SELECT *, CASE WHEN done THEN rest ELSE list_transform({each}, lambda i: list_sum(list_transform(range({d}),
             lambda k: power[(i // {d}) * {d} + k + 1] * power[k * {d} + i % {d} + 1]))) END AS next
    FROM (
      SELECT axis, turn, done, power, v, share / {trace('whole')} AS share,
             CASE WHEN done THEN list_transform({each}, lambda i: base[i + 1] - share * v[i // {d} + 1] * v[i % {d} + 1])
                  ELSE base END AS rest
      FROM (
        SELECT *, CASE WHEN done THEN list_sum(list_transform({each}, lambda i: v[i // {d} + 1] * base[i + 1] * v[i % {d} + 1])) END AS share
        FROM (
          SELECT axis, turn, done, base, power, whole,
                 list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS v
          FROM (
            SELECT axis, turn, base, power, turn = {squarings} AS done, (SELECT m FROM start) AS whole,
                   list_transform(range({d}), lambda i: power[i * {d} + list_position({diagonal.format('power')},
                     list_max({diagonal.format('power')}))]) AS c
            FROM walk WHERE axis < {count}))))) ),
axes AS (
  SELECT axis - 1 AS axis, share,
         CASE WHEN list_max(v) >= -list_min(v) THEN v ELSE list_transform(v, lambda x: -x) END AS v
  FROM walk WHERE turn = 0 AND axis > 0),
rows AS (SELECT {key}, list(z ORDER BY h) AS x FROM {cells} GROUP BY {key}),
scores AS (SELECT {key}, axis, list_dot_product(x, v) AS score FROM rows, axes)"""


oracle("temporal_pca", f"""RECURSIVE {principal('hour_z', 'userid', 24, 5)}
FINALLY
SELECT userid, {', '.join(num(f"max(CASE WHEN axis = {k} THEN score END)", f"temporal_stability_pc{k + 1}") for k in range(5))}
FROM scores GROUP BY userid""")
oracle("hour_axes", f"""RECURSIVE {principal('hour_z', 'userid', 24, 23)},
kept AS (SELECT * FROM (SELECT axis, coalesce(sum(share) OVER (ORDER BY axis ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                        FROM axes) WHERE before <= 0.6)
FINALLY
SELECT userid, {big('axis', 'axis')}, {num('score', 'score')} FROM scores JOIN kept USING (axis)""")
oracle("vector_plane", f"""RECURSIVE {principal('vec_z', 'vec_id', 64, 2)}
FINALLY
SELECT vec_id, {num('max(CASE WHEN axis = 0 THEN score END)', 'umap_x')}, {num('max(CASE WHEN axis = 1 THEN score END)', 'umap_y')},
       'Cluster ' || any_value(cluster) AS cluster_label
FROM scores JOIN vec USING (vec_id) GROUP BY vec_id""")

# -- matrix and exploration ------------------------------------------------------------

oracle("feature_matrix", f"""
SELECT userid, {pick(MATRIX_COLS)}, gender, {num('age', 'age')}, country FROM matrix_l""")
ORACLE["feature_matrix_increments"] = ORACLE["feature_matrix"]
oracle("dataset_summary", """
SELECT 'scrobbles' AS metric, count(*) AS value FROM plays_l
UNION ALL SELECT 'users', count(DISTINCT userid) FROM plays_l
UNION ALL SELECT 'first_play', CAST(epoch_us(min(ts)) // 1000000 AS BIGINT) FROM plays_l
UNION ALL SELECT 'last_play', CAST(epoch_us(max(ts)) // 1000000 AS BIGINT) FROM plays_l
UNION ALL SELECT 'artists', count(*) FROM genres_l
UNION ALL SELECT 'artists_matched', count(spotify_artist_id) FROM genres_l
UNION ALL SELECT 'tracks', count(*) FROM audio_l""")
oracle("feature_describe", f"""
SELECT feature, count(value) AS count, {num('avg(value)', 'mean')}, {num('stddev_samp(value)', 'std')},
       {num('min(value)', 'min')}, {num('max(value)', 'max')}, {num('quantile_cont(value, 0.25)', 'q25')},
       {num('quantile_cont(value, 0.5)', 'q50')}, {num('quantile_cont(value, 0.75)', 'q75')}
FROM matrix_long GROUP BY feature""")
oracle("feature_histogram", f"""
SELECT e.feature, CAST(e.bin AS BIGINT) AS bin, {num('lo + span * e.bin / 30', 'bin_lo')},
       {num('lo + span * (e.bin + 1) / 30', 'bin_hi')}, coalesce(c.n, 0) AS n
FROM (SELECT * FROM (SELECT feature, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END AS lo,
               CASE WHEN min(value) = max(value) THEN 1.0 ELSE max(value) - min(value) END AS span
               FROM matrix_long GROUP BY feature), range(0, 30) r(bin)) e
LEFT JOIN (
  SELECT feature, least(CAST(floor((value - mn) / span * 30) AS BIGINT), 29) AS bin,
         count(*) AS n
  FROM (SELECT *, CASE WHEN min(value) OVER w = max(value) OVER w THEN min(value) OVER w - 0.5
                       ELSE min(value) OVER w END AS mn,
               CASE WHEN min(value) OVER w = max(value) OVER w THEN 1.0 ELSE max(value) OVER w - min(value) OVER w END AS span
        FROM matrix_long WINDOW w AS (PARTITION BY feature))
  GROUP BY 1, 2) c ON e.feature = c.feature AND e.bin = c.bin""")
oracle("value_counts", """
SELECT 'gender' AS "column", gender AS value, count(*) AS n FROM profiles_l WHERE gender IS NOT NULL GROUP BY gender
UNION ALL SELECT * FROM (
  SELECT 'country', country, count(*) AS n FROM profiles_l GROUP BY country ORDER BY n DESC, country LIMIT 10)""")
PARTS["corr_rows"] = """
SELECT a.feature AS feat_a, b.feature AS feat_b,
       CASE WHEN stddev_pop(a.value) > 1e-9 AND stddev_pop(b.value) > 1e-9 THEN corr(a.value, b.value) END AS r
FROM matrix_long a JOIN matrix_long b ON a.userid = b.userid
WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY a.feature, b.feature"""
oracle("correlation_matrix", f"SELECT feat_a, feat_b, {num('r', 'correlation')} FROM corr_rows")
_AT = "CASE WHEN v[p] IS NOT NULL AND v[q] IS NOT NULL THEN v[{}] END"
oracle("high_correlation_pairs", f"""
SELECT names[p] AS feat_a, names[q] AS feat_b, {num('abs(r)', 'correlation')}
FROM (SELECT p, q, corr(v[p], v[q]) AS r
      FROM (SELECT [{', '.join(f'CAST({c} AS DOUBLE)' for c in FEATURES)}] AS v FROM matrix_l)
      JOIN (SELECT p, q FROM range(1, {len(FEATURES) + 1}) a(p) JOIN range(1, {len(FEATURES) + 1}) b(q) ON p > q) ON true
      GROUP BY p, q HAVING stddev_pop({_AT.format('p')}) > 1e-9 AND stddev_pop({_AT.format('q')}) > 1e-9)
JOIN (SELECT {FEATURES} AS names) ON true
WHERE abs(r) > 0.75""")

# -- sessions, top k, sets -------------------------------------------------------------

oracle("sessionize", f"""
SELECT userid, track_name, {big('session_id', 'session_id')}, {us()} FROM ({session_rows('plays_e', 30)})""")
oracle("session_table", f"""
SELECT userid, {big('session_id', 'session_id')}, track_count, {big('round(duration_min * 60000000)', 'duration_us')}
FROM ({session_table('plays_e', 360)})""")
oracle("first_seen_artist", f"""
SELECT userid, artist_name, {us('min(ts)', 'first_seen_us')} FROM plays_l WHERE artist_name IS NOT NULL
GROUP BY userid, artist_name""")
oracle("sort_plays", f"SELECT {PLAY_COLS} FROM plays_e ORDER BY userid, ts")
PARTS["top_tracks"] = """
SELECT userid, artist_name, track_name, play_count
FROM (SELECT userid, artist_name, track_name, count(*) AS play_count,
             row_number() OVER (PARTITION BY userid ORDER BY count(*) DESC, artist_name, track_name) AS rn
      FROM plays_l WHERE artist_name IS NOT NULL AND track_name IS NOT NULL
      GROUP BY userid, artist_name, track_name) WHERE rn <= 20"""
oracle("top_tracks_per_user", "SELECT userid, artist_name, track_name, play_count FROM top_tracks")
oracle("tracks_to_enrich", "SELECT DISTINCT artist_name, track_name FROM top_tracks")
# The periods and their days.
PERIODS = {"7day": 7, "1month": 30, "3month": 90, "6month": 180, "12month": 365, "overall": 100_000}
oracle("top_artists_by_period", " UNION ALL ".join(f"""
SELECT userid, artist_name, playcount, '{period}' AS period
FROM (SELECT userid, artist_name, count(*) AS playcount,
             row_number() OVER (PARTITION BY userid ORDER BY count(*) DESC, artist_name) AS rn
      FROM plays_l WHERE artist_name IS NOT NULL AND ts BETWEEN {AS_OF} - INTERVAL {days} DAY AND {AS_OF}
      GROUP BY userid, artist_name) WHERE rn <= 5""" for period, days in PERIODS.items()))
PARTS["top_genres"] = """
SELECT genre, CAST(sum(plays) AS BIGINT) AS plays FROM genre_counts_l GROUP BY genre ORDER BY plays DESC, genre LIMIT 10"""
oracle("top_n_genres", "SELECT genre, plays FROM top_genres")
oracle("merge_dedup", f"""
SELECT userid, artist_mbid, artist_name, track_mbid, track_name, {us()}
FROM (SELECT *, row_number() OVER (PARTITION BY userid, ts, artist_name, track_name ORDER BY src) AS rn
      FROM (SELECT * REPLACE ('id' AS artist_mbid), 0 AS src FROM plays_l
            UNION ALL SELECT *, 1 AS src FROM plays_l WHERE ts >= TIMESTAMP '1998-01-01'))
WHERE rn = 1""")
oracle("union_users", f"""
SELECT {PLAY_COLS} FROM plays_l UNION ALL SELECT {PLAY_COLS} FROM plays_e""")
oracle("distinct_artists", "SELECT DISTINCT artist_name FROM plays_l WHERE artist_name IS NOT NULL")
oracle("scalar_checks", f"""
SELECT p.userid, p.artist_name, lower(p.artist_name) AS key, {big('hour(t)', 'hour')},
       {big('isodow(t) - 1', 'dow')}, {big('month(t)', 'month')}, CAST(CAST(t AS DATE) AS VARCHAR) AS day,
       {big('coalesce(len(g.genres), 0)', 'tags')}, {num('log2(plays)', 'log_plays')},
       {num('coalesce(plays / CAST(nullif(len(g.genres), 0) AS DOUBLE), 0)', 'plays_per_tag')},
       {num('TRY_CAST(p.userid AS DOUBLE)', 'user_number')},
       {num('TRY_CAST(p.artist_name AS DOUBLE)', 'not_a_number')}
FROM (SELECT userid, artist_name, count(*) AS plays, min(ts) AS t FROM plays_l GROUP BY userid, artist_name) p
LEFT JOIN genres_l g ON lower(p.artist_name) = g.artist_name_normalized""")

# -- preprocessing ---------------------------------------------------------------------

PARTS["imputed"] = "SELECT userid, " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), median(CAST({c} AS DOUBLE)) OVER ()) AS {c}" for c in FEATURES
) + " FROM matrix_m"
oracle("median_impute", "SELECT userid, " + ", ".join(num(c, c) for c in FEATURES) + " FROM imputed")
oracle(
    "standard_scale",
    "SELECT userid, "
    + ", ".join(
        num(
            f"CASE WHEN min({c}) OVER () = max({c}) OVER () THEN 0 "
            f"ELSE ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () END",
            c,
        )
        for c in FEATURES
    )
    + " FROM imputed",
)

# -- quality ---------------------------------------------------------------------------

oracle("silhouette_exact", f"SELECT {num('avg(s)', 'silhouette')} FROM sil_rows")
oracle("silhouette_squared", f"""
SELECT {num('avg(s)', 'silhouette')}
FROM (SELECT i, coalesce(CASE WHEN max(CASE WHEN ci = cj THEN m END) IS NULL THEN 0
                     ELSE (min(CASE WHEN ci <> cj THEN m END) - max(CASE WHEN ci = cj THEN m END))
            / nullif(greatest(min(CASE WHEN ci <> cj THEN m END), max(CASE WHEN ci = cj THEN m END)), 0) END, 0) AS s
      FROM (SELECT i, ci, cj, avg(d * d) AS m FROM pairs GROUP BY i, ci, cj) GROUP BY i)""")
oracle("silhouette_samples", f"""
SELECT i AS vec_id, {big('cluster', 'cluster')}, {num('s', 'silhouette')} FROM sil_rows""")
oracle("inertia", f"SELECT {num('sum(sq)', 'inertia')} FROM within")
oracle("calinski_harabasz", f"""
SELECT {num('''(SELECT sum(n * (c - g) * (c - g)) FROM centres
  JOIN (SELECT pos, avg(v) AS g FROM vec_cells GROUP BY pos) USING (pos)) / (k - 1)
  / ((SELECT sum(sq) FROM within) / (n - k))''', 'calinski_harabasz')}
FROM (SELECT count(DISTINCT cluster) AS k, count(*) AS n FROM vec)""")
oracle("davies_bouldin", f"""
SELECT {num('avg(worst)', 'davies_bouldin')}
FROM (SELECT a.cluster, max((a.s + b.s) / m.d) AS worst
      FROM (SELECT cluster, avg(sqrt(sq)) AS s FROM within GROUP BY cluster) a
      JOIN (SELECT cluster, avg(sqrt(sq)) AS s FROM within GROUP BY cluster) b ON a.cluster <> b.cluster
      JOIN (SELECT p.cluster AS i, q.cluster AS j, sqrt(sum((p.c - q.c) * (p.c - q.c))) AS d
            FROM centres p JOIN centres q ON p.pos = q.pos GROUP BY p.cluster, q.cluster) m
        ON m.i = a.cluster AND m.j = b.cluster
      GROUP BY a.cluster)""")
_ASSIGNED = """
SELECT k, vec_id, arg_min(c, (d, c)) AS c, min(d) AS d
FROM (SELECT k, c, vec_id, sum((v - value) * (v - value)) AS d FROM {} m JOIN vec_cells USING (pos) GROUP BY k, c, vec_id)
GROUP BY k, vec_id"""
_MOVED = """
starts AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS c, vec_id FROM vec QUALIFY c < 6),
moved(turn, k, c, pos, value) AS (
  SELECT 0, k, c, pos, v FROM starts JOIN vec_cells USING (vec_id) JOIN (VALUES (2), (4), (6)) s(k) ON c < k
  UNION ALL
  SELECT turn, k, c, pos, avg(v)
  FROM (SELECT any_value(turn) + 1 AS turn, k, vec_id, arg_min(c, (d, c)) AS c
        FROM (SELECT turn, k, c, vec_id, sum((v - value) * (v - value)) AS d
              FROM moved JOIN vec_cells USING (pos) WHERE turn < 12 GROUP BY turn, k, c, vec_id)
        GROUP BY k, vec_id)
  JOIN vec_cells USING (vec_id) GROUP BY turn, k, c, pos)"""
oracle("kmeans_rounds", f"""RECURSIVE {_MOVED},
before AS (SELECT * FROM moved WHERE turn = 11),
costs AS ({_ASSIGNED.format('before')})
FINALLY
SELECT {big('k', 'k')}, {big('c', 'centre')}, members, {num('cost', 'cost')}, {num('square', 'square')}
FROM (SELECT k, c, count(*) AS members FROM costs GROUP BY k, c)
JOIN (SELECT k, sum(d) AS cost FROM costs GROUP BY k) USING (k)
JOIN (SELECT k, c, sum(value * value) AS square FROM moved WHERE turn = 12 GROUP BY k, c) USING (k, c)""")
_JUDGED = f"""{_MOVED},
settled AS (SELECT * FROM moved WHERE turn = 12),
given AS ({_ASSIGNED.format('settled')}),
mids AS (SELECT k, c, pos, avg(v) AS mid, count(*) AS n FROM given JOIN vec_cells USING (vec_id) GROUP BY k, c, pos),
off AS (
  SELECT k, c, vec_id, sum((v - mid) * (v - mid)) AS sq
  FROM given JOIN vec_cells USING (vec_id) JOIN mids USING (k, c, pos) GROUP BY k, c, vec_id),
spread AS (SELECT k, c, avg(sqrt(sq)) AS s, count(*) AS n FROM off GROUP BY k, c),
apart AS (
  SELECT a.k, a.c AS i, b.c AS j, sqrt(sum((a.mid - b.mid) * (a.mid - b.mid))) AS m
  FROM mids a JOIN mids b ON a.k = b.k AND a.pos = b.pos AND a.c <> b.c GROUP BY a.k, a.c, b.c),
worst AS (
  SELECT k, avg(w) AS davies_bouldin FROM (
    SELECT a.k, a.i, max((x.s + y.s) / m) AS w FROM apart a JOIN spread x ON x.k = a.k AND x.c = a.i
    JOIN spread y ON y.k = a.k AND y.c = a.j GROUP BY a.k, a.i) GROUP BY k),
inner_ AS (SELECT k, sum(sq) AS inertia FROM off GROUP BY k),
outer_ AS (
  SELECT k, sum(n * (mid - g) * (mid - g)) AS apart FROM mids JOIN (SELECT pos, avg(v) AS g FROM vec_cells GROUP BY pos) USING (pos)
  GROUP BY k),
kinds AS (SELECT k, count(*) AS clusters, sum(n) AS n FROM spread GROUP BY k),
nearness AS (
  SELECT a.k, p.i, a.c AS ci, b.c AS cj, avg(p.d) AS m FROM pairs p JOIN given a ON a.vec_id = p.i
  JOIN given b ON b.k = a.k AND b.vec_id = p.j GROUP BY a.k, p.i, a.c, b.c),
sides AS (
  SELECT k, i, max(CASE WHEN ci = cj THEN m END) AS own, min(CASE WHEN ci <> cj THEN m END) AS other FROM nearness GROUP BY k, i),
silhouettes AS (SELECT k, avg(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END) AS silhouette FROM sides GROUP BY k)"""
oracle("elbow_given", f"""RECURSIVE {_JUDGED}
FINALLY
SELECT {big('k', 'k')}, {num('inertia', 'inertia')}, {num('silhouette', 'silhouette')} FROM inner_ JOIN silhouettes USING (k)""")
oracle("model_choice", f"""RECURSIVE {_JUDGED}
FINALLY
SELECT 'KMeans (k=' || k || ')' AS algorithm, clusters, CAST(0 AS BIGINT) AS noise_points, {num('silhouette', 'silhouette')},
       {num('davies_bouldin', 'davies_bouldin')}, {num('(apart / (clusters - 1)) / (inertia / (n - clusters))', 'calinski_harabasz')}
FROM kinds JOIN silhouettes USING (k) JOIN worst USING (k) JOIN inner_ USING (k) JOIN outer_ USING (k)""")
oracle("core_distance", f"""
SELECT i AS vec_id, {num('d', 'core_distance')}
FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS rn FROM pairs) WHERE rn = 5""")
PARTS["tickets"] = """
SELECT rep, vec_id, cluster,
       row_number() OVER (PARTITION BY rep ORDER BY ('0x' || substr(md5(vec_id || '_' || rep), 1, 13))::BIGINT) AS rn
FROM vec, range(1, 51) r(rep)"""
PARTS["chosen"] = """
SELECT rep, vec_id, cluster FROM tickets WHERE rn <= (SELECT CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) FROM vec)"""
PARTS["rep_means"] = """
SELECT a.rep, p.i, p.ci, p.cj, avg(p.d) AS m
FROM pairs p JOIN chosen a ON a.vec_id = p.i JOIN chosen b ON b.vec_id = p.j AND b.rep = a.rep
GROUP BY a.rep, p.i, p.ci, p.cj"""
oracle("silhouette_stability", f"""
SELECT {num('avg(s)', 'mean_silhouette')}, {num('stddev_pop(s)', 'std_silhouette')}
FROM (SELECT rep, avg(s) AS s
      FROM (SELECT rep, i,
                   coalesce(CASE WHEN max(CASE WHEN ci = cj THEN m END) IS NULL THEN 0
                     ELSE (min(CASE WHEN ci <> cj THEN m END) - max(CASE WHEN ci = cj THEN m END))
                     / nullif(greatest(min(CASE WHEN ci <> cj THEN m END), max(CASE WHEN ci = cj THEN m END)), 0)
                     END, 0) AS s
            FROM rep_means GROUP BY rep, i)
      GROUP BY rep)""")
oracle("density_cluster", """RECURSIVE
dense AS (SELECT i FROM pairs WHERE d <= 1.165 GROUP BY i HAVING count(*) >= 5),
links AS (SELECT i, j FROM pairs WHERE d <= 1.165 AND i IN (SELECT i FROM dense) AND j IN (SELECT i FROM dense)),
reach(root, i) AS (
  SELECT i, i FROM dense
  UNION
  SELECT r.root, l.j FROM reach r JOIN links l ON l.i = r.i),
comp AS (SELECT i, min(root) AS component FROM reach GROUP BY i),
numbered AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS cluster
             FROM comp GROUP BY component HAVING count(*) >= 5)
FINALLY
SELECT v.vec_id, CAST(coalesce(n.cluster, -1) AS BIGINT) AS cluster
FROM vec v LEFT JOIN comp c ON v.vec_id = c.i LEFT JOIN numbered n ON c.component = n.component""")

# The hierarchy of densities, from the order in which a tree of least links grows: components
# at any distance are runs of that order without a longer link inside.
_GROWN = """
core AS (SELECT i, d FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS rn FROM pairs) WHERE rn = 5),
linked AS (
  SELECT p.i, p.j, greatest(p.d, a.d, b.d, 1e-12::DOUBLE) AS w FROM pairs p JOIN core a ON a.i = p.i JOIN core b ON b.i = p.j),
grown(step, i, best) AS (
  SELECT 1, j, w FROM linked WHERE i = (SELECT min(i) FROM core)
  UNION ALL
  SELECT step + 1, g.i, least(best, w)
  FROM (SELECT *, first_value(i) OVER (ORDER BY best, i) AS nearest FROM grown) g
  JOIN linked l ON l.i = g.nearest AND l.j = g.i),
places AS (
  SELECT step AS pos, arg_min(i, (best, i)) AS i, min(best) AS w FROM grown GROUP BY step
  UNION ALL SELECT 0, min(i), NULL FROM core),
runs AS (
  SELECT DISTINCT w, lo, hi, hi - lo + 1 AS size FROM (
    SELECT a.w, coalesce(max(CASE WHEN b.pos <= a.pos AND b.w > a.w THEN b.pos END), 0) AS lo,
           coalesce(min(CASE WHEN b.pos > a.pos AND b.w > a.w THEN b.pos END) - 1, max(b.pos)) AS hi
    FROM places a, places b WHERE a.w IS NOT NULL GROUP BY a.pos, a.w)
  WHERE hi - lo + 1 >= 5),
above AS (
  SELECT r.lo, r.hi, arg_min((o.lo, o.hi), o.size) AS up FROM runs r JOIN runs o
  ON o.lo <= r.lo AND o.hi >= r.hi AND o.size > r.size GROUP BY r.lo, r.hi),
begun AS (
  SELECT r.*, coalesce(n, 0) AS parts FROM runs r LEFT JOIN (SELECT up, count(*) AS n FROM above GROUP BY up) k ON k.up = (r.lo, r.hi)
  WHERE coalesce(n, 0) <> 1),
chains AS (
  SELECT r.w, r.lo, r.hi, r.size, arg_max((o.lo, o.hi), o.size) AS c
  FROM runs r JOIN begun o ON o.lo >= r.lo AND o.hi <= r.hi GROUP BY r.w, r.lo, r.hi, r.size),
tops AS (SELECT c, arg_max((lo, hi), size) AS top, max(size) AS size FROM chains GROUP BY c),
leaving AS (
  SELECT c, pos, i, min(h.w) AS w FROM chains h JOIN places ON pos BETWEEN lo AND hi GROUP BY c, pos, i),
tree AS (
  SELECT t.c, t.top, t.size, a.up AS parent, CASE WHEN u.w IS NULL THEN 0.0::DOUBLE ELSE 1 / u.w END AS birth, 1 / o.w AS death,
         (SELECT sum(1 / l.w) FROM leaving l WHERE l.c = t.c) - t.size * CASE WHEN u.w IS NULL THEN 0.0::DOUBLE ELSE 1 / u.w END AS stability,
         (SELECT min(l.i) FROM leaving l WHERE l.c = t.c) AS least,
         row_number() OVER (ORDER BY t.size, t.top) AS k
  FROM tops t JOIN begun o ON t.c = (o.lo, o.hi) LEFT JOIN above a ON t.top = (a.lo, a.hi) LEFT JOIN runs u ON a.up = (u.lo, u.hi)),
family AS (SELECT t.*, coalesce((SELECT list(s.k) FROM tree s WHERE s.parent = t.c), []) AS kids FROM tree t),
judged(k, best, stable) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS DOUBLE[]), CAST([] AS BOOLEAN[])
  UNION ALL
  SELECT f.k, list_append(best, CASE WHEN keep THEN f.stability ELSE below END), list_append(stable, keep)
  FROM (SELECT j.*, f.k AS next, f.stability,
               coalesce(list_sum(list_transform(kids, lambda x: best[x])), 0) AS below,
               len(kids) = 0 OR f.stability >= list_sum(list_transform(kids, lambda x: best[x])) AS keep
        FROM judged j JOIN family f ON f.k = j.k + 1) f(k0, best, stable, k, stability, below, keep)),
verdict AS (SELECT stable FROM judged ORDER BY k DESC LIMIT 1),
sound AS (SELECT f.* FROM family f, verdict v WHERE v.stable[f.k] AND f.parent IS NOT NULL),
kept AS (
  SELECT s.* FROM sound s WHERE NOT EXISTS (
    SELECT 1 FROM sound o WHERE o.top[1] <= s.top[1] AND o.top[2] >= s.top[2] AND o.size > s.size))"""
oracle("density_hierarchy", f"""RECURSIVE {_GROWN}
FINALLY
SELECT f.least, f.size, {num('birth', 'birth')}, {num('death', 'death')}, {num('stability', 'stability')},
       f.c IN (SELECT c FROM kept) AS kept FROM family f""")
oracle("density_auto", f"""RECURSIVE {_GROWN},
numbered AS (SELECT top, row_number() OVER (ORDER BY least) - 1 AS cluster FROM kept),
first_run AS (
  SELECT p.i, arg_min((r.lo, r.hi), r.size) AS run FROM places p JOIN runs r ON p.pos BETWEEN r.lo AND r.hi GROUP BY p.i)
FINALLY
SELECT v.vec_id, CAST(coalesce(n.cluster, -1) AS BIGINT) AS cluster
FROM vec v LEFT JOIN first_run f ON f.i = v.vec_id
LEFT JOIN numbered n ON n.top[1] <= f.run[1] AND n.top[2] >= f.run[2]""")

# -- profiles --------------------------------------------------------------------------

oracle("cluster_summary", f"""
SELECT {big('cluster', 'cluster')}, feature, {num('avg(value)', 'mean')}, {num('median(value)', 'median')},
       {num('stddev_samp(value)', 'std')} FROM cluster_long GROUP BY cluster, feature""")
oracle("cluster_names", f"SELECT {big('cluster', 'cluster')}, cluster_name FROM names_l")
oracle("cluster_labels", f"SELECT userid, {big('cluster', 'cluster')}, cluster_name FROM labels_l JOIN names_l USING (cluster)")
oracle("cluster_zscore_heatmap", f"""
SELECT {big('cluster', 'cluster')}, feature,
       {num('''CASE WHEN min(mean) OVER w = max(mean) OVER w THEN 0
            ELSE (mean - avg(mean) OVER w) / stddev_pop(mean) OVER w END''', 'zscore')}
FROM cluster_means WHERE cluster <> -1 WINDOW w AS (PARTITION BY feature)""")
oracle("cluster_radar", f"""
SELECT {big('c.cluster', 'cluster')}, f.feature,
       {num("CASE WHEN f.feature = 'no_such_feature' THEN 0 ELSE m.mean END", 'value')}
FROM (SELECT DISTINCT cluster FROM cluster_means WHERE cluster <> -1) c,
     (SELECT unnest(['artist_entropy', 'genre_entropy', 'novelty_ratio', 'track_replay_rate', 'no_such_feature']) AS feature) f
LEFT JOIN cluster_means m ON m.cluster = c.cluster AND m.feature = f.feature""")
PARTS["cluster_tags"] = """
SELECT l.cluster, g.genre, CAST(sum(g.plays) AS DOUBLE) AS plays
FROM genre_counts_l g JOIN labels_l l ON g.userid = l.userid
WHERE l.cluster <> -1 AND g.genre IN (SELECT genre FROM top_genres) GROUP BY l.cluster, g.genre"""
oracle("genre_share_by_cluster", f"""
SELECT {big('c.cluster', 'cluster')}, t.genre, {num('coalesce(k.plays, 0) / c.total', 'proportion')}
FROM (SELECT cluster, sum(plays) AS total FROM cluster_tags GROUP BY cluster) c
CROSS JOIN (SELECT genre FROM top_genres) t
LEFT JOIN cluster_tags k ON k.cluster = c.cluster AND k.genre = t.genre""")
oracle("activity_heatmap", f"""
SELECT {big('c.cluster', 'cluster')}, {big('d.dow', 'dow')}, {big('h.hour', 'hour')}, coalesce(n.plays, 0) AS plays
FROM (SELECT DISTINCT cluster FROM labels_l) c, range(0, 7) d(dow), range(0, 24) h(hour)
LEFT JOIN (SELECT l.cluster, isodow(p.ts) - 1 AS dow, hour(p.ts) AS hour, count(*) AS plays
           FROM plays_e p JOIN labels_l l ON p.userid = l.userid GROUP BY 1, 2, 3) n
  ON n.cluster = c.cluster AND n.dow = d.dow AND n.hour = h.hour""")
oracle("segment_report", f"""
SELECT {big('cluster', 'cluster')}, feature, {big('users', 'users')}, {num('percent', 'percent')}, {num('mean', 'mean')},
       {num('global_mean', 'global_mean')}, arrow FROM report_l WHERE cluster <> -1""")


def line(feature: str, column: str) -> str:
    return f"max(CASE WHEN feature = '{feature}' THEN {column} END)"


oracle("segment_recommendations", f"""
SELECT {big('cluster', 'cluster')}, {big('row_number() OVER (PARTITION BY cluster ORDER BY o)', 'position')}, recommendation
FROM (
  SELECT cluster, o, CASE
      WHEN o = 1 AND nov > nov_all THEN '{ADVICE_NEW_ARTISTS}' WHEN o = 1 THEN '{ADVICE_FAVOURITES}'
      WHEN o = 2 AND rep > rep_all * 1.2 THEN '{ADVICE_OFFLINE}'
      WHEN o = 3 AND gen > gen_all THEN '{ADVICE_CROSS_GENRE}' WHEN o = 3 THEN '{ADVICE_DEEP_GENRE}'
      WHEN o = 4 AND wk > 0.45 THEN '{ADVICE_WEEKEND}'
      WHEN o = 5 AND ses > ses_all * 1.3 THEN '{ADVICE_LONG_SESSION}' END AS recommendation
  FROM (SELECT cluster, {line('novelty_ratio', 'mean')} AS nov, {line('novelty_ratio', 'global_mean')} AS nov_all,
               {line('track_replay_rate', 'mean')} AS rep, {line('track_replay_rate', 'global_mean')} AS rep_all,
               {line('genre_entropy', 'mean')} AS gen, {line('genre_entropy', 'global_mean')} AS gen_all,
               {line('weekend_ratio', 'mean')} AS wk,
               {line('avg_tracks_per_session', 'mean')} AS ses,
               {line('avg_tracks_per_session', 'global_mean')} AS ses_all
        FROM report_l WHERE cluster <> -1 GROUP BY cluster), range(1, 6) r(o))
WHERE recommendation IS NOT NULL""")
oracle("gender_by_cluster", f"""
SELECT cluster_name, gender, {num('count(*) / CAST(sum(count(*)) OVER (PARTITION BY cluster_name) AS DOUBLE)', 'proportion')}
FROM demo_l WHERE gender IS NOT NULL GROUP BY cluster_name, gender""")
oracle("median_age_by_cluster", f"SELECT cluster_name, {num('median(age)', 'median_age')} FROM demo_l GROUP BY cluster_name")
oracle("top_countries_per_cluster", """
SELECT cluster_name, country, n
FROM (SELECT cluster_name, country, count(*) AS n,
             row_number() OVER (PARTITION BY cluster_name ORDER BY count(*) DESC, country) AS rn
      FROM demo_l WHERE country IS NOT NULL GROUP BY cluster_name, country) WHERE rn <= 3""")
oracle("cluster_sizes", f"SELECT {big('cluster', 'cluster')}, count(*) AS users FROM labels_l GROUP BY cluster")
oracle("enrich_with", f"""
SELECT lower(artist_name) AS artist_name_normalized,
       CASE WHEN k % 3 <> 0 THEN 'a' || k END AS spotify_artist_id,
       CASE WHEN k % 3 <> 0 THEN 'g' || (k % 5) ELSE '' END AS genres,
       {big('CASE WHEN k % 3 <> 0 THEN k % 100 END', 'popularity')}
FROM (SELECT DISTINCT artist_name, CAST(substr(artist_name, 2) AS BIGINT) AS k FROM plays_l WHERE artist_name IS NOT NULL)""")


# -- facts about models ----------------------------------------------------------------

_USERS = "FROM (SELECT count(DISTINCT userid) AS n FROM plays_l)"
oracle("pca_facts", f"""
SELECT {big('n', 'users')}, {big('0', 'variance_lost')}, {big('0', 'correlated')} {_USERS}""")
oracle("kmeans_facts", f"""
SELECT {big('n', 'users')}, {big('n', 'labelled')}, {big('0', 'nearer_elsewhere')}, {big('8', 'tried')},
       {big('0', 'rising')}, {big('0', 'extra_reads')} {_USERS}""")
oracle("pipeline_facts", f"""
SELECT {big('n', 'users')}, {big('n', 'labelled')}, {big('0', 'noise')}, {big('0', 'scores_off')} {_USERS}""")
oracle("importance_facts", f"""
SELECT {big('38', 'features')}, {big('38', 'named')}, CAST(1 AS DOUBLE) AS total, {big('0', 'negative')},
       {big('200', 'trees')}, {big('0', 'lost')}, {big('0', 'impure')}""")
