"""From raw logs and landed pages to the tables the analysis reads."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, types as T

from playcohort.operators.topk import tracks_to_enrich
from playcohort.schemas import ARTIST_GENRES, AUDIO_FEATURES, PLAYS
from playcohort.sources.ingest import ingest_recent_plays, merge_dedup, users_to_fetch
from playcohort.sources.lookup import (
    artist_answers,
    enrich_stored,
    enrich_with,
    missing_artists,
    missing_tracks,
    stored,
    track_answers,
    upsert,
    upsert_stored,
)
from playcohort.session import cut_lineage
from playcohort.sources.parquet import read_or_empty, user_universe, write_parquet
from playcohort.sources.tsv import read_plays_tsv, read_profiles_tsv

Fetch = Callable[[list[dict]], Sequence[dict | None]]

ARTIST_ANSWER = T.StructType(
    [T.StructField("spotify_artist_id", T.StringType())] + list(ARTIST_GENRES.fields[2:])
)
TRACK_ANSWER = T.StructType(
    [T.StructField("resolved_id", T.StringType())] + list(AUDIO_FEATURES.fields[1:])
)


def run_enrichment(
    spark: SparkSession,
    out_dir: str,
    *,
    as_of: Column,
    plays_tsv: str | None = None,
    profiles_tsv: str | None = None,
    landed_pages: str | None = None,
    previous: str | None = None,
    lookups: str | None = None,
    fetch_artists: Fetch | None = None,
    fetch_tracks: Fetch | None = None,
    lookback_years: int = 5,
    min_scrobbles: int = 50,
    tracks_per_user: int = 20,
) -> dict[str, DataFrame]:
    """Read, merge and enrich; write ``scrobbles``, ``profiles``, ``artist_genres`` and
    ``audio_features`` under ``out_dir`` and return them as read back.

    ``users_to_fetch``, which is returned and not written, lists whom a collector still has to
    ask for: the users of the profiles, else of the play log, else of all plays, without those
    whose landed plays reach the threshold. A resumed collection starts from it.

    Lookup tables of a ``previous`` output folder are extended: only keys they lack are
    asked for. The new folder gets the whole tables; the old one is not touched. With a
    ``lookups`` folder instead, the tables live there across runs: a run rewrites the parts of
    them that its answers fall into, and goes on where an interrupted one stopped asking.
    """
    if previous and lookups:
        raise ValueError("give the folder of a previous run or one of lookup tables, not both")
    sources: list[DataFrame] = []
    log = read_plays_tsv(spark, plays_tsv) if plays_tsv else None
    if log is not None:
        sources.append(log)
    landed = read_or_empty(spark, None, PLAYS)
    if landed_pages:
        landed = ingest_recent_plays(spark, landed_pages, as_of, lookback_years, min_scrobbles)
        sources.append(landed)
    if not sources:
        raise ValueError("neither a play log nor landed pages given")
    out: dict[str, DataFrame] = {}

    def save(name: str, df: DataFrame, by: list[str], within: list[str] = ()) -> DataFrame:
        write_parquet(df, f"{out_dir}/{name}", by, within)
        out[name] = spark.read.parquet(f"{out_dir}/{name}")
        return out[name]

    plays = save("scrobbles", merge_dedup(sources), ["userid"], ["timestamp"])
    if profiles_tsv:
        save("profiles", read_profiles_tsv(spark, profiles_tsv), ["userid"])
    universe = user_universe(out.get("profiles"), plays if log is None else log)
    out["users_to_fetch"] = users_to_fetch(universe, landed, min_scrobbles)

    def extend(name: str, key: str, schema: T.StructType, fetch: Fetch, answer: T.StructType, missing, as_rows) -> None:
        if lookups:
            path = f"{lookups}/{name}"
            answers = enrich_stored(missing(stored(spark, path, schema)), fetch, answer, f"{path}_asked")
            upsert_stored(path, as_rows(answers), key, schema)
            out[name] = stored(spark, path, schema)
            return
        known = read_or_empty(spark, previous and f"{previous}/{name}", schema)
        # Checkpointed: the sorted write would otherwise ask twice, once for its ranges.
        answers = cut_lineage(enrich_with(missing(known), fetch, answer, halve=True))
        save(name, upsert(known, as_rows(answers), key), [key])

    if fetch_artists:
        extend(
            "artist_genres", "artist_name_normalized", ARTIST_GENRES, fetch_artists, ARTIST_ANSWER,
            lambda known: missing_artists(plays, known), artist_answers,
        )
    if fetch_tracks:
        extend(
            "audio_features", "track_key", AUDIO_FEATURES, fetch_tracks, TRACK_ANSWER,
            lambda known: missing_tracks(tracks_to_enrich(plays, tracks_per_user), known), track_answers,
        )
    return out
