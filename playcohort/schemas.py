"""Table layouts."""

from pyspark.sql import types as T

PLAYS = T.StructType(
    [
        T.StructField("userid", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("artist_mbid", T.StringType()),
        T.StructField("artist_name", T.StringType()),
        T.StructField("track_mbid", T.StringType()),
        T.StructField("track_name", T.StringType()),
    ]
)

PROFILES = T.StructType(
    [
        T.StructField("userid", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("age", T.DoubleType()),
        T.StructField("country", T.StringType()),
        T.StructField("signup", T.TimestampType()),
    ]
)

ARTIST_GENRES = T.StructType(
    [
        T.StructField("artist_name_normalized", T.StringType()),
        T.StructField("spotify_artist_id", T.StringType()),
        T.StructField("genres", T.ArrayType(T.StringType())),
        T.StructField("popularity", T.IntegerType()),
    ]
)

# Fixed column names of the audio lookup; the first eight enter the user profile.
AUDIO_COLUMNS = [
    "danceability",
    "energy",
    "valence",
    "tempo",
    "acousticness",
    "instrumentalness",
    "liveness",
    "speechiness",
]

AUDIO_FEATURES = T.StructType(
    [T.StructField("track_key", T.StringType()), T.StructField("track_spotify_id", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in AUDIO_COLUMNS + ["loudness"]]
    + [T.StructField("mode", T.IntegerType()), T.StructField("time_signature", T.IntegerType())]
)

# Landed page of recent plays: one JSON object per played track.
RECENT_PLAYS = T.StructType(
    [
        T.StructField("userid", T.StringType()),
        T.StructField("uts", T.LongType()),
        T.StructField("artist", T.StringType()),
        T.StructField("title", T.StringType()),
    ]
)

DEMOGRAPHICS = ["gender", "age", "country"]
