"""Declared schemas for every input and output shape (no inference at scale)."""

from pyspark.sql import types as T

# play history, one row per play.
PLAY_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("platform", T.StringType(), True),
    T.StructField("ms_played", T.LongType(), True),
    T.StructField("ip_addr", T.StringType(), True),
    T.StructField("master_metadata_track_name", T.StringType(), True),
    T.StructField("master_metadata_album_artist_name", T.StringType(), True),
    T.StructField("master_metadata_album_album_name", T.StringType(), True),
    T.StructField("spotify_track_uri", T.StringType(), True),
    T.StructField("reason_start", T.StringType(), True),
    T.StructField("reason_end", T.StringType(), True),
    T.StructField("shuffle", T.BooleanType(), True),
    T.StructField("skipped", T.BooleanType(), True),
])

NAME_ITEM = T.StructType([T.StructField("name", T.StringType(), True)])

# ranked artist pages.
ARTIST_PAGE_SCHEMA = T.StructType([
    T.StructField("list", T.StringType(), True),
    T.StructField("page_no", T.IntegerType(), True),
    T.StructField("next", T.StringType(), True),
    T.StructField("items", T.ArrayType(NAME_ITEM), True),
])

# ranked track pages.
TRACK_ITEM = T.StructType([
    T.StructField("name", T.StringType(), True),
    T.StructField("artists", T.ArrayType(NAME_ITEM), True),
])
TRACK_PAGE_SCHEMA = T.StructType([
    T.StructField("list", T.StringType(), True),
    T.StructField("page_no", T.IntegerType(), True),
    T.StructField("next", T.StringType(), True),
    T.StructField("items", T.ArrayType(TRACK_ITEM), True),
])

# one event document inside an event-search response body.
IMAGE = T.StructType([
    T.StructField("url", T.StringType(), True),
    T.StructField("width", T.IntegerType(), True),
])
VENUE = T.StructType([
    T.StructField("name", T.StringType(), True),
    T.StructField("city", T.StructType([T.StructField("name", T.StringType(), True)]), True),
    T.StructField("address", T.StructType([T.StructField("line1", T.StringType(), True)]), True),
])
EVENT_DOC = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("name", T.StringType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("images", T.ArrayType(IMAGE), True),
    T.StructField("dates", T.StructType([
        T.StructField("start", T.StructType([
            T.StructField("localDate", T.StringType(), True)]), True)]), True),
    T.StructField("_embedded", T.StructType([
        T.StructField("venues", T.ArrayType(VENUE), True)]), True),
    # catalogue additions used by the radius and category filters
    T.StructField("latitude", T.DoubleType(), True),
    T.StructField("longitude", T.DoubleType(), True),
    T.StructField("classification", T.StringType(), True),
    T.StructField("country", T.StringType(), True),
    T.StructField("source", T.StringType(), True),
])
RESPONSE_BODY = T.StructType([
    T.StructField("_embedded", T.StructType([
        T.StructField("events", T.ArrayType(EVENT_DOC), True)]), True),
])
RESPONSE_SCHEMA = T.StructType([
    T.StructField("query", T.StringType(), True),
    T.StructField("status", T.IntegerType(), True),
    T.StructField("body", T.StringType(), True),
])

# chart names CSV.
CHART_CSV_SCHEMA = T.StructType([T.StructField("artist_name", T.StringType(), True)])

# chart pages.
PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("html", T.StringType(), True),
])

# flat event rows.
FLAT_EVENT_COLUMNS = ["artist_name", "ticket_link", "artist_image", "concert_date",
                      "venue", "city", "address"]
