"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string runs on the driver's pre-registered views.  The stand-in
inputs are rebuilt with the same rules as ``encore.plans.stand_in``;
the operator logic is written the plain way (COUNT DISTINCT, HAVING,
LAG over every play, window min/max), independent of the Spark rewrites.
Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

PLAYS_CTE = """plays AS (
  SELECT o.o_orderdate + to_seconds(CAST(CASE l.l_linenumber WHEN 1 THEN 0 WHEN 2 THEN 86399
           ELSE (l.l_orderkey * 37 + l.l_linenumber * 3600) % 86400 END AS BIGINT)) AS ts,
         o.o_orderstatus AS platform,
         CAST(l.l_quantity * 1000 AS BIGINT) AS ms_played,
         CAST(NULL AS VARCHAR) AS ip_addr,
         CASE WHEN l.l_partkey % 23 <> 0 THEN CAST(l.l_partkey AS VARCHAR) END AS master_metadata_track_name,
         CASE WHEN o.o_orderpriority = '5-LOW' THEN NULL
              ELSE printf('Customer#%09d', o.o_custkey) END AS master_metadata_album_artist_name,
         CASE WHEN l.l_partkey % 46 <> 0 THEN p.p_brand END AS master_metadata_album_album_name,
         CASE WHEN l.l_partkey % 46 <> 0 THEN 'uri:track:' || CAST(l.l_partkey AS VARCHAR) END AS spotify_track_uri,
         CASE WHEN l.l_linenumber = 3 THEN NULL
              WHEN o.o_orderpriority = '1-URGENT' THEN 'clickrow'
              WHEN o.o_orderpriority = '2-HIGH' THEN 'playbtn'
              ELSE 'fwdbtn' END AS reason_start,
         CASE WHEN l.l_linenumber = 5 THEN NULL
              WHEN l.l_linestatus = 'F' THEN 'trackdone'
              ELSE 'endplay' END AS reason_end,
         l.l_discount > 0.05 AS shuffle,
         CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE l.l_returnflag = 'R' END AS skipped
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
artist_plays AS (SELECT * FROM plays WHERE master_metadata_album_artist_name IS NOT NULL)"""

A = "master_metadata_album_artist_name"
T = "master_metadata_track_name"
AL = "master_metadata_album_album_name"

AGG_UNIQUE = f"""f_distinct AS (
  SELECT {A}, COUNT(DISTINCT {AL}) AS unique_albums_for_artist,
         COUNT(DISTINCT {T}) AS num_unique_songs_for_artist
  FROM artist_plays GROUP BY {A})"""
AGG_TRUE_ALBUMS = f"""f_albums AS (
  SELECT {A}, COUNT(album_name) AS num_true_albums
  FROM (SELECT {A}, {AL} AS album_name, COUNT(DISTINCT {T}) AS n_tracks
        FROM artist_plays GROUP BY {A}, {AL}) g
  WHERE n_tracks > 1 GROUP BY {A})"""
AGG_PLAYS = f"""f_plays AS (SELECT {A}, COUNT(*) AS play_count_per_artist FROM artist_plays GROUP BY {A})"""
AGG_CONSISTENCY = f"""f_months AS (
  SELECT {A}, COUNT(*) AS listening_consistency
  FROM (SELECT {A}, strftime(ts, '%Y-%m') AS year_month, COUNT(DISTINCT {T}) AS n_tracks
        FROM artist_plays GROUP BY {A}, strftime(ts, '%Y-%m')) g
  WHERE n_tracks > 1 GROUP BY {A})"""
AGG_SKIP = f"""f_skip AS (SELECT {A}, AVG(CAST(skipped AS INT)) AS skip_rate FROM artist_plays GROUP BY {A})"""
AGG_INTENT = f"""f_intent AS (
  SELECT {A}, SUM(CAST(reason_start IN ('clickrow', 'playbtn', 'backbtn') AS INT)) / COUNT(*)
         AS intentional_listening_rate
  FROM artist_plays GROUP BY {A})"""
AGG_DONE = f"""f_done AS (
  SELECT {A}, SUM(CAST(reason_end = 'trackdone' AS INT)) / COUNT(*) AS completion_rate
  FROM artist_plays GROUP BY {A})"""
AGG_REVISIT = f"""f_gaps AS (
  SELECT {A}, COUNT(*) AS revisit_rate
  FROM (SELECT {A}, DATEDIFF('day', LAG(ts) OVER (PARTITION BY {A} ORDER BY ts), ts) AS gap
        FROM artist_plays) g
  WHERE gap > 120 GROUP BY {A})"""

FEATURES_CTE = f"""{PLAYS_CTE},
{AGG_PLAYS},
{AGG_UNIQUE},
{AGG_DONE},
{AGG_INTENT},
{AGG_SKIP},
{AGG_CONSISTENCY},
{AGG_TRUE_ALBUMS},
{AGG_REVISIT},
features AS (
  SELECT {A}, play_count_per_artist, unique_albums_for_artist, num_unique_songs_for_artist,
         completion_rate, intentional_listening_rate, skip_rate,
         listening_consistency, num_true_albums, revisit_rate
  FROM f_plays
  LEFT JOIN f_distinct USING ({A})
  LEFT JOIN f_done USING ({A})
  LEFT JOIN f_intent USING ({A})
  LEFT JOIN f_skip USING ({A})
  LEFT JOIN f_months USING ({A})
  LEFT JOIN f_albums USING ({A})
  LEFT JOIN f_gaps USING ({A})
)"""

LOG_FEATURES = ["play_count_per_artist", "num_unique_songs_for_artist", "completion_rate",
                "intentional_listening_rate", "listening_consistency", "num_true_albums",
                "revisit_rate"]


def _scaled_logs() -> str:
    cols = []
    for c in LOG_FEATURES:
        x = f"ln(1 + CAST({c} AS DOUBLE))"
        lo = f"MIN({x}) OVER ()"
        hi = f"MAX({x}) OVER ()"
        cols.append(f"({x} - {lo}) / CASE WHEN {hi} = {lo} THEN 1.0 ELSE {hi} - {lo} END AS log_{c}")
    return ",\n         ".join(cols)


SCORES_CTE = f"""{FEATURES_CTE},
scaled AS (
  SELECT {_scaled_logs()},
         {A} AS artist_name
  FROM features
),
scored AS (
  SELECT *, 0.30 * log_listening_consistency + 0.15 * log_play_count_per_artist
          + 0.15 * log_revisit_rate + 0.15 * log_num_unique_songs_for_artist
          + 0.10 * log_num_true_albums + 0.10 * log_completion_rate
          + 0.05 * log_intentional_listening_rate AS superfan_score
  FROM scaled
),
superfan_scores AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY superfan_score DESC NULLS LAST, artist_name ASC) AS rank
  FROM scored
)"""


def r6(cols) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


SCORE_COLS = [f"log_{c}" for c in LOG_FEATURES] + ["superfan_score"]
FEATURE_DOUBLES = ["completion_rate", "intentional_listening_rate", "skip_rate"]
FEATURE_LONGS = ["play_count_per_artist", "unique_albums_for_artist",
                 "num_unique_songs_for_artist", "listening_consistency", "num_true_albums",
                 "revisit_rate"]

ORACLE: dict[str, str] = {}

ORACLE["pipe1_features"] = f"""WITH {FEATURES_CTE}
SELECT {A}, {', '.join(FEATURE_LONGS)}, {r6(FEATURE_DOUBLES)} FROM features"""

ORACLE["pipe2_superfan_scores"] = f"""WITH {SCORES_CTE}
SELECT artist_name, rank, {r6(SCORE_COLS)} FROM superfan_scores"""

ORACLE["top2_top50_by_rank"] = f"""WITH {SCORES_CTE}
SELECT artist_name, rank, {r6(SCORE_COLS)} FROM superfan_scores WHERE rank <= 50"""

PLAY_COLS = ("ts, platform, ms_played, ip_addr, master_metadata_track_name, "
             "master_metadata_album_artist_name, master_metadata_album_album_name, "
             "spotify_track_uri, reason_start, reason_end, shuffle, skipped")

ORACLE["flt1_drop_podcasts"] = f"WITH {PLAYS_CTE} SELECT {PLAY_COLS} FROM artist_plays"
ORACLE["flt2_complete_rows"] = f"""WITH {PLAYS_CTE} SELECT {PLAY_COLS} FROM plays
WHERE {T} IS NOT NULL AND {A} IS NOT NULL AND {AL} IS NOT NULL AND spotify_track_uri IS NOT NULL"""
ORACLE["flt3_drop_all_null"] = f"""WITH {PLAYS_CTE} SELECT {PLAY_COLS} FROM plays
WHERE NOT ({T} IS NULL AND {A} IS NULL AND {AL} IS NULL AND spotify_track_uri IS NULL)"""
ORACLE["agg1_play_count"] = f"WITH {PLAYS_CTE}, {AGG_PLAYS} SELECT * FROM f_plays"
ORACLE["agg2_distinct_albums_tracks"] = f"WITH {PLAYS_CTE}, {AGG_UNIQUE} SELECT * FROM f_distinct"
ORACLE["agg3_multi_track_albums"] = f"""WITH {PLAYS_CTE}
SELECT {A}, {AL} AS album_name, COUNT(DISTINCT {T}) AS num_tracks
FROM artist_plays GROUP BY {A}, {AL} HAVING num_tracks > 1"""
ORACLE["agg4_true_albums"] = f"WITH {PLAYS_CTE}, {AGG_TRUE_ALBUMS} SELECT * FROM f_albums"
ORACLE["agg5_listening_consistency"] = f"WITH {PLAYS_CTE}, {AGG_CONSISTENCY} SELECT * FROM f_months"
ORACLE["agg6_active_months"] = f"""WITH {PLAYS_CTE}
SELECT {A}, COUNT(DISTINCT strftime(ts, '%Y-%m')) AS active_months FROM artist_plays GROUP BY {A}"""
ORACLE["agg7_skip_rate"] = f"WITH {PLAYS_CTE}, {AGG_SKIP} SELECT {A}, {r6(['skip_rate'])} FROM f_skip"
ORACLE["agg8_intentional_rate"] = (f"WITH {PLAYS_CTE}, {AGG_INTENT} "
                                   f"SELECT {A}, {r6(['intentional_listening_rate'])} FROM f_intent")
ORACLE["agg9_completion_rate"] = f"WITH {PLAYS_CTE}, {AGG_DONE} SELECT {A}, {r6(['completion_rate'])} FROM f_done"
ORACLE["agg10_revisits"] = f"WITH {PLAYS_CTE}, {AGG_REVISIT} SELECT * FROM f_gaps"
ORACLE["win1_previous_play"] = f"""WITH {PLAYS_CTE}
SELECT {A}, ts, prev_timestamp, DATEDIFF('day', prev_timestamp, ts) AS difference_days FROM (
  SELECT {A}, ts, LAG(ts, 1) OVER (PARTITION BY {A} ORDER BY ts) AS prev_timestamp FROM artist_plays) x"""
ORACLE["win3_partition_total"] = f"""WITH {PLAYS_CTE}
SELECT {A}, COUNT(*) OVER (PARTITION BY {A}) AS total_plays FROM artist_plays"""

# ------------------------------------------------------ recency and blend --

LISTS_CTE = """spend AS (
  SELECT 'long_term' AS list, o_custkey, round(SUM(o_totalprice), 2) AS spend
  FROM orders GROUP BY o_custkey
  UNION ALL
  SELECT 'medium_term', o_custkey, round(SUM(o_totalprice), 2)
  FROM orders WHERE o_orderdate >= TIMESTAMP '2001-02-01' GROUP BY o_custkey
  UNION ALL
  SELECT 'short_term', o_custkey, round(SUM(o_totalprice), 2)
  FROM orders WHERE o_orderdate >= TIMESTAMP '2001-07-01' GROUP BY o_custkey
),
lists AS (
  SELECT list, position, printf('Customer#%09d', o_custkey) AS artist_name FROM (
    SELECT list, o_custkey,
           ROW_NUMBER() OVER (PARTITION BY list ORDER BY spend DESC, o_custkey) AS position
    FROM spend) x
),
tracks AS (
  SELECT 'long_term' AS list, position, printf('Customer#%09d', o_custkey) AS artist_name,
         p_name AS track_name FROM (
    SELECT o_custkey, l_partkey,
           ROW_NUMBER() OVER (ORDER BY qty DESC, o_custkey, l_partkey) AS position
    FROM (SELECT o_custkey, l_partkey, SUM(l_quantity) AS qty
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          GROUP BY o_custkey, l_partkey) y) x
  JOIN part ON p_partkey = l_partkey
),
presence AS (
  SELECT artist_name,
         CASE WHEN n = 1 THEN 1.0 ELSE (n - position) / (n - 1) END AS api_presence_score
  FROM (SELECT artist_name, position, COUNT(*) OVER () AS n FROM lists WHERE list = 'long_term') x
),
consistency AS (
  SELECT artist_name,
         max(CASE WHEN list = 'long_term' THEN 1 ELSE 0 END) AS in_long,
         max(CASE WHEN list = 'medium_term' THEN 1 ELSE 0 END) AS in_medium,
         max(CASE WHEN list = 'short_term' THEN 1 ELSE 0 END) AS in_short
  FROM lists GROUP BY artist_name
),
breadth AS (
  SELECT artist_name, track_breadth,
         track_breadth / MAX(track_breadth) OVER () AS track_breadth_score
  FROM (SELECT artist_name, COUNT(DISTINCT track_name) AS track_breadth
        FROM tracks WHERE artist_name IS NOT NULL GROUP BY artist_name) x
)"""

ORACLE["src4_ranked_artists"] = f"WITH {LISTS_CTE} SELECT list, position, artist_name FROM lists"
ORACLE["src5_ranked_tracks"] = f"WITH {LISTS_CTE} SELECT list, position, artist_name, track_name FROM tracks"
ORACLE["win5_presence_score"] = f"WITH {LISTS_CTE} SELECT artist_name, {r6(['api_presence_score'])} FROM presence"
ORACLE["jn3_time_range_consistency"] = f"""WITH {LISTS_CTE}
SELECT artist_name, in_long, in_medium, in_short,
       round((in_short + in_medium + in_long) / 3.0, 6) AS time_range_consistency FROM consistency"""
ORACLE["agg11_track_breadth"] = f"""WITH {LISTS_CTE}
SELECT artist_name, track_breadth, {r6(['track_breadth_score'])} FROM breadth"""
ORACLE["pipe3_recency"] = f"""WITH {LISTS_CTE}
SELECT COALESCE(c.artist_name, p.artist_name, b.artist_name) AS artist_name,
       round((in_short + in_medium + in_long) / 3.0, 6) AS time_range_consistency,
       round(api_presence_score, 6) AS api_presence_score,
       round(track_breadth_score, 6) AS track_breadth_score
FROM consistency c FULL JOIN presence p ON c.artist_name = p.artist_name
FULL JOIN breadth b ON COALESCE(c.artist_name, p.artist_name) = b.artist_name"""

BLEND_CTE = f"""{SCORES_CTE},
{LISTS_CTE},
blended AS (
  SELECT s.artist_name,
         COALESCE(s.superfan_score, 0) AS superfan_score,
         COALESCE(p.api_presence_score, 0) AS api_presence_score,
         COALESCE((c.in_short + c.in_medium + c.in_long) / 3.0, 0) AS time_range_consistency,
         COALESCE(b.track_breadth_score, 0) AS track_breadth_score
  FROM superfan_scores s
  LEFT JOIN presence p ON s.artist_name = p.artist_name
  LEFT JOIN breadth b ON s.artist_name = b.artist_name
  LEFT JOIN consistency c ON s.artist_name = c.artist_name
),
final AS (
  SELECT *, 0.60 * superfan_score + 0.20 * api_presence_score + 0.10 * time_range_consistency
          + 0.10 * track_breadth_score AS blended_score
  FROM blended
)"""

BLEND_DOUBLES = ["superfan_score", "api_presence_score", "time_range_consistency",
                 "track_breadth_score", "blended_score"]
ORACLE["jn2_blend_all"] = f"WITH {BLEND_CTE} SELECT artist_name, {r6(BLEND_DOUBLES)} FROM final"
ORACLE["pipe4_blend_top50"] = f"""WITH {BLEND_CTE}
SELECT artist_name, {r6(BLEND_DOUBLES)}, blend_rank FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY blended_score DESC NULLS LAST, artist_name) AS blend_rank
  FROM final) x WHERE blend_rank <= 50"""

# -------------------------------------------------------------- events -----

EVENTS_CTE = """ev AS (
  SELECT o_orderkey, o_custkey, o_orderkey // 20 AS page,
         printf('Customer#%09d', o_custkey) AS query,
         CASE o_custkey % 50 WHEN 7 THEN 500 WHEN 11 THEN NULL ELSE 200 END AS status,
         CAST(o_orderkey AS VARCHAR) AS event_id,
         printf('Customer#%09d', o_custkey) ||
           CASE o_orderkey % 4 WHEN 0 THEN ' Live' WHEN 1 THEN ' World Tour'
                WHEN 2 THEN ' with ' || printf('Supplier#%09d', o_orderkey % 100) ELSE '' END AS name,
         'https://tickets.example/event/' || CAST(o_orderkey AS VARCHAR) AS url,
         [{'url': url || '/a.jpg', 'width': 640},
          {'url': url || '/b.jpg', 'width': CASE WHEN o_orderkey % 2 = 0 THEN 1024 ELSE 305 END},
          {'url': url || '/c.jpg', 'width': 1024}] AS images,
         strftime(o_orderdate + INTERVAL 312 MONTH, '%Y-%m-%d') AS concert_date,
         'Hall ' || CAST(o_orderkey % 97 AS VARCHAR) AS venue,
         n_name AS city,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR) || ' Main St' END AS address,
         CAST(42.3331 AS DOUBLE) + ((o_orderkey % 7) - 3) * CAST(0.8 AS DOUBLE) AS latitude,
         CAST(-83.0511 AS DOUBLE) + ((o_orderkey % 5) - 2) * CAST(1.5 AS DOUBLE) AS longitude,
         CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'Sports' ELSE 'Music' END AS classification,
         CASE WHEN o_orderkey % 11 = 0 THEN 'CA' ELSE 'US' END AS country,
         CASE WHEN o_orderkey % 13 = 0 THEN 'resale' ELSE 'ticketmaster' END AS source
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
),
okev AS (
  SELECT *,
         images[list_position(list_transform(images, lambda x: x.width),
                              list_max(list_transform(images, lambda x: x.width)))].url AS artist_image
  FROM ev WHERE status = 200 AND page % 9 <> 4 AND page % 7 <> 3
)"""

FLAT_SQL = ("query, name AS artist_name, url AS ticket_link, artist_image, concert_date, "
            "venue, city, address")
LAT0, LON0 = 42.33306884765625, -83.0511474609375
DIST_SQL = (f"2 * 3958.8 * asin(least(1.0, sqrt("
            f"pow(sin((radians({LAT0}) - radians(latitude)) / 2), 2) + "
            f"cos(radians(latitude)) * cos(radians({LAT0})) * "
            f"pow(sin((radians({LON0}) - radians(longitude)) / 2), 2))))")
MATCH_SQL = """list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"""

ORACLE["src6_flat_events"] = f"WITH {EVENTS_CTE} SELECT {FLAT_SQL} FROM okev"
ORACLE["src7_error_responses"] = f"""WITH {EVENTS_CTE}
SELECT query, status, printf('API error for %s: %d', query, status) AS message FROM (
  SELECT o_custkey, page, any_value(query) AS query, any_value(status) AS status
  FROM ev GROUP BY o_custkey, page) x WHERE status <> 200"""
ORACLE["jn8_category_filter"] = f"""WITH {EVENTS_CTE}
SELECT event_id, {FLAT_SQL} FROM okev
WHERE lower(classification) = 'music' AND country = 'US' AND source = 'ticketmaster'"""
ORACLE["jn7_radius_filter"] = f"""WITH {EVENTS_CTE}
SELECT event_id, artist_name, round(distance, 6) AS distance FROM (
  SELECT event_id, name AS artist_name, {DIST_SQL} AS distance FROM okev) x
WHERE distance <= 150"""

def dist_sql(lat0: str, lon0: str) -> str:
    """DIST_SQL around other centres than the fixed one."""
    return DIST_SQL.replace(str(LAT0), f"({lat0})").replace(str(LON0), f"({lon0})")


ORACLE["jn7_nation_centres"] = f"""WITH {EVENTS_CTE}
SELECT n_name, event_id, artist_name, round(distance, 6) AS distance FROM (
  SELECT c.n_name, c.radius, event_id, name AS artist_name, {dist_sql('c.lat', 'c.lon')} AS distance
  FROM okev, (SELECT n_name, CAST(42.3331 AS DOUBLE) + (n_nationkey % 7 - 3) * CAST(0.9 AS DOUBLE) AS lat,
                     CAST(-83.0511 AS DOUBLE) + (n_nationkey % 5 - 2) * CAST(1.2 AS DOUBLE) AS lon,
                     40 + (n_nationkey % 6) * 35 AS radius FROM nation) c) x
WHERE distance <= radius"""

TOP50_CTE = f"""{BLEND_CTE},
top50 AS (
  SELECT artist_name, blend_rank AS artist_rank FROM (
    SELECT *, ROW_NUMBER() OVER (ORDER BY blended_score DESC NULLS LAST, artist_name) AS blend_rank
    FROM final) x WHERE blend_rank <= 50
),
{EVENTS_CTE},
anorm AS (
  SELECT artist_name AS searched_artist, artist_rank,
         array_to_string({MATCH_SQL.format(c='artist_name')}, ' ') AS a_norm FROM top50
),
enorm AS (
  SELECT *, array_to_string({MATCH_SQL.format(c='name')}, ' ') AS e_norm FROM okev
),
pairs AS (
  SELECT a.searched_artist, a.artist_rank, e.*
  FROM anorm a, enorm e
  WHERE length(a.a_norm) > 0 AND instr(' ' || e.e_norm || ' ', ' ' || a.a_norm || ' ') > 0
)"""

ORACLE["jn6_keyword_match"] = f"""WITH {TOP50_CTE}
SELECT searched_artist, artist_rank, event_id, name AS event_name FROM pairs"""
ORACLE["pipe5_match_events"] = f"""WITH {TOP50_CTE},
near AS (
  SELECT * FROM pairs
  WHERE lower(classification) = 'music' AND country = 'US' AND source = 'ticketmaster'
    AND {DIST_SQL} <= 150
)
SELECT searched_artist, artist_rank, event_position, event_id, name AS artist_name,
       url AS ticket_link, artist_image, concert_date, venue, city, address FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY searched_artist ORDER BY concert_date, event_id)
         AS event_position FROM near) x
WHERE event_position <= 5"""

# -------------------------------------------------- digest and chart -------

from encore.constants import (CHART_ITEM_PATTERN, CHART_SPLIT_PATTERN, DIGEST_CARD,  # noqa: E402
                              DIGEST_CARD_END, DIGEST_DIVIDER, DIGEST_HEAD, DIGEST_TAIL)
from encore.constants import HTML_CLASS, HTML_TAG_NAME, HTML_TOKEN, HTML_VOID, WHITE_SPACE  # noqa: E402
from encore.functions.columns import named_entities  # noqa: E402
from encore.functions.html import sql_literal, sql_render  # noqa: E402
from encore.plans.stand_in import CLASSED_TAGS, LIST_STARTS  # noqa: E402

MATCHED_CTE = f"""{TOP50_CTE},
near AS (
  SELECT * FROM pairs
  WHERE lower(classification) = 'music' AND country = 'US' AND source = 'ticketmaster'
    AND {DIST_SQL} <= 150
),
matched AS (
  SELECT searched_artist, artist_rank, event_position, event_id, name AS artist_name,
         url AS ticket_link, artist_image, concert_date, venue, city, address FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY searched_artist ORDER BY concert_date, event_id)
           AS event_position FROM near) x
  WHERE event_position <= 5
)"""

ORACLE["top4_events_by_date"] = f"""WITH {MATCHED_CTE}
SELECT ROW_NUMBER() OVER (ORDER BY concert_date, artist_rank, event_position) AS digest_position,
       concert_date, searched_artist, event_id FROM matched"""
ORACLE["scl18_event_cards"] = f"""WITH {MATCHED_CTE}
SELECT event_id, searched_artist, {sql_render(DIGEST_CARD)} AS card_html FROM matched"""

_HEAD0, _HEAD1 = DIGEST_HEAD.split("{date}")
ORACLE["pipe6_digest"] = f"""WITH {MATCHED_CTE}
SELECT COUNT(*) AS n_events, strftime(DATE '2026-06-07', '%B %d, %Y') AS digest_date,
       {sql_literal(_HEAD0)} || strftime(DATE '2026-06-07', '%B %d, %Y') || {sql_literal(_HEAD1)}
       || CASE WHEN COUNT(*) > 0 THEN
            string_agg({sql_render(DIGEST_CARD)}, {sql_literal(DIGEST_CARD_END + DIGEST_DIVIDER)}
                       ORDER BY concert_date, artist_rank, event_position)
            || {sql_literal(DIGEST_CARD_END)} ELSE '' END
       || {sql_literal(DIGEST_TAIL)} AS html
FROM matched"""

ORACLE["scl16_long_date"] = "SELECT o_orderkey, strftime(o_orderdate, '%B %d, %Y') AS long_date FROM orders"

_STRIP = sql_literal(rf"^{WHITE_SPACE}+|{WHITE_SPACE}+$")
_NAMED = "MAP {" + ", ".join(f"{sql_literal(k)}: {sql_literal(v)}"
                             for k, v in named_entities().items()) + "}"
_REF = "regexp_extract(p, '^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);', 1)"
_CODE = (f"TRY_CAST(CASE WHEN lower(left({_REF}, 2)) = '#x' THEN '0x' || substr({_REF}, 3) "
         f"ELSE substr({_REF}, 2) END AS INTEGER)")
_UNESCAPED = f"""(SELECT coalesce(string_agg(CASE WHEN i = 1 THEN p ELSE coalesce(
             CASE WHEN {_REF} LIKE '#%' THEN CASE WHEN {_CODE} BETWEEN 1 AND 1114111 THEN chr({_CODE}) END
                  WHEN {_REF} <> '' THEN (SELECT v FROM named WHERE k = {_REF}) END
             || substr(p, length({_REF}) + 2), '&' || p) END, '' ORDER BY i), '')
           FROM (SELECT unnest(s) AS p, unnest(generate_series(1, len(s))) AS i
                 FROM (SELECT string_split(regexp_replace(raw, '<[^>]+>', '', 'g'), '&') AS s)))"""

ITEMS_CTE = f"""named AS (SELECT unnest(map_keys(m)) AS k, unnest(map_values(m)) AS v FROM (SELECT {_NAMED} AS m)),
raw AS (
  SELECT page_id, unnest(m) AS raw, unnest(generate_series(1, len(m))) AS position
  FROM (SELECT page_id, regexp_extract_all(html, {sql_literal(CHART_ITEM_PATTERN)}, 1) AS m
        FROM pages) x
),
items AS (
  SELECT page_id, position,
         regexp_replace({_UNESCAPED}, {_STRIP}, '', 'g') AS text
  FROM raw
),
names AS (
  SELECT page_id, position,
         regexp_replace(string_split_regex(text, {sql_literal(CHART_SPLIT_PATTERN)})[1],
                        {_STRIP}, '', 'g') AS artist_name
  FROM items
),
seed AS (
  SELECT page_id, chart_position, artist_name FROM (
    SELECT page_id, artist_name,
           ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY first_pos) AS chart_position
    FROM (SELECT page_id, artist_name, MIN(position) AS first_pos
          FROM names WHERE position <= 100 GROUP BY page_id, artist_name) y) x
  WHERE chart_position <= 50
)"""

ORACLE["src8_chart_items"] = f"WITH {ITEMS_CTE} SELECT page_id, position, text FROM items"

_TOKEN = HTML_TOKEN.replace("++", "+").replace("*+", "*")
_CLASSED = "html"
for _tag, _own in CLASSED_TAGS.items():
    _CLASSED = f"replace({_CLASSED}, {sql_literal(_tag)}, {sql_literal(_own)})"
_NAMES = "list_transform(w.stack, lambda x: x.name)"
_LEFT = f"(len(w.stack) - list_position(list_reverse({_NAMES}), t.name))"
_OPEN = "STRUCT(pos BIGINT, name VARCHAR, hit VARCHAR[])[]"
ORACLE["src8_elements_by_class"] = f"""WITH RECURSIVE
named AS (SELECT unnest(map_keys(m)) AS k, unnest(map_values(m)) AS v FROM (SELECT {_NAMED} AS m)),
tok AS (
  SELECT page_id, unnest(m) AS t, unnest(generate_series(1, len(m))) AS i
  FROM (SELECT page_id, regexp_extract_all({_CLASSED}, {sql_literal(_TOKEN)}) AS m FROM pages) x
),
tag AS (
  SELECT page_id, i, name, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n,
         CASE WHEN t LIKE '</%' THEN 'close'
              WHEN t LIKE '%/>' OR name IN ({", ".join(map(sql_literal, HTML_VOID))}) THEN 'void'
              ELSE 'open' END AS kind,
         list_filter(['ad', 'top', 'entry'], lambda c: list_contains(string_split_regex(
           {" || ".join(f"regexp_extract(t, {sql_literal(HTML_CLASS)}, {g})" for g in (1, 2, 3))}, '\\s+'), c)) AS hit
  FROM (SELECT *, lower(regexp_extract(t, {sql_literal(HTML_TAG_NAME)}, 1)) AS name FROM tok) x
  WHERE name <> ''
),
walk AS (
  SELECT page_id, CAST(0 AS BIGINT) AS n, CAST([] AS {_OPEN}) AS stack, CAST([] AS {_OPEN}) AS gone,
         CAST(0 AS BIGINT) AS stop
  FROM pages
  UNION ALL
  SELECT w.page_id, t.n,
         CASE WHEN t.kind = 'open' THEN list_append(w.stack, {{'pos': t.i, 'name': t.name, 'hit': t.hit}})
              WHEN t.kind = 'close' AND list_contains({_NAMES}, t.name) THEN w.stack[1:{_LEFT}]
              ELSE w.stack END,
         CASE WHEN t.kind = 'void' THEN [{{'pos': t.i, 'name': t.name, 'hit': t.hit}}]
              WHEN t.kind = 'close' AND list_contains({_NAMES}, t.name) THEN w.stack[{_LEFT} + 1:]
              ELSE CAST([] AS {_OPEN}) END,
         t.i
  FROM walk w JOIN tag t ON t.page_id = w.page_id AND t.n = w.n + 1
),
ends AS (
  SELECT page_id, unnest(gone) AS e, stop FROM walk
  UNION ALL
  SELECT page_id, unnest(stack), CAST(9223372036854775807 AS BIGINT) FROM (
    SELECT page_id, stack FROM walk QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC) = 1) x
),
hits AS (SELECT page_id, e.pos AS pos, stop, unnest(e.hit) AS class FROM ends),
raw AS (
  SELECT h.page_id, h.class, h.pos, coalesce(string_agg(k.t, '' ORDER BY k.i), '') AS raw
  FROM hits h LEFT JOIN tok k ON k.page_id = h.page_id AND k.i > h.pos AND k.i < h.stop
                             AND (k.t NOT LIKE '<%' OR k.t = '<')
  GROUP BY h.page_id, h.class, h.pos
)
SELECT page_id, class, row_number() OVER (PARTITION BY page_id, class ORDER BY pos) AS position,
       regexp_replace({_UNESCAPED.replace("regexp_replace(raw, '<[^>]+>', '', 'g')", "raw")}, {_STRIP}, '', 'g') AS text
FROM raw"""
ORACLE["scl13_primary_name"] = f"WITH {ITEMS_CTE} SELECT page_id, position, artist_name FROM names"
ORACLE["pipe7_chart_seed"] = f"WITH {ITEMS_CTE} SELECT * FROM seed"
ORACLE["snk2_src3_chart_csv"] = f"WITH {ITEMS_CTE} SELECT * FROM seed"

# ---------------------------------------------------------- exploration ----

NUM_FEATURES = ["play_count_per_artist", "unique_albums_for_artist", "num_unique_songs_for_artist",
                "completion_rate", "intentional_listening_rate", "skip_rate",
                "listening_consistency", "num_true_albums", "revisit_rate"]
_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM features WHERE {c} IS NOT NULL"
    for c in NUM_FEATURES)
_ALLCOLS = [A] + NUM_FEATURES

ORACLE["agg19_column_profile"] = f"""WITH {FEATURES_CTE}
""" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT({c}) AS non_null, "
    f"CASE any_value(typeof({c})) WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double' "
    f"WHEN 'VARCHAR' THEN 'string' ELSE lower(any_value(typeof({c}))) END AS dtype FROM features"
    for c in _ALLCOLS)

ORACLE["agg18_describe"] = f"""WITH {FEATURES_CTE}, long AS ({_LONG})
SELECT column_name, COUNT(*) AS count, round(AVG(value), 6) AS mean,
       round(STDDEV_SAMP(value), 6) AS std, round(MIN(value), 6) AS min,
       round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75, round(MAX(value), 6) AS max
FROM long GROUP BY column_name"""

ORACLE["agg20_histogram"] = f"""WITH {FEATURES_CTE}, long AS ({_LONG}),
rng AS (
  SELECT column_name,
         CASE WHEN MIN(value) = MAX(value) THEN MIN(value) - 0.5 ELSE MIN(value) END AS lo,
         CASE WHEN MIN(value) = MAX(value) THEN MAX(value) + 0.5 ELSE MAX(value) END AS hi
  FROM long GROUP BY column_name
),
binned AS (
  SELECT l.column_name,
         CAST(least(floor((value - lo) * 30.0 / (hi - lo)) + 1, 30) AS INTEGER) AS bin
  FROM long l JOIN rng r ON l.column_name = r.column_name
),
counts AS (SELECT column_name, bin, COUNT(*) AS count FROM binned GROUP BY column_name, bin),
grid AS (SELECT column_name, lo, hi, CAST(unnest(generate_series(1, 30)) AS INTEGER) AS bin FROM rng)
SELECT g.column_name, g.bin, round(lo + (g.bin - 1) * ((hi - lo) / 30.0), 6) AS bin_lo,
       round(lo + g.bin * ((hi - lo) / 30.0), 6) AS bin_hi, COALESCE(c.count, 0) AS count
FROM grid g LEFT JOIN counts c ON g.column_name = c.column_name AND g.bin = c.bin"""

_PAIRS = [(a, b) for i, a in enumerate(NUM_FEATURES) for b in NUM_FEATURES[i:]]
_PAIR_ROWS = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y "
    f"FROM features WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS)
ORACLE["agg21_spearman"] = f"""WITH {FEATURES_CTE}, pr AS ({_PAIR_ROWS}),
ranked AS (
  SELECT col_a, col_b,
         RANK() OVER (PARTITION BY col_a, col_b ORDER BY x)
           + (COUNT(*) OVER (PARTITION BY col_a, col_b, x) - 1) / 2.0 AS rx,
         RANK() OVER (PARTITION BY col_a, col_b ORDER BY y)
           + (COUNT(*) OVER (PARTITION BY col_a, col_b, y) - 1) / 2.0 AS ry
  FROM pr
)
SELECT col_a, col_b, round(CASE WHEN isnan(corr(rx, ry)) THEN NULL ELSE corr(rx, ry) END, 6) AS rho
FROM ranked GROUP BY col_a, col_b"""

RAW_FEATURES = LOG_FEATURES


def _scaled_raw() -> str:
    cols = []
    for c in RAW_FEATURES:
        x = f"CAST({c} AS DOUBLE)"
        lo, hi = f"MIN({x}) OVER ()", f"MAX({x}) OVER ()"
        cols.append(f"({x} - {lo}) / CASE WHEN {hi} = {lo} THEN 1.0 ELSE {hi} - {lo} END AS {c}")
    return ",\n         ".join(cols)


ORACLE["scl8_raw_superfan_score"] = f"""WITH {FEATURES_CTE},
scaled AS (SELECT {_scaled_raw()}, {A} AS artist_name FROM features),
scored AS (
  SELECT *, 0.20 * listening_consistency + 0.20 * play_count_per_artist + 0.20 * revisit_rate
          + 0.15 * num_unique_songs_for_artist + 0.10 * num_true_albums + 0.10 * completion_rate
          + 0.05 * intentional_listening_rate AS superfan_score FROM scaled
)
SELECT artist_name,
       ROW_NUMBER() OVER (ORDER BY superfan_score DESC NULLS LAST, artist_name) AS rank,
       {r6(RAW_FEATURES + ['superfan_score'])}
FROM scored"""

ORACLE["scl10_early_blend"] = f"""WITH {BLEND_CTE.replace(
    '0.60 * superfan_score + 0.20 * api_presence_score + 0.10 * time_range_consistency',
    '0.70 * superfan_score + 0.15 * api_presence_score + 0.10 * time_range_consistency').replace(
    '+ 0.10 * track_breadth_score AS blended_score', '+ 0.05 * track_breadth_score AS blended_score')}
SELECT artist_name, {r6(BLEND_DOUBLES)} FROM final"""

# ----------------------------------------------- sources and single steps --

ORACLE["src1_json_union_by_name"] = f"""WITH {PLAYS_CTE}
SELECT ts, CASE WHEN ts >= TIMESTAMP '1998-01-01' THEN NULL ELSE platform END AS platform,
       ms_played, ip_addr, master_metadata_track_name, master_metadata_album_artist_name,
       master_metadata_album_album_name, spotify_track_uri, reason_start, reason_end,
       shuffle, skipped FROM plays"""
ORACLE["src9_preview"] = f"""WITH {PLAYS_CTE}
SELECT {PLAY_COLS} FROM plays ORDER BY {', '.join(c.strip() + ' ASC NULLS FIRST' for c in PLAY_COLS.split(','))}
LIMIT 5"""
ORACLE["agg13_minmax_fit"] = f"""WITH {FEATURES_CTE}
""" + " UNION ALL ".join(
    f"SELECT 'log_{c}' AS column_name, round(MIN(ln(1 + CAST({c} AS DOUBLE))), 6) AS min, "
    f"round(MAX(ln(1 + CAST({c} AS DOUBLE))), 6) AS max FROM features" for c in LOG_FEATURES)
ORACLE["win6_average_rank"] = f"""WITH {FEATURES_CTE}
SELECT {A}, play_count_per_artist,
       RANK() OVER (ORDER BY play_count_per_artist)
         + (COUNT(*) OVER (PARTITION BY play_count_per_artist) - 1) / 2.0 AS avg_rank
FROM features"""
ORACLE["top3_top20_raw_score"] = f"""WITH {FEATURES_CTE},
scaled AS (SELECT {_scaled_raw()}, {A} AS artist_name FROM features),
scored AS (
  SELECT *, 0.20 * listening_consistency + 0.20 * play_count_per_artist + 0.20 * revisit_rate
          + 0.15 * num_unique_songs_for_artist + 0.10 * num_true_albums + 0.10 * completion_rate
          + 0.05 * intentional_listening_rate AS superfan_score FROM scaled
)
SELECT artist_name, round(superfan_score, 6) AS superfan_score FROM scored
ORDER BY superfan_score DESC NULLS LAST, artist_name LIMIT 20"""

ORACLE["jn6_fuzzy_keyword_match"] = f"""WITH {TOP50_CTE},
atok AS (SELECT *, {MATCH_SQL.format(c='searched_artist')} AS a_tok FROM anorm),
etok AS (SELECT *, {MATCH_SQL.format(c='name')} AS e_tok FROM okev)
SELECT a.searched_artist, a.artist_rank, e.event_id, e.name AS event_name
FROM atok a, etok e
WHERE len(a.a_tok) > 0 AND len(e.e_tok) >= len(a.a_tok)
  AND list_bool_or(list_transform(range(1, len(e.e_tok) - len(a.a_tok) + 2),
        lambda i: levenshtein(array_to_string(list_slice(e.e_tok, i, i + len(a.a_tok) - 1), ' '),
                              a.a_norm) <= 1))"""

# the historical-rank flow: the top 50 by rank go straight to event lookup
_RANK_TOP50 = f"""{SCORES_CTE},
top50 AS (SELECT artist_name, rank AS artist_rank FROM superfan_scores WHERE rank <= 50),"""
_BLEND_PART = TOP50_CTE[:TOP50_CTE.index(EVENTS_CTE)]
assert MATCHED_CTE.startswith(_BLEND_PART)
RANK_MATCHED_CTE = _RANK_TOP50 + "\n" + MATCHED_CTE[len(_BLEND_PART):]
ORACLE["pipe5_rank_top50_events"] = f"""WITH {RANK_MATCHED_CTE}
SELECT * FROM matched"""

# ------------------------------------------------- clusters, sinks, chart flow --

def _kmeans_ctes(k: int = 3, rounds: int = 3) -> str:
    """K-means|| seeds as a chain of CTEs, and Lloyd's rounds as a recursion that ends when
    no centre moves."""
    n = len(SCORE_COLS)
    xi = ", ".join(f"x{i}" for i in range(n))
    xs = ", ".join(f"COALESCE({c}, 0) AS x{i}" for i, c in enumerate(SCORE_COLS))
    u = lambda r: f"(CAST(('0x' || substr(md5('{r}|' || artist_name), 1, 12)) AS BIGINT) / 281474976710656.0)"
    dist = lambda a, b: " + ".join(f"({a}x{i} - {b}x{i}) * ({a}x{i} - {b}x{i})" for i in range(n))
    out = [f"x AS MATERIALIZED (SELECT artist_name, superfan_score AS s, {xs} FROM superfan_scores)",
           f"s0 AS MATERIALIZED (SELECT CAST(0 AS BIGINT) AS i, {xi} FROM x ORDER BY {u(0)}, artist_name LIMIT 1)"]
    for r in range(1, rounds + 1):
        out.append(f"d{r} AS MATERIALIZED (SELECT artist_name, MIN({dist('x.', 's.')}) AS d2 "
                   f"FROM x, s{r - 1} s GROUP BY artist_name)")
        out.append(f"s{r} AS MATERIALIZED (SELECT * FROM s{r - 1} UNION ALL "
                   f"SELECT (SELECT COUNT(*) FROM s{r - 1}) - 1 + ROW_NUMBER() OVER (ORDER BY {u(r)}, artist_name), {xi} "
                   f"FROM x JOIN d{r} USING (artist_name) "
                   f"WHERE {u(r)} * (SELECT round(SUM(d2), 9) FROM d{r}) < {2.0 * k} * d2)")
    out.append(f"""seeds AS MATERIALIZED (SELECT s{rounds}.*, COALESCE(w, 0) AS w FROM s{rounds} LEFT JOIN (
           SELECT i, COUNT(*) AS w FROM (SELECT s.i FROM x, s{rounds} s
             QUALIFY ROW_NUMBER() OVER (PARTITION BY artist_name ORDER BY {dist('x.', 's.')}, s.i) = 1) GROUP BY i)
           USING (i))""")
    out.append("t1 AS MATERIALIZED (SELECT 1 AS c, * FROM seeds ORDER BY w DESC, i LIMIT 1)")
    for j in range(2, k + 1):
        out.append(f"""t{j} AS MATERIALIZED (FROM t{j - 1} UNION ALL (SELECT {j} AS c, a.* FROM seeds a, t{j - 1} b
           GROUP BY ALL ORDER BY a.w * MIN({dist('a.', 'b.')}) DESC, a.i LIMIT 1))""".replace(
               "GROUP BY ALL", f"GROUP BY a.i, a.w, {', '.join(f'a.x{i}' for i in range(n))}").replace(
               "a.*", f"a.i, {', '.join(f'a.x{i}' for i in range(n))}, a.w"))
    near = " + ".join(f"(x{i} - p[{i + 1}]) * (x{i} - p[{i + 1}])" for i in range(n))
    mean = ", ".join(f"round(AVG(x{i}), 9)" for i in range(n))
    out.append(f"""lloyd(m, moves) AS (
         SELECT (SELECT list([{xi}] ORDER BY c) FROM t{k}), true
         UNION ALL
         SELECT new, new <> m FROM (
           SELECT m, list_transform(range(1, {k + 1}), lambda j:
                       COALESCE(list_filter(means, lambda q: q.c = j)[1].v, m[j])) AS new
           FROM (SELECT m, list({{'c': c, 'v': v}}) AS means FROM (
             SELECT m, c, [{mean}] AS v FROM (
               SELECT m, list_position(d, list_min(d)) AS c, {xi} FROM (
                 SELECT m, {xi}, list_transform(m, lambda p: {near}) AS d FROM lloyd, x WHERE moves))
             GROUP BY m, c) GROUP BY m)))""")
    out.append(f"""placed AS MATERIALIZED (SELECT artist_name, s, {xi}, list_position(d, list_min(d)) AS c FROM (
         SELECT *, list_transform(m, lambda p: {near}) AS d FROM x, (SELECT m FROM lloyd WHERE NOT moves)))""")
    out.append(f"""clusters AS MATERIALIZED (SELECT artist_name, s, {xi},
         CAST(DENSE_RANK() OVER (ORDER BY mean DESC NULLS LAST, c) - 1 AS INTEGER) AS cluster
         FROM (SELECT *, AVG(s) OVER (PARTITION BY c) AS mean FROM placed))""")
    return ",\n".join(out)


def _pca_ctes() -> str:
    """Principal components by power iteration: a matrix is squared and scaled to trace 1
    until it stands still; its columns are then the first component."""
    n = len(SCORE_COLS)
    at = lambda i, j: f"covar_samp(x{i}, x{j})"
    gram = "[" + ", ".join("[" + ", ".join(at(i, j) for j in range(n)) + "]" for i in range(n)) + "]"
    trace = lambda m: "(" + " + ".join(f"{m}[{i}][{i}]" for i in range(1, n + 1)) + ")"
    cells = lambda f: (f"list_transform(range(1, {n + 1}), lambda i: "  # noqa: E731
                       f"list_transform(range(1, {n + 1}), lambda j: {f}))")
    product = " + ".join(f"m[i][{t}] * m[{t}][j]" for t in range(1, n + 1))

    def power(name, start):
        return [f"""{name}(m, moves) AS (
         SELECT {cells(f"g[i][j] / {trace('g')}")}, true FROM {start}
         UNION ALL
         SELECT new, list_max(list_transform(range(1, {n + 1}), lambda i: list_max(list_transform(
                  range(1, {n + 1}), lambda j: abs(new[i][j] - m[i][j]))))) > 1e-14
         FROM (SELECT m, {cells(f"sq[i][j] / {trace('sq')}")} AS new
               FROM (SELECT m, {cells(product)} AS sq FROM {name} WHERE moves)))""",
                f"""v_{name} AS MATERIALIZED (SELECT list_transform(col, lambda v: v / len * big) AS v FROM (
         SELECT col, sqrt(list_sum(list_transform(col, lambda v: v * v))) AS len, CASE WHEN list_extract(col,
                  list_position(list_transform(col, lambda v: abs(v)), list_max(list_transform(col, lambda v: abs(v))))) >= 0
                  THEN 1.0 ELSE -1.0 END AS big
         FROM (SELECT m[list_position(list_transform(range(1, {n + 1}), lambda i: m[i][i]),
                                      list_max(list_transform(range(1, {n + 1}), lambda i: m[i][i])))] AS col
               FROM {name} WHERE NOT moves)))"""]

    value = " + ".join(f"v[{i}] * g[{i}][{j}] * v[{j}]" for i in range(1, n + 1) for j in range(1, n + 1))
    out = [f"gram AS MATERIALIZED (SELECT {gram} AS g FROM clusters)", *power("pc1", "gram"),
           f"""rest AS MATERIALIZED (SELECT {cells("g[i][j] - l * v[i] * v[j]")} AS g
               FROM (SELECT g, v, {value} AS l FROM gram, v_pc1))""", *power("pc2", "rest")]
    dot = lambda v: " + ".join(f"(x{i} - AVG(x{i}) OVER ()) * {v}.v[{i + 1}]" for i in range(n))
    out.append(f"""frame AS (SELECT artist_name, s, cluster, {dot('v_pc1')} AS PC1, {dot('v_pc2')} AS PC2
               FROM clusters, v_pc1, v_pc2)""")
    return ",\n".join(out)


CLUSTERS_CTE = f"RECURSIVE {SCORES_CTE},\n{_kmeans_ctes()}"
ORACLE["ml1_kmeans"] = f"""WITH {CLUSTERS_CTE}
SELECT artist_name, round(s, 6) AS superfan_score, cluster FROM clusters"""
ORACLE["agg17_cluster_sizes"] = f"""WITH {CLUSTERS_CTE}
SELECT cluster, COUNT(*) AS count FROM clusters GROUP BY cluster"""
ORACLE["ml3_cluster_frame"] = f"""WITH {CLUSTERS_CTE},
{_pca_ctes()}
SELECT round(PC1, 6) AS PC1, round(PC2, 6) AS PC2, CAST(cluster AS VARCHAR) AS cluster, artist_name,
       round(s, 6) AS superfan_score FROM frame"""
_KW = " UNION ALL ".join(f"SELECT '{c}' AS feature, x{i} AS value, cluster FROM clusters"
                         for i, c in enumerate(SCORE_COLS))
ORACLE["ml4_kruskal_wallis"] = f"""WITH {CLUSTERS_CTE}, long AS ({_KW}),
ranked AS (SELECT *, RANK() OVER (PARTITION BY feature ORDER BY value)
             + (COUNT(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM long),
per AS (SELECT feature, cluster, SUM(r) AS rs, COUNT(*) AS n FROM ranked GROUP BY feature, cluster),
tot AS (SELECT feature, CAST(SUM(n) AS BIGINT) AS N, SUM(rs * rs / n) AS s, COUNT(*) AS groups
        FROM per GROUP BY feature),
ties AS (SELECT feature, SUM(t * t * t - t) AS tt FROM (
           SELECT feature, value, CAST(COUNT(*) AS DOUBLE) AS t FROM long GROUP BY feature, value) q
         GROUP BY feature),
h AS (SELECT feature, groups, N, CASE WHEN tt < 1.0 * N * N * N - N THEN
        (12.0 / (1.0 * N * (N + 1)) * s - 3 * (N + 1)) / (1 - tt / (1.0 * N * N * N - N)) END AS h
      FROM tot JOIN ties USING (feature))
SELECT feature, round(h, 6) AS statistic,
       round(CASE groups WHEN 3 THEN exp(-h / 2) END, 6) AS p_value, groups, N FROM h"""


def _long(part: str, query: str, item: str, detail: str, metrics) -> str:
    return " UNION ALL ".join(
        f"SELECT '{part}' AS part, CAST({item} AS VARCHAR) AS item, CAST({detail} AS VARCHAR) AS detail, "
        f"'{m}' AS metric, round(CAST({m} AS DOUBLE), 6) AS value FROM ({query}) t" for m in metrics)


_BY_CLUSTER = f"""WITH {CLUSTERS_CTE}
SELECT cluster, COUNT(*) AS count, MIN(s) AS least, MAX(s) AS greatest FROM clusters GROUP BY cluster"""
ORACLE["pipe8_explore"] = " UNION ALL ".join([
    _long("profile", ORACLE["agg19_column_profile"], "column_name", "dtype", ["non_null"]),
    _long("describe", ORACLE["agg18_describe"], "column_name", "''",
          ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]),
    _long("histogram", ORACLE["agg20_histogram"], "column_name", "bin", ["bin_lo", "bin_hi", "count"]),
    _long("spearman", ORACLE["agg21_spearman"], "col_a", "col_b", ["rho"]),
    _long("clusters", _BY_CLUSTER, "cluster", "''", ["count", "least", "greatest"]),
    _long("frame", ORACLE["ml3_cluster_frame"], "artist_name", "cluster", ["PC1", "PC2", "superfan_score"]),
    _long("kruskal_wallis", ORACLE["ml4_kruskal_wallis"], "feature", "''", ["statistic", "p_value", "groups", "N"])])
ORACLE["top3_log_score_preview"] = f"""WITH {SCORES_CTE}
SELECT artist_name, round(superfan_score, 6) AS superfan_score FROM superfan_scores
ORDER BY superfan_score DESC NULLS LAST, artist_name LIMIT 30"""
ORACLE["snk1_saved_features"] = ORACLE["pipe1_features"]
ORACLE["snk3_view_top_artists"] = f"""WITH {SCORES_CTE}
SELECT artist_name, round(superfan_score, 6) AS superfan_score FROM superfan_scores
WHERE superfan_score >= 0.5"""
ORACLE["snk4_written_digests"] = f"""WITH {MATCHED_CTE}
SELECT COALESCE(city, 'none') AS listener,
       {sql_literal(_HEAD0)} || strftime(DATE '2026-06-07', '%B %d, %Y') || {sql_literal(_HEAD1)}
       || string_agg({sql_render(DIGEST_CARD)}, {sql_literal(DIGEST_CARD_END + DIGEST_DIVIDER)}
                     ORDER BY concert_date, artist_rank, event_position)
       || {sql_literal(DIGEST_CARD_END)} || {sql_literal(DIGEST_TAIL)} AS html
FROM matched GROUP BY 1"""
ORACLE["snk1_bucketed_join"] = f"""WITH {FEATURES_CTE}, {LISTS_CTE}
SELECT {A}, play_count_per_artist, revisit_rate,
       round((in_short + in_medium + in_long) / 3.0, 6) AS time_range_consistency,
       round(api_presence_score, 6) AS api_presence_score, round(track_breadth_score, 6) AS track_breadth_score
FROM features LEFT JOIN presence p ON p.artist_name = {A} LEFT JOIN breadth b ON b.artist_name = {A}
LEFT JOIN consistency c ON c.artist_name = {A}"""
ORACLE["agg2_sketched_counts"] = f"""WITH {PLAYS_CTE}, {AGG_UNIQUE} SELECT *, true AS within_bound FROM f_distinct"""
ORACLE["set4_overlapping_exports"] = f"""WITH {PLAYS_CTE}
SELECT {PLAY_COLS} FROM plays WHERE ts < TIMESTAMP '1998-07-01'
UNION ALL SELECT {PLAY_COLS} FROM plays WHERE ts >= TIMESTAMP '1998-01-01'"""
ORACLE["set4_deduped_exports"] = f"WITH {PLAYS_CTE} SELECT DISTINCT {PLAY_COLS} FROM plays"
ORACLE["src7_unreadable_responses"] = f"""WITH {EVENTS_CTE}
SELECT query, status, CASE WHEN status IS NULL THEN 'no status' ELSE 'body is not JSON' END AS reason
FROM (SELECT o_custkey, page, any_value(query) AS query, any_value(status) AS status
      FROM ev GROUP BY o_custkey, page) x
WHERE status IS NULL OR (status = 200 AND page % 7 = 3 AND page % 9 <> 4)"""

_CHART_PAGES = """pages AS (
  SELECT CAST(c_custkey // 200 * 25 + c_nationkey AS BIGINT) AS page_id,
         '<ul>' || string_agg('<li><a href="/a">' || CASE c_custkey % 4
           WHEN 0 THEN printf('Customer#%09d', c_custkey) || ' &amp; ' || printf('Supplier#%09d', c_custkey)
           WHEN 1 THEN '&nbsp;' || printf('Customer#%09d', c_custkey) || '&#160;'
           WHEN 2 THEN printf('Customer#%09d', c_custkey) || ' Featuring Beyonc&eacute;'
           ELSE 'Caf&eacute; &#x4e2d; ' || CAST(c_custkey AS VARCHAR) END || '</a></li>', ''
           ORDER BY c_custkey) || '</ul>' AS html
  FROM customer GROUP BY page_id
)"""
ORACLE["pipe7_chart_events"] = f"""WITH {_CHART_PAGES}, {ITEMS_CTE}, {EVENTS_CTE},
chart AS (SELECT artist_name, MIN(chart_position) AS place FROM seed GROUP BY artist_name),
anorm AS (
  SELECT artist_name AS searched_artist, ROW_NUMBER() OVER (ORDER BY place, artist_name) AS artist_rank,
         array_to_string({MATCH_SQL.format(c='artist_name')}, ' ') AS a_norm FROM chart
),
enorm AS (
  SELECT *, array_to_string({MATCH_SQL.format(c='name')}, ' ') AS e_norm FROM okev
  WHERE lower(classification) = 'music' AND country = 'US' AND source = 'ticketmaster'
    AND {DIST_SQL} <= 150
),
pairs AS (
  SELECT a.searched_artist, a.artist_rank, e.* FROM anorm a, enorm e
  WHERE length(a.a_norm) > 0 AND instr(' ' || e.e_norm || ' ', ' ' || a.a_norm || ' ') > 0
)
SELECT searched_artist, artist_rank, event_position, event_id, name AS artist_name,
       url AS ticket_link, artist_image, concert_date, venue, city, address FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY searched_artist ORDER BY concert_date, event_id)
         AS event_position FROM pairs) x
WHERE event_position <= 5"""

# ------------------------------------------------- many listeners at once --

def _scoped(cte: str) -> str:
    """The CTEs of one listener's history, for every user_id at once."""
    head, rest = cte[:len(PLAYS_CTE)], cte[len(PLAYS_CTE):]
    head = head.replace("SELECT o.o_orderdate", "SELECT e.user_id, o.o_orderdate").replace(
        "  JOIN part p", """  JOIN events e ON e.event_id = o.o_orderkey % (SELECT COUNT(*) FROM events)
  JOIN part p""")
    rest = (rest.replace(A, f"user_id, {A}").replace("OVER ()", "OVER (PARTITION BY user_id)")
            .replace("OVER (ORDER BY", "OVER (PARTITION BY user_id ORDER BY"))
    return head + rest


ORACLE["scoped_pipe2_scores"] = f"""WITH {_scoped(SCORES_CTE)}
SELECT user_id, artist_name, rank, {r6(SCORE_COLS)} FROM superfan_scores"""
_LISTENER_SPEND = "\n  UNION ALL\n".join(
    f"  SELECT user_id, '{name}' AS list, o_custkey, round(SUM(o_totalprice), 2) AS spend FROM own "
    f"WHERE o_orderdate >= TIMESTAMP '{start}' GROUP BY user_id, o_custkey" for name, start in LIST_STARTS.items())
ORACLE["scoped_pipe4_blend_top50"] = f"""WITH {_scoped(SCORES_CTE)},
own AS (SELECT o.*, e.user_id FROM orders o
        JOIN events e ON e.event_id = o.o_orderkey % (SELECT COUNT(*) FROM events)),
spend AS (
{_LISTENER_SPEND}
),
lists AS (
  SELECT user_id, list, printf('Customer#%09d', o_custkey) AS artist_name,
         ROW_NUMBER() OVER (PARTITION BY user_id, list ORDER BY spend DESC, o_custkey) AS position
  FROM spend
),
presence AS (
  SELECT user_id, artist_name,
         CASE WHEN n = 1 THEN 1.0 ELSE (n - position) / (n - 1) END AS api_presence_score
  FROM (SELECT *, COUNT(*) OVER (PARTITION BY user_id) AS n FROM lists WHERE list = 'long_term') x
),
consistency AS (
  SELECT user_id, artist_name, COUNT(DISTINCT list) / 3.0 AS time_range_consistency
  FROM lists GROUP BY user_id, artist_name
),
breadth AS (
  SELECT user_id, artist_name, n / MAX(n) OVER (PARTITION BY user_id) AS track_breadth_score
  FROM (SELECT user_id, printf('Customer#%09d', o_custkey) AS artist_name, COUNT(DISTINCT p_name) AS n
        FROM own JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
        GROUP BY user_id, o_custkey) x
),
blended AS (
  SELECT s.user_id, s.artist_name, COALESCE(s.superfan_score, 0) AS superfan_score,
         COALESCE(p.api_presence_score, 0) AS api_presence_score,
         COALESCE(c.time_range_consistency, 0) AS time_range_consistency,
         COALESCE(b.track_breadth_score, 0) AS track_breadth_score
  FROM superfan_scores s
  LEFT JOIN presence p ON p.user_id = s.user_id AND p.artist_name = s.artist_name
  LEFT JOIN consistency c ON c.user_id = s.user_id AND c.artist_name = s.artist_name
  LEFT JOIN breadth b ON b.user_id = s.user_id AND b.artist_name = s.artist_name
),
final AS (
  SELECT *, 0.60 * superfan_score + 0.20 * api_presence_score + 0.10 * time_range_consistency
          + 0.10 * track_breadth_score AS blended_score
  FROM blended
)
SELECT user_id, artist_name, {r6(BLEND_DOUBLES)}, blend_rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id
    ORDER BY blended_score DESC NULLS LAST, artist_name) AS blend_rank FROM final) x
WHERE blend_rank <= 50"""
ORACLE["scoped_win6_average_rank"] = f"""WITH {_scoped(FEATURES_CTE)}
SELECT user_id, {A}, play_count_per_artist,
       RANK() OVER (PARTITION BY user_id ORDER BY play_count_per_artist)
         + (COUNT(*) OVER (PARTITION BY user_id, play_count_per_artist) - 1) / 2.0 AS avg_rank
FROM features"""
ORACLE["scoped_agg18_describe"] = f"""WITH {_scoped(FEATURES_CTE)}, long AS ({_LONG.replace("SELECT '", "SELECT user_id, '")})
SELECT user_id, column_name, COUNT(*) AS count, round(AVG(value), 6) AS mean,
       round(STDDEV_SAMP(value), 6) AS std, round(MIN(value), 6) AS min,
       round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75, round(MAX(value), 6) AS max
FROM long GROUP BY user_id, column_name"""
ORACLE["scoped_pipe6_digests"] = f"""WITH {_scoped(SCORES_CTE)},
{EVENTS_CTE},
anorm AS (
  SELECT DISTINCT artist_name AS searched_artist,
         array_to_string({MATCH_SQL.format(c='artist_name')}, ' ') AS a_norm
  FROM superfan_scores WHERE rank <= 50
),
enorm AS (
  SELECT *, array_to_string({MATCH_SQL.format(c='name')}, ' ') AS e_norm FROM okev
  WHERE lower(classification) = 'music' AND country = 'US' AND source = 'ticketmaster'
    AND {DIST_SQL} <= 150
),
kept AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY searched_artist ORDER BY concert_date, event_id) AS event_position
  FROM anorm a, enorm e
  WHERE length(a.a_norm) > 0 AND instr(' ' || e.e_norm || ' ', ' ' || a.a_norm || ' ') > 0
),
matched AS (
  SELECT s.user_id, s.rank AS artist_rank, event_position, name AS artist_name, url AS ticket_link,
         artist_image, concert_date, venue, city, address
  FROM superfan_scores s JOIN kept k ON k.searched_artist = s.artist_name
  WHERE s.rank <= 50 AND event_position <= 5
)
SELECT user_id, COUNT(*) AS n_events, strftime(DATE '2026-06-07', '%B %d, %Y') AS digest_date,
       {sql_literal(_HEAD0)} || strftime(DATE '2026-06-07', '%B %d, %Y') || {sql_literal(_HEAD1)}
       || string_agg({sql_render(DIGEST_CARD)}, {sql_literal(DIGEST_CARD_END + DIGEST_DIVIDER)}
                     ORDER BY concert_date, artist_rank, event_position)
       || {sql_literal(DIGEST_CARD_END)} || {sql_literal(DIGEST_TAIL)} AS html
FROM matched GROUP BY user_id"""

ORACLE["scoped_pipe5_listener_centres"] = f"""WITH {_scoped(SCORES_CTE)},
{EVENTS_CTE},
centres AS (SELECT DISTINCT user_id, CAST(42.3331 AS DOUBLE) + (user_id % 5 - 2) * CAST(0.8 AS DOUBLE) AS lat,
                   CAST(-83.0511 AS DOUBLE) + (user_id % 3 - 1) * CAST(1.5 AS DOUBLE) AS lon,
                   30 + (user_id % 4) * 60 AS radius FROM events),
anorm AS (
  SELECT DISTINCT artist_name AS searched_artist,
         array_to_string({MATCH_SQL.format(c='artist_name')}, ' ') AS a_norm
  FROM superfan_scores WHERE rank <= 50
),
enorm AS (
  SELECT *, array_to_string({MATCH_SQL.format(c='name')}, ' ') AS e_norm FROM okev
  WHERE lower(classification) = 'music' AND country = 'US' AND source = 'ticketmaster'
),
pairs AS (
  SELECT * FROM anorm a, enorm e
  WHERE length(a.a_norm) > 0 AND instr(' ' || e.e_norm || ' ', ' ' || a.a_norm || ' ') > 0
)
SELECT user_id, searched_artist, artist_rank, event_position, event_id FROM (
  SELECT s.user_id, p.searched_artist, s.rank AS artist_rank, event_id,
         ROW_NUMBER() OVER (PARTITION BY s.user_id, p.searched_artist ORDER BY concert_date, event_id) AS event_position
  FROM superfan_scores s JOIN centres c ON c.user_id = s.user_id JOIN pairs p ON p.searched_artist = s.artist_name
  WHERE s.rank <= 50 AND {dist_sql('c.lat', 'c.lon')} <= c.radius) x
WHERE event_position <= 5"""

ORACLE["pipe1_features_columnar"] = ORACLE["pipe1_features"]
