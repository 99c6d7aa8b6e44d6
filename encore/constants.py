"""Fixed values.

Everything in this module is a value that must equal the behaviour being
reproduced (thresholds, weights, reason codes, search parameters), stated
here once, plainly, in natural order; the digest layout and the limits of the
fits are this library's own.
"""

# --- fixed values: play-event columns kept at ingest (in this order) -------
PLAY_COLUMNS = [
    "ts", "platform", "ms_played", "ip_addr",
    "master_metadata_track_name", "master_metadata_album_artist_name",
    "master_metadata_album_album_name", "spotify_track_uri",
    "reason_start", "reason_end", "shuffle", "skipped",
]
ARTIST = "master_metadata_album_artist_name"
TRACK = "master_metadata_track_name"
ALBUM = "master_metadata_album_album_name"

# --- fixed values: behavioural feature rules -------------------------------
INTENTIONAL_REASONS = ["clickrow", "playbtn", "backbtn"]
COMPLETED_REASON = "trackdone"
REVISIT_GAP_DAYS = 120          # a revisit is a gap strictly greater than this
MONTH_FORMAT = "yyyy-MM"

# --- fixed values: features dropped before scoring (collinear) -------------
DROPPED_FEATURES = ["unique_albums_for_artist", "skip_rate"]

# --- fixed values: superfan score weights ----------------------------------
# log variant (the one used downstream)
LOG_SCORE_WEIGHTS = {
    "log_listening_consistency": 0.30,
    "log_play_count_per_artist": 0.15,
    "log_revisit_rate": 0.15,
    "log_num_unique_songs_for_artist": 0.15,
    "log_num_true_albums": 0.10,
    "log_completion_rate": 0.10,
    "log_intentional_listening_rate": 0.05,
}
# raw min-max variant (exploration)
RAW_SCORE_WEIGHTS = {
    "listening_consistency": 0.20,
    "play_count_per_artist": 0.20,
    "revisit_rate": 0.20,
    "num_unique_songs_for_artist": 0.15,
    "num_true_albums": 0.10,
    "completion_rate": 0.10,
    "intentional_listening_rate": 0.05,
}

# --- fixed values: blended score weights -----------------------------------
BLEND_WEIGHTS = {
    "superfan_score": 0.60,
    "api_presence_score": 0.20,
    "time_range_consistency": 0.10,
    "track_breadth_score": 0.10,
}
# earlier blend, overwritten in the exploration notebook
EARLY_BLEND_WEIGHTS = {
    "superfan_score": 0.70,
    "api_presence_score": 0.15,
    "time_range_consistency": 0.10,
    "track_breadth_score": 0.05,
}
TOP_ARTISTS = 50
PAGE_SIZE = 50

# --- fixed values: event search parameters ---------------------------------
EVENT_CLASSIFICATION = "music"
EVENT_GEOHASH = "dpsby4"
EVENT_RADIUS = 150.0
EVENT_RADIUS_UNIT = "miles"
EVENTS_PER_ARTIST = 5
EVENT_COUNTRY = "US"
EVENT_SOURCE = "ticketmaster"
EARTH_RADIUS = {"miles": 3958.8, "km": 6371.0}

# --- fixed values: chart-page seeding --------------------------------------
CHART_ITEM_PATTERN = r"(?s)<li><a[^>]*>(.*?)</a></li>"
# one token of HTML: a comment, a script or style with its content, a tag, a run of text
HTML_TOKEN = (r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
              r"|<[a-z/!?](?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>|[^<]+|<")
HTML_TAG_NAME = r"^</?([A-Za-z][^\s/>]*)"
HTML_CLASS = (r"(?i)^<(?:[^'\">]|\"[^\"]*\"|'[^']*')*?\sclass\s*=\s*"
              r"(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# elements without an end tag, and those whose content is one token with them
HTML_VOID = ("area base br col embed hr img input link meta param source track wbr "
             "script style").split()
# white space that is stripped from names: Unicode's, not only ASCII's
WHITE_SPACE = r"[\s\x0B\x85\p{Z}]"
CHART_SPLIT_PATTERN = r"&|[Ww]ith|[Ff]eaturing"
CHART_ITEMS_SCANNED = 100
CHART_NAMES_KEPT = 50

# --- fixed values: statistics ----------------------------------------------
HIST_BINS = 30
KMEANS_K = 3
KMEANS_SEED_ROUNDS = 3
KMEANS_LIMIT = 1000        # rounds after which a fit that still moves is an error
PCA_K = 2
DESCRIBE_QUANTILES = [0.25, 0.5, 0.75]

# --- fixed values: digest date format and HTML layout ----------------------
DIGEST_DATE_FORMAT = "MMMM dd, yyyy"

# --- digest layout (this library's own): a list of articles -----------------
DIGEST_HEAD = """<!doctype html>
<html lang="en">
<head><meta charset="utf-8"><title>Shows ahead</title>
<style>
body { font: 16px/1.5 system-ui, sans-serif; background: #fff; color: #222; }
main { max-width: 40rem; margin: 2rem auto; }
article { display: grid; grid-template-columns: 9rem 1fr; gap: 1rem; }
article img { width: 9rem; height: 9rem; object-fit: cover; }
dt { float: left; width: 5rem; color: #666; }
</style></head>
<body><main>
<h1>Shows ahead</h1>
<p>Compiled on <time>{date}</time>: dates of the artists at the top of your list.</p>
"""

# One card; {name} placeholders are filled per event.
DIGEST_CARD = """<article>
<img src="{artist_image}" alt="">
<div><h2><a href="{ticket_link}">{artist_name}</a></h2>
<dl><dt>When</dt><dd>{concert_date}</dd>
<dt>Where</dt><dd>{venue}, {city}</dd>
<dt>Address</dt><dd>{address}</dd></dl></div>"""

# Closes a card; the divider stands between two cards (never after the last one).
DIGEST_CARD_END = "\n</article>\n"
DIGEST_DIVIDER = "<hr>\n"
DIGEST_TAIL = "</main></body></html>\n"
