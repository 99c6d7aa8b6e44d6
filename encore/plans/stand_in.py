"""Stand-in inputs built from the driver's tables.

No listening history, ranked lists or event responses are supplied, so
these functions give rows *in the schema the operators expect*, derived
from the TPC-H-style tables.  They do none of the operators' work; each
one has a SQL twin in ``encore.plans.oracle`` so the DuckDB check sees the
same input.

plays       lineitem x orders x part: one play per line item
            artist  = 'Customer#%09d' of the order's customer, NULL for
                      priority 5-LOW (podcasts)
            track   = part key (NULL for keys 0 mod 23), album = part brand
            (NULL, as the URI, for keys 0 mod 46), ts = order date and a time
            of day (lines 1 and 2: 00:00:00 and 23:59:59)
            reason_start from priority (NULL on line 3), reason_end from
            line status (NULL on line 5), skipped from return flag (NULL
            for 'N')
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.constants import PAGE_SIZE
from encore.operators.ranking import broadcast_if_small, row_number_by_range
from encore.sources.tables import read_table


def artist_name(custkey) -> F.Column:
    """'Customer#%09d' (concat + lpad: codegen'd, unlike a per-row format call)."""
    return F.concat(F.lit("Customer#"), F.lpad(custkey.cast("string"), 9, "0"))


def _second_of_day() -> F.Column:
    """Midnight, the day's last second, or some time between, by line number."""
    return (F.when(F.col("l_linenumber") == 1, F.lit(0)).when(F.col("l_linenumber") == 2, F.lit(86399))
            .otherwise((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 3600) % 86400))


def plays(spark: SparkSession, base: str) -> DataFrame:
    o = read_table(spark, base, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    return _plays(spark, base, o)


def _plays(spark: SparkSession, base: str, o: DataFrame, keep=()) -> DataFrame:
    l = read_table(spark, base, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount",
        "l_returnflag", "l_linestatus")
    p = read_table(spark, base, "part").select("p_partkey", "p_brand")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    prio = F.col("o_orderpriority")
    return j.select(
        (F.col("o_orderdate") + F.make_dt_interval(secs=_second_of_day())).alias("ts"),
        F.col("o_orderstatus").alias("platform"),
        (F.col("l_quantity") * 1000).cast("long").alias("ms_played"),
        F.lit(None).cast("string").alias("ip_addr"),
        F.when(F.col("l_partkey") % 23 != 0, F.col("l_partkey").cast("string"))
         .alias("master_metadata_track_name"),
        F.when(prio == "5-LOW", F.lit(None).cast("string"))
         .otherwise(artist_name(F.col("o_custkey"))).alias("master_metadata_album_artist_name"),
        F.when(F.col("l_partkey") % 46 != 0, F.col("p_brand")).alias("master_metadata_album_album_name"),
        F.when(F.col("l_partkey") % 46 != 0,
               F.concat(F.lit("uri:track:"), F.col("l_partkey").cast("string"))).alias("spotify_track_uri"),
        F.when(F.col("l_linenumber") == 3, F.lit(None).cast("string"))
         .when(prio == "1-URGENT", F.lit("clickrow"))
         .when(prio == "2-HIGH", F.lit("playbtn"))
         .otherwise(F.lit("fwdbtn")).alias("reason_start"),
        F.when(F.col("l_linenumber") == 5, F.lit(None).cast("string"))
         .when(F.col("l_linestatus") == "F", F.lit("trackdone"))
         .otherwise(F.lit("endplay")).alias("reason_end"),
        (F.col("l_discount") > 0.05).alias("shuffle"),
        F.when(F.col("l_returnflag") == "N", F.lit(None).cast("boolean"))
         .otherwise(F.col("l_returnflag") == "R").alias("skipped"),
        *keep,
    )


def listener_plays(spark: SparkSession, base: str) -> DataFrame:
    """The plays with a listener: the user of the ``events`` row that the order's key
    falls on (keys modulo the number of events).  The orders meet their listeners before
    they meet their line items, which are more."""
    o = read_table(spark, base, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    return _plays(spark, base, _with_listener(spark, base, o), ["user_id"])


def _with_listener(spark: SparkSession, base: str, o: DataFrame) -> DataFrame:
    events = read_table(spark, base, "events").select("event_id", "user_id")
    n = F.lit(max(events.count(), 1))
    return o.join(events, F.pmod("o_orderkey", n) == F.col("event_id")).drop("event_id")


# ranked lists --------------------------------------------------------------
# artist lists: every customer with orders since a start date, ranked by
# order spend (ties by key), cut into pages of PAGE_SIZE items; the list
# grows with the tables.
LIST_STARTS = {"long_term": "0001-01-01", "medium_term": "2001-02-01",
               "short_term": "2001-07-01"}


def supplier_name(suppkey) -> F.Column:
    return F.concat(F.lit("Supplier#"), F.lpad(suppkey.cast("string"), 9, "0"))


def _paginate(ranked: DataFrame, item, scope=(), of=()) -> DataFrame:
    """Pages of ``item``, a column; or, with columns ``of``, a function of a row of them: these
    narrow rows are grouped into pages, and the items are made afterwards."""
    k = [*scope, "list"]
    row = F.struct("pos", *of) if of else F.struct(F.col("pos"), item.alias("it"))
    pages = (ranked.withColumn("page_no", ((F.col("pos") - 1) / PAGE_SIZE).cast("int") + 1)
             .groupBy(*k, "page_no")
             .agg(F.sort_array(F.collect_list(row)).alias("_items")))
    # the last page number per list comes from the positions (combined map-side, one row per
    # list) and is broadcast under a checked size: shuffled by list, the pages of a list
    # would meet in one task
    last_page = ranked.groupBy(*k).agg((((F.max("pos") - 1) / PAGE_SIZE).cast("int") + 1).alias("_last"))
    pages = pages.join(broadcast_if_small(last_page), k)
    last = F.col("_last")
    return pages.select(
        *k, "page_no",
        F.when(F.col("page_no") < last,
               F.format_string("https://api.example/%s?offset=%d", F.col("list"),
                               F.col("page_no") * PAGE_SIZE)).alias("next"),
        F.transform("_items", item if of else lambda x: x["it"]).alias("items"))


def artist_pages(spark: SparkSession, base: str) -> DataFrame:
    return _artist_pages(read_table(spark, base, "orders").select("o_custkey", "o_totalprice", "o_orderdate"))


def _artist_pages(o: DataFrame, scope=()) -> DataFrame:
    lists = None
    for name, start in LIST_STARTS.items():
        one = (o.where(F.col("o_orderdate") >= F.lit(start).cast("timestamp_ntz"))
               .withColumn("list", F.lit(name)))
        lists = one if lists is None else lists.unionByName(one)
    spend = (lists.groupBy(*scope, "list", "o_custkey")
             .agg(F.round(F.sum("o_totalprice"), 2).alias("spend")))
    ranked = row_number_by_range(spend, [F.col("spend").desc(), F.col("o_custkey").asc()],
                                 [*scope, "list"], out="pos")
    return _paginate(ranked, lambda x: F.struct(artist_name(x["o_custkey"]).alias("name")), scope, ["o_custkey"])


def track_pages(spark: SparkSession, base: str) -> DataFrame:
    return _track_pages(spark, base, read_table(spark, base, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate"))


def _track_pages(spark: SparkSession, base: str, o: DataFrame, scope=()) -> DataFrame:
    o = o.where(F.col("o_orderdate") >= F.lit(LIST_STARTS["long_term"]).cast("timestamp_ntz"))
    l = read_table(spark, base, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey",
                                                   "l_quantity")
    # the list name is written as data, not a literal: a literal key would
    # be constant-folded into a keyless join downstream
    lst = F.when(F.col("o_orderdate") >= F.lit(LIST_STARTS["long_term"]).cast("timestamp_ntz"),
                 F.lit("long_term"))
    pairs = (l.join(o, l.l_orderkey == o.o_orderkey)
             .groupBy(*scope, lst.alias("list"), "o_custkey", "l_partkey")
             .agg(F.sum("l_quantity").alias("qty"), F.min("l_suppkey").alias("supp")))
    ranked = row_number_by_range(pairs, [F.col("qty").desc(), F.col("o_custkey").asc(),
                                         F.col("l_partkey").asc()], [*scope, "list"], out="pos")
    p = read_table(spark, base, "part").select("p_partkey", "p_name")
    ranked = ranked.join(p, ranked.l_partkey == p.p_partkey)
    return _paginate(ranked, lambda x: F.struct(
        x["p_name"].alias("name"),
        F.array(F.struct(artist_name(x["o_custkey"]).alias("name")),
                F.struct(supplier_name(x["supp"]).alias("name"))).alias("artists")),
        scope, ["p_name", "o_custkey", "supp"])


def listener_pages(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Pages of artists and of tracks with a listener: the same lists over each listener's own
    orders, an order's listener being that of ``listener_plays``."""
    o = _with_listener(spark, base, read_table(spark, base, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))
    return _artist_pages(o, ["user_id"]), _track_pages(spark, base, o.drop("o_totalprice"), ["user_id"])


# event-search responses ------------------------------------------------------
# One event per order, headlined by the order's customer; events
# are grouped into response pages of the same customer and order-key block
# of 20 (so a page never holds more than 20 events).  Customers whose key
# is 7 mod 50 get status 500; every ninth page block comes back 200 without
# an ``_embedded`` block; every seventh is cut off, and customers whose key is
# 11 mod 50 come without a status.

def _event_key() -> F.Column:
    """What an event is made from, in the order of its own columns that tell events of
    one key apart: these narrow rows are grouped into pages, not the events."""
    return F.struct(
        "o_orderkey",
        F.date_format(F.add_months(F.col("o_orderdate"), 312), "yyyy-MM-dd").alias("date"),
        "n_name",
        F.when(F.col("o_orderpriority") == "3-MEDIUM", F.lit("Sports")).otherwise(F.lit("Music")).alias("kind"))


def _event_struct(of: F.Column) -> F.Column:
    k = of["o_orderkey"]
    url = F.concat(F.lit("https://tickets.example/event/"), k.cast("string"))
    suffix = (F.when(k % 4 == 0, F.lit(" Live"))
              .when(k % 4 == 1, F.lit(" World Tour"))
              .when(k % 4 == 2, F.concat(F.lit(" with "), supplier_name(k % 100)))
              .otherwise(F.lit("")))
    image = lambda tag, w: F.struct(F.concat(url, F.lit(tag)).alias("url"), w.alias("width"))
    return F.struct(
        k.cast("string").alias("id"),
        F.concat(artist_name(F.col("o_custkey")), suffix).alias("name"),
        url.alias("url"),
        F.array(image("/a.jpg", F.lit(640)),
                image("/b.jpg", F.when(k % 2 == 0, F.lit(1024)).otherwise(F.lit(305))),
                image("/c.jpg", F.lit(1024))).alias("images"),
        F.struct(F.struct(of["date"].alias("localDate")).alias("start")).alias("dates"),
        F.struct(F.array(F.struct(
            F.concat(F.lit("Hall "), (k % 97).cast("string")).alias("name"),
            F.struct(of["n_name"].alias("name")).alias("city"),
            F.when(k % 10 == 0, F.lit(None).cast("struct<line1:string>"))
             .otherwise(F.struct(F.concat(k.cast("string"), F.lit(" Main St")).alias("line1")))
             .alias("address"))).alias("venues")).alias("_embedded"),
        (F.lit(42.3331) + ((k % 7) - 3) * 0.8).alias("latitude"),
        (F.lit(-83.0511) + ((k % 5) - 2) * 1.5).alias("longitude"),
        of["kind"].alias("classification"),
        F.when(k % 11 == 0, F.lit("CA")).otherwise(F.lit("US")).alias("country"),
        F.when(k % 13 == 0, F.lit("resale")).otherwise(F.lit("ticketmaster")).alias("source"),
    )


def event_responses(spark: SparkSession, base: str) -> DataFrame:
    o = (read_table(spark, base, "orders")
         .select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"))
    c = read_table(spark, base, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, base, "nation").select("n_nationkey", "n_name")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    pages = (j.withColumn("page", F.expr("o_orderkey div 20"))
             .groupBy("o_custkey", "page")
             .agg(F.sort_array(F.collect_list(_event_key())).alias("_evs")))
    status = (F.when(F.col("o_custkey") % 50 == 7, F.lit(500))
              .when(F.col("o_custkey") % 50 == 11, F.lit(None).cast("int")).otherwise(F.lit(200)))
    body = (F.when(status == 500, F.lit('{"errors": [{"code": "500"}]}'))
            .when(F.col("page") % 9 == 4, F.lit("{}"))
            .when(F.col("page") % 7 == 3, F.lit('{"_embedded": {"events": [{"id":'))
            .otherwise(F.to_json(F.struct(F.struct(
                F.transform("_evs", _event_struct).alias("events")).alias("_embedded")))))
    return pages.select(artist_name(F.col("o_custkey")).alias("query"),
                        status.cast("int").alias("status"), body.alias("body"))


# chart pages ----------------------------------------------------------------
# One page per nation and block of 200 customer keys: its customers by key as list items,
# some with a partner after ``&amp;`` or ``featuring``, with entities and no-break spaces
# around.  So the pages, and the names that they seed, grow with the customers.
CHART_BLOCK = 200


def chart_pages(spark: SparkSession, base: str) -> DataFrame:
    c = read_table(spark, base, "customer").select("c_custkey", "c_nationkey")
    k = F.col("c_custkey")
    name = (F.when(k % 4 == 0, F.concat(artist_name(k), F.lit(" &amp; "), supplier_name(k)))
            .when(k % 4 == 1, F.concat(F.lit("&nbsp;"), artist_name(k), F.lit("&#160;")))
            .when(k % 4 == 2, F.concat(artist_name(k), F.lit(" Featuring Beyonc&eacute;")))
            .otherwise(F.concat(F.lit("Caf&eacute; &#x4e2d; "), k.cast("string"))))
    item = F.concat(F.lit('<li><a href="/a">'), name, F.lit("</a></li>"))
    page = F.expr(f"c_custkey div {CHART_BLOCK}") * 25 + F.col("c_nationkey")
    return (c.groupBy(page.cast("long").alias("page_id"))
            .agg(F.sort_array(F.collect_list(F.struct(k, item.alias("it")))).alias("_items"))
            .select("page_id", F.concat(F.lit("<ul>"), F.array_join(
                F.transform("_items", lambda x: x["it"]), ""), F.lit("</ul>")).alias("html")))


#: What the pages' tags become, so that lists, items and articles carry classes.
CLASSED_TAGS = {"<nav>": '<nav class="menu top">', "<li>": "<li class=entry>",
                "<article>": "<article data-x=\"class='ad'\" class='story\ttop'>", "<br>": '<br class="entry">',
                "<b>": '<b class="entrys Top">'}


def classed_pages(spark: SparkSession, base: str) -> DataFrame:
    """The pages with classes on some of their tags."""
    html = F.col("html")
    for tag, own in CLASSED_TAGS.items():
        html = F.replace(html, F.lit(tag), F.lit(own))
    return read_table(spark, base, "pages").select("page_id", html.alias("html"))
