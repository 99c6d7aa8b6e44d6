"""Chart-page seeding (SRC8, SCL13, SCL15, SET2, TOP6, PIPE7).

Per page: element texts by a fixed pattern in document order, the first
``scan`` of them, each cut at the first ``&``/``with``/``featuring`` and
stripped, de-duplicated keeping first occurrences, the first ``keep``
names.  Every step is per page and bounded by the page's item count.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from encore.constants import (CHART_ITEM_PATTERN, CHART_ITEMS_SCANNED, CHART_NAMES_KEPT,
                              CHART_SPLIT_PATTERN, HTML_CLASS, HTML_TAG_NAME, HTML_TOKEN, HTML_VOID)
from encore.functions.columns import html_unescape, split_first, strip_ws
from encore.operators.ranking import ordered_distinct, top_k_per_group


def class_pattern(name: str) -> str:
    """SRC8: pattern (group 1) of the text of ``<li>`` elements, or of links in them,
    whose ``class`` attribute holds the given class."""
    own = rf"class\s*=\s*[\"'](?:[^\"']*\s)?{re.escape(name)}(?:\s[^\"']*)?[\"']"
    return rf"(?s)<li(?:\s[^>]*{own}[^>]*>|[^>]*>\s*<a\s[^>]*{own}[^>]*>)(.*?)</li>"


def element_texts(pages: DataFrame, pattern: str = CHART_ITEM_PATTERN, key: str = "page_id",
                  html_col: str = "html") -> DataFrame:
    """SRC8 + SCL15: (key, position, text) for every element matched by
    ``pattern`` (group 1), inner tags removed, entities decoded, stripped."""
    ex = pages.select(key, F.posexplode(F.regexp_extract_all(html_col, F.lit(pattern), 1))
                      .alias("_pos", "_raw"))
    text = strip_ws(html_unescape(F.regexp_replace("_raw", r"<[^>]+>", "")))
    return ex.select(key, (F.col("_pos") + 1).cast("long").alias("position"), text.alias("text"))


def elements_by_class(pages: DataFrame, classes, key: str = "page_id", html_col: str = "html") -> DataFrame:
    """SRC8 + SCL15: (key, class, position, text) for every element, whatever its tag, whose
    ``class`` attribute holds one of ``classes``; positions count a page's elements of a class
    in document order, nested ones too.

    A page's tokens (tags, runs of text) are folded with the stack of open elements: an end tag
    closes the last open element of its name and all opened after it, one without such an
    element is passed over, and the page's end closes the rest.  The text is that of all
    tokens inside, without comments, scripts and styles, entities decoded, stripped.  An
    element of several of the classes is an item of each; a null page has none.  All in one
    projection: pages are not shuffled, and only open elements and matches are carried along."""
    wanted = F.array(*[F.lit(c) for c in dict.fromkeys(classes)]).cast("array<string>")

    def tag(t, i):
        name = F.lower(F.regexp_extract(t, HTML_TAG_NAME, 1))
        kind = (F.when(t.startswith("</"), "close")
                .when(name.isin(HTML_VOID) | t.endswith("/>"), "void").otherwise("open"))
        own = F.concat(*[F.regexp_extract(t, HTML_CLASS, g) for g in (1, 2, 3)])
        hit = F.array_intersect(F.split(own, r"\s+"), wanted)
        return F.struct(i.alias("at"), name.alias("name"), kind.alias("kind"), hit.alias("hit"))

    def ended(opened, stop):
        return F.transform(F.filter(opened, lambda x: F.size(x["hit"]) > 0), lambda x: F.struct(
            x["at"].alias("at"), stop.alias("stop"), x["hit"].alias("hit")))

    def step(state, t):
        stack, done, kind = state["stack"], state["done"], t["kind"]
        own = F.array(F.struct(t["at"], t["name"], t["hit"]))
        back = F.array_position(F.reverse(F.transform(stack, lambda x: x["name"])), t["name"]).cast("int")
        left = F.size(stack) - back  # elements that stay open
        return (F.when(kind == "open", F.struct(F.concat(stack, own).alias("stack"), done.alias("done")))
                .when(kind == "void", F.struct(stack.alias("stack"),
                                               F.concat(done, ended(own, t["at"])).alias("done")))
                .when(back > 0, F.struct(
                    F.slice(stack, F.lit(1), left).alias("stack"),
                    F.concat(done, ended(F.slice(stack, left + 1, back), t["at"])).alias("done")))
                .otherwise(F.struct(stack.alias("stack"), done.alias("done"))))

    start = F.struct(F.array().cast("array<struct<at:int,name:string,hit:array<string>>>").alias("stack"),
                     F.array().cast("array<struct<at:int,stop:int,hit:array<string>>>").alias("done"))
    tags = F.filter(F.transform("_tokens", tag), lambda t: t["name"] != "")
    found = F.aggregate(tags, start, step, lambda s: F.array_sort(
        F.concat(s["done"], ended(s["stack"], F.size("_tokens")))))

    def text(x):
        inside = F.slice("_tokens", x["at"] + 2, F.greatest(x["stop"] - x["at"] - 1, F.lit(0)))
        return F.array_join(F.filter(inside, lambda t: ~t.startswith("<") | (t == "<")), "")

    def per_class(c):
        own = F.filter("_found", lambda x: F.array_contains(x["hit"], c))
        return F.struct(c.alias("class"), F.transform(own, text).alias("texts"))

    out = (pages.select(key, F.regexp_extract_all(html_col, F.lit(HTML_TOKEN), 0).alias("_tokens"))
           .select(key, "_tokens", found.alias("_found"))
           .select(key, F.explode(F.transform(wanted, per_class)).alias("_c"))
           .select(key, "_c.class", F.posexplode("_c.texts").alias("_pos", "_raw")))
    return out.select(key, "class", (F.col("_pos") + 1).cast("long").alias("position"),
                      strip_ws(html_unescape("_raw")).alias("text"))


def primary_name(text) -> F.Column:
    """SCL13 + SCL15: the part before the first ``&``/``with``/``featuring``, stripped."""
    return strip_ws(split_first(text, CHART_SPLIT_PATTERN))


def chart_seed(pages: DataFrame, pattern: str = CHART_ITEM_PATTERN, key: str = "page_id",
               scan: int = CHART_ITEMS_SCANNED, keep: int = CHART_NAMES_KEPT) -> DataFrame:
    """PIPE7: (key, chart_position, artist_name), at most ``keep`` per page."""
    items = element_texts(pages, pattern, key).where(F.col("position") <= scan)   # TOP6
    names = items.select(key, "position", primary_name("text").alias("artist_name"))
    first = ordered_distinct(names, "artist_name", "position", [key])            # SET2
    return (top_k_per_group(first, [key], [F.col("position").asc()], keep,       # TOP6
                            out="chart_position")
            .select(key, "chart_position", "artist_name"))
