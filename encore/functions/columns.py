"""Scalar column expressions (all JVM-side built-ins, codegen friendly)."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from encore.constants import DIGEST_DATE_FORMAT, MONTH_FORMAT, WHITE_SPACE


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_key(ts) -> Column:
    """SCL1: ``YYYY-MM`` text of a timestamp."""
    return F.date_format(col_(ts), MONTH_FORMAT)


def day_gap(earlier, later) -> Column:
    """SCL2: number of day boundaries between two timestamps (not 24h periods)."""
    return F.datediff(F.to_date(col_(later)), F.to_date(col_(earlier)))


def flag(pred: Column) -> Column:
    """SCL3 / FLT4 / FLT5: a three-valued predicate as 0/1/NULL."""
    return pred.cast("int")


def ratio(num, den) -> Column:
    """SCL4: true division, NULL (not an error) on a zero divisor."""
    return F.try_divide(col_(num).cast("double"), col_(den).cast("double"))


def strip_ws(c) -> Column:
    """SCL15: remove all leading/trailing Unicode whitespace, no-break spaces
    included (``trim`` only strips spaces)."""
    return F.regexp_replace(col_(c), rf"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def split_first(c, pattern: str) -> Column:
    """SCL13: first piece of a regex split (no word boundaries)."""
    return F.split(col_(c), pattern, 2).getItem(0)


def long_date(d) -> Column:
    """SCL16: ``June 07, 2026`` style date text."""
    return F.date_format(col_(d), DIGEST_DATE_FORMAT)


def html_escape(c) -> Column:
    """SCL18 helper: escape ``& < > "`` for HTML text and attributes."""
    x = col_(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def named_entities() -> dict[str, str]:
    """Entity name (without ``;``) -> text, from the standard library's HTML table."""
    return {k[:-1]: v for k, v in html5.items() if k.endswith(";")}


def html_unescape(c) -> Column:
    """Decode the named and numeric character references of element text, each once
    (``&amp;lt;`` gives ``&lt;``); unknown ones stay as they are."""
    names = F.from_json(F.lit(json.dumps(named_entities())), "map<string,string>")

    def decoded(piece):
        ref = F.regexp_extract(piece, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);", 1)
        code = (F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 6), 16, 10))
                .when(ref.startswith("#"), F.substring(ref, 2, 7)).cast("int"))
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        text = F.when(ref.startswith("#"), char).when(ref != "", F.try_element_at(names, ref))
        return F.coalesce(F.concat(text, piece.substr(F.length(ref) + 2, F.length(piece))), F.concat(F.lit("&"), piece))

    x = col_(c)
    pieces = F.split(x, "&")
    rest = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), decoded)
    return F.when(x.contains("&"), F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))).otherwise(x)
