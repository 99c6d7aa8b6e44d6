"""Digest HTML as column expressions (SCL16, SCL18, WIN7).

The card layout is a fixed text with ``{field}`` slots; it is compiled
once into a ``concat`` of literals and (escaped) columns, and the same
pieces give the SQL twin, so both engines render identical text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from encore.constants import (DIGEST_CARD, DIGEST_CARD_END, DIGEST_DIVIDER, DIGEST_HEAD,
                              DIGEST_TAIL)
from encore.functions.columns import html_escape

_SLOT = re.compile(r"\{(\w+)\}")


def template_pieces(text: str) -> list[tuple[str, str]]:
    """Split a slotted text into ('lit', text) / ('col', name) pieces."""
    out, pos = [], 0
    for m in _SLOT.finditer(text):
        if m.start() > pos:
            out.append(("lit", text[pos:m.start()]))
        out.append(("col", m.group(1)))
        pos = m.end()
    if pos < len(text):
        out.append(("lit", text[pos:]))
    return out


def render(text: str, escape: bool = True) -> Column:
    """Fill the slots of ``text`` from same-named columns (NULL renders empty)."""
    parts = []
    for kind, val in template_pieces(text):
        if kind == "lit":
            parts.append(F.lit(val))
        else:
            c = F.coalesce(F.col(val).cast("string"), F.lit(""))
            parts.append(html_escape(c) if escape else c)
    return F.concat(*parts)


def card(escape: bool = True) -> Column:
    """SCL18: one event card (image, date, name, venue - city, address, link)."""
    return render(DIGEST_CARD, escape)


CARD_JOINER = DIGEST_CARD_END + DIGEST_DIVIDER


def document(cards: Column, date_text: Column) -> Column:
    """WIN7 + layout: head (with the date), the cards separated by the divider
    (never after the last card), tail."""
    body = F.when(F.size(cards) > 0,
                  F.concat(F.array_join(cards, CARD_JOINER), F.lit(DIGEST_CARD_END))
                  ).otherwise(F.lit(""))
    head_pieces = DIGEST_HEAD.split("{date}")
    return F.concat(F.lit(head_pieces[0]), date_text, F.lit(head_pieces[1]), body,
                    F.lit(DIGEST_TAIL))


def sql_render(text: str, escape: bool = True) -> str:
    """SQL twin of :func:`render` (DuckDB string syntax)."""
    def lit(s):
        return "'" + s.replace("'", "''") + "'"

    parts = []
    for kind, val in template_pieces(text):
        if kind == "lit":
            parts.append(lit(val))
        else:
            c = f"COALESCE(CAST({val} AS VARCHAR), '')"
            if escape:
                for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
                    c = f"replace({c}, {lit(a)}, {lit(b)})"
            parts.append(c)
    return " || ".join(parts)


def sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"
