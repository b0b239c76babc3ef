"""Canonical telephone numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_WIDTH, ASCII = "０１２３４５６７８９＋（）－．", "0123456789+()-."


def canonical_number(address: Column) -> Column:
    """One form for all notations of a number (national, +cc, 00cc; cc 82, 44 or 1); other senders stay as written.

    null stays null. A value counts as a number if it holds digits and otherwise only blanks and the
    signs + ( ) . - / and dashes.
    """
    plain = F.translate(address, FULL_WIDTH + "–—‑ ", ASCII + "--- ")
    is_number = plain.rlike(r"^[\s+().\-/]*[0-9][0-9\s+().\-/]*$")
    bare = F.regexp_replace(F.regexp_replace(plain, r"\(0\)", ""), r"[^0-9+]", "")
    rest = F.regexp_extract(bare, r"^(?:\+|00)(\d+)$", 1)
    national = (
        F.when(rest.startswith("82"), F.concat(F.lit("0"), F.substring(rest, 3, 40)))
        .when(rest.startswith("44"), F.concat(F.lit("0"), F.substring(rest, 3, 40)))
        .when(rest.startswith("1"), F.substring(rest, 2, 40))
        .when(rest != "", F.concat(F.lit("+"), rest))
        .when(bare.rlike(r"^1[2-9]\d{9}$"), F.substring(bare, 2, 40))
        .otherwise(F.replace(bare, F.lit("+"), F.lit("")))
    )
    return F.when(is_number, national).otherwise(address)
