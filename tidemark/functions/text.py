"""Keys and times out of loosely written text, as JVM-side column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of apostrophe, hyphen and blank that count as the plain one.
APOSTROPHES = "‘’‛ʼʹ′＇`´"
HYPHENS = "‐‑‒–—―−﹣－"
BLANKS = r"[\s\u0085   -‍    　﻿]+"


def _accent_table() -> tuple[str, str]:
    """Lower-case Latin letters with marks and their plain letters, by Unicode decomposition."""
    src, dst = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(cp)
        base = unicodedata.normalize("NFD", ch)[0]
        if ch.islower() and base != ch and base.isascii():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


_MARKED, _PLAIN = _accent_table()


def strip_accents(col: Column) -> Column:
    """Lower-case text without accents, composed or combining."""
    return F.regexp_replace(F.translate(col, _MARKED, _PLAIN), r"\p{M}+", "")


def name_key(col: Column) -> Column:
    """Lower case, no accents, plain ' and -, single spaces, none outside. Null stays null, blank becomes ''."""
    low = F.lower(col)
    plain = F.translate(strip_accents(low), APOSTROPHES + HYPHENS, "'" * len(APOSTROPHES) + "-" * len(HYPHENS))
    folded = F.trim(F.regexp_replace(plain, BLANKS, " "))
    return F.when(low.rlike(r"[^!-_a-~ ]|  "), folded).otherwise(F.trim(low))  # most names need no folding


def label_key(col: Column) -> Column:
    """Lower case without outer blanks."""
    return F.regexp_replace(F.lower(col), f"^{BLANKS}|{BLANKS}$", "")


_TIME = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"


def time_text(col: Column) -> Column:
    """Timestamp of time text: a bare date is the start of that day, no offset means UTC, anything else is null.

    The offset is made explicit first, so the session's time zone has no part in the result.
    """
    t = F.trim(col)
    full = (
        F.when(F.length(t) == 10, F.concat(t, F.lit(" 00:00:00+00:00")))
        .when(t.rlike(r"(Z|[+-]\d{2}:\d{2})$"), t)
        .otherwise(F.concat(t, F.lit("+00:00")))
    )
    return F.when(t.rlike(_TIME), full.try_cast("timestamp"))
