"""Blank handling, match keys and other text basics."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE_SPACE = r"^[ \t\r\n]+|[ \t\r\n]+$"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def trimmed(x) -> Column:
    """Trim blanks, tabs and line breaks (``trim`` alone takes only blanks)."""
    return F.regexp_replace(_c(x), _EDGE_SPACE, "")


def squeezed(x) -> Column:
    """Trim, and turn every run of white space into one blank."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def is_filled(x) -> Column:
    """True when not null and not only white space; never null."""
    return F.coalesce(_c(x).rlike(r"[^ \t\r\n]"), F.lit(False))


def filled_or(x, fallback) -> Column:
    """``x`` unless it is blank, else ``fallback``."""
    x = _c(x)
    return F.when(x.rlike(r"[^ \t\r\n]"), x).otherwise(_c(fallback))


def null_if_blank(x) -> Column:
    x = _c(x)
    return F.when(is_filled(x), x)


def _plain_letters() -> tuple[str, str]:
    """Accented lower-case letters and the plain letter of each one.

    Built from the Unicode decomposition; marks that stand alone have no
    counterpart in the second string, so ``translate`` deletes them.
    """
    source, target = [], []
    for code in range(0xA0, 0x250):
        char = chr(code)
        base = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if char == char.lower() and len(base) == 1 and base.isascii() and base.isalnum():
            source.append(char)
            target.append(base.lower())
    # Letters without a decomposition, and the hybrid sign.
    for char, base in (("ø", "o"), ("đ", "d"), ("ð", "d"), ("ł", "l"), ("ı", "i"), ("×", "x")):
        source.append(char)
        target.append(base)
    marks = [chr(code) for code in range(0x300, 0x370)]
    return "".join(source + marks), "".join(target)


_ACCENTED, _PLAIN = _plain_letters()


def match_key(x) -> Column:
    """Lower case, no accents, every other character run one blank."""
    s = F.lower(_c(x))
    for long, short in (("æ", "ae"), ("œ", "oe"), ("ß", "ss"), ("þ", "th")):
        s = F.replace(s, F.lit(long), F.lit(short))
    s = F.translate(s, _ACCENTED, _PLAIN)
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def area_key(x) -> Column:
    """Areas and localities meet on the match key."""
    return match_key(x)


def area_slug(x) -> Column:
    key = area_key(x)
    return F.when(is_filled(key), F.replace(key, F.lit(" "), F.lit("_"))).otherwise("area")


def token_count(x) -> Column:
    """Number of white-space separated tokens; zero for an empty text."""
    s = trimmed(x)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"\s+")))


def list_tokens(x) -> Column:
    """Tokens of a ``;``/``,`` list: trimmed, known and distinct.

    A null list gives an empty array.
    """
    pieces = F.transform(F.split(_c(x), "[;,]"), lambda t: trimmed(t))
    known = F.filter(pieces, lambda t: (t != "") & ~F.lower(t).isin("unknown", "na"))
    return F.coalesce(F.array_distinct(known), F.array().cast("array<string>"))
