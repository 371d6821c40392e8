"""Column functions for the texts and boxes of figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Advances of a character, box widths by kind, and the heights of a box's rows in pixels.
MONO_ADVANCE, SANS_ADVANCE = 0.6, 0.58
WIDTHS = {"folder": 220, "unresolved": 190}
FILE_WIDTH = 230
KICKER, NAME, SECOND, MARKER, FRAME = 20.5, 21.0, 18.5, 20.5, 26.0
MARKED = ("heuristic", "unknown")


def truncate_end(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(max(0, most - 1))), F.lit("…")))


def truncate_middle(text: Column, most: int) -> Column:
    """At most ``most`` characters, with an ellipsis in place of what lies in the middle; the beginning gets the odd one."""
    if most <= 1:
        return F.when(F.length(text) <= most, text).otherwise("…")
    head = -(-(most - 1) // 2)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit("…"), F.right(text, F.lit(most - 1 - head))))


def format_count(n: Column) -> Column:
    """Thousands with one decimal, if it isn't zero, and a k.

    The quotient is a double and rounded by its exact value, ties up: of 1150 and 1050 one goes down and one up. The
    double times a power of two is a whole number, so a half is decided without error.
    """
    n = n.cast("long")
    bits = F.when(n < 1_024_000, F.lit(1 << 52)).otherwise(F.lit(1 << 42))
    whole = (n / F.lit(1000.0) * bits.cast("double")).cast("long").cast("decimal(38,0)") * F.lit(1000).cast("decimal(4,0)")
    above = whole >= n.cast("decimal(19,0)") * bits.cast("decimal(19,0)")
    tenths = F.floor((n + F.when((n % 100 == 50) & ~above, 49).otherwise(50)) / 100).cast("long")
    rest = F.when(tenths % 10 == 0, "").otherwise(F.concat(F.lit("."), (tenths % 10).cast("string")))
    return F.when(n < 1000, n.cast("string")).otherwise(F.concat(F.floor(tenths / 10).cast("string"), rest, F.lit("k")))


def mono_width(text: Column, size: float) -> Column:
    return F.length(text) * (size * MONO_ADVANCE)


def box_width(kind: Column) -> Column:
    out = F.lit(FILE_WIDTH)
    for name, width in WIDTHS.items():
        out = F.when(kind == name, width).otherwise(out)
    return out


def box_height(kind: Column, confidence: Column, partly_read: Column) -> Column:
    """Of a file, folder or unresolved import: kicker and name; a second line but for unresolved ones; a folder's line on files
    that were partly read; a marker for what isn't fully known."""
    second = F.when(kind.isin("file", "folder"), SECOND).otherwise(0.0)
    partial = F.when((kind == "folder") & F.coalesce(partly_read, F.lit(False)), SECOND).otherwise(0.0)
    marker = F.when(confidence.isin(*MARKED), MARKER).otherwise(0.0)
    return F.lit(KICKER + NAME + FRAME) + second + partial + marker
