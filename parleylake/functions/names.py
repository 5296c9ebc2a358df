"""Column expressions over names and loosely written strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The full-width forms U+FF01..U+FF5E lie 0xFEE0 above ASCII 0x21..0x7E.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
#: White space of any script, control and format characters.
BLANKS = r"[\s\p{Z}\p{Cc}\p{Cf}]+"


def fold_width(c: Column) -> Column:
    """Full-width ASCII forms as plain ASCII."""
    return F.translate(c, _WIDE, _NARROW)


def without_blanks(c: Column) -> Column:
    """The string without white space, control and format characters."""
    return F.regexp_replace(c, BLANKS, "")


def name_key(c: Column) -> Column:
    """Key under which names agree apart from case, width, white space and control characters."""
    return F.lower(without_blanks(fold_width(c)))


def is_blank(c: Column) -> Column:
    """Whether nothing but white space and control characters is left; null counts as blank."""
    return F.coalesce(F.length(without_blanks(c)) == 0, F.lit(True))


def path_key(c: Column) -> Column:
    """Key under which paths agree as on Windows: letter case, ``\\`` and ``/``, repeated separators and ``.`` steps aside."""
    p = F.lower(F.regexp_replace(F.trim(c), r"[\\/]+", "/"))
    return F.regexp_replace(F.regexp_replace(p, r"(^|/)(\./)+", "$1"), r"/$", "")


def whole_number(c: Column) -> Column:
    """A decimal or 0x text as DECIMAL(38,0), null if it is not a whole non-negative number that fits."""
    t = without_blanks(c)
    dec = F.when(t.rlike(r"^\+?[0-9]+$"), t.try_cast("decimal(38,0)"))
    hexa = F.when(t.rlike(r"^0[xX]0*[0-9a-fA-F]{1,16}$"), F.conv(F.regexp_replace(t, r"^0[xX]", ""), 16, 10).try_cast("decimal(38,0)"))
    return F.coalesce(dec, hexa)
