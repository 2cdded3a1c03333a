"""Whether a cell of a catalogue states a value, and normal forms of its codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterweave.runtime import number

# The object type codes of the public NGC guide, then those of the other catalogues.
TYPE_CODES = (
    "*", "**", "*Ass", "OCl", "GCl", "Cl+N", "G", "GPair", "GTrpl", "GGroup", "PN", "HII",
    "DrkN", "EmN", "Neb", "RfN", "SNR", "Nova", "NonEx", "Dup", "Other",
    "Gx", "NB", "DN", "LDN", "RCW", "RFN", "GxyP",
)

# Words that only stand for "nothing", lower case.
NOTHING_WORDS = (
    "nan", "none", "null", "nil", "n/a", "na", "n.a.", "unk", "unknown", "undefined", "missing",
    "empty", "void", "tbd", "brak", "nothing", "not available", "no data", "<na>", "(null)", "nat",
)

#: Magnitudes of anything in the sky lie between the Sun's and the faintest detections.
MAG_RANGE = (-30.0, 40.0)
#: An angular size is positive and at most half the sky's circumference, in arcmin.
MAX_SIZE = 10_800.0
# What catalogues customarily write for an unknown size, where it could be one.
SIZE_FILLERS = (999.0, 9999.0)
#: Beyond so many arcmin, a quarter of the sky, such a value needs no repetition to be a filler.
WIDE_SIZE = 5_400.0
#: Positions at which a smaller one must stand.
FILLER_PLACES = 3


def blank_trim(text: Column) -> Column:
    """``text`` without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^[\s\u00a0]+|[\s\u00a0]+$", "")


def is_nothing(text: Column) -> Column:
    """True where a text is null, blank, without any letter, digit or star, or a word for nothing."""
    t = F.lower(blank_trim(text))
    return F.coalesce(~t.rlike(r"[\p{L}\p{N}*]") | t.isin(*NOTHING_WORDS), F.lit(True))


def stated_mag(mag: Column) -> Column:
    """The magnitude, or null where the cell states none.

    Null, NaN, infinite and impossible values are none; so are 99 and repeated
    eights or nines, which lie outside ``MAG_RANGE``.
    """
    x = number(mag)
    return F.when(x.between(*MAG_RANGE), x)


def size_fillers(df: DataFrame, size: str = "size") -> list[float]:
    """The values of ``SIZE_FILLERS`` that only stand for "nothing" in this table.

    A filler stands out by repetition: it is met more often than all other sizes
    within one percent of it together, repeated deliveries (one position)
    counting once. A real size, even of nines, is no more frequent than its
    neighbours. One pass over the table; one row comes back. ``df`` also has
    ``ra`` and ``dec``. An empty table has no fillers.
    """
    x = number(F.col(size))
    at = F.xxhash64("ra", "dec")
    counts = [F.count_distinct(F.when(c, at)) for f in SIZE_FILLERS for c in (x == f, x.between(0.99 * f, 1.01 * f) & (x != f))]
    near = F.greatest(*(F.lit(0.01) - F.abs(x / f - 1) for f in SIZE_FILLERS)) >= 0
    met = df.where(near).select(F.array(*counts)).first()[0]
    return [
        f for f, n, beside in zip(SIZE_FILLERS, met[::2], met[1::2], strict=True)
        if n > beside and (f > WIDE_SIZE or n >= FILLER_PLACES)
    ]


def stated_size(size: Column, fillers: Sequence[float] = ()) -> Column:
    """The size in the unit it was written in, or null where the cell states none.

    Null, NaN, infinite, zero and negative sizes are none, and so are the
    ``fillers`` of the table and anything wider than half the sky. A size in a
    wrong unit is a value.
    """
    x = number(size)
    return F.when((x > 0) & (x <= MAX_SIZE) & ~x.isin(*fillers), x)


def type_code(kind: Column) -> Column:
    """The type's code, upper case without outer white space, or null where none is stated.

    Every code of ``TYPE_CODES`` is a value; another text is one unless it only
    stands for nothing.
    """
    t = F.upper(blank_trim(kind))
    known = t.isin(*{c.upper() for c in TYPE_CODES})
    return F.when(known | ~is_nothing(kind), t)


def catalog_code(catalog: Column) -> Column:
    """A catalogue's name in lower case without white space; null where blank."""
    return F.nullif(F.lower(F.regexp_replace(catalog, r"[\s\u00a0]+", "")), F.lit(""))


def id_code(ident: Column) -> Column:
    """A designation in lower case without white space, or null where it states none."""
    return F.when(~is_nothing(ident), F.lower(F.regexp_replace(ident, r"[\s\u00a0]+", "")))
