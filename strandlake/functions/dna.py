"""Column functions on base strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandlake.functions.handles import _col

_BASES, _PAIRED = "AGCTYRWSKMDVHB", "TCGARYWSMKHBDV"
FROM, TO = _BASES + _BASES.lower(), _PAIRED + _PAIRED.lower()
CODES = "ACGTN"


def complement(seq) -> Column:
    """Complement of every ambiguity code, in its case; other characters stay."""
    return F.translate(_col(seq), FROM, TO)


def reverse_complement(seq) -> Column:
    return complement(F.reverse(_col(seq)))


def oriented(seq, reverse) -> Column:
    return F.when(_col(reverse), reverse_complement(seq)).otherwise(_col(seq))


def plain_bases(seq) -> Column:
    """Upper case, with N for all but A, C, G and T: what a packed store keeps."""
    return F.regexp_replace(F.upper(_col(seq)), "[^ACGT]", "N")


def encode_bases(seq) -> Column:
    """Two bases to a byte, the first in the upper half; an odd end is filled with ones."""
    digits = F.translate(plain_bases(seq), CODES, "01234")
    return F.unhex(F.concat(digits, F.when(F.length(digits) % 2 == 1, "F").otherwise("")))


def decode_bases(packed) -> Column:
    """The bases of :func:`encode_bases`."""
    return F.translate(F.hex(_col(packed)), "01234F", CODES)
