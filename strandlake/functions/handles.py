"""Column functions on handles (oriented nodes) and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids from here on would not fit a handle with a sign to spare.
ID_LIMIT = 1 << 62


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pack(node_id, reverse=False) -> Column:
    """The handle of a node; a null or oversized id is an error at run time."""
    rev = F.lit(reverse) if isinstance(reverse, bool) else _col(reverse)
    return F.shiftleft(_col(node_id).cast("bigint"), 1).bitwiseOR(rev.cast("int").cast("bigint"))


def checked_pack(node_id, reverse=False) -> Column:
    node = _col(node_id)
    ok = F.assert_true((node > 0) & (node < ID_LIMIT), F.lit("node id out of range"))
    return F.when(ok.isNull(), pack(node, reverse))


def node_of(handle) -> Column:
    return F.shiftright(_col(handle), 1)


def is_reverse(handle) -> Column:
    return _col(handle).bitwiseAND(F.lit(1)) == 1


def flip(handle) -> Column:
    return _col(handle).bitwiseXOR(F.lit(1).cast("bigint"))


def forward(handle) -> Column:
    return _col(handle).bitwiseAND(F.lit(-2).cast("bigint"))


def canonical(left, right) -> Column:
    """One form of the two that an edge has: (l, r) and (flip r, flip l)."""
    l, r = _col(left), _col(right)
    turned = l > flip(r)
    return F.struct(F.when(turned, flip(r)).otherwise(l).alias("l"), F.when(turned, flip(l)).otherwise(r).alias("r"))


def canonical_edges(pairs: DataFrame, left: str = "l", right: str = "r") -> DataFrame:
    return pairs.select(canonical(left, right).alias("e")).select("e.l", "e.r").distinct()
