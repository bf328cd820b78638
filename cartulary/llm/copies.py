"""Groups of exact copies: one representative each, and pairs between representatives spread to the members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.session import materialize, skew_safe_join

#: Classes of up to this many copies are spread into pairs of all members. Larger ones appear through their
#: representative: it is paired with each of its copies and with what any of them is alike to; the classes
#: (``p1_groups``, ``p9_copies``) say the rest, so no link is lost and no class gives a number of pairs that is quadratic in its size.
SPREAD = 100


def members(keyed: DataFrame, written: bool = False) -> DataFrame:
    """Of (key, digest): (key, digest, rep, copies) for keys whose digest has more than one key; ``rep`` is the smallest.

    Keys and digests are written first, so the texts are read once for them; ``written``: they are a table of distinct
    rows. The counts are combined before the exchange, and digests that hold much of all rows are joined by broadcast.
    """
    keyed = keyed if written else materialize(keyed.distinct())
    classes = materialize(
        keyed.groupBy("digest").agg(F.min("key").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
    )
    return materialize(skew_safe_join(keyed, classes, "digest", "copies", keyed.count()).select("key", "digest", "rep", "copies"))


def spread(pairs: DataFrame, copies: DataFrame, most: int | None = SPREAD) -> DataFrame:
    """Pairs of representatives (a, b) as distinct pairs (a, b) of members, a < b, with the pairs within classes; all of
    them with ``most`` None, else as said at ``SPREAD``."""
    small = copies if most is None else copies.filter(F.col("copies") <= most)
    out = pairs.select("a", "b")
    for side in ("a", "b"):
        own = small.select(F.col("rep").alias(side), F.col("key").alias("member"))
        other = "b" if side == "a" else "a"
        out = out.join(own, side, "left").select(F.coalesce("member", side).alias(side), other)
    x, y = (small.select(F.col("key").alias(k), "rep") for k in "ab")
    within = x.join(y, "rep").filter("a < b").select("a", "b")
    both = out.unionByName(within)
    if most is not None:
        stars = copies.filter((F.col("copies") > most) & (F.col("key") != F.col("rep")))
        both = both.unionByName(stars.select(F.col("rep").alias("a"), F.col("key").alias("b")))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
