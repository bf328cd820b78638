"""Items that appear together: counts of ordered pairs per basket, lift and pointwise mutual information."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from cartulary.session import materialize, skew_safe_join, small_or_not

#: Items that a block of a basket holds about; larger baskets are paired block by block.
BLOCK = 256


@pandas_udf(StringType())
def _composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(x: str | None) -> str | None:
        return None if x is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).strip().lower())

    for s in batches:
        yield s.map(one)


def plain_form(c: Column) -> Column:
    """Form NFC, without outer spaces, in lower case; null for blank."""
    return F.nullif(_composed(c), F.lit(""))


def cooccurrence(
    df: DataFrame, basket: str = "path", item: str = "tag", least: int = 1, form: bool = True, block: int = BLOCK
) -> DataFrame:
    """Pairs of different items that stand in at least ``least`` baskets together, with how much more than by chance.

    Columns: a, b (a < b), both, n_a, n_b, n (baskets with any item), lift (both * n / (n_a * n_b)), pmi (its binary
    logarithm). Items count once a basket; null baskets, null and blank items don't count. ``form``: items are compared
    in plain form. Items of fewer than ``least`` baskets can't be in a pair and are left out before pairing. Large
    baskets are split by hash into blocks that are paired with one another, so no basket is ever gathered whole; items
    are paired as numbers and counts combined before the exchange. The result is exact. An empty table gives no rows.
    """
    rows = df.select(F.col(basket).alias("basket"), F.col(item).alias("raw")).filter("basket IS NOT NULL AND raw IS NOT NULL")
    if form:  # each different value is brought to its form once
        forms = materialize(rows.groupBy("raw").agg(F.count("*").alias("n")).withColumn("item", plain_form(F.col("raw"))))
        total = forms.agg(F.sum("n")).first()[0] or 0
        forms = forms.filter("item IS NOT NULL")
        one = skew_safe_join(rows, forms, "raw", "n", total)
    else:
        one = rows.withColumn("item", F.nullif(F.trim("raw"), F.lit(""))).filter("item IS NOT NULL")
    one = materialize(one.select("basket", "item").distinct())
    marginal = materialize(one.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= least).withColumn("id", F.monotonically_increasing_id()))
    ids = small_or_not(marginal.select("item", "id"))
    sizes = materialize(one.join(ids, "item", "left").groupBy("basket").agg(F.count("id").alias("m")))
    n, total = sizes.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    # m decides alone, so a small basket is one block and isn't joined with anything
    sized = skew_safe_join(one.join(ids, "item").select("basket", "id"), sizes.filter("m > 1"), "basket", "m", total)
    sized = sized.withColumn("blocks", F.ceil(F.col("m") / F.lit(block)).cast("int"))
    ordered = lambda x, y: F.explode(F.expr(f"flatten(transform({x}, p -> transform(filter({y}, q -> q > p), q -> struct(p AS x, q AS y))))"))
    small = (
        sized.filter("blocks = 1").groupBy("basket").agg(F.collect_list("id").alias("items"))
        .select(ordered("items", "items").alias("t"))
    )
    part = (
        sized.filter("blocks > 1")
        .withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .groupBy("basket", "blocks", "i")
        .agg(F.collect_list("id").alias("items"))
    )
    x = part.select("basket", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.col("items").alias("x"))
    y = part.select("basket", F.col("i").alias("j"), F.col("items").alias("y"))
    # every ordered couple of blocks meets once; keeping x < y gives each pair once
    large = x.join(y, ["basket", "j"]).select(ordered("x", "y").alias("t"))
    pairs = small.unionByName(large).select("t.x", "t.y").groupBy("x", "y").agg(F.count("*").alias("both")).filter(F.col("both") >= least)
    names = small_or_not(marginal)
    for k in "xy":
        pairs = pairs.join(names.select(F.col("id").alias(k), F.col("item").alias(f"item_{k}"), F.col("n").alias(f"n_{k}")), k)
    turned = F.col("item_x") > F.col("item_y")
    own = lambda k, first, second: F.when(turned, F.col(f"{k}_{second}")).otherwise(F.col(f"{k}_{first}"))
    pairs = pairs.select(own("item", "x", "y").alias("a"), own("item", "y", "x").alias("b"), "both", own("n", "x", "y").alias("n_a"), own("n", "y", "x").alias("n_b"))
    lift = F.col("both") * F.lit(float(n)) / (F.col("n_a").cast("double") * F.col("n_b"))
    return pairs.select("a", "b", "both", "n_a", "n_b", F.lit(n).cast("bigint").alias("n"), lift.alias("lift"), F.log2(lift).alias("pmi"))


def beyond_chance(pairs: DataFrame, times: int) -> DataFrame:
    """Pairs at least ``times`` times as often as by chance, by whole numbers: both * n >= times * n_a * n_b."""
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return pairs.filter(wide("both") * wide("n") >= F.lit(times) * wide("n_a") * wide("n_b"))
