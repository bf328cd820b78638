"""Mixing sources to target shares of a budget in tokens, by counts of documents per exact token length.

Whole passes over a source come first. For the rest of its budget the documents are counted by token length; each
length gives its proportional number of documents, and a bounded-knapsack search over the lengths, adding and giving
back documents around the budget, finds the greatest sum that doesn't exceed it: the budget is met to the token
wherever a subset sum allows. Which documents of a length are taken follows a seeded hash, not their order.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.session import materialize, small_or_not

#: Parts by hash that the documents of one length are counted in, so that a frequent length isn't ranked in one task.
PARTS = 64


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 0) -> np.ndarray:
    """How many documents of each length to take so that their sum is the greatest that doesn't exceed ``budget``.

    First a proportional number of each length, then, in seeded order, one more of each while it fits, until less than
    the greatest length is missing; from there ``balance`` finds an optimal sum.
    """
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    use = (lengths > 0) & (counts > 0)
    total = int((lengths * counts).sum())
    if budget <= 0 or not use.any():
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    part = int(np.gcd.reduce(lengths[use]))
    n, c, goal = lengths[use] // part, counts[use], budget // part
    rng = np.random.default_rng(seed)
    taken = np.minimum(c, np.floor(c * (budget / total)).astype(np.int64))
    left = goal - int((n * taken).sum())
    while left < 0:  # rounding of large numbers
        k = int(np.flatnonzero(taken)[0])
        taken[k], left = taken[k] - 1, left + int(n[k])
    while left >= int(n.max()):
        order = rng.permutation(np.flatnonzero(taken < c))
        fits = order[np.cumsum(n[order]) <= left]
        taken[fits] += 1
        left -= int(n[fits].sum())
    out = np.zeros_like(counts)
    out[use] = taken + balance(n, taken, c - taken, left, rng)
    return out


def balance(lengths: np.ndarray, taken: np.ndarray, free: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """Exact bounded knapsack around a choice that misses its budget by ``left``, below the greatest length: by how many
    documents of each length it changes so that the sum is the greatest up to the budget.

    Any better choice can be reached by adding a free document while the sum is not above the budget and giving a taken
    one back while it is, so sums stay within one greatest length of it. Free documents are offered one after another;
    for each sum it is kept how far the taken ones, in a fixed order, are still untouched (the farther the better). No
    sum is passed over, so the result is optimal; the search ends at the budget itself, which is mostly met after a few
    documents. Of one length no more documents can be needed than twice the greatest length.
    """
    change = np.zeros_like(taken)
    if left == 0:
        return change
    most = int(lengths.max())
    kinds = rng.permutation(np.flatnonzero(taken > 0))  # taken documents, length by length; ends[i]: where kind i ends
    ends = np.cumsum(np.minimum(taken[kinds], 2 * most + 1))
    begins, sizes = ends - np.diff(ends, prepend=0), lengths[kinds]
    # at[x + most]: sums by their distance x from the budget, from -most to most; -1 for sums not reached
    at = np.full(2 * most + 1, -1, np.int64)
    way = np.zeros(2 * most + 1, np.int64)  # the step by which a sum was reached
    steps: list[tuple[int, np.ndarray, np.ndarray | int, int]] = []  # from a number on: steps before, kinds, 1 or -1
    made = 1

    def step(to: np.ndarray, before: np.ndarray, kind: np.ndarray | int, sign: int) -> None:
        nonlocal made
        steps.append((made, before, kind, sign))
        way[to] = np.arange(made, made + len(to))
        made += len(to)

    at[most - left] = int(ends[-1]) if len(ends) else 0
    order = rng.permutation(np.flatnonzero(free > 0))
    for k in (int(k) for i in range(2 * most + 1) for k in order[free[order] > i]):
        n, old = int(lengths[k]), at.copy()
        low = np.flatnonzero(old[: most + 1] >= 0)
        low = low[old[low] > at[low + n]]
        at[low + n] = old[low]
        step(low + n, way[low].copy(), k, 1)
        i = 2 * most
        while i > most and at[most] < 0:  # above the budget: give back one of the untouched, the last of its kind
            if at[i] > max(old[i], 0):
                some = np.flatnonzero((begins < at[i]) & (ends > max(old[i], 0)))
                last, there = np.minimum(ends[some], at[i]) - 1, i - sizes[some]
                more = last > at[there]
                at[there[more]] = last[more]
                step(there[more], np.broadcast_to(way[i], int(more.sum())), kinds[some][more], -1)
            i -= 1
        if at[most] >= 0:
            break
    number = int(way[int(np.flatnonzero(at[: most + 1] >= 0)[-1])])
    while number:
        base, before, kind, sign = steps[bisect_right(steps, number, key=lambda x: x[0]) - 1]
        change[kind if isinstance(kind, int) else kind[number - base]] += sign
        number = int(before[number - base])
    return change


class Mixture:
    """Uses of documents so that the sources come to ``target_share`` of a budget, each at most ``max_repeats`` times.

    ``counted`` has (doc_id, source, n_tokens), ``targets`` (source, target_share, max_repeats). The budget is the sum of
    tokens of all listed sources unless given; it grows with the corpus while ``targets`` is a short list. Documents
    whose source is null or not listed are not used; texts of 0 tokens are used as often as whole passes go. Rows
    of one doc_id count once. A null share counts as 0, a null or negative ``max_repeats`` as 0. A source that can't
    reach its target within its repeats reports the shortfall. Rounding: target_tokens is the nearest whole number.
    """

    def __init__(self, counted: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 7):
        goal = targets.filter("source IS NOT NULL").groupBy("source").agg(
            F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.greatest(F.max("max_repeats"), F.lit(0)).alias("max_repeats")
        )
        goal = materialize(goal)
        one = counted.select("doc_id", "source", "n_tokens").filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
        part = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(PARTS)).cast("int")
        self.docs = materialize(one.join(small_or_not(goal.select("source")), "source", "left_semi").withColumn("part", part))
        # (source, length, part) with the number of documents: as many rows as there are lengths, not documents
        self.lengths = materialize(self.docs.groupBy("source", "n_tokens", "part").agg(F.count("*").alias("n")))
        total = self.lengths.agg(F.sum(F.col("n_tokens") * F.col("n"))).first()[0]
        self.budget = int(total or 0) if budget is None else budget
        self.goal = goal.withColumn("target_tokens", F.round(F.col("target_share") * F.lit(self.budget)).cast("bigint"))
        self.plan = materialize(self._plan(seed))

    def _plan(self, seed: int) -> DataFrame:
        """(source, n_tokens, passes, extra): whole passes, and how many documents of the length are used once more."""

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            lengths, counts = pdf.n_tokens.to_numpy(), pdf.n.to_numpy()
            target, most = int(pdf.target_tokens.iloc[0]), int(pdf.max_repeats.iloc[0])
            total = int((lengths * counts).sum())
            passes = most if total == 0 else min(most, target // total)
            extra = fit(lengths, counts, target - passes * total, seed) if passes < most else np.zeros_like(counts)
            return pd.DataFrame({"source": pdf.source, "n_tokens": lengths, "passes": passes, "extra": extra})

        histogram = self.lengths.groupBy("source", "n_tokens").agg(F.sum("n").alias("n"))
        return (
            histogram.join(small_or_not(self.goal), "source")
            .groupBy("source")
            .applyInPandas(one, "source string, n_tokens bigint, passes int, extra bigint")
        )

    def uses(self) -> DataFrame:
        """How often each document of a listed source is used: (doc_id, source, n_tokens, uses).

        Of a length's parts by hash the ones before ``edge`` are taken whole and ``edge`` itself up to ``rest``
        documents, so only documents of that part are ranked. The joined side has one row per source and length.
        """
        w = Window.partitionBy("source", "n_tokens").orderBy("part")
        sums = self.lengths.withColumn("up_to", F.sum("n").over(w)).join(self.plan, ["source", "n_tokens"])
        last = F.when(F.col("up_to") >= F.col("extra"), F.struct("part", (F.col("extra") - F.col("up_to") + F.col("n")).alias("rest")))
        cuts = sums.groupBy("source", "n_tokens", "passes").agg(F.min(last).alias("cut"))
        cuts = materialize(cuts.select("source", "n_tokens", "passes", F.col("cut.part").alias("edge"), F.col("cut.rest").alias("rest")))
        rows = self.docs.join(small_or_not(cuts), ["source", "n_tokens"])
        whole = rows.filter("part <> edge").withColumn("once", (F.col("part") < F.col("edge")).cast("int"))
        rank = Window.partitionBy("source", "n_tokens", "part").orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id")
        some = rows.filter("part = edge").withColumn("rank", F.row_number().over(rank))
        some = some.withColumn("once", (F.col("rank") <= F.col("rest")).cast("int")).drop("rank")
        return whole.unionByName(some).select("doc_id", "source", "n_tokens", (F.col("passes") + F.col("once")).alias("uses"))

    def shares(self) -> DataFrame:
        """Per listed source: target and reached share and tokens, the shortfall, documents and uses."""
        got = (
            self.lengths.groupBy("source", "n_tokens").agg(F.sum("n").alias("n"))
            .join(self.plan, ["source", "n_tokens"])
            .groupBy("source")
            .agg(
                F.sum(F.col("n_tokens") * (F.col("n") * F.col("passes") + F.col("extra"))).alias("reached"),
                F.sum("n").alias("docs"),
                F.sum(F.col("n") * F.col("passes") + F.col("extra")).alias("uses"),
            )
        )
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
        every = self.goal.join(got, "source", "left").withColumn("reached", zero("reached"))
        whole = F.sum("reached").over(Window.partitionBy())
        return every.withColumn("whole", whole).select(
            "source", "target_share", F.try_divide(F.col("reached").cast("double"), F.col("whole")).alias("reached_share"), "target_tokens",
            F.col("reached").alias("reached_tokens"), (F.col("target_tokens") - F.col("reached")).alias("shortfall_tokens"), "max_repeats",
            zero("docs").alias("docs"), zero("uses").alias("uses"),
        )
