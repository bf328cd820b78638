"""Near-duplicate notes: an inverted join of signature coordinates with prefixes and skipped lists.

Each text gets a signature of ``COORDINATES`` values, each made of ``ROWS`` minima of hashed word sequences; two texts
agree in a coordinate with a probability of their likeness to the power ``ROWS``, so that texts which only share
phrases rarely meet. A text is posted under (coordinate, value) pairs. As alike texts agree in at least
``MATCHES`` coordinates, they meet within any ``COORDINATES - MATCHES + 1`` of them, so only that prefix, rarest values
first, is merged; the long lists of frequent values are skipped and probed instead by comparing the signatures of the
pairs that met. Pairs with at least ``MATCHES`` equal coordinates are then measured exactly on their word sequences.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.arrays import Prefix, alphanumeric, chunks, codes, mix
from cartulary.llm.copies import members, spread
from cartulary.session import materialize, small_or_not, spread_small

COORDINATES, ROWS = 64, 3
#: At likeness 0.7 the coordinates that agree number 22.0 on average with a deviation of 3.8: fewer than 7 happen for
#: 4 in 10**6 such pairs, at 0.75 for 8 in 10**9. The threshold follows from this, not from the data.
MATCHES = 7
#: Texts of a list that are paired at once; longer lists are cut into blocks of about that many, and these paired.
BLOCK = 512
CHUNK = 1_000_000

def _sequence_hashes(texts: list[str], n: int, least: int) -> list[np.ndarray | None]:
    """Distinct hashes of the ``n``-word sequences of each text, words being unbroken runs of letters and digits in lower case; None for texts of fewer than ``least`` words."""
    flat, at = codes([t.lower() for t in texts])
    on = np.zeros(len(flat) + 2, bool)
    on[1:-1] = alphanumeric()[flat]
    edge = on[1:] != on[:-1]
    edge[at[:-1]] |= on[1:][at[:-1]] & on[:-1][at[:-1]]  # no word runs from one text into the next
    where = np.flatnonzero(edge)
    begin = where[on[where + 1]]
    end = where[on[where]]
    h = Prefix(flat).spans(begin, end)
    first = np.searchsorted(begin, at)
    m = len(h) - n + 1
    seq = np.zeros(max(0, m), np.uint64)
    for i in range(n):
        seq = mix(seq * np.uint64(0x2545F4914F6CDD1D) + h[i : i + m]) if m > 0 else seq
    return [
        np.unique(seq[a : b - n + 1]) if b - a >= max(least, n) else None
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)
    ]


def _signer(n: int, least: int):
    rng = np.random.default_rng(20240229)
    factors = rng.integers(0, 2**63, COORDINATES * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, COORDINATES * ROWS, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            keep, exact, digests, ids, signs = [], [], [], [], []
            for a, b in chunks(list(map(len, texts)), CHUNK):
                for i, x in enumerate(_sequence_hashes(texts[a:b], n, least), a):
                    if x is None:
                        continue
                    low = np.full(COORDINATES * ROWS, 2**64 - 1, np.uint64)
                    for k in range(0, len(x), 2048):
                        y = x[k : k + 2048, None] * factors + shifts
                        low = np.minimum(low, y.min(0))
                    value = np.zeros(COORDINATES, np.uint64)
                    for row in low.reshape(ROWS, COORDINATES):
                        value = mix(value * np.uint64(0x2545F4914F6CDD1D) + row)
                    digest = hashlib.md5(x.tobytes()).digest()
                    keep.append(i), exact.append(hashlib.md5(texts[i].encode("utf-8", "surrogatepass")).digest()), digests.append(digest), ids.append(int.from_bytes(digest[:8], "little", signed=True))
                    signs.append((value >> np.uint64(32)).astype(np.uint32).view(np.int32))
            flat = np.concatenate(signs) if signs else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(keep, pa.int64())),
                    pa.array(exact, pa.binary()),
                    pa.array(digests, pa.binary()),
                    pa.array(ids, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * COORDINATES), pa.array(flat)),
                ],
                ["key", "exact", "digest", "id", "sig"],
            )

    return run


def _hasher(n: int, least: int):
    """Distinct hashes of the ``n``-word sequences of each text, in order: (key, seq)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            keep, own = [], []
            for a, b in chunks(list(map(len, texts)), CHUNK):
                for i, x in enumerate(_sequence_hashes(texts[a:b], n, least), a):
                    if x is not None:
                        keep.append(i), own.append(x.view(np.int64))
            at = np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate(own) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(keep, pa.int64())), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["key", "seq"])

    return run


def _measure(least: float):
    """Exact likeness of pairs. Rows come by (token, cell), those with hashes of a text (``b`` null) before the pairs of
    these texts; what is held is one cell's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            token, cell, first, second = (batch.column(i).to_pylist() for i in range(4))
            seq = batch.column(4)
            at, flat = seq.offsets.to_numpy(), seq.values.to_numpy().view(np.uint64)
            out = []
            for i, (a, b) in enumerate(zip(first, second, strict=True)):
                if group != (token[i], cell[i]):
                    group, held = (token[i], cell[i]), {}
                if b is None:
                    held.setdefault(a, []).append(flat[at[i] : at[i + 1]].copy())
                    continue
                best = 0.0
                for p in held[a]:
                    for q in held[b]:
                        both = len(np.intersect1d(p, q, assume_unique=True))
                        either = len(p) + len(q) - both
                        if both >= least * either - 1e-9 * either:
                            best = max(best, both / either)
                if best:
                    out.append((a, b, best))
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()), strict=True)],
                ["a", "b", "likeness"],
            )

    return run


class NearDuplicates:
    """Texts whose distinct ``n``-word sequences are alike to at least ``least`` (shared divided by all).

    ``df`` needs a string ``key_col``; the text is ``parts`` joined by line breaks with nulls as empty. Rows with a
    null key, and texts of fewer than ``least_words`` words, take no part. Texts with the same set of sequences are
    collapsed to the smallest key for the search and all given back in full; only exact copies of a text stand for one
    another (``copies``). Repeated rows count once. A key with several texts is alike to
    whatever any of them is alike to. Other columns are not read; an empty table gives no rows.
    """

    def __init__(
        self, df: DataFrame, key_col: str = "path", parts: tuple[str, ...] = ("title", "body"), n: int = 3, least: float = 0.7, least_words: int = 20, block: int = BLOCK
    ):
        self.n, self.least, self.least_words, self.block = n, least, least_words, block
        text = F.concat_ws("\n", *(F.coalesce(F.col(p), F.lit("")) for p in parts))
        self.texts = df.filter(F.col(key_col).isNotNull()).select(F.col(key_col).cast("string").alias("key"), text.alias("text"))
        schema = "key string, exact binary, digest binary, id bigint, sig array<int>"
        self.signed = materialize(spread_small(self.texts).mapInArrow(_signer(n, least_words), schema))
        self.copies = members(self.signed.select("key", F.col("exact").alias("digest")))
        alike = members(self.signed.select("key", "digest"))
        # of each text, its first key, and the first key of all texts with the same sequences
        later = self.copies.filter("key <> rep").select("key", F.col("digest").alias("exact"))
        firsts = self.signed.select("key", "exact", "digest").join(small_or_not(later), ["key", "exact"], "left_anti")
        self.forms = materialize(firsts.join(small_or_not(alike.select("key", "digest", "rep")), ["key", "digest"]).select("key", "digest", "rep").distinct())
        extra = alike.filter("key <> rep").select("key", "digest")
        self.single = self.signed.join(small_or_not(extra), ["key", "digest"], "left_anti").dropDuplicates(["digest"])
        self._pairs: DataFrame | None = None

    def candidates(self) -> DataFrame:
        """Pairs (a, b) of representatives that agree in at least ``MATCHES`` coordinates, with that number."""
        single = materialize(self.single.select("id", "key", "sig"))
        posted = single.select("id", F.posexplode("sig").alias("i", "v")).select("id", F.expr("shiftleft(cast(i as bigint), 32) | (v & 4294967295L)").alias("token"))
        prefix = COORDINATES - MATCHES + 1
        # values that stand alone can't meet: with their number, not their lists, a text's prefix gets shorter
        lists = posted.groupBy("token").agg(F.count("*").alias("n")).filter("n > 1")
        ranked = (
            posted.join(lists, "token")
            .groupBy("id")
            .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("own"))
            .filter(F.size("own") >= MATCHES)
            .withColumn("alone", COORDINATES - F.size("own"))
            .filter(f"alone < {prefix}")
            .select("id", "alone", F.posexplode(F.expr(f"slice(own, 1, {prefix} - alone)")).alias("at", "t"))
            .select("id", F.col("t.token").alias("token"), (F.col("at") + F.col("alone")).alias("at"), F.ceil(F.col("t.n") / self.block).cast("int").alias("blocks"))
        )
        # a long list is cut into blocks by hash; a row goes to the cell of its own block with every block of the list
        own, lo, hi = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"), F.least("own", "other"), F.greatest("own", "other")
        posts = (
            ranked.withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("token", (lo * F.col("blocks") + hi).alias("cell"), "own", (F.col("own") == F.col("other")).alias("inner"), "id", "at")
        )
        x = posts.select("token", "cell", "inner", F.col("own").alias("own_x"), F.col("id").alias("x"), F.col("at").alias("at_x"))
        y = posts.select("token", "cell", "inner", F.col("own").alias("own_y"), F.col("id").alias("y"), F.col("at").alias("at_y"))
        met = (
            x.join(y, ["token", "cell", "inner"])
            .filter("x < y AND (inner OR own_x <> own_y)")
            .groupBy("x", "y")
            .agg(F.count("*").alias("n"), F.max(F.greatest("at_x", "at_y")).alias("at"), F.min("token").alias("token"))
            # what can still agree after the last meeting is known from its place in the order
            .filter(f"n + {COORDINATES} - at - 1 >= {MATCHES}")
        )
        sig = lambda k: single.select(F.col("id").alias(k), F.col("sig").alias(f"sig_{k}"), F.col("key").alias(f"key_{k}"))
        agree = F.expr("aggregate(zip_with(sig_x, sig_y, (p, q) -> if(p = q, 1, 0)), 0, (s, v) -> s + v)")
        # pairs that met in one list are measured together, by cells of two blocks, so that a text goes there once
        part = lambda k: F.pmod(F.xxhash64(k), F.ceil(F.col("many") / self.block)).cast("int")
        return (
            met.join(sig("x"), "x")
            .join(sig("y"), "y")
            .withColumn("agree", agree)
            .filter(F.col("agree") >= MATCHES)
            .join(lists.withColumnRenamed("n", "many"), "token")
            .select(
                F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b"), "agree", "token",
                F.concat_ws(":", F.least(part("x"), part("y")), F.greatest(part("x"), part("y"))).alias("cell"),
            )
            .filter("a <> b")
        )

    def pairs(self) -> DataFrame:
        """Pairs of representatives: (a, b, likeness), a < b, measured exactly on the hashes of their word sequences."""
        if self._pairs is None:
            close = materialize(self.candidates())
            met = close.select("token", "cell", F.explode(F.array("a", "b")).alias("key")).distinct()
            wanted = materialize(met.select("key").distinct())
            text = self.texts.join(small_or_not(wanted), "key", "left_semi")
            hashed = spread_small(text).mapInArrow(_hasher(self.n, self.least_words), "key string, seq array<bigint>")
            hashed = materialize(hashed.dropDuplicates(["key", "seq"]))
            texts = met.join(hashed, "key").select("token", "cell", F.col("key").alias("a"), F.lit(None).cast("string").alias("b"), "seq")
            rows = texts.unionByName(close.select("token", "cell", "a", "b"), allowMissingColumns=True)
            rows = rows.repartition("token", "cell").sortWithinPartitions("token", "cell", F.col("b").isNotNull())
            measured = rows.mapInArrow(_measure(self.least), "a string, b string, likeness double")
            self._pairs = materialize(measured.groupBy("a", "b").agg(F.max("likeness").alias("likeness")))
        return self._pairs

    def found(self) -> DataFrame:
        """Distinct pairs (a, b) of keys, a < b: of all different texts, exact copies spread as in ``copies.spread``."""
        return spread(spread(self.pairs(), self.forms, most=None), self.copies)

    def groups(self) -> DataFrame:
        """One row per key that takes part: (key, rep, group_id, copies, links).

        ``rep`` is the smallest key with the same text, ``copies`` the number of keys with it, ``group_id`` the smallest
        key of the connected group, and ``links`` the number of other texts that this one is alike to.
        """
        from cartulary.operators.graph import components

        pairs = self.pairs()
        group = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnsRenamed({"node": "first", "component": "group_id"})
        forms = self.forms.groupBy("rep").agg(F.count_distinct("key").alias("forms")).withColumnRenamed("rep", "first")
        # a text is alike to all with its own sequences and to all forms of those that were measured
        both = pairs.select(F.col("a").alias("first"), F.col("b").alias("other")).union(pairs.select("b", "a"))
        links = (
            both.join(forms.withColumnsRenamed({"first": "other", "forms": "there"}), "other", "left")
            .groupBy("first")
            .agg(F.sum(F.coalesce("there", F.lit(1))).alias("links"))
        )
        first = self.forms.select(F.col("key").alias("rep"), F.col("rep").alias("first"))
        return (
            self.signed.select("key")
            .distinct()
            .join(self.copies.select("key", "rep", "copies"), "key", "left")
            .select("key", F.coalesce("rep", "key").alias("rep"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
            .join(first, "rep", "left")
            .withColumn("first", F.coalesce("first", "rep"))
            .join(forms, "first", "left")
            .join(links, "first", "left")
            .join(group, "first", "left")
            .select(
                "key", "rep", F.coalesce("group_id", "first").alias("group_id"), "copies",
                (F.coalesce("links", F.lit(0)) + F.coalesce("forms", F.lit(1)) - 1).cast("bigint").alias("links"),
            )
        )
