"""Long exact spans shared between texts, by anchors on a difference cover.

Windows are hashed only where their position modulo a period lies in a perfect difference set. For any two positions
there is one offset below the period that brings both onto the set, so every common span of ``min_len`` characters
holds one window that is hashed in both texts. Equal anchors are found by hash bucket; pairs of texts are collapsed to
diagonals and extended character by character.

Postings travel as compressed columns, a row per chunk of text and bucket. A hash that is frequent within a chunk, or
within its bucket, is *hot*: instead of pairing its occurrences, all ``min_len`` windows around them are digested, and
those are grouped by the whole window. So no bucket grows with the frequency of a phrase, and pairs are only made of
texts that share a whole window, once for each run of equal windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.llm.arrays import Prefix, chunks, codes
from cartulary.llm.copies import SPREAD, members, spread
from cartulary.session import materialize, release, skew_safe_join, small_or_not, spread_small

#: Occurrences of one hash in a chunk, and in its bucket, up to which they are paired directly.
HOT_CHUNK, HOT = 16, 64
#: Characters worked on at once by a task, and those whose anchors one bucket holds about.
CHUNK, BUCKET_CHARS = 1_000_000, 16_000_000
#: Windows of a class that are paired at once.
BLOCK = 512


@cache
def difference_set(q: int) -> tuple[int, ...]:
    """A perfect difference set modulo q*q + q + 1 for a prime q (powers of a generator of the field of q**3 elements
    that lie in a plane)."""
    period = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, order, found = (1, 0, 0), 0, []
                while order == 0 or x != (1, 0, 0):
                    if x[2] == 0 and order < period:
                        found.append(order)
                    x = (x[2] * c % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * a) % q)
                    order += 1
                    if order >= q**3:
                        break
                if order == q**3 - 1:
                    return tuple(found)
    raise ValueError(f"{q} is no prime")


def cover(min_len: int) -> tuple[int, tuple[int, ...]]:
    """Period and difference set for spans of ``min_len``: the largest period of at most two thirds of it."""
    best = 2
    for q in (3, 5, 7, 11, 13, 17, 19, 23, 29, 31):
        if 3 * (q * q + q + 1) <= 2 * min_len:
            best = q
    return best * best + best + 1, difference_set(best)


def _pack(a: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(b: bytes, n: int, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(pa.decompress(b, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(dtype).ravel()


_POSTED, _OCCURRED, _MARK = 0, 1, 2
_BLOB = "bucket int, kind int, n int, h binary, d binary, p binary"
_FOUND = "hot boolean, a bigint, b bigint, diag bigint, lo bigint, hi bigint"


def _anchors(ids: np.ndarray, offsets: np.ndarray, texts: list[str], period: int, points: np.ndarray, width: int):
    """Hash, id and position of all anchors of a chunk; ``offsets`` are where the texts begin in their documents."""
    flat, at = codes(texts)
    size = np.diff(at)
    local = np.arange(len(flat)) - np.repeat(at[:-1], size)
    on = np.zeros(period, bool)
    on[points] = True
    here = np.flatnonzero(on[(local + np.repeat(offsets % period, size)) % period] & (local <= np.repeat(size - width, size)))
    which = np.searchsorted(at, here, "right") - 1
    h = Prefix(flat).spans(here, here + width)
    return h, ids[which], offsets[which] + local[here]


def _post(period: int, points: tuple[int, ...], width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                step = period * max(1, CHUNK // period)
                for o in range(0, max(1, len(t) - width + 1), step):
                    pieces.append((i, o, t[o : o + step + width - 1]))
            for x, y in chunks([len(t) for _, _, t in pieces], CHUNK):
                part = pieces[x:y]
                h, d, p = _anchors(
                    np.array([i for i, _, _ in part], np.int64), np.array([o for _, o, _ in part], np.int64),
                    [t for _, _, t in part], period, np.array(points), width,
                )
                rows = []
                uniq, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
                hot = (n > HOT_CHUNK)[inverse]
                marks = uniq[n > HOT_CHUNK]
                for a, *columns in _split(marks, buckets, marks):
                    rows.append((a, _MARK, len(columns[0]), _pack(columns[0]), b"", b""))
                if hot.any():
                    rows.append((int(h[0] % np.uint64(buckets)), _OCCURRED, int(hot.sum()), b"", _pack(_delta(d[hot])), _pack(p[hot])))
                for a, *c in _split(h[~hot], buckets, h[~hot], d[~hot], p[~hot]):
                    rows.append((a, _POSTED, len(c[0]), _pack(c[0]), _pack(_delta(c[1])), _pack(c[2])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (*[pa.int32()] * 3, *[pa.binary()] * 3), strict=True)] if rows
                    else [pa.array([], t) for t in (*[pa.int32()] * 3, *[pa.binary()] * 3)],
                    ["bucket", "kind", "n", "h", "d", "p"],
                )

    return run


def _delta(d: np.ndarray) -> np.ndarray:
    return np.diff(d, prepend=np.int64(0))


def _split(h: np.ndarray, buckets: int, *columns: np.ndarray):
    """(bucket, columns of its rows) for each bucket that occurs."""
    if not len(h):
        return
    b = (h % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    b = b[order]
    begin = np.flatnonzero(np.diff(b, prepend=-1))
    for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(b)], strict=True):
        yield int(b[i]), *(c[order[i:j]] for c in columns)


def _match(table: pa.Table) -> pa.Table:
    """Diagonals of a bucket's equal anchors, and the occurrences of hot ones."""
    rows = table.to_pylist()
    none64 = np.zeros(0, np.int64)
    h, d, p, marks = [np.zeros(0, np.uint64)], [none64], [none64], [np.zeros(0, np.uint64)]
    hot_d, hot_p = [none64], [none64]
    for r in rows:
        if r["kind"] == _MARK:
            marks.append(_unpack(r["h"], r["n"], np.uint64))
            continue
        ids, at = np.cumsum(_unpack(r["d"], r["n"], np.int64)), _unpack(r["p"], r["n"], np.int64)
        if r["kind"] == _OCCURRED:
            hot_d.append(ids), hot_p.append(at)
        else:
            h.append(_unpack(r["h"], r["n"], np.uint64)), d.append(ids), p.append(at)
    h, d, p = map(np.concatenate, (h, d, p))
    order = np.argsort(h, kind="stable")
    h, d, p = h[order], d[order], p[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else none64
    n = np.diff(np.append(begin, len(h)))
    hot = (n > HOT) | np.isin(h[begin], np.unique(np.concatenate(marks)))
    many = np.repeat(hot, n)
    hot_d.append(d[many]), hot_p.append(p[many])
    first, second = [none64], [none64]
    for size in np.unique(n[~hot & (n > 1)]).tolist():
        i, j = np.triu_indices(size, 1)
        at = begin[~hot & (n == size)][:, None]
        first.append((at + i).ravel()), second.append((at + j).ravel())
    i, j = np.concatenate(first), np.concatenate(second)
    keep = d[i] != d[j]
    i, j = i[keep], j[keep]
    i, j = np.where(d[i] < d[j], i, j), np.where(d[i] < d[j], j, i)
    a, b, lo, diag = d[i], d[j], p[i], p[j] - p[i]
    order = np.lexsort((lo, diag, b, a))
    a, b, lo, diag = a[order], b[order], lo[order], diag[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (diag[1:] != diag[:-1])]) if len(a) else np.zeros(0, bool)
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(a)) - 1 if len(s) else s
    hd, hp = np.concatenate(hot_d), np.concatenate(hot_p)
    zero = np.zeros(len(hd), np.int64)
    return pa.table(
        {
            "hot": np.concatenate([np.zeros(len(s), bool), np.ones(len(hd), bool)]),
            "a": np.concatenate([a[s], hd]),
            "b": np.concatenate([b[s], zero]),
            "diag": np.concatenate([diag[s], zero]),
            "lo": np.concatenate([lo[s], hp]),
            "hi": np.concatenate([lo[e], hp]),
        }
    )


def _extend(min_len: int):
    """Maximal equal runs of two texts that are laid side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, start, diag, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = min(len(x), len(y))
                same = np.frombuffer(x[:n].encode("utf-32-le", "surrogatepass"), np.uint32) == np.frombuffer(
                    y[:n].encode("utf-32-le", "surrogatepass"), np.uint32
                )
                edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
                for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    if j - i >= min_len:
                        out.append((a, start + i, b, start + i + diag, j - i))
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.int64()) for c in columns], ["a", "start_a", "b", "start_b", "length"]
            )

    return run


def _windows(min_len: int, reach: int):
    """All windows around the hot positions of a text: a digest of their characters in two parts, text and place, and the
    characters before and after, -1 where the neighbouring window isn't among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                begin = np.zeros(len(t) - min_len + 2, np.int64)  # windows that begin here: +1 at the first, -1 after the last
                at = np.array(at, np.int64)
                np.add.at(begin, np.clip(at - reach, 0, len(t) - min_len + 1), 1)
                np.add.at(begin, np.clip(at + 1, 0, len(t) - min_len + 1), -1)
                s = np.flatnonzero(np.cumsum(begin)[: len(t) - min_len + 1] > 0)
                flat = codes([t])[0].astype(np.int32)
                raw = memoryview(flat.tobytes())
                for i in range(0, len(s), 100_000):
                    k = s[i : i + 100_000]
                    digests = b"".join(hashlib.md5(raw[4 * x : 4 * (x + min_len)], usedforsecurity=False).digest() for x in k.tolist())
                    w = np.frombuffer(digests, np.int64).reshape(-1, 2)
                    on = np.isin(k - 1, s), np.isin(k + 1, s)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), pa.array(np.full(len(k), d)), pa.array(k),
                            pa.array(np.where(on[0], flat[k - 1], -1).astype(np.int32)), pa.array(np.where(on[1], flat[np.minimum(k + min_len, len(flat) - 1)], -1).astype(np.int32)),
                        ],
                        ["w1", "w2", "d", "s", "before", "after"],
                    )

    return run


def _within(period: int, points: tuple[int, ...], min_len: int):
    """Maximal spans that stand at two positions of one text: (digest, s, t, length), s < t."""
    width = min_len - period + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for digest, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                flat, _ = codes([t])
                h, _, p = _anchors(np.zeros(1, np.int64), np.zeros(1, np.int64), [t], period, np.array(points), width)
                order = np.argsort(h, kind="stable")
                h, p = h[order], p[order]
                apart = np.zeros(len(t), bool)
                begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                for i, j in zip(begin.tolist(), np.append(begin[1:], len(h)).tolist(), strict=True):
                    for k in range(i, j - 1):
                        apart[p[k + 1 : j] - p[k]] = True
                for d in np.flatnonzero(apart).tolist():
                    same = flat[:-d] == flat[d:]
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
                    out += [(digest, i, i + d, j - i) for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if j - i >= min_len]
            columns = zip(*out, strict=True) if out else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, (pa.binary(), *[pa.int64()] * 3), strict=True)], ["digest", "s", "t", "length"]
            )

    return run


class SharedSpans:
    """Spans of at least ``min_len`` characters that stand verbatim in different documents.

    ``docs`` needs a bigint ``id_col`` and a string ``text_col``; other columns are not read. Null ids, null texts and
    texts shorter than ``min_len`` share nothing. Rows of one id count as one document; exact copies are collapsed to
    the smallest id (``copies``). ``buckets``: groups the anchors are sorted in, each by a task in memory (about 9 % of its
    characters, 24 bytes each); by default as many as the counted characters need at ``BUCKET_CHARS`` each.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = 200, buckets: int | None = None):
        self.min_len = min_len
        text = docs.select(F.col(id_col).cast("bigint").alias("key"), F.col(text_col).alias("text"))
        self.all = text.filter("key IS NOT NULL")
        self.texts = self.all.filter(F.length("text") >= min_len)
        digest = F.unhex(F.md5("text"))
        keyed = materialize(self.texts.select("key", digest.alias("digest"), F.length("text").alias("n")).distinct())
        chars = keyed.agg(F.sum("n")).first()[0] or 0
        self.buckets = buckets or max(64, -(-chars // BUCKET_CHARS))
        self.parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.buckets // 4))
        self.copies = members(keyed, written=True)
        extra = self.copies.filter("key <> rep").select("key", "digest")
        self.single = self.texts.withColumn("digest", digest).join(small_or_not(extra), ["key", "digest"], "left_anti")
        self.period, self.points = cover(min_len)
        self._parts: tuple[DataFrame, DataFrame] | None = None

    def candidates(self) -> DataFrame:
        """Diagonals with equal anchors (``lo`` and ``hi``: first and last position in ``a``), and hot occurrences."""
        width = self.min_len - self.period + 1
        blobs = spread_small(self.single.select("key", "text")).mapInArrow(_post(self.period, self.points, width, self.buckets), _BLOB)
        return blobs.repartition(self.parts, "bucket").groupBy("bucket").applyInArrow(_match, _FOUND)

    def _find(self) -> tuple[DataFrame, DataFrame]:
        """Extended spans of the diagonals (a, start_a, b, start_b, length), and all whole windows around hot anchors
        (w1, w2, d, s, before, after); each is found once and kept as a table."""
        if self._parts is None:
            self._parts = self._extended()
        return self._parts

    def _extended(self) -> tuple[DataFrame, DataFrame]:
        found = materialize(self.candidates())
        reach = self.period - 1
        diagonals = found.filter("NOT hot").groupBy("a", "b", "diag").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        hot = found.filter("hot").select(F.col("a").alias("key"), F.col("lo").alias("p"))
        wanted = found.filter("NOT hot").select(F.explode(F.array("a", "b")).alias("key")).union(hot.select("key")).distinct()
        wanted = materialize(wanted)
        text = self.single.join(small_or_not(wanted), "key", "left_semi")
        text = materialize(text.groupBy("key", "digest").agg(F.first("text").alias("text")).drop("digest"))

        start = F.greatest(F.lit(0), F.col("lo") - reach, -F.col("diag"))
        piece = lambda s: F.substring("text", (s + 1).cast("int"), (F.col("hi") + 2 * self.min_len - F.col("start")).cast("int"))
        side = (
            diagonals.join(text.withColumnRenamed("key", "a"), "a")
            .withColumn("start", start)
            .select("a", "b", "diag", "hi", "start", piece(F.col("start")).alias("x"))
        )
        both = side.join(text.withColumnRenamed("key", "b"), "b").select(
            "a", "b", "start", "diag", "x", piece(F.col("start") + F.col("diag")).alias("y")
        )
        schema = "a bigint, start_a bigint, b bigint, start_b bigint, length bigint"
        direct = both.mapInArrow(_extend(self.min_len), schema)

        at = hot.groupBy("key").agg(F.collect_set("p").alias("at"))
        schema = "w1 bigint, w2 bigint, d bigint, s bigint, before int, after int"
        windows = text.join(at, "key").select("key", "text", "at").mapInArrow(_windows(self.min_len, reach), schema)
        out = materialize(direct), materialize(windows)
        release(found, wanted, text)
        return out

    def _edges(self, side: str) -> DataFrame:
        """Where equal windows of two texts don't go on at ``side`` (before or after): (a, sa, b, sb), a < b.

        Windows are classed by the character at that side. Two equal ones go on together only if it is the same for
        both, so only members of different classes are paired, and those of the class -1 also with one another: a run of
        equal windows gives its two ends and not the pairs between them. Large classes are paired in blocks.
        """
        _, windows = self._find()
        key, at = ["w1", "w2", side], F.col(side)
        classes = windows.groupBy(*key).agg(F.count("*").alias("n"), F.min("d").alias("x"), F.max("d").alias("y"))
        # windows of one text, and those that all go on with the same character, give no pair
        open_ = classes.groupBy("w1", "w2").agg(F.min("x").alias("x"), F.max("y").alias("y"), F.min(side).alias("least"), F.max(side).alias("most"))
        open_ = open_.filter("x <> y AND (least <> most OR least = -1)").select("w1", "w2")
        classes = materialize(classes.join(open_, ["w1", "w2"], "left_semi").select(*key, "n"))
        k = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
        x = classes.select("w1", "w2", at.alias("cx"), k("n").alias("kx"))
        y = classes.select("w1", "w2", at.alias("cy"), k("n").alias("ky"))
        links = x.join(y, ["w1", "w2"]).filter("cx < cy OR cx = cy AND cx = -1")
        links = links.select("w1", "w2", "cx", "cy", F.explode(F.sequence(F.lit(0), F.col("kx") - 1)).alias("ix"), "ky")
        links = links.select("w1", "w2", "cx", "ix", "cy", F.explode(F.sequence(F.lit(0), F.col("ky") - 1)).alias("iy"))
        own = skew_safe_join(windows, classes, key, "n", windows.count())
        own = materialize(own.select(*key, F.pmod(F.xxhash64("d", "s"), k("n")).cast("int").alias("i"), "d", "s"))
        first = links.join(own.select("w1", "w2", F.col(side).alias("cx"), F.col("i").alias("ix"), F.col("d").alias("dx"), F.col("s").alias("sx")), ["w1", "w2", "cx", "ix"])
        both = first.join(own.select("w1", "w2", F.col(side).alias("cy"), F.col("i").alias("iy"), F.col("d").alias("dy"), F.col("s").alias("sy")), ["w1", "w2", "cy", "iy"])
        turn = lambda p, q: F.when(F.col("dx") < F.col("dy"), F.col(p)).otherwise(F.col(q))
        # within the class -1 each pair comes in both orders
        return both.filter("dx < dy OR dx > dy AND cx < cy").select(F.least("dx", "dy").alias("a"), turn("sx", "sy").alias("sa"), F.greatest("dx", "dy").alias("b"), turn("sy", "sx").alias("sb"))

    def spans(self) -> DataFrame:
        """Maximal common spans of different documents: (a, start_a, b, start_b, length), a < b, positions from 0.

        Spans found by hot windows are runs of such windows on one diagonal; where they overlap or touch a span found
        directly on it, both are parts of one. Copies are spread as in ``copies.spread``.
        """
        direct, _ = self._find()
        ends = lambda side, kind: self._edges(side).select("a", "b", (F.col("sb") - F.col("sa")).alias("diag"), F.col("sa").alias("at"), F.lit(kind).alias("kind"))
        # on a diagonal runs of equal windows begin and end in turn; one window can be both
        w = Window.partitionBy("a", "b", "diag").orderBy("at", "kind")
        runs = ends("before", 0).union(ends("after", 1)).withColumn("last", F.lead("at").over(w)).filter("kind = 0")
        by_window = runs.select(
            "a", F.col("at").alias("start_a"), "b", (F.col("at") + F.col("diag")).alias("start_b"), (F.col("last") - F.col("at") + self.min_len).alias("length")
        )
        found = direct.unionByName(by_window).withColumn("diag", F.col("start_b") - F.col("start_a")).withColumn("end", F.col("start_a") + F.col("length"))
        w = Window.partitionBy("a", "b", "diag").orderBy("start_a", "end")
        apart = F.coalesce(F.col("start_a") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
        merged = (
            found.withColumn("apart", apart.cast("int"))
            .withColumn("span", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("a", "b", "diag", "span")
            .agg(F.min("start_a").alias("start_a"), F.max("end").alias("end"))
        )
        return self._spread(
            merged.select("a", "start_a", "b", (F.col("start_a") + F.col("diag")).alias("start_b"), (F.col("end") - F.col("start_a")).alias("length"))
        )

    def _spread(self, spans: DataFrame) -> DataFrame:
        """Spans of representatives as those of all members, with the spans within classes."""
        small = self.copies.filter(F.col("copies") <= SPREAD)
        out = spans
        for side in ("a", "b"):
            own = small.select(F.col("rep").alias(side), F.col("key").alias("member"))
            out = out.join(own, side, "left").withColumn(side, F.coalesce("member", side)).drop("member")
        x, y = (small.select("digest", F.col("key").alias(k)) for k in "ab")
        stars = self.copies.filter((F.col("copies") > SPREAD) & (F.col("key") != F.col("rep"))).select("digest", F.col("rep").alias("a"), F.col("key").alias("b"))
        met = x.join(y, "digest").filter("a < b").unionByName(stars)
        first = self.copies.filter("key = rep").select("key", "digest")
        text = self.texts.withColumn("digest", F.unhex(F.md5("text"))).join(small_or_not(first), ["key", "digest"], "left_semi").select("digest", "text")
        text = materialize(text.dropDuplicates(["digest"]))
        whole = text.select("digest", F.lit(0).cast("bigint").alias("s"), F.lit(0).cast("bigint").alias("t"), F.length("text").cast("bigint").alias("length"))
        again = materialize(spread_small(text).mapInArrow(_within(self.period, self.points, self.min_len), "digest binary, s bigint, t bigint, length bigint"))
        own = whole.union(again).union(again.select("digest", "t", "s", "length"))
        within = met.join(own, "digest").select("a", F.col("s").alias("start_a"), "b", F.col("t").alias("start_b"), "length")
        ordered = lambda p, q: F.when(F.col("a") < F.col("b"), F.col(p)).otherwise(F.col(q))
        return (
            out.filter("a <> b")
            .select(
                F.least("a", "b").alias("a"), ordered("start_a", "start_b").alias("start_a"), F.greatest("a", "b").alias("b"), ordered("start_b", "start_a").alias("start_b"), "length"
            )
            .unionByName(within)
            .distinct()
        )

    def pairs(self) -> DataFrame:
        """Distinct pairs (a, b), a < b, of documents that share a span, copies spread as in ``copies.spread``."""
        return spread(self._met(), self.copies)

    def classes(self) -> DataFrame:
        """One row per document of ``min_len`` characters or more: (key, rep, copies, links), the smallest key with its
        text, the number of keys with it, and the number of other texts that share a span with it."""
        links = self._met().select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        return (
            self.texts.select("key")
            .distinct()
            .join(self.copies.select("key", "rep", "copies"), "key", "left")
            .select("key", F.coalesce("rep", "key").alias("rep"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
            .join(links, "rep", "left")
            .select("key", "rep", "copies", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))
        )

    def _met(self) -> DataFrame:
        """Distinct pairs (a, b), a < b, of representatives that share a span."""
        direct, _ = self._find()
        return direct.select("a", "b").union(self._edges("before").select("a", "b")).distinct()

    def coverage(self) -> DataFrame:
        """One row per document: (key, n_chars, shared_chars, shared_part), the part that also stands in others.

        Overlapping spans count once. Null and empty texts have 0 characters and a null part. Hot windows are counted
        where they stand, without pairs.
        """
        direct, windows = self._find()
        shared = windows.groupBy("w1", "w2").agg(F.min("d").alias("x"), F.max("d").alias("y"), F.count("*").alias("n")).filter("x <> y")
        windows = skew_safe_join(windows, materialize(shared.select("w1", "w2", "n")), ["w1", "w2"], "n", windows.count())
        ends = lambda k: direct.select(F.col(k).alias("key"), F.col(f"start_{k}").alias("s"), (F.col(f"start_{k}") + F.col("length")).alias("e"))
        one = ends("a").union(ends("b")).union(windows.select("d", "s", F.col("s") + self.min_len))
        w = Window.partitionBy("key").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
        merged = one.distinct().withColumn("reached", F.coalesce(F.max("e").over(w), F.lit(0)))
        new = F.greatest(F.lit(0), F.col("e") - F.greatest("s", "reached"))
        covered = merged.groupBy("key").agg(F.sum(new).alias("shared"))
        doc = self.all.groupBy("key").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("bigint").alias("n_chars"))
        whole = self.copies.select("key").distinct().withColumn("copied", F.lit(True))
        chars = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("shared", F.lit(0))).cast("bigint")
        return (
            doc.join(covered, "key", "left")
            .join(whole, "key", "left")
            .select("key", "n_chars", chars.alias("shared_chars"), F.try_divide(chars.cast("double"), F.col("n_chars")).alias("shared_part"))
        )
