"""Byte-level BPE over whole columns: unique pre-tokens are merged together in padded numpy matrices.

The pre-tokens of a batch of texts are cut by the public pattern and made unique. Those not seen before by the worker
are grouped by length into padded matrices of token ids. In each round every row merges its leftmost pair of minimum
rank; ranks come from an open-addressing hash table of all pairs; rows without a mergeable pair are taken out
(compaction of rows) and the others are closed up by one column (compaction of columns).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.llm.arrays import LETTER, SPACE, Prefix, chunks, codes, kinds
from cartulary.session import spread_small

#: Pre-tokens longer than this many bytes go through a heap instead of a matrix (the same merges, O(n log n)).
MATRIX_BYTES = 512
#: Pre-tokens that a worker remembers at most; beyond, it forgets all and begins anew. Only speed depends on it.
REMEMBERED = 400_000

NONE = np.int32(2**31 - 1)


class ByteBPE:
    """An encoder for a vocabulary file of lines ``base64(token) rank``; ids are ranks.

    ``pattern`` cuts a text into pre-tokens. Markup that looks like a special token is plain text.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        self.cut = regex.compile(pattern).findall
        self.fast = pattern == PATTERN
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.whole = {k: (v,) for k, v in ranks.items()}
        self._pairs(ranks)
        self.memo: dict[str, tuple[int, ...]] = {}

    def _pairs(self, ranks: dict[bytes, int]) -> None:
        """The hash table of (left id, right id) to the id of their union, which is its rank."""
        left, right, union = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), union.append(rank)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        values = np.array(union, np.int32)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.unions = np.full(1 << self.bits, NONE, np.int32)
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            at = (self._slot(keys[todo]) + step) & ((1 << self.bits) - 1)
            free = self.slots[at] == -1
            self.slots[at[free]] = keys[todo[free]]  # of several, the last one stays
            won = self.slots[at] == keys[todo]
            self.unions[at[won]] = values[todo[won]]
            todo, step = todo[~won], step + 1
        self.probes = step
        self.merged = dict(zip(keys.tolist(), values.tolist(), strict=True))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the unions of pairs, NONE where a pair has none."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(keys.shape, NONE, np.int32)
        at = self._slot(keys)
        hit = self.slots[at] == keys
        out[hit] = self.unions[at[hit]]
        open_ = np.nonzero(~hit & (self.slots[at] != -1))
        for step in range(1, self.probes):
            if not len(open_[0]):
                break
            k, here = keys[open_], (at[open_] + step) & ((1 << self.bits) - 1)
            hit = self.slots[here] == k
            out[tuple(x[hit] for x in open_)] = self.unions[here[hit]]
            more = ~hit & (self.slots[here] != -1)
            open_ = tuple(x[more] for x in open_)
        return out

    def _matrix(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """Merges words of similar length together."""
        n, width = len(words), max(map(len, words))
        size = np.fromiter(map(len, words), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        result: list[tuple[int, ...]] = [()] * n
        row = np.arange(n)
        ranks = np.full((n, width), NONE, np.int32)
        if width > 1:
            ok = ids[:, 1:] >= 0
            ranks[:, :-1][ok] = self._ranks(ids[:, :-1][ok], ids[:, 1:][ok])
        while len(row):
            at = ranks.argmin(1)  # the leftmost of the minimum
            union = ranks[np.arange(len(row)), at]
            stay = union != NONE
            if not stay.all():
                for r, x, k in zip(row[~stay].tolist(), ids[~stay], size[~stay].tolist(), strict=True):
                    result[r] = tuple(x[:k].tolist())
                row, ids, ranks, size, at, union = row[stay], ids[stay], ranks[stay], size[stay], at[stay], union[stay]
                if not len(row):
                    break
            k, m = np.arange(len(row)), ids.shape[1]
            after = np.arange(m - 1) > at[:, None]
            ids = np.concatenate([np.where(after, ids[:, 1:], ids[:, :-1])], 1)
            ranks = np.where(after, ranks[:, 1:], ranks[:, :-1])
            ids[k, at] = union
            size = size - 1
            ranks[k, at] = NONE
            for i in (at - 1, at):  # only the pairs beside the union are new
                j = np.flatnonzero((i >= 0) & (i + 1 < size))
                ranks[j, i[j]] = self._ranks(ids[j, i[j]], ids[j, i[j] + 1])
            keep = int(size.max())
            ids, ranks = ids[:, :keep], ranks[:, :keep]
        return result

    def _heap(self, word: bytes) -> tuple[int, ...]:
        """The same merges for one very long word, with a heap of pairs and a linked list."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        get = self.merged.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], k = r, -1, after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if (x := get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[k]))
            h = before[i]
            if h >= 0 and (x := get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (x, h, ids[h], r))
        return tuple(x for x in ids if x >= 0)

    def learn(self, words: set[str]) -> None:
        """Encodes words that aren't remembered yet."""
        if len(self.memo) > REMEMBERED:
            self.memo = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            if w in self.memo:
                continue
            b = w.encode("utf-8", "replace")
            known = self.whole.get(b)
            if known:
                self.memo[w] = known
            elif len(b) > MATRIX_BYTES:
                self.memo[w] = self._heap(b)
            else:
                n = len(b)  # one bucket a length up to 16, then four for each doubling
                bucket = n if n <= 16 else 16 + (n.bit_length() << 2 | n >> n.bit_length() - 3 & 3)
                buckets.setdefault(bucket, []).append((w, b))
        for group in buckets.values():
            for i in range(0, len(group), 8192):
                part = group[i : i + 8192]
                self.memo.update(zip((w for w, _ in part), self._matrix([b for _, b in part]), strict=True))

    def _words(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """For each pre-token of all texts its number among the distinct ones; these; the first pre-token of each text."""
        if self.fast:
            return fast_words(texts)
        cut = [self.cut(t) for t in texts]
        number: dict[str, int] = {}
        which = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(cut)), np.int64)
        return which, list(number), np.concatenate([[0], np.cumsum(list(map(len, cut)), dtype=np.int64)])

    def _chunk(self, texts: list[str], lists: bool) -> tuple[np.ndarray | None, np.ndarray]:
        which, words, first = self._words(texts)
        self.learn(set(words))
        found = [self.memo[w] for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found))
        sizes = size[which]
        ends = np.zeros(len(which) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        flat = None
        if lists:
            store = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
            begin = np.cumsum(size) - size
            flat = store[np.arange(ends[-1]) + np.repeat(begin[which] - ends[:-1], sizes)]
        return flat, ends[first]

    def run(self, texts: list[str | None], lists: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another (empty unless ``lists``), and the number of ids of each text.

        An empty and a null text give no ids. Work is done in chunks of about a million characters; longer texts are
        cut where white space follows other characters, which always begins a pre-token of the public pattern.
        """
        owner, pieces = [], []
        for i, t in enumerate(texts):
            for p in segments(t or "") if self.fast else [t or ""]:
                owner.append(i), pieces.append(p)
        flats, counts = [], np.zeros(len(texts), np.int64)
        for a, b in chunks(list(map(len, pieces)), CHUNK):
            flat, ends = self._chunk(pieces[a:b], lists)
            np.add.at(counts, owner[a:b], np.diff(ends))
            if lists:
                flats.append(flat)
        return np.concatenate(flats) if flats else np.zeros(0, np.int32), counts

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Lists of ids."""
        flat, n = self.run(texts)
        return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] if texts else []


#: Characters that are worked on at once.
CHUNK = 1_000_000

#: The public pattern whose pre-tokens ``fast_words`` cuts, and its contractions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def segments(text: str) -> list[str]:
    """Parts of a long text, cut before white space that follows another character."""
    out, begin = [], 0
    while len(text) - begin > 2 * CHUNK:
        at = begin + CHUNK
        while at < len(text) and not (text[at] in " \n\t" and not text[at - 1].isspace()):
            at += 1
        out.append(text[begin:at])
        begin = at
    return [*out, text[begin:]]


def fast_words(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
    """``_words`` for the public pattern, from the kinds of neighbouring characters.

    A pre-token begins where the kind changes; the last of several white-space characters before another character
    stands alone, or joins what follows if it is a blank; a contraction takes the letters after its apostrophe.
    """
    flat, at = codes(texts)
    n = len(flat)
    kind = kinds()[flat]
    begins = np.zeros(n + 4, bool)  # of a text; with room for looking ahead
    begins[at] = True
    start = np.ones(n + 1, bool)
    if n:
        start[1:n] = (kind[1:] != kind[:-1]) | begins[1:n]
        after = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begins[1:n]) + 1
        start[after - 1] = True
        start[after] = flat[after - 1] != 32
        quote = np.flatnonzero((flat == 39) & start[:n])
        padded = np.concatenate([flat, np.zeros(3, np.uint32)])
        for end in CONTRACTIONS:
            hit = quote
            for k, c in enumerate(end, 1):
                hit = hit[(padded[hit + k] == ord(c)) & ~begins[hit + k]]
            start[hit + 1] = False
            stop = hit + 1 + len(end)
            stop = stop[stop < n]
            start[stop[kind[stop] == LETTER]] = True
    begin = np.flatnonzero(start[:n])
    end = np.append(begin[1:], n) if len(begin) else begin
    h = Prefix(flat).spans(begin, end)
    whole = "".join(texts)
    long: dict[str, int] = {}
    for i in np.flatnonzero(end - begin > 64).tolist():  # long ones are told apart by themselves
        h[i] = long.setdefault(whole[begin[i] : end[i]], len(long))
    _, where, which = np.unique(h, return_index=True, return_inverse=True)
    words = [whole[a:b] for a, b in zip(begin[where].tolist(), end[where].tolist(), strict=True)]
    return which, words, np.searchsorted(begin, at)


_encoders: dict[tuple[str, str], ByteBPE] = {}


def encoder(ranks_path: str, pattern: str) -> ByteBPE:
    """One encoder per worker and vocabulary; it keeps what it remembers from batch to batch."""
    key = (ranks_path, pattern)
    if key not in _encoders:
        _encoders[key] = ByteBPE(*key)
    return _encoders[key]


def vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """Place and pattern of a public vocabulary installed on every node."""
    import public_tokenizers as public

    return str(public.path(f"{name}.tiktoken")), public.PATTERN


def _parts(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def encode(
    df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 1000
) -> DataFrame:
    """One row (id, ids) for each row of ``df``, in one pass without an exchange.

    Nulls and empty texts give an empty list, repeated rows stay repeated, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for whole in batches:
            for b in _parts(whole, rows):
                flat, n = bpe.run(b.column(1).to_pylist())
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], ["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    two = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return spread_small(two).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def token_counts(
    df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out: str = "n_tokens", rows: int = 1000
) -> DataFrame:
    """``df`` without its text, with the number of tokens of each row (0 for null and empty texts)."""
    keep = [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for whole in batches:
            for b in _parts(whole, rows):
                _, n = bpe.run(b.column(len(keep)).to_pylist(), lists=False)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n)], [*keep, out])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), f"`{out}` bigint"])
    return spread_small(df.select(*keep, F.col(text_col))).mapInArrow(run, schema)
