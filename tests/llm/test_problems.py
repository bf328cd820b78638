"""The llm queries over the smallest tables against plain brute force."""

import re
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest

from cartulary.llm import bpe, mixture, pieces
from cartulary.llm.queries import queries


def rows(data, name, columns=None):
    return pq.read_table(f"{data}/{name}.parquet", columns=columns).to_pylist()


def run(spark, data, name):
    return {tuple(r) for r in queries()[name](spark, data).collect()}


def word_sequences(f):
    w = re.findall(r"[^\W_]+", ((f["title"] or "") + "\n" + (f["body"] or "")).lower())
    return set(zip(w, w[1:], w[2:])) if len(w) >= 20 else None  # noqa: B905


def test_near_duplicates(spark, data):
    notes = {f["path"]: s for f in rows(data, "files", ["path", "title", "body"]) if (s := word_sequences(f))}
    true = {(a, b) for a, b in combinations(sorted(notes), 2) if len(notes[a] & notes[b]) >= 0.7 * len(notes[a] | notes[b])}
    assert true and run(spark, data, "p1_found") == true
    groups = queries()["p1_groups"](spark, data).collect()
    assert len(groups) == len(notes)
    group = {r.path: r.group_id for r in groups}
    assert all(group[a] == group[b] for a, b in true)


def test_pieces(spark, data):
    big = {f["path"]: f["body"] for f in rows(data, "files", ["path", "body"]) if len(f["body"] or "") > 4000}
    kind = {p: "forced" if re.search(r"[^ \t\r\n]{4001}", b) else "natural" for p, b in big.items()}
    assert run(spark, data, "p2_found") == set(kind.items())
    parts = defaultdict(list)
    for r in queries()["p2_pieces"](spark, data).collect():
        parts[r.path].append(r)
    assert set(parts) == set(big)
    for path, own in parts.items():
        own.sort(key=lambda r: r.piece_no)
        assert "".join(big[path][r.begin : r.end] for r in own) == big[path]
        assert all(r.text == big[path][r.start : r.end] and len(r.text) <= 4000 for r in own)
        # about the last 200 characters of the piece before, or all of it if it is shorter
        assert all(160 <= r.begin - r.start <= 200 or r.start <= before.start + 40 for before, r in zip(own, own[1:], strict=False))
        assert own[0].start == 0 and all(r.begin - r.start <= 200 for r in own)


@pytest.mark.parametrize("length", [3799, 3801, 3990, 4000, 4001, 9000])
def test_cut_by_force_only_where_needed(length):
    for tail in (" x" * 3000, "\n" * 5000, " " * 4100, "."):
        for head in ("", "wort " * 500, "# Kopf\n\n", "a\n" * 2000):
            text = head + "x" * length + tail
            if len(text) <= 4000:
                continue
            cut = pieces.cut(text)
            assert "".join(text[b:e] for _, b, e, _ in cut) == text
            assert all(e - s <= 4000 and s <= b < e for s, b, e, _ in cut)
            assert any(k == "forced" for *_, k in cut) == bool(re.search(r"\S{4001}", text))


def fold(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()
    return "".join(c for c in s if c.isalnum())


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


def nearest(v, entries):
    ok = [(d, e) for e in entries if (d := edits(fold(v), fold(e))) * 5 <= 2 * len(fold(e))]
    return min(ok)[1] if ok else ""


def meant(data):
    types = {t["name"]: t["allowed_statuses"] for t in rows(data, "doc_types")}
    every = sorted({s for x in types.values() for s in x})
    out = set()
    for f in rows(data, "files", ["path", "type", "status"]):
        name = ""
        if f["type"] is not None and f["type"].strip():
            name = f["type"]
            if name not in types:
                name = nearest(name, types)
                out.add((f["path"], "type", name))
        s = f["status"]
        allowed = types[name] if name else every
        if s is not None and s.strip() and allowed and s not in allowed:
            out.add((f["path"], "status", nearest(s, allowed)))
    return out


def test_values(spark, data):
    assert run(spark, data, "p3_found") == meant(data)
    unmatched = queries()["p3_unmatched"](spark, data).collect()
    assert len({(r.field, r.list, r.value) for r in unmatched}) == len(unmatched) > 0


def test_tag_pairs(spark, data):
    nfc = lambda s: unicodedata.normalize("NFC", s)
    own = defaultdict(set)
    for t in rows(data, "tags"):
        tag = nfc(nfc(t["tag"] or "").strip().lower())
        if tag and t["path"] is not None:
            own[t["path"]].add(tag)
    n = Counter(x for tags in own.values() for x in tags)
    both = Counter(p for tags in own.values() for p in combinations(sorted(tags), 2))
    got = {(r.tag_a, r.tag_b): (r.both, r.n_a, r.n_b, r.n) for r in queries()["p5_pairs"](spark, data).collect()}
    assert got == {(a, b): (k, n[a], n[b], len(own)) for (a, b), k in both.items()}
    found = {(a, b) for (a, b), k in both.items() if k >= 5 and k * len(own) >= 4 * n[a] * n[b]}
    assert run(spark, data, "p5_found") == found


def test_ids(spark, data):
    import base64

    import public_tokenizers as public
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = rows(data, "documents", ["doc_id", "text"])
    got = {r.doc_id: r.ids for r in queries()["p7_ids"](spark, data).collect()}
    assert got == {d["doc_id"]: enc.encode_ordinary(d["text"] or "") for d in docs}
    b = bpe.ByteBPE(*bpe.vocabulary())
    for t in ("it's we'll 'tis  x\n\n y", "a" * 5000, "漢字" * 600, " " * 3000, "<|endoftext|>", "​﻿", "é'S", "abcab" * 3000):
        assert b.encode_batch([t, None, ""]) == [enc.encode_ordinary(t), [], []]


def greatest_sum(lengths, counts, budget):
    sums = 1
    for n, c in zip(lengths, counts, strict=True):
        for _ in range(int(c)):
            sums = (sums | sums << int(n)) & ((1 << (budget + 1)) - 1)
    return sums.bit_length() - 1


@pytest.mark.parametrize("kind", ["short", "mixed", "skewed"])
def test_knapsack_is_exact(kind):
    rng = np.random.default_rng(1)
    for i in range(200):
        lengths = rng.integers(1, 30 if kind == "short" else 400, rng.integers(1, 8))
        lengths = np.unique(np.concatenate([lengths, rng.integers(1500, 3000, 2)]) if kind == "skewed" else lengths)
        counts = rng.integers(0, 25, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 5))
        use = mixture.fit(lengths, counts, budget, i)
        assert (use >= 0).all() and (use <= counts).all() and (use * lengths).sum() == greatest_sum(lengths, counts, budget)


def test_knapsack_of_many_lengths():
    for lengths in (np.arange(2, 20_000, 2), np.append(np.arange(2, 20_000, 2), 30_001)):
        counts = np.full(len(lengths), 5)
        budget = int((lengths * counts).sum()) // 2 | 1
        left = budget - int((mixture.fit(lengths, counts, budget) * lengths).sum())
        assert left == (1 if len(lengths) == 9_999 else 0)


def test_mixture(spark, data):
    targets = {t["source"]: t for t in rows(data, "source_targets")}
    uses = queries()["p8_mix"](spark, data).collect()
    total = sum(r.n_tokens for r in uses)
    assert all(0 <= r.uses <= targets[r.source]["max_repeats"] for r in uses)
    got = Counter()
    for r in uses:
        got[r.source] += r.uses * r.n_tokens
    shares = queries()["p8_shares"](spark, data).collect()
    assert {r.source for r in shares} == set(targets)
    for r in shares:
        assert r.reached_tokens == got[r.source] <= r.target_tokens == round(targets[r.source]["target_share"] * total)
        most = sum(x.n_tokens for x in uses if x.source == r.source) * r.max_repeats
        own = Counter(x.n_tokens for x in uses if x.source == r.source)
        whole = sum(n * c for n, c in own.items())
        passes = min(r.max_repeats, r.target_tokens // whole) if whole else 0
        best = greatest_sum(own, own.values(), r.target_tokens - passes * whole) if passes < r.max_repeats else 0
        assert r.reached_tokens == passes * whole + best and r.shortfall_tokens >= r.target_tokens - most


def test_shared_spans(spark, data):
    docs = {d["doc_id"]: d["text"] for d in rows(data, "documents", ["doc_id", "text"]) if len(d["text"] or "") >= 200}
    where = defaultdict(set)
    for k, t in docs.items():
        for i in range(len(t) - 199):
            where[t[i : i + 200]].add(k)
    true = {p for ks in where.values() if len(ks) > 1 for p in combinations(sorted(ks), 2)}
    assert true and run(spark, data, "p9_found") == true
    shares = {r.doc_id: r.shared_chars for r in queries()["p9_share"](spark, data).collect()}
    for k, t in docs.items():
        on = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if len(where[t[i : i + 200]]) > 1:
                on[i : i + 200] = True
        assert shares[k] == on.sum()
