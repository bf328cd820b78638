"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns of the llm operators."""

import random
import re
import unicodedata
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cartulary.llm import bpe, copies, mixture, pairs, pieces, spans
from cartulary.llm.canonical import NoteValues
from cartulary.llm.near import NearDuplicates
from cartulary.llm.queries import queries
from cartulary.llm.spans import SharedSpans

#: Names that the operators use inside.
CLASH = ("key", "text", "digest", "rep", "a", "b", "n", "id", "sig", "token", "list", "v", "s", "f", "entry", "basket", "item", "part", "rank", "hot", "start", "end")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def notes(spark, rows):
    return clashing(spark.createDataFrame(rows, "path string, title string, body string"))


def words(n, seed=0):
    return " ".join(f"w{(i * 7919 + seed) % 10007}" for i in range(n))


def test_near_duplicates(spark):
    base = words(60)
    rows = [
        ("p1", None, base), ("p1", None, base), ("p2", None, base), ("p3", "w1", base.replace("w0 ", "other ")), ("p4", None, words(60, 5)), ("p5", None, ""), ("p6", "t", None),
        ("p7", None, words(19)), (None, None, base), ("p8", None, words(40_000, 3)), ("p9", "x", words(40_000, 3)),
        # lower case, digits and scripts; signs and underscores separate words
        ("q1", None, " ".join(f"Ärger_{i}" for i in range(30))), ("q2", None, "; ".join(f"ärger {i}" for i in range(30))),
    ]
    near = NearDuplicates(notes(spark, rows))
    assert {tuple(r) for r in near.found().collect()} == {("p1", "p2"), ("p1", "p3"), ("p2", "p3"), ("p8", "p9"), ("q1", "q2")}
    groups = {r.key: (r.group_id, r.copies, r.links) for r in near.groups().collect()}
    assert groups["p3"] == ("p1", 1, 1) and groups["p1"] == groups["p2"] == ("p1", 2, 1) and groups["p4"] == ("p4", 1, 0) and set(groups) & {"p5", "p6", "p7"} == set()
    empty = NearDuplicates(notes(spark, []))
    assert empty.found().count() == empty.groups().count() == 0


def test_only_exact_copies_become_stars(spark):
    base = words(60)
    # 102 different texts with the same words (101 by signs, one in capitals), a text alike to them, and 101 exact copies
    forms = [(f"f{i:03}", None, base.replace(" ", "." * i + " ", 1)) for i in range(101)] + [("g", None, base.upper())]
    exact = words(50, 3)
    rows = [*forms, ("h", "w1", base.replace("w0 ", "other ")), *((f"x{i:03}", None, exact) for i in range(101)), ("y", None, exact + " more")]
    near = NearDuplicates(notes(spark, rows))
    alike = sorted([k for k, *_ in forms] + ["h"])
    true = set(combinations(alike, 2)) | {("x000", f"x{i:03}") for i in range(1, 101)} | {("x000", "y")}
    assert {tuple(r) for r in near.found().collect()} == true
    groups = {r.key: (r.rep, r.group_id, r.copies, r.links) for r in near.groups().collect()}
    assert all(groups[k] == (k, "f000", 1, 102) for k in alike) and len(groups) == len(rows)
    assert all(groups[f"x{i:03}"] == ("x000", "x000", 101, 1) for i in range(101)) and groups["y"] == ("y", "x000", 1, 1)


def test_long_lists_are_paired_in_blocks(spark):
    base = words(80)
    rows = [(f"k{i:02}", None, base.replace(f"w{(i * 7919) % 10007} ", f"other{i} ")) for i in range(40)]
    near = NearDuplicates(notes(spark, rows), block=4)
    assert {tuple(r) for r in near.found().collect()} == set(combinations([k for k, *_ in rows], 2))


def test_large_classes_of_copies_become_stars(spark):
    members = spark.createDataFrame([(k, 1, 5) for k in range(1, 6)] + [(8, 8, 2), (9, 8, 2)], "key int, rep int, copies int")
    links = spark.createDataFrame([(1, 8), (1, 20)], "a int, b int")
    got = {tuple(r) for r in copies.spread(links, members, most=3).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (1, 5), (8, 9), (1, 8), (1, 9), (1, 20)}
    full = {tuple(r) for r in copies.spread(links, members).collect()}
    assert len(full) == 10 + 1 + 10 + 5


def test_pieces(spark):
    rows = [("a", None, None), ("b", None, ""), ("c", None, "x" * 4000), ("d", None, "y " * 3000), ("d", None, "y " * 3000), (None, None, "z" * 5000), ("long", None, "wort. " * 200_000)]
    out = pieces.pieces(notes(spark, rows)).collect()
    assert {r.path for r in out} == {"d", None, "long"} and sum(r.path == "d" for r in out) == 2
    assert {r.boundary for r in out if r.path is None} == {"forced", "end"}
    assert pieces.pieces(notes(spark, [])).count() == 0
    fenced = "# A\n\n" + "```\n# no\n\n" + "x\n" * 1500 + "```\n" + "## B\n" + "y " * 1500
    assert [k for *_, k in pieces.cut(fenced)] == ["heading", "end"]


def test_values(spark):
    types = clashing(spark.createDataFrame([("Alpha", ["open", "opem"]), ("Beta", []), ("Gamma", None), (None, ["x"]), ("Alpha", ["open", "opem"])], "name string, allowed_statuses array<string>"))
    rows = [
        ("1", "alpha", "opex"), ("1", "alpha", "opex"), ("2", None, "OPEN"), ("3", "  ", "open"), ("4", "Beta", "whatever"), ("5", "Gamma", "whatever"), ("6", "zzzzzz", "opez"), ("7", "Álphä!", None), ("8", "Alpha", ""),
        ("9", "", "́"), ("10", "Alph" + "a" * 5000, "op"), (None, "alpha", "open"),
    ]
    files = clashing(spark.createDataFrame(rows, "path string, type string, status string"))
    got = {tuple(r) for r in NoteValues(files, types).found().collect()}
    assert got == {
        ("1", "type", "Alpha"), ("1", "status", "opem"), ("2", "status", "open"), ("6", "type", ""), ("6", "status", "opem"), ("7", "type", "Alpha"), ("9", "status", ""),
        ("10", "type", ""), ("10", "status", ""), (None, "type", "Alpha"),
    }
    v = NoteValues(files, types)
    assert {(r.field, r.value) for r in v.unmatched().collect()} == {("type", "zzzzzz"), ("type", "Alph" + "a" * 5000), ("status", "́"), ("status", "op")}
    assert NoteValues(files.limit(0), types).found().count() == 0
    assert {r.entry for r in NoteValues(files, types.limit(0)).found().collect()} <= {""}


@pytest.mark.parametrize("block", [2, 256])
def test_pairs(spark, block):
    decomposed = unicodedata.normalize("NFD", "é")
    rows = [(p, t) for p in "123456" for t in ("A", " b ", "c")] + [("1", "é"), ("2", decomposed), ("2", "É"), ("1", None), (None, "a"), ("3", "  "), ("4", "d"), ("4", "e"), ("4", "f"), ("1", "a")]
    tags = clashing(spark.createDataFrame(rows, "path string, tag string"))
    got = {(r.a, r.b): (r.both, r.n_a, r.n_b, r.n) for r in pairs.cooccurrence(tags, block=block).collect()}
    assert got[("a", "b")] == (6, 6, 6, 6) and got[("a", "é")] == (2, 6, 2, 6) and got[("d", "f")] == (1, 1, 1, 6) and len(got) == 3 + 3 + 9 + 3
    assert pairs.cooccurrence(tags, least=6, block=block).count() == 3
    one = pairs.cooccurrence(tags).filter("a = 'd' AND b = 'e'").first()
    assert one.lift == 6.0 and abs(one.pmi - 2.584962500721156) < 1e-12
    assert pairs.cooccurrence(tags.limit(0)).count() == 0


def test_ids(spark):
    df = clashing(spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x"), (5, "ab" * 300_000)], "doc_id bigint, text string"))
    out = bpe.encode(df, *bpe.vocabulary()).collect()
    ids = [(r.doc_id, r.ids) for r in out if r.doc_id != 5]
    assert sorted((k or 0, v) for k, v in ids) == [(0, [87]), (1, []), (2, []), (3, [64, 275]), (3, [64, 275])]
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(df, *bpe.vocabulary()).collect()}
    assert counts[5] == len(next(r.ids for r in out if r.doc_id == 5)) and counts[1] == 0
    assert bpe.encode(df.limit(0), *bpe.vocabulary()).count() == 0
    slow = bpe.ByteBPE(bpe.vocabulary()[0], r"\S+|\s+")  # any other pattern goes through the regular expression
    assert slow.encode_batch(["a b", None]) == [[64, 220, 65], []]


def mix(spark, docs, targets):
    d = clashing(spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint"))
    return mixture.Mixture(d, clashing(spark.createDataFrame(targets, "source string, target_share double, max_repeats int")))


def test_mixture(spark):
    docs = [(i, "a", 10) for i in range(1000)] + [(2000 + i, "b", 1 + i % 7) for i in range(70)] + [(1, "a", 10), (3000, None, 5), (3001, "other", 5), (3002, "b", 0), (None, "a", 1)]
    m = mix(spark, docs, [("a", 0.5, 3), ("b", 0.4, 3), ("none", 0.1, 2), (None, 0.5, 1), ("zero", None, None)])
    s = {r.source: r for r in m.shares().collect()}
    assert m.budget == 10_280 and s["a"].reached_tokens == 5140 and s["b"].reached_tokens == 3 * 280 and s["b"].shortfall_tokens == 4112 - 840
    assert s["none"].reached_tokens == s["zero"].target_tokens == 0 and s["none"].shortfall_tokens == 1028
    uses = m.uses().collect()
    assert len(uses) == 1071 and sum(r.uses for r in uses if r.source == "a") == 514 and {r.uses for r in uses if r.source == "b"} == {3}
    assert [tuple(r) for r in sorted(mix(spark, docs, [("a", 0.5, 3), ("b", 0.4, 3), ("none", 0.1, 2)]).uses().collect())] == sorted(map(tuple, uses))
    repeated = mix(spark, [(1, "a", 100), (2, "b", 10), (3, "b", 7)], [("a", 0.2, 1), ("b", 0.8, 5)])
    assert {r.doc_id: r.uses for r in repeated.uses().collect()} == {1: 0, 2: 5, 3: 5}
    empty = mix(spark, [], [("a", 1.0, 1)])
    assert empty.uses().count() == 0 and empty.shares().first().reached_share is None and mix(spark, docs, []).shares().count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_shared_spans(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(spans, "HOT_CHUNK", 1), monkeypatch.setattr(spans, "HOT", 2)
    monkeypatch.setattr(spans, "CHUNK", 2_000)
    import random

    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefgh 漢😀") for _ in range(n))
    p200, p199, long_ = text(200), text(199), text(5000)
    two = text(7) + "2" + p200
    docs = [
        (1, text(50) + "1" + p200 + "1"), (2, two), (2, two), (3, "3" + p199 + "3"), (4, "4" + p199 + "4"), (5, long_), (6, long_), (7, text(900) + "7" + long_[100:4000] + "7"),
        (8, None), (9, ""), (10, p200[:150]), (None, p200), (11, "a" * 3000), (12, "b" + "a" * 1000), (13, "abc" * 400), (14, p200 + p200),
    ]
    s = SharedSpans(clashing(spark.createDataFrame(docs, "doc_id bigint, text string")), buckets=5)
    true = {(1, 2), (1, 14), (2, 14), (5, 6), (5, 7), (6, 7), (11, 12)}
    assert {tuple(r) for r in s.pairs().collect()} == true
    share = {r.key: r.shared_chars for r in s.coverage().collect()}
    assert share == {1: 200, 2: 200, 3: 0, 4: 0, 5: 5000, 6: 5000, 7: 3900, 8: 0, 9: 0, 10: 0, 11: 3000, 12: 1000, 13: 0, 14: 400}
    empty = SharedSpans(spark.createDataFrame([], "doc_id bigint, text string"))
    assert empty.pairs().count() == empty.coverage().count() == 0


def maximal_spans(docs, least=200):
    out = set()
    for (i, x), (j, y) in ((p, q) for p in docs.items() for q in docs.items() if p[0] < q[0]):
        for diag in range(least - len(x), len(y) - least + 1):
            lo, hi = max(0, -diag), min(len(x), len(y) - diag)
            same = "".join("1" if x[k] == y[k + diag] else "0" for k in range(lo, hi))
            out |= {(i, lo + m.start(), j, lo + m.start() + diag, m.end() - m.start()) for m in re.finditer("1{%d,}" % least, same)}
    return out


@pytest.mark.parametrize("most", [2, 100])
def test_spans_of_copies(spark, monkeypatch, most):
    monkeypatch.setattr(spans, "SPREAD", most)
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("abcdefgh 漢😀") for _ in range(n))
    p, alone, twice = text(230), text(300), text(210)
    own, other = text(40) + p + text(30), text(11) + p
    # 2 and 3 are copies alike to nothing else, 4, 6 and 9 share a passage with 5, 7 and 8 repeat one within
    docs = {2: alone, 3: alone, 4: own, 6: own, 9: own, 5: other, 7: twice + "x" + twice, 8: twice + "x" + twice, 10: "a" * 202, 11: "a" * 202}
    s = SharedSpans(clashing(spark.createDataFrame([*docs.items(), (2, alone)], "doc_id bigint, text string")), buckets=5).spans()
    assert s.columns == ["a", "start_a", "b", "start_b", "length"]
    true = maximal_spans(docs)
    if most == 2:  # the class of three is a star
        true = {r for r in true if (r[0], r[2]) in {(2, 3), (4, 5), (4, 6), (4, 9), (7, 8), (10, 11)}}
    got = [tuple(r) for r in s.collect()]
    assert (7, 0, 8, 211, 210) in true and (7, 211, 8, 0, 210) in true and len(got) == len(set(got)) and set(got) == true


def test_pairs_of_large_classes_follow_from_the_classes(spark, tmp_path):
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    p, q = text(220), text(250)
    docs = {k: p + "x" for k in range(10, 112)} | {1: "y" + p, 2: p + q, 3: q, 4: q, 5: text(300), 6: "short"}
    spark.createDataFrame([*docs.items(), (5, docs[5]), (7, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries()["p9_copies"](spark, str(tmp_path)).collect()
    got = {r.doc_id: (r.rep, r.copies, r.links) for r in rows}
    true = {k: (10, 102, 2) for k in range(10, 112)} | {1: (1, 1, 2), 2: (2, 1, 3), 3: (3, 2, 1), 4: (3, 2, 1), 5: (5, 1, 0)}
    assert rows[0].asDict().keys() == {"doc_id", "rep", "copies", "links"} and len(rows) == len(got) and got == true
    # with them, the pairs of all members follow from those of representatives
    found = {tuple(r) for r in queries()["p9_found"](spark, str(tmp_path)).collect()}
    members = {r: [k for k, v in got.items() if v[0] == r] for r, *_ in got.values()}
    every = {tuple(sorted((x, y))) for a, b in found for x in members[got[a][0]] for y in members[got[b][0]] if x != y}
    assert (10, 11) in found and (11, 12) not in found and every == {(a, b) for a, b in combinations(sorted(docs), 2) if any(docs[a][i : i + 200] in docs[b] for i in range(len(docs[a]) - 199))}


def test_spans_are_whole_where_hot_windows_join_them(spark, monkeypatch):
    monkeypatch.setattr(spans, "HOT_CHUNK", 2), monkeypatch.setattr(spans, "HOT", 4)
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("abcdefgh 漢😀") for _ in range(n))
    head, tail, middle, last = text(300), text(450), text(1500), text(280)
    # boilerplate of many begins, ends and interrupts what only 1 and 2 share
    docs = {1: text(20) + head + middle + tail + middle[::-1] + last, 2: text(70) + head + middle + tail + middle[::-1] + last}
    docs |= {k: text(3 * k) + p + text(k) for k, p in enumerate([head, tail, last] * 6, 3)}
    s = SharedSpans(clashing(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")), buckets=5).spans()
    got = sorted(tuple(r) for r in s.collect())
    whole = next(r for r in got if r[::2][:2] == (1, 2))
    assert whole[4] >= 300 + 1500 + 450 + 1500 + 280 and got == sorted(maximal_spans(docs))


def test_long_runs_of_one_character_give_their_diagonals(spark):
    n = 3_000
    docs = [(1, "x" + "=" * n), (2, "some words " + "=" * n + " and more"), (3, "plain")]
    s = SharedSpans(spark.createDataFrame(docs, "doc_id bigint, text string"))
    got = {tuple(r) for r in s.spans().collect()}
    true = {(1, 1 + max(0, -d), 2, 11 + max(0, d), n - abs(d)) for d in range(200 - n, n - 199)}
    assert got == true and [tuple(r) for r in s.pairs().collect()] == [(1, 2)]


def test_classes_of_windows_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spans, "HOT_CHUNK", 2), monkeypatch.setattr(spans, "HOT", 4), monkeypatch.setattr(spans, "BLOCK", 3)
    rnd = random.Random(5)
    text = lambda n: "".join(rnd.choice("abcd") for _ in range(n))
    head = text(210)
    docs = {k: text(k % 4) + head + text(9) for k in range(40)}
    s = SharedSpans(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"))
    got = [tuple(r) for r in s.spans().collect()]
    assert sorted(got) == sorted(maximal_spans(docs)) and {tuple(r) for r in s.pairs().collect()} == set(combinations(range(40), 2))


def test_difference_cover_brings_any_two_positions_together():
    for n in (20, 60, 200, 1000):
        period, points = spans.cover(n)
        assert {(x - y) % period for x in points for y in points} == set(range(period)) and period < n
