"""Operators of the core over small literal corpora."""

import inspect
import json
import random
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cartulary.functions import headings as H
from cartulary.functions import paths as P
from cartulary.functions import text as T
from cartulary.functions.front import build_raw, parse, parse_files
from cartulary.operators import checks as C
from cartulary.operators import diff as D
from cartulary.operators import generate as G
from cartulary.operators import graph, history, plan, references, search, snapshots
from cartulary.operators import links as L
from cartulary.operators import schema as S
from cartulary.plans.facade import Workspace, answer, impact_risk
from cartulary.sources import corpus, sinks
from cartulary.streaming.feed import Feed, reconcile, state_of

FILES = "path string, raw string"
NOTE = "---\ntype: Nota\ntitle: {0}\n---\n\n# {0}\n\n{1}\n"


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def paths(df, c="path"):
    return sorted(r[c] for r in df.collect())


def corpus_of(spark, **notes):
    return spark.createDataFrame([(k.replace("__", "/") + ".md", v) for k, v in notes.items()], FILES)


@pytest.fixture(scope="module")
def issues(spark):
    return spark.createDataFrame(
        [
            ("index.md", "---\nokf_version: \"0.1\"\n---\n\n# B\n\n* [ok](ok.md)\n"),
            ("sub/index.md", "---\nx: 1\n---\n"),
            ("log.md", "# Log\n\n## 2024-01-02\n\n## ayer\n"),
            ("ok.md", NOTE.format("Ok", "[x](/none/new-page.md) [self](ok.md) [b](./rel.md)")),
            ("plain.md", "no front matter"),
            ("open.md", "---\ntype: a\n"),
            ("broken.md", "---\ntype: [a\n---\n"),
            ("rel.md", "---\ntype: ' '\ntags: a\ntimestamp: 2024-13-01\n---\ntext\n=======\n"),
            ("twice.md", "---\ntype: a\ntype: b\n---\n# x\n"),
        ],
        FILES,
    )


def test_paths(spark):
    f = F.lit
    assert one(spark, P.normalize(f("a/./b//../c")), P.normalize(f("../a")), P.dir_of(f("a/b/c.md")), P.dir_of(f("c.md"))) == ("a/c", "a", "a/b/", "")
    assert one(spark, *(P.rel_path(f(x)) for x in ("a//./b.md", "/a.md", "a\\b", "../a", "C:/x", "", "."))) == ("a/b.md", *[None] * 6)
    assert one(spark, P.title_from_path(f("x/año_nuevo-foo.bar.md"))) == ("AñO Nuevo Foo.Bar",)
    href = {"http://x/a.md": None, "#a": None, "b.md#x?y": "d/b.md", "../c/": "c/index.md", "/./a.md": "./a.md", "a.txt": None, "mailto:a.md": None, "": None}
    assert one(spark, *(P.resolve_link(f(h), f("d/a.md")) for h in href)) == tuple(href.values())


def test_iso_and_snippets(spark):
    values = {"2024-01-15": True, "2024-02-31": True, "2024-01-15T24:30": True, "2024-01-15hello": False, "2024-01-15T99:99": False, "2024-13-01": False, "0000-01-01": False, "2024-01-15 10:00:00.5+0200": True}
    assert one(spark, *(T.is_iso(F.lit(v)) for v in values)) == tuple(values.values())
    text = F.lit("a" * 50 + " NEEDLE  \n needle" + "b" * 300)
    snip, n, none = one(spark, T.snippet(text, "needle"), T.occurrences(text, "needle"), T.occurrences(text, ""))
    assert snip[0] == snip[-1] == "…" and len(snip) == 162 and snip[31:37] == "NEEDLE" and (n, none) == (2.0, 1.0)
    assert one(spark, T.slug(F.lit(" Cafe\u0301 / Y'a ")), T.slug(F.lit("--"))) == ("café-y-a", "tag")
    assert one(spark, T.field_line(F.lit("---\na: 1\nb: 2\n---\n"), "b"), T.version(F.lit('okf_version: "0.3"\n'))) == (3, "0.3")


def test_yaml_core_schema():
    p = {x["key"]: x for x in parse("title: 2024-01-15\nx: yes\nn: 010\nh: 0x10\nf: 1e3\nz: ~\ntags: [a, 1, null]\nm: {a: 1}\ntype: 12\ncustom: !t v\n")["pairs"]}
    assert [p[k]["scalar"] for k in ("title", "x", "n", "h", "f", "z", "type", "custom")] == ["2024-01-15", "yes", "10", "16", "1000", "", "12", "v"]
    assert p["tags"]["items"] == ["a", "1", ""] and p["m"]["tag"] == "map" and p["z"]["tag"] == "null"
    assert list(p)[:3] == ["type", "title", "tags"]
    assert parse("a: [1")["error"] and parse("a: 1\na: 2")["error"] and parse("- 1")["pairs"] == [] and parse("")["error"] is None
    assert build_raw({"x": "", "status": "s", "title": "t", "tags": []}, "B") == "---\ntitle: t\nstatus: s\n---\nB"


def test_checks(issues):
    p = parse_files(issues)
    checks = C.analyze(p, L.out_links(p))
    got = {(r.path, r.code) for r in checks.collect() if r.level != "pass"}
    assert got == {
        ("sub/index.md", "OKF-IDX"), ("log.md", "OKF-LOG"), ("plain.md", "OKF-FM01"), ("open.md", "OKF-FM02"), ("broken.md", "OKF-FM03"), ("twice.md", "OKF-FM03"),
        ("rel.md", "OKF-CONFLICT"), ("rel.md", "OKF-TYPE"), ("rel.md", "REC-TITLE"), ("rel.md", "REC-DESC"), ("rel.md", "FMT-TAGS"), ("rel.md", "FMT-TS"), ("rel.md", "BODY-STRUCT"),
        ("ok.md", "REC-DESC"), ("ok.md", "LINK-REL"), ("ok.md", "LINK-STUB"),
    }
    assert tuple(C.hard_fail(checks).first()) == (5, 4)
    assert paths(L.orphans(L.out_links(p), p)) == ["broken.md", "open.md", "plain.md", "twice.md"]
    assert [tuple(r) for r in L.dangling(L.out_links(p), p).collect()] == [("ok.md", "none/new-page.md")]
    assert {r.level for r in C.worst(checks).collect()} == {"err", "warn", "info"} and C.page(checks, "err").count() == 6


def test_query_language(spark, issues):
    tokens = [(t.field, t.value, t.exact, t.negated) for t in search.tokenize('type:a -x="b c" :foo y:!z -')]
    assert tokens == [("type", "a", False, False), ("x", "b c", True, True), (None, "foo", False, False), ("y", "z", False, True), (None, "", False, True)]
    p = parse_files(issues)
    own = {"orphan": L.orphans(L.out_links(p), p)}
    hit = lambda q: paths(search.select(p, q, **own))
    assert hit("type:nota") == hit("type=NOTA") == ["ok.md"]
    assert len(hit("")) == 9 and len(hit("-type:nota")) == 5 and hit("is:reserved") == ["index.md", "log.md", "sub/index.md"]
    assert hit("has:tags") == ["rel.md"] and "rel.md" not in hit("no:tags") and hit("is:orphan plain") == ["plain.md"]
    assert hit("body:ayer") == ["log.md"] and hit(":ayer") == ["log.md"] and hit("is:what") == [] and len(hit("-is:what")) == 6
    assert search.offset_of("zz") == 0 and search.offset_of(search.cursor_of(40)) == 40


def test_headings():
    body = "# A\n\n```\n# no\n```\n\n## B ##\n\nx\n\n#nothing\n# C\ny\n"
    own = H.headings(body)
    assert [(h["level"], h["title"]) for h in own] == [(1, "A"), (2, "B ##"), (1, "C")]
    a, b = H.section(body, ["A", "B ##"])
    assert body[a:b] == "\nx\n\n#nothing\n" and H.section(body, ["C", "B ##"]) is None and H.section(body, []) is None


def brute_components(edges, nodes):
    up = {n: n for n in nodes}
    for a, b in edges:
        up.setdefault(a, a), up.setdefault(b, b)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {n: find(n) for n in up}


def brute_reach(edges, a):
    seen, todo = set(), [a]
    while todo:
        for x, y in edges:
            if x == todo[0] and y not in seen:
                seen.add(y)
                todo.append(y)
        todo.pop(0)
    return seen


@pytest.mark.parametrize(("seed", "in_task"), [(1, 300_000), (2, 300_000), (3, 0), (4, 6)])
def test_graph_against_brute_force(spark, monkeypatch, seed, in_task):
    monkeypatch.setattr(graph, "IN_TASK", in_task)
    rnd = random.Random(seed)
    edges = sorted({(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(16)})
    df = spark.createDataFrame(edges, "src string, dst string")
    nodes = spark.createDataFrame([("alone",)], "node string")
    assert {r.node: r.component for r in graph.components(df, nodes).collect()} == brute_components(edges, ["alone"])
    reach = {a: brute_reach(edges, a) for a, _ in edges}
    true = {a: min(b for b in r | {a} if b in reach and a in reach[b] or b == a) for a, r in reach.items() if a in r}
    assert {r.node: r.cycle for r in graph.cycles(df).collect()} == true
    got = graph.reach(df, spark.createDataFrame([(edges[0][0],)], "node string"), "out")
    assert {r.node for r in got.collect()} == reach[edges[0][0]] | {edges[0][0]}


@pytest.mark.parametrize("in_task", [0, 300_000])
def test_shortest_path_is_the_least(spark, monkeypatch, in_task):
    monkeypatch.setattr(graph, "IN_TASK", in_task)
    df = spark.createDataFrame([("a", "z"), ("a", "b"), ("b", "d"), ("z", "d"), ("d", "e"), ("e", "a")], "src string, dst string")
    assert [r.node for r in graph.shortest_path(df, "a", "e").orderBy("pos").collect()] == ["a", "b", "d", "e"]
    assert graph.shortest_path(df, "e", "x").count() == 0 and graph.components(df.limit(0)).count() == 0 and graph.cycles(df.limit(0)).count() == 0


@pytest.mark.parametrize("in_task", [0, 300_000])
def test_shortest_path_never_ends_early_without_saying_so(spark, monkeypatch, in_task):
    monkeypatch.setattr(graph, "IN_TASK", in_task)
    df = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(4)], "src string, dst string")
    assert inspect.signature(graph.shortest_path).parameters["longest"].default is None
    assert graph.shortest_path(df, "n0", "n4", longest=4).count() == graph.shortest_path(df, "n0", "n4").count() == 5
    assert graph.shortest_path(df, "n0", "x", longest=4).count() == 0
    with pytest.raises(Exception, match="at most 3 steps"):
        graph.shortest_path(df, "n0", "n4", longest=3).collect()


def test_schema(spark):
    p = parse_files(
        corpus_of(spark, a="---\ntype: task\ntitle:\nstatus: odd\nowner: [b.md, none.md, c.md]\n---\n", b="---\ntype: team\n---\n", c="---\ntype: task\nrationale:\ntitle: t\n---\n")
    )
    types = spark.createDataFrame([("task", ["title", "rationale"], ["open"], None)], S.TYPES)
    got = {(r.path, r.code, r.msg.split(": ")[1]) for r in S.schema_checks(p, types).collect()}
    assert got == {("a.md", "SCHEMA-REQFIELD", "title"), ("a.md", "SCHEMA-REQFIELD", "rationale"), ("a.md", "SCHEMA-STATUS", "odd")}
    rel = spark.createDataFrame([("task", "owner", ["team"], "one")], S.RELATIONS)
    assert sorted((r.path, r.code) for r in S.relation_checks(p, rel).collect()) == [("a.md", "REL-CARD"), ("a.md", "REL-TARGET"), ("a.md", "REL-TYPE")]
    assert [tuple(r)[:4] for r in S.broken_relations(p, rel).collect()] == [("a.md", "owner", "none.md", 5)]
    assert paths(S.blocking_relations(p, rel, "b.md")) == ["a.md"]


def test_generated_pages(spark):
    files = corpus_of(spark, a="---\ntype: N\ntitle: A\ntags: [Foo, foo, x]\n---\n", sub__doc_10="---\ntags: [x]\ndescription: d\n---\n", sub__doc_2="---\ntags: x\n---\n", tags__old__index="x")
    p = parse_files(files)
    pages = {r.path: r.content for r in G.index_pages(p).collect()}
    assert pages["sub/index.md"] == "# sub\n\n# Concept\n\n* [doc_10](doc_10.md) - d\n* [doc_2](doc_2.md)\n"
    assert pages["index.md"] == '---\nokf_version: "0.1"\n---\n\n# Bundle\n\n# N\n\n* [A](a.md)\n\n# Subdirectorios\n\n* [sub/](sub/)\n* [tags/](tags/)\n'
    tags = {r.path: r.content for r in G.tag_pages(p).collect()}
    assert tags["tags/x/index.md"] == "# x\n\n* [A](/a.md)\n* [doc_2](/sub/doc_2.md)\n* [doc_10](/sub/doc_10.md) - d\n"
    assert set(tags) == {"tags/index.md", "tags/foo/index.md", "tags/foo-2/index.md", "tags/x/index.md"} and "# foo\n" in tags["tags/foo/index.md"]
    assert paths(G.stale_pages(files, G.tag_pages(p))) == ["tags/old/index.md"]
    slugs = G.tag_slugs(spark.createDataFrame([("a",), ("A",), ("a-2",), ("A-2",), (None,)], "tag string"))
    assert len({r.slug for r in slugs.collect()}) == 4


def test_line_diff():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = (["abc"[rnd.randrange(3)] for _ in range(rnd.randrange(9))] for _ in range(2))
        d = D.line_diff("\n".join(a), "\n".join(b))
        assert "\n".join(t for o, t in d if o != "add") == "\n".join(a) and "\n".join(t for o, t in d if o != "del") == "\n".join(b)
    d = D.collapse(D.line_diff("\n".join(map(str, range(20))), "\n".join([*map(str, range(19)), "x"])))
    assert d == [("gap", "17"), ("equal", "17"), ("equal", "18"), ("del", "19"), ("add", "x")]
    own = lambda x: D.collapse([("equal" if c == "." else "add", c) for c in x])
    assert [o[0] + t for o, t in own("......+......+....+.....")] == ["g4", "e.", "e.", "a+", "e.", "e.", "g2", "e.", "e.", "a+", "e.", "e.", "e.", "e.", "a+", "e.", "e.", "g3"]
    assert D.line_diff("x\ny", "y\ny") == [("del", "x"), ("equal", "y"), ("add", "y")]  # equal as early as it goes
    # beyond the guard nothing is compared, equal lines neither
    assert len(D.line_diff("a\n" * 2000, "b\n" * 2000)) == 4002


def test_state_diff(spark):
    a = corpus_of(spark, a=NOTE.format("A", "x"), b=NOTE.format("B", "[a](a.md)"), gone="x", index="i")
    b = corpus_of(spark, a=NOTE.format("A2", "x"), b=NOTE.format("B", "[a](/a.md) [n](n.md)"), new="y", index="j")
    d = D.file_diff(a, b)
    assert {(r.path, r.change) for r in d.collect()} == {("a.md", "modified"), ("b.md", "modified"), ("gone.md", "removed"), ("new.md", "added"), ("index.md", "modified")}
    assert {r.change: r.n for r in D.stats(d).collect()} == {"modified": 2, "removed": 1, "added": 1} and D.with_lines(d).count() == 4
    assert [(r.path, r.field, r.before, r.after) for r in D.field_changes(parse_files(a), parse_files(b)).collect()] == [("a.md", "title", "A", "A2")]
    assert [tuple(r) for r in D.link_changes(L.out_links(parse_files(a)), L.out_links(parse_files(b))).collect()] == [("b.md", "n.md", "added")]
    merged = {r.path: r.conflict for r in D.three_way(a, b, a.filter("path <> 'gone.md'")).collect()}
    assert merged == {"a.md": False, "b.md": False, "index.md": False, "new.md": False}
    assert D.three_way(a, b, corpus_of(spark, a="other")).filter("conflict").count() == 3


def snap(spark, *rows):
    import datetime as dt

    t = lambda n: dt.datetime(2024, 1, n)
    return spark.createDataFrame([(s, p, h, j, t(n)) for s, p, h, j, n in rows], "snap_no int, path string, hash binary, frontmatter_json string, loaded_at timestamp")


def test_snapshot_changes(spark):
    b = lambda s: s.encode()
    rows = [
        (1, "a", b("1"), '{"x": 1, "y": "\\u00e9"}', 1), (2, "a", b("1"), '{"y":"é","x":1}', 2), (3, "a", b("1"), '{"x":1,"y":null}', 3), (3, "a", b("1"), '{"x":1,"y":null}', 3),
        (1, "b", b("1"), None, 1), (2, "b", None, "{}", 2), (3, "b", b("2"), "{}", 3),
        (2, "c", b("1"), "{}", 9), (2, "c", b("0"), "{}", 2), (3, "c", b("1"), "[not json", 3),
        (1, "d", b("1"), "{}", 1), (3, "d", b("1"), "{}", 3), (1, None, b("1"), "{}", 1), (None, "e", b("1"), "{}", 1),
    ]
    taken = spark.createDataFrame([(1,), (2,), (3,), (4,)], "snap_no int")
    got = {tuple(r) for r in snapshots.snapshot_changes(snap(spark, *rows), taken).collect()}
    gone = {(4, k, "removed") for k in "abcd"}
    assert got == gone | {(3, "a", "changed"), (2, "c", "added"), (3, "c", "changed"), (2, "d", "removed"), (3, "d", "added")}
    assert snapshots.snapshot_changes(snap(spark), taken).count() == 0 and snapshots.snapshot_changes(snap(spark), taken.limit(0)).count() == 0


def test_orphan_references(spark):
    import datetime as dt

    t = lambda n: dt.datetime(2024, n, 1)
    links = spark.createDataFrame(
        [(1, "a", "x", t(1)), (1, "a", "x", t(1)), (2, "a", "late", t(2)), (3, "gone", "a", t(3)), (4, None, None, t(1)), (5, "a", "late", t(6)), (6, "a", "late", None), *[(100 + i, "a", "hot", t(5)) for i in range(60)]],
        "link_id bigint, src string, dst string, seen_at timestamp",
    )
    files = spark.createDataFrame([("a", t(1)), ("a", t(1)), ("late", t(4)), (None, t(1))], "path string, first_seen timestamp")
    history = spark.createDataFrame([("gone",), ("gone",), (None,)], "path string")
    got = references.orphan_references(links, files, history)
    hot = {(100 + i, "dst", "missing") for i in range(60)}
    assert {(r.link_id, r.side, r.reason) for r in got.collect()} == hot | {(1, "dst", "missing"), (2, "dst", "late"), (3, "src", "deleted")}
    assert {(r.side, r.reason, r.month): r.n for r in references.orphan_report(got).collect()}[("dst", "missing", "2024-05")] == 60
    assert references.orphan_references(links.limit(0), files, history).count() == 0
    assert references.orphan_references(links, files.limit(0), history.limit(0)).filter("reason <> 'missing'").count() == 0


def test_reference_counts_follow_deltas(spark, tmp_path):
    """Counts kept from random deltas equal those of the whole, first times too."""
    import datetime as dt

    rnd, day = random.Random(5), lambda n: dt.datetime(2024, 1, n)
    state, refs, there, past = references.ReferenceState(spark, str(tmp_path / "state")), [], {}, set()
    rows = "link_id int, path string, seen_at timestamp"
    for batch in range(4):
        came = [(i, f"p{rnd.randrange(5)}", day(rnd.randrange(1, 28))) for i in range(8)]
        went = [refs.pop(rnd.randrange(len(refs))) for _ in range(min(6, len(refs)))]
        refs += came
        add = {f"p{rnd.randrange(5)}": day(rnd.randrange(1, 28)) for _ in range(2)}
        add = {k: v for k, v in add.items() if k not in there}
        drop = {k: there.pop(k) for k in list(there) if rnd.random() < 0.4}
        there |= add
        past |= set(drop)
        delta = [references.reference_deltas(spark.createDataFrame(x, rows), n) for x, n in ((came, 1), (went, -1))]
        delta += [references.record_deltas(spark.createDataFrame(list(x.items()), "path string, seen timestamp"), "seen", n) for x, n in ((add, 1), (drop, -1))]
        delta.append(references.record_deltas(spark.createDataFrame([(k,) for k in drop], "path string"), current=False))
        for _ in range(2):  # delivered twice
            state.apply(batch, *delta)
        true = {}
        for k in {p for _, p, _ in refs}:
            first = min(t for _, p, t in refs if p == k)
            reason = ("deleted" if k in past else "missing") if k not in there else "late" if there[k] > first else None
            if reason:
                true[k] = (sum(p == k for _, p, _ in refs), reason)
        assert {r.path: (r.refs, r.reason) for r in references.orphan_keys(state.counts()).collect()} == true
    assert state.counts().filter("n = 0").count() == 0


def planned(p, *ops):
    return {r.path: r.content for r in p.mutation(list(ops)).collect()}


def test_plans(spark):
    files = corpus_of(
        spark, a=NOTE.format("A", "## S\n\nold\n\n## T"), d__b=NOTE.format("B", '[a](../a.md#x "t") [a](/a.md) [o](c.md)'), d__c=NOTE.format("C", "[b](b.md)"), index="* [a](a.md)\n"
    )
    p = plan.Planner(files, spark.createDataFrame([("N", [], [], "# {title}\n")], S.TYPES))
    move = {"op": "move", "from": "a.md", "to": "e/f.md", "rewriteInboundLinks": True}
    out = planned(p, move)
    # index pages stay as they are, and so does everything if links aren't to be rewritten
    assert out["a.md"] is None and "[a](../e/f.md#x) [a](/e/f.md) [o](c.md)" in out["d/b.md"] and set(out) == {"a.md", "e/f.md", "d/b.md"}
    assert set(planned(p, {"op": "move", "from": "a.md", "to": "e/f.md"})) == {"a.md", "e/f.md"}
    assert "[o](./z.md)" in planned(p, {"op": "move", "from": "d/c.md", "to": "d/z.md", "rewriteInboundLinks": True})["d/b.md"]
    out = planned(p, {"op": "create", "path": "n.md", "type": "N", "title": "Neu"}, {"op": "create", "path": "x/a-new_one.md", "type": "M"}, {"op": "create", "path": "e.md", "type": "N", "body": ""})
    assert out["n.md"] == "---\ntype: N\ntitle: Neu\n---\n# Neu\n" and out["x/a-new_one.md"] == "---\ntype: M\ntitle: A New One\n---\n# A New One\n" and out["e.md"].endswith("---\n")
    edit = lambda mode: planned(p, {"op": "edit_section", "path": "a.md", "headingPath": ["A", "S"], "mode": mode, "content": " new\n"})["a.md"]
    assert "## S\n\nnew\n\n## T" in edit("replace") and "## S\n\nold\n\nnew\n\n## T" in edit("append") and "## S\n\nnew\nold\n\n## T" in edit("prepend")
    # text is replaced in the body only, and none where it isn't there
    assert planned(p, {"op": "replace_text", "path": "a.md", "find": "zzz", "replace": ""}) == {}
    new = planned(p, {"op": "replace_text", "path": "a.md", "find": "A", "replace": "Z", "expectedOccurrences": 1})["a.md"]
    assert "title: A\n" in new and "# Z\n" in new
    for code, bad in {
        "INVALID_SCHEMA": {"op": "what"}, "INVALID_SCHEMA ": {"op": "create", "path": "../x.md"}, "INBOUND_LINKS_EXIST": {"op": "delete", "path": "a.md"},
        "WRITE_CONFLICT": {"op": "replace_text", "path": "a.md", "find": "old", "replace": "", "expectedOccurrences": 2}, "CONCEPT_NOT_FOUND": {"op": "replace_body", "path": "no.md"},
        "REVISION_CONFLICT": {"op": "replace_body", "path": "a.md", "expectedRevision": "sha256:0"}, "CONCEPT_NOT_FOUND ": {"op": "edit_section", "path": "a.md", "headingPath": ["no"]},
    }.items():
        with pytest.raises(plan.PlanError) as e:
            p.mutation([bad]).collect()
        assert e.value.code == code.strip()
    only_index = plan.Planner(corpus_of(spark, a="x", index="* [a](a.md)\n"))
    assert planned(only_index, {"op": "delete", "path": "a.md"}) == {"a.md": None}
    m = p.mutation([move, {"op": "create", "path": "n.md"}])
    after = plan.simulate(files, m)
    back = plan.simulate(after, plan.restore(files, after))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, files.collect()))


def test_operations_of_one_change_set_add_up(spark):
    files = corpus_of(spark, a="---\ntype: N\ntitle: A\nstatus: draft\nown:\n---\nold text [b](b.md)\n", b=NOTE.format("B", ""), c=NOTE.format("C", "[a](a.md) [b](b.md)"), d=NOTE.format("D", "[b](/b.md)"))
    p = plan.Planner(files)
    patch, text = {"op": "patch_frontmatter", "path": "a.md", "patch": {"status": "final", "title": None}}, {"op": "replace_text", "path": "a.md", "find": "old", "replace": "new"}
    for ops in ([patch, text], [text, patch]):
        assert planned(p, *ops) == {"a.md": "---\ntype: N\nstatus: final\nown: null\n---\nnew text [b](b.md)\n"}
    # two patches add up; of two bodies the later holds
    assert "status: x" in (out := planned(p, patch, {"op": "patch_frontmatter", "path": "a.md", "patch": {"status": "x", "k": 1}})["a.md"]) and "k: 1" in out and "title" not in out
    assert "OLD" in planned(p, text, {"op": "replace_text", "path": "a.md", "find": "old", "replace": "OLD"})["a.md"]
    # a move and edits of what is moved, and of a note that links there
    move = {"op": "move", "from": "b.md", "to": "x/b.md", "rewriteInboundLinks": True}
    out = planned(p, move, patch)
    assert out["a.md"] == "---\ntype: N\nstatus: final\nown: null\n---\nold text [b](x/b.md)\n" and "(/x/b.md)" in out["d.md"] and set(out) == {"a.md", "b.md", "x/b.md", "c.md", "d.md"}
    # a note that links to two that move has the body of the later move
    out = planned(p, move, {"op": "move", "from": "a.md", "to": "y/a.md", "rewriteInboundLinks": True})
    assert "[a](y/a.md) [b](b.md)" in out["c.md"] and "[b](x/b.md)" in out["y/a.md"] and out["a.md"] is None
    out = planned(p, {"op": "move", "from": "b.md", "to": "z.md"}, {"op": "patch_frontmatter", "path": "b.md", "patch": {"k": 1}})
    assert out["z.md"] == NOTE.format("B", "") and out["b.md"] == "---\nk: 1\n---\n"  # as the path is free by then
    assert planned(p, {"op": "create", "path": "n.md", "title": "x"}, {"op": "delete", "path": "n.md"}) == {}
    out = planned(p, {"op": "delete", "path": "b.md", "inboundLinksPolicy": "remove_links"})
    assert out["d.md"] == NOTE.format("D", "b") and "[a](a.md) b" in out["c.md"] and out["a.md"].endswith("old text b\n")
    assert planned(p, {"op": "delete", "path": "b.md", "inboundLinksPolicy": "create_stub"}) == {"b.md": None}


def test_relations_in_plans(spark):
    files = corpus_of(
        spark, t="---\ntype: task\nneeds: [c.md, none.md]\nowner: c.md\n---\n", c="---\ntype: component\n---\n", o="---\ntype: other\n---\n", n="no front matter", q="[t](t.md)", index="[t](t.md)"
    )
    types = spark.createDataFrame([("task", [], ["open", "done"], None)], S.TYPES)
    relations = spark.createDataFrame([("task", "needs", ["component"], "many"), ("task", "owner", [], "one")], S.RELATIONS)
    p = plan.Planner(files, types, relations)
    op = lambda kind, rel, target: {"op": kind, "source": "t.md", "relation": rel, "target": target}
    fields = lambda *ops: plan.split(planned(p, *ops)["t.md"])[0]
    assert fields(op("add_relation", "needs", "n.md"))["needs"] == ["c.md", "none.md", "n.md"] and fields(op("add_relation", "needs", "c.md"))["needs"] == ["c.md", "none.md"]
    assert fields(op("remove_relation", "owner", "c.md"))["owner"] == [] and fields(op("add_relation", "free", "o.md"))["free"] == ["o.md"]
    for bad in (op("add_relation", "needs", "o.md"), op("add_relation", "owner", "o.md")):
        with pytest.raises(plan.PlanError, match="RELATION_CONSTRAINT"):
            p.mutation([bad])
    assert fields({"op": "transition_status", "path": "t.md", "to": "done"})["status"] == "done"
    with pytest.raises(plan.PlanError, match="no status"):
        p.mutation([{"op": "transition_status", "path": "t.md", "to": "odd"}])
    fix = S.broken_relations(parse_files(files), relations).first()
    assert (fix.path, fix.target, fix.fix_id) == ("t.md", "none.md", plan.fix_id("t.md", "needs", "none.md")) and fields({"op": "apply_fix", "fixId": fix.fix_id})["needs"] == ["c.md"]
    with pytest.raises(plan.PlanError, match="no safe repair"):
        p.mutation([{"op": "apply_fix", "fixId": plan.fix_id("t.md", "needs", "c.md")}])
    risk = lambda *ops: p.risk(p.steps(list(ops)))
    assert risk({"op": "transition_status", "path": "c.md", "to": "deprecated"}) == {"level": "low", "reasons": []}
    assert risk({"op": "move", "from": "t.md", "to": "x.md"}) == {"level": "medium", "reasons": ["move t.md: 1 note link to it"]}
    assert (plan.can_apply(0, 1), plan.can_apply(1, 0), plan.can_apply(1, 0, False), plan.can_apply(0, 1, True, False)) == (True, False, True, False)
    m = spark.createDataFrame([("src/a.md", "write", ""), ("srcx/a.md", "write", ""), ("ref/a.md", "write", ""), ("src/ref/b.md", "delete", None)], plan.MUTATION)
    assert paths(plan.refused(m, ["src"], ["src/ref"])) == ["ref/a.md", "src/ref/b.md", "srcx/a.md"] and paths(plan.refused(m, [], ["ref"])) == ["ref/a.md"] and paths(plan.refused(m, [], [])) == []


def test_workspace_on_disk(spark, tmp_path):
    for name, text in {"a.md": NOTE.format("A", "[b](b.md)"), "b.md": NOTE.format("B", "[a](a.md)"), ".hid/c.md": NOTE.format("C", ""), "skip/x.md": "x", ".git/y.md": "y"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / ".gitignore").write_text("# c\nskip/\n")
    w = Workspace.open(spark, tmp_path)
    assert paths(w.files) == [".hid/c.md", "a.md", "b.md"]
    s = w.status()
    assert (s["concepts"], s["links"], s["orphans"], s["errors"]) == (3, 2, 1, 0)
    rows, after = w.search("title:a", limit=1)
    assert [r.path for r in rows.collect()] == ["a.md"] and after is None
    assert sorted(r.node for r in w.graph("cycles").collect()) == ["a.md", "b.md"] and [w.impact("a.md")[k] for k in ("direct", "transitive", "blockers", "risk")] == [1, 1, 0, "low"]
    (tmp_path / "index.md").write_text("old")
    w = Workspace.open(spark, tmp_path)
    planned = w.change_plan([{"op": "patch_frontmatter", "path": "a.md", "patch": {"status": "neu"}}, {"op": "create", "path": "z/n.md", "type": "t", "title": "N"}])
    assert {(r.field, r.after) for r in planned["fields"].collect()} == {("status", "neu")}
    assert planned["can_apply"] and planned["message"] == "neu: A" and planned["result"]["errors"] == 0 and w.load_plan(planned["id"])["hash"] == planned["hash"]
    done = w.change_apply(planned["id"])
    # the root's index page, which was there, is brought up to date
    assert (done["written"], done["removed"]) == (3, 0) and "status: neu" in (tmp_path / "a.md").read_text() and "* [A](a.md)" in (tmp_path / "index.md").read_text()
    with pytest.raises(plan.PlanError, match="REVISION_CONFLICT"):
        w.change_apply(planned)
    with pytest.raises(plan.PlanError, match="PLAN_STALE"):
        w.load_plan("changeset:none")
    kept = tmp_path / ".cartulary/runtime/plans" / (planned["hash"].split(":")[1] + ".json")
    kept.write_text(json.dumps(json.loads(kept.read_text()) | {"expires_at": 1}))
    with pytest.raises(plan.PlanError, match="PLAN_EXPIRED"):
        w.load_plan(planned["id"])
    w.change_revert(done["receipt"])
    assert (tmp_path / "a.md").read_text() == NOTE.format("A", "[b](b.md)") and not (tmp_path / "z/n.md").exists()
    (tmp_path / "index.md").unlink()
    assert sinks.export_zip(w.files.filter("path <> 'index.md'"), tmp_path / "out.zip") == 3 and len(zipfile.ZipFile(tmp_path / "out.zip").namelist()) == 3
    assert paths(corpus.scan_zip(spark, str(tmp_path / "out.zip"))) == [".hid/c.md", "a.md", "b.md"]
    n = sinks.write_sarif(w.checks, tmp_path / "r.sarif")
    assert len(json.loads((tmp_path / "r.sarif").read_text())["runs"][0]["results"]) == n > 0


def test_views_of_a_workspace(spark, tmp_path):
    w = Workspace.create_folder(spark, tmp_path)
    assert Workspace.create_folder(spark, tmp_path).files.count() == 1 and (tmp_path / ".gitignore").read_text() == ".cartulary/runtime/\n" and (tmp_path / ".cartulary/runtime/plans").is_dir()
    w = Workspace(corpus_of(spark, a=NOTE.format("A", "[b](b.md) [b2](/b.md) [x](gone.md) [l](log.md)"), b=NOTE.format("", "[a](a.md) [c](c.md)"), c="plain", log="l", index="[a](a.md)\n[b](b.md)"))
    view = {tuple(r) for r in w.note_view("a.md").collect()}
    assert view == {("inbound", "b.md", "a.md"), ("index", "index.md", None), ("out", "b.md", None), ("dangling", None, "gone.md")}
    assert {(r.path, r.title, r.orphan, r.invalid) for r in w.summaries().collect()} == {("a.md", "A", False, False), ("b.md", "B", False, False), ("c.md", "C", False, True)}
    g = w.graph_page("components", limit=2)
    assert [r.id for r in g["nodes"].collect()] == ["a.md", "b.md"] and sorted(tuple(r)[:2] for r in g["edges"].collect()) == [("a.md", "b.md"), ("b.md", "a.md")] and g["truncated"]
    g = w.graph_page("components", limit=2, cursor=g["cursor"])
    assert [(r.id, r.ghost) for r in g["nodes"].collect()] == [("c.md", False), ("gone.md", True)] and not g["truncated"] and g["cursor"] is None
    g = w.graph_page("path_between", "a.md", "c.md")
    assert (g["node_count"], sorted(tuple(r) for r in g["edges"].collect())) == (3, [("a.md", "b.md", False), ("b.md", "c.md", False)])
    assert w.graph_page("backlinks", "c.md")["edge_count"] == 1 and w.graph_page("cycles")["edge_count"] == 2 and w.graph_page("orphans")["node_count"] == 0
    assert w.graph_page("dangling")["node_count"] == 2 and w.graph_page("outgoing", "a.md")["node_count"] == 3
    bad = answer(w.graph_page, "backlinks", "index.md")
    assert not bad.ok and bad.error["code"] == "CONCEPT_NOT_FOUND" and answer(w.conformant).data is False and json.loads(bad.as_json())["ok"] is False
    assert answer(w.graph_page, "what").error["code"] == "INVALID_SCHEMA"
    text = w.report()
    assert "✗ [OKF-FM01] c.md" in text and text.endswith("3 notes · 1 errors · 0 warnings · doesn't conform")
    w.analysis(tmp_path / "a.json")
    data = json.loads((tmp_path / "a.json").read_text())
    assert data["conformant"] is False and len(data["concepts"]) == 3 and data["orphans"] == [] and {d["dst"] for d in data["dangling"]} == {"gone.md", "log.md"}
    assert {f["name"] for f in w.response_schema()["note_view"]["fields"]} == {"kind", "path", "href"}
    no, yes = w.draft("n.md", "x"), w.create("d/new-note.md", "Nota")
    assert not no["written"] and "OKF-FM01" in no["rejected"] and no["hard_fail"] == 2 and w.draft("n.md", "x", allow_errors=True)["written"]
    assert yes["written"] and yes["raw"] == "---\ntype: Nota\ntitle: New Note\nstatus: draft\n---\n# Nota - New Note\n" and yes["mutation"].count() == 1
    assert w.merge("a.md", {"type": None})["rejected"].endswith("OKF-TYPE") and "title: Neu" in w.merge("a.md", {"title": "Neu"})["raw"]
    assert (w.impact("b.md")["direct"], w.impact("b.md", depth=1)["transitive"], w.impact("b.md")["recommendations"]) == (1, 1, ["Look through 1 links that point here after the change (delete)."])


def test_risk_of_an_impact():
    cases = {(0, 0, 1): "high", (20, 20, 0): "high", (5, 5, 0): "medium", (1, 5, 0): "medium", (4, 4, 0): "low"}
    assert {k: impact_risk(*k) for k in cases} == cases


def test_tables_are_removed_after_use(spark, tmp_path):
    from cartulary.session import materialize, release, scratch

    with scratch():
        t = materialize(spark.range(3))
        kept = t._cartulary_path.removeprefix("file://")
        assert t.count() == 3
    assert not Path(kept).exists()
    t = materialize(spark.range(3))
    release(t, None, spark.range(1))
    assert not Path(t._cartulary_path.removeprefix("file://")).exists()


def test_settings(tmp_path):
    assert corpus.settings(tmp_path)["writable"] == [] and corpus.seconds("7d") == 604800
    (tmp_path / "cartulary.toml").write_text("[gate]\nblock_warnings = true\n")
    assert corpus.settings(tmp_path)["block_warnings"]
    (tmp_path / "cartulary.toml").write_text("[gate")
    with pytest.raises(ValueError):
        corpus.settings(tmp_path)


def test_synthetic_ring(spark):
    p = parse_files(corpus.synthetic(spark, 12))
    links = L.out_links(p)
    assert links.count() == 13 and graph.cycles(L.note_links(links, p)).count() == 12 and L.orphans(links, p).count() == 0


def test_feed_equals_rebuild(spark, tmp_path):
    rnd = random.Random(11)
    feed, now = Feed(spark, str(tmp_path / "feed")), {}
    for batch in range(3):
        rows = []
        for i in range(15):
            path = f"p{rnd.randrange(6)}.md"
            if rnd.random() < 0.3:
                rows.append((i, path, "remove", None))
                now.pop(path, None)
            else:
                rows.append((i, path, "upsert", f"text {rnd.randrange(3)}"))
                now[path] = rows[-1][3]
        df = spark.createDataFrame(rows, "seq bigint, path string, op string, raw string")
        feed.apply(df, batch)
        feed.apply(df, batch)  # delivered again
        assert {r.path: r.raw for r in feed.state().collect()} == now
    events = feed.events().count()
    feed.apply(spark.createDataFrame([(1, p, "upsert", t) for p, t in now.items()] + [(2, "absent.md", "remove", None)], "seq bigint, path string, op string, raw string"), 3)
    assert feed.events().count() == events
    assert reconcile(feed.state(), spark.createDataFrame(list(now.items()), FILES)).count() == 0
    whole = state_of(spark.createDataFrame([*now.items(), ("n.md", "n")], FILES))
    assert [tuple(r) for r in reconcile(feed.state(), whole).select("path", "op").collect()] == [("n.md", "upsert")]


def test_feed_as_a_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [{"seq": 1, "path": "a.md", "op": "upsert", "raw": "1"}, {"seq": 2, "path": "a.md", "op": "upsert", "raw": "2"}, {"seq": 3, "path": "b.md", "op": "upsert", "raw": "3"}]
    (log / "1.json").write_text("\n".join(map(json.dumps, rows)))
    feed = Feed(spark, str(tmp_path / "feed"))
    feed.start(str(log), once=True).awaitTermination()
    (log / "2.json").write_text(json.dumps({"seq": 4, "path": "b.md", "op": "remove", "raw": None}))
    feed.start(str(log), once=True).awaitTermination()
    assert [(r.path, r.raw) for r in feed.state().collect()] == [("a.md", "2")]
    assert sorted((r.path, r.event) for r in feed.events().collect()) == [("a.md", "changed"), ("b.md", "changed"), ("b.md", "removed")]


def test_history(spark):
    checks = spark.createDataFrame([(1, "a", "err"), (1, "a", "err"), (1, "b", "warn"), (2, "a", "warn")], "version int, path string, level string")
    c = history.conformance(checks, spark.createDataFrame([(1,), (2,), (3,)], "version int"))
    assert sorted(map(tuple, c.collect())) == [(1, 1, 1, False), (2, 0, 1, True), (3, 0, 0, True)]
    assert history.last_conforming(c).first().version == 3 and history.last_conforming(c.limit(0)).first().version is None
    commits = spark.createDataFrame([("c0", None), ("c1", "c0"), ("x1", "c1"), ("x2", "x1"), ("y1", "c1")], "id string, parent string")
    assert history.ahead_behind(commits, "x2", "y1") == (2, 1)
    receipts = spark.createDataFrame([(f"r{i}", 1000 + i) for i in range(6)], "name string, mtime bigint")
    assert paths(history.expired(receipts, 1010, most=3), "name") == ["r0", "r1", "r2"] and history.expired(receipts, 1010, seconds=7).count() == 3


def test_external_references(spark):
    p = parse_files(corpus_of(spark, a="---\ntype: t\nimplemented_by: [src/x.py, src/none.py, other/y.py]\nverified_by: srcs/z.py\n---\n"))
    there = spark.createDataFrame([("src/x.py",), ("other/y.py",), ("srcs/z.py",)], "path string")
    assert sorted(r.msg for r in S.external_references(p, there, ["src"]).collect()) == ["Not found: other/y.py", "Not found: src/none.py", "Not found: srcs/z.py"]


def test_sources_from_tables(spark):
    df = spark.createDataFrame([("a//b.md", "1", 1), ("a/b.md", "2", 1), ("/x.md", "3", 1), (None, "4", 2), ("c.md", None, 2)], "path string, raw string, version int")
    assert [tuple(r) for r in corpus.from_table(df).collect()] == [("a/b.md", "2")]
    assert corpus.at_version(df, 2).columns == ["path", "raw"] and corpus.at_version(df, 2).count() == 2
    lines = ["build/", "*.tmp.md", "/top.md", "!keep.tmp.md", "# x", ""]
    names = {"build/a.md": True, "x/build/a.md": True, "a.tmp.md": True, "keep.tmp.md": False, "top.md": True, "d/top.md": False, "builds/a.md": False}
    assert one(spark, *(corpus.ignored(F.lit(n), lines) for n in names)) == tuple(names.values())


def test_staged_state_and_import(spark, tmp_path):
    df = spark.createDataFrame([("a.md", "1", 0), ("b.md", "2", 0)], "path string, raw string, stage int")
    assert paths(corpus.staged(df)) == ["a.md", "b.md"] and corpus.staged(df).columns == ["path", "raw"]
    with pytest.raises(ValueError, match="b.md"):
        corpus.staged(df.union(spark.createDataFrame([("b.md", "3", 2)], df.schema)))
    (tmp_path / "a.md").write_text("1")
    now = corpus.scan(spark, str(tmp_path))
    assert sinks.import_files(tmp_path, now, df) == {"written": 1, "removed": 0, "unchanged": 1} and (tmp_path / "b.md").read_text() == "2"
    now = corpus.scan(spark, str(tmp_path))
    assert paths(corpus.dirty(now, df)) == [] and paths(corpus.dirty(now.limit(0), df)) == ["a.md", "b.md"]


def test_two_walks_to_what_refers_to_a_note_agree(spark):
    rnd = random.Random(8)
    edges = sorted({(f"n{rnd.randrange(12)}.md", f"n{rnd.randrange(12)}.md") for _ in range(20)})
    notes = spark.createDataFrame([(f"n{i}.md", "concept") for i in range(12)], "path string, kind string")
    links = spark.createDataFrame(edges, "src string, dst string")
    root = spark.createDataFrame([("n1.md",)], "node string")
    by_links = {tuple(r) for r in graph.reach(L.note_links(links, notes), root, "in").collect()}
    by_graph = {tuple(r) for r in graph.neighborhood(graph.graph_edges(links, notes), "n1.md", 20, "in")[0].collect()}
    assert by_links == by_graph and {n for n, _ in by_links} == brute_reach([(b, a) for a, b in edges], "n1.md") | {"n1.md"}


def test_ignore_files_of_folders(spark, tmp_path):
    for name, text in {".gitignore": "*.tmp.md\n/out/\n", "a/.gitignore": "!keep.tmp.md\n/x.md\n", "a/x.md": "1", "a/b/x.md": "2", "a/keep.tmp.md": "3", "keep.tmp.md": "4", "out/o.md": "5", "a/out/o.md": "6"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert paths(corpus.scan(spark, str(tmp_path))) == ["a/b/x.md", "a/keep.tmp.md", "a/out/o.md"]
    assert corpus.ignore_files(spark, str(tmp_path)) == {"": ["*.tmp.md", "/out/"], "a/": ["!keep.tmp.md", "/x.md"]}


def test_effects_of_mutations(spark, tmp_path):
    now = corpus_of(spark, a="1", b="2")
    m = spark.createDataFrame([("a.md", "write", "1"), ("b.md", "write", "3"), ("n.md", "write", ""), ("none.md", "delete", None)], plan.MUTATION)
    assert {r.path: r.effect for r in sinks.changes(now, m).collect()} == {"a.md": "unchanged", "b.md": "written", "n.md": "written", "none.md": "unchanged"}
    assert sinks.apply(tmp_path, now, m) == {"written": 2, "removed": 0, "unchanged": 2} and (tmp_path / "b.md").read_text() == "3"
    with pytest.raises(ValueError):
        sinks.apply(tmp_path, now, spark.createDataFrame([("../x.md", "write", "")], plan.MUTATION))
    assert json.loads(sinks.as_json(now.filter("path = 'a.md'")).first().json) == {"path": "a.md", "raw": "1"}
