"""Graph operators over (src, dst) edge tables.

Graphs, and parts of graphs that hang together, of at most ``IN_TASK`` counted edges are walked within one task; larger
ones by loops that write each round to the shared folder, read it back and remove the round before. Both give the same.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.session import materialize, release, small_or_not

#: Most edges, counted, that one task takes.
IN_TASK = 300_000


def _in_task(edges: DataFrame, walk: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows that ``walk`` makes of the columns of one task's edges."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(walk(*(pdf[c].tolist() for c in pdf.columns)), columns=[c.split()[0] for c in schema.split(", ")])

    return edges.groupBy(F.lit("all")).applyInPandas(run, schema)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def path_edges(path: DataFrame, notes: DataFrame) -> DataFrame:
    """Edges between the consecutive nodes of a path (pos, node): (src, dst, dangling), in doubt those that lead to no
    file."""
    there = notes.select(F.col("path").alias("dst")).distinct().withColumn("known", F.lit(True))
    after = path.select((F.col("pos") - 1).alias("pos"), F.col("node").alias("dst"))
    return path.withColumnRenamed("node", "src").join(after, "pos").join(there, "dst", "left").select("src", "dst", F.col("known").isNull().alias("dangling"))


def inner_edges(edges: DataFrame, nodes: DataFrame, column: str = "node") -> DataFrame:
    """Edges with both ends among ``nodes``."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col(column).alias(end)).distinct(), end, "left_semi")
    return edges.select("src", "dst", "dangling")


def page(nodes: DataFrame, edges: DataFrame, limit: int | None = None, offset: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """Nodes (id, ...) in order of their ids from ``offset`` on, at most ``limit``, the edges between them, and the number
    of all nodes. Without a limit everything after ``offset`` is given."""
    total = nodes.count()
    own = nodes.orderBy("id").offset(offset) if offset else nodes.orderBy("id")
    own = materialize(own if limit is None else own.limit(limit))
    return own, inner_edges(edges, own, "id"), total


def graph_edges(links: DataFrame, concepts: DataFrame) -> DataFrame:
    """Distinct edges between notes: (src, dst, dangling). Sources are notes; targets that are index or log pages are
    dropped, targets that don't exist stay and are ``dangling``."""
    reserved = F.element_at(F.split("dst", "/"), -1).isin("index.md", "log.md")
    known = concepts.select(F.col("path").alias("dst")).distinct().withColumn("known", F.lit(True))
    return (
        links.filter(F.col("dst").isNotNull() & ~reserved)
        .join(concepts.select(F.col("path").alias("src")).distinct(), "src", "left_semi")
        .select("src", "dst")
        .distinct()
        .join(known, "dst", "left")
        .select("src", "dst", F.col("known").isNull().alias("dangling"))
    )


def graph_nodes(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """Notes and ghosts (targets that don't exist): (id, ghost, type, status)."""
    own = concepts.select(F.col("path").alias("id"), F.lit(False).alias("ghost"), "type", "status")
    ghosts = edges.filter("dangling").select(F.col("dst").alias("id")).distinct()
    return own.dropDuplicates(["id"]).unionByName(ghosts.withColumn("ghost", F.lit(True)), allowMissingColumns=True)


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(here, there) steps for ``out``, ``in`` or ``both``."""
    out = edges.select(F.col("src").alias("here"), F.col("dst").alias("there"))
    back = edges.select(F.col("dst").alias("here"), F.col("src").alias("there"))
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction {direction!r} is none of out, in, both")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction].distinct()


def reach(edges: DataFrame, roots: DataFrame, direction: str = "out", depth: int | None = None) -> DataFrame:
    """Breadth-first distances (node, distance) from ``roots`` (a ``node`` column); ``depth`` None: as far as it goes.

    In a large graph a round joins the frontier with the steps and takes away what was reached before.
    """
    steps = materialize(directed(edges, direction))
    start = roots.select("node").filter("node IS NOT NULL").distinct()
    if steps.count() + start.count() <= IN_TASK:
        rows = steps.withColumn("root", F.lit(False)).union(start.select("node", "node", F.lit(True)))
        return _in_task(rows, lambda a, b, root: _distances(a, b, root, depth), f"node {_kind(steps, 'here')}, distance int")
    found = [materialize(roots.select("node").filter("node IS NOT NULL").distinct().withColumn("distance", F.lit(0)))]
    while depth is None or len(found) <= depth:
        seen = reduce(DataFrame.unionByName, found)
        front = small_or_not(found[-1].select(F.col("node").alias("here")))
        new = (
            steps.join(front, "here", "left_semi")
            .select(F.col("there").alias("node"))
            .distinct()
            .join(seen, "node", "left_anti")
            .withColumn("distance", F.lit(len(found)))
        )
        new = materialize(new)
        if new.isEmpty():
            break
        found.append(new)
        if len(found) % 8 == 0:  # one table of all but the last
            found = _fold(found)
    return reduce(DataFrame.unionByName, found)


def _distances(here: list, there: list, root: list, depth: int | None) -> list[tuple]:
    """Breadth-first distances; rows with ``root`` name the nodes to begin with."""
    steps, seen = defaultdict(list), {}
    for a, b, first in zip(here, there, root, strict=True):
        if first:
            seen[a] = 0
        else:
            steps[a].append(b)
    front = list(seen)
    while front and (depth is None or seen[front[0]] < depth):
        after = []
        for a in front:
            for b in steps[a]:
                if b not in seen:
                    seen[b] = seen[a] + 1
                    after.append(b)
        front = after
    return list(seen.items())


def _fold(found: list[DataFrame]) -> list[DataFrame]:
    whole = materialize(reduce(DataFrame.unionByName, found[:-1]))
    release(*found[:-1])
    empty = whole.limit(0)
    return [whole, *[empty] * (len(found) - 2), found[-1]]


def neighborhood(edges: DataFrame, root: str, depth: int, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes (node, distance) within ``depth`` and the edges (src, dst) met while expanding nodes nearer than it."""
    spark = edges.sparkSession
    nodes = materialize(reach(edges, spark.createDataFrame([(root,)], "node string"), direction, depth))
    inner = nodes.filter(F.col("distance") < depth).select("node")
    met = []
    if direction in ("out", "both"):
        met.append(edges.join(inner.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst"))
    if direction in ("in", "both"):
        met.append(edges.join(inner.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    return nodes, reduce(DataFrame.unionByName, met).distinct()


def shortest_path(edges: DataFrame, a: str, b: str, longest: int | None = None) -> DataFrame:
    """The first of the shortest directed paths from a to b by order of node names: (pos, node); no rows if none.

    Each node keeps the least path by which it was first reached; nodes reached before are left out. The search goes on
    until nothing new is reached; with ``longest`` it raises a ValueError if it would need more steps than that.
    """
    spark = edges.sparkSession
    steps = materialize(directed(edges.filter("src <> dst"), "out"))
    if steps.count() <= IN_TASK:
        kind = _kind(steps, "here")
        rows = steps.unionByName(spark.createDataFrame([(a, a)], f"here {kind}, there {kind}"))  # so that there is a row
        return _in_task(rows, lambda x, y: _least_path(x, y, a, b, longest), f"pos int, node {kind}")
    front = spark.createDataFrame([(a, [a])], "node string, way array<string>")
    seen = front.select("node")
    for n in count():
        if not front.filter(F.col("node") == b).isEmpty():
            return front.filter(F.col("node") == b).select(F.posexplode("way").alias("pos", "node"))
        front = materialize(
            steps.join(front.withColumnRenamed("node", "here"), "here")
            .groupBy(F.col("there").alias("node"))
            .agg(F.min("way").alias("way"))
            .join(seen, "node", "left_anti")
            .select("node", F.concat("way", F.array("node")).alias("way"))
        )
        if front.isEmpty():
            break
        if n == longest:
            raise ValueError(f"no path from {a!r} to {b!r} of at most {longest} steps, and the search has not ended")
        seen = materialize(seen.unionByName(front.select("node")))
    return spark.createDataFrame([], "pos int, node string")


def _least_path(here: list, there: list, a: str, b: str, longest: int | None) -> list[tuple]:
    """Breadth first with the nodes of a level in order of their least paths, so the first way to a node is the least."""
    steps, before = defaultdict(list), {a: None}
    for x, y in zip(here, there, strict=True):
        steps[x].append(y)
    front, n = [a], 0
    while front and b not in before:
        after = []
        for x in front:
            for y in sorted(steps[x]):
                if y not in before:
                    before[y] = x
                    after.append(y)
        if after and n == longest:
            raise ValueError(f"no path from {a!r} to {b!r} of at most {longest} steps, and the search has not ended")
        front, n = after, n + 1
    way = []
    while b is not None and b in before:
        way.append(b)
        b = before[b]
    return list(enumerate(reversed(way)))


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Connected components without direction: (node, component), the component being its smallest node.

    Alternates large stars and small stars: every node is linked to the smallest neighbour of its own and of its
    neighbours, so the rounds grow with the logarithm of the longest path. Pairs are grouped by hash of the node with
    map-side minima; no component is ever gathered in one task. ``nodes`` (a ``node`` column) adds single ones.
    """
    e = materialize(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    every = e.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    if nodes is not None:
        every = every.unionByName(nodes.select("node").filter("node IS NOT NULL")).distinct()
    e = e.filter("u <> v")
    if e.count() <= IN_TASK:
        label = _in_task(e, _joined, f"node {_kind(e, 'u')}, component {_kind(e, 'u')}")
        return every.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    before, last = None, None
    while True:
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", "m")).filter("u <> v").distinct()
        e = materialize(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        release(last)
        last = e
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    label = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return every.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _joined(a: list, b: list) -> list[tuple]:
    """The smallest node of the connected part that each node belongs to."""
    up: dict = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(a, b, strict=True):
        x, y = sorted((top(x), top(y)))
        up[y] = x
    return [(x, top(x)) for x in list(up)]


def cycles(edges: DataFrame) -> DataFrame:
    """Strongly connected groups of more than one node, and nodes with an edge to themselves: (node, cycle), the cycle
    being its smallest node.

    A cycle lies within one connected part of the graph. Parts of up to ``IN_TASK`` edges, several of them together, are
    each searched in one task, so a ring needs no round per node. In larger parts nodes without a way in or out are
    trimmed until none is left; then, in each round, every node takes the smallest node that reaches it as its colour,
    and those that also reach their colour within it form a group. Nothing bounds the rounds.
    """
    spark = edges.sparkSession
    e = materialize(edges.filter("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct())
    kind = _kind(e, "src")
    schema = f"node {kind}, cycle {kind}"
    done = e.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle"))
    apart = e.filter("src <> dst")
    n = apart.count()
    if n <= IN_TASK:
        found = _in_task(apart, _circular, schema)
    else:
        part = components(apart)
        apart = materialize(apart.join(part.select(F.col("node").alias("src"), F.col("component").alias("part")), "src").select("src", "dst", "part"))
        large = materialize(apart.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > IN_TASK).select("part"))
        task = F.pmod(F.xxhash64("part"), F.lit(1 + 2 * n // max(1, IN_TASK)))
        run = lambda pdf: pd.DataFrame(_circular(pdf["src"].tolist(), pdf["dst"].tolist()), columns=["node", "cycle"])
        found = apart.join(small_or_not(large), "part", "left_anti").groupBy(task.alias("task")).applyInPandas(run, schema)
        found = found.unionByName(_coloured(materialize(apart.join(small_or_not(large), "part", "left_semi").select("src", "dst"))))
    whole = materialize(found.unionByName(spark.createDataFrame([], schema)))
    return whole.unionByName(done.join(whole.select("node"), "node", "left_anti")).distinct()


def _circular(a: list, b: list) -> list[tuple]:
    """(node, smallest node of its group) of every strongly connected group of more than one node.

    Two passes: nodes in the order in which a search along the edges leaves them, then, from the last, what reaches them
    backwards among those not yet taken.
    """
    out, back = defaultdict(list), defaultdict(list)
    for x, y in zip(a, b, strict=True):
        out[x].append(y)
        back[y].append(x)
    left, seen = [], set()
    for root in list(out):
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(out[root]))]
        while stack:
            node, ways = stack[-1]
            new = next((y for y in ways if y not in seen), None)
            if new is None:
                left.append(node)
                stack.pop()
            else:
                seen.add(new)
                stack.append((new, iter(out.get(new, ()))))
    rows, taken = [], set()
    for root in reversed(left):
        if root in taken:
            continue
        taken.add(root)
        group, todo = [root], [root]
        while todo:
            for x in back.get(todo.pop(), ()):
                if x not in taken:
                    taken.add(x)
                    group.append(x)
                    todo.append(x)
        if len(group) > 1:
            least = min(group)
            rows += [(x, least) for x in group]
    return rows


def _coloured(e: DataFrame) -> DataFrame:
    """Strongly connected groups of more than one node by colouring: (node, cycle)."""
    kind = _kind(e, "src")
    groups = []
    e = _trim(e)
    while not e.isEmpty():
        colour = _spread_min(e, e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")), "src", "dst")
        same = materialize(
            e.join(colour.withColumnsRenamed({"node": "src", "colour": "c"}), "src")
            .join(colour.withColumnsRenamed({"node": "dst", "colour": "d"}), "dst")
            .filter("c = d")
            .select("src", "dst", "c")
        )
        release(e, colour)
        # backward from each colour's own node, within the colour
        front = materialize(same.filter("dst = c").select(F.col("src").alias("node"), "c").union(same.select("c", "c")).distinct())
        members_ = front
        while True:
            front = materialize(
                same.join(front.withColumnRenamed("node", "dst"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct().join(members_, ["node", "c"], "left_anti")
            )
            if front.isEmpty():
                break
            grown = materialize(members_.unionByName(front))
            release(members_)
            members_ = grown
        groups.append(materialize(members_.join(members_.groupBy("c").count().filter("count > 1").select("c"), "c", "left_semi").select("node", F.col("c").alias("cycle"))))
        settled = members_.select("node")
        rest = same.join(settled.withColumnRenamed("node", "src"), "src", "left_anti").join(settled.withColumnRenamed("node", "dst"), "dst", "left_anti")
        e = _trim(materialize(rest.select("src", "dst")))
        release(same, members_)
    return reduce(DataFrame.unionByName, groups, e.sparkSession.createDataFrame([], f"node {kind}, cycle {kind}"))


def _trim(e: DataFrame) -> DataFrame:
    """Edges whose source has a way in and whose target a way out, until all have."""
    n = e.count()
    while True:
        kept = materialize(
            e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        )
        release(e)
        e, m = kept, kept.count()
        if m == n:
            return e
        n = m


def _spread_min(e: DataFrame, colour: DataFrame, here: str, there: str) -> DataFrame:
    """Every node's smallest colour among its own and those of nodes from which it is reached."""
    last = materialize(colour)
    while True:
        colour = last.select("node", "colour")
        came = e.join(colour.withColumnRenamed("node", here), here).groupBy(F.col(there).alias("node")).agg(F.min("colour").alias("other"))
        new = materialize(colour.join(came, "node", "left").select("node", F.least("colour", "other").alias("colour"), (F.col("other") < F.col("colour")).alias("moved")))
        release(last)
        if new.filter("moved").isEmpty():
            return new.select("node", "colour")
        last = new
