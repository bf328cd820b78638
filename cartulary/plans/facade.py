"""The services of a workspace over one corpus: status, search, reading, schema, checks, graph, impact and changes."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import text as T
from cartulary.functions.front import build_raw, parse_files
from cartulary.functions.headings import extract_sections
from cartulary.operators import checks as C
from cartulary.operators import diff as D
from cartulary.operators import generate as G
from cartulary.operators import graph, history, plan, search
from cartulary.operators import links as L
from cartulary.operators import revisions as R
from cartulary.operators import schema as S
from cartulary.session import materialize
from cartulary.sources import corpus, sinks


#: Folders of a workspace that hold no notes: what plans and receipts are kept in.
PLANS, RECEIPTS = ".cartulary/runtime/plans", ".cartulary/runtime/receipts"
#: Notes that a change reaches from which its risk is medium, and direct ones from which it is high.
MEDIUM_REACH, HIGH_REACH = 5, 20


@dataclass
class Response:
    """What a service answers: its data, or the code and text of an error."""

    ok: bool
    data: Any = None
    error: dict[str, str] | None = None
    warnings: list[str] = field(default_factory=list)

    def as_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, default=str)


def answer(service: Callable[..., Any], *args: Any, **kw: Any) -> Response:
    """Calls a service and wraps its answer; errors of plans keep their code, other wrong values are INVALID_SCHEMA."""
    try:
        return Response(True, service(*args, **kw))
    except plan.PlanError as e:
        return Response(False, error={"code": e.code, "message": str(e)})
    except ValueError as e:
        return Response(False, error={"code": "INVALID_SCHEMA", "message": str(e)})


class Workspace:
    """A corpus (path, raw) with its derived tables, each made when it is first needed and then kept as a table.

    ``types`` and ``relations`` are as ``schema.load_catalogue`` gives them; without them every type is free.
    """

    def __init__(self, files: DataFrame, types: DataFrame | None = None, relations: DataFrame | None = None, root: str | Path | None = None):
        self.spark: SparkSession = files.sparkSession
        self.files = files.select("path", "raw")
        self.types = types if types is not None else self.spark.createDataFrame([], S.TYPES)
        self.relations = relations if relations is not None else self.spark.createDataFrame([], S.RELATIONS)
        self.root = Path(root) if root else None
        self._made: dict[str, DataFrame] = {}

    @classmethod
    def create_folder(cls, spark: SparkSession, root: str | Path) -> Workspace:
        """A folder with a root index, the folders for plans and receipts, and these ignored by version control; what is
        already there stays."""
        root = Path(root)
        for name in (PLANS, RECEIPTS):
            (root / name).mkdir(parents=True, exist_ok=True)
        if not (root / "index.md").exists():
            sinks.write_file(root, "index.md", '---\nokf_version: "0.1"\n---\n\n# Bundle\n')
        sinks.ignore(root, [".cartulary/runtime/"])
        return cls.open(spark, root)

    @classmethod
    def open(cls, spark: SparkSession, root: str | Path) -> Workspace:
        """A folder of Markdown files with its catalogue ``.cartulary/schema.yaml``."""
        return cls(corpus.scan(spark, str(root)), *S.load_catalogue(spark, Path(root, ".cartulary/schema.yaml")), root=root)

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = materialize(make())
        return self._made[name]

    @property
    def parsed(self) -> DataFrame:
        return self._once("parsed", lambda: parse_files(self.files))

    @property
    def links(self) -> DataFrame:
        return self._once("links", lambda: L.core_links(L.out_links(self.parsed)))

    @property
    def checks(self) -> DataFrame:
        def make() -> DataFrame:
            own = C.analyze(self.parsed, self.links).unionByName(S.schema_checks(self.parsed, self.types))
            return own.unionByName(S.relation_checks(self.parsed, self.relations))

        return self._once("checks", make)

    @property
    def concepts(self) -> DataFrame:
        return self.parsed.filter("kind = 'concept'")

    def status(self) -> dict[str, Any]:
        """Numbers of notes, links, orphans, dangling links, errors and warnings, with the revision of the corpus."""
        s = C.summary(self.checks).first()
        v = self.parsed.filter("path = 'index.md'").select(T.version(F.col("raw"))).first()
        return {
            "concepts": self.concepts.count(), "links": self.links.count(), "orphans": L.orphans(self.links, self.parsed).count(),
            "dangling": L.dangling(self.links, self.parsed).count(), "errors": s.errors, "warnings": s.warnings, "infos": s.infos,
            "version": (v[0] if v else None) or "0.2", "revision": R.workspace_revision(self.files).first().revision,
        }

    def conformant(self) -> bool:
        return self.checks.filter("level = 'err'").isEmpty()

    def search(self, text: str = "", limit: int = 20, cursor: str | None = None, **filters: Any) -> tuple[DataFrame, str | None]:
        """One page of hits and the next cursor, null when there are no more."""
        own = {"orphan": L.orphans(self.links, self.parsed), "linked": L.inbound(self.links, self.parsed), "invalid": self.checks.filter("level = 'err'")}
        hits = search.ranked(search.narrowed(search.select(self.concepts, text, **own), **filters), text)
        rows, after = search.page(hits, limit, cursor)
        more = after and not hits.offset(search.offset_of(after)).limit(1).isEmpty()
        return rows, after if more else None

    def get(self, path: str, include: tuple[str, ...] = ("frontmatter", "body"), sections: list[list[str]] = ()) -> DataFrame:
        """The asked parts of one note; what isn't asked for isn't computed."""
        row = self.concepts.filter(F.col("path") == path)
        parts = {"frontmatter": F.col("pairs"), "body": F.col("body"), "raw": F.col("raw"), "revision": R.concept_revision(F.col("raw"))}
        cols = [parts[k].alias(k) for k in include]
        if sections:
            cols.append(extract_sections(F.col("body"), list(sections)).alias("sections"))
        return row.select("path", *cols)

    def backlinks(self, path: str) -> DataFrame:
        return L.backlinks(self.links, self.parsed, path)

    def inspect_schema(self, name: str | None = None) -> DataFrame:
        return self.types if name is None else self.types.filter(F.col("name") == name).join(self.relations, "name", "left")

    def check(self, floor: str = "info", offset: int = 0, limit: int = 100, paths: DataFrame | None = None) -> tuple[dict[str, int], DataFrame]:
        """Numbers by severity over the scope, and one page at or above the floor."""
        own = self.checks if paths is None else self.checks.join(paths.select("path").distinct(), "path", "left_semi")
        return C.summary(own).first().asDict(), C.page(own, floor, offset, limit)

    def affected_scope(self, roots: DataFrame, depth: int = 1) -> DataFrame:
        """Notes within ``depth`` steps of ``roots`` (path) in either direction: (path)."""
        return graph.reach(self.edges, roots.select(F.col("path").alias("node")), "both", depth).select(F.col("node").alias("path"))

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", lambda: graph.graph_edges(self.links, self.concepts))

    def graph(self, op: str, root: str | None = None, to: str | None = None, depth: int = 1, direction: str = "both") -> DataFrame:
        """orphans, dangling, backlinks, outgoing, neighborhood, path_between, cycles or components."""
        match op:
            case "orphans":
                return L.orphans(self.links, self.parsed)
            case "dangling":
                return L.dangling(self.links, self.parsed)
            case "backlinks":
                return self.backlinks(root or "")
            case "outgoing":
                return self.links.filter(F.col("src") == root).select("dst", "href")
            case "neighborhood":
                return graph.neighborhood(self.edges, root or "", depth, direction)[0]
            case "path_between":
                return graph.shortest_path(self.edges, root or "", to or "")
            case "cycles":
                return graph.cycles(self.edges)
            case "components":
                return graph.components(self.edges, self.concepts.select(F.col("path").alias("node")))
        raise ValueError(f"{op!r} is no graph query")

    def concept(self, path: str) -> str:
        """The path of a note that exists; index and log pages are none."""
        if self.concepts.filter(F.col("path") == path).isEmpty():
            raise plan.PlanError("CONCEPT_NOT_FOUND", f"{path} is no note")
        return path

    def graph_page(
        self, op: str, root: str | None = None, to: str | None = None, depth: int = 1, direction: str = "out", limit: int | None = None, cursor: str | None = None
    ) -> dict[str, Any]:
        """A graph query as nodes (id, ghost, type, status) in order of their ids and the edges (src, dst, dangling) between
        those of the page, with the numbers of both, ``truncated`` and the cursor of the next page."""
        for p in (root, to if op == "path_between" else None):
            if p is not None:
                self.concept(p)
        one = lambda p: self.spark.createDataFrame([(p,)], "node string")
        edges = self.edges
        match op:
            case "backlinks":
                own = L.note_links(self.links, self.parsed).filter((F.col("dst") == root) & (F.col("src") != root))
                nodes, edges = own.select(F.col("src").alias("node")).union(one(root)), own.select("src", "dst", F.lit(False).alias("dangling"))
            case "outgoing" | "neighborhood":
                nodes, met = graph.neighborhood(edges, root or "", 1 if op == "outgoing" else depth, "out" if op == "outgoing" else direction)
                edges = edges.join(met, ["src", "dst"], "left_semi")
            case "orphans":
                nodes, edges = L.orphans(self.links, self.parsed).select(F.col("path").alias("node")), edges.limit(0)
            case "dangling":
                own = L.dangling(self.links, self.parsed)
                # as the page holds only the missing ends, its edges are those between them
                nodes, edges = own.select(F.col("dst").alias("node")), own.select("src", "dst", F.lit(True).alias("dangling"))
            case "path_between":
                way = materialize(graph.shortest_path(edges, root or "", to or ""))
                nodes, edges = way.select("node"), graph.path_edges(way, self.parsed)
            case "cycles":
                nodes = graph.cycles(edges).select("node")
            case "components":
                nodes = graph.graph_nodes(edges, self.concepts).select(F.col("id").alias("node"))
            case _:
                raise plan.PlanError("INVALID_SCHEMA", f"{op!r} is no graph query")
        known = self.parsed.select(F.col("path").alias("id"), F.lit(False).alias("ghost"), "type", "status").dropDuplicates(["id"])
        every = nodes.select(F.col("node").alias("id")).distinct().join(known, "id", "left").withColumn("ghost", F.coalesce("ghost", F.lit(True)))
        offset = search.offset_of(cursor)
        own, inner, total = graph.page(every, edges, limit, offset)
        end = total if limit is None else min(total, offset + limit)
        inner = materialize(inner)
        return {
            "nodes": own, "edges": inner, "node_count": own.count(), "edge_count": inner.count(), "truncated": end < total,
            "cursor": search.cursor_of(end) if end < total else None,
        }

    def note_view(self, path: str) -> DataFrame:
        """What refers to a note and what it refers to: see ``links.note_view``."""
        return L.note_view(self.parsed, self.concept(path))

    def summaries(self) -> DataFrame:
        return C.summaries(self.parsed, L.orphans(self.links, self.parsed), self.checks)

    def report(self, block_warnings: bool = False) -> str:
        """Errors and warnings, a line each, and what they come to."""
        return sinks.report(self.checks, self.concepts.count(), block_warnings)

    def analysis(self, target: str | Path) -> None:
        """The analysis as one JSON document with ``conformant``, written row by row."""
        sinks.write_analysis(self.checks, self.concepts, self.links, L.orphans(self.links, self.parsed), L.dangling(self.links, self.parsed), target)

    def response_schema(self) -> dict[str, Any]:
        """Schema of the table that each service answers with."""
        tables = {
            "search": search.ranked(self.concepts, ""), "backlinks": self.backlinks(""), "checks": self.checks, "schema": self.types, "relations": self.relations,
            "edges": self.edges, "nodes": graph.graph_nodes(self.edges, self.concepts), "summaries": self.summaries(), "note_view": L.note_view(self.parsed, ""),
            "fields": D.field_changes(self.parsed, self.parsed), "links": D.link_changes(self.links, self.links), "diagnostics": D.diagnostic_changes(self.checks, self.checks),
        }
        return {k: json.loads(v.schema.json()) for k, v in tables.items()}

    def impact(self, path: str, kind: str = "delete", depth: int | None = None) -> dict[str, Any]:
        """What a change of a note would reach: direct and transitive numbers, for a deletion the typed relations that would
        break, the risk, and what to look after."""
        roots = self.spark.createDataFrame([(self.concept(path),)], "node string")
        edges = L.note_links(self.links, self.parsed)
        direct = edges.filter((F.col("dst") == path) & (F.col("src") != path)).count()
        near = materialize(graph.reach(edges, roots, "in", depth).filter("distance > 0"))
        all_ = near.count()
        broken = S.blocking_relations(self.parsed, self.relations, path) if kind == "delete" else self.spark.createDataFrame([], "path string, relation string")
        blockers = broken.count()
        advice = [f"Update or redirect {blockers} typed relations that point here first."] if blockers else []
        advice += [f"Look through {direct} links that point here after the change ({kind})."] if direct else []
        return {
            "direct": direct, "transitive": all_, "blockers": blockers, "risk": impact_risk(direct, all_, blockers), "affected": near.select(F.col("node").alias("path")),
            "blocking": broken, "recommendations": advice,
        }

    # --- changes ---------------------------------------------------------------------------------------------------

    def draft(self, path: str, raw: str, allow_errors: bool = False) -> dict[str, Any]:
        """What writing one text would come to: its checks within the corpus, whether it may be written, and the number of
        files with errors then. Nothing is written."""
        new = self.spark.createDataFrame([(plan.clean_path(path), "write", raw)], plan.MUTATION)
        after = Workspace(plan.simulate(self.files, new), self.types, self.relations)
        checks = C.analyze(after.parsed, after.links)
        own = materialize(checks.filter(F.col("path") == path))
        codes = sorted({r.code for r in own.filter("level = 'err'").collect()})
        rejected = f"the note doesn't conform: {', '.join(codes)}" if codes and not allow_errors else None
        revision = self.spark.range(1).select(R.concept_revision(F.lit(raw))).first()[0]
        return {
            "path": path, "raw": raw, "revision": revision, "written": rejected is None, "rejected": rejected, "checks": own, "hard_fail": C.hard_fail(checks).first().hard_fail,
            "mutation": new if rejected is None else new.limit(0),
        }

    def create(self, path: str, kind: str, title: str | None = None, body: str = "", timestamp: str | None = None, allow_errors: bool = False) -> dict[str, Any]:
        """A new note as a draft; without a body it begins with a heading of its type and title."""
        title = plan.title_of(path) if title is None else title
        front = {"type": kind, "title": title, "status": "draft"} | ({"timestamp": timestamp} if timestamp else {})
        return self.draft(path, build_raw(front, body if body.strip() else f"# {kind + ' - ' if kind else ''}{title}\n"), allow_errors)

    def merge(self, path: str, patch: dict[str, Any]) -> dict[str, Any]:
        """A note with a merge patch of its front matter."""
        row = self.files.filter(F.col("path") == path).first()
        front, body = plan.split(row.raw if row else "")
        return self.draft(path, build_raw(plan.patched(front, patch), body))

    def change_plan(self, operations: list[dict[str, Any]], revision: str | None = None, require_conformant: bool = True, allow_warnings: bool = True) -> dict[str, Any]:
        """Steps, mutation, simulated result and semantic differences of planned operations. No note is written; with a
        folder the plan is kept under its id for ``load_plan``."""
        base = R.workspace_revision(self.files).first().revision
        if revision and revision != base:
            raise plan.PlanError("REVISION_CONFLICT", "the corpus has another revision")
        planner = plan.Planner(self.files, self.types, self.relations)
        steps = planner.steps(operations)
        mutation = materialize(planner.fold(steps))
        after = Workspace(plan.simulate(self.files, mutation), self.types, self.relations)
        sums = [C.summary(w.checks).first().asDict() for w in (self, after)]
        hash_ = plan.plan_hash(base, steps)
        out = {
            "id": "changeset:" + hash_.split(":")[1], "hash": hash_, "base": base, "expires_at": int(time.time()) + plan.LASTS, "operations": operations, "steps": steps,
            "can_apply": plan.can_apply(sums[1]["errors"], sums[1]["warnings"], require_conformant, allow_warnings),
            "require_conformant": require_conformant, "allow_warnings": allow_warnings, "before": sums[0], "result": sums[1], "risk": planner.risk(steps),
        }
        if self.root is not None:
            folder = self.root / PLANS
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"{out['id'].split(':')[1]}.json").write_text(json.dumps(out, ensure_ascii=False), encoding="utf-8")
        files = materialize(D.file_diff(self.files, after.files))
        fields, links = D.field_changes(self.parsed, after.parsed), D.link_changes(self.links, after.links)
        return out | {
            "mutation": mutation, "after": after, "files": files, "fields": fields, "links": links, "diagnostics": D.diagnostic_changes(self.checks, after.checks),
            "message": D.message(files, fields),
        }

    def load_plan(self, id_: str) -> dict[str, Any]:
        """A kept plan; PLAN_STALE if it isn't there or can't be read, PLAN_EXPIRED an hour after it was made."""
        path = self.root / PLANS / f"{id_.split(':')[-1]}.json"
        try:
            planned = json.loads(path.read_text(encoding="utf-8"))
            expires = int(planned["expires_at"])
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise plan.PlanError("PLAN_STALE", f"{id_} isn't kept here") from e
        if expires < time.time():
            raise plan.PlanError("PLAN_EXPIRED", f"{id_} is too old")
        return planned

    def change_apply(self, planned: dict[str, Any] | str) -> dict[str, Any]:
        """Writes a plan, or the one kept under an id, below the root.

        The corpus must still be as it was planned on, every file must be one that may be written, and the result must
        be as conformant as was asked for. Generated pages that exist are brought up to date with it. A receipt of what
        was there before makes it revertible; receipts beyond the settings are removed.
        """
        if self.root is None:
            raise ValueError("this workspace has no folder")
        planned = self.load_plan(planned) if isinstance(planned, str) else planned
        now = materialize(corpus.scan(self.spark, str(self.root)).select("path", "raw"))
        if R.workspace_revision(now).first().revision != planned["base"]:
            raise plan.PlanError("REVISION_CONFLICT", "the corpus has changed since the plan was made")
        planner = plan.Planner(now, self.types, self.relations)
        mutation = materialize(planner.fold(planned["steps"]))
        own = corpus.settings(self.root)
        refused = plan.refused(mutation, own["writable"], own["references"]).first()
        if refused:
            raise plan.PlanError("PERMISSION_DENIED", f"{refused.path} may not be written")
        after = Workspace(plan.simulate(now, mutation), self.types, self.relations)
        s = C.summary(after.checks).first()
        if not plan.can_apply(s.errors, s.warnings, planned["require_conformant"], planned["allow_warnings"] and not own["block_warnings"]):
            raise plan.PlanError("NONCONFORMANT_RESULT", "the result would not conform")
        pages = plan.regenerated(after.files, G.index_pages(after.parsed), G.tag_pages(after.parsed))
        mutation = materialize(plan.overlaid(mutation, pages))
        before = materialize(now.join(mutation.select("path"), "path", "left_semi"))
        undo = plan.restore(before, plan.simulate(before, mutation))
        folder = self.root / RECEIPTS
        folder.mkdir(parents=True, exist_ok=True)
        receipt = folder / (planned["hash"].split(":")[1][:32] + ".jsonl")
        with open(receipt, "w", encoding="utf-8") as f:
            for r in undo.toLocalIterator():
                f.write(json.dumps(r.asDict(), ensure_ascii=False) + "\n")
        done = {"receipt": receipt.name, **sinks.apply(self.root, now, mutation)}
        self.drop_receipts()
        sinks.audit(self.root, {"plan": planned["hash"], "at": int(time.time()), **done})
        return done

    def drop_receipts(self) -> list[str]:
        """Removes the receipts that are older or more than the settings allow; gives their names."""
        own, folder = corpus.settings(self.root), self.root / RECEIPTS
        rows = [(p.name, int(p.stat().st_mtime)) for p in folder.glob("*.jsonl")]
        if not rows:
            return []
        gone = history.expired(self.spark.createDataFrame(rows, "name string, mtime bigint"), int(time.time()), own["most_receipts"], own["retain_seconds"])
        names = sorted(r.name for r in gone.collect())
        for n in names:
            (folder / n).unlink(missing_ok=True)
        return names

    def change_revert(self, receipt: str) -> dict[str, int]:
        """Puts back what a receipt holds."""
        path = self.root / RECEIPTS / receipt
        if not path.is_file():
            raise plan.PlanError("PLAN_STALE", f"{receipt} isn't kept here")
        rows = [json.loads(x) for x in path.read_text(encoding="utf-8").splitlines()]
        undo = self.spark.createDataFrame([(r["path"], r["op"], r.get("content")) for r in rows], plan.MUTATION)
        return sinks.apply(self.root, corpus.scan(self.spark, str(self.root)).select("path", "raw"), undo)


def impact_risk(direct, transitive, blockers):
    """low, medium or high, of numbers or of columns."""
    if not hasattr(direct, "cast"):
        return "high" if blockers or direct >= HIGH_REACH else "medium" if max(direct, transitive) >= MEDIUM_REACH else "low"
    high, medium = (blockers > 0) | (direct >= HIGH_REACH), F.greatest(direct, transitive) >= MEDIUM_REACH
    return F.when(high, "high").when(medium, "medium").otherwise("low")
