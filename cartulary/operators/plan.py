"""Planned edits of a corpus: operations become steps, and the steps a mutation of few files, simulated as an overlay.

Operations are brought to steps on the state before the plan: new notes, patches of front matter, new bodies, moves,
deletions and links to be rewritten. The steps are folded in their order, so a patch and a new body of one note add up,
while of two new bodies, each planned on the text as it was, the later holds. Only what operations name is folded on the
driver; files that merely link to something moved or deleted are rewritten in parallel, in one pass for all operations.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import re
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions import text as T
from cartulary.functions.front import as_string, build_raw, parse
from cartulary.functions.headings import section
from cartulary.functions.paths import is_reserved, resolve_link

OPERATIONS = ("create", "replace_text", "edit_section", "patch_frontmatter", "replace_body", "move", "delete", "add_relation", "remove_relation", "transition_status", "apply_fix")
MUTATION = "path string, op string, content string"
#: Fields that hold texts, what links to a deleted note may become, references from which a loss is a
#: medium and a high risk, seconds a plan is good for.
TEXTS = ("type", "title", "description", "resource", "status")
POLICIES = ("reject", "remove_links", "retarget", "create_stub")
MEDIUM, HIGH = 1, 5
LASTS = 3600
_LINK = re.compile(r'\[([^\]]*)\]\(([^)\s]+)(?:\s+"[^"]*")?\)')


class PlanError(ValueError):
    """An operation that can't be planned, or a plan that can't be applied; ``code`` says why."""

    def __init__(self, code: str, text: str):
        super().__init__(f"{code}: {text}")
        self.code = code


def split(raw: str) -> tuple[dict[str, Any], str]:
    """Front matter as values and the body of one text; malformed front matter counts as empty."""
    m = re.match(r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\Z", raw)
    if not m:
        return {}, raw
    return {p["key"]: json.loads(p["json"]) for p in parse(m[1])["pairs"]}, m[2]


def patched(front: dict[str, Any], patch: dict[str, Any]) -> dict[str, Any]:
    """Fields after a merge patch: null takes a field away, anything else is put in its place."""
    out = dict(front)
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = as_string(v) if k in TEXTS else v
    return out


def clean_path(path: Any) -> str:
    """A path of a corpus as it is stored; an invalid one is an error."""
    parts = path.split("/") if isinstance(path, str) else []
    if not path or path.startswith("/") or "\\" in path or ".." in parts or re.match("[A-Za-z]:", path) or not [p for p in parts if p not in ("", ".")]:
        raise PlanError("INVALID_SCHEMA", f"{path!r} is no path")
    return "/".join(p for p in parts if p not in ("", "."))


def title_of(path: str) -> str:
    name = re.sub(r"\.md$", "", path.rpartition("/")[2]).translate(str.maketrans("-_", "  "))
    return re.sub("[A-Za-z0-9]+", lambda m: m[0][0].upper() + m[0][1:], name)


def fix_id(source: str, relation: str, target: str) -> str:
    return "fix:sha256:" + hashlib.sha256("\x00".join((source, relation, target)).encode()).hexdigest()


def _own(o: dict[str, Any], *names: str, default: Any = None) -> Any:
    return next((o[n] for n in names if n in o), default)


class Planner:
    """Plans operations over ``files`` (path, raw), with ``types`` and ``relations`` as ``schema.load_catalogue`` gives them."""

    def __init__(self, files: DataFrame, types: DataFrame | None = None, relations: DataFrame | None = None):
        self.files, self.spark, self.types, self.relations = files.select("path", "raw"), files.sparkSession, types, relations
        self.texts: dict[str, str | None] = {}

    # --- what operations need to know of the corpus ----------------------------------------------------------------

    def _look_up(self, paths: set[str]) -> None:
        """Texts of the paths that operations name; there are as many as operations name, not as many as files."""
        new = [p for p in paths if p not in self.texts]
        if new:
            self.texts |= dict.fromkeys(new)
            self.texts |= {r.path: r.raw for r in self.files.filter(F.col("path").isin(new)).groupBy("path").agg(F.max("raw").alias("raw")).collect()}

    def _text(self, path: str) -> str:
        raw = self.texts.get(path)
        if raw is None:
            raise PlanError("CONCEPT_NOT_FOUND", f"{path} doesn't exist")
        return raw

    def _linking(self, targets: list[str]) -> DataFrame:
        """Notes that link to any of ``targets``: (path, raw, targets). Index and log pages don't count, nor links of a note
        to itself."""
        own = F.transform(T.hrefs(T.body_text(F.col("raw"))), lambda h: resolve_link(h, F.col("path")))
        met = F.array_remove(F.array_intersect(F.array_compact(own), F.array(*map(F.lit, targets))), F.col("path"))
        notes = self.files.filter(~is_reserved("path") & F.col("raw").contains("](")).dropDuplicates(["path"])
        return notes.select("path", "raw", met.alias("targets")).filter(F.size("targets") > 0)

    def inbound(self, paths: list[str]) -> dict[str, int]:
        """Number of notes that link to each of ``paths``."""
        if not paths:
            return {}
        rows = self._linking(paths).select(F.explode("targets").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()
        return {r.t: r.n for r in rows}

    def _type(self, path: str) -> str | None:
        raw = self.texts.get(path)
        return None if raw is None else split(raw)[0].get("type")

    def _of_type(self, name: str | None):
        rows = [] if self.types is None or name is None else self.types.filter(F.col("name") == name).limit(1).collect()
        return rows[0] if rows else None

    # --- operations to steps ---------------------------------------------------------------------------------------

    def steps(self, operations: list[dict[str, Any]]) -> list[dict[str, Any]]:
        """Operations as steps: create, patch, body, move, delete and relink."""
        named = set()
        for o in operations:
            if o.get("op") not in OPERATIONS:
                raise PlanError("INVALID_SCHEMA", f"{o.get('op')!r} is no operation")
            named |= {clean_path(v) for v in (self._path(o), o.get("to") if o["op"] == "move" else None, o.get("target")) if v is not None}
        self._look_up(named)
        out = []
        for o in operations:
            expected = o.get("expectedRevision")
            if expected:
                raw = self.texts.get(clean_path(self._path(o)))
                if raw is None or "sha256:" + hashlib.sha256(raw.encode()).hexdigest() != expected:
                    raise PlanError("REVISION_CONFLICT", f"{self._path(o)} has another revision")
            path = None if o["op"] == "apply_fix" else clean_path(self._path(o))
            out += getattr(self, f"_{o['op']}")(o, path)
        return out

    @staticmethod
    def _path(o: dict[str, Any]) -> str | None:
        return (o.get("ref") or {}).get("path") or _own(o, "path", "from", "source")

    def _create(self, o, path):
        title = o["title"] if o.get("title") is not None else title_of(path)
        body, kind = o.get("body"), o.get("type") or ""
        if body is None:
            row = self._of_type(kind)
            body = row.body_template.replace("{title}", title) if row and row.body_template is not None else None
        return [{"op": "create", "path": path, "patch": {"type": kind, "title": title}, "body": f"# {title or title_of(path)}\n" if body is None else body}]

    def _replace_text(self, o, path):
        _, body = split(self._text(path))
        old, new, expected = _own(o, "find", "old", default=""), _own(o, "replace", "new", default=""), _own(o, "expectedOccurrences", "expectedCount")
        n = body.count(old) if old else 0
        if expected is not None and n != expected:
            raise PlanError("WRITE_CONFLICT", f"{old!r} stands {n} times in the body of {path}, not {expected}")
        return [{"op": "body", "path": path, "body": body.replace(old, new)}]

    def _edit_section(self, o, path):
        _, body = split(self._text(path))
        names = _own(o, "headingPath", "section", default=[])
        at = section(body, names) if names else (0, len(body))
        if at is None:
            raise PlanError("CONCEPT_NOT_FOUND", f"{path} has no section {names}")
        old, text = body[at[0] : at[1]], o.get("content", "").strip()
        match o.get("mode"):
            case "append":
                new = f"{old.rstrip()}\n\n{text}\n\n"
            case "prepend":
                new = f"\n{text}\n{old.lstrip()}"
            case _:
                new = f"\n{text}\n\n"
        return [{"op": "body", "path": path, "body": body[: at[0]] + new + body[at[1] :]}]

    def _patch_frontmatter(self, o, path):
        self._text(path)
        if not isinstance(o.get("patch"), dict):
            raise PlanError("INVALID_SCHEMA", "a patch must be a map")
        return [{"op": "patch", "path": path, "patch": o["patch"]}]

    def _replace_body(self, o, path):
        self._text(path)
        return [{"op": "body", "path": path, "body": o.get("body") or ""}]

    def _transition_status(self, o, path):
        status, row = _own(o, "to", "status"), self._of_type(self._type(path))
        if not isinstance(status, str):
            raise PlanError("INVALID_SCHEMA", "a transition needs a status")
        if row and row.allowed_statuses and status not in row.allowed_statuses:
            raise PlanError("INVALID_SCHEMA", f"{status!r} is no status of {row.name}")
        return [{"op": "patch", "path": path, "patch": {"status": status}}]

    def _targets(self, path: str, relation: str) -> list[str]:
        v = split(self.texts.get(path) or "")[0].get(relation)
        return [x for x in v if isinstance(x, str)] if isinstance(v, list) else [v] if isinstance(v, str) else []

    def _add_relation(self, o, path):
        relation, target = o.get("relation"), clean_path(o.get("target"))
        own = self._targets(path, relation)
        own = own if target in own else [*own, target]
        kind, other = self._type(path), self._type(target)
        rule = None if self.relations is None or kind is None else self.relations.filter((F.col("name") == kind) & (F.col("relation") == relation)).first()
        if rule and rule.target_types and other is not None and other not in rule.target_types:
            raise PlanError("RELATION_CONSTRAINT_VIOLATION", f"{relation} of {path} may not point to a {other}")
        if rule and rule.cardinality == "one" and len(own) > 1:
            raise PlanError("RELATION_CONSTRAINT_VIOLATION", f"{relation} of {path} may have one target only")
        return [{"op": "patch", "path": path, "patch": {relation: own}}]

    def _remove_relation(self, o, path):
        own = [t for t in self._targets(path, o["relation"]) if t != clean_path(o.get("target"))]
        return [{"op": "patch", "path": path, "patch": {o["relation"]: own}}]

    def _apply_fix(self, o, _):
        """Takes away the broken target of a typed relation that a diagnostic offered to repair under this id."""
        from cartulary.functions.front import parse_files
        from cartulary.operators.schema import broken_relations

        found = None
        if self.relations is not None:
            found = broken_relations(parse_files(self.files), self.relations).filter(F.col("fix_id") == _own(o, "fixId", "fix_id")).first()
        if found is None:
            raise PlanError("INVALID_SCHEMA", f"there is no safe repair {_own(o, 'fixId', 'fix_id')!r}")
        self._look_up({found.path})
        own = [t for t in self._targets(found.path, found.relation) if t != found.target]
        return [{"op": "patch", "path": found.path, "patch": {found.relation: own}}]

    def _move(self, o, path):
        to = clean_path(o.get("to"))
        out = [{"op": "move", "path": path, "to": to}]
        return [*out, {"op": "relink", "path": path, "to": to}] if o.get("rewriteInboundLinks") else out

    def _delete(self, o, path):
        policy = _own(o, "inboundLinksPolicy", "policy", default="reject")
        policy = policy if policy in POLICIES else "reject"
        if policy == "reject" and self.inbound([path]):
            raise PlanError("INBOUND_LINKS_EXIST", f"notes link to {path}")
        out = [{"op": "delete", "path": path, "policy": policy}]
        return [*out, {"op": "relink", "path": path, "to": None}] if policy == "remove_links" else out

    # --- steps to a mutation ---------------------------------------------------------------------------------------

    def mutation(self, operations: list[dict[str, Any]]) -> DataFrame:
        """All operations as (path, op, content), ``op`` being write or delete; files that stay as they are give no row."""
        return self.fold(self.steps(operations))

    def fold(self, steps: list[dict[str, Any]]) -> DataFrame:
        """The mutation of steps, applied one after another."""
        named = {s["path"] for s in steps if s["op"] != "relink"} | {s["to"] for s in steps if s["op"] == "move"}
        self._look_up(named)
        now = {p: self.texts[p] for p in named if self.texts[p] is not None}
        for s in steps:
            match s["op"]:
                case "create":
                    now[s["path"]] = build_raw(patched({}, s["patch"]), s["body"])
                case "patch":
                    front, body = split(now.get(s["path"], ""))
                    now[s["path"]] = build_raw(patched(front, s["patch"]), body)
                case "body":
                    now[s["path"]] = build_raw(split(now.get(s["path"], ""))[0], s["body"])
                case "move" if s["path"] in now:
                    now[s["to"]] = now.pop(s["path"])
                case "delete":
                    now.pop(s["path"], None)
                case "relink":
                    for p in named:  # as they were before the plan, like every other note that links there
                        new = relinked(p, self.texts[p], s) if self.texts[p] is not None else None
                        if new is not None:
                            now[p] = build_raw(split(now.get(p, ""))[0], new)
        rows = [(p, "write", now[p]) if p in now else (p, "delete", None) for p in sorted(named) if now.get(p) != self.texts[p]]
        out = self.spark.createDataFrame(rows, MUTATION)
        links = [s for s in steps if s["op"] == "relink"]
        if not links:
            return out

        def run(batches):
            for df in batches:
                new = [next((x for s in reversed(links) if (x := relinked(p, r, s)) is not None), None) for p, r in zip(df.path, df.raw, strict=True)]
                df["content"] = [r if x is None else build_raw(split(r)[0], x) for r, x in zip(df.raw, new, strict=True)]
                yield df[df.content != df.raw].assign(op="write")[["path", "op", "content"]]

        linking = self._linking(sorted({s["path"] for s in links})).filter(~F.col("path").isin(sorted(named)))
        return out.unionByName(linking.select("path", "raw").mapInPandas(run, MUTATION))

    def risk(self, steps: list[dict[str, Any]]) -> dict[str, Any]:
        """Level and reasons: notes that are deleted, moved or deprecated, by the number of notes that link to them."""
        loss = [(s["path"], s["op"]) for s in steps if s["op"] in ("move", "delete") or (s["op"] == "patch" and s["patch"].get("status") == "deprecated")]
        n = self.inbound(sorted({p for p, _ in loss}))
        met = [(p, op, n[p]) for p, op in loss if n.get(p)]
        level = "high" if any(k >= HIGH for *_, k in met) else "medium" if any(k >= MEDIUM for *_, k in met) else "low"
        return {"level": level, "reasons": [f"{'deprecate' if op == 'patch' else op} {p}: {k} note{'s' if k > 1 else ''} link to it" for p, op, k in met]}


def relinked(source: str, raw: str, step: dict[str, Any]) -> str | None:
    """The body of a note with its links to a step's path rewritten; null if it has none."""
    if source == step["path"] or source.rpartition("/")[2] in ("index.md", "log.md"):
        return None
    _, body = split(raw)
    new, n = relink(source, body, step["path"], step["to"])
    return new if n else None


def relink(source: str, body: str, old: str, new: str | None) -> tuple[str, int]:
    """A body with the links of ``source`` to ``old`` changed to ``new``, and how many there are.

    A link from the root stays one, any other becomes relative to the source's folder, with ``./`` before a page of the
    same folder; what follows ``#`` or ``?`` is kept. With ``new`` None only the text of a link is left.
    """
    folder, n = source.rpartition("/")[0], 0

    def one(m: re.Match) -> str:
        nonlocal n
        bare = re.match(r"[^#?]*", m[2])[0]
        page = bare + "index.md" if bare.endswith("/") else bare
        if re.match(r"[A-Za-z]+:", m[2]) or not page.endswith(".md"):
            return m[0]
        if (_kept(page[1:]) if page.startswith("/") else _normal(f"{folder}/{page}")) != old:
            return m[0]
        n += 1
        if new is None:
            return m[1]
        to = posixpath.relpath(new, folder or ".")
        to = f"/{new}" if page.startswith("/") else to if "/" in to else f"./{to}"
        return f"[{m[1]}]({to}{m[2][len(bare) :]})"

    return _LINK.sub(one, body), n


def _kept(path: str) -> str | None:
    try:
        return clean_path(path)
    except PlanError:
        return None


def _normal(path: str) -> str:
    out: list[str] = []
    for s in path.split("/"):
        if s == "..":
            out[-1:] = []
        elif s not in ("", "."):
            out.append(s)
    return "/".join(out)


def simulate(files: DataFrame, mutation: DataFrame) -> DataFrame:
    """The corpus (path, raw) after a mutation: untouched files and what is written."""
    kept = files.select("path", "raw").join(mutation.select("path"), "path", "left_anti")
    return kept.unionByName(mutation.filter("op = 'write'").select("path", F.col("content").alias("raw")))


def restore(before: DataFrame, after: DataFrame) -> DataFrame:
    """The mutation that brings the state ``after`` back to ``before``."""
    a, b = before.select("path", F.col("raw").alias("old")), after.select("path", F.col("raw").alias("new"))
    both = a.join(b, "path", "full").filter("NOT (old <=> new)")
    return both.select("path", F.when(F.col("old").isNull(), "delete").otherwise("write").alias("op"), F.col("old").alias("content"))


def regenerated(files: DataFrame, pages: DataFrame, tag_pages: DataFrame) -> DataFrame:
    """The mutation that brings generated pages up to date: index pages that exist (those of tags apart), all tag pages,
    and tag pages that are stale away."""
    from cartulary.operators.generate import stale_pages

    there = files.select("path", "raw").dropDuplicates(["path"])
    own = pages.filter(~F.col("path").startswith("tags/")).join(there, "path").filter("content <> raw").select("path", "content")
    tags = tag_pages.join(there, "path", "left").filter("NOT (content <=> raw)").select("path", "content")
    out = own.unionByName(tags).select("path", F.lit("write").alias("op"), "content")
    return out.unionByName(stale_pages(files, tag_pages).select("path", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("content")))


def overlaid(mutation: DataFrame, later: DataFrame) -> DataFrame:
    """One mutation of two; on a path of both the later holds."""
    return mutation.join(later.select("path"), "path", "left_anti").unionByName(later)


def affected(mutation: DataFrame, inbound: DataFrame) -> DataFrame:
    """Files that a mutation touches or that link to one it touches: distinct (path)."""
    own = mutation.select("path")
    return own.union(inbound.join(own.withColumnRenamed("path", "dst"), "dst", "left_semi").select("src")).distinct()


def refused(mutation: DataFrame, writable: list[str], references: list[str]) -> DataFrame:
    """Paths of a mutation that may not be written: below a root that is only referred to, or outside of the roots that
    may be written where there are any."""
    from cartulary.functions.paths import under

    inside = lambda roots: F.exists(F.array(*(under("path", r) for r in roots)), lambda x: x)
    bad = inside(references) if references else F.lit(False)
    return mutation.filter(bad | ~inside(writable) if writable else bad).select("path")


def plan_hash(base_revision: str, steps: list[dict[str, Any]]) -> str:
    text = base_revision + "\x00" + json.dumps(steps, sort_keys=True, ensure_ascii=False)
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def can_apply(errors: int, warnings: int, require_conformant: bool = True, allow_warnings: bool = True) -> bool:
    """Whether a result with these numbers of diagnostics may be applied."""
    return not (require_conformant and errors) and (allow_warnings or not warnings)
