"""Queries over states that are made of the given tables: changes, merges, plans, typed relations and views of a workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions.front import parse_files
from cartulary.operators import checks as C
from cartulary.operators import diff as D
from cartulary.operators import links as L
from cartulary.operators import plan
from cartulary.operators import schema as S
from cartulary.operators import search
from cartulary.plans import notes as N
from cartulary.plans.facade import Workspace
from cartulary.plans.notes import GLOSSARY

QUERIES: dict = {}
SQL: dict[str, str] = {}
_F, _OUT, _WITH = N._F, N._OUT, N._WITH


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(N.Tables(spark, d))
        SQL[f.__name__] = sql
        return f

    return add


# --- changes between two states: titled notes get a link, others without a status go, one note comes ------------------


def _after(t) -> DataFrame:
    own = t.files.filter("title IS NOT NULL OR status IS NOT NULL OR kind <> 'concept'")
    more = F.concat("raw", F.when(F.col("title").isNotNull(), "\n\n[nuevo](/comun/nuevo.md)\n").otherwise(""))
    new = t.spark.createDataFrame([("comun/nuevo.md", "---\ntype: Nota\n---\n\n# Nuevo\n")], "path string, raw string")
    return own.select("path", more.alias("raw")).unionByName(new).distinct()


def _before(t) -> DataFrame:
    return t.files.select("path", "raw").distinct()


_GONE = "SELECT path FROM f WHERE title IS NULL AND status IS NULL AND kind = 'concept'"


@query(_WITH + f"SELECT path, 'modified' AS change FROM f WHERE title IS NOT NULL UNION ALL SELECT path, 'removed' FROM ({_GONE}) UNION ALL SELECT 'comun/nuevo.md', 'added'")
def diff_files(t):
    return D.file_diff(_before(t), _after(t)).select("path", "change")


@query(
    f"""WITH {_F}, {_OUT} SELECT src, dst, 'removed' AS change FROM ol WHERE src IN ({_GONE})
        UNION ALL SELECT path, 'comun/nuevo.md', 'added' FROM f WHERE title IS NOT NULL AND path NOT IN (SELECT src FROM ol WHERE dst = 'comun/nuevo.md')"""
)
def diff_links(t):
    return D.link_changes(L.out_links(parse_files(_before(t))), L.out_links(parse_files(_after(t))))


@query(
    _WITH + """SELECT path, unnest(CASE WHEN n > 4 THEN ['equal', 'gap', 'add'] ELSE ['equal', 'add'] END) AS op,
            unnest(CASE WHEN n > 4 THEN [2, 1, 3] ELSE [n, 3] END)::BIGINT AS n FROM (SELECT path, len(string_split(body, E'\\n')) AS n FROM f WHERE title IS NOT NULL)"""
)
def diff_lines(t):
    """Numbers of lines kept around the three that are added at the end of a text, and of gaps."""
    lines = D.with_lines(D.file_diff(_before(t), _after(t)).filter("change = 'modified'"))
    return lines.select("path", F.explode("lines").alias("x")).groupBy("path", F.col("x.op").alias("op")).agg(F.count("*").alias("n"))


_LOCAL = " UNION ALL ".join(f"SELECT path, '{c}' AS code FROM ({sql})" for c, (_, sql) in N._RULES.items() if not c.startswith("SCHEMA") and c not in ("ORPHAN", "LINK-STUB"))


@query(
    _WITH + f"""SELECT path, code, 'resolved' AS change FROM ({_LOCAL}) WHERE path IN ({_GONE})
            UNION ALL SELECT 'comun/nuevo.md', unnest(['REC-TITLE', 'REC-DESC']), 'introduced'"""
)
def diff_diagnostics(t):
    a, b = (C.local_checks(parse_files(x)) for x in (_before(t), _after(t)))
    return D.diagnostic_changes(a, b).select("path", "code", "change")


@query(_WITH + "SELECT path, 'status' AS field, coalesce(status, '') AS before, 'cambiado' AS after FROM ok WHERE regexp_matches(front, '(?m)^status: ')")
def diff_fields(t):
    new = t.files.withColumn("raw", F.regexp_replace("raw", r"(?s)\A(---\r?\n(?:(?!\r?\n---\r?\n).)*?(?<=\n)status: )[^\n\r]*", "$1cambiado"))
    return D.field_changes(parse_files(_before(t)), parse_files(new.select("path", "raw").distinct())).filter("field = 'status'").select("path", "field", "before", "after")


@query(
    _WITH + """SELECT path, title IS NOT NULL AND status IS NOT NULL AS conflict, md5(CASE WHEN title IS NULL AND status IS NULL THEN raw WHEN status IS NULL THEN raw || 'a'
            WHEN title IS NULL THEN raw || 'b' ELSE E'<<<<<<< ours\\n' || raw || E'a=======\\n' || raw || E'b>>>>>>> theirs\\n' END) AS digest FROM f"""
)
def merge_states(t):
    return _merged(t).select("path", "conflict", F.md5("raw").alias("digest"))


def _merged(t) -> DataFrame:
    side = lambda c, x: t.files.select("path", F.concat("raw", F.when(F.col(c).isNotNull(), x).otherwise("")).alias("raw")).distinct()
    return D.three_way(_before(t), side("title", "a"), side("status", "b"))


@query(_WITH + "SELECT path, 'err' AS level FROM f WHERE title IS NOT NULL AND status IS NOT NULL")
def check_merge_marks(t):
    """Conflict marks that a merge leaves, as the check of conflicts finds them."""
    own = t.files.filter("title IS NOT NULL AND status IS NOT NULL").select("path", F.concat(F.lit("<<<<<<< ours\n"), "raw", F.lit("\n=======\n")).alias("raw")).distinct()
    rest = _before(t).join(own.select("path"), "path", "left_anti")
    return C.local_checks(parse_files(own.unionByName(rest))).filter("code = 'OKF-CONFLICT'").select("path", "level")


@query(_WITH + r"SELECT path FROM f WHERE kind = 'log' AND regexp_matches(raw, '(?m)^## \d{4}-\d{2}-')")
def check_log_dates(t):
    new = t.files.select("path", F.regexp_replace("raw", r"(?m)^## (\d{4})-(\d{2})-", "## $1/$2/").alias("raw"))
    return C.local_checks(parse_files(new)).filter("code = 'OKF-LOG'").select("path")


@query(_WITH + "SELECT path FROM f WHERE kind = 'concept' AND status IS NULL")
def check_malformed(t):
    new = t.files.select("path", F.when(F.col("status").isNull(), "---\ntitle: [x\n---\n").otherwise(F.col("raw")).alias("raw"))
    return C.local_checks(parse_files(new)).filter("code = 'OKF-FM03'").select("path")


# --- typed relations: every note cites what it links to ---------------------------------------------------------------


def _citing(t, key: str = "cites") -> DataFrame:
    cited = t.links.filter("dst IS NOT NULL").groupBy(F.col("src").alias("path")).agg(F.to_json(F.sort_array(F.collect_set("dst"))).alias("own"))
    kind = F.when(F.col("type").isNotNull(), F.concat(F.lit("type: "), F.to_json(F.array("type")).substr(F.lit(2), F.length(F.to_json(F.array("type"))) - 2), F.lit("\n"))).otherwise("")
    cites = F.when(F.col("own").isNotNull(), F.concat(F.lit(f"{key}: "), "own", F.lit("\n"))).otherwise("")
    return t.concepts.select("path", "type").distinct().join(cited, "path", "left").select("path", F.concat(F.lit("---\n"), kind, cites, F.lit("---\n")).alias("raw"))


def _relations(t) -> DataFrame:
    one = F.when(F.col("body_template").isNotNull(), "one").otherwise("many")
    return t.types.select("name", F.lit("cites").alias("relation"), F.array("name").alias("target_types"), one.alias("cardinality"))


_CITES = r"""c AS (SELECT DISTINCT a.path, a.type, l.dst, regexp_replace(l.dst, '(^|/)(\./|/)+', '\1', 'g') AS goal FROM l JOIN f a ON a.path = l.src AND a.kind = 'concept' JOIN doc_types d ON d.name = a.type),
    rc AS (SELECT path, 'REL-CARD' AS code, 1 AS n FROM c JOIN doc_types d ON d.name = c.type AND body_template IS NOT NULL GROUP BY path HAVING count(DISTINCT dst) > 1),
    rt AS (SELECT path, 'REL-TARGET' AS code, count(*) AS n FROM c WHERE goal NOT IN (SELECT path FROM f WHERE kind = 'concept') GROUP BY path),
    ry AS (SELECT c.path, 'REL-TYPE' AS code, count(*) AS n FROM c JOIN f b ON b.path = c.goal AND b.kind = 'concept' WHERE b.type <> c.type GROUP BY c.path)"""


@query(f"WITH {_F}, {_CITES} SELECT path, code, n::BIGINT AS n FROM (SELECT * FROM rc UNION ALL SELECT * FROM rt UNION ALL SELECT * FROM ry)")
def check_relations(t):
    return S.relation_checks(parse_files(_citing(t)), _relations(t)).groupBy("path", "code").agg(F.count("*").alias("n"))


@query(f"WITH {_F}, {_CITES} SELECT path, dst AS target, 'fix:sha256:' || sha256(path || chr(0) || 'cites' || chr(0) || dst) AS fix_id FROM c WHERE goal NOT IN (SELECT path FROM f WHERE kind = 'concept')")
def relation_fixes(t):
    return S.broken_relations(parse_files(_citing(t)), _relations(t)).select("path", "target", "fix_id")


@query(_WITH + "SELECT a.path, count(*) AS n FROM l JOIN f a ON a.path = l.src AND a.kind = 'concept' WHERE l.dst <> '' AND (NOT starts_with(l.dst, 'comun/') OR l.dst NOT IN (SELECT path FROM f)) GROUP BY a.path")
def check_external(t):
    c = S.external_references(parse_files(_citing(t, "implemented_by")), t.files.select("path"), ["comun"])
    return c.groupBy("path").agg(F.count("*").alias("n"))


# --- plans -----------------------------------------------------------------------------------------------------------

_X = "(SELECT min(path) FROM ok WHERE title IS NOT NULL AND status IS NOT NULL)"
_LINKED = "(SELECT min(dst) FROM (SELECT dst FROM ol JOIN f a ON a.path = src AND a.kind = 'concept' JOIN f b ON b.path = dst AND b.kind = 'concept' WHERE dst <> '" + GLOSSARY + "' GROUP BY dst HAVING count(*) > 2))"


def _much_linked(t) -> str:
    n = L.inbound(L.out_links(t.files), t.files).filter((F.col("n") > 2) & (F.col("path") != GLOSSARY))
    return n.agg(F.min("path")).first()[0] or ""


@query(_WITH + f"SELECT path, 'revisado' AS status, title, replace(body, 'e', 'E') AS body FROM f WHERE path = {_X}")
def plan_compose(t):
    """A patch of the front matter and a new text of the body of one note in one change set: both hold."""
    x = parse_files(t.files).filter("kind = 'concept' AND fm_error IS NULL AND title IS NOT NULL AND status IS NOT NULL").agg(F.min("path")).first()[0] or ""
    planner = plan.Planner(t.files)
    m = planner.mutation([{"op": "patch_frontmatter", "path": x, "patch": {"status": "revisado"}}, {"op": "replace_text", "path": x, "find": "e", "replace": "E"}])
    return parse_files(plan.simulate(t.files, m)).filter(F.col("path") == x).select("path", "status", "title", "body")


@query(
    f"""WITH {_F}, {_OUT}, y AS (SELECT {_LINKED} AS y), both_ AS (SELECT src FROM ol WHERE dst = (SELECT y FROM y))
        SELECT src, CASE WHEN dst = (SELECT y FROM y) THEN 'comun/m2.md' WHEN src IN (SELECT src FROM both_) THEN dst ELSE 'comun/m1.md' END AS dst
        FROM ol JOIN f ON path = src AND kind = 'concept' WHERE dst IN ('{GLOSSARY}', (SELECT y FROM y)) AND src NOT IN ('{GLOSSARY}', (SELECT y FROM y))"""
)
def plan_two_moves(t):
    """Links after two moves in one change set: a note that links to both has the body that the later one gave it."""
    y = _much_linked(t)
    m = plan.Planner(t.files).mutation([{"op": "move", "from": p, "to": f"comun/m{i}.md", "rewriteInboundLinks": True} for i, p in ((1, GLOSSARY), (2, y))])
    after = parse_files(plan.simulate(t.files, m))
    own = L.out_links(after.filter("kind = 'concept'")).filter(F.col("dst").isin(GLOSSARY, y, "comun/m1.md", "comun/m2.md") & ~F.col("src").isin("comun/m1.md", "comun/m2.md"))
    return own.select("src", "dst")


@query(
    f"""WITH {_F}, {_OUT}, y AS (SELECT {_LINKED} AS y)
        SELECT src, dst FROM ol JOIN f ON path = src AND kind = 'concept' WHERE src IN (SELECT src FROM ol WHERE dst = (SELECT y FROM y)) AND dst <> (SELECT y FROM y)"""
)
def plan_delete(t):
    """The links that are left to notes that linked to a deleted one."""
    y = _much_linked(t)
    m = plan.Planner(t.files).mutation([{"op": "delete", "path": y, "inboundLinksPolicy": "remove_links"}])
    written = m.filter("op = 'write'").select("path")
    return L.out_links(parse_files(plan.simulate(t.files, m)).join(written, "path", "left_semi")).select("src", "dst")


@query(f"WITH {_F}, {_OUT} SELECT 'high' AS level, count(*) AS links FROM ol JOIN f ON path = src AND kind = 'concept' WHERE dst = '{GLOSSARY}'")
def plan_risk(t):
    planner = plan.Planner(t.files)
    steps = planner.steps([{"op": "move", "from": GLOSSARY, "to": "comun/moved.md"}])
    return t.spark.createDataFrame([(planner.risk(steps)["level"], planner.inbound([GLOSSARY])[GLOSSARY])], "level string, links bigint")


# --- views of a workspace --------------------------------------------------------------------------------------------


def _impact_sql(root: str) -> str:
    return f"""WITH RECURSIVE {_F}, {_OUT}, n2 AS (SELECT ol.src, ol.dst FROM ol JOIN f a ON a.path = ol.src AND a.kind = 'concept' JOIN f b ON b.path = ol.dst AND b.kind = 'concept'),
        root AS (SELECT {root} AS root), r AS (SELECT root AS node FROM root UNION SELECT n2.src FROM r JOIN n2 ON n2.dst = r.node),
        k AS (SELECT (SELECT count(*) FROM n2 WHERE dst = (SELECT root FROM root)) AS direct, (SELECT count(*) - 1 FROM r) AS transitive)
        SELECT *, 0::BIGINT AS blockers, CASE WHEN direct >= 20 THEN 'high' WHEN direct >= 5 OR transitive >= 5 THEN 'medium' ELSE 'low' END AS risk FROM k"""


def _impact(t, root: str) -> DataFrame:
    i = Workspace(_before(t)).impact(root)
    return t.spark.createDataFrame([(i["direct"], i["transitive"], i["blockers"], i["risk"])], "direct bigint, transitive bigint, blockers bigint, risk string")


@query(_impact_sql(f"'{GLOSSARY}'"))
def impact_glossary(t):
    return _impact(t, GLOSSARY)


_FEW = "(SELECT min(dst) FROM (SELECT dst FROM n2 GROUP BY dst HAVING count(*) BETWEEN 2 AND 3))"


@query(_impact_sql(_FEW))
def impact_transitive(t):
    """A note with few references of its own."""
    few = L.inbound(L.out_links(t.files), t.files).filter("n BETWEEN 2 AND 3").agg(F.min("path")).first()[0] or ""
    return _impact(t, few)


_PAGE = f"""WITH {_F}, {_OUT}, pg AS (SELECT DISTINCT id FROM (SELECT src AS id FROM ol JOIN f ON path = src AND kind = 'concept' WHERE dst = '{GLOSSARY}' UNION ALL SELECT '{GLOSSARY}')
            ORDER BY id LIMIT 40 OFFSET 10) """


@query(_PAGE + "SELECT id, false AS ghost, type, status FROM pg JOIN f ON path = id")
def graph_page_nodes(t):
    return Workspace(_before(t)).graph_page("neighborhood", GLOSSARY, direction="in", limit=40, cursor=search.cursor_of(10))["nodes"]


@query(f"WITH {_F}, {_OUT} SELECT src, dst, false AS dangling FROM ol JOIN f ON path = src AND kind = 'concept' WHERE dst = '{GLOSSARY}'")
def graph_page_edges(t):
    return Workspace(_before(t)).graph_page("backlinks", GLOSSARY)["edges"]


@query(
    f"""WITH {_F}, {_OUT}, y AS (SELECT {_LINKED} AS y), yy AS (SELECT y FROM y)
        SELECT CASE WHEN kind = 'index' THEN 'index' ELSE 'inbound' END AS kind, src AS path, CASE WHEN kind <> 'index' THEN href END AS href FROM ol JOIN f ON path = src AND kind <> 'log' WHERE dst = (SELECT y FROM yy)
        UNION ALL SELECT 'out', dst, NULL FROM ol JOIN f ON path = dst AND kind = 'concept' WHERE src = (SELECT y FROM yy)
        UNION ALL SELECT DISTINCT 'dangling', NULL, href FROM o WHERE src = (SELECT y FROM yy) AND dst NOT IN (SELECT path FROM f)"""
)
def note_view(t):
    return L.note_view(parse_files(t.files), _much_linked(t))


@query(
    _WITH + f"""SELECT path, type, coalesce(title, '') = '' AS untitled, path IN (SELECT path FROM orph) AS orphan, path IN ({N._INVALID}) AS invalid FROM f WHERE kind = 'concept'"""
)
def note_summaries(t):
    own = C.summaries(parse_files(t.files), L.orphans(t.links, t.files), t.checks)
    there = parse_files(t.files).select("path", F.coalesce("title", F.lit("")).alias("written")).distinct()
    return own.join(there, "path").select("path", "type", (F.col("written") == "").alias("untitled"), "orphan", "invalid")


@query(_WITH + "SELECT path FROM ok WHERE len(list_filter(CASE json_type(fm, '$.tags') WHEN 'ARRAY' THEN (fm ->> '$.tags[*]')::VARCHAR[] ELSE [fm ->> '$.tags'] END, lambda x: lower(x) IN ('parser', 'catálogo'))) > 0")
def search_tags(t):
    return search.narrowed(t.parsed.filter("kind = 'concept'"), tags=["Parser", "catálogo"]).select("path").distinct()


@query(_WITH + f"SELECT path, level, code FROM ({N._ALL}) WHERE level IN ('warn', 'err') ORDER BY path, code LIMIT 100")
def check_first_page(t):
    return C.page(t.checks, "warn", 0, 100).select("path", "level", "code")


@query(_WITH + f"SELECT code AS rule, CASE level WHEN 'err' THEN 'error' WHEN 'warn' THEN 'warning' ELSE 'note' END AS level, path AS uri, count(*) AS n FROM ({N._ALL}) GROUP BY ALL")
def sarif_rules(t):
    from cartulary.sources import sinks

    get = lambda p, n: F.get_json_object("result", p).alias(n)
    own = sinks.sarif(t.checks).select(get("$.ruleId", "rule"), get("$.level", "level"), get("$.locations[0].physicalLocation.artifactLocation.uri", "uri"))
    return own.groupBy("rule", "level", "uri").agg(F.count("*").alias("n"))


@query(N.SQL["index_pages"].replace("SELECT d || 'index.md' AS path", "SELECT path, what FROM (SELECT p.path, CASE WHEN f.raw IS NULL THEN 'absent' ELSE 'differs' END AS what FROM (SELECT d || 'index.md' AS path") + ") p LEFT JOIN f ON f.path = p.path WHERE f.raw IS NULL OR f.raw <> p.content)")
def drifted_pages(t):
    from cartulary.operators import generate as G

    return G.drift(t.files, G.index_pages(t.parsed)).filter("what <> 'stale'")


@query(
    _WITH + """SELECT DISTINCT path, trim(tag, E' \\t\\r\\n' || chr(160)) AS tag FROM (SELECT path, unnest((fm ->> '$.tags[*]')::VARCHAR[]) AS tag
            FROM ok WHERE json_type(fm, '$.tags') = 'ARRAY') WHERE trim(tag, E' \\t\\r\\n' || chr(160)) <> ''"""
)
def note_tag_lists(t):
    from cartulary.operators import generate as G

    return G.note_tags(t.parsed, lists_only=True)


@query(_WITH + "SELECT path FROM f WHERE title IS NOT NULL OR (status IS NULL AND kind = 'concept') UNION ALL SELECT 'comun/nuevo.md'")
def dirty_paths(t):
    from cartulary.sources import corpus

    return corpus.dirty(_before(t), _after(t))
