"""Queries over the notes, links and tags of the given tables, each with SQL that must give the same rows."""

from __future__ import annotations

import uuid
from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import paths as P
from cartulary.functions import text as T
from cartulary.functions.front import parse_files
from cartulary.functions.headings import parse_headings
from cartulary.operators import checks as C
from cartulary.operators import generate as G
from cartulary.operators import graph, history, plan
from cartulary.operators import links as L
from cartulary.operators import revisions as R
from cartulary.operators import schema as S
from cartulary.operators import search
from cartulary.session import materialize, shared_dir
from cartulary.sources import corpus, sinks
from cartulary.streaming.feed import Feed

GLOSSARY = "comun/glosario/terminos.md"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


class Tables:
    """The tables of one folder as a corpus: parsed notes, their own links, the link table.

    Repeated rows of a file stay in: what is made of them is made distinct in the end, when it is narrow, so no texts
    are exchanged. ``rows`` is for what counts within the texts.
    """

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.d = spark, d
        self.files = table(spark, d, "files")
        self.rows = self.files.dropDuplicates(["path"])
        self.links = table(spark, d, "links")
        self.types = table(spark, d, "doc_types")

    @property
    def parsed(self) -> DataFrame:
        return parse_files(self.files)

    @cached_property
    def ruled(self) -> DataFrame:
        """What checks need of each parsed note, with the rules of single notes; parsed once and without its texts."""
        return materialize(C.with_rules(self.parsed).select("path", "kind", "fm_error", "type", "status", "pairs", "rules"))

    @property
    def concepts(self) -> DataFrame:
        return self.files.filter("kind = 'concept'")

    @property
    def edges(self) -> DataFrame:
        return graph.graph_edges(self.links, self.concepts)

    @cached_property
    def checks(self) -> DataFrame:
        return C.analyze(self.ruled, self.links).unionByName(S.schema_checks(self.ruled, self.types))


_FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$"
_F = f"""
    f AS (SELECT path, any_value(kind) AS kind, any_value(type) AS type, any_value(title) AS title, any_value(description) AS description,
                 any_value(status) AS status, any_value(resource) AS resource, any_value(frontmatter_json) AS fm, any_value(body) AS body,
                 any_value(raw) AS raw FROM files GROUP BY path),
    e AS (SELECT *, CASE WHEN kind <> 'concept' THEN NULL WHEN NOT starts_with(raw, '---') THEN 'missing'
                         WHEN NOT regexp_matches(raw, '{_FRONT}') THEN 'unclosed' END AS err,
                 CASE WHEN starts_with(raw, '---') THEN regexp_extract(raw, '{_FRONT}', 1) ELSE '' END AS front FROM f),
    ok AS (SELECT * FROM e WHERE kind = 'concept' AND err IS NULL),
    l AS (SELECT DISTINCT src, dst FROM links WHERE dst IS NOT NULL),
    nl AS (SELECT l.* FROM l JOIN f a ON a.path = l.src AND a.kind = 'concept' JOIN f b ON b.path = l.dst AND b.kind = 'concept'),
    idx AS (SELECT DISTINCT dst AS path FROM l WHERE regexp_matches(src, '(^|/)index\\.md$')),
    orph AS (SELECT path FROM f WHERE kind = 'concept' AND path NOT IN (SELECT dst FROM nl) AND path NOT IN (SELECT path FROM idx)),
    ed AS (SELECT l.src, l.dst, b.path IS NULL AS dangling FROM l JOIN f a ON a.path = l.src AND a.kind = 'concept'
           LEFT JOIN f b ON b.path = l.dst AND b.kind = 'concept' WHERE NOT regexp_matches(l.dst, '(^|/)(index|log)\\.md$'))"""
_WITH = f"WITH {_F} "
_REC = f"WITH RECURSIVE {_F}, "

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(Tables(spark, d))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(_WITH + "SELECT path, kind, type, title, description, status, resource FROM f")
def parsed_fields(t):
    return t.parsed.select("path", "kind", "type", "title", "description", "status", "resource").distinct()


@query(
    _WITH
    + r"""SELECT path, CASE WHEN coalesce(title, '') <> '' THEN title ELSE list_reduce(list_transform(regexp_extract_all(translate(
          regexp_replace(regexp_extract(path, '[^/]*$'), '\.md$', ''), '-_', '  '), '[A-Za-z0-9]+|[^A-Za-z0-9]'),
          lambda w: CASE WHEN regexp_matches(w, '^[A-Za-z0-9]') THEN upper(w[1]) || w[2:] ELSE w END), lambda x, y: x || y) END AS title
          FROM f WHERE kind = 'concept'"""
)
def title_fallback(t):
    return t.concepts.select("path", F.coalesce(F.nullif("title", F.lit("")), P.title_from_path("path")).alias("title")).distinct()


_OUT = r"""
    h AS (SELECT path AS src, unnest(x) AS href, generate_subscripts(x, 1) AS pos FROM
          (SELECT path, regexp_extract_all(body, '\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)', 1) AS x FROM f)),
    p AS (SELECT *, CASE WHEN ends_with(bare, '/') THEN bare || 'index.md' ELSE bare END AS page
          FROM (SELECT *, regexp_extract(href, '^[^#?]*') AS bare FROM h)),
    o AS (SELECT src, href, pos, CASE WHEN starts_with(page, '/') THEN page[2:] ELSE list_reduce(list_prepend('', string_split(
            regexp_extract(src, '^(.*/)?') || page, '/')), lambda a, s: CASE WHEN s IN ('', '.') THEN a
            WHEN s = '..' THEN regexp_replace(a, '(^|/)[^/]*$', '') WHEN a = '' THEN s ELSE a || '/' || s END) END AS dst
          FROM p WHERE NOT regexp_matches(lower(href), '^[a-z]+:') AND ends_with(page, '.md')),
    ol AS (SELECT src, dst, arg_min(href, pos) AS href, regexp_matches(src, '(^|/)index\.md$')::INT AS src_is_index
           FROM o WHERE dst <> src GROUP BY src, dst)"""


@query(f"WITH {_F}, {_OUT} SELECT src, dst, href, src_is_index FROM ol")
def out_links(t):
    return L.out_links(t.files)


@query(f"WITH {_F}, {_OUT} SELECT count(*) AS links FROM ol")
def links_count(t):
    return L.out_links(t.files).agg(F.count("*").alias("links"))


@query(
    _WITH
    + r"""SELECT path, len(x)::BIGINT AS n FROM (SELECT path, list_filter(regexp_extract_all(body, '\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)', 1),
          lambda h: regexp_matches(h, '^\.{1,2}/') AND contains(h, '.md')) AS x FROM f) WHERE len(x) > 0"""
)
def relative_links(t):
    return t.files.select("path", F.size(T.relative_hrefs(F.col("body"))).cast("bigint").alias("n")).filter("n > 0").distinct()


@query(_WITH + "SELECT path FROM idx")
def in_index(t):
    return L.in_index(t.links)


@query(_WITH + f"SELECT src, min(href) AS href FROM links WHERE dst = '{GLOSSARY}' AND src IN (SELECT path FROM f) GROUP BY src")
def backlinks(t):
    return L.backlinks(t.links, t.files, GLOSSARY)


@query(_WITH + "SELECT dst AS path, count(*) AS n FROM nl GROUP BY dst")
def inbound_degree(t):
    return L.inbound(t.links, t.files)


@query(_WITH + "SELECT path FROM orph")
def orphans(t):
    return L.orphans(t.links, t.files)


_DANGLING = "SELECT l.src, l.dst FROM l JOIN f a ON a.path = l.src AND a.kind = 'concept' LEFT JOIN f b ON b.path = l.dst WHERE b.path IS NULL OR b.kind = 'log'"


@query(_WITH + _DANGLING)
def dangling(t):
    return L.dangling(t.links, t.files)


_STUB = """SELECT a.path, string_agg(l.dst, ' ' ORDER BY l.dst) AS targets FROM l JOIN f a ON a.path = l.src AND a.kind = 'concept'
           WHERE l.dst NOT IN (SELECT path FROM f) GROUP BY a.path"""


@query(_WITH + _STUB)
def link_stubs(t):
    return L.missing_targets(t.links, t.files).select("path", F.array_join("targets", " ").alias("targets"))


_RULES = {
    "OKF-CONFLICT": ("err", r"SELECT path FROM f WHERE regexp_matches(raw, '(?m)^(<{7}|={7}|>{7}|\|{7})')"),
    "OKF-IDX": (
        "warn",
        r"""SELECT path FROM e WHERE kind = 'index' AND trim(front, E' \t\r\n') <> '' AND NOT (NOT contains(path, '/')
            AND regexp_matches(trim(front, E' \t\r\n'), '^\s*okf_version\s*:') AND NOT contains(trim(front, E' \t\r\n'), E'\n'))""",
    ),
    "OKF-LOG": (
        "warn",
        r"""SELECT path FROM f WHERE kind = 'log' AND len(list_filter(regexp_extract_all(raw, '(?m)^##\s+(.+)$'),
            lambda h: NOT regexp_matches(h, '^##\s+\d{4}-\d{2}-\d{2}\s*$'))) > 0""",
    ),
    "OKF-FM01": ("err", "SELECT path FROM e WHERE err = 'missing'"),
    "OKF-FM02": ("err", "SELECT path FROM e WHERE err = 'unclosed'"),
    "OKF-TYPE": ("err", r"SELECT path FROM ok WHERE regexp_replace(coalesce(type, ''), '[\s\x{a0}\x{200b}]', '', 'g') = '' AND NOT contains(coalesce(type, ''), chr(8203))"),
    "REC-TITLE": ("info", "SELECT path FROM ok WHERE coalesce(title, '') = ''"),
    "REC-DESC": ("info", "SELECT path FROM ok WHERE coalesce(description, '') = ''"),
    "FMT-TAGS": (
        "warn",
        "SELECT path FROM ok WHERE json_type(fm, '$.tags') NOT IN ('ARRAY', 'NULL') AND coalesce(fm ->> '$.tags', '') NOT IN ('', 'false', '0')",
    ),
    "FMT-TS": (
        "warn",
        r"""SELECT path FROM ok WHERE json_type(fm, '$.timestamp') NOT IN ('NULL') AND coalesce(fm ->> '$.timestamp', '') NOT IN ('', 'false', '0')
            AND NOT (json_type(fm, '$.timestamp') = 'VARCHAR' AND regexp_matches(fm ->> '$.timestamp',
            '^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])([T ]([01]\d|2[0-4]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$')
            AND NOT starts_with(fm ->> '$.timestamp', '0000'))""",
    ),
    "LINK-REL": (
        "info",
        r"""SELECT path FROM ok WHERE len(list_filter(regexp_extract_all(body, '\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)', 1),
            lambda h: regexp_matches(h, '^\.{1,2}/') AND contains(h, '.md'))) > 0""",
    ),
    "BODY-STRUCT": ("info", r"SELECT path FROM ok WHERE NOT regexp_matches(body, '(?m)^#{1,6}[\s\x{a0}]')"),
    "ORPHAN": ("info", "SELECT path FROM orph WHERE path IN (SELECT path FROM ok)"),
    "LINK-STUB": ("info", f"SELECT path FROM ({_STUB}) WHERE path IN (SELECT path FROM ok)"),
    "SCHEMA-STATUS": (
        "err",
        "SELECT path FROM ok JOIN doc_types d ON d.name = ok.type WHERE coalesce(status, '') <> '' AND len(allowed_statuses) > 0 AND NOT list_contains(allowed_statuses, status)",
    ),
}
_REQ = """
    SELECT path, field FROM (SELECT path, fm, unnest(required_fields) AS field FROM ok JOIN doc_types d ON d.name = ok.type)
    WHERE NOT coalesce(list_contains(json_keys(fm), field), false)
       OR (json_type(fm, '$."' || field || '"') = 'NULL' AND field IN ('type', 'title', 'description', 'resource', 'status'))"""
_ALL = " UNION ALL ".join(f"SELECT path, '{level}' AS level, '{code}' AS code FROM ({sql})" for code, (level, sql) in _RULES.items())
_ALL += f" UNION ALL SELECT path, 'err', 'SCHEMA-REQFIELD' FROM ({_REQ})"


def _rule(code: str, level: str, sql: str) -> None:
    name = "check_" + code.lower().replace("-", "_")

    def run(spark, d):
        t = Tables(spark, d)
        p = t.parsed if code not in ("ORPHAN", "LINK-STUB") and not code.startswith("SCHEMA") else t.ruled
        if code in ("ORPHAN", "LINK-STUB"):
            every = C.graph_checks(p, t.links)
        else:
            every = S.schema_checks(p, t.types) if code.startswith("SCHEMA") else C.local_checks(p)
        return every.filter((F.col("code") == code) & (F.col("level") == level)).select("path", "level")

    QUERIES[name], SQL[name] = run, _WITH + f"SELECT path, '{level}' AS level FROM ({sql})"


for _code, (_level, _sql) in _RULES.items():
    _rule(_code, _level, _sql)


@query(_WITH + _REQ)
def check_schema_reqfield(t):
    c = S.schema_checks(t.ruled, t.types).filter("code = 'SCHEMA-REQFIELD'")
    return c.select("path", F.regexp_extract("msg", "[^ ]*$", 0).alias("field"))


@query(_WITH + f"SELECT code, level, count(*) AS n FROM ({_ALL}) GROUP BY ALL")
def check_counts(t):
    return t.checks.filter("level <> 'pass'").groupBy("code", "level").agg(F.count("*").alias("n"))


@query(_WITH + f"SELECT count(DISTINCT path) FILTER (level = 'err') AS hard_fail, count(*) FILTER (level = 'warn') AS warn_count FROM ({_ALL})")
def hard_fail(t):
    return C.hard_fail(t.checks)


@query(_WITH + f"SELECT count(*) FILTER (level = 'err') AS errors, count(*) FILTER (level = 'warn') AS warnings, count(*) FILTER (level = 'info') AS infos FROM ({_ALL})")
def check_summary(t):
    return C.summary(t.checks)


@query(
    _WITH + f"""SELECT path, CASE max(CASE level WHEN 'err' THEN 3 WHEN 'warn' THEN 2 ELSE 1 END) WHEN 3 THEN 'err' WHEN 2 THEN 'warn' ELSE 'info' END AS level
            FROM ({_ALL}) GROUP BY path"""
)
def worst_severity(t):
    return C.worst(t.checks.filter("level <> 'pass'"))


@query()
def check_page(t):
    return C.page(t.checks, "warn", 0, 100)


@query(
    _WITH + f"""SELECT (SELECT count(*) FROM f WHERE kind = 'concept') AS concepts, (SELECT count(*) FROM l) AS links,
            (SELECT count(*) FROM orph) AS orphans, (SELECT count(*) FROM ({_DANGLING})) AS dangling"""
)
def workspace_status(t):
    counted = {
        "concepts": t.concepts.select("path").distinct(),
        "links": t.links.filter("dst IS NOT NULL").select("src", "dst").distinct(),
        "orphans": L.orphans(t.links, t.files),
        "dangling": L.dangling(t.links, t.files),
    }
    rows = [df.agg(F.count("*").alias("n")).withColumn("what", F.lit(name)) for name, df in counted.items()]
    return reduce(DataFrame.unionByName, rows).agg(*(F.sum(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in counted))


# --- the search language -------------------------------------------------------------------------------------------

_INVALID = f"SELECT path FROM ({_ALL}) WHERE level = 'err'"
_LOOSE = """(contains(lower(regexp_extract(path, '[^/]*$')), '{0}') OR contains(lower(coalesce(body, '')), '{0}') OR (kind = 'concept' AND err IS NULL AND
    len(list_filter(json_keys(fm), lambda k: coalesce(contains(lower((fm -> ('$."' || k || '"'))::VARCHAR), '{0}'), false))) > 0))"""
DSL = {
    "dsl_empty": ("", "true"),
    "dsl_field_substr": ("type:component", "kind = 'concept' AND contains(lower(type), 'component')"),
    "dsl_field_exact": ("status=borrador", "kind = 'concept' AND lower(status) = 'borrador'"),
    "dsl_negated": ("-status=borrador type:ficha", "kind = 'concept' AND coalesce(lower(status) <> 'borrador', true) AND contains(lower(type), 'ficha')"),
    "dsl_flipped": ('type:"!hoja de ruta"', "kind = 'concept' AND coalesce(NOT contains(lower(type), 'hoja de ruta'), true)"),
    "dsl_has": ("has:resource", "kind = 'concept' AND err IS NULL AND coalesce(resource, json_type(fm, '$.resource'), '') <> ''"),
    "dsl_no": ("no:title", "kind = 'concept' AND NOT coalesce(err IS NULL AND coalesce(title, json_type(fm, '$.title'), '') <> '', false)"),
    "dsl_tag": ("tags:cache", "kind = 'concept' AND len(list_filter(CASE json_type(fm, '$.tags') WHEN 'ARRAY' THEN (fm ->> '$.tags[*]')::VARCHAR[] ELSE [fm ->> '$.tags'] END, lambda x: contains(lower(x), 'cache'))) > 0"),
    "dsl_is_orphan": ("is:orphan", "kind = 'concept' AND path IN (SELECT path FROM orph)"),
    "dsl_is_linked": ("is:linked", "kind = 'concept' AND path IN (SELECT dst FROM nl)"),
    "dsl_is_invalid": ("is:invalid", f"kind = 'concept' AND path IN ({_INVALID})"),
    "dsl_is_reserved": ("is:reserved", "kind <> 'concept'"),
    "dsl_is_unknown": ("-is:nothing", "kind = 'concept'"),
    "dsl_body": ("body:migración", "contains(lower(body), 'migración')"),
    "dsl_loose": ("cursor", _LOOSE.format("cursor")),
    "dsl_reserved_gate": ("-type:componente", "kind = 'concept' AND coalesce(NOT contains(lower(type), 'componente'), true)"),
    "dsl_and": ("type:guía -is:orphan cursor", "kind = 'concept' AND contains(lower(type), 'guía') AND path NOT IN (SELECT path FROM orph) AND " + _LOOSE.format("cursor")),
}


def _dsl(name: str, text: str, where: str) -> None:
    def run(spark, d):
        t = Tables(spark, d)
        need = search.flags(text)
        p = t.parsed
        own = {}
        if "orphan" in need:
            own["orphan"] = L.orphans(t.links, t.files)
        if "linked" in need:
            own["linked"] = L.inbound(t.links, t.files)
        if "invalid" in need:
            own["invalid"] = t.checks.filter("level = 'err'")
        return search.select(p, text, **own).select("path").distinct()

    QUERIES[name], SQL[name] = run, _WITH + f"SELECT path FROM e WHERE {where}"


for _name, (_text, _where) in DSL.items():
    _dsl(_name, _text, _where)

_SCORE = """greatest(1, (length(lower(raw)) - length(replace(lower(raw), '{0}', ''))) / length('{0}'))::DOUBLE"""


def _hits(t, text):
    return search.ranked(search.select(t.parsed.filter("kind = 'concept'"), text), text)


@query(_WITH + f"SELECT path, {_SCORE.format('cursor')} AS score FROM e WHERE kind = 'concept' AND {_LOOSE.format('cursor')}")
def search_score(t):
    return _hits(t, "cursor").select("path", "score").distinct()


_PAGE = _WITH + f"SELECT path, {_SCORE.format('cursor')} AS score FROM e WHERE kind = 'concept' AND {_LOOSE.format('cursor')} ORDER BY score DESC, path LIMIT 20 OFFSET "


@query(_PAGE + "0")
def search_topk(t):
    return search.page(_hits(t, "cursor").select("path", "score").distinct())[0].select("path", "score")


@query(_PAGE + "20")
def search_page2(t):
    return search.page(_hits(t, "cursor").select("path", "score").distinct(), 20, search.cursor_of(20))[0].select("path", "score")


@query()
def search_snippets(t):
    return _hits(t, "cursor").select("path", "title", "snippet").distinct()


@query(_WITH + "SELECT path FROM f WHERE kind = 'concept' AND lower(type) IN ('componente', 'minuta') AND lower(status) = 'estable' AND starts_with(path, 'b')")
def search_filters(t):
    return search.narrowed(t.parsed, ["Componente", "MINUTA"], ["estable"], prefix="b").select("path").distinct()


@query(
    _WITH
    + r"""SELECT term, count(DISTINCT path) AS notes, count(*) AS n FROM (SELECT path, unnest(regexp_extract_all(lower(raw), '[\p{L}\p{N}]+')) AS term FROM f)
          GROUP BY term HAVING count(DISTINCT path) >= 20"""
)
def term_index(t):
    return search.inverted_index(t.rows).groupBy("term").agg(F.count("*").alias("notes"), F.sum("n").alias("n")).filter("notes >= 20")


@query(
    _WITH
    + r"""SELECT term, count(DISTINCT path) AS notes, count(*) AS n FROM (SELECT path, unnest(regexp_extract_all(lower(raw), '[\p{L}\p{N}]+')) AS term FROM f)
          GROUP BY term"""
)
def term_index_all(t):
    return search.inverted_index(t.rows).groupBy("term").agg(F.count("*").alias("notes"), F.sum("n").alias("n"))


# --- the graph -----------------------------------------------------------------------------------------------------


@query(_WITH + "SELECT src, dst, dangling FROM ed")
def graph_edges(t):
    return t.edges


@query(
    _WITH + """SELECT path AS id, false AS ghost, type, status FROM f WHERE kind = 'concept'
            UNION ALL SELECT DISTINCT dst, true, NULL, NULL FROM ed WHERE dangling"""
)
def graph_nodes(t):
    return graph.graph_nodes(t.edges, t.concepts)


def _reach_sql(step: str, depth: int) -> str:
    return _REC + f"""r AS (SELECT '{GLOSSARY}' AS node, 0 AS distance UNION SELECT s.there, r.distance + 1 FROM r JOIN ({step}) s ON s.here = r.node
            WHERE r.distance < {depth}) SELECT node, min(distance) AS distance FROM r GROUP BY node"""


_OUTS, _INS = "SELECT src AS here, dst AS there FROM ed", "SELECT dst AS here, src AS there FROM ed"


@query(_reach_sql(_OUTS, 3))
def neighborhood_out(t):
    return graph.neighborhood(t.edges, GLOSSARY, 3, "out")[0]


@query(_reach_sql(_INS, 2))
def neighborhood_in(t):
    return graph.neighborhood(t.edges, GLOSSARY, 2, "in")[0]


@query(_reach_sql(f"{_OUTS} UNION ALL {_INS}", 2))
def neighborhood_both(t):
    return graph.neighborhood(t.edges, GLOSSARY, 2, "both")[0]


@query(
    _REC + f"""r AS (SELECT '{GLOSSARY}' AS node, 0 AS distance UNION SELECT s.there, r.distance + 1 FROM r JOIN ({_INS}) s ON s.here = r.node
            WHERE r.distance < 2) SELECT DISTINCT src, dst FROM ed WHERE dst IN (SELECT node FROM r WHERE distance < 2)"""
)
def neighborhood_edges(t):
    return graph.neighborhood(t.edges, GLOSSARY, 2, "in")[1]


@query(
    _REC + f"""r AS (SELECT '{GLOSSARY}' AS node UNION SELECT nl.src FROM r JOIN nl ON nl.dst = r.node)
            SELECT node FROM r WHERE node <> '{GLOSSARY}'"""
)
def blast_radius(t):
    roots = t.spark.createDataFrame([(GLOSSARY,)], "node string")
    edges = L.note_links(t.links, t.files)
    return graph.reach(edges, roots, "in").filter(F.col("distance") > 0).select("node")


@query(
    _REC + """e2 AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed),
            r AS (SELECT path AS node, path AS other FROM f WHERE kind = 'concept' UNION SELECT DISTINCT dst, dst FROM ed
                  UNION SELECT r.node, e2.b FROM r JOIN e2 ON e2.a = r.other)
            SELECT node, min(other) AS component FROM r GROUP BY node"""
)
def components(t):
    return graph.components(t.edges, t.concepts.select(F.col("path").alias("node")))


@query(
    _REC + """r AS (SELECT src AS a, dst AS b FROM ed UNION SELECT r.a, ed.dst FROM r JOIN ed ON ed.src = r.b)
            SELECT x.a AS node, min(x.b) AS cycle FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a"""
)
def cycles(t):
    return graph.cycles(t.edges)


_ENDS = f"(SELECT min(src) FROM ed WHERE dst <> '{GLOSSARY}')"


@query(
    _REC + f"""r AS (SELECT {_ENDS} AS node, [{_ENDS}] AS way, 0 AS d UNION ALL
              SELECT ed.dst, list_append(r.way, ed.dst), d + 1 FROM r JOIN ed ON ed.src = r.node WHERE d < 4 AND NOT list_contains(r.way, ed.dst)),
            best AS (SELECT way FROM r WHERE node = '{GLOSSARY}' ORDER BY d, way LIMIT 1)
            SELECT generate_subscripts(way, 1)::INT - 1 AS pos, unnest(way) AS node FROM best"""
)
def shortest_path(t):
    e = t.edges
    first = e.filter(F.col("dst") != GLOSSARY).agg(F.min("src")).first()[0]
    return graph.shortest_path(e, first or "", GLOSSARY)


@query(
    _WITH + """SELECT dst AS path, count(*) AS direct, CASE WHEN count(*) >= 20 THEN 'high' WHEN count(*) >= 5 THEN 'medium' ELSE 'low' END AS risk
            FROM nl GROUP BY dst"""
)
def impact_direct(t):
    n = F.col("n")
    return L.inbound(t.links, t.files).select("path", n.alias("direct"), F.when(n >= 20, "high").when(n >= 5, "medium").otherwise("low").alias("risk"))


# --- derived pages, revisions, changes -----------------------------------------------------------------------------


@query(
    _WITH + r"""SELECT regexp_extract(path, '^(.*/)?') AS dir, coalesce(nullif(type, ''), 'Concept') AS type, count(*) AS n
            FROM f WHERE kind = 'concept' GROUP BY ALL"""
)
def index_groups(t):
    return G.index_groups(t.parsed)


_ENTRY = r"""'* [' || coalesce(nullif(title, ''), regexp_replace(regexp_extract(path, '[^/]*$'), '\.md$', '')) || '](' || {0} || ')'
    || CASE WHEN coalesce(description, '') <> '' THEN ' - ' || description ELSE '' END"""


@query(
    _WITH
    + rf"""SELECT d || 'index.md' AS path, regexp_replace(CASE d WHEN '' THEN E'---\nokf_version: "0.1"\n---\n\n# Bundle\n\n' ELSE '# ' || rtrim(d, '/') || E'\n\n' END
           || string_agg(x, '' ORDER BY pos, k), '\n+$', '') || E'\n' AS content FROM (
           SELECT d, 0 AS pos, k, '# ' || k || E'\n\n' || string_agg(line, E'\n' ORDER BY path) || E'\n\n' AS x FROM (
             SELECT regexp_extract(path, '^(.*/)?') AS d, coalesce(nullif(type, ''), 'Concept') AS k, path,
                    {_ENTRY.format("regexp_extract(path, '[^/]*$')")} AS line FROM f WHERE kind = 'concept') GROUP BY d, k
           UNION ALL
           SELECT d, 1, '', E'# Subdirectorios\n\n' || string_agg('* [' || s || '](' || s || E')\n', '' ORDER BY s) || E'\n' FROM (
             SELECT DISTINCT array_to_string(p[1:i-1], '/') || CASE WHEN i > 1 THEN '/' ELSE '' END AS d, p[i] || '/' AS s
             FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(path, '/') AS p FROM f))) GROUP BY d) GROUP BY d"""
)
def index_pages(t):
    return G.index_pages(t.parsed)


@query("SELECT tag, count(DISTINCT path) AS n FROM tags WHERE tag IS NOT NULL AND path IS NOT NULL GROUP BY tag")
def tag_counts(t):
    return G.tag_counts(table(t.spark, t.d, "tags"))


@query()
def tag_slugs(t):
    return G.tag_slugs(table(t.spark, t.d, "tags"))


@query()
def tag_pages(t):
    return G.tag_pages(t.parsed)


@query()
def page_drift(t):
    return G.drift(t.files, G.index_pages(t.parsed))


@query(_WITH + "SELECT path, 'sha256:' || sha256(raw) AS revision FROM f")
def concept_revisions(t):
    return t.files.select("path", R.concept_revision(F.col("raw")).alias("revision")).distinct()


_PART = "sum(('0x' || substr(r, {0}, 15))::BIGINT)::HUGEINT::VARCHAR"


@query(
    _WITH + f"""SELECT n AS files, 'sha256:' || sha256(n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) AS revision FROM (
            SELECT count(*) AS n, {', '.join(f'{_PART.format(1 + 15 * i)} AS s{i}' for i in range(4))}
            FROM (SELECT sha256(path || chr(0) || sha256(raw)) AS r FROM f))"""
)
def workspace_revision(t):
    return R.workspace_revision(t.files)


_LAST = """(SELECT path, hash FROM file_snapshots WHERE snap_no = {0} AND path IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY path ORDER BY loaded_at DESC, hash DESC NULLS LAST) = 1)"""


@query(
    f"""SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'delete' ELSE 'upsert' END AS op
        FROM {_LAST.format(4)} a FULL JOIN {_LAST.format(5)} b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.hash IS DISTINCT FROM b.hash"""
)
def hash_gate(t):
    s = table(t.spark, t.d, "file_snapshots")
    one = lambda n: R.final_state(s.filter(F.col("snap_no") == n), "path", ["loaded_at"], "hash")
    return R.gate(one(4), one(5))


_EVENT = "SELECT user_id, event_type, value FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query(f"SELECT user_id, event_type, value FROM ({_EVENT}) WHERE event_type <> 'error'")
def event_final_state(t):
    last = R.final_state(table(t.spark, t.d, "events"), "user_id", ["ts", "event_id"], "event_type", "value")
    return last.filter("event_type <> 'error'")


@query(f"SELECT user_id FROM ({_EVENT}) WHERE event_type = 'error'")
def event_removed(t):
    return R.final_state(table(t.spark, t.d, "events"), "user_id", ["ts", "event_id"], "event_type").filter("event_type = 'error'").select("user_id")


@query(
    _WITH + """SELECT DISTINCT path, trim(tag, E' \\t\\r\\n' || chr(160)) AS tag FROM (SELECT path, unnest(CASE json_type(fm, '$.tags') WHEN 'ARRAY' THEN (fm ->> '$.tags[*]')::VARCHAR[]
            WHEN 'NULL' THEN [] ELSE [fm ->> '$.tags'] END) AS tag FROM ok WHERE json_type(fm, '$.tags') IS NOT NULL) WHERE trim(tag, E' \\t\\r\\n' || chr(160)) <> ''"""
)
def note_tags(t):
    return G.note_tags(t.parsed)


@query(
    _WITH
.rstrip()
    + r""", ls AS (SELECT path, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS no, len(body) AS size FROM (SELECT path, body, string_split(body, E'\n') AS x FROM f)),
          hl AS (SELECT path, no, size, rtrim(line, E'\r') AS line, coalesce(sum(len(line) + 1) OVER w, 0) AS start, len(line) + 1 AS own, starts_with(ltrim(rtrim(line, E'\r'), E' \t\f' || chr(11)), '```') AS fence,
                   coalesce(sum(starts_with(ltrim(rtrim(line, E'\r'), E' \t\f' || chr(11)), '```')::INT) OVER w, 0) AS fences
                 FROM ls WINDOW w AS (PARTITION BY path ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
          hs AS (SELECT *, len(regexp_extract(line, '^#+')) AS level FROM hl WHERE NOT fence AND fences % 2 = 0 AND regexp_matches(line, '^#{1,6}[ \t]'))
          SELECT path, level::INT AS level, trim(line[level + 1:], E' \t\f' || chr(11) || chr(160)) AS title, no::INT AS line, start::INT AS start, least(start + own, size)::INT AS content,
                 coalesce((SELECT min(y.start) FROM hs y WHERE y.path = x.path AND y.no > x.no AND y.level <= x.level), size)::INT AS end FROM hs x"""
)
def headings(t):
    own = t.files.select("path", F.explode(parse_headings(F.col("body"))).alias("h"))
    return own.select("path", "h.*").distinct()


@query()
def sarif_results(t):
    return sinks.sarif(t.checks)


@query("SELECT 'index.md' AS src, 'c0000.md' AS dst UNION ALL SELECT format('c{:04d}.md', i), format('c{:04d}.md', (i + 1) % 1000) FROM range(1000) r(i)")
def synthetic_links(t):
    return L.out_links(parse_files(corpus.synthetic(t.spark, 1000))).select("src", "dst")


@query(
    f"""WITH {_F}, {_OUT} SELECT src AS path, 'write' AS op FROM ol JOIN f ON path = src AND kind = 'concept' WHERE dst = '{GLOSSARY}'
        UNION ALL SELECT '{GLOSSARY}', 'delete' UNION ALL SELECT 'comun/moved.md', 'write'"""
)
def plan_move(t):
    planner = plan.Planner(t.files)
    return planner.mutation([{"op": "move", "from": GLOSSARY, "to": "comun/moved.md", "rewriteInboundLinks": True}]).select("path", "op")


def _snapshot(t, n: int) -> DataFrame:
    rows = table(t.spark, t.d, "file_snapshots").filter(F.col("snap_no") == n)
    last = R.final_state(rows, "path", ["loaded_at", "hash"], "frontmatter_json")
    return last.select("path", F.get_json_object("frontmatter_json", "$.status").alias("status"))


_STATUS = """(SELECT path, coalesce(frontmatter_json ->> '$.status', '') AS status FROM file_snapshots WHERE snap_no = {0} AND path IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY path ORDER BY loaded_at DESC, hash DESC NULLS LAST) = 1)"""


@query(f"SELECT path, a.status AS before, b.status AS after FROM {_STATUS.format(4)} a JOIN {_STATUS.format(5)} b USING (path) WHERE a.status <> b.status")
def status_changes(t):
    return history.status_changes(_snapshot(t, 4), _snapshot(t, 5))


@query(
    """SELECT s.snap_no AS version, count(DISTINCT path) FILTER (bad) AS hard_fail, 0::BIGINT AS warn_count, count(DISTINCT path) FILTER (bad) = 0 AS conform
       FROM snapshots s LEFT JOIN (SELECT snap_no, path, NOT regexp_matches(path, '(^|/)(index|log)\\.md$') AND coalesce(frontmatter_json ->> '$.type', '') = '' AS bad
         FROM file_snapshots WHERE path IS NOT NULL) f ON f.snap_no = s.snap_no GROUP BY s.snap_no"""
)
def snapshot_conformance(t):
    rows = table(t.spark, t.d, "file_snapshots").filter("path IS NOT NULL").withColumnRenamed("snap_no", "version")
    untyped = F.coalesce(F.get_json_object("frontmatter_json", "$.type"), F.lit("")) == ""
    bad = rows.filter(~P.is_reserved("path") & untyped).select("version", "path", F.lit("err").alias("level"))
    return history.conformance(bad, table(t.spark, t.d, "snapshots").select(F.col("snap_no").alias("version")))


@query(
    """SELECT format('user/u{}.md', user_id) AS path, event_type AS raw FROM (SELECT user_id, event_type FROM events WHERE user_id IS NOT NULL
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'"""
)
def event_stream_state(t):
    """The change feed over the events as a stream: every event writes its user's page, an error removes it."""
    feed = Feed(t.spark, f"{shared_dir(t.spark)}/cartulary-feed-{uuid.uuid4().hex}")
    events = table(t.spark, t.d, "events")
    op = F.when(F.col("event_type") == "error", "remove").otherwise("upsert")
    path = F.format_string("user/u%d.md", "user_id")
    log = t.spark.readStream.schema(events.schema).parquet(f"{t.d}/events.parquet*").filter("user_id IS NOT NULL")
    changes = log.select(F.col("event_id").alias("seq"), path.alias("path"), op.alias("op"), F.col("event_type").alias("raw"))
    feed.follow(changes, once=True).awaitTermination()
    return feed.state().select("path", "raw")
