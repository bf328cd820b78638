"""Rules on notes as one projection of native expressions, and those that need the link graph as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartulary.functions import paths as P
from cartulary.functions import text as T
from cartulary.operators import links as L

#: Order of severities.
RANK = {"pass": 0, "info": 1, "warn": 2, "err": 3}
_SCHEMA = ("path", "level", "code", "msg", "targets")


def rank(level: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv)), level)


def _check(when: Column, level: str, code: str, msg: str | Column, own: bool = True) -> Column:
    targets = F.array(F.col("path")) if own else F.array().cast("array<string>")
    row = F.struct(
        F.lit(level).alias("level"), F.lit(code).alias("code"), (F.lit(msg) if isinstance(msg, str) else msg).alias("msg"), targets.alias("targets")
    )
    return F.when(when, row)


def _pair(key: str) -> Column:
    return F.get(F.filter("pairs", lambda p: p["key"] == key), F.lit(0))


def _truthy(pair: Column) -> Column:
    tag, scalar = pair["tag"], pair["scalar"]
    zero = F.coalesce(scalar.try_cast("double") == 0, F.lit(False))
    return F.coalesce(
        F.when(tag == "null", False)
        .when(tag == "bool", scalar == "true")
        .when(tag == "str", scalar != "")
        .when(tag == "list", F.size(pair["items"]) > 0)
        .when(tag == "num", ~zero)
        .otherwise(pair.isNotNull()),
        F.lit(False),
    )


def with_rules(parsed: DataFrame) -> DataFrame:
    """``parsed`` with the rules that each note meets or breaks by itself as a list ``rules``.

    Index and log pages only meet the conflict rule and their own; broken front matter ends the rules for a note.
    """
    concept, index, log = (F.col("kind") == k for k in ("concept", "index", "log"))
    fine = concept & F.col("fm_error").isNull()
    front = F.regexp_replace(T.front_text(F.col("raw")), r"(?U)^\s+|\s+$", "")
    versioned = (P.dir_of("path") == "") & front.rlike(T.VERSION_LINE) & ~front.contains("\n")
    headings = F.regexp_extract_all(F.col("raw"), F.lit(T.LOG_HEADING), F.lit(0))
    tags, stamp = _pair("tags"), _pair("timestamp")
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    typed = F.regexp_replace(F.coalesce(F.col("type"), F.lit("")), r"(?U)\s+", "") != ""
    rules = [
        _check(F.col("raw").rlike(T.CONFLICT), "err", "OKF-CONFLICT", "A merge conflict is left in the text."),
        _check(index & (F.coalesce(front, F.lit("")) != "") & ~F.coalesce(versioned, F.lit(False)), "warn", "OKF-IDX", "An index page should have no front matter."),
        _check(log & F.exists(headings, lambda h: ~h.rlike(T.LOG_DATE)), "warn", "OKF-LOG", "Dates of the log should be written YYYY-MM-DD.", own=False),
        _check(concept & (F.col("fm_error") == "missing"), "err", "OKF-FM01", "Front matter is missing."),
        _check(concept & (F.col("fm_error") == "unclosed"), "err", "OKF-FM02", "Front matter is not closed."),
        _check(concept & (F.col("fm_error") == "malformed"), "err", "OKF-FM03", F.concat(F.lit("Front matter is malformed: "), F.coalesce("fm_message", F.lit("")))),
        _check(fine & ~typed, "err", "OKF-TYPE", "The type is missing."),
        _check(fine & typed, "pass", "OKF-TYPE", F.concat(F.lit("Type: "), F.coalesce("type", F.lit("")))),
        _check(fine & empty("title"), "info", "REC-TITLE", "A title is recommended."),
        _check(fine & empty("description"), "info", "REC-DESC", "A description is recommended."),
        _check(fine & _truthy(tags) & (tags["tag"] != "list"), "warn", "FMT-TAGS", "Tags should be a list."),
        _check(fine & _truthy(stamp) & ~((stamp["tag"] == "str") & T.is_iso(stamp["scalar"])), "warn", "FMT-TS", "The timestamp is no ISO date."),
        _check(fine & (F.size(T.relative_hrefs(F.col("body"))) > 0), "info", "LINK-REL", "Links are relative."),
        _check(fine & ~F.col("body").rlike(T.HEADING), "info", "BODY-STRUCT", "The body has no heading."),
    ]
    return parsed.withColumn("rules", F.array_compact(F.array(*rules)))


def local_checks(parsed: DataFrame) -> DataFrame:
    """Rules of single notes: (path, level, code, msg, targets), one row each; ``parsed`` may already have its ``rules``."""
    own = parsed if "rules" in parsed.columns else with_rules(parsed)
    return own.select("path", F.explode("rules").alias("c")).select("path", "c.*").distinct()


def graph_checks(parsed: DataFrame, links: DataFrame) -> DataFrame:
    """ORPHAN and LINK-STUB for notes with sound front matter."""
    fine = parsed.filter("kind = 'concept' AND fm_error IS NULL").select("path").distinct()
    alone = L.orphans(links, parsed).join(fine, "path", "left_semi").select(
        "path", F.lit("info").alias("level"), F.lit("ORPHAN").alias("code"), F.lit("Nothing refers to this note.").alias("msg"), F.array("path").alias("targets")
    )
    stubs = L.missing_targets(links, parsed).join(fine, "path", "left_semi")
    titles = F.array_join(F.transform("targets", P.title_from_path), ", ")
    stub = stubs.select("path", F.lit("info").alias("level"), F.lit("LINK-STUB").alias("code"), F.concat(F.lit("Notes to be written: "), titles).alias("msg"), "targets")
    return alone.unionByName(stub)


def analyze(parsed: DataFrame, links: DataFrame) -> DataFrame:
    return local_checks(parsed).unionByName(graph_checks(parsed, links))


def diagnostic_ids(checks: DataFrame) -> DataFrame:
    """With an ``id`` that is equal for equal path, code and message."""
    return checks.withColumn("id", F.sha2(F.concat_ws("\x00", "path", "code", "msg"), 256))


def hard_fail(checks: DataFrame) -> DataFrame:
    """Number of files with an error, and of warnings, in one pass: (hard_fail, warn_count)."""
    per = checks.groupBy("path").agg(F.max((F.col("level") == "err").cast("int")).alias("e"), F.count_if(F.col("level") == "warn").alias("w"))
    return per.agg(F.coalesce(F.sum("e"), F.lit(0)).cast("bigint").alias("hard_fail"), F.coalesce(F.sum("w"), F.lit(0)).cast("bigint").alias("warn_count"))


def summary(checks: DataFrame) -> DataFrame:
    """(errors, warnings, infos)."""
    return checks.agg(*(F.count_if(F.col("level") == k).alias(n) for k, n in (("err", "errors"), ("warn", "warnings"), ("info", "infos"))))


def summaries(parsed: DataFrame, orphans: DataFrame, checks: DataFrame) -> DataFrame:
    """One row a note: (path, title, type, status, description, orphan, invalid), the title made from the name if there
    is none."""
    own = parsed.filter("kind = 'concept'").dropDuplicates(["path"])
    flag = lambda df, n: df.select("path").distinct().withColumn(n, F.lit(True))
    own = own.join(flag(orphans, "orphan"), "path", "left").join(flag(checks.filter("level = 'err'"), "invalid"), "path", "left")
    title = F.coalesce(F.nullif("title", F.lit("")), P.title_from_path("path"))
    no = lambda n: F.coalesce(n, F.lit(False)).alias(n)
    return own.select("path", title.alias("title"), "type", "status", "description", no("orphan"), no("invalid"))


def worst(checks: DataFrame) -> DataFrame:
    """Worst severity of each path: (path, level)."""
    by_rank = F.create_map(*(F.lit(x) for k, v in RANK.items() for x in (v, k)))
    return checks.groupBy("path").agg(F.max(rank(F.col("level"))).alias("r")).select("path", F.element_at(by_rank, F.col("r")).alias("level"))


def page(checks: DataFrame, floor: str = "info", offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of diagnostics at or above a severity, by path, code and id; at most 1,000 rows."""
    ordered = diagnostic_ids(checks).filter(rank(F.col("level")) >= RANK[floor]).orderBy("path", "code", "id")
    return ordered.offset(offset).limit(min(limit, 1000))
