"""Index and tag pages as ordered aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartulary.functions import paths as P
from cartulary.functions import text as T
from cartulary.session import materialize

# Texts of generated pages.
ROOT_HEAD = '---\nokf_version: "0.1"\n---\n\n# Bundle\n\n'
SUBFOLDERS = "# Subdirectorios\n\n"
TAGS_HEAD = "# Tags\n\n"
UNTYPED = "Concept"


def _entry(target):
    title = F.coalesce(F.nullif("title", F.lit("")), P.concept_id(P.basename("path")))
    tail = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" - "), "description")).otherwise("")
    return F.concat(F.lit("* ["), title, F.lit("]("), target, F.lit(")"), tail)


def index_groups(parsed: DataFrame) -> DataFrame:
    """Notes per folder and type: (dir, type, n); notes without a type are of type ``Concept``."""
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit(UNTYPED))
    return parsed.filter("kind = 'concept'").groupBy(P.dir_of("path").alias("dir"), kind.alias("type")).agg(F.count_distinct("path").alias("n"))


def subfolders(parsed: DataFrame) -> DataFrame:
    """Every folder with the names of the folders in it: (dir, name)."""
    parts = F.split("path", "/")
    steps = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.struct(F.concat(F.array_join(F.slice(parts, F.lit(1), i - 1), "/"), F.when(i > 1, "/").otherwise("")).alias("dir"), F.concat(F.get(parts, i - 1), F.lit("/")).alias("name")),
    )
    return parsed.filter(F.size(parts) > 1).select(F.explode(steps).alias("s")).select("s.*").distinct()


def index_pages(parsed: DataFrame) -> DataFrame:
    """The index page of every folder: (path, content). Notes by type and path, then subfolders.

    Lines are put in order within each page by ``listagg``; a page is as large as its folder.
    """
    kind = F.coalesce(F.nullif("type", F.lit("")), F.lit(UNTYPED))
    notes = parsed.filter("kind = 'concept'").dropDuplicates(["path"]).select(P.dir_of("path").alias("dir"), kind.alias("kind"), "path", _entry(P.basename("path")).alias("line"))
    by_type = notes.groupBy("dir", "kind").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY path)").alias("lines"))
    part = by_type.select("dir", F.lit(0).alias("at"), F.col("kind").alias("name"), F.concat(F.lit("# "), "kind", F.lit("\n\n"), "lines", F.lit("\n\n")).alias("text"))
    subs = subfolders(parsed).groupBy("dir").agg(F.expr("listagg(concat('* [', name, '](', name, ')\n'), '') WITHIN GROUP (ORDER BY name)").alias("lines"))
    part = part.unionByName(subs.select("dir", F.lit(1).alias("at"), F.lit("").alias("name"), F.concat(F.lit(SUBFOLDERS), "lines", F.lit("\n")).alias("text")))
    pages = part.groupBy("dir").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "name", "text"))), lambda x: x["text"]), "").alias("text"))
    head = F.when(F.col("dir") == "", ROOT_HEAD).otherwise(F.concat(F.lit("# "), F.regexp_replace("dir", "/+$", ""), F.lit("\n\n")))
    return pages.select(F.concat("dir", F.lit(P.INDEX)).alias("path"), F.concat(F.regexp_replace(F.concat(head, "text"), r"\n+\z", ""), F.lit("\n")).alias("content"))


def note_tags(parsed: DataFrame, lists_only: bool = False) -> DataFrame:
    """Distinct (path, tag): entries of lists, and single values unless ``lists_only``, trimmed; blank ones are left out."""
    pair = F.get(F.filter("pairs", lambda p: p["key"] == "tags"), F.lit(0))
    items = F.when(pair["tag"] == "list", pair["items"])
    if not lists_only:
        items = items.when(pair["tag"].isin("str", "num", "bool"), F.array(pair["scalar"]))
    tags = parsed.filter("kind = 'concept'").select("path", F.explode(items).alias("tag"))
    return tags.select("path", F.regexp_replace("tag", r"(?U)^\s+|\s+$", "").alias("tag")).filter("tag <> ''").distinct()


def tag_counts(tags: DataFrame) -> DataFrame:
    """Notes per tag: (tag, n)."""
    return tags.filter("tag IS NOT NULL AND path IS NOT NULL").groupBy("tag").agg(F.count_distinct("path").alias("n"))


def tag_slugs(tags: DataFrame) -> DataFrame:
    """A folder name for each tag, unique: (tag, slug). Tags of one slug are numbered from 2 in order of the accent- and
    case-blind form, then lower case first; a number that makes the name of another tag is passed over.

    Few tags collide; only the numbered names are looked up again, round by round.
    """
    every = tags.select("tag").filter("tag IS NOT NULL").distinct().withColumn("base", T.slug(F.col("tag")))
    order = [F.expr("collate(tag, 'UNICODE_CI_AI')"), F.expr("collate(tag, 'UNICODE')"), "tag"]
    numbered = materialize(every.withColumn("i", F.row_number().over(Window.partitionBy("base").orderBy(*order))))
    name = F.when(F.col("i") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "i"))
    while True:
        named = numbered.withColumn("slug", name)
        bases = numbered.filter("i = 1").select(F.col("base").alias("slug"))
        clash = named.filter("i > 1").join(bases, "slug", "left_semi").select("tag")
        twice = named.filter("i > 1").groupBy("slug").agg(F.count("*").alias("n"), F.max("tag").alias("tag")).filter("n > 1").select("tag")
        move = materialize(clash.union(twice).distinct())
        if move.isEmpty():
            return named.select("tag", "slug")
        moved = move.withColumn("moved", F.lit(1))
        own = Window.partitionBy("base").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        numbered = materialize(numbered.join(moved, "tag", "left").withColumn("i", F.col("i") + F.coalesce(F.sum("moved").over(own), F.lit(0))).drop("moved"))


def tag_pages(parsed: DataFrame) -> DataFrame:
    """A page per tag and the page of all tags: (path, content); entries in natural order of their paths."""
    tags = note_tags(parsed)
    slugs = tag_slugs(tags)
    notes = parsed.dropDuplicates(["path"]).select("path", _entry(F.concat(F.lit("/"), "path")).alias("line"), T.natural_key(F.col("path")).alias("key"))
    lines = tags.join(notes, "path").groupBy("tag").agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY key)").alias("lines"), F.count("*").alias("n"))
    lines = materialize(lines.join(slugs, "tag"))
    own = lines.select(F.format_string("tags/%s/index.md", "slug").alias("path"), F.format_string("# %s\n\n%s\n", "tag", "lines").alias("content"))
    row = F.concat(F.lit("* ["), "tag", F.lit("]("), "slug", F.lit("/) - "), "n", F.when(F.col("n") == 1, " concept").otherwise(" concepts"))
    ordered = lines.select(F.expr("collate(tag, 'UNICODE_CI_AI')").alias("k"), "tag", row.alias("row"))
    root = ordered.groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "tag", "row"))), lambda x: x["row"]), "\n").alias("rows"))
    return own.unionByName(root.filter("rows <> ''").select(F.lit("tags/index.md").alias("path"), F.format_string(TAGS_HEAD + "%s\n", "rows").alias("content")))


def stale_pages(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Tag pages that exist and aren't generated any more: (path)."""
    own = files.filter(F.col("path").rlike(r"^tags/([^/]+/)?index\.md$")).select("path").distinct()
    return own.join(pages.select("path"), "path", "left_anti")


def drift(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Generated pages that differ from what is there, and stale ones: (path, what)."""
    there = files.select("path", "raw").dropDuplicates(["path"])
    differ = pages.join(there, "path", "left").filter("NOT (content <=> raw)").select("path", F.when(F.col("raw").isNull(), "absent").otherwise("differs").alias("what"))
    return differ.unionByName(stale_pages(files, pages).withColumn("what", F.lit("stale")))
