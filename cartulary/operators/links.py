"""The directed graph of links between notes, derived from their texts or from a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.functions import paths as P
from cartulary.functions import text as T


def all_hrefs(notes: DataFrame) -> DataFrame:
    """Links of each text as written: (src, pos, href)."""
    return notes.select(F.col("path").alias("src"), F.posexplode(T.hrefs(F.col("body"))).alias("pos", "href"))


def out_links(notes: DataFrame) -> DataFrame:
    """Distinct targets of each note but itself, with the first href: (src, dst, href, src_is_index).

    The first of several links is found by a map-side minimum, so a page of many equal links isn't gathered.
    """
    return (
        all_hrefs(notes)
        .withColumn("dst", P.resolve_link("href", "src"))
        .filter(F.col("dst").isNotNull() & (F.col("dst") != F.col("src")))
        .groupBy("src", "dst")
        .agg(F.min(F.struct("pos", "href")).alias("first"))
        .select("src", "dst", F.col("first.href").alias("href"), (P.basename("src") == P.INDEX).cast("int").alias("src_is_index"))
    )


def core_links(links: DataFrame) -> DataFrame:
    """Targets as paths; what is no valid path is dropped."""
    return links.withColumn("dst", P.rel_path("dst")).filter("dst IS NOT NULL")


def in_index(links: DataFrame) -> DataFrame:
    """Paths that an index page lists."""
    return links.filter((P.basename("src") == P.INDEX) & F.col("dst").isNotNull()).select(F.col("dst").alias("path")).distinct()


def note_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Distinct (src, dst) between existing notes; index and log pages are neither."""
    concepts = notes.filter("kind = 'concept'").select("path").distinct()
    return (
        links.filter("dst IS NOT NULL")
        .select("src", "dst")
        .distinct()
        .join(concepts.withColumnRenamed("path", "src"), "src", "left_semi")
        .join(concepts.withColumnRenamed("path", "dst"), "dst", "left_semi")
    )


def backlinks(links: DataFrame, notes: DataFrame, path: str) -> DataFrame:
    """Notes and pages that refer to one path, with the first href of each: (src, href)."""
    own = links.filter(F.col("dst") == path).groupBy("src").agg(F.min("href").alias("href"))
    return own.join(notes.select(F.col("path").alias("src")).distinct(), "src", "left_semi")


def inbound(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Number of other notes that refer to each note that is referred to: (path, n)."""
    return note_links(links, notes).groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("n"))


def orphans(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes that no other note refers to and no index lists: (path)."""
    concepts = notes.filter("kind = 'concept'").select("path").distinct()
    linked = note_links(links, notes).select(F.col("dst").alias("path"))
    return concepts.join(linked.distinct(), "path", "left_anti").join(in_index(links), "path", "left_anti")


def dangling(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Links of notes to what doesn't exist or is a log page: distinct (src, dst)."""
    every = notes.select(F.col("path").alias("dst"), "kind").dropDuplicates(["dst"])
    concepts = notes.filter("kind = 'concept'").select(F.col("path").alias("src")).distinct()
    return (
        links.filter("dst IS NOT NULL")
        .select("src", "dst")
        .distinct()
        .join(concepts, "src", "left_semi")
        .join(every, "dst", "left")
        .filter("kind IS NULL OR kind = 'log'")
        .select("src", "dst")
    )


def missing_targets(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Targets of each note that don't exist, as a sorted list: (path, targets)."""
    concepts = notes.filter("kind = 'concept'").select(F.col("path").alias("src")).distinct()
    gone = (
        links.filter("dst IS NOT NULL").select("src", "dst").distinct()
        .join(concepts, "src", "left_semi")
        .join(notes.select(F.col("path").alias("dst")).distinct(), "dst", "left_anti")
    )
    return gone.groupBy(F.col("src").alias("path")).agg(F.sort_array(F.collect_set("dst")).alias("targets"))


def note_view(notes: DataFrame, path: str) -> DataFrame:
    """Around one note: (kind, path, href). ``inbound``: notes that link to it with their first href; ``index``: index pages
    that list it; ``out``: files it links to, but itself and index and log pages; ``dangling``: hrefs of it that lead to
    no file."""
    hrefs = all_hrefs(notes).withColumn("dst", P.rel_path(P.resolve_link("href", "src"))).withColumn("page", P.basename("src") == P.INDEX)
    into = hrefs.filter((F.col("dst") == path) & (F.col("src") != path) & (F.col("page") | ~P.is_reserved("src")))
    first = into.groupBy("src", "page").agg(F.min_by("href", "pos").alias("href"))
    inbound_ = first.select(F.when(F.col("page"), "index").otherwise("inbound").alias("kind"), F.col("src").alias("path"), F.when(~F.col("page"), F.col("href")).alias("href"))
    there = notes.select(F.col("path").alias("dst")).distinct().withColumn("known", F.lit(True))
    # a target that is no valid path is dangling too
    own = hrefs.filter((F.col("src") == path) & P.resolve_link("href", "src").isNotNull()).join(there, "dst", "left")
    out = own.filter(F.col("known") & (F.col("dst") != path) & ~P.is_reserved("dst")).select(F.lit("out").alias("kind"), F.col("dst").alias("path"), F.lit(None).cast("string").alias("href"))
    gone = own.filter("known IS NULL").select(F.lit("dangling").alias("kind"), F.lit(None).cast("string").alias("path"), "href")
    return inbound_.unionByName(out.distinct()).unionByName(gone.distinct())
