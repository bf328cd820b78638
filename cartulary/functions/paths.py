"""Paths of notes and targets of links, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of pages that are no notes.
INDEX, LOG = "index.md", "log.md"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def dir_of(path: Column | str) -> Column:
    """The folder with its slash at the end, or an empty string."""
    return F.regexp_extract(_col(path), "^(?s)(.*/)?", 0)


def concept_id(path: Column | str) -> Column:
    return F.regexp_replace(_col(path), r"\.md$", "")


def is_reserved(path: Column | str) -> Column:
    return basename(path).isin(INDEX, LOG)


def file_kind(path: Column | str) -> Column:
    return F.when(basename(path) == INDEX, "index").when(basename(path) == LOG, "log").otherwise("concept")


def title_from_path(path: Column | str) -> Column:
    """The name without its ending, dashes and underscores as blanks, with a capital after every character that is no
    ASCII letter or digit (so an accent begins a word too)."""
    spaced = F.translate(concept_id(basename(path)), "-_", "  ")
    letters = F.regexp_extract_all(spaced, F.lit(r"(?s)[A-Za-z0-9][A-Za-z0-9]*|[^A-Za-z0-9]"), F.lit(0))
    capital = lambda w: F.when(w.rlike("^[A-Za-z0-9]"), F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))).otherwise(w)
    return F.array_join(F.transform(letters, capital), "")


def normalize(path: Column | str) -> Column:
    """Without ``.`` and empty segments; ``..`` takes the segment before it away."""
    drop = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    parts = F.aggregate(
        F.split(_col(path), "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s.isin(".", ""), acc).when(s == "..", drop(acc)).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(parts, "/")


def rel_path(path: Column | str) -> Column:
    """The path with ``.`` and empty segments removed; null for an empty or absolute path, a backslash, a drive or ``..``."""
    p = _col(path)
    bad = (p == "") | p.contains("\\") | p.startswith("/") | p.rlike("^[A-Za-z]:") | F.array_contains(F.split(p, "/"), "..")
    kept = F.array_join(F.filter(F.split(p, "/"), lambda s: ~s.isin(".", "")), "/")
    return F.when(~bad & (kept != ""), kept)


def resolve_link(href: Column | str, source: Column | str) -> Column:
    """The path that a link written in ``source`` points to; null for other schemes, anchors and what isn't a page.

    A leading slash is only taken off; other targets are relative to the source's folder and normalized.
    """
    href = _col(href)
    bare = F.regexp_extract(href, "^[^#?]*", 0)
    page = F.when(bare.endswith("/"), F.concat(bare, F.lit(INDEX))).otherwise(bare)
    ok = ~F.lower(href).rlike("^[a-z]+:") & page.endswith(".md")
    target = F.when(page.startswith("/"), F.substr(page, F.lit(2))).otherwise(normalize(F.concat(dir_of(source), page)))
    return F.when(ok, target)


def under(path: Column | str, root: str) -> Column:
    """Whether a path lies in ``root``, segment by segment."""
    p, root = _col(path), root.rstrip("/")
    return F.lit(True) if not root else (p == root) | p.startswith(f"{root}/")
