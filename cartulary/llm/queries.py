"""Queries of this subpackage by name, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import bpe, pairs, pieces
from cartulary.llm.canonical import NoteValues
from cartulary.llm.mixture import Mixture
from cartulary.llm.near import NearDuplicates
from cartulary.llm.spans import SharedSpans

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(table(spark, d, "files")).found().withColumnsRenamed({"a": "path_a", "b": "path_b"})


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates(table(spark, d, "files")).groups().withColumnRenamed("key", "path")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    cut = F.when(F.max((F.col("boundary") == "forced").cast("int")) > 0, "forced").otherwise("natural")
    return pieces.pieces(table(spark, d, "files"), texts=False).groupBy("path").agg(cut.alias("cut"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.pieces(table(spark, d, "files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return NoteValues(table(spark, d, "files"), table(spark, d, "doc_types")).found()


def p3_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return NoteValues(table(spark, d, "files"), table(spark, d, "doc_types")).unmatched()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = pairs.beyond_chance(pairs.cooccurrence(table(spark, d, "tags"), least=5), 4)
    return found.select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.cooccurrence(table(spark, d, "tags")).withColumnsRenamed({"a": "tag_a", "b": "tag_b"})


def _mixture(spark: SparkSession, d: str) -> Mixture:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    return Mixture(bpe.token_counts(docs, *bpe.vocabulary()), table(spark, d, "source_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).uses()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"), *bpe.vocabulary())


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return SharedSpans(table(spark, d, "documents")).pairs().select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    return SharedSpans(table(spark, d, "documents")).classes().withColumnRenamed("key", "doc_id")


def p9_spans(spark: SparkSession, d: str) -> DataFrame:
    s = SharedSpans(table(spark, d, "documents")).spans()
    return s.withColumnsRenamed({"a": "doc_a", "b": "doc_b"})


def p9_share(spark: SparkSession, d: str) -> DataFrame:
    return SharedSpans(table(spark, d, "documents")).coverage().withColumnRenamed("key", "doc_id")


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_groups, p2_found, p2_pieces, p3_found, p3_unmatched, p5_found, p5_pairs, p7_ids, p8_mix, p8_shares,
            p9_found, p9_copies, p9_spans, p9_share,
        )
    }


_TAGS = """
    WITH clean AS (
      SELECT DISTINCT path, nfc_normalize(lower(regexp_replace(nfc_normalize(tag), '^\\s+|\\s+$', '', 'g'))) AS tag
      FROM tags WHERE path IS NOT NULL AND tag IS NOT NULL),
    one AS (SELECT * FROM clean WHERE tag <> ''),
    n AS (SELECT tag, count(*) AS n FROM one GROUP BY tag),
    pairs AS (SELECT a.tag AS tag_a, b.tag AS tag_b, count(*) AS "both"
              FROM one a JOIN one b ON a.path = b.path AND a.tag < b.tag GROUP BY ALL)
    SELECT tag_a, tag_b, "both", x.n AS n_a, y.n AS n_b, (SELECT count(DISTINCT path) FROM one) AS n
    FROM pairs JOIN n x ON x.tag = tag_a JOIN n y ON y.tag = tag_b"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f'SELECT tag_a, tag_b FROM ({_TAGS}) WHERE "both" >= 5 AND "both" * n >= 4 * n_a * n_b',
        "p5_pairs": f'SELECT *, "both" * n::DOUBLE / (n_a::DOUBLE * n_b) AS lift, log2(lift) AS pmi FROM ({_TAGS})',
    }
