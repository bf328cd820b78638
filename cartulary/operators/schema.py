"""Document types: required fields, allowed statuses and typed relations between notes."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.functions import text as T
from cartulary.functions.front import KNOWN
from cartulary.functions.paths import rel_path
from cartulary.session import small_or_not

TYPES = "name string, required_fields array<string>, allowed_statuses array<string>, body_template string"
RELATIONS = "name string, relation string, target_types array<string>, cardinality string"


def load_catalogue(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame]:
    """Types and relations of a YAML or JSON catalogue; a file that doesn't exist gives empty tables."""
    p = Path(path)
    data: dict[str, Any] = {}
    if p.exists():
        text = p.read_text(encoding="utf-8")
        if p.suffix == ".json":
            data = json.loads(text)
        else:
            import yaml

            data = yaml.safe_load(text) or {}
        if not isinstance(data, dict) or not isinstance(data.get("types", {}), dict):
            raise ValueError(f"{p} is no catalogue of types")
    types, relations = [], []
    for name, t in (data.get("types") or {}).items():
        t = t or {}
        types.append((name, t.get("requiredFields") or [], t.get("allowedStatuses") or [], t.get("bodyTemplate")))
        for r, d in (t.get("relations") or {}).items():
            relations.append((name, r, (d or {}).get("targetTypes") or [], (d or {}).get("cardinality") or "many"))
    return spark.createDataFrame(types, TYPES), spark.createDataFrame(relations, RELATIONS)


def _typed(parsed: DataFrame, types: DataFrame) -> DataFrame:
    own = types.select(F.col("name").alias("type"), "required_fields", "allowed_statuses").dropDuplicates(["type"])
    return parsed.filter("kind = 'concept' AND fm_error IS NULL").join(small_or_not(own), "type")


def _present(key, pairs):
    """A field is there, unless it is a known text field without a value."""
    own = F.filter(pairs, lambda p: (p["key"] == key) & ~((p["tag"] == "null") & p["key"].isin([k for k in KNOWN if k not in ("tags", "timestamp")])))
    return F.size(own) > 0


def schema_checks(parsed: DataFrame, types: DataFrame) -> DataFrame:
    """SCHEMA-REQFIELD for each required field that is absent, SCHEMA-STATUS for a status outside a list that isn't
    empty: (path, level, code, msg, targets). Notes whose type isn't listed are free."""
    typed = _typed(parsed, types)
    lacking = F.filter(F.coalesce("required_fields", F.array().cast("array<string>")), lambda k: ~_present(k, F.col("pairs")))
    check = lambda df, code, msg: df.select("path", F.lit("err").alias("level"), F.lit(code).alias("code"), msg.alias("msg"), F.array("path").alias("targets"))
    fields = check(typed.select("path", F.explode(lacking).alias("field")), "SCHEMA-REQFIELD", F.concat(F.lit("Required field is missing: "), "field"))
    wrong = typed.filter((F.coalesce("status", F.lit("")) != "") & (F.size("allowed_statuses") > 0) & ~F.array_contains("allowed_statuses", F.col("status")))
    return fields.unionByName(check(wrong, "SCHEMA-STATUS", F.concat(F.lit("Status is not allowed: "), "status"))).distinct()


def relation_targets(parsed: DataFrame, relations: DataFrame) -> DataFrame:
    """Targets of typed relations: (path, raw, relation, target_types, cardinality, n, target)."""
    own = small_or_not(relations.withColumnRenamed("name", "type"))
    pair = F.get(F.filter("pairs", lambda p: p["key"] == F.col("relation")), F.lit(0))
    items = F.when(pair["tag"] == "list", pair["items"]).when(pair["tag"] == "str", F.array(pair["scalar"]))
    rows = parsed.filter("kind = 'concept' AND fm_error IS NULL").join(own, "type").withColumn("items", items).filter("items IS NOT NULL")
    return rows.select("path", "raw", "relation", "target_types", "cardinality", F.size("items").alias("n"), F.explode_outer("items").alias("target"))


def relation_checks(parsed: DataFrame, relations: DataFrame) -> DataFrame:
    """REL-CARD, REL-TARGET and REL-TYPE: (path, level, code, msg, targets). A target without a type has none that is wrong."""
    t = relation_targets(parsed, relations)
    base = lambda df, code, msg: df.select("path", F.lit("err").alias("level"), F.lit(code).alias("code"), msg.alias("msg"), F.array("path").alias("targets"))
    card = base(t.filter("cardinality = 'one' AND n > 1").dropDuplicates(["path", "relation"]), "REL-CARD", F.concat(F.lit("Only one target is allowed: "), "relation"))
    known = parsed.filter("kind = 'concept'").select(F.col("path").alias("at"), F.col("type").alias("at_type"), F.lit(True).alias("known")).dropDuplicates(["at"])
    met = t.filter("target IS NOT NULL").withColumn("at", rel_path("target")).join(known, "at", "left")
    broken = base(met.filter("known IS NULL"), "REL-TARGET", F.concat_ws(" ", F.lit("Target is missing:"), "relation", "target"))
    other = met.filter(F.col("at_type").isNotNull() & (F.size("target_types") > 0) & ~F.array_contains("target_types", F.col("at_type")))
    wrong = base(other, "REL-TYPE", F.concat_ws(" ", F.lit("Target has another type:"), "relation", "target"))
    return card.unionByName(broken).unionByName(wrong)


def broken_relations(parsed: DataFrame, relations: DataFrame) -> DataFrame:
    """What a repair would take away: (path, relation, target, line, fix_id)."""
    known = parsed.filter("kind = 'concept'").select(F.col("path").alias("at")).distinct()
    met = relation_targets(parsed, relations).filter("target IS NOT NULL").withColumn("at", rel_path("target"))
    gone = met.join(known, "at", "left_anti")
    lines = F.posexplode(F.split(T.front_text(F.col("raw")), "\n")).alias("no", "line")
    at = gone.select("path", "relation", "target", lines).filter(F.startswith(F.ltrim("line"), F.concat("relation", F.lit(":"))))
    fix = F.concat(F.lit("fix:sha256:"), F.sha2(F.concat_ws("\x00", "path", "relation", "target"), 256))
    return at.groupBy("path", "relation", "target").agg((F.min("no") + 2).alias("line")).withColumn("fix_id", fix)


def blocking_relations(parsed: DataFrame, relations: DataFrame, path: str) -> DataFrame:
    """Typed relations that point to a note, which would break if it went: (path, relation)."""
    return relation_targets(parsed, relations).filter(rel_path("target") == path).select("path", "relation").distinct()


def external_references(parsed: DataFrame, existing: DataFrame, roots: list[str]) -> DataFrame:
    """EXTREF-MISSING for paths in ``implemented_by`` and ``verified_by`` that aren't in ``existing`` (path) or lie
    outside ``roots``."""
    from cartulary.functions.paths import under

    pairs = F.filter("pairs", lambda p: p["key"].isin("implemented_by", "verified_by"))
    items = F.flatten(F.transform(pairs, lambda p: F.when(p["tag"] == "list", p["items"]).when(p["tag"] == "str", F.array(p["scalar"])).otherwise(F.array().cast("array<string>"))))
    ref = parsed.filter("kind = 'concept'").select("path", F.explode(items).alias("target")).filter("target <> ''")
    inside = F.lit(False)
    for r in roots:
        inside = inside | under("target", r)
    there = existing.select(F.col("path").alias("target")).distinct().withColumn("there", F.lit(True))
    gone = ref.join(there, "target", "left").filter(F.col("there").isNull() | ~inside)
    return gone.select("path", F.lit("warn").alias("level"), F.lit("EXTREF-MISSING").alias("code"), F.concat(F.lit("Not found: "), "target").alias("msg"), F.array("path").alias("targets"))
