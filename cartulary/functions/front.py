"""YAML front matter as an ordered array of pairs, through one Arrow function."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from cartulary.functions import text as T
from cartulary.functions.paths import file_kind
from cartulary.session import spread_small

try:
    import yaml
except ImportError:  # pragma: no cover
    yaml = None

#: Known keys in their canonical order.
KNOWN = ("type", "title", "description", "resource", "tags", "timestamp", "status")
_S = StringType()
PAIR = StructType(
    [StructField("key", _S), StructField("tag", _S), StructField("scalar", _S), StructField("items", ArrayType(_S)), StructField("json", _S)]
)
FRONT = StructType([StructField("error", _S), StructField("pairs", ArrayType(PAIR))] + [StructField(k, _S) for k in KNOWN if k != "tags"])

_INT = re.compile(r"[-+]?[0-9]+$|0o[0-7]+$|0x[0-9a-fA-F]+$")
_FLOAT = re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$|[-+]?\.(?:inf|Inf|INF)$|\.(?:nan|NaN|NAN)$")


def _loader():
    """A loader with the core schema of YAML 1.2: no dates, no yes and no, no base 60; keys of a map are unique."""

    class Core(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        yaml_implicit_resolvers: dict = {}

    Core.add_implicit_resolver("tag:yaml.org,2002:null", re.compile(r"(?:~|null|Null|NULL|)$"), ["~", "n", "N", ""])
    Core.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    Core.add_implicit_resolver("tag:yaml.org,2002:int", _INT, list("-+0123456789"))
    Core.add_implicit_resolver("tag:yaml.org,2002:float", _FLOAT, list("-+0123456789."))

    def integer(loader: Any, node: Any) -> int:
        s = loader.construct_scalar(node)
        return int(s[2:], 8) if s.startswith("0o") else int(s, 16) if s.startswith("0x") else int(s)

    def number(loader: Any, node: Any) -> float:
        s = loader.construct_scalar(node).lower()
        return float(s.replace(".inf", "inf").replace(".nan", "nan"))

    def mapping(loader: Any, node: Any) -> dict:
        out: dict = {}
        for k, v in node.value:
            key = loader.construct_object(k, deep=True)
            key = key if isinstance(key, str) else as_string(key)
            if key in out:
                raise yaml.YAMLError(f"duplicate key {key!r}")
            out[key] = loader.construct_object(v, deep=True)
        return out

    def inner(loader: Any, suffix: str, node: Any) -> Any:
        if isinstance(node, yaml.ScalarNode):
            return loader.construct_scalar(node)
        return mapping(loader, node) if isinstance(node, yaml.MappingNode) else loader.construct_sequence(node, deep=True)

    Core.add_constructor("tag:yaml.org,2002:int", integer)
    Core.add_constructor("tag:yaml.org,2002:float", number)
    Core.add_constructor("tag:yaml.org,2002:map", mapping)
    Core.add_multi_constructor("!", inner)
    return Core


def _number(v: float) -> str:
    return str(int(v)) if isinstance(v, float) and v.is_integer() and abs(v) < 1e21 else repr(v)


def as_string(v: Any) -> str:
    """A value as text: lists joined by commas with nulls empty, maps as a mark."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return _number(v)
    if isinstance(v, list):
        return ",".join("" if x is None else as_string(x) for x in v)
    return "[object Object]" if isinstance(v, dict) else str(v)


def query_string(v: Any) -> str:
    """A value as text for searching: null is empty."""
    return "" if v is None else json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else as_string(v)


def _finite(v: Any) -> Any:
    if isinstance(v, float) and not math.isfinite(v):
        return None
    if isinstance(v, dict):
        return {k: _finite(x) for k, x in v.items()}
    return [_finite(x) for x in v] if isinstance(v, list) else v


def parse(text: str) -> dict:
    """Error and ordered pairs of one front matter; blank text and what isn't a map give no pairs."""
    if yaml is None:
        raise RuntimeError("reading front matter needs PyYAML")
    out: dict = {"error": None, "pairs": [], **{k: None for k in KNOWN if k != "tags"}}
    if not text.strip():
        return out
    try:
        data = yaml.load(text, Loader=_loader_once())  # noqa: S506 (a safe loader)
    except (yaml.YAMLError, ValueError, RecursionError) as e:
        return out | {"error": " ".join(str(e).split())[:200] or "malformed"}
    if not isinstance(data, dict):
        return out
    known = [k for k in KNOWN if k in data]
    for k in [*known, *(k for k in data if k not in KNOWN)]:
        v = data[k]
        tag = "null" if v is None else "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else "list" if isinstance(v, list) else "map" if isinstance(v, dict) else "str"
        if k in KNOWN and k not in ("tags", "timestamp") and v is not None:
            v, tag = as_string(v), "str"
        items = [query_string(x) for x in v] if tag == "list" else None
        out["pairs"].append({"key": k, "tag": tag, "scalar": query_string(v) if tag != "list" else None, "items": items, "json": json.dumps(_finite(v), ensure_ascii=False)})
        if k in KNOWN and k != "tags" and v is not None:
            out[k] = as_string(v)
    return out


_core: list = []


def _loader_once():
    if not _core:
        _core.append(_loader())
    return _core[0]


@pandas_udf(FRONT)
def parse_front(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in batches:
        yield pd.DataFrame([parse(x or "") for x in s], columns=FRONT.names)


def parse_files(files: DataFrame) -> DataFrame:
    """``files`` (path, raw) with its parts: (path, kind, fm_error, fm_message, pairs, the known text fields, body, raw).

    ``fm_error`` is missing, unclosed or malformed, null otherwise. Index and log pages keep their whole text as body
    and have no pairs. A null raw counts as an empty text; rows with a null path are left out.
    """
    raw, reserved = F.coalesce("raw", F.lit("")), F.col("kind") != "concept"
    df = spread_small(files.filter("path IS NOT NULL").select("path", raw.alias("raw"))).withColumn("kind", file_kind("path"))
    df = df.withColumn("front", T.front_text(F.col("raw")))
    df = df.withColumn("f", parse_front(F.when(~reserved, F.col("front"))))
    blank = F.col("front") == ""
    error = F.when(reserved, None).when(F.col("front").isNull(), "unclosed").when(blank & ~F.col("raw").startswith("---"), "missing").when(F.col("f.error").isNotNull(), "malformed")
    known = [F.col(f"f.{k}").alias(k) for k in KNOWN if k != "tags"]
    body = F.when(reserved, F.col("raw")).otherwise(T.body_text(F.col("raw")))
    return df.select("path", "kind", error.alias("fm_error"), F.col("f.error").alias("fm_message"), F.col("f.pairs").alias("pairs"), *known, body.alias("body"), "raw")


def build_raw(pairs: dict[str, Any], body: str) -> str:
    """Front matter and body as one text: known keys first, empty texts and, of known keys, empty lists left out."""
    keep = {}
    for k in [*(k for k in KNOWN if k in pairs), *(k for k in pairs if k not in KNOWN)]:
        v = pairs[k]
        if v == "" or (k in KNOWN and v == []):
            continue
        keep[k] = v
    front = yaml.safe_dump(keep, allow_unicode=True, sort_keys=False, default_flow_style=False, width=10**9) if keep else ""
    return f"---\n{front}---\n{body}"
