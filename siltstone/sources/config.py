"""Settings: defaults, deep merge, environment values, and collections as a table."""

from __future__ import annotations

import hashlib
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession

#: Defaults of the engine. Fixed values.
DEFAULTS = {"glob": "**/*.md", "multi_get_bytes": 10 * 1024, "embed_batch_docs": 64, "embed_batch_bytes": 64 * 1024 * 1024, "research": {"min_words": 200, "max_words": 50_000, "max_urls": 100, "max_bytes": 50 * 1024 * 1024}}
COLLECTION = "name string, root string, pattern string, ignore array<string>, include_by_default boolean, context map<string,string>, type string"


def merge(base: dict, over: dict) -> dict:
    """over upon base; maps merge, all else, lists too, is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def substitute(value, env: dict[str, str] | None = None):
    """${NAME} in strings replaced by environment values; a missing one is an error."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    if isinstance(value, str):

        def one(m: re.Match) -> str:
            if m[1] not in env:
                raise KeyError(f"{m[1]} is not set")
            return env[m[1]]

        return re.sub(r"\$\{(\w+)\}", one, value)
    return value


def require(settings: dict, keys: list[str]) -> dict:
    """settings, unless a dotted key is missing or empty."""
    for key in keys:
        at = settings
        for part in key.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at in (None, ""):
            raise ValueError(f"{key} is missing")
    return settings


def collection_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", name):
        raise ValueError("a collection's name has letters, digits, _ and - only")
    return name


def config_hash(rows: list[dict]) -> str:
    """Of what collections say, whatever their order."""
    return hashlib.sha256(json.dumps(sorted((sorted(r.items()) for r in rows), key=str), ensure_ascii=False).encode()).hexdigest()


def upserted(held: list[dict], new: list[dict], remove: bool = False) -> list[dict]:
    """held with new ones put in by name: what a new one says counts, what it doesn't say stays. With remove, those that aren't among the new go."""
    old = {r["name"]: r for r in held}
    by = {} if remove else dict(old)
    for r in new:
        by[collection_name(r["name"])] = {**old.get(r["name"], {}), **r}
    return [by[n] for n in sorted(by)]


def collections(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = [c.split(" ")[0] for c in ("name string", "root string", "pattern string", "ignore array", "include_by_default boolean", "context map", "type string")]
    full = [{"pattern": DEFAULTS["glob"], "ignore": [], "context": {}, "type": "static", **r} for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full if collection_name(r["name"])], COLLECTION)
