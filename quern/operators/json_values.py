"""JSON of unknown shape: members, leaves, and privacy by the names of keys at any depth."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: keys whose strings privacy rewrites, by kind --------------------------
QUERY_KEYS = ("query", "seed")
CONTENT_KEYS = (
    "body signature symbol anchor_symbol excerpt normalized_key normalized_keys constraint_keys normalized_text evidence summary reason detail rank_reason checks followups "
    "recommended_followups shared_evidence missing_evidence unknowns gaps"
).split()
PATH_KEYS = ("path", "related_tests", "launcher_recommended", "removed_files", "project_root", "db_path", "resolved_project_path", "resolved_db_path")
PATH_ENDS = ("_path", "_paths", "_root")
MASKED = {"query": "<redacted-query>", "content": "<redacted-content>", "error": "operation failed (privacy_mode=mask); details redacted"}
HASHED = {"path": "<hash:{}>", "query": "<query-hash:{}>", "content": "<content-hash:{}>", "error": "operation failed (privacy_mode=hash); fingerprint={}"}
HASH_CHARS = 12


def kind_of_key(key: str) -> str | None:
    """error, query, content or path, or None where strings stay as they are."""
    low = key.lower()
    if low == "error":
        return "error"
    if low in QUERY_KEYS or low.endswith("_query"):
        return "query"
    if low in CONTENT_KEYS:
        return "content"
    return "path" if low in PATH_KEYS or low.endswith(PATH_ENDS) else None


def sanitize_text(mode: str, kind: str, text: str) -> str:
    if mode == "hash":
        return HASHED[kind].format(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:HASH_CHARS])
    if kind == "path":
        return f"<masked:{re.split(r'[/\\]', text)[-1] or '***'}>"
    return MASKED[kind]


def sanitize_value(mode: str, value, key: str | None = None):
    """A JSON value with the strings under private keys rewritten; lists hand their key on to their items."""
    if isinstance(value, dict):
        return {k: sanitize_value(mode, v, k) for k, v in value.items()}
    if isinstance(value, list):
        return [sanitize_value(mode, v, key) for v in value]
    kind = kind_of_key(key) if key is not None and isinstance(value, str) else None
    return sanitize_text(mode, kind, value) if kind else value


def sanitized(df: DataFrame, column: str, mode: str) -> DataFrame:
    """``df`` with its JSON column rewritten for the mode ``mask`` or ``hash``; ``off`` changes nothing.

    A null stays null; a text that is no JSON becomes null, so nothing gets out unread.
    """
    if mode == "off":
        return df
    if mode not in ("mask", "hash"):
        raise ValueError(f"privacy mode {mode!r} is none of off, mask, hash")
    at = df.columns.index(column)

    def rewrite(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(sanitize_value(mode, json.loads(text)), separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([rewrite(v) for v in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, batch.schema.field(at).with_type(pa.string()), new)

    return df.mapInArrow(run, df.schema)


def result_json(df: DataFrame) -> DataFrame:
    """Every row of a result as one JSON text, nulls kept as members."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def members(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """``(*keep, key, value)``: the members of JSON objects of any shape, values as JSON text.

    Values stay in the engine's variant type until they are written as text; arrays give
    their places as keys; scalars and texts that are no JSON give nothing.
    """
    parsed = F.try_parse_json(F.col(column))
    rows = df.select(*keep, parsed.alias("v")).where("v is not null")
    view = rows.lateralJoin(_exploded("v"))
    key = F.coalesce("key", F.col("pos").cast("string"))
    return view.select(*keep, key.alias("key"), F.to_json("value").alias("value"))


def _exploded(column: str) -> DataFrame:
    from pyspark.sql import SparkSession

    return SparkSession.active().tvf.variant_explode(F.col(column).outer())


def leaves(df: DataFrame, column: str, depth: int, *keep: str) -> DataFrame:
    """``(*keep, json_path, value)``: the scalars down to ``depth`` levels, with their paths.

    One explode for each level, over all rows together.
    """
    rows = df.select(*keep, F.lit("$").alias("json_path"), F.col(column).alias("value"))
    done = None
    for level in range(depth + 1):
        nested = F.rlike("value", F.lit(r"^\s*[\{\[]"))
        flat = rows.where(~nested)
        done = flat if done is None else done.unionByName(flat)
        if level == depth:
            break
        inner = members(rows.where(nested), "value", *keep, "json_path")
        rows = inner.select(*keep, F.concat("json_path", F.lit("."), "key").alias("json_path"), "value")
    return done


def extract(column: Column, path: str, kind: str = "string") -> Column:
    """The value at a JSON path, null where there is none or it is of another kind."""
    return F.try_variant_get(F.try_parse_json(column), path, kind)
