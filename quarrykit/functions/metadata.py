"""JSON metadata: what a trace may keep of it, tool arguments and outputs without their content, canonical forms."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarrykit.functions.text import REDACTED_CHARS, SECRET

MAX_DEPTH, MAX_ITEMS = 4, 64
_SECRET, _CONTROL = re.compile(SECRET), re.compile(r"[\x00-\x1f\x7f]")

# Fields of a tool's arguments that a trace keeps.
ARGUMENTS = {
    "read_file": ("path", "start_line", "end_line"), "create_file": ("path",), "replace_text": ("path",), "run_tests": ("paths", "max_failures", "timeout_seconds"), "run_ruff": ("paths", "timeout_seconds"),
    "list_directory": ("path", "recursive"), "search_code": ("path", "max_results", "case_sensitive"), "find_symbol": ("path", "max_results"), "git_status": (), "git_diff": ("path", "staged", "max_chars"),
    "indexed_code_search": ("max_results",),
}
# Fields of which a trace keeps the length.
MEASURED = {"replace_text": ("old_text", "new_text"), "create_file": ("content",), "search_code": ("query",), "find_symbol": ("symbol",), "indexed_code_search": ("query",)}
_HASHES, _FLAGS = {"sha256", "before_sha256", "after_sha256"}, {"recursive", "case_sensitive", "staged", "truncated", "clean", "passed", "timed_out"}


def redact(text: str) -> str:
    return _CONTROL.sub(" ", _SECRET.sub(lambda m: (m[1] or "") + "[REDACTED]", text))[:REDACTED_CHARS]


def kept(value, keys: frozenset[str] | None, depth: int = 0):
    """value without unknown keys (None: all are known), what lies too deep, too many items, and numbers that aren't finite."""
    if depth > MAX_DEPTH:
        return None
    match value:
        case None | bool() | int():
            return value
        case float():
            return value if math.isfinite(value) else None
        case str():
            return redact(value)
        case dict():
            return {k: kept(v, keys, depth + 1) for k, v in list(value.items())[:MAX_ITEMS] if keys is None or k in keys}
        case list() | tuple():
            return [kept(v, keys, depth + 1) for v in value[:MAX_ITEMS]]
    return None


def public_path(path) -> str | None:
    if not isinstance(path, str):
        return None
    path = path.replace("\\", "/")
    return None if path.startswith("/") or re.match("[A-Za-z]:", path) or ".." in path.split("/") else redact(path)


def _typed(key: str, value):
    if key == "path":
        return public_path(value)
    if key == "paths":
        return [public_path(p) for p in value[:MAX_ITEMS]] if isinstance(value, list) else None
    if key in _HASHES:
        return value if isinstance(value, str) and re.fullmatch("[0-9a-fA-F]{64}", value) else None
    if key in _FLAGS:
        return value if isinstance(value, bool) else None
    fits = isinstance(value, int | float) if key == "duration_seconds" else isinstance(value, int)
    return value if fits and not isinstance(value, bool) else None


def tool_arguments(name: str, data: dict) -> dict:
    out = kept({k: _typed(k, data[k]) for k in ARGUMENTS.get(name, ()) if k in data}, None)
    out |= {f"{k}_chars": len(data[k]) for k in MEASURED.get(name, ()) if isinstance(data.get(k), str)}
    return out | ({"expected_sha256_present": data.get("expected_sha256") is not None} if name == "replace_text" else {})


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def _decoded(text: str | None) -> dict:
    try:
        value = json.loads(text) if text else {}
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def allow_listed(keys: Iterable[str]):
    """A UDF over JSON texts: canonical JSON of what may stay; a text that is no object gives {}."""
    known = frozenset(keys)

    @F.pandas_udf(StringType())
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: canonical(kept(_decoded(t), known)))

    return clean


@F.pandas_udf(StringType())
def public_arguments(names: pd.Series, texts: pd.Series) -> pd.Series:
    """Canonical JSON of what a trace keeps of a tool call's arguments."""
    return pd.Series([canonical(tool_arguments(n, _decoded(t))) for n, t in zip(names, texts, strict=True)])


def call_identity(tool: Column, arguments: Column, revision: Column) -> Column:
    """Equal for equal calls at one revision; arguments: canonical JSON."""
    return F.sha2(F.to_json(F.struct(tool.alias("tool"), arguments.alias("arguments"), revision.alias("revision"))), 256)


def is_json_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def escaped_json(text: Column) -> Column:
    """JSON that is safe inside markup."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("\\u0026")), F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e"))
