"""JSON payloads: flattening to paths, masking, canonical hashes."""

from __future__ import annotations

import hashlib
import json
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from driftjobs.constants import MASKS, MAX_FIELD_DEPTH, MAX_MASK_DEPTH

LEAVES = "array<struct<path:string,kind:string,num:double,str:string,len:int>>"
CANONICAL = "struct<normalized:string,payload_hash:string,schema_hash:string,is_object:boolean>"
PAYLOAD = f"struct<parsed:boolean,is_object:boolean,schema_hash:string,leaves:{LEAVES}>"
#: JSON that nests deeper counts as bad JSON, in every function here.
MAX_NESTING = 500
_KINDS = {str: "str", int: "int", float: "float", bool: "bool", list: "list", type(None): "null"}
_PATTERNS = [(re.compile(p), mask) for p, mask in MASKS]
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"')


def _parse(text: str | None):
    """The payload, or None for null, bad JSON and JSON that nests too deep."""
    try:
        if text is None or text.count("{") + text.count("[") > MAX_NESTING and _nesting(text) > MAX_NESTING:
            return None
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _nesting(text: str) -> int:
    deepest = depth = 0
    for c in re.findall(r"[\[\]{}]", _QUOTED.sub("", text)):
        depth += 1 if c in "[{" else -1
        deepest = max(deepest, depth)
    return deepest


def _text(value: str) -> str:
    """The string with U+FFFD for each half of a surrogate pair that stands alone, which JSON can hold and UTF-8 can't."""
    try:
        value.encode()
    except UnicodeEncodeError:
        return "".join("\ufffd" if 0xD800 <= ord(c) < 0xE000 else c for c in value)
    return value


def _number(value: float) -> float | None:
    """The value as a double if it is finite."""
    try:
        number = float(value)
    except OverflowError:
        return None
    return number if math.isfinite(number) else None


def _leaf(path: str, value) -> tuple:
    kind = _KINDS[type(value)]
    num = _number(value) if kind in ("int", "float", "bool") else None
    return path, kind, num, _text(value) if kind == "str" else None, len(value) if kind in ("str", "list") else None


def _leaves(payload) -> list[tuple] | None:
    """A row of kind "visit" for each path that occurs and a row for each value, in order; None without a payload.

    Objects open their keys, lists put their items under ``path[]``; both add a level, and what lies over
    MAX_FIELD_DEPTH levels deep is left out. A list within a list is a value.
    """
    if payload is None:
        return None
    rows, visited, todo = [], set(), [("", payload, 0)] if isinstance(payload, dict) else []
    while todo:
        path, value, depth = todo.pop()
        if isinstance(value, (dict, list)) and depth >= 0:
            if depth > MAX_FIELD_DEPTH:
                continue
            inner = []
            if isinstance(value, list):
                path = f"{path}[]"
                if path not in visited:
                    visited.add(path)
                    rows.append((path, "visit", None, None, None))
                inner = [(path, x, depth + 1 if isinstance(x, dict) else -1) for x in value]
            else:
                for key, x in value.items():
                    own = f"{path}.{_text(key)}" if path else _text(key)
                    inner.append((own, x, depth + 1 if isinstance(x, (dict, list)) else -2))
            todo.extend(reversed(inner))
            if isinstance(value, dict):
                fresh = [p for p, _, _ in inner if p not in visited]
                visited.update(fresh)
                rows.extend((p, "visit", None, None, None) for p in dict.fromkeys(fresh))
        else:
            rows.append(_leaf(path, value))
    return rows


def _list_of_leaves(payloads: list) -> pa.Array:
    rows: list[tuple] = []
    starts: list[int | None] = []
    for payload in payloads:
        leaves = _leaves(payload)
        starts.append(None if leaves is None else len(rows))
        rows.extend(leaves or ())
    types = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.int32())
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, types, strict=True)]
    values = pa.StructArray.from_arrays(columns, ["path", "kind", "num", "str", "len"])
    return pa.ListArray.from_arrays(pa.array([*starts, len(rows)], pa.int32()), values)


def flatten_payload(payload: Column | str) -> Column:
    """An array of (path, kind, num, str, len); null for null and bad JSON, empty for what is no object."""
    return F.arrow_udf(lambda texts: _list_of_leaves([_parse(t) for t in texts.to_pylist()]), LEAVES)(fine_json(payload))


def _read(texts: pa.Array) -> pa.Array:
    payloads = [_parse(t) for t in texts.to_pylist()]
    objects = [isinstance(x, dict) for x in payloads]
    hashes = [_schema_hash(x) if own else None for x, own in zip(payloads, objects, strict=True)]
    columns = [pa.array([x is not None for x in payloads]), pa.array(objects), pa.array(hashes, pa.string()), _list_of_leaves(payloads)]
    return pa.StructArray.from_arrays(columns, ["parsed", "is_object", "schema_hash", "leaves"])


def read_payload(payload: Column | str) -> Column:
    """What features need of a payload, parsed once: whether it is one, whether it is an object, the hash of an object's types, and its leaves."""
    return F.arrow_udf(_read, PAYLOAD)(fine_json(payload))


def _mask(value: str) -> str:
    return next((mask for pattern, mask in _PATTERNS if pattern.search(value)), value)


def _masked(value, depth: int = 0):
    if depth > MAX_MASK_DEPTH:
        return value
    if isinstance(value, str):
        return _mask(value)
    if isinstance(value, dict):
        return {k: _masked(v, depth + 1) for k, v in value.items()}
    return [_masked(v, depth + 1) for v in value] if isinstance(value, list) else value


def _skeleton(value, depth: int = 0):
    if depth > MAX_MASK_DEPTH:
        return type(value).__name__
    if isinstance(value, dict):
        return {k: _skeleton(v, depth + 1) for k, v in value.items()}
    if isinstance(value, list):
        return [_skeleton(value[0], depth + 1)] if value else ["array_empty"]
    return {bool: "boolean", str: "string", type(None): "null"}.get(type(value), "number")


def _canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()[:16]


def _schema_hash(payload) -> str:
    """Of the payload's types; no payload counts as the word null, as in the hash of its content."""
    return _digest("null" if payload is None else _canonical(_skeleton(payload)))


def _canonicalize(payloads: pd.Series) -> pd.DataFrame:
    rows = []
    for payload in map(_parse, payloads):
        masked = _canonical(_masked(payload))
        rows.append((masked, _digest(masked), _schema_hash(payload), isinstance(payload, dict)))
    return pd.DataFrame(rows, columns=["normalized", "payload_hash", "schema_hash", "is_object"])


def canonicalize(payload: Column | str) -> Column:
    """Masked canonical JSON and its hash, and the hash of the payload's types; null and bad payloads count as null."""
    return F.pandas_udf(_canonicalize, CANONICAL)(fine_json(payload))


def _java(pattern: str) -> str:
    """The pattern in Java's words: digits, word characters, spaces and ends of text are those of Unicode, as Python has them."""
    spaces = "\\t-\\r\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
    for mine, theirs in (("\\d", "\\p{Nd}"), ("\\w", "\\p{L}\\p{N}_"), ("\\s", spaces), ("\\Z", "\\z"), ("$", "(?=\\n?\\z)")):
        pattern = pattern.replace(mine, theirs)
    return pattern


def mask_string(text: Column) -> Column:
    """The mask of the first pattern that a flat string matches, else the string; in the JVM."""
    out = None
    for pattern, mask in MASKS:
        met = text.rlike(_java(pattern))
        out = F.when(met, mask) if out is None else out.when(met, mask)
    return out.otherwise(text)


def _nests_too_deep(text: Column) -> Column:
    opened = F.length(text) - F.length(F.translate(text, "[{", ""))
    brackets = F.regexp_extract_all(F.regexp_replace(text, r'"(?:[^"\\\\]|\\\\.)*+"', ""), F.lit(r"[\[\]{}]"), F.lit(0))
    step = lambda s, c: F.struct((s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    return (opened > MAX_NESTING) & (F.aggregate(brackets, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step)["most"] > MAX_NESTING)


def is_json(text: Column) -> Column:
    """Whether a text is JSON, in the JVM: one value and nothing behind it, no name twice in an object, no NaN or infinity, no
    deeper than MAX_NESTING. Null for null.

    This is the one rule: every function here asks it first, also those that parse in Python. The parser stops behind the
    first value, so it is asked twice, in a list and in an object: nothing but one value fits into both.
    """
    fits = lambda before, after: F.try_parse_json(F.concat(F.lit(before), text, F.lit(after))).isNotNull()
    return F.when(text.isNotNull(), fits("[", "]") & fits('{"k":', "}") & ~_nests_too_deep(text))


def fine_json(payload: Column | str) -> Column:
    """The payload if it is JSON, for Python to read: with U+FFFD for bytes that aren't UTF-8."""
    text = F.make_valid_utf8(payload)
    return F.when(is_json(text), text)


def safe_json(text: Column, otherwise: str | None = None) -> Column:
    """The text if it is JSON (``is_json``), else null or what is given."""
    return F.when(is_json(text), text).otherwise(otherwise)
