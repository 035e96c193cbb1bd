"""Metadata filters: a tree of predicates over a JSON object, checked and compiled to a Column.

A leaf is {"key", "op", "value"} with op one of eq, ne, lt, lte, gt, gte, in, exists; a group is {"all": [...]} or
{"any": [...]}. A missing key matches `ne` and `exists: false` only. Order is defined between two numbers or two
strings, the latter by code point. Numbers compare as decimal(38,18): 5 equals 5.0.
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE = {"lt": "<", "lte": "<=", "gt": ">", "gte": ">="}
OPS = {"eq", "ne", "in", "exists", *COMPARE}
MAX_DEPTH, MAX_LEAVES, MAX_VALUES, MAX_KEY = 4, 32, 256, 128


class InvalidFilter(ValueError):
    pass


def validate(tree: Any) -> None:
    leaves = 0

    def visit(node: Any, depth: int) -> None:
        nonlocal leaves
        if not isinstance(node, dict):
            raise InvalidFilter("a filter is an object")
        if depth > MAX_DEPTH:
            raise InvalidFilter(f"deeper than {MAX_DEPTH}")
        groups = [g for g in ("all", "any") if g in node]
        if groups:
            if len(groups) > 1 or len(node) > 1:
                raise InvalidFilter("a node is a group or a leaf")
            if not isinstance(node[groups[0]], list) or not node[groups[0]]:
                raise InvalidFilter("a group has members")
            for child in node[groups[0]]:
                visit(child, depth + 1)
            return
        leaves += 1
        if leaves > MAX_LEAVES:
            raise InvalidFilter(f"more than {MAX_LEAVES} predicates")
        key, op = node.get("key"), node.get("op")
        if not isinstance(key, str) or not 1 <= len(key.encode()) <= MAX_KEY:
            raise InvalidFilter("a key has 1 to 128 bytes")
        if op not in OPS:
            raise InvalidFilter(f"unknown op {op!r}")
        if "value" not in node or set(node) - {"key", "op", "value"}:
            raise InvalidFilter("a leaf has key, op and value")
        value = node["value"]
        if op in COMPARE and (isinstance(value, bool) or not isinstance(value, (int, float, str))):
            raise InvalidFilter("only numbers and strings have an order")
        if op == "exists" and not isinstance(value, bool):
            raise InvalidFilter("exists takes true or false")
        if op == "in" and (not isinstance(value, list) or not 1 <= len(value) <= MAX_VALUES or any(isinstance(v, (list, dict)) for v in value)):
            raise InvalidFilter("in takes 1 to 256 plain values")
        if op in ("eq", "ne") and isinstance(value, (list, dict)):
            raise InvalidFilter("eq and ne take a plain value")

    visit(tree, 1)


def _kind(value: Any) -> str:
    if value is None:
        return "null"
    return "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def compile_filter(tree: dict | None, metadata: str) -> Column:
    """A boolean Column over the JSON text column `metadata`; no filter is true."""
    if tree is None:
        return F.lit(True)
    validate(tree)
    whole = f"try_parse_json({metadata})"

    def leaf(node: dict) -> str:
        key, op, value = node["key"], node["op"], node["value"]
        path = "$[" + json.dumps(key, ensure_ascii=False).replace("\\", "\\\\") + "]" if "'" in key else f"$['{key}']"
        x = f"try_variant_get({whole}, {_sql(path)}, 'variant')"
        here = f"coalesce(schema_of_variant({whole}) LIKE 'OBJECT<%' AND {x} IS NOT NULL, false)"
        schema = f"schema_of_variant({x})"
        kinds = {
            "null": f"coalesce(is_variant_null({x}), false)",
            "string": f"coalesce({schema} = 'STRING', false)",
            "boolean": f"coalesce({schema} = 'BOOLEAN', false)",
            "number": f"coalesce({schema} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {schema} LIKE 'DECIMAL%', false)",
        }

        def compare(v: Any, sign: str) -> str:
            kind = _kind(v)
            if kind == "null":
                return kinds["null"]
            if kind == "string":
                return f"({kinds[kind]} AND coalesce(try_variant_get({x}, '$', 'string') {sign} {_sql(v)}, false))"
            if kind == "boolean":
                return f"({kinds[kind]} AND coalesce(try_variant_get({x}, '$', 'boolean') {sign} {str(v).lower()}, false))"
            return f"({kinds[kind]} AND coalesce(try_variant_get({x}, '$', 'decimal(38,18)') {sign} CAST('{v!r}' AS DECIMAL(38,18)), false))"

        if op == "exists":
            return here if value else f"NOT {here}"
        if op == "ne":
            return f"(NOT {here} OR NOT {compare(value, '=')})"
        if op == "in":
            return f"({here} AND ({' OR '.join(compare(v, '=') for v in value)}))"
        return f"({here} AND {compare(value, '=' if op == 'eq' else COMPARE[op])})"

    def build(node: dict) -> Column:
        if "all" in node:
            return reduce(lambda a, b: a & b, map(build, node["all"]))
        if "any" in node:
            return reduce(lambda a, b: a | b, map(build, node["any"]))
        return F.expr(leaf(node))

    return build(tree)
