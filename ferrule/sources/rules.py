"""Rule definitions from JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ferrule.errors import ParseError
from ferrule.plans.typing import declared


@dataclass(frozen=True)
class Rule:
    name: str
    expression: str
    version: str = "1.0.0"
    description: str = ""
    category: str = "DEFAULT"
    input_schema: dict[str, str] = field(default_factory=dict)

    def types(self) -> dict[str, str]:
        return {k: declared(v) for k, v in self.input_schema.items()}


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return "" if isinstance(value, (dict, list)) else json.dumps(value)


def parse_rule(text: str | None) -> Rule:
    """A rule from a JSON object; `name` and `expression` are required, a schema that is no object is ignored."""
    if text is None or not text.strip():
        raise ParseError("JSON content cannot be null or empty")
    try:
        root = json.loads(text)
    except ValueError as e:
        raise ParseError(f"Malformed JSON rule content: {e}") from e
    if not isinstance(root, dict):
        raise ParseError("JSON root element must be a JSON object")
    for key in ("name", "expression"):
        if root.get(key) is None:
            raise ParseError(f"Missing required rule attribute: '{key}'")
    get = lambda key, default: default if root.get(key) is None else _text(root[key])
    schema = root.get("inputSchema")
    schema = {k: _text(v) for k, v in schema.items()} if isinstance(schema, dict) else {}
    rule = Rule(_text(root["name"]), _text(root["expression"]), get("version", "1.0.0"), get("description", ""), get("category", "DEFAULT"), schema)
    rule.types()
    return rule


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """The rules in the JSON files under a path that Spark can read; a catalogue is small, and so is collected."""
    rows = spark.read.text(path, wholetext=True).collect()
    return sorted((parse_rule(r[0]) for r in rows), key=lambda r: (r.name, r.version))
