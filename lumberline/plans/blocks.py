"""Extraction schemas: an ordered list of blocks that describes the lines of a log.

A schema is a parameter of the extraction operators, as a join condition is of a join.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

# Block kinds by their names in schema files.
KINDS = (
    "constant", "text", "greedy-text", "timestamp", "level", "hex", "integer", "ip", "path", "regex", "remainder",
)
# Names of kinds in older schema files.
OLD_KINDS = {"optional-text": "text", "optional-path": "path", "ignore": "text"}

FREE_TEXT = {"text", "greedy-text", "remainder"}
ANCHORS = {"timestamp", "level", "ip"}
TOKENS = {"timestamp", "level", "hex", "integer", "ip"}
UNTRIMMED = {"constant", "regex", "remainder"}

SCHEMA_VERSION = 3


@dataclass(frozen=True)
class Block:
    """One piece of a line: a value of some kind, what encloses it, and the glue to the next block."""

    kind: str
    name: str = ""
    leading: str = ""
    closing: str = ""
    separator: str = ""
    separator_regex: bool = False
    pattern: str = ""  # text of a constant, expression of a regex block
    hidden: bool = False

    @property
    def is_field(self) -> bool:
        return not self.hidden and (self.kind != "constant" or bool(self.name.strip()))

    @property
    def ends_itself(self) -> bool:
        """The value is over by its own shape, so that glue after it may be missing."""
        return self.kind in TOKENS or self.kind == "constant" or bool(self.closing)

    @property
    def solid(self) -> bool:
        """Something in the line must be there for the block to match."""
        return bool(self.separator or self.closing) or self.kind not in FREE_TEXT

    @property
    def evidence(self) -> bool:
        """Matching it tells a structured line from free text."""
        if self.kind == "constant":
            return len(self.pattern.strip()) >= 3
        return self.kind in ANCHORS or self.kind == "regex"


@dataclass(frozen=True)
class Schema:
    blocks: tuple[Block, ...]
    line_prefix: str = ""
    warnings: tuple[str, ...] = field(default=(), compare=False)

    @property
    def field_blocks(self) -> list[int]:
        return [i for i, b in enumerate(self.blocks) if b.is_field]

    @property
    def field_names(self) -> list[str]:
        return [self.blocks[i].name for i in self.field_blocks]


class SchemaError(ValueError):
    """The schema cannot be applied."""


def _readable(pattern: str) -> bool:
    from pyspark.sql import SparkSession

    from lumberline.functions.rules import regex_is_valid

    if SparkSession.getActiveSession() is not None:
        return regex_is_valid(f"(?:{pattern})")
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def problems(schema: Schema) -> list[str]:
    """Why the schema cannot be applied; empty if it can.

    Spark would report a bad expression only inside the running job.
    """
    found: list[str] = [] if schema.blocks else ["no blocks"]
    seen: set[str] = set()
    for at, block in enumerate(schema.blocks, start=1):
        if block.kind not in KINDS:
            found.append(f"block {at}: unknown kind {block.kind!r}")
        if block.kind == "constant" and not block.pattern:
            found.append(f"block {at}: constant without text")
        if block.kind == "regex" and not (block.pattern.strip() and _readable(block.pattern.strip())):
            found.append(f"block {at}: empty or invalid expression")
        if block.separator_regex and block.separator.strip() and not _readable(block.separator.strip()):
            found.append(f"block {at}: invalid separator expression")
        if block.kind == "remainder" and at < len(schema.blocks):
            found.append(f"block {at}: the remainder must come last")
        if block.is_field:
            key = block.name.strip().lower()
            if not key or key in seen:
                found.append(f"block {at}: empty or repeated field name {block.name!r}")
            seen.add(key)
    return found


def checked(schema: Schema) -> Schema:
    why = problems(schema)
    if why:
        raise SchemaError("; ".join(why))
    return schema


def with_unique_names(schema: Schema) -> Schema:
    """Number repeated field names: ``Field``, ``Field 2``, …"""
    taken: set[str] = set()
    blocks = []
    for block in schema.blocks:
        if block.is_field:
            base = block.name if block.name.strip() else "Field"
            name, n = base, 2
            while name.lower() in taken:
                name, n = f"{base} {n}", n + 1
            taken.add(name.lower())
            block = replace(block, name=name)
        blocks.append(block)
    return replace(schema, blocks=tuple(blocks))


def _block_from_json(entry: dict) -> Block:
    named = str(entry.get("kind", "")).strip().lower()
    kind = OLD_KINDS.get(named, named)
    if kind not in KINDS:
        raise SchemaError(f"unknown kind {named!r}")
    leading, separator = entry.get("leadingText", ""), entry.get("separator", "")
    closing = entry.get("closingText", "")
    if "closingText" not in entry and leading:
        # Older files kept the closing bracket of an enclosed block in its separator.
        closing, separator = separator, ""
    return Block(
        kind=kind,
        name=str(entry.get("name", "")).strip(),
        leading=leading,
        closing=closing,
        separator=separator,
        separator_regex=bool(entry.get("separatorIsRegex", False)),
        pattern=entry.get("customRegex", ""),
        hidden=bool(entry.get("ignored", False)) or named == "ignore",
    )


def schema_from_json(text: str) -> Schema:
    """Read a schema file of version 1 to 3; anything else raises ``SchemaError``."""
    try:
        root = json.loads(text)
    except json.JSONDecodeError as error:
        raise SchemaError(str(error)) from error
    if not isinstance(root, dict) or int(root.get("version", 0) or 0) > SCHEMA_VERSION:
        raise SchemaError("not a schema of a known version")
    entries = root.get("blocks", [])
    if not all(isinstance(e, dict) for e in entries):
        raise SchemaError("a block is not an object")
    return checked(Schema(tuple(map(_block_from_json, entries)), root.get("linePrefix", "")))
