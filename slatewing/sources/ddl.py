"""CREATE TABLE statements: columns, keys and indexes."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field

from pyspark.sql import types as T

from slatewing.sources.types import spark_type


@dataclass(frozen=True)
class Table:
    """A declared table; ``keys`` maps an index kind ("PK" or "IDX") to its single columns."""

    name: str
    schema: T.StructType
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)


def parts(body: str) -> list[str]:
    """The comma-parted items at depth 0."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(body):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(body[start:i])
            start = i + 1
    return [x.strip() for x in [*out, body[start:]] if x.strip()]


def parse_create(statement: str) -> Table:
    """The table that a CREATE TABLE statement declares. Keys of several columns are passed over with
    a warning, as only single columns can be indexed."""
    m = re.match(r"\s*create\s+table\s+(?:if\s+not\s+exists\s+)?[`\"]?([\w.]+)[`\"]?\s*\((.*)\)\s*;?\s*$", statement, re.I | re.S)
    if not m:
        raise ValueError(f"not a CREATE TABLE statement: {statement[:80]!r}")
    fields, primary, indexed = [], [], []
    for item in parts(m[2]):
        if key := re.match(r"(?:constraint\s+\w+\s+)?primary\s+key\s*\(([^)]*)\)", item, re.I):
            primary.append(key[1])
        elif key := re.match(r"(?:unique\s+)?(?:index|key)\b[^(]*\(([^)]*)\)", item, re.I):
            indexed.append(key[1])
        elif re.match(r"(?:foreign\s+key|unique|check|constraint)\b", item, re.I):
            continue
        else:
            name, _, rest = item.partition(" ") if " " in item else (item, "", "string")
            name = name.strip("`\"")
            fields.append(T.StructField(name, spark_type(" ".join(rest.split()))))
            if re.search(r"\bprimary\s+key\b", rest, re.I):
                primary.append(name)
    for x in (x for x in (*primary, *indexed) if "," in x):
        warnings.warn(f"table {m[1]}: no index of several columns ({x.strip()}) is built", stacklevel=2)
    single = lambda lists: tuple(x.strip(" `\"") for x in lists if "," not in x)
    keys = {kind: cols for kind, cols in (("PK", single(primary)), ("IDX", single(indexed))) if cols}
    return Table(m[1].rpartition(".")[2], T.StructType(fields), keys)
