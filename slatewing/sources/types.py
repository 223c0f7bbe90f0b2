"""Declared type names and what they mean here."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# Declared names with a type of their own; every other name is a string.
NAMED = {
    "INT": T.IntegerType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DATE": T.DateType(),
    "FLOAT": T.DoubleType(),
    "DOUBLE": T.DoubleType(),
    "DECIMAL": T.DoubleType(),
    "BOOL": T.BooleanType(),
    "BOOLEAN": T.BooleanType(),
}


def spark_type(declared: str) -> T.DataType:
    """INT, DATE and BOOL as they are; FLOAT and DECIMAL (with or without precision) are doubles, since a
    bare DECIMAL would lose all decimals in Spark; CHAR, VARCHAR and unknown names are plain strings."""
    return NAMED.get(re.split(r"[\s(]", declared.strip().upper(), maxsplit=1)[0], T.StringType())
