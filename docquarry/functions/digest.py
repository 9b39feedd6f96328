"""Content digests that do not depend on key order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256_text(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def sha256_fields(**fields: Column) -> Column:
    """SHA-256 of the compact JSON object with its keys in alphabetical order."""
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def sha256_list(values: Column) -> Column:
    """SHA-256 of the compact JSON array."""
    return F.sha2(F.to_json(values), 256)


def resume_key(*parts: Column) -> Column:
    """Compact JSON array of the parts."""
    return F.to_json(F.array(*parts))
