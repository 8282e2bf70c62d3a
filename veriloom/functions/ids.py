"""Stable identities: a prefix and the first 24 hex digits of a SHA-256 over canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ + 24 hex of the SHA-256 of the JSON array of the parts as text; null parts stay null."""
    body = F.to_json(F.array(*(p.cast("string") for p in parts)), {"ignoreNullFields": "false"})
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(body, 256), 1, 24))


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the JSON object of some columns, names sorted; nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
