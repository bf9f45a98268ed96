"""Keyed pseudonyms and reproducible hash order."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_pads(key: str) -> tuple[bytes, bytes]:
    """Inner and outer 64-byte pads of HMAC-SHA256 (RFC 2104)."""
    raw = key.encode("utf-8")
    if len(raw) > 64:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def hmac_sha256(message: Column, key: str) -> Column:
    """Hex HMAC-SHA256 of a string column, composed from ``sha2``."""
    inner_pad, outer_pad = hmac_pads(key)
    inner = F.sha2(F.concat(F.lit(inner_pad), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer_pad), F.unhex(inner)), 256)


def pseudonym(name: Column, key: str, length: int = 16) -> Column:
    """Keyed code of a name; NULL for a missing or empty one."""
    return F.when(F.length(name) > 0, F.substring(hmac_sha256(name, key), 1, length))


def order_key(seed: int | str, key: Column) -> Column:
    """Seeded hash to order rows by: the same in every engine and every run."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)
