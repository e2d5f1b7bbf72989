"""Keyed pseudonyms and coarsening as column expressions."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex of a binary message. The key is one for a whole query, so its padded forms are literals."""
    padded = (hashlib.sha256(key).digest() if len(key) > _BLOCK else key).ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in padded)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def partner_key(secret: str, partner: str) -> bytes:
    """One key for each partner from a master secret."""
    return hmac.digest(secret.encode(), f"partner:{partner}".encode(), "sha256")


def pseudonym(key: bytes, vehicle_id: Column) -> Column:
    """A vehicle's name for one partner: 16 hex digits."""
    return F.substring(hmac_sha256(key, vehicle_id.cast("binary")), 1, 16)


def coarse_cell(geohash: Column, precision: int = 5) -> Column:
    return F.substring(geohash, 1, precision)


def hour_of(ts: Column) -> Column:
    """Epoch seconds of the hour's start."""
    return (F.floor(ts / 3600) * 3600).cast("long")


def hashed_identity(value: Column) -> Column:
    """SHA-256 in hex of a personal identifier."""
    return F.sha2(value.cast("binary"), 256)
