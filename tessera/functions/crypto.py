"""Keyed hashes as column expressions. An expression holds the key's pads as literals: always alias it, and keep plans
of pseudonymised data out of logs."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F


def domain_key(pepper: str, domain: str) -> bytes:
    if not pepper:
        raise ValueError("a pepper is needed to pseudonymise")
    return hmac.new(pepper.encode(), domain.encode(), hashlib.sha256).digest()


def pseudonym_key(pepper: str) -> bytes:
    return domain_key(pepper, "pseudonym")


def fingerprint(pepper: str | None) -> str | None:
    """A short mark of the pepper for audit logs, from a key of its own."""
    return "fp:" + hmac_text(domain_key(pepper, "audit"), pepper, 12) if pepper else None


def hmac_text(key: bytes, value: str, n: int) -> str:
    return hmac.new(key, value.encode(), hashlib.sha256).hexdigest()[:n].upper()


def hmac_hex(key: bytes, value: Column) -> Column:
    """HMAC-SHA256 as lower-case hex: two nested hashes over the padded key."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256)


def hash_prefix(key: bytes, value: Column, n: int) -> Column:
    return F.upper(F.left(hmac_hex(key, value), F.lit(n)))
