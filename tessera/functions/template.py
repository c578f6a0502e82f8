"""Templates: compiled once on the driver to a concatenation of column expressions.

Text that one placeholder inserts is not expanded again by another.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules import Rule
from .crypto import hash_prefix, hmac_text
from .normalize import SPACE, TEXT, normalize

PART = re.compile(r"\{(first|second|last|prefix|suffix|digits|major|domain|hash:8|hash:32|(?:head|tail):\d+)\}")
#: 8 hexadecimal digits meet by chance among some ten thousand values; what is joined on takes 32.
HASHED = {"hash:8": 8, "hash:32": 32}
KEYED = (*HASHED, "digits")
SPLIT = rf"(?U)[{SPACE}.\-]+"


def needs_key(template: str) -> bool:
    return any(m[1] in KEYED for m in PART.finditer(template))


def _piece(kind: str, v: Column, key: bytes | None) -> Column:
    if kind in KEYED:
        if key is None:
            raise ValueError("a pepper is needed for this template")
        if kind in HASHED:
            return hash_prefix(key, v, HASHED[kind])
        n = F.length(F.regexp_replace(v, r"(?U)\D", ""))
        n = F.when(n == 0, 11).otherwise(n)
        return F.rpad(F.left(F.translate(hash_prefix(key, v, 16), "ABCDEF", "012345"), n), n, F.lit("0"))
    name, _, number = kind.partition(":")
    if name == "head":
        return F.left(v, F.lit(int(number)))
    if name == "tail":
        return F.right(v, F.lit(int(number))) if int(number) else v
    if name in ("first", "last", "second"):
        return {"first": F.left(v, F.lit(1)), "last": F.right(v, F.lit(1)), "second": F.substring(v, 2, 1)}[name]
    if name == "major":
        return F.regexp_extract(v, r"(?U)\A[vV]?(\d+)", 1)
    if name == "domain":
        return F.when(F.contains(v, F.lit("@")), F.substring_index(v, "@", -1)).otherwise(F.lit(""))
    parts = F.split(v, SPLIT, -1)
    return F.get(parts, F.lit(0)) if name == "prefix" else F.when(F.size(parts) > 1, F.element_at(parts, -1)).otherwise(F.lit(""))


def render(template: str, v: Column, key: bytes | None = None) -> Column:
    """The template for a value; unknown placeholders stay as they are."""
    out, at = [], 0
    for m in PART.finditer(template):
        out += [F.lit(template[at : m.start()])] * (m.start() > at) + [_piece(m[1], v, key)]
        at = m.end()
    out += [F.lit(template[at:])] * (at < len(template))
    return F.concat(*out) if len(out) > 1 else out[0] if out else F.lit("")


def apply_rule(rule: Rule, strategy: str, v: Column, key: bytes | None = None) -> Column:
    """mask: the mask template on the value; pseudo: the pseudonym template on the normalized value. Empty stays."""
    if strategy not in ("mask", "pseudo"):
        raise ValueError(f"strategy {strategy!r} is neither mask nor pseudo")
    if strategy == "pseudo" and key is None:
        raise ValueError("a pepper is needed to pseudonymise")
    done = render(rule.mask, v, key) if strategy == "mask" else render(rule.pseudo, normalize(rule.normalize, v), key)
    return F.when(v != "", done).otherwise(v)


def render_text(template: str, v: str, key: bytes | None = None) -> str:
    """render() of one Python string."""

    def piece(m: re.Match) -> str:
        kind = m[1]
        if kind in KEYED:
            if key is None:
                raise ValueError("a pepper is needed for this template")
            if kind in HASHED:
                return hmac_text(key, v, HASHED[kind])
            n = sum(c.isdecimal() for c in v) or 11
            return "".join(str(int(c, 16) % 10) for c in hmac_text(key, v, 16))[:n].ljust(n, "0")
        name, _, number = kind.partition(":")
        if number:
            n = int(number)
            return v[:n] if name == "head" else v[-n:]
        if name in ("first", "second", "last"):
            return {"first": v[:1], "second": v[1:2], "last": v[-1:]}[name]
        if name == "major":
            found = re.match(r"[vV]?(\d+)", v)
            return found[1] if found else ""
        if name == "domain":
            return v.rpartition("@")[2] if "@" in v else ""
        parts = re.split(r"[\s.\-]+", v)
        return parts[0] if name == "prefix" else parts[-1] if len(parts) > 1 else ""

    return PART.sub(piece, template)


def apply_text(rule: Rule, strategy: str, v: str, key: bytes | None = None) -> str:
    """apply_rule() of one Python string."""
    if not v:
        return v
    return render_text(rule.mask, v, key) if strategy == "mask" else render_text(rule.pseudo, TEXT.get(rule.normalize, TEXT["default"])(v), key)


def preview_rule(rule: Rule, value: str, strategy: str = "mask", key: bytes | None = None) -> dict:
    out = apply_text(rule, strategy, value, key)
    return {"original": value, "masked": out, "changed": out != value, "strategy": strategy}
