"""Normalizers as column expressions, equal to Python's string methods."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python strips it, for Java patterns with (?U).
SPACE = r"\s\x1c-\x1f"


def trim(v: Column) -> Column:
    return F.regexp_replace(v, rf"(?U)\A[{SPACE}]+|[{SPACE}]+\z", "")


@lru_cache
def folds() -> tuple[str, str, list[tuple[str, str]]]:
    """Case folding of single code points to one (two aligned strings) and to several."""
    one, many = [], []
    for i in (*range(0xD800), *range(0xE000, sys.maxunicode + 1)):
        c = chr(i)
        f = c.casefold()
        if f != c:
            (one if len(f) == 1 else many).append((c, f))
    # translate() goes by UTF-16 units in some versions; code points beyond the first plane are replaced one by one
    plain = [(c, f) for c, f in one if ord(c) < 0x10000 and ord(f) < 0x10000]
    return "".join(c for c, _ in plain), "".join(f for _, f in plain), many + [x for x in one if x not in set(plain)]


def casefold(v: Column) -> Column:
    """str.casefold without Python workers: a translation, with rarer foldings behind a test."""
    src, dst, many = folds()
    table = F.expr("array(" + ", ".join(f"named_struct('a', '{a}', 'b', '{b}')" for a, b in many) + ")")
    rare = F.aggregate(table, v, lambda acc, e: F.replace(acc, e["a"], e["b"]))
    wide = F.when(v.rlike("[" + "".join(a for a, _ in many) + "]"), rare).otherwise(v)
    return F.when(v.rlike(r"\A[\x00-\x7f一-鿿]*\z"), F.lower(v)).otherwise(F.translate(wide, src, dst))


def joined(v: Column) -> Column:
    """Without white space, dots, hyphens and dashes."""
    return F.regexp_replace(v, rf"(?U)[{SPACE}.\-–—]+", "")


def phone(v: Column) -> Column:
    return F.regexp_replace(trim(v), rf"(?U)[{SPACE}.\-–—()]+", "")


NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "trim": trim, "lower": casefold, "hyphen": joined, "default": lambda v: joined(casefold(trim(v))), "none": trim, "phone": phone, "upper": lambda v: F.upper(trim(v)),
}
_DASH = re.compile(r"[\s.\-–—]+")
_PHONE = re.compile(r"[\s.\-–—()]+")
TEXT: dict[str, Callable[[str], str]] = {
    "trim": str.strip, "lower": str.casefold, "hyphen": lambda v: _DASH.sub("", v), "default": lambda v: _DASH.sub("", v.strip().casefold()), "none": str.strip, "phone": lambda v: _PHONE.sub("", v.strip()), "upper": lambda v: v.strip().upper(),
}


def normalize(name: str, v: Column) -> Column:
    """By name; an unknown name is the default."""
    return NORMALIZERS.get(name, NORMALIZERS["default"])(v)


def trace(name: str, v: Column) -> Column:
    out = normalize(name, v)
    return F.struct(out.alias("value"), (out != v).alias("changed"))
