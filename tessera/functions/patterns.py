"""Python patterns as Java ones."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def unanchored(pattern: str) -> str:
    """Without one leading ^ and one trailing $ (an escaped $ is kept)."""
    p = pattern.removeprefix("^")
    return p[:-1] if p.endswith("$") and not p.endswith(r"\$") else p


def to_java(pattern: str) -> str | None:
    """An equal Java pattern, or None where there is none: Unicode classes, Python's white space, Unix lines."""
    try:
        re.compile(pattern)
    except re.error:
        return None
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            d = pattern[i + 1]
            if d == "s":
                out.append(r"\s\x1c-\x1f" if inside else r"[\s\x1c-\x1f]")
            elif d == "S":
                if inside:
                    return None
                out.append(r"[^\s\x1c-\x1f]")
            elif d == "Z":
                out.append(r"\z")
            elif d in "wWbB":  # other classes of letters in Java
                return None
            else:
                out.append(c + d)
            i += 2
            continue
        if inside:
            if c == "]" and pattern[i - 1 : i] != "[" and pattern[i - 2 : i] != "[^":
                inside = False
                out.append(c)
            else:
                out.append("\\" + c if c in "[&~|]" else c)
        elif c == "[":
            inside = True
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 3
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append(rf"\k<{pattern[i + 4 : end]}>")
            i = end
        elif pattern.startswith("(?(", i):
            return None
        elif pattern.startswith("{,", i) and re.match(r"\{,\d+\}", pattern[i:]):
            out.append("{0")
        else:
            out.append(c)
        i += 1
    return "(?Ud)" + "".join(out)


def native(spark: SparkSession, pattern: str) -> str | None:
    """A Java pattern that Spark's split and extract treat as Python's sub treats this one; None if there is none,
    which includes patterns that match the empty string."""
    java = to_java(pattern)
    if java is None or re.search(pattern, "") or re.compile(pattern).fullmatch(""):
        return None
    try:
        spark._jvm.java.util.regex.Pattern.compile(java)
    except Exception:
        return None
    return java
