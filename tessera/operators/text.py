"""Scan and replace in free text: rules one after another, each on what the one before left."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import pseudonym_key
from ..functions.patterns import native, unanchored
from ..functions.people import company_names, person_names
from ..functions.template import apply_rule, apply_text
from ..rules import Rule, RuleSet


def replace_matches(t: Column, java: str, done) -> Column:
    """Every match of a pattern replaced by an expression of it; rows without a match are left alone."""
    parts, found = F.split(t, java, -1), F.regexp_extract_all(t, F.lit(java), F.lit(0))
    new = F.array_join(F.zip_with(parts, F.transform(found, done), lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
    return F.when(t.rlike(java), new).otherwise(t)


def renderer(rule: Rule, strategy: str, key: bytes | None):
    return lambda m: apply_rule(rule, strategy, m, key)


def by_python(rule: Rule, strategy: str, key: bytes | None):
    """The same for a pattern without a Java form: Python's sub in Arrow batches."""
    regex = re.compile(unanchored(rule.match))

    @F.pandas_udf("string")
    def sub(s: pd.Series) -> pd.Series:
        return s.map(lambda t: regex.sub(lambda m: apply_text(rule, strategy, m[0], key), t), na_action="ignore")

    return sub


def replace_names(t: Column, names: Column, rule: Rule, strategy: str, key: bytes | None) -> Column:
    return F.aggregate(names, t, lambda acc, n: F.replace(acc, n, apply_rule(rule, strategy, n, key)))


def mask_text(df: DataFrame, column: str, rules: RuleSet, pepper: str | None = None, strategy: str = "mask", scan_names: bool = False, people: Iterable[str] | None = None, into: str | None = None) -> DataFrame:
    """df with the text column masked (or its masked form in `into`). Null and empty texts stay, and so does every
    text if no rule is for text. Each rule is a projection of its own, since its expression uses the text twice."""
    key = pseudonym_key(pepper) if pepper else None
    if strategy == "pseudo" and key is None:
        raise ValueError("a pepper is needed to pseudonymise")
    into = into or column
    df = df.withColumn(into, F.col(column).cast("string"))
    active = rules.text_rules()
    for r in active:
        java = native(df.sparkSession, unanchored(r.match))
        if java:
            df = df.withColumn(into, replace_matches(F.col(into), java, renderer(r, strategy, key)))
        else:
            df = df.withColumn(into, by_python(r, strategy, key)(F.col(into)))
    if active and scan_names:
        if name := rules.rules.get("name"):
            df = df.withColumn(into, replace_names(F.col(into), person_names(F.col(into), people), name, strategy, key))
        if company := rules.rules.get("company"):
            df = df.withColumn(into, replace_names(F.col(into), company_names(F.col(into)), company, strategy, key))
    return df


def held_by_python(rule: Rule):
    regex = re.compile(unanchored(rule.match))

    @F.pandas_udf("boolean")
    def held(s: pd.Series) -> pd.Series:
        return pd.Series([t is not None and any(m[0] for m in regex.finditer(t)) for t in s], dtype=bool)

    return held


def sensitive(t: Column, rules: RuleSet, spark) -> Column:
    """Whether a text holds a match of any text rule. Rules without a Java form are searched by Python in Arrow batches,
    which Spark refuses inside a lambda of a higher-order function."""
    out = F.lit(False)
    for r in rules.text_rules():
        if java := native(spark, unanchored(r.match)):
            out = out | t.rlike(java)
        else:
            out = out | held_by_python(r)(t)
    return out


def mask_text_value(text: str, rules: RuleSet, pepper: str | None = None, strategy: str = "mask", scan_names: bool = False, people: Iterable[str] | None = None) -> str:
    """mask_text() of one Python string, for document parts that are rewritten where they lie."""
    from ..functions import people as P

    if not text:
        return text
    key = pseudonym_key(pepper) if pepper else None
    if strategy == "pseudo" and key is None:
        raise ValueError("a pepper is needed to pseudonymise")
    active = rules.text_rules()
    for r in active:
        text = re.sub(unanchored(r.match), lambda m, r=r: apply_text(r, strategy, m[0], key), text)
    if not active or not scan_names:
        return text
    if name := rules.rules.get("name"):
        gap = r"\s*[：:]\s*"
        found = [m[1] for m in re.finditer(f"(?:{'|'.join(P.PERSON_PREFIXES)}){gap}([{P.HAN}]{{2,4}})", text)]
        found += [w for w in P.by_length(P.KNOWN_NAMES) if re.search(f"(?<![{P.HAN}]){re.escape(w)}(?![{P.HAN}])", text)]
        found += [w for w in P.by_length({p for p in people or () if p} - set(P.KNOWN_NAMES)) if w in text]
        for w in dict.fromkeys(found):
            text = text.replace(w, apply_text(name, strategy, w, key))
    if company := rules.rules.get("company"):
        found = [m[1].strip() for m in re.finditer(rf"(?:{'|'.join(P.COMPANY_PREFIXES)})\s*[：:]\s*([{P.HAN}A-Za-z0-9&.,·\-\s]{{2,30}})", text)]
        found += [w for w in P.by_length(P.KNOWN_COMPANIES) if w in text]
        for w in dict.fromkeys(filter(None, found)):
            text = text.replace(w, apply_text(company, strategy, w, key))
    return text
