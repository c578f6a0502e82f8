"""Column masking, pseudonymisation and whole-value detection as one projection."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.crypto import pseudonym_key
from ..functions.normalize import trim
from ..functions.patterns import to_java
from ..functions.people import is_person_name
from ..functions.template import apply_rule, needs_key
from ..rules import VALUE_RULES, Rule, RuleSet, Spec, effective_specs
from .stats import MaskStats

IN_LIST = 10_000


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quote(name))


@dataclass
class Masked:
    """A masked table. work: its columns and, behind them, a counter column for each changed cell."""

    work: DataFrame
    columns: list[str]
    counters: list[str]
    specs: list[Spec] = field(default_factory=list)

    @property
    def frame(self) -> DataFrame:
        return self.work.select(*map(col, self.columns))

    def counts(self) -> Column:
        return sum((F.coalesce(F.col(c), F.lit(0)) for c in self.counters), F.lit(0)).cast("long")

    def observed(self) -> tuple[DataFrame, Observation]:
        """The frame, and an observation that holds its `rows` and changed cells `n` once it has been written."""
        seen = Observation()
        work = self.work.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(self.counts()), F.lit(0)).alias("n"))
        return work.select(*map(col, self.columns)), seen

    def count(self) -> int:
        return self.work.agg(F.coalesce(F.sum(self.counts()), F.lit(0)).alias("n")).first().n

    def stats(self) -> MaskStats:
        r = self.work.agg(F.count("*").alias("rows"), F.coalesce(F.sum(self.counts()), F.lit(0)).alias("n")).first()
        return MaskStats(r.rows, r.n, 1)


def compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def value_rules(rules: RuleSet) -> list[tuple[Rule, str | None]]:
    """Rules of whole-value detection with their Java patterns (None where there is none), the longest pattern first;
    those that Python cannot compile are left out."""
    out = [(r, to_java(r.match)) for r in rules.rules.values() if r.name in VALUE_RULES and r.in_text and not r.disabled]
    return sorted(((r, p) for r, p in out if p or compiles(r.match)), key=lambda x: -len(x[0].match))


def by_python(v: Column, pattern: str) -> Column:
    """Whether a value matches as a whole a pattern without a Java form: Python's fullmatch in Arrow batches."""
    regex = re.compile(pattern)

    @F.pandas_udf("boolean")
    def whole(s: pd.Series) -> pd.Series:
        return pd.Series([t is not None and regex.fullmatch(t) is not None for t in s], dtype=bool)

    return whole(v)


def value_rule(v: Column, rules: RuleSet, listed: Column | None = None) -> Column:
    """Name of the rule that a stripped value matches as a whole, or null. listed: whether it is on the person list."""
    name = rules.rules.get("name")
    out = F.lit(None).cast("string")
    if name:
        person = is_person_name(v) if listed is None else listed | is_person_name(v)
        out = F.when(person, F.lit(name.name))
    for r, p in reversed(value_rules(rules)):
        whole = v.rlike(rf"(?Ud)\A(?:{p.removeprefix('(?Ud)')})\z") if p else by_python(v, r.match)
        out = F.when(whole, F.lit(r.name)).otherwise(out)
    return F.when((v != "") & ~v.startswith("="), out)


def on_list(v: Column, people: Iterable[str] | None) -> Column | None:
    names = sorted({p for p in people or () if p})
    return v.isin(names) if names else None


def own_prefix(columns: list[str]) -> str:
    """What no column of a table begins with, whatever its case."""
    out = "_"
    while any(c.lower().startswith(out) for c in columns):
        out += "_"
    return out


def with_people(df: DataFrame, names: list[str], people: DataFrame, own: str) -> tuple[DataFrame, dict[str, str]]:
    """Flags for a long person list: a left join for each column on its stripped value, by broadcast or shuffle as
    Spark sees the list's size."""
    flags = {}
    listed = people.select(trim(F.col(people.columns[0])).alias("_person")).where("_person <> ''").distinct()
    for i, n in enumerate(names):
        flags[n] = f"{own}listed_{i}"
        side = listed.select(F.col("_person").alias(f"{own}p{i}"), F.lit(True).alias(flags[n]))
        df = df.join(side, trim(col(n)) == F.col(f"{own}p{i}"), "left").drop(f"{own}p{i}")
    return df, flags


def apply_rules(df: DataFrame, rules: RuleSet, pepper: str | None = None, value_scan: bool = True, people: Iterable[str] | DataFrame | None = None, stringify: bool = False) -> Masked:
    """Mask or pseudonymise the mapped columns, then scan the others for whole sensitive values.

    A mapped column's non-empty values all go through its rule, whether or not they match it; null and empty stay.
    A scanned value that matches is masked without its outer blanks; a blank one becomes empty and is not counted; any
    other stays as it is. A column mapped twice is changed twice. Masked columns become strings; other columns keep
    their type and are scanned if they are strings; stringify makes every column a string and scans all.
    """
    key = pseudonym_key(pepper) if pepper else None
    columns, counters = df.columns, []
    own = own_prefix(columns)
    for s in rules.specs:
        if s.column not in columns:
            raise ValueError(f"no column {s.column!r}")
        rule = rules.rules.get(s.rule)
        if rule is None:
            raise ValueError(f"no rule {s.rule!r}")
        if rule.disabled:
            raise ValueError(f"rule {s.rule!r} is off by default; define it to use it")
        apply_rule(rule, s.strategy, F.lit("x"), key)  # raises what is wrong now, not when rows are read
    if stringify:
        df = df.select(*(col(c).cast("string").alias(c) for c in columns))
    rest = list(rules.specs)
    while rest:
        now: dict[str, Spec] = {}
        later = []
        for s in rest:
            (later.append(s) if s.column in now else now.update({s.column: s}))
        text = {c: col(c).cast("string") for c in now}
        out = {c: apply_rule(rules.rules[s.rule], s.strategy, text[c], key) for c, s in now.items()}
        marks = {f"{own}changed_{len(counters) + i}": (out[c] != text[c]).cast("int") for i, c in enumerate(now)}
        df = df.select(*((out[c].alias(c) if c in out else col(c)) for c in columns), *map(F.col, counters), *(x.alias(m) for m, x in marks.items()))
        counters += marks
        rest = later
    mapped = {s.column for s in rules.specs}
    open_ = [c for c, t in df.dtypes if c in columns and c not in mapped and t == "string"] if value_scan else []
    if open_ and (value_rules(rules) or "name" in rules.rules):
        flags: dict[str, str] = {}
        if isinstance(people, DataFrame):
            df, flags = with_people(df, open_, people, own)
        elif people is not None and len(people := set(people)) > IN_LIST:
            df, flags = with_people(df, open_, df.sparkSession.createDataFrame([(p,) for p in people], "name string"), own)
        names = {c: f"{own}trim_{i}" for i, c in enumerate(open_)}
        # stripped values and rules are columns of their own, so that no expression is written out several times
        df = df.select("*", *(trim(col(c)).alias(names[c]) for c in open_))
        found = {c: f"{own}rule_{i}" for i, c in enumerate(open_)}
        listed = {c: (F.coalesce(F.col(flags[c]), F.lit(False)) if flags else on_list(F.col(names[c]), people)) for c in open_}
        df = df.select("*", *(value_rule(F.col(names[c]), rules, listed[c]).alias(found[c]) for c in open_))
        out = {}
        for c in open_:
            v = F.col(names[c])
            hit = v
            for r in {**{r.name: r for r, _ in value_rules(rules)}, **({"name": rules.rules["name"]} if "name" in rules.rules else {})}.values():
                if not needs_key(r.mask) or key is not None:
                    hit = F.when(F.col(found[c]) == r.name, apply_rule(r, "mask", v, key)).otherwise(hit)
            out[c] = F.when(v == "", F.lit("")).when(F.col(found[c]).isNotNull(), hit).otherwise(col(c))
        marks = {f"{own}changed_{len(counters) + i}": (F.col(found[c]).isNotNull() & (out[c] != F.col(names[c]))).cast("int") for i, c in enumerate(open_)}
        df = df.select(*((out[c].alias(c) if c in out else col(c)) for c in columns), *map(F.col, counters), *(x.alias(m) for m, x in marks.items()))
        counters += marks
    return Masked(df, columns, counters, list(rules.specs))


def mask_table(df: DataFrame, rules: RuleSet, pepper: str | None = None, value_scan: bool = True, people: Iterable[str] | DataFrame | None = None, stringify: bool = False) -> Masked:
    """apply_rules() with the specs that hold for these columns: optional ones may lack, and if none is left columns
    are matched by name."""
    return apply_rules(df, RuleSet(rules.rules, tuple(effective_specs(df.columns, rules))), pepper, value_scan, people, stringify)
