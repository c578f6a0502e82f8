"""Dry run: what masking would do to each column, in one aggregation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import pseudonym_key
from ..functions.normalize import trim
from ..functions.template import apply_rule, needs_key
from ..rules import RuleSet, effective_specs
from .masking import col, on_list, value_rule, value_rules

FIELDS = "column string, rule string, strategy string, hits long, total long, ratio double, sample_before string, sample_after string"


def preview(df: DataFrame, rules: RuleSet, pepper: str | None = None, people: Iterable[str] | None = None) -> list[dict]:
    """For each column: rule, strategy, cells that would change, cells that are not null, their ratio, and the first
    changed cell before and after. A rule that is off is not refused here, and of a column's specs the last counts."""
    key = pseudonym_key(pepper) if pepper else None
    specs = {s.column: s for s in effective_specs(df.columns, rules)}
    for s in specs.values():
        if s.rule not in rules.rules:
            raise ValueError(f"no rule {s.rule!r}")
    columns = df.columns
    rows = df.select(F.monotonically_increasing_id().alias("_at"), *(col(c).cast("string").alias(f"_v{i}") for i, c in enumerate(columns)))
    rows = rows.select("*", *((F.col(f"_v{i}") if c in specs else trim(F.col(f"_v{i}"))).alias(f"_b{i}") for i, c in enumerate(columns)))
    rows = rows.select("*", *((F.lit(specs[c].rule) if c in specs else value_rule(F.col(f"_b{i}"), rules, on_list(F.col(f"_b{i}"), people))).alias(f"_r{i}") for i, c in enumerate(columns)))
    scanned = {r.name: r for r, _ in value_rules(rules)} | ({"name": rules.rules["name"]} if "name" in rules.rules else {})
    after = []
    for i, c in enumerate(columns):
        v = F.col(f"_b{i}")
        if c in specs:
            after.append(apply_rule(rules.rules[specs[c].rule], specs[c].strategy, v, key))
            continue
        out = v
        for r in scanned.values():
            if not needs_key(r.mask) or key is not None:
                out = F.when(F.col(f"_r{i}") == r.name, apply_rule(r, "mask", v, key)).otherwise(out)
        after.append(out)
    rows = rows.select("*", *(a.alias(f"_a{i}") for i, a in enumerate(after)))
    sums = []
    for i, c in enumerate(columns):
        changed = F.col(f"_v{i}").isNotNull() & F.col(f"_r{i}").isNotNull() & (F.col(f"_a{i}") != F.col(f"_b{i}"))
        hit = F.col(f"_v{i}").isNotNull() & F.col(f"_r{i}").isNotNull()
        sums.append(
            F.struct(
                F.count(f"_v{i}").alias("total"), F.coalesce(F.sum(changed.cast("long")), F.lit(0)).alias("hits"),
                F.min_by(F.struct(F.col(f"_b{i}").alias("before"), F.col(f"_a{i}").alias("after")), F.when(changed, F.col("_at"))).alias("sample"),
                F.min_by(f"_r{i}", F.when(hit, F.col("_at"))).alias("rule"),
            ).alias(f"c{i}")
        )
    got = rows.agg(*sums).first() if columns else []
    out = []
    for c, r in zip(columns, got):
        out.append({"column": c, "rule": r.rule, "strategy": (specs[c].strategy if c in specs else "mask") if r.rule else None, "hits": r.hits, "total": r.total, "ratio": round(r.hits / r.total, 3) if r.total else 0.0, "sample_before": r.sample and r.sample.before, "sample_after": r.sample and r.sample.after})
    return out


def preview_frame(df: DataFrame, rules: RuleSet, pepper: str | None = None, people: Iterable[str] | None = None) -> DataFrame:
    """preview() as a table of one row a column."""
    return df.sparkSession.createDataFrame([tuple(r.values()) for r in preview(df, rules, pepper, people)], FIELDS)
