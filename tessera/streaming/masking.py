"""The same masking on streams: expressions without state, so no watermark and no checkpointed state are needed."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.masking import mask_table
from ..operators.text import mask_text
from ..rules import RuleSet


def mask_stream(df: DataFrame, rules: RuleSet, pepper: str | None = None, text_columns: Iterable[str] = (), people: Iterable[str] | None = None) -> DataFrame:
    """A streaming table masked like a static one; cells changed are observed as `masking` (rows, changed)."""
    m = mask_table(df, rules, pepper, people=people)
    out = m.work.observe("masking", F.count(F.lit(1)).alias("rows"), F.sum(m.counts()).alias("changed")).select(*(f"`{c}`" for c in m.columns))
    for c in text_columns:
        out = mask_text(out, c, rules, pepper)
    return out


def write_stream(df: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    w = df.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start(path)
