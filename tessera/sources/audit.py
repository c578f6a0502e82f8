"""Audit log: one JSON line a run, with rule versions and key marks but never secrets."""

from __future__ import annotations

import json
import os
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crypto import fingerprint
from ..rules import RuleSet

FIELDS = "ts string, input_file string, output_file string, ruleset_version string, rows long, mask_columns array<string>, pseudo_columns array<string>, pepper_fingerprint string"


def log_path() -> Path:
    return Path(os.environ.get("TESSERA_AUDIT_LOG") or Path.home() / ".tessera" / "audit.jsonl")


def log_run(source: str, target: str, rules: RuleSet, rows: int, pepper: str | None = None, path: str | Path | None = None) -> dict:
    entry = {
        "ts": datetime.now(UTC).isoformat(), "input_file": str(source), "output_file": str(target), "ruleset_version": rules.version, "rows": rows,
        "mask_columns": [s.column for s in rules.specs if s.strategy == "mask"], "pseudo_columns": [s.column for s in rules.specs if s.strategy == "pseudo"], "pepper_fingerprint": fingerprint(pepper),
    }
    path = Path(path or log_path())
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a", encoding="utf-8") as f:
        f.write(json.dumps(entry, ensure_ascii=False) + "\n")
    return entry


def read_log(limit: int = 50, path: str | Path | None = None) -> list[dict]:
    """The last lines that are JSON; 0 is all of them."""
    path = Path(path or log_path())
    if not path.exists():
        return []
    out = []
    for line in path.read_text("utf-8").splitlines()[-limit:]:
        try:
            out.append(json.loads(line))
        except ValueError:
            continue
    return out


def scan_log(spark: SparkSession, path: str, limit: int = 50) -> DataFrame:
    """The same as a table, the newest first; for logs of any size."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.from_json("value", FIELDS).alias("r"), "value")
    newest = lines.orderBy(F.desc("at"))
    newest = newest.limit(limit) if limit else newest
    return newest.where(F.col("r").isNotNull() & F.col("r.ts").isNotNull()).select("at", "r.*").orderBy(F.desc("at")).drop("at")
