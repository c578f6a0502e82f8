"""Files in, masked files out: discovery, names, dispatch by extension."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from ..operators.masking import mask_table
from ..operators.preview import preview
from ..operators.stats import MaskStats
from ..operators.text import mask_text_value
from ..rules import RuleSet, default_rules
from ..sources import documents, tables

TABLES = (".csv", ".xlsx", ".xls", ".json", ".jsonl", ".ndjson")
DOCUMENTS = tuple(documents.MASKERS)
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tiff")
SAMPLE = 500


@dataclass
class Result:
    rows: int
    stats: MaskStats = field(default_factory=MaskStats)
    sheets: dict[str, int] = field(default_factory=dict)


def discover(path: str | Path, kinds: Iterable[str] = TABLES + DOCUMENTS) -> list[Path]:
    """A file itself, or the files of these kinds below a folder, sorted."""
    p, kinds = Path(path), {k.lower() for k in kinds}
    if p.is_file():
        return [p]
    if p.is_dir():
        return sorted(f for f in p.rglob("*") if f.is_file() and f.suffix.lower() in kinds)
    raise FileNotFoundError(f"no file or folder {p}")


def validate(paths: Iterable[str | Path], kinds: Iterable[str] = TABLES + DOCUMENTS) -> tuple[list[Path], list[dict]]:
    good, bad, kinds = [], [], {k.lower() for k in kinds}
    for p in paths:
        try:
            found = discover(p, kinds)
        except FileNotFoundError:
            bad.append({"path": str(p), "reason": "missing"})
            continue
        if not found:
            bad.append({"path": str(p), "reason": "no supported file"})
        for f in found:
            good.append(f) if f.suffix.lower() in kinds else bad.append({"path": str(f), "reason": f"unsupported kind {f.suffix}"})
    return good, bad


def output_path(source: str | Path, folder: str | Path | None = None, dotted: bool = False) -> Path:
    """stem_masked.ext, or stem.masked.ext, beside the source or in a folder."""
    s = Path(source)
    to = Path(folder) if folder else s.parent
    to.mkdir(parents=True, exist_ok=True)
    return to / f"{s.stem}{'.' if dotted else '_'}masked{s.suffix}"


def mask_path(spark: SparkSession, source: str, target: str, rules: RuleSet | None = None, pepper: str | None = None, strategy: str = "mask", scan_names: bool = False, people: Iterable[str] | None = None, encoding: str = "utf-8", images: bool = False) -> Result:
    """Mask one file by its extension. strategy is for text; tables go by their mapping. Missing files are
    FileNotFoundError, whatever else is wrong with input or rules is ValueError."""
    rules = rules or default_rules()
    if not Path(source).exists():
        raise FileNotFoundError(f"no file {source}")
    kind = Path(source).suffix.lower()
    if kind in (".csv", ".json", ".jsonl", ".ndjson"):
        df = tables.read_csv(spark, str(source), encoding) if kind == ".csv" else tables.read_json(spark, str(source))
        m = mask_table(df, rules, pepper, people=people)
        frame, seen = m.observed()
        tables.write_single(frame, str(target), "csv" if kind == ".csv" else "json")
        stats = MaskStats(seen.get["rows"], seen.get["n"], 1)
        return Result(stats.processed, stats)
    if kind in (".xlsx", ".xls"):
        done, stats, rows = {}, MaskStats(), {}
        for name, df in tables.read_excel(spark, str(source)).items():
            m = mask_table(df, rules, pepper, people=people)
            done[name], s = m.frame, m.stats()
            rows[name], stats = s.processed, stats + s
        tables.write_excel(str(source), str(target), done)
        return Result(sum(rows.values()), stats, rows)
    if kind in documents.MASKERS:
        people = set(people) if people is not None else None
        texts = changed = 0

        def masked(text: str) -> str:
            nonlocal texts, changed
            new = mask_text_value(text, rules, pepper, strategy, scan_names, people)
            texts, changed = texts + 1, changed + (new != text)
            return new

        data, n = documents.MASKERS[kind](Path(source).read_bytes(), masked)
        Path(target).parent.mkdir(parents=True, exist_ok=True)
        Path(target).write_bytes(data)
        return Result(n, MaskStats(texts, changed, 1))
    if kind in IMAGES:
        raise ValueError("images need recognised words; see sources.documents.sensitive_band" if images else "images are beta: pass images=True")
    raise ValueError(f"no way to mask {kind or 'files without extension'}")


def mask_folder(spark: SparkSession, source: str, target: str, rules: RuleSet | None = None, pepper: str | None = None, people: Iterable[str] | None = None, encoding: str = "utf-8", multiline: bool = True) -> Result:
    """Mask all CSV files of a folder (and of folders in it), which have one header, in one job to a folder of part
    files; the plan runs once and no row passes through the driver. Paths are of any store that Spark reaches. Files
    of another header, and a folder without rows, are a ValueError or Spark's own error; a target that is the source
    is refused."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("a folder cannot be masked onto itself")
    m = mask_table(tables.read_csv(spark, source, encoding, multiline=multiline, only="*.csv"), rules or default_rules(), pepper, people=people)
    frame, seen = m.observed()
    tables.write_folder(frame, target, "csv")
    stats = MaskStats(seen.get["rows"], seen.get["n"], 0)
    return Result(stats.processed, stats)


def preview_path(spark: SparkSession, source: str, rules: RuleSet | None = None, pepper: str | None = None, people: Iterable[str] | None = None, encoding: str = "utf-8") -> dict:
    """Dry run over the first 500 rows of each table of a file: {columns, total_hits, total_cells}."""
    rules = rules or default_rules()
    if not Path(source).exists():
        raise FileNotFoundError(f"no file {source}")
    kind = Path(source).suffix.lower()
    if kind not in TABLES:
        raise ValueError(f"no preview of {kind}")
    try:
        if kind == ".csv":
            frames = {"": tables.read_csv(spark, str(source), encoding)}
        else:
            frames = tables.read_excel(spark, str(source)) if kind in (".xlsx", ".xls") else {"": tables.read_json(spark, str(source))}
    except ValueError as e:
        if "no data" not in str(e):
            raise
        frames = {}
    columns = [{**c, "sheet": name} for name, df in frames.items() for c in preview(df.limit(SAMPLE), rules, pepper, people)]
    return {"columns": columns, "total_hits": sum(c["hits"] for c in columns), "total_cells": sum(c["total"] for c in columns)}
