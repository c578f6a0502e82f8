"""Tables in files: CSV, JSON and workbooks (read and written with the standard library)."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _there(path: str) -> None:
    if "://" not in str(path) and not Path(path).exists():
        raise FileNotFoundError(f"no file {path}")


def read_csv(spark: SparkSession, path: str, encoding: str = "utf-8", infer_types: bool = False, multiline: bool = True, only: str | None = None) -> DataFrame:
    """All columns as text, so that 00123 stays; infer_types loses such zeros. Encodings that Spark's reader refuses
    (gbk, gb18030) are decoded from whole files. Where no cell holds a line break, multiline=False lets large files be
    split among tasks. only: a pattern of the file names to read of a folder and the folders in it."""
    _there(path)
    options = {"header": True, "quote": '"', "escape": '"', "inferSchema": False, "enforceSchema": False} | {"multiLine": multiline} | ({"pathGlobFilter": only, "recursiveFileLookup": True} if only else {})
    kind = {"utf8": "UTF-8", "utf-8": "UTF-8"}.get(encoding.lower(), encoding)
    if kind.upper() in ("UTF-8", "US-ASCII", "ISO-8859-1", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32"):
        df = spark.read.options(**options, encoding=kind).csv(path)
    else:
        import csv

        raw = spark.read.options(**({"pathGlobFilter": only, "recursiveFileLookup": True} if only else {})).format("binaryFile").load(path).orderBy("path").select("content").toLocalIterator()
        files = [rows for r in raw if (rows := list(csv.reader(io.StringIO(bytes(r.content).decode(encoding), newline=""))))]
        if not files:
            raise ValueError(f"no data in {path}")
        head = files[0][0]
        if any(rows[0] != head for rows in files):
            raise ValueError(f"files of different headers in {path}")
        df = spark.createDataFrame([tuple((r + [None] * len(head))[: len(head)]) for rows in files for r in ([c or None for c in r] for r in rows[1:])], ", ".join(f"`{h}` string" for h in head))
    if not df.columns or df.isEmpty():
        raise ValueError(f"no data in {path}")
    if infer_types:
        kinds = spark.read.options(**(options | {"inferSchema": True}), encoding=kind).csv(path).schema
        df = df.select(*(F.col(f"`{f.name}`").try_cast(f.dataType).cast("string").alias(f.name) for f in kinds))
    return df


#: Up to this size the content of a JSON file is looked at as a whole by the executors, many files at a time.
SMALL = 256 << 10


class Tokens:
    """Jackson's tokens of a file of any store, whatever its size: the driver's JVM reads it as a stream, and no further
    than it is asked to."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        raw = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
        try:
            text = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(raw, "UTF-8"))
            text.mark(1)
            if text.read() != 0xFEFF:
                text.reset()
            kinds = jvm.com.fasterxml.jackson.core
            self.tokens = kinds.JsonFactory().createParser(text)
            self.tokens.enable(getattr(kinds, "JsonParser$Feature").ALLOW_NON_NUMERIC_NUMBERS)
        except BaseException:
            raw.close()
            raise

    def __enter__(self) -> Tokens:
        return self

    def __exit__(self, *_) -> None:
        self.tokens.close()

    def next(self) -> str | None:
        got = self.tokens.nextToken()
        return got and got.name()

    def kind(self) -> str | None:
        """by_kind() of the file."""
        try:
            first = self.next()
            if first is None or first == "START_ARRAY":
                return first and "root"
            self.tokens.skipChildren()
            return "lines" if self.next() else "root"
        except Py4JJavaError as e:
            if "JsonProcessingException" not in _causes(e):
                raise
            return "lines"

    def names(self) -> list[str]:
        """The names in the first object, in a root array or by itself; none if it is not whole."""
        out = []
        try:
            first = self.next()
            if first == "START_ARRAY":
                first = self.next()
            while first == "START_OBJECT" and self.next() == "FIELD_NAME":
                out.append(self.tokens.currentName())
                self.next()
                self.tokens.skipChildren()
        except Py4JJavaError as e:
            if "JsonProcessingException" not in _causes(e):
                raise
            return []
        return list(dict.fromkeys(out))


def _causes(e: Py4JJavaError) -> list[str]:
    """Simple names of the class of a Java exception and of those above it."""
    kind, out = e.java_exception.getClass(), []
    while kind is not None:
        out.append(kind.getSimpleName())
        kind = kind.getSuperclass()
    return out


def by_kind(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """Paths of JSON files that one root value fills, and of those with a value on each line; blank files are in
    neither. Of large files no more is read than says so, and none of their content comes to Python."""

    @F.udf("string")
    def kind(content: bytes) -> str | None:
        import json

        text = bytes(content).decode("utf-8-sig", "replace").strip()
        if not text:
            return None
        if text[0] == "[":
            return "root"
        try:
            end = json.JSONDecoder().raw_decode(text)[1]
        except ValueError:
            return "lines"
        return "root" if end == len(text) else "lines"

    files = spark.read.format("binaryFile").load(path)
    found = {r.path: r.kind for r in files.where(F.col("length") <= SMALL).select("path", kind("content").alias("kind")).collect()}
    for r in files.where(F.col("length") > SMALL).select("path").collect():
        with Tokens(spark, r.path) as t:
            found[r.path] = t.kind()
    return tuple([p for p in sorted(found) if found[p] == k] for k in ("root", "lines"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Lines of objects, or for .json also one array or object over a whole file; every value as text, columns in the
    order in which the first object has them. Files of both kinds may lie in one folder."""
    _there(path)
    lines = str(path).lower().endswith((".jsonl", ".ndjson"))
    roots, by_line = ([], [path]) if lines else by_kind(spark, path)
    parts = [(multi, spark.read.options(primitivesAsString=True, multiLine=multi, mode="PERMISSIVE").json(p)) for multi, p in ((True, roots), (False, by_line)) if p]
    df = parts[0][1] if parts else spark.createDataFrame([], "_corrupt_record string")
    if len(parts) > 1:
        kinds = [dict(d.dtypes) for _, d in parts]
        mixed = {c for c in kinds[0] if kinds[0][c] != kinds[1].get(c, kinds[0][c])}
        df, other = (d.select(*((F.col(f"`{c}`") if k[c] == "string" or c not in mixed else F.to_json(F.col(f"`{c}`"))).alias(c) for c in d.columns)) for (_, d), k in zip(parts, kinds))
        df = df.unionByName(other, allowMissingColumns=True)
    if df.columns and df.columns != ["_corrupt_record"] and not df.isEmpty():
        import json

        if roots:
            with Tokens(spark, roots[0]) as t:
                first = t.names()
        else:
            head = spark.read.text(by_line).first().value
            try:
                first, _ = json.JSONDecoder().raw_decode(head.lstrip())
            except ValueError:
                first = []
        order = [c for c in first if c in df.columns]
        names = order + [c for c in df.columns if c not in order and c != "_corrupt_record"]
        kinds = dict(df.dtypes)
        return df.select(*((F.col(f"`{c}`") if kinds[c] == "string" else F.to_json(F.col(f"`{c}`"))).alias(c) for c in names))
    raise ValueError(f"no data in {path}")


def sheets_of(raw: bytes) -> Iterator[tuple[str, str, list[list[str]]]]:
    """(name, part, rows of text) of every sheet, cached values for formulas."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(MAIN + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        parts = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for s in ET.fromstring(z.read("xl/workbook.xml")).iter(MAIN + "sheet"):
            part = parts[s.get(REL)].lstrip("/")
            part = part if part.startswith("xl/") else "xl/" + part
            rows = []
            for r in ET.fromstring(z.read(part)).iter(MAIN + "row"):
                cells: dict[int, str] = {}
                for i, c in enumerate(r.iter(MAIN + "c")):
                    letters = re.match(r"[A-Z]+", c.get("r") or "")
                    at = sum((ord(x) - 64) * 26**k for k, x in enumerate(reversed(letters[0]))) - 1 if letters else i
                    value = c.findtext(MAIN + "v") or ""
                    if c.get("t") == "s":
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter(MAIN + "t"))
                    cells[at] = value
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            yield s.get("name"), part, rows


def header(row: list[str]) -> list[str]:
    return [h if h else f"col_{i}" for i, h in enumerate(row)]


def read_excel(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Sheet name -> table of text; sheets without rows below their header are left out."""
    _there(path)
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    out = {}
    for name, _, rows in sheets_of(raw):
        if len(rows) > 1:
            head = header(rows[0])
            out[name] = spark.createDataFrame([tuple((r + [""] * len(head))[: len(head)]) for r in rows[1:]], ", ".join(f"`{h}` string" for h in head))
    return out


def scan_excel(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells) of every row of many workbooks, read on the executors."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got = [(p, name, i, r) for name, _, rows in sheets_of(raw) for i, r in enumerate(rows)]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], t) for k, t in enumerate(kinds)], ["path", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "path string, sheet string, row long, cells array<string>")


def letters_of(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def sheet_xml(rows: list[list[str]]) -> bytes:
    body = "".join(f'<row r="{i}">' + "".join(f'<c r="{letters_of(j)}{i}" t="inlineStr"><is><t xml:space="preserve">{escape(v or "")}</t></is></c>' for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>'.encode()


def write_excel(source: str, target: str, tables: dict[str, DataFrame]) -> None:
    """A copy of a workbook with these sheets rewritten, the others as they were."""
    raw = Path(source).read_bytes()
    new = {}
    for name, part, _ in sheets_of(raw):
        if name in tables:
            new[part] = sheet_xml([tables[name].columns, *([*r] for r in tables[name].collect())])
    with zipfile.ZipFile(io.BytesIO(raw)) as z, zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for n in z.namelist():
            out.writestr(n, new.get(n) or z.read(n))


def new_excel(target: str, tables: dict[str, list[list[str]]]) -> None:
    """A new workbook of text cells."""
    names = list(tables)
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        out.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(names) + 1)) + "</Types>")
        out.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        out.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        out.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            out.writestr(f"xl/worksheets/sheet{i}.xml", sheet_xml(tables[n]))


def write_folder(df: DataFrame, path: str, kind: str) -> None:
    """The distributed sink: a folder of part files."""
    w = df.write.mode("overwrite")
    w.option("header", True).option("escape", '"').csv(path) if kind == "csv" else w.option("ignoreNullFields", False).json(path)


def write_single(df: DataFrame, path: str, kind: str) -> None:
    """One file in the order of the rows: parts are written in parallel to a folder that the executors share with the
    driver (in spark.checkpoint.dir, or beside the target where that is unset) and put together. Rows without parts to
    be seen here are an error, not an empty file."""
    spark, target = df.sparkSession, Path(path.removeprefix("file://"))
    target.parent.mkdir(parents=True, exist_ok=True)
    shared = spark.conf.get("spark.checkpoint.dir", None)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/') if shared else target.parent.resolve().as_uri()}/tessera-{uuid.uuid4().hex}")
    fs, seen = folder.getFileSystem(conf), Observation()
    try:
        w = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
        w.option("header", False).option("escape", '"').csv(folder.toString()) if kind == "csv" else w.option("ignoreNullFields", False).json(folder.toString())
        parts = sorted((p for p in fs.listStatus(folder) if p.getPath().getName().startswith("part-")), key=lambda p: p.getPath().getName())
        if seen.get["rows"] and not any(p.getLen() for p in parts):
            raise OSError(f"the driver sees no parts in {folder.toString()}; set spark.checkpoint.dir to a shared folder")
        out = jvm.java.io.FileOutputStream(str(target.resolve()))
        try:
            if kind == "csv":
                import csv

                head = io.StringIO()
                csv.writer(head, lineterminator="\n").writerow(df.columns)
                out.write(head.getvalue().encode())
            for p in parts:
                part = fs.open(p.getPath())
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, conf, False)
                finally:
                    part.close()
        finally:
            out.close()
    finally:
        fs.delete(folder, True)


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a person list: the first column with a name heading, stripped, without blanks and repeats."""
    from ..functions.normalize import trim
    from ..functions.people import NAME_COLUMNS

    _there(path)
    df = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(path)
    if not df.columns:
        raise ValueError(f"no header in {path}")
    column = next((c for c in df.columns if c.strip().lower() in NAME_COLUMNS), None)
    if column is None:
        raise ValueError(f"no name column in {path}; it has {', '.join(df.columns)}")
    out = df.select(trim(F.col(f"`{column}`")).alias("name")).where("name <> ''").distinct()
    if out.isEmpty():
        raise ValueError(f"no names in {path}")
    return out


# The pools of demonstration data.
DEMO_DOMAINS = ["corp.example", "company.cn", "gmail.com", "outlook.com", "internal.local"]
DEMO_PREFIXES = ["EID", "EMP", "ACCT"]


def demo_data(spark: SparkSession, rows: int = 100_000, seed: int = 42) -> DataFrame:
    """Eight columns of deterministic sensitive values; names, companies, domains and prefixes by a seeded hash."""
    from ..functions.people import KNOWN_COMPANIES, KNOWN_NAMES

    i, h = F.col("id"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    pick = lambda pool: F.element_at(F.array(*map(F.lit, pool)), (F.pmod(h, F.lit(len(pool))) + 1).cast("int"))
    s = lambda x: x.cast("string")
    return spark.range(rows).select(
        pick(KNOWN_NAMES).alias("name"), F.concat(F.lit("user"), s(i), F.lit("@"), pick(DEMO_DOMAINS)).alias("email"),
        F.concat_ws(".", F.lit("10"), s(i % 256), s((i / 256).cast("long") % 256), s((i / 65536).cast("long") % 256)).alias("ip"),
        F.concat(F.lit("138"), F.lpad(s((i + 10_000_000) % 100_000_000), 8, "0")).alias("phone"), F.concat(pick(DEMO_PREFIXES), F.lit("-"), s(1000 + i % 9000)).alias("employee_id"),
        F.concat(F.lit("u"), s(i), F.lit("_audit")).alias("account"), pick(KNOWN_COMPANIES).alias("company"),
        F.concat(F.lit("v"), s(1 + i % 5), F.lit("."), s(i % 10), F.lit("."), s(i * 7 % 20)).alias("app_version"),
    )
