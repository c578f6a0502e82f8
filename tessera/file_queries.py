"""Registered queries that go through files and streams: tables are written by the engine's sinks, read by its sources
and masked, and the same rows are said in DuckDB's SQL over the tables themselves."""

from __future__ import annotations

import dataclasses
import tempfile
import uuid
import zipfile
from email.message import EmailMessage
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.normalize import trace
from .operators.masking import apply_rules, mask_table
from .operators.text import mask_text
from .plans.files import mask_folder
from .queries import MIXED, NAMING, PEOPLE, RULED, K, S, mask_sql, people, query, table
from .rules import BUILTIN, RuleSet, default_rules
from .sources.documents import read_units
from .sources.tables import new_excel, read_csv, read_excel, read_json, read_people, scan_excel, write_excel, write_folder, write_single
from .streaming.masking import mask_stream, write_stream

CUSTOMERS = f"(SELECT {PEOPLE} FROM customer)"
MASKED = f"SELECT {{}} AS k, {', '.join(f'{mask_sql(r, r)} AS {r}' for r in RULED)} FROM {CUSTOMERS}"
TEXT = MASKED.format("CAST(k AS VARCHAR)")


def work(spark: SparkSession) -> str:
    """A new folder where driver and executors both can write: in spark.checkpoint.dir, or a temporary one where that is
    unset (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/tessera/{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tessera-")


def local(spark: SparkSession) -> Path:
    """work() for what the driver writes itself."""
    path = Path(work(spark).removeprefix("file://").removeprefix("file:"))
    path.mkdir(parents=True, exist_ok=True)
    return path


@query("csv_mask_round_trip", TEXT)
def csv_mask_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to CSV, read as text, masked, to CSV again and read."""
    at = work(spark)
    write_folder(people(spark, sf_dir), f"{at}/in.csv", "csv")
    write_folder(mask_table(read_csv(spark, f"{at}/in.csv"), default_rules()).frame, f"{at}/out.csv", "csv")
    return read_csv(spark, f"{at}/out.csv")


@query("csv_folder_mask", TEXT)
def csv_folder_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of folders of CSV files masked in one job, split among tasks."""
    at = work(spark)
    for i, part in enumerate(people(spark, sf_dir).randomSplit([1.0, 1.0], 7)):
        write_folder(part, f"{at}/in/{i}", "csv")
    mask_folder(spark, f"{at}/in", f"{at}/out", multiline=False)
    return read_csv(spark, f"{at}/out")


@query("json_mask_round_trip", TEXT)
def json_mask_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = work(spark)
    write_folder(people(spark, sf_dir), f"{at}/in.jsonl", "json")
    write_folder(mask_table(read_json(spark, f"{at}/in.jsonl"), default_rules()).frame, f"{at}/out.jsonl", "json")
    return read_json(spark, f"{at}/out.jsonl")


def _single(kind: str, read):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        target = local(spark) / f"one.{kind}"
        write_single(people(spark, sf_dir).repartition(4), str(target), kind)
        return read(spark, f"file://{target}")

    return run


PLAIN = f"SELECT CAST(k AS VARCHAR) AS k, {', '.join(RULED)} FROM {CUSTOMERS}"
query("csv_single_file", PLAIN)(_single("csv", read_csv))
query("json_single_file", PLAIN)(_single("json", read_json))


@query("csv_person_list", "SELECT DISTINCT trim(c_name) AS name FROM customer")
def csv_person_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person list from a CSV file with repeats and outer blanks."""
    at = f"{work(spark)}/people.csv"
    names = table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), "c_name", F.lit(" ")).alias("name"), F.col("c_custkey").alias("id"))
    write_folder(names.unionByName(names), at, "csv")
    return read_people(spark, at)


def _nations(spark: SparkSession, sf_dir: str) -> list:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name").orderBy("n_nationkey").collect()


@query("excel_scan", "SELECT 'nation' AS sheet, row_number() OVER (ORDER BY CAST(n_nationkey AS VARCHAR))::BIGINT AS row, CAST(n_nationkey AS VARCHAR) AS a, n_name AS b FROM nation UNION ALL SELECT 'region', row_number() OVER (ORDER BY CAST(r_regionkey AS VARCHAR))::BIGINT, CAST(r_regionkey AS VARCHAR), r_name FROM region")
def excel_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row below the header of a workbook of two sheets, read on the executors."""
    at = local(spark) / "two.xlsx"
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("k"), "r_name").orderBy("k").collect()
    new_excel(str(at), {"nation": [["key", "name"], *([*r] for r in _nations(spark, sf_dir))], "region": [["key", "name"], *([*r] for r in regions)]})
    return scan_excel(spark, f"file://{at}").where("row > 0").select("sheet", "row", F.col("cells")[0].alias("a"), F.col("cells")[1].alias("b"))


@query("excel_mask_round_trip", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, left(n_name, 1) || '*' AS n_name FROM nation")
def excel_mask_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = local(spark)
    new_excel(f"{at}/in.xlsx", {"nation": [["n_nationkey", "n_name"], *([*r] for r in _nations(spark, sf_dir))]})
    write_excel(f"{at}/in.xlsx", f"{at}/out.xlsx", {"nation": mask_table(read_excel(spark, f"{at}/in.xlsx")["nation"], default_rules()).frame})
    return read_excel(spark, f"{at}/out.xlsx")["nation"]


@query("mail_units_masked", "SELECT CAST(n_nationkey AS VARCHAR) AS mail, 'From' AS kind, 'u***@corp.example' AS t FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'Subject', n_name FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'body', 'from *.*.*.* of ' || n_name FROM nation")
def mail_units_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails read on the executors, their headers and bodies masked as text."""
    at = local(spark)
    for key, name in _nations(spark, sf_dir):
        m = EmailMessage()
        m["From"], m["Subject"] = f"user{key}@corp.example", name
        m.set_content(f"from 10.0.0.{key} of {name}")
        (at / f"{key}.eml").write_bytes(bytes(m))
    units = read_units(spark, f"file://{at}/*.eml").select(F.regexp_extract("path", r"(\d+)\.eml$", 1).alias("mail"), "kind", F.rtrim("text", F.lit("\r\n")).alias("t"))
    return mask_text(units, "t", default_rules())


@query("word_units_masked", "SELECT CAST(n_nationkey AS VARCHAR) AS word, 'of ' || n_name AS t FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'at *.*.*.*' FROM nation")
def word_units_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of Word documents, read on the executors and masked as text."""
    at, space = local(spark), "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    for key, name in _nations(spark, sf_dir):
        body = "".join(f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>" for t in (f"of {name}", f"at 10.0.0.{key}"))
        with zipfile.ZipFile(at / f"{key}.docx", "w") as z:
            z.writestr("word/document.xml", f'<w:document xmlns:w="{space}"><w:body>{body}</w:body></w:document>')
    units = read_units(spark, f"file://{at}/*.docx").select(F.regexp_extract("path", r"(\d+)\.docx$", 1).alias("word"), F.col("text").alias("t"))
    return mask_text(units, "t", default_rules())


@query("stream_mask", MASKED.format("k"))
def stream_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a stream of files, masked and written by one run over what is there."""
    at = work(spark)
    people(spark, sf_dir).write.parquet(f"{at}/in")
    stream = spark.readStream.schema(people(spark, sf_dir).schema).parquet(f"{at}/in")
    write_stream(mask_stream(stream, default_rules()), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("value_scan_overlaid", f"SELECT k, {mask_sql('email', 'email')} AS v FROM {CUSTOMERS}")
def value_scan_overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule whose pattern has no Java form still takes part in the value scan."""
    email = dataclasses.replace(BUILTIN["email"], match=r"\w+@\w+\.\w+")
    return apply_rules(people(spark, sf_dir).select("k", F.col("email").alias("v")), RuleSet({**BUILTIN, "email": email}, ())).frame


@query("value_scan_count", "SELECT count(*) AS processed, sum(CASE WHEN c_custkey % 9 < 4 THEN 1 ELSE 0 END)::BIGINT AS masked FROM customer")
def value_scan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells a value scan changes."""
    m = apply_rules(people(spark, sf_dir).select("k", F.expr(MIXED).alias("v")), RuleSet(dict(BUILTIN), ()))
    return m.work.agg(F.count("*").alias("processed"), F.sum(m.counts()).alias("masked"))


@query("working_columns", f"SELECT k, 1 AS _changed_0, 'x' AS _trim_0, 'y' AS _rule_0, {mask_sql('email', 'email')} AS v FROM {CUSTOMERS}")
def working_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the names that the engine might use itself."""
    df = people(spark, sf_dir).select("k", F.lit(1).alias("_changed_0"), F.lit("x").alias("_trim_0"), F.lit("y").alias("_rule_0"), F.col("email").alias("v"))
    return apply_rules(df, RuleSet(dict(BUILTIN), ())).frame


VARIED = f"CASE {K} % 4 WHEN 0 THEN '申请人：张三丰' WHEN 1 THEN 'no person, order ' || {S(K)} WHEN 2 THEN '供应商：Acme Trading' ELSE '王芳 signed' END"


@query("name_scan_varied", f"SELECT {K} AS k, CASE {K} % 4 WHEN 0 THEN '申请人：张*' WHEN 1 THEN 'no person, order ' || {S(K)} WHEN 2 THEN '供应商：A*' ELSE '王* signed' END AS t FROM customer")
def name_scan_varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons and companies by prefix and list in some rows, none in others."""
    return mask_text(table(spark, sf_dir, "customer").select(F.col(K).alias("k"), F.expr(VARIED).alias("t")), "t", NAMING, scan_names=True)


@query("normalize_trace", f"SELECT k, lower(account) AS v, lower(account) <> account AS changed FROM {CUSTOMERS}")
def normalize_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return people(spark, sf_dir).select("k", trace("lower", F.col("account")).alias("x")).select("k", F.col("x.value").alias("v"), "x.changed")
