"""Masking of tables and text, preview, files, streams."""

import json
import os
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.functions.patterns import native, to_java, unanchored
from tessera.operators.masking import apply_rules, mask_table
from tessera.operators.preview import preview
from tessera.operators.stats import MaskStats
from tessera.operators.text import mask_text, mask_text_value
from tessera.plans.files import discover, mask_folder, mask_path, output_path, preview_path, validate
from tessera.plans.rulesets import RuleSets, generate_rules
from tessera.rules import BUILTIN, RuleSet, Spec, default_rules, matches, parse_rules
from tessera.sources import audit, documents, tables

EIGHT = "name string, email string, ip string, phone string, employee_id string, account string, company string, app_version string"
ROWS = [("张伟", "a@b.com", "10.1.2.3", "13800000000", "EID-7F3A", "zhangsan", "亚玛芬体育", "v1.2.3"), ("Alice", "c@d.org", "10.0.0.1", "13900000001", "EID-1234", "lisi_x", "Acme", "2.0")]


def scanned(spark, values, **how):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    m = apply_rules(df, RuleSet(dict(BUILTIN)), **how)
    return [r.v for r in m.frame.orderBy("i").collect()], m.count()


def test_counts(spark):
    assert mask_table(spark.createDataFrame(ROWS, EIGHT), default_rules()).count() == 16
    rows = [("", *ROWS[0][1:]), ROWS[1]]
    m = mask_table(spark.createDataFrame(rows, EIGHT), default_rules())
    assert m.count() == 15 and m.stats() == MaskStats(2, 15, 1)
    assert (MaskStats(1, 2, 1) + MaskStats(1, 0, 1)).ratio == 1.0 and MaskStats().ratio == 0


def test_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",), (" x",)], "name string")
    assert [r.name for r in mask_table(df, default_rules()).frame.collect()] == [None, "", " *"]


def test_value_scan(spark):
    got, n = scanned(spark, ["11010119900307777X", "id 11010119900307777X", "2.5", "2024.1.1", "=SUM(H13:H17)", "100", " 张伟 ", "张伟负责审批", "采购流程", "2026年度", "欧阳修", "   ", None, "", " a@b.com ", "6222021234567890123", "1.2.3.4"])
    assert got == ["110101**********777X", "id 11010119900307777X", "2.5", "2024.1.1", "=SUM(H13:H17)", "100", "张*", "张伟负责审批", "采购流程", "2026年度", "欧*", "", None, "", "a***@b.com", "622202**********0123", "*.*.*.*"]
    assert n == 6
    assert scanned(spark, ["Zed"], people=["Zed"]) == (["Z*"], 1)
    people = spark.createDataFrame([(" Zed ",), ("Q",), (None,)], "name string")
    assert scanned(spark, ["Zed", " Q", "R"], people=people) == (["Z*", "Q*", "R"], 2)


def test_apply_errors(spark):
    df = spark.createDataFrame(ROWS, EIGHT)
    for specs in ((Spec("nope", "ip"),), (Spec("ip", "nope"),), (Spec("ip", "ssn"),), (Spec("ip", "ip", "pseudo"),)):
        with pytest.raises(ValueError):
            apply_rules(df, RuleSet(dict(BUILTIN), specs))


def test_odd_column_names(spark):
    df = spark.createDataFrame([("张伟", 1), ("x", 2)], "`姓 名` string, `a.b` int")
    m = mask_table(df, default_rules())
    assert m.frame.columns == ["姓 名", "a.b"] and [tuple(r) for r in m.frame.collect()] == [("张*", 1), ("x*", 2)]
    assert mask_table(df, default_rules(), stringify=True).frame.dtypes[1] == ("a.b", "string")


def test_pseudonyms_join(spark):
    rules = RuleSet(dict(BUILTIN), (Spec("phone", "phone", "pseudo"),))
    a = apply_rules(spark.createDataFrame([("138-0000-0000",), ("139 1",)], "phone string"), rules, "k").frame
    b = apply_rules(spark.createDataFrame([("13800000000",), ("1391",)], "phone string"), rules, "k").frame
    assert a.join(b, "phone").count() == 2


TEXTS = ["mail a@b.com or 10.0.0.1, call 138 0000 0000.", "v1.2.3 and EMP-12345 2024-01-02 11:00", "", None, "申请人：张伟负责审批 张伟达 王芳", "供应商: Acme & Co, Ltd\n腾讯 13800000000", "1234567890123456789"]


@pytest.mark.parametrize("strategy", ["mask", "pseudo"])
@pytest.mark.parametrize("names", [False, True])
def test_text(spark, strategy, names):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    got = [r.t for r in mask_text(df, "t", default_rules(), "pep", strategy, names, ["欧阳修", "张伟达"]).orderBy("i").collect()]
    assert got == [None if t is None else mask_text_value(t, default_rules(), "pep", strategy, names, ["欧阳修", "张伟达"]) for t in TEXTS]


def test_text_of_python_patterns(spark):
    rules = parse_rules(r"rule_defs: {w: {match: '\bz\w+', mask: '<{first}>', pseudo: 'x', text_scanable: true}, e: {match: 'q*', mask: '-', pseudo: 'x', text_scanable: true}}")
    only = RuleSet({k: rules.rules[k] for k in ("w", "e")})
    df = spark.createDataFrame([("zap qq z b",)], "t string")
    assert mask_text(df, "t", only).first().t == re.sub("q*", lambda m: "-" if m[0] else "", re.sub(r"\bz\w+", "<z>", "zap qq z b"))


def test_patterns(spark):
    assert unanchored(r"^a$") == "a" and unanchored(r"a\$") == r"a\$" and to_java("(") is None and native(spark, "x*") is None
    assert to_java(r"[\s]") == r"(?Ud)[\s\x1c-\x1f]" and to_java(r"(?P<n>a{,3})(?P=n)\Z") == r"(?Ud)(?<n>a{0,3})\k<n>\z"


def test_preview(spark):
    df = spark.createDataFrame([("张伟", "13800000000", None), ("李娜", "", " 王芳 ")], "`姓名` string, `手机号` string, `备注` string")
    got = {r["column"]: r for r in preview(df, default_rules())}
    assert got["姓名"]["hits"] == 2 and got["姓名"]["rule"] == "name" and got["手机号"]["total"] == 2 and got["手机号"]["hits"] == 1
    assert got["备注"]["sample_before"] == "王芳" and got["备注"]["sample_after"] == "王*" and got["备注"]["ratio"] == 1.0
    assert sum(r["hits"] for r in got.values()) == mask_table(df, default_rules()).count()


def test_value_scan_with_python_patterns(spark):
    from dataclasses import replace

    from tessera.operators.text import sensitive

    base = default_rules().rules
    own = RuleSet(base | {"email": replace(base["email"], match=r"[\w.+-]+@[\w-]+\.\w+")})
    assert to_java(own.rules["email"].match) is None
    df = spark.createDataFrame([(" ann@b.com ",), ("no address",), (None,), ("",)], "remark string")
    assert [r.remark for r in apply_rules(df, own).frame.collect()] == ["a***@b.com", "no address", None, ""]
    assert preview(df, own)[0]["hits"] == 1
    text = spark.createDataFrame([("write to ann@b.com",), ("nothing",)], "t string")
    only = RuleSet({"email": own.rules["email"]})
    assert [r.s for r in text.select(sensitive(F.col("t"), only, spark).alias("s")).collect()] == [True, False]


def write(path: Path, text: str) -> str:
    path.write_text(text, "utf-8")
    return str(path)


def test_csv_file(spark, tmp_path):
    src = write(tmp_path / "a.csv", 'name,email,note\n张伟,a@b.com,"x, ""y""\nz"\n,c@d.org,00123\n')
    done = mask_path(spark, src, str(tmp_path / "o" / "b.csv"))
    text = (tmp_path / "o" / "b.csv").read_text("utf-8")
    assert done.rows == 2 and done.stats.masked == 3 and text.startswith("name,email,note\n张*,a***@b.com,") and "00123" in text and '""y""' in text
    assert mask_path(spark, src, str(tmp_path / "c.csv")) == done and (tmp_path / "c.csv").read_text("utf-8") == text
    (tmp_path / "g.csv").write_bytes("name\n张伟\n".encode("gb18030"))
    mask_path(spark, str(tmp_path / "g.csv"), str(tmp_path / "h.csv"), encoding="gb18030")
    assert (tmp_path / "h.csv").read_text("utf-8") == "name\n张*\n"
    for bad, kind in ((write(tmp_path / "e.csv", "name\n"), ValueError), (str(tmp_path / "none.csv"), FileNotFoundError), (write(tmp_path / "x.zip", ""), ValueError)):
        with pytest.raises(kind):
            mask_path(spark, bad, str(tmp_path / "out"))


def test_json_files(spark, tmp_path):
    for name, text in (("a.json", '[{"name": "张伟", "email": "a@b.com", "n": 1}]'), ("b.ndjson", '{"name": "张伟", "email": "a@b.com", "n": 1}\n'), ("c.json", '{"name": "张伟", "email": "a@b.com", "n": 1}\n')):
        mask_path(spark, write(tmp_path / name, text), str(tmp_path / f"out_{name}"))
        assert json.loads((tmp_path / f"out_{name}").read_text("utf-8")) == {"name": "张*", "email": "a***@b.com", "n": "1"}


def test_json_lines_in_json_files(spark, tmp_path):
    lines = "".join(json.dumps({"name": "张伟", "n": i}, ensure_ascii=False) + "\n" for i in range(3))
    src = write(tmp_path / "a.json", lines)
    assert mask_path(spark, src, str(tmp_path / "b.json")).rows == 3
    assert tables.read_json(spark, str(tmp_path / "b.json")).count() == 3
    (tmp_path / "d").mkdir()
    write(tmp_path / "d" / "1.json", lines)
    write(tmp_path / "d" / "2.json", '[{"name": "李娜",\n "n": 3},\n {"name": "王芳", "n": 4}]')
    write(tmp_path / "d" / "3.json", '{"name": "x",\n "n": 5}')
    assert {r.n for r in tables.read_json(spark, str(tmp_path / "d")).collect()} == set("012345")


def test_csv_folder_of_other_encoding(spark, tmp_path):
    for i, name in enumerate(("张伟", "李娜")):
        (tmp_path / f"{i}.csv").write_bytes(f"name\n{name}\n".encode("gb18030"))
    assert {r.name for r in tables.read_csv(spark, str(tmp_path), "gb18030").collect()} == {"张伟", "李娜"}


def test_excel(spark, tmp_path):
    src = str(tmp_path / "a.xlsx")
    tables.new_excel(src, {"用户": [["name", "email", ""], ["张伟", "a@b.com", "x<&"]], "权限": [["employee_id", "phone"], ["EMP-1", "13800000000"]], "空": [["only"]]})
    done = mask_path(spark, src, str(tmp_path / "b.xlsx"))
    got = {n: rows for n, _, rows in tables.sheets_of((tmp_path / "b.xlsx").read_bytes())}
    assert done.sheets == {"用户": 1, "权限": 1} and got["用户"] == [["name", "email", "col_2"], ["张*", "a***@b.com", "x<&"]] and got["权限"][1] == ["EMP-***", "138****0000"] and got["空"] == [["only"]]
    assert preview_path(spark, src)["total_hits"] == 4
    assert tables.scan_excel(spark, src).count() == 5


def test_mail_and_word(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"From: Alice Chen <alice@corp.example>\r\nTo: x@y.org, B <b@c.de>\r\nSubject: call 13800000000\r\nDate: Mon, 1 Jan 2024 00:00:00 +0000\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nip 10.0.0.1\r\n")
    mask_path(spark, str(tmp_path / "a.eml"), str(tmp_path / "b.eml"))
    mail = documents.parse_mail((tmp_path / "b.eml").read_bytes())
    assert mail["From"] == "Alice Chen <a***@corp.example>" and "b@c.de" not in mail["To"] and "138****0000" in mail["Subject"] and mail["Date"] and "*.*.*.*" in mail.get_content()
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body><w:p><w:r><w:t>mail a@</w:t></w:r><w:r><w:t>b.com</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1.2.3.4</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>")
    done = mask_path(spark, str(tmp_path / "a.docx"), str(tmp_path / "b.docx"))
    assert done.rows == 2 and done.stats == MaskStats(2, 2, 1)
    assert [t for _, t in documents.units_of("b.docx", (tmp_path / "b.docx").read_bytes())] == ["mail a***@b.com", "*.*.*.*"]
    units = documents.read_units(spark, str(tmp_path / "a.*"))
    assert units.where("kind = 'cell'").first().text == "1.2.3.4"
    assert documents.mask_documents(spark, str(tmp_path / "a.eml"), lambda t: "#").first().units == 1
    with pytest.raises(ValueError):
        documents.document_text(spark, str(tmp_path / "none"))


def test_band(spark):
    words = "array(named_struct('text','a@b.com','conf',90.0D,'x',1,'y',20,'w',5,'h',10), named_struct('text','plain','conf',90.0D,'x',1,'y',90,'w',5,'h',10), named_struct('text','c@d.com','conf',10.0D,'x',1,'y',70,'w',5,'h',10))"
    got = spark.range(1).select(documents.sensitive_band(F.expr(words), lambda t: t.contains("@"), F.lit(100)).alias("b")).first().b
    assert (got.top, got.bottom) == (15, 35)


def test_people_and_demo(spark, tmp_path):
    assert {r.name for r in tables.read_people(spark, write(tmp_path / "p.csv", "employee_id,Name\n1, 欧阳修 \n2,\n3,欧阳修\n")).collect()} == {"欧阳修"}
    for bad in ("a\n1\n", "name\n\n"):
        with pytest.raises(ValueError):
            tables.read_people(spark, write(tmp_path / "q.csv", bad))
    assert mask_table(tables.demo_data(spark, 50), default_rules()).count() == 400


def test_files(tmp_path):
    (tmp_path / "s").mkdir()
    a, b = write(tmp_path / "s" / "b.csv", "x"), write(tmp_path / "s" / "a.txt", "x")
    assert discover(tmp_path) == [Path(a)] and output_path(a).name == "b_masked.csv" and output_path(a, dotted=True).name == "b.masked.csv"
    good, bad = validate([tmp_path, b, tmp_path / "none"])
    assert good == [Path(a)] and [x["path"] for x in bad] == [b, str(tmp_path / "none")]


def test_rulesets_and_audit(tmp_path, spark):
    sets = RuleSets(tmp_path / "r")
    sets.save("mine", {"tin": {"match": "x", "mask": "y", "pseudo": "z"}})
    sets.switch("mine")
    assert sets.names() == ["builtin", "mine"] and sets.current() == "mine" and "tin" in sets.load().rules and sets.info("mine")["own_rules"] == 1
    with pytest.raises(ValueError):
        sets.delete("mine")
    sets.export("mine", tmp_path / "e.yaml")
    assert sets.take(tmp_path / "e.yaml", "two") == "two" and sets.current() == "two"
    sets.delete("mine")
    assert generate_rules(lambda p: "```yaml\nrule_defs: {}\n```", "text") == "rule_defs: {}\n"
    log = tmp_path / "a.jsonl"
    for _ in range(3):
        audit.log_run("i", "o", default_rules(), 5, "secret", log)
    log.open("a").write("not json\n")
    got = audit.read_log(2, log)
    assert len(got) == 1 and got[0]["pepper_fingerprint"] == "fp:D5EE103E683D" and "secret" not in log.read_text() and len(audit.read_log(0, log)) == 3
    assert audit.scan_log(spark, str(log)).count() == 3


def test_csv_folder(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    write(tmp_path / "in" / "a.csv", "name,phone\n张伟,13800000000\n")
    write(tmp_path / "in" / "deep" / "b.csv", "name,phone\n王芳,\n李娜,13900000001\n")
    write(tmp_path / "in" / "notes.txt", "left alone\n")
    done = mask_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert (done.rows, done.stats.masked) == (3, 5)
    rows = sorted(tuple(r) for r in tables.read_csv(spark, str(tmp_path / "out"), multiline=False).collect())
    assert {r[1] for r in rows} == {"139****0001", None, "138****0000"}
    with pytest.raises(ValueError):
        mask_folder(spark, str(tmp_path / "in"), str(tmp_path / "in") + "/")


def test_matches():
    assert matches(["Phone_No", "x", "e-mail"]) == [{"column": "Phone_No", "rule": "phone", "strategy": "mask"}, {"column": "e-mail", "rule": "email", "strategy": "mask"}]
    assert json.loads(json.dumps(matches([]))) == []


def test_old_rules_file(tmp_path):
    sets, old = RuleSets(tmp_path / "r"), tmp_path / "old.yaml"
    assert sets.migrate(old) is None
    write(old, "rule_defs:\n  tin: {match: x, mask: y, pseudo: z}\n")
    assert sets.migrate(old) == "mine" and "tin" in sets.load("mine").rules and not old.exists() and (tmp_path / "old.bak").exists()
    write(old, "rule_defs:\n  tin: {match: x, mask: y, pseudo: z}\n")
    with pytest.raises(ValueError):
        sets.migrate(old)
    assert old.exists()
    for text in ("a: [", "", "rule_defs: {}\n"):
        write(old, text)
        assert sets.migrate(old, "other") is None and not old.exists()


def test_generate_command(tmp_path, monkeypatch, capsys):
    from tessera import cli

    (tmp_path / "asked.py").write_text("def ask(prompt):\n    return 'rule_defs: {}' if 'tax numbers' in prompt else 'rule_defs: ['\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    out = tmp_path / "out.yaml"
    assert cli.main(["rules", "generate", "tax numbers", "-o", str(out), "-y"]) == 2
    monkeypatch.setenv("TESSERA_ASK", "asked:ask")
    assert cli.main(["rules", "generate"]) == 2 and cli.main(["rules", "generate", "else", "-y", "-o", str(out)]) == 2
    assert cli.main(["rules", "generate", "tax numbers", "--dry-run", "-o", str(out)]) == 0 and not out.exists()
    monkeypatch.setattr("builtins.input", lambda _: "n")
    assert cli.main(["rules", "generate", "tax numbers", "-o", str(out)]) == 0 and not out.exists()
    (tmp_path / "want.txt").write_text("mask tax numbers")
    assert cli.main(["rules", "generate", "-i", str(tmp_path / "want.txt"), "-o", str(out), "-y"]) == 0 and out.read_text() == "rule_defs: {}"


def test_stream(spark, tmp_path):
    from tessera.streaming.masking import mask_stream, write_stream

    spark.createDataFrame([("张伟", "mail a@b.com")], "name string, note string").write.parquet(str(tmp_path / "in"))
    df = spark.readStream.schema("name string, note string").parquet(str(tmp_path / "in"))
    q = write_stream(mask_stream(df, default_rules(), text_columns=["note"]), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(120)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("张*", "mail a***@b.com")]


def test_cli_codes(tmp_path):
    def run(*args):
        return subprocess.run([sys.executable, "-m", "tessera.cli", *args], cwd=Path(__file__).parents[1], capture_output=True, text=True, env=os.environ | {"TESSERA_AUDIT_LOG": str(tmp_path / "a")})

    assert run("rules", "list").stdout.count("\n") == 12
    missing = run("mask", str(tmp_path / "none.csv"))
    assert missing.returncode == 2 and "Traceback" not in missing.stderr
    src = write(tmp_path / "a.csv", "name\nx\n")
    assert run("mask", src, "--strategy", "pseudo").returncode == 2 and run("audit").returncode == 0
