"""Golden values of rules, templates, normalizers and keyed hashes."""

import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tessera.functions.crypto import fingerprint, hmac_hex, pseudonym_key
from tessera.functions.normalize import NORMALIZERS, TEXT
from tessera.functions.template import apply_rule, apply_text, preview_rule, render, render_text
from tessera.rules import BUILTIN, default_rules, effective_specs, list_rules, load_rules, match_columns, parse_rules, rules_for, validate_rule

MASKS = [
    ("name", "张伟", "张*"), ("name", "Alice Chen", "A*"), ("name", "", ""), ("email", "a@b.com", "a***@b.com"), ("email", "alice@corp.example", "a***@corp.example"), ("ip", "10.1.2.3", "*.*.*.*"),
    ("phone", "13800000000", "138****0000"), ("employee_id", "EID-7F3A", "EID-***"), ("account", "zhangsan", "z***n"), ("company", "亚玛芬体育", "亚*"), ("app_version", "v1.2.3", "v1.*.*"),
]
PSEUDO = [
    ("email", "alice@corp.example", "p110F17E9@masked.local"), ("phone", "13800000000", "64434872504"), ("phone", "138-0000-0000", "64434872504"), ("phone", "138 0000 0000", "64434872504"),
    ("employee_id", "EID-7F3A", "EID-601D558B"), ("name", "张伟", "N-04921D6C"), ("name", "Alice Chen", "N-1D3A0E7C"), ("ip", "10.1.2.3", "IP-811D6010"), ("id_card", "11010119900307777X", "ID-35CE422C"), ("app_version", "v1.2.3", "V-540B79A7"),
]


def column(spark, values, expr):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(expr(F.col("v")).alias("x")).collect()]


@pytest.mark.parametrize("strategy,cases", [("mask", MASKS), ("pseudo", PSEUDO)])
def test_rules(spark, strategy, cases):
    key = pseudonym_key("pepper-1")
    for rule in {c[0] for c in cases}:
        mine = [c for c in cases if c[0] == rule]
        assert column(spark, [c[1] for c in mine], lambda v: apply_rule(BUILTIN[rule], strategy, v, key)) == [c[2] for c in mine]
        assert [apply_text(BUILTIN[rule], strategy, c[1], key) for c in mine] == [c[2] for c in mine]


TEMPLATES = ["{first}{second}***{tail:2}", "{head:6}****{tail:4}", "{head:0}|{tail:0}|{last}", "{prefix}/{suffix}", "{domain}", "{major}", "{hash:12}{x}", "{digits}", "{hash:8}", "plain", ""]
VALUES = ["沪A12345", "沪", "110101199003077777", "a-b c.d", "-x", "x@y@z", "v12.3", "", "a", "９８", "\x1cq r", "138-0000-0000", "😀b"]


def test_templates_agree(spark):
    key = pseudonym_key("k")
    for t in TEMPLATES:
        assert column(spark, VALUES, lambda v: render(t, v, key)) == [render_text(t, v, key) for v in VALUES], t
    assert render_text("{first}{second}***{tail:2}", "沪A12345") == "沪A***45"
    assert render_text("{first}{second}***{tail:2}", "沪") == "沪***沪"


def test_normalizers_agree(spark):
    values = ["  A-b c ", "ΟΔΟΣ", "Straße", "İx", " x　", "\x1cy\x1f", "+86 138 0000 0000", "ﬁ", "Ꭰꮿ", "a–b—c", "", "ıI"]
    for name in NORMALIZERS:
        if name != "upper":
            assert column(spark, values, NORMALIZERS[name]) == [TEXT[name](v) for v in values], name
    assert TEXT["phone"]("+86 138 0000 0000") == "+8613800000000"


def test_casefold_everywhere(spark):
    values = [chr(i) for i in range(1, 0x2FFF)] + ["𐐀", "𞤀"]
    assert column(spark, values, NORMALIZERS["lower"]) == [v.casefold() for v in values]


def test_hmac(spark):
    for v in ["", "x", "张伟", "y" * 500]:
        assert column(spark, [v], lambda c: hmac_hex(b"k" * 32, c)) == [hmac.new(b"k" * 32, v.encode(), hashlib.sha256).hexdigest()]
    assert fingerprint("secret") == "fp:D5EE103E683D" and fingerprint(None) is None


def test_rule_sets(tmp_path):
    assert default_rules().version == "sha256:f7f934c8dab3"
    assert len(BUILTIN) == 12 and sum(r.disabled for r in BUILTIN.values()) == 2 and len(list_rules()) == 12
    rs = parse_rules("rule_defs:\n  tin: {match: '^[A-Z0-9]{15,18}$', mask: '***-{tail:4}', pseudo: 'TIN-{hash:8}'}\nrules:\n  - {column: t, rule: tin, strategy: pseudo}\n")
    assert rs.rules["tin"].mask == "***-{tail:4}" and rs.strategy_for("t") == "pseudo"
    for bad in ("rules: [{column: a, rule: nope}]", "rules: [{column: a, rule: ip, strategy: x}]", "rule_defs: {a: {match: x}}", "a: [", "rules: [{col: a}]"):
        with pytest.raises(ValueError):
            parse_rules(bad)
    with pytest.raises(FileNotFoundError):
        load_rules(tmp_path / "none.yaml")
    assert validate_rule("ok", {"match": "(", "mask": "", "pseudo": "x"})
    with pytest.raises(ValueError, match="email"):
        effective_specs(["x"], parse_rules("rules: [{column: email, rule: email}]"))


def test_column_match():
    assert [s.rule for s in match_columns(["员工姓名", "签约主体", "l_shipdate", "description", "hotel"])] == ["name", "company", "ip", "ip", "phone"]
    assert not match_columns(["期间", "岗位", "队伍ID", ""])
    assert [s.column for s in rules_for(["email", "员工姓名"]).specs] == ["email"]


def test_errors(spark):
    with pytest.raises(ValueError, match="pepper"):
        apply_rule(BUILTIN["ip"], "pseudo", F.lit("x"))
    with pytest.raises(ValueError):
        apply_rule(BUILTIN["ip"], "other", F.lit("x"))
    assert preview_rule(BUILTIN["ip"], "1.2.3.4") == {"original": "1.2.3.4", "masked": "*.*.*.*", "changed": True, "strategy": "mask"}
