"""What only large tables or files show, on small ones made for it."""

from pathlib import Path

import duckdb
import pytest

from tessera import file_queries, queries  # noqa: F401  (registers its queries)
from tessera.operators.text import mask_text
from tessera.rules import default_rules
from tessera.sources import tables


@pytest.fixture
def same(spark, tmp_path):
    """Whether a query over tables gives the rows of its SQL."""

    def check(name: str, **tables: tuple[str, list[tuple]]) -> bool:
        con = duckdb.connect()
        for t, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
        got = queries.Q[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.SQL[name]})").fetchall()
        return sorted(map(tuple, got.collect())) == sorted(want)

    return check


def test_pseudonyms_of_many_keys_stay_apart(same):
    # these keys have the same 32 bits of their pseudonyms
    meet = (96205, 155019)
    orders = [(i, k, "F") for i, k in enumerate(meet)] + [(9, -5, "O")]
    assert same("pseudo_join", customer=("c_custkey long", [(k,) for k in (*meet, 5)]), orders=("o_orderkey long, o_custkey long, o_orderstatus string", orders))


@pytest.mark.parametrize("name", ["name_scan_prefix", "name_scan_varied"])
def test_long_keys_are_no_phones(spark, same, name):
    keys = [7, 99_999, 100_000, 123_457, 1_000_001, 13_800_000_001, 10**15 + 1, 10**17 + 1]
    assert same(name, customer=("c_custkey long", [(k,) for k in keys]))
    # the operator under the default rules takes them for phones, as the reference does
    assert mask_text(spark.createDataFrame([("编号123457 王芳",)], "t string"), "t", default_rules(), scan_names=True).first().t == "编号123****457 王*"


#: A JSON file's text, and how it is to be read.
JSON = {
    "a": ('[{"b": 1, "a": {"x": [1]}}]', "root"), "b": ('{"a": 1}\n{"a": 2}\n', "lines"), "c": ('\ufeff {"z": "x\\u00e9",\n "a": NaN}\n', "root"), "d": (' \n\t\n', None), "e": ('{"a": 1', "lines"),
    "f": ('{"a": 1} x', "lines"), "g": ('{a: 1}', "lines"), "h": ('\n\n{"a": "]["}\n', "root"), "i": ('{"a": 1}{"a": 2}', "lines"), "j": ('"text"', "root"), "k": ('{"a": 1,\n}\n{"a": 2}', "lines"), "l": ('\ufeff[', "root"),
}


def test_large_json_files_stay_out_of_python(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "SMALL", 0, raising=False)
    want = {"root": [], "lines": []}
    for n, (text, kind) in JSON.items():
        (tmp_path / f"{n} x.json").write_text(text, "utf-8")
        want.get(kind, []).append(f"{n} x.json")
    (tmp_path / "m x.json").write_bytes(b'{"a": "\xff\xfe"}')
    want["root"].append("m x.json")
    read = tables.F.udf
    monkeypatch.setattr(tables.F, "udf", lambda *a: (lambda f: read(*a)(lambda c: f(c) if not c else 1 / 0)))
    assert {k: [Path(p).name for p in paths] for k, paths in zip(("root", "lines"), tables.by_kind(spark, str(tmp_path)))} == want
    assert tables.read_json(spark, str(tmp_path / "a x.json")).columns == ["b", "a"]
    assert tables.read_json(spark, str(tmp_path / "c x.json")).columns == ["z", "a"]


def test_small_json_files_are_told_apart_alike(spark, tmp_path, monkeypatch):
    for n, (text, _) in JSON.items():
        (tmp_path / f"{n}.json").write_text(text, "utf-8")
    small = tables.by_kind(spark, str(tmp_path))
    monkeypatch.setattr(tables, "SMALL", 0, raising=False)
    assert small == tables.by_kind(spark, str(tmp_path))
