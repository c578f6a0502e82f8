"""That operators spend no more than they need."""

import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql.readwriter import DataFrameWriter

pytest.importorskip("tessera.llm.queries")
from tessera.llm import common, decontam, substring, toxicity  # noqa: E402


def test_toxicity_looks_up_few_words():
    texts = ["Ab abc ABCDE abcdefg\tabcdefg\nabcd_e 12345 é́lan ΣΑΣ ΣΑΣ\x0bİstanbul", "", " \x85\x1c ", "x" * 90 + " abcdz", "ﬁne-tuned İİİİİİ ǅabcdef"]

    def spans(text):
        """Terms of a text, chunk by chunk."""
        words = [w for c in re.split("[\t\n\r ]", text) for w in re.findall(r"\w+", c.lower())]
        return [s for w in words for s in (w, *(w[:n] + "-" for n in toxicity.BEGIN if len(w) > n))]

    looked = []

    class Looked(dict):
        def __contains__(self, term):
            looked.append(term)
            return dict.__contains__(self, term)

    number = Looked({s: i for i, s in enumerate(sorted({s for t in texts for s in spans(t)})[::2])})
    known = toxicity.Terms(number, most=3)
    for t in texts:
        assert known.counts(t) == tuple(sorted(Counter(number[s] for s in spans(t) if s in number.keys()).items()))
    # words that begin like no known term cost no look
    looked.clear()
    assert known.counts(" ".join(f"q{i:05d}" for i in range(1000))) == () and not looked


def test_intermediate_tables_have_no_checksum_files(spark, tmp_path, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text if i % 2 else text[4:] + f" {i}") for i in range(40)], "doc_id long, text string")
    for module in (common, substring):
        monkeypatch.setattr(module, "shared_dir", lambda spark: tmp_path.as_uri())
    kept = common.materialize(docs, "docs")
    assert sorted(kept.collect()) == sorted(docs.collect())
    assert substring.remove_repeats(kept).where("n_removed > 0").count() == 39
    files = {p.name for p in Path(tmp_path).rglob("*") if p.is_file()}
    # such a file costs child processes that set its mode and that of the file it belongs to
    assert any(n.startswith("part-") for n in files) and not [n for n in files if n.endswith(".crc")]


def test_decontamination_cuts_a_text_once_and_decodes_few_at_once(spark, tmp_path, monkeypatch):
    key = "spark.sql.parquet.columnarReaderBatchSize"
    texts = ["A Text OF words", "É TEXT OF WORDS İ", "Text-of_WORDS ΣΑΣ", "other", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    bench = spark.createDataFrame([(1, "text of words"), (2, "é"), (3, "É text"), (4, "ΣΑΣ")], "item_id long, text string")
    before, seen, write = spark.conf.get(key), {}, DataFrameWriter.parquet

    def spy(self, path, *args, **named):
        plan = self._df._jdf.queryExecution().optimizedPlan().toString()
        seen[path.rpartition("/")[2].partition("-")[0]] = int(spark.conf.get(key)), plan.count("split(")
        return write(self, path, *args, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", spy)
    found = decontam.find(spark.read.parquet(f"{tmp_path}/docs"), bench)
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in found.collect()) == [(0, 4, 3, 1), (1, 5, 4, 2), (2, 4, 4, 2), (3, 1, 0, 0), (4, 0, 0, 0), (5, 0, 0, 0)]
    # both tables that come from all texts; what is read of the result later does not decode them again
    assert [seen.get(name) for name in ("rarity", "found")] == [(64, 1), (64, 1)]
    assert "docs" not in "".join(found.inputFiles()) and spark.conf.get(key) == before
