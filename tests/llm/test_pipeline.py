"""The pipeline against a plain version of it, and the registered SQL of this package."""

import os
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm.queries")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from tessera.llm import queries as Q  # noqa: E402
from tessera.llm import common, toxicity  # noqa: E402
from tessera.llm.common import documents, materialize, settled  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = Q.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({Q.oracle_sql()[name]})").fetchall()
    assert Counter(map(str, want)) == Counter(str(tuple(r)) for r in df.select(columns).collect())


def test_pipeline(spark):
    from tokenizers import Tokenizer

    docs = documents(spark, DATA)
    index = toxicity.fit(docs, documents(spark, DATA, "labels").select("doc_id", "toxic"))
    rows = [(r.doc_id, r.text or "") for r in docs.orderBy("doc_id").collect()]
    rows = [(i, t) for i, t in rows if index.score(t)[0] < 0.5]

    def shingles(t):
        w = t.encode().lower().split()
        return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])

    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            for j in where[x]:
                shared[i, j] += 1
            where[x].append(i)
    for (i, j), n in shared.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            root[max(find(i), find(j))] = min(find(i), find(j))
    rows = [(i, t) for i, t in rows if find(i) == i]

    seen, kept = set(), []
    for i, t in rows:
        w = t.encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(k)
        if not any(gone):
            kept.append((i, t))
        elif not all(gone):
            kept.append((i, b" ".join(x for x, g in zip(w, gone) if not g).decode()))

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))

    wins = defaultdict(set)
    for r in documents(spark, DATA, "benchmark").collect():
        w = words(r.text or "")
        for s in range(max(len(w) - 7, 1) if w else 0):
            wins[tuple(w[s : s + 8])].add(r.item_id)
    sizes = {len(k) for k in wins}
    clean = []
    for i, t in kept:
        w = words(t)
        items = set().union(*(wins.get(tuple(w[s : s + n]), set()) for n in sizes for s in range(len(w) - n + 1)))
        if not items:
            clean.append((i, t))
    assert 0 < len(clean) < len(kept) <= len(rows)

    tok, want = Tokenizer.from_file(Q.vocabulary()), Counter()
    for i, t in clean:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), 4096):
            want[i, s // 4096, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())] += 1
    got = corpus_pipeline.run(spark, DATA).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 4096)


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "x", "en", "s", 1), (3, "", "en", "s", 0)], documents(spark, DATA).schema)
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, DATA), name)
        assert out.columns == docs.columns
        assert out.where("doc_id = 2").first().text is None and out.where("doc_id is null").count() == 1
    assert corpus_pipeline.without_near_duplicates(spark, docs, DATA).where("doc_id = 1").count() == 1
    # columns that operators use themselves, and empty tables
    extra = ["rid", "n_words", "n_removed", "kept", "before", "root", "_row", "key", "tile"]
    wide = docs
    for c in extra:
        wide = wide.withColumn(c, F.lit(7))
    wide.write.parquet(str(tmp_path / "w"))
    wide = spark.read.parquet(str(tmp_path / "w"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, DATA)
        assert out.columns == wide.columns
        assert all(r[c] == 7 for r in out.collect() for c in extra)
        assert stage(spark, wide.limit(0), DATA).count() == 0


def test_settled(spark, tmp_path):
    """Rows that a join or a shuffle has dealt are written before they are numbered."""
    docs = documents(spark, DATA)
    assert settled(docs.where("doc_id > 3").select("doc_id")) is not None and not hasattr(settled(docs.where("doc_id > 3")), "_tessera_path")
    assert hasattr(settled(docs.repartition(3)), "_tessera_path")


def test_shuffle_files_go_with_the_write(spark, monkeypatch):
    """A written table leaves no shuffle files, whenever Spark's cleaner comes by; the setting is as before."""
    monkeypatch.setattr(common, "free_shuffles", lambda spark: None)
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    store, before = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager(), spark.conf.get(key, None)

    def shuffles():
        files = store.getAllFiles()
        return {f for i in range(files.size()) if (f := files.apply(i).getName()).startswith("shuffle_")}

    had = shuffles()
    out = materialize(spark.range(20_000).groupBy((F.col("id") % 5000).alias("k")).count(), "counts")
    for _ in range(30):
        if not (left := shuffles() - had):
            break
        time.sleep(0.1)
    assert not left and out.count() == 5000 and spark.conf.get(key, None) == before


def test_one_planted_passage_is_dropped(spark, tmp_path):
    item = documents(spark, DATA, "benchmark").where("length(text) > 0").orderBy("item_id").first().text
    docs = spark.createDataFrame([(1, f"before it {item} after it", "en", "s", 0), (2, "no passage at all", "en", "s", 0)], documents(spark, DATA).schema)
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert [r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, DATA).collect()] == [2]
