"""Removal of repeated passages: suffix automata over reference shards, fed by matching anchors.

A broadcast of automata of all documents would grow with the corpus, and every document would meet every shard. So
documents are first routed: each window of `size` words has an anchor, the `gram` consecutive words of least hash
within it. Equal windows have equal anchors at equal places, so only anchors that occur twice matter. The windows of
one anchor in one document are its context. Equal contexts are counted once (all their windows start earliest where
the first of them does); where an anchor has contexts that differ, these are one small reference shard: they are
added to a suffix automaton in document order, matching statistics of each give the earliest place of each window,
which say which windows of the context are found earlier. An anchor with more than `shard` different contexts,
such as the edge of a passage that thousands share, is split further, by whole windows. Flagged windows are merged to
maximal spans, document by document, and removed.

Word sequences are compared by 64-bit word hashes in windows and 32-bit ones within the contexts of one anchor.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import PLAIN, delete_at_exit, discard, free_shuffles, hot_join, materialize, shared_dir, with_row
from .shingles import mixed, rolled, slices, word_hashes


def least_at(x: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive values the place of the least, the first of equals."""
    at, have = np.arange(len(x)), 1
    while have < w:
        step = min(have, w - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(x[right] < x[left], right, left)
        have += step
    return at


def anchors(h: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, windows) of each anchor of a document, by place."""
    if len(h) < size:
        z = np.zeros(0, "i8")
        return np.zeros(0, "u8"), z, z, z
    g = rolled(h, gram)
    at = least_at(g, size - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return g[at[first]], at[first], first, np.diff(np.append(first, len(at)))


def find_anchors(rows: DataFrame, size: int, gram: int) -> DataFrame:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1):
                words, at = word_hashes(part.column(1), False)
                got = [anchors(words[s:e], size, gram)[:2] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                rid = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(x) for x, _ in got])
                yield pa.RecordBatch.from_pydict({"h": pa.array(np.concatenate([x for x, _ in got]).view("i8")), "rid": pa.array(rid), "p": pa.array(np.concatenate([p for _, p in got]).astype("i4"))})

    return rows.select("rid", "text").mapInArrow(emit, "h long, rid long, p int")


def occurrences(docs: DataFrame, size: int, gram: int, kind: str) -> DataFrame:
    """(h, c, doc_id, rid, s, m): the contexts of a document's repeated anchors; c: hash of the context, s: its first
    window, m: how many windows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, 2)):
            out: list[list] = [[] for _ in range(5)]
            words, at = word_hashes(b.column(2), False)
            for i, places in enumerate(b.column(3).to_pylist()):
                h = words[at[i] : at[i + 1]]
                g, p, s, m = anchors(h, size, gram)
                keep = np.isin(p, places, assume_unique=True)
                g, p, s, m = g[keep], p[keep], s[keep], m[keep]
                w = rolled(h, size)
                # windows of a context, with its place before the anchor, make its hash
                code = mixed(w[s] ^ mixed((p - s).astype("u8") << np.uint64(32) | m.astype("u8")))
                code = mixed(code + mixed(w[s + m - 1] ^ g))
                for a, x in zip(out, (np.full(len(g), i), g.view("i8"), code.view("i8"), s, m)):
                    a.append(x)
            i, g, c, s, m = (np.concatenate(a) for a in out) if out[0] else [np.zeros(0, "i8")] * 5
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c), b.column(1).take(pa.array(i)), b.column(0).take(pa.array(i)), pa.array(s.astype("i4")), pa.array(m.astype("i4"))], ["h", "c", "doc_id", "rid", "s", "m"])

    return docs.select("rid", "doc_id", "text", "ps").where("ps is not null").mapInArrow(emit, f"h long, c long, doc_id {kind}, rid long, s int, m int")


def contents(docs: DataFrame, size: int) -> DataFrame:
    """(h, c, rank, m, words, wins): the word hashes of the contexts named in `at`, and those of their windows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for batch in batches for x in slices(batch, 0)):
            out: list[list] = [[] for _ in range(5)]
            every, ends = word_hashes(b.column(0), False)
            for i, at in enumerate(b.column(1).to_pylist()):
                h = every[ends[i] : ends[i + 1]]
                w, low = rolled(h, size).view("i8"), (h & np.uint64(0x7FFFFFFF)).astype("i4")
                for a in at:
                    s, m = a["s"], a["m"]
                    for o, x in zip(out, (a["h"], a["c"], m, low[s : s + m + size - 1], w[s : s + m])):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.list_(pa.int64()))], ["h", "c", "m", "words", "wins"])

    return docs.mapInArrow(emit, "h long, c long, m int, words array<int>, wins array<long>")


def shards(contexts: DataFrame, size: int) -> DataFrame:
    """(h, c, offs): which windows of a context occur in an earlier context of its anchor. Rows come by anchor and in
    document order; one automaton at a time is in memory, of one anchor's contexts."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sam = None, SuffixAutomaton()
        for b in batches:
            out: list[tuple[int, int, list[int]]] = []
            for h, c, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if h != now:
                    now, sam = h, SuffixAutomaton()
                offs = [j for j, end in enumerate(sam.matches(words, size)) if end >= 0] if sam.size else []
                sam.add(words)
                if offs:
                    out.append((h, c, offs))
            h, c, offs = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "c": pa.array(c, pa.int64()), "offs": pa.array(offs, pa.list_(pa.int32()))})

    return contexts.mapInArrow(emit, "h long, c long, offs array<int>")


def strip(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(rid, doc_id, n_words, n_removed, kept) of (rid, doc_id, text, starts): texts without the windows that begin at
    starts, about a megabyte of text at a time."""
    for part in (x for b in batches for x in slices(b, 2)):
        words, gone, kept = [], [], []
        for text, starts in zip(part.column(2), part.column(3)):
            w = text.as_buffer().to_pybytes().split()
            words.append(len(w))
            at = starts.values.to_numpy() if starts.is_valid else ()
            if len(at):
                edge = np.bincount(at, minlength=len(w) + 1) - np.bincount(at + size, minlength=len(w) + 1)
                stay = np.cumsum(edge[:-1]) == 0
                gone.append(len(w) - int(stay.sum()))
                w = [x for x, k in zip(w, stay.tolist()) if k]
            else:
                gone.append(0)
            kept.append(b" ".join(w))
        # the words were cut at ASCII white space alone, so what is joined is UTF-8 as before
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["rid", "doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, size: int = 20, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", shard: int = 2000) -> DataFrame:
    """(rid, doc_id, n_words, n_removed, kept), one row for each row of docs; rid is the row's number in the table.

    Words are runs without ASCII white space. Removed is each word covered by a window of `size` words whose sequence
    also starts earlier: in a smaller id (null ids first, repeated ids by row number), or earlier in the same row. kept: the
    other words joined by one blank. Null text has no words, texts of fewer than `size` words keep all; other columns
    are ignored; an empty table gives no rows.
    """
    if gram > size:
        raise ValueError("an anchor is no longer than a window")
    spark, rows = docs.sparkSession, with_row(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    every = materialize(find_anchors(rows, size, gram), "anchors")
    twice = materialize(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    places = hot_join(every, twice, "h", "n", every.count(), "inner").groupBy("rid").agg(F.collect_list("p").alias("ps"))
    places = materialize(places, "places")
    discard(every)
    discard(twice)

    # texts lie in buckets by row from here on, so that what is found can be joined to them without moving them
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    table = f"tessera_{uuid4().hex}"
    path = f"{shared_dir(spark)}/tessera/texts-{uuid4().hex}"
    joined = rows.join(places, "rid", "left").repartition(n, "rid")
    joined.write.options(**PLAIN).bucketBy(n, "rid").option("path", path).saveAsTable(table)
    texts = spark.table(table)
    # what is planned on it goes on reading the files; the catalog keeps no entry
    spark.sql(f"DROP TABLE {table}")
    delete_at_exit(spark, path)
    del joined
    free_shuffles(spark)

    seen = materialize(occurrences(texts, size, gram, kind), "contexts")
    firsts = seen.groupBy("h", "c").agg(F.min(F.struct("doc_id", "rid", "s", "m")).alias("f"), F.count("*").alias("n"))
    firsts = materialize(firsts.select("h", "c", "n", "f.*"), "firsts")
    many = materialize(firsts.groupBy("h").agg(F.count("*").alias("k")).where("k > 1"), "many")
    differ = hot_join(firsts, many, "h", "k", firsts.count(), "inner")
    at = differ.groupBy("rid").agg(F.collect_list(F.struct("h", "c", "s", "m")).alias("at"))
    held = materialize(contents(texts.select("rid", "text").join(at, "rid").select("text", "at"), size).join(differ.select("h", "c", "k", "doc_id", "rid", "s"), ["h", "c"]), "contents")
    near = held.where(F.col("k") <= shard).repartition("h").sortWithinPartitions("h", F.asc_nulls_first("doc_id"), "rid", "s").select("h", "c", "words")
    masks = shards(near, size)
    # anchors of very many contexts: each window's earliest context by aggregation
    wide = held.where(F.col("k") > shard).select("h", "c", "doc_id", "rid", "s", F.posexplode("wins").alias("j", "win"))
    wide = materialize(wide.select(F.struct("h", "win").alias("key"), "h", "c", "doc_id", "rid", "s", "j"), "wide")
    earliest = wide.groupBy("key").agg(F.min(F.struct("doc_id", "rid", "s", "j", "c"))["c"].alias("first_c"), F.count("*").alias("times")).where("times > 1")
    later = hot_join(wide.select("key", "h", "c", "j"), materialize(earliest, "earliest"), "key", "times", wide.count(), "inner")
    later = later.where("c <> first_c").groupBy("h", "c").agg(F.collect_list(F.col("j").cast("int")).alias("offs"))
    masks = materialize(masks.unionByName(later), "masks")

    # of a context's occurrences all but the first are repeats; of the first, the windows in its mask
    none = F.array().cast("array<int>")
    known = firsts.join(masks, ["h", "c"], "left").select("h", "c", "n", F.col("rid").alias("first_rid"), F.col("s").alias("first_s"), F.coalesce("offs", none).alias("offs")).where("n > 1 or size(offs) > 0")
    known = materialize(known.withColumn("key", F.struct("h", "c")).drop("h", "c"), "known")
    again = hot_join(seen.select(F.struct("h", "c").alias("key"), "rid", "s", "m"), known, "key", "n", seen.count(), "inner")
    offs = F.when((F.col("rid") == F.col("first_rid")) & (F.col("s") == F.col("first_s")), F.col("offs")).otherwise(F.sequence(F.lit(0), F.col("m") - 1))
    starts = again.select("rid", F.transform(offs, lambda o: F.col("s") + o).alias("at")).where("size(at) > 0")
    spans = materialize(starts.groupBy("rid").agg(F.flatten(F.collect_list("at")).alias("starts")), "spans")
    for t in (firsts, many, known, masks, wide, places):
        discard(t)
    discard(seen)
    discard(held)

    joined = texts.select("rid", "doc_id", "text").join(spans, "rid", "left")
    return joined.mapInArrow(lambda batches: strip(batches, size), f"rid long, doc_id {kind}, n_words long, n_removed long, kept string")


def sql(size: int = 20) -> str:
    """n_words, n_removed and the hash of what is kept, in DuckDB's SQL."""
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, s, array_to_string(w[s : s + {size - 1}], ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {size - 1})) AS s FROM d)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS i FROM x) WHERE i > 1),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + {size - 1})) AS p FROM r),
k AS (SELECT doc_id, w, list(p) AS gone FROM d LEFT JOIN g USING (doc_id) GROUP BY doc_id, w),
t AS (SELECT doc_id, len(w)::BIGINT AS n_words, list_filter(w, lambda x, i: NOT list_contains(gone, i)) AS kept FROM k)
SELECT doc_id, n_words, (n_words - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM t"""
