"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

A benchmark item's words are cut into windows of `size` words (a shorter item is one window). A document holds a
window only if it holds each of its words, so with containment 1 the necessary prefix of a window is its rarest
word, by the words' counts over all documents. Document words are joined to these prefix words; positional and length
bounds and the comparison of the whole window are the join's condition, so that nothing but true occurrences leaves
it. An added blank "word" at each text's end, which no text can hold, brings the number of words along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_row

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LAST = " "
#: Texts that a task decodes at once.
TEXTS = 64


def words(text: Column) -> Column:
    """Cut at what lies between words: a tenth of the time of extracting the words by their pattern. Of a text of ASCII
    alone, lower() makes the same as translate(), which allocates an object for each character."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def windows(items: DataFrame, size: int = 8, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(win, items): each distinct window with the sorted ids, as text, of the items that have it. Items without words
    have none; an item with a null id takes part in hits but is in no list of ids."""
    it = items.select(F.col(id_col).cast("string").alias("item_id"), words(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = it.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("win"))
    return each.groupBy("win").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def find(docs: DataFrame, items: DataFrame, size: int = 8, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_bytes: int = 32 << 20) -> DataFrame:
    """(rid, doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each row of docs; rid is its number in
    the table.

    Null text has no words; null and repeated ids give a row each; other columns are ignored; without items nothing
    is hit. An empty table gives no rows; a long text is one row of words. Windows of up to broadcast_bytes are
    broadcast; more are joined by shuffle on the prefix word, with each document word's surroundings (2 * size - 1
    words) instead of its text. The plan is another, the rows are the same. The result is a written table.
    """
    rows = with_row(docs, id_col, text_col).select("rid", "doc_id", words(F.col("text")).alias("w"))
    win = materialize(windows(items, size, item_col, item_text).withColumn("wid", F.monotonically_increasing_id()), "windows")
    bytes_ = win.agg(F.coalesce(F.sum(F.octet_length(F.array_join("win", " ")) + F.octet_length(F.array_join("items", " ")) + 64), F.lit(0)).alias("b")).first().b
    small = bytes_ <= broadcast_bytes
    held = (lambda d: F.broadcast(d)) if small else (lambda d: d)
    spread = win.select("wid", F.posexplode("win").alias("at", "word"))
    vocab = spread.select("word").distinct()
    # how often each benchmark word occurs in all documents; explode alone would get a filter on the size of "w" from
    # Spark, which cuts each text a second time
    counts = rows.select(F.explode_outer("w").alias("word")).join(held(vocab), "word").groupBy("word").agg(F.count("*").alias("n"))
    counts = materialize(counts, "rarity", TEXTS)
    rarest = spread.join(counts, "word").groupBy("wid").agg(F.count("*").alias("have"), F.min(F.struct("n", "word", "at")).alias("p"))
    # a window with a word that no document has is nowhere
    prefix = win.join(rarest, "wid").where(F.col("have") == F.size("win")).select(F.col("p.word").alias("word"), F.col("p.at").alias("at"), "win", "items")
    end = docs.sparkSession.createDataFrame([(LAST, 0, [LAST], [])], "word string, at int, win array<string>, items array<string>")
    prefix = materialize(prefix.select("word", "at", "win", "items").unionByName(end), "prefix").withColumnRenamed("word", "prefix")
    every = F.posexplode(F.concat("w", F.array(F.lit(LAST)))).alias("pos", "word")
    if small:
        fits = (F.col("word") == F.col("prefix")) & ((F.col("word") == LAST) | ((F.col("pos") >= F.col("at")) & (F.slice("w", F.greatest(F.col("pos") - F.col("at"), F.lit(0)) + 1, F.size("win")) == F.col("win"))))
        met = rows.select("rid", "doc_id", "w", every).join(F.broadcast(prefix), fits)
    else:
        near = F.slice("w", F.greatest(F.col("pos") - size + 2, F.lit(1)), 2 * size - 1)
        wide = rows.select("rid", "doc_id", "w", every).select("rid", "doc_id", "pos", "word", near.alias("near"), F.least(F.col("pos"), F.lit(size - 1)).alias("mid"))
        ends = wide.where(F.col("word") == LAST).select("rid", "doc_id", "pos", "word", F.lit(0).alias("at"), F.array(F.lit(LAST)).alias("win"), F.array().cast("array<string>").alias("items"))
        fits = (F.col("word") == F.col("prefix")) & (F.col("mid") >= F.col("at")) & (F.slice("near", F.greatest(F.col("mid") - F.col("at"), F.lit(0)) + 1, F.size("win")) == F.col("win"))
        met = wide.where(F.col("word") != LAST).join(prefix, fits).select("rid", "doc_id", "pos", "word", "at", "win", "items").unionByName(ends)
    hits = met.select("rid", "doc_id", (F.col("word") == LAST).alias("last"), (F.col("pos") - F.col("at")).alias("start"), F.size("win").alias("n"), "items")
    by_doc = hits.groupBy("rid", "doc_id").agg(
        F.max(F.when(F.col("last"), F.col("start"))).cast("long").alias("n_words"),
        F.collect_set(F.when(~F.col("last"), F.struct("start", "n"))).alias("spans"),
        F.collect_set(F.when(~F.col("last"), F.col("items"))).alias("items"),
    )
    hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    out = by_doc.select("rid", "doc_id", "n_words", F.size(hit).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten("items"))).alias("ids"))
    out = out.select("rid", "doc_id", "n_words", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), (F.size("ids") >= least_items).alias("contaminated"))
    return materialize(out, "found", TEXTS)


def sql(size: int = 8, least_items: int = 2) -> str:
    """The same in DuckDB's SQL."""
    cut = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""
WITH d AS (SELECT doc_id, {cut} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item_id, {cut} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[s : s + {size - 1}] AS win FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - {size - 1}, 1))) AS s FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT len(win) AS n FROM win),
cand AS (SELECT doc_id, n, s, w[s : s + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, n)),
m AS (SELECT doc_id, n, s, item_id FROM cand JOIN win USING (win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT doc_id, n, s FROM m)) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM m GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= {least_items} AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""
