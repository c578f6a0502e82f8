"""A corpus pipeline of five stages; each reads what its predecessor wrote.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`. Rows
are told apart by their number in the table that a stage reads, so repeated and null ids are kept apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard, packing, substring, toxicity
from tessera.llm.common import documents, materialize, settled
from tessera.llm.queries import vocabulary


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with the operators' row number in a column of a name that docs does not have."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, F.monotonically_increasing_id()), name


def same(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs, all columns as they are, without the rows numbered in gone (rid)."""
    rows, row = numbered(docs)
    return rows.join(gone.select(F.col("rid").alias(row)), row, "left_anti").select(*same(docs))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half. Null and empty texts get the score of texts without a known
    term; repeated rows share their fate; further columns of any name pass through; an empty table stays empty."""
    return toxicity.keep_clean(docs, documents(spark, sf_dir, "labels").select("doc_id", "toxic"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each component of near duplicates: 0.8 of shingles of five words in common.

    Of equal ids, and of repeated rows, the first row of the table stays; a null id goes before no other. Null and
    empty texts are near nothing and stay, one and all. Columns of any name pass through; an empty table stays empty.
    """
    docs = settled(docs)
    rows = materialize(jaccard.near_duplicates(docs, k=5, percent=80), "components")
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("rid")).select("rid")
    return without(docs, rows.select("rid").join(first, "rid", "left_anti"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 20 and more words that an earlier document, or an earlier place, has; a document of
    which nothing is left is dropped, a text that loses nothing stays as it is.

    Null, empty and short texts stay; of repeated rows the first keeps its passages. n_chars follows the text; other
    columns of any name pass through; an empty table stays empty.
    """
    docs = settled(docs)
    rows, row = numbered(docs)
    found = f"{row}found"
    kept = substring.remove_repeats(docs).select(F.col("rid").alias(row), F.struct("n_words", "n_removed", "kept").alias(found))
    rows = rows.join(kept, row)
    cut = F.col(f"{found}.n_removed") > 0
    rows = rows.where((F.col(f"{found}.n_words") == 0) | (F.col(f"{found}.n_removed") < F.col(f"{found}.n_words")))
    now = {"text": F.when(cut, F.col(f"{found}.kept")).otherwise(F.col("text")), "n_chars": F.when(cut, F.char_length(f"{found}.kept").cast("long")).otherwise(F.col("n_chars"))}
    return rows.select(*(now[c].alias(c) if c in now else F.col(f"`{c}`") for c in docs.columns))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item. Null and empty texts hold none and stay; repeated rows share
    their fate; columns of any name pass through; an empty table stays empty, and without items all stay."""
    docs = settled(docs)
    found = decontam.find(docs, documents(spark, sf_dir, "benchmark"), least_items=1)
    return without(docs, materialize(found.where("contaminated").select("rid"), "contaminated"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 4096 tokens: a row for each piece. Null and empty texts are one token."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("toxicity", without_toxic),
    ("jaccard_join", without_near_duplicates),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: Nearest-example scores, the library's token ids and best-fit packing have no SQL; a brute-force version is tested.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
