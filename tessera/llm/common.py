"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, contextmanager, nullcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["shared_dir", "delete_at_exit", "materialize", "discard", "free_shuffles", "setting", "short_shuffles", "fold_of", "documents", "settled", "with_row", "hot_join", "chunked"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one on a local
    master (tests), and an error on a cluster, whose executors would not see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    have = spark.sparkContext.getCheckpointDir()
    if not have:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        have = spark.sparkContext.getCheckpointDir()
    return have.rstrip("/")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session that holds for what is run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def short_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """What is run inside leaves no shuffle files once it has ended. Spark's cleaner alone would let them lie until it
    comes to know that nothing refers to the plan, beside those of the next plan."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


#: How many rows of a Parquet file Spark decodes at once (4096 if nothing is said).
BATCH = "spark.sql.parquet.columnarReaderBatchSize"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


#: How intermediate tables are written to a local folder: without Hadoop's checksum files (Parquet's pages have their own).
#: With them each file costs five child processes that set its mode, without them two; between its start and exec such
#: a child holds all pages of the executor's JVM, so that whoever adds up processes counts these twice. Other stores
#: do not read these settings.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def materialize(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: a short lineage that survives lost executors. batch:
    rows of df's own Parquet input that a task decodes at once. They lie in one buffer; with long texts, 4096 of them are
    tens of megabytes, which the JVM's heap must hold in one piece and grows for."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    with short_shuffles(spark), setting(spark, BATCH, str(batch)) if batch else nullcontext():
        df.write.options(**PLAIN).parquet(path)
    delete_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    del df
    free_shuffles(spark)
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that no plan still to be run reads."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fold_of(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id's decimal text modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: What a scan, and columns and rows of it, are called in Spark's logical plans: these come the same way each time.
SCANS = {"Project", "Filter", "LogicalRelation", "LocalRelation", "LogicalRDD", "SubqueryAlias"}


def settled(docs: DataFrame) -> DataFrame:
    """docs, if it is columns and rows of a table, else a written copy: its rows come in the same order whenever they are
    read, also after an executor is lost, so that they can be numbered."""

    def kinds(plan) -> set[str]:
        children = plan.children()
        return {plan.nodeName()}.union(*(kinds(children.apply(i)) for i in range(children.size())))

    return docs if kinds(docs._jdf.queryExecution().optimizedPlan()) <= SCANS else materialize(docs, "settled")


def with_row(docs: DataFrame, id_col: str, text_col: str, keep_null: bool = False) -> DataFrame:
    """(rid, doc_id, text) of a table: only these columns, so that others may have any name. rid, the row's number, tells
    repeated rows apart; the same numbers come again for the same settled frame."""
    text = F.col(text_col).cast("string")
    return settled(docs).select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), (text if keep_null else F.coalesce(text, F.lit(""))).alias("text"))


def hot_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int, how: str = "left", share: int = 200) -> DataFrame:
    """left join right on key where a few keys may hold most of left's rows. right has one row for each key and the
    key's number of left rows in weight. Keys with over total/share rows, at most `share` of them by counting, are
    broadcast and their left rows are not dealt by key; all others go through an ordinary shuffled join."""
    limit = max(1, total // share)
    hot = F.broadcast(right.where(F.col(weight) > limit).withColumn("_hot", F.lit(True)))
    hot_keys = F.broadcast(right.where(F.col(weight) > limit).select(key))
    cold = left.join(hot_keys, key, "left_anti").join(right.where(F.col(weight) <= limit), key, how)
    return left.join(hot, key, "inner").drop("_hot").unionByName(cold)


def chunked(make: Callable[[list], pa.RecordBatch], rows: Iterator, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `most` rows from an iterator of tuples."""
    held: list = []
    for r in rows:
        held.append(r)
        if len(held) >= most:
            yield make(held)
            held = []
    if held:
        yield make(held)
