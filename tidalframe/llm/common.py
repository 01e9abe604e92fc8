"""Helpers shared by the training-data operators.

Conventions: an operator takes a DataFrame plus the names of its id and text columns, keeps
foreign columns untouched, and gives its own columns a ``__`` prefix while it works so that
extra input columns cannot clash with them.
"""

from __future__ import annotations

import gc
import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Characters of a plan's text that the driver keeps.
PLAN_CHARS = 4000


def tune(spark: SparkSession, rows: int = 500) -> None:
    """Small Arrow and Parquet batches: a batch holds whole texts or sets, and they can be very long.

    The driver keeps the plans of a thousand finished queries as text, which is cut.
    """
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_CHARS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))


#: States of the SQL parser that the driver keeps from one text to the next.
PARSER_STATES = 2000


def forget_parses(spark: SparkSession) -> None:
    """From now on the driver drops what the SQL parser learnt from a long text: an expression of 100 KB leaves 40 MB."""
    spark.conf.set("spark.sql.parser.manageParserCaches", "true")
    spark.conf.set("spark.sql.parser.parserDfaCacheFlushThreshold", str(PARSER_STATES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; made here only where the session names none (tests)."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Stored tables from one release of the driver's memory to the next.
RELEASE = 2
_count = itertools.count(1)


def release(spark: SparkSession) -> None:
    """Frees what the driver holds of finished steps: Spark's cleaner drops their broadcasts and shuffles when nothing refers to them."""
    gc.collect()
    spark._jvm.System.gc()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and later reads take single columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if next(_count) % RELEASE == 0:
        release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of ids that are broadcast at most; beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000


def matching(rows: DataFrame, key: str, ids: DataFrame, id_col: str, keep: list[str] | None = None, how: str | None = None, count: int | None = None) -> DataFrame:
    """Rows whose ``key`` is an id of ``ids`` (``how="left_anti"``: is none; ``how="left"``: all rows), with the columns ``keep`` of ids.

    ids are distinct and already stored. They are broadcast up to ``BROADCAST_IDS``; ``count`` is their number, if it is known.
    """
    ids = ids.select(F.col(id_col).alias("__match"), *(keep or []))
    if (ids.limit(BROADCAST_IDS + 1).count() if count is None else count) <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    out = rows.join(ids, F.col(key).cast("long") == F.col("__match"), how or ("inner" if keep else "left_semi"))
    return out.drop("__match") if keep else out


def looked_up(rows: DataFrame, hot: DataFrame, cold: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with hot and cold, which hold each key once; ``hot`` is small and is broadcast, so hot keys stay where they are."""
    by_hot = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return by_hot.unionByName(rest.join(cold, keys))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of the cluster."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_or_empty(text: str):
    return F.coalesce(F.col(text), F.lit(""))


def bucket_of(doc_id: str, modulus: int):
    """crc32 of the id written as text, the fold key of the held-out rules."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, max_chars: int) -> DataFrame:
    """(id, text, label): at most ``max_rows`` labelled texts of ``max_chars`` code points in all.

    Candidates are twice as many ids as needed, in the order of a hash; a text that no longer
    fits is passed over and the next one is taken. Ids without a document or with a null text
    are no candidates; of an id with several texts the shortest is taken, once. Documents are
    scanned twice; lengths and digests of texts are shuffled, texts are not.
    """
    spark = docs.sparkSession
    order = F.xxhash64("__id")
    ids = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label"))
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    sized = texts.select("__doc", F.struct(F.length("__text").alias("n"), F.xxhash64("__text").alias("h")).alias("__t")).groupBy("__doc").agg(F.min("__t").alias("__t")).join(ids, F.col("__doc") == F.col("__id"))
    sized = sized.groupBy("__id").agg(F.max("__label").alias("__label"), F.min("__t").alias("__t")).select("__id", "__label", F.col("__t.h").alias("__h"), F.col("__t.n").alias("__n"), order.alias("__o")).orderBy("__o", "__id").limit(2 * max_rows)
    chosen, left = [], max_chars
    for r in sorted(sized.collect(), key=lambda r: (r["__o"], r["__id"])):
        if len(chosen) < max_rows and r["__n"] <= left:
            chosen.append((r["__id"], r["__label"], r["__h"]))
            left -= r["__n"]
    picked = F.broadcast(spark.createDataFrame(chosen, sized.select("__id", "__label", "__h").schema))
    rows = texts.join(picked, (F.col("__doc") == F.col("__id")) & (F.xxhash64("__text") == F.col("__h")))
    return rows.select(F.col("__doc").alias("id"), F.col("__text").alias("text"), F.col("__label").alias("label")).dropDuplicates(["id"])
