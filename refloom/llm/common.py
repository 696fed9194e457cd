"""Shared helpers of the training-data operators."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of bytes other than space and TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI.

    It is the session's spark.checkpoint.dir. Only where that is unset and the session
    runs in one process (tests) a new temporary folder takes its place.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="refloom-shared-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table into the shared folder and read it again."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Delete tables of stage() whose last reader has been staged itself, so that nothing can need them again."""
    for df in staged:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def running(df: DataFrame, order: list, sums: tuple[str, ...], name: str) -> DataFrame:
    """df, staged, with <c>_before for each c of sums: the sum of c over all rows that come earlier by order.

    Rows are sorted by ranges, the partitions' totals are added up (one row for each partition), and
    windows run inside one partition only, so no group is ever in one task.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = stage(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), name)
    totals = dealt.groupBy("__part").agg(*[F.sum(c).alias(c) for c in sums])
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("__part").alias("__at"), *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"__{c}") for c in sums])
    local = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.select("*", *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias(f"{c}_before") for c in sums])
    out = summed.join(F.broadcast(offsets), F.col("__part") == F.col("__at"))
    return out.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"__{c}") for c in sums}).drop("__part", "__at", *[f"__{c}" for c in sums])


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows that an Arrow batch holds, since single texts can be long. It is a setting of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_key(col) -> F.Column:
    """128-bit content key of a text (null counts as empty)."""
    return F.unhex(F.md5(F.coalesce(col, F.lit("")).cast("binary")))


def one_of_each(keyed: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """wanted (k and more columns, one row per k; default: every k) with the text of each k, from keyed (doc_id, k, text).

    Of equal texts that of the smallest doc_id is taken, by a join on both, so that
    a large group of copies is spread over tasks. Rows equal in both give a row each.
    """
    first = keyed.groupBy("k").agg(F.min("doc_id").alias("__id"))
    names = ["k"] if wanted is None else wanted.columns
    chosen = stage(first if wanted is None else wanted.join(first, "k"), "chosen").withColumnRenamed("k", "__k")
    # a sort-merge join at every size: AQE splits what is skewed in it
    return keyed.join(chosen.hint("merge"), (F.col("k") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select("k", "text", *[c for c in names if c != "k"])


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text as UTF-8; bytes.split() cuts at the same six characters as WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    BOUND = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = value
        return value


def doc_columns(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*DOC_COLUMNS, *extra)


LETTER = re.compile(r"[^\W\d_]")
