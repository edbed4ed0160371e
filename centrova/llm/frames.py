"""Spark plumbing that the operators share."""

from __future__ import annotations

import gc
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from centrova.plans.iterate import checkpoint_folder

#: Rows of two or three numbers that may be broadcast, and such rows that a task of a later job should have.
#: A plan builds several broadcasts at once, each of them on the driver's heap and in its buffers.
SMALL_ROWS, TASK_ROWS = 50_000, 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Parts of the shuffle's partitions in which frames are written that are far smaller than what they were made from.
HEAVY, LIGHT = 16, 64


def _share(df: DataFrame, by: int) -> int:
    return -(-int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // by)


def narrowed(df: DataFrame) -> DataFrame:
    """What is left of whole documents or keys, to be written: made in all partitions, then dealt to few by one more small shuffle.

    Every file written costs renames and changes of mode, for which local folders start processes.
    """
    return df.repartition(_share(df, HEAVY))


def saved(df: DataFrame) -> DataFrame:
    """The frame as written to the folder in spark.checkpoint.dir, so that a lost executor costs no recomputation of lineage.

    What its making left behind on the driver and in shuffle files is released.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession))
    out = df.checkpoint()
    release(df.sparkSession)
    return out


def counted(df: DataFrame, heavy: bool = False, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """``saved`` in few partitions, with its rows (``n``) and further metrics observed in the same job; heavy: made in all partitions."""
    seen = Observation()
    few = narrowed(df) if heavy else df.coalesce(_share(df, LIGHT))
    out = saved(few.observe(seen, F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in metrics.items()]))
    found = seen.get
    return out.coalesce(max(1, -(-found["n"] // TASK_ROWS))), found


def hinted(df: DataFrame, n: int) -> DataFrame:
    """A frame of n narrow rows, with a broadcast hint if these are few; else Spark chooses, as by shuffling it."""
    return F.broadcast(df) if n <= SMALL_ROWS else df


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame as a compressed table in the checkpoint folder, and its path, for ``drop``."""
    path = f"{checkpoint_folder(df.sparkSession)}/stored/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that are out of use: it does so as the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> str:
    """Let the driver's JVM give back native memory that is freed (of compilers, buffers, threads) but kept by the C library.

    It is what ``jcmd PID System.trim_native_heap`` does; a JVM without that command keeps its memory.  Returns what the JVM says.
    """
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    kinds = [jvm.java.lang.Class.forName(n) for n in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    given = [jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)]
    types, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for i in range(4):
        types[i], values[i] = kinds[i], given[i]
    try:  # by the interface, as the server's own class is not open to reflection
        return str(jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values))
    except Py4JJavaError:
        return ""


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and further columns alone, whatever else the table holds."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *more)


def bounded_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """The frame with a broadcast hint if it has no more than limit rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
