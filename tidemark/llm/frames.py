"""Small helpers that several operators of this package share."""

from __future__ import annotations

import gc

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tidemark import session
from tidemark.session import shared_folder

__all__ = ["cut", "read", "remove", "shared_folder", "tidy"]

#: Share of its largest heap that the driver may hold when a part is computed before it collects its garbage, which also gives memory back.
HEAP = 0.4


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def give_back(spark: SparkSession) -> bool:
    """Returns to the system what the driver's allocator holds free outside the heap, as the compilers of many plans leave it; false where the JVM has no such command."""
    sc = spark.sparkContext
    lang, beans = sc._jvm.java.lang, sc._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # The server's own class is not open to other modules, its interface is.
    found = [m for m in lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke"]
    args = sc._gateway.new_array(lang.Object, 4)
    args[0], args[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        found[0].invoke(beans, args)
    except Py4JJavaError:
        return False
    return True


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of plans that nothing refers to any more: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back(spark)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept in the shared folder; the plans of parts before it are given up where the driver's heap has grown by them."""
    out = session.cut(df)
    runtime = df.sparkSession.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > HEAP * runtime.maxMemory():
        tidy(df.sparkSession)
    else:
        give_back(df.sparkSession)
    return out
