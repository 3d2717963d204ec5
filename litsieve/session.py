"""Session settings, table access and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("litsieve")
    for k, v in (
        SETTINGS
        | {
            "spark.sql.shuffle.partitions": str(shuffle_partitions),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
        }
        | conf
    ).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; the schema comes from the parquet footer."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only where that is unset and Spark
    runs on this one machine (tests) is a temporary folder made; a cluster without it is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = getattr(spark.sparkContext, "_litsieve_dir", None)
        if d is None:
            path = tempfile.mkdtemp(prefix="litsieve-")
            atexit.register(shutil.rmtree, path, ignore_errors=True)
            d = spark.sparkContext._litsieve_dir = Path(path).as_uri()
    return d.rstrip("/")


def materialize(df: DataFrame, what: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` as parquet to the shared folder and read it back. The result
    does not depend on any executor that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._litsieve_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote, once nothing later reads it."""
    path = getattr(df, "_litsieve_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _trim(spark: SparkSession) -> bool:
    """Return the driver's freed native memory to the system; whether its JVM has a command for that."""
    from py4j.protocol import Py4JJavaError

    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    # the server's class is not public, so the method is taken from its interface
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return False
    return True


def tidy(spark: SparkSession) -> None:
    """Let the driver collect its garbage now. Spark removes the shuffle files and broadcasts of a step only once its plan
    is collected, and loops of many small steps leave plans and generated code until the heap has grown to its limit; what
    the driver needs outside the heap comes on top of that. Of the latter, what compilers and codecs gave back stays with
    the C library, apart for each of many threads, so it is returned to the system too, where the JVM can do that (on Linux)."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trim(spark)


#: A table may be broadcast up to so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def small_enough(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a written table may be broadcast: its rows and the bytes of its texts are counted."""
    from pyspark.sql import functions as F

    texts = [F.octet_length(F.to_json(F.struct(c)) if "<" in t else c) for c, t in df.dtypes if t == "string" or "<" in t]
    size = F.sum(sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(16 * (len(df.columns) + 1))).cast("bigint"))
    n, size = df.agg(F.count("*"), size).first()
    return n <= max_rows and (size or 0) <= max_bytes


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its place, from 1, in a total order. Rows are range-partitioned by the order and counted per
    partition, so that no task sees all rows."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    x = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    n = x.groupBy("_part").agg(F.count("*").alias("_n"))  # a row per partition
    before = n.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_before")
    return x.join(F.broadcast(before), "_part").withColumn(name, place.cast("bigint")).drop("_part", "_before")


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small``, which has each key once. ``small``, or the written table ``counted`` that it is made of,
    is broadcast up to a bound of rows and bytes; beyond it both are shuffled, and adaptive execution splits a key
    that holds much of ``big``."""
    from pyspark.sql import functions as F

    if counted is None:
        counted = small = small if hasattr(small, "_litsieve_path") else materialize(small, "small")
    return big.join(F.broadcast(small) if small_enough(counted) else small, on, how)
