"""What the corpus operators share: word rules, Arrow mapping, and scratch tables in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of Arrow data that a Python worker gets at once, however long the texts are.
ARROW_BATCH_BYTES = 16 << 20


def words_of(text: bytes | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of UTF-8 bytes; null gives none. ``lower`` folds A-Z only.

    ``bytes.split`` splits on exactly those six characters and ``bytes.lower`` touches ASCII only.
    """
    if not text:
        return []
    return (text.lower() if lower else text).split()


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df``; batches are bounded in bytes, so memory is too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None and out.num_rows:
                yield out

    bounded_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def binaries(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = f"file://{tempfile.mkdtemp(prefix='tallymark-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """Tables in the shared folder that cut lineage and outlive the executors that wrote them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and read it back; the result does not depend on how it was made."""
        df.write.parquet(path := self.path(name))
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def save_classes(self, df: DataFrame, key: Column, classes: int, name: str) -> list[DataFrame]:
        """``df`` written once and read back in ``classes`` tables by ``key``; each can be dropped by itself."""
        df.withColumn("__class", F.pmod(key, F.lit(classes)).cast("int")).write.partitionBy("__class").parquet(path := self.path(name))
        whole = self.spark.read.schema(f"{df._jdf.schema().toDDL()}, __class int").parquet(path)
        out = [whole.filter(F.col("__class") == k).select(*df.columns) for k in range(classes)]
        for k, t in enumerate(out):
            t._scratch_path = f"{path}/__class={k}"
        return out

    def release(self) -> None:
        """Let go of shuffle files that no table needs any more: Spark deletes them when the driver frees its plans.

        Spark holds the plan of the last query until the next one, so an empty one goes before. Memory that the
        driver's compiler has freed goes back too, where the JVM has a command for that; it stays allocated otherwise.
        """
        self.spark.range(1).write.format("noop").mode("overwrite").save()
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        trim_native_heap(self.spark)

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            if path := getattr(t, "_scratch_path", None):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def trim_native_heap(spark: SparkSession) -> bool:
    """Give memory that the driver's JVM has freed outside its heap back to the system; whether the JVM could."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        given = (jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", gateway.new_array(jvm.java.lang.Object, 0), gateway.new_array(jvm.java.lang.String, 0))
        args = gateway.new_array(jvm.java.lang.Object, 4)
        for k, x in enumerate(given):
            args[k] = x
        invoke.invoke(server, args)
    except Py4JJavaError:  # not this JVM
        return False
    return True


def possibly_in(rows: DataFrame, wanted: DataFrame, key: str, words: int) -> DataFrame:
    """The rows of ``rows`` whose hash ``key`` may be one of ``wanted``; rows whose hash is one are all there.

    A broadcast table of ``words`` times 64 bits, whatever the input, keeps most others out.
    """
    word, bit = (F.expr(x.format(f"pmod({key}, {words * 64})")) for x in ("{} div 64", "shiftleft(1L, cast({} % 64 as int))"))
    bits = wanted.groupBy(word.alias("__word")).agg(F.bit_or(bit).alias("__bits"))
    return rows.join(F.broadcast(bits), word == F.col("__word")).filter(F.col("__bits").bitwiseAND(bit) != 0).drop("__word", "__bits")


def bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a column that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text modulo ``modulus`` equals ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))
