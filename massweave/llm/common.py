"""What the operators of this subpackage share: shared storage, checked broadcasts, Arrow row mapping."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What Python works on at a time: rows and bytes of a batch, about. The batches themselves are bounded by the
#: session's spark.sql.execution.arrow.maxRecordsPerBatch and maxBytesPerBatch.
SLICE_ROWS, SLICE_BYTES = 1000, 8 << 20
#: A side is broadcast only if counting shows at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Words of every operator: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Paths of tables written and values shared, by open scope.
SCOPES: list[list] = [[]]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). A temporary one is made only for a local session that has none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='massweave-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends here and rows keep their numbers."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/massweave/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._massweave_path = path  # type: ignore[attr-defined]
    SCOPES[-1].append(path)
    return out


def shared(spark: SparkSession, value):
    """A broadcast value that ends with its scope."""
    out = spark.sparkContext.broadcast(value)
    SCOPES[-1].append(out)
    return out


def deleted(path: str) -> None:
    jvm, conf = SparkContext._active_spark_context._jvm, SparkContext._active_spark_context._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)


def dropped(*frames: DataFrame) -> None:
    """Delete tables made by ``written`` once nothing lazy refers to them."""
    for df in frames:
        path = df._massweave_path  # type: ignore[attr-defined]
        deleted(path)
        for scope in SCOPES:
            if path in scope:
                scope.remove(path)


def closed(scope: list) -> None:
    while scope:
        made = scope.pop()
        if isinstance(made, str):
            deleted(made)
        else:
            made.destroy()


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written and values shared inside are deleted at the end, but for frames given to the yielded function."""
    SCOPES.append([])

    def keep(df: DataFrame) -> DataFrame:
        SCOPES[-1].remove(df._massweave_path)  # type: ignore[attr-defined]
        SCOPES[-2].append(df._massweave_path)  # type: ignore[attr-defined]
        return df

    try:
        yield keep
    finally:
        closed(SCOPES.pop())


@atexit.register
def leave() -> None:
    """What lazy results still needed goes when the program ends, if its session still runs."""
    context = SparkContext._active_spark_context
    if context is not None and context._jsc is not None:
        for own in SCOPES:
            closed(own)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether counting shows few enough rows and bytes to broadcast."""
    wide = [f.name for f in df.schema if f.dataType.typeName() in ("string", "binary", "array", "struct", "map")]
    each = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in wide), F.lit(16 * len(df.columns)))
    n, total = df.agg(F.count("*"), F.coalesce(F.sum(each), F.lit(0))).first()
    return n <= rows and total <= size


def checked_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join; ``right`` is broadcast only when counting its rows and bytes allows it, else both sides shuffle."""
    return left.join(F.broadcast(right) if small(right) else right, on, how)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: CRC-32 of half bytes (fixed values of the polynomial).
CRC_NIBBLES = [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]


def crc_sql(text: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a text's UTF-8, which it has no function for."""
    nibbles = f"list_transform(range(2 * strlen({text})), lambda i: (strpos('0123456789ABCDEF', substr(hex({text}), i + 2 * ((i + 1) % 2), 1)) - 1)::BIGINT)"
    step = f"lambda c, b: xor(c >> 4, ({CRC_NIBBLES}::BIGINT[])[(xor(c, b) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {nibbles}), {step}), 4294967295::BIGINT)"


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut to ``SLICE_ROWS`` rows and, by their mean row, ``SLICE_BYTES``."""
    for batch in batches:
        rows = max(1, min(SLICE_ROWS, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def released() -> None:
    """Give a finished task's memory back to the system: Python workers live on and serve later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def driver_released(spark: SparkSession) -> None:
    """Give the driver's memory back between the steps of a long job, its JVM's heap and native memory too.

    The collection also lets Spark's cleaner drop what ended plans left on the executors: it follows weak references,
    and a driver with little garbage of its own would seldom collect.
    """
    released()
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    jvm.java.lang.System.gc()
    # The server's class isn't open to calls from outside its module, its interface is.
    server = jvm.java.lang.Class.forName("javax.management.MBeanServer")
    invoke = next(m for m in server.getMethods() if m.getName() == "invoke")
    call = gateway.new_array(jvm.java.lang.Object, 4)
    call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), call)
    except Py4JJavaError:
        pass  # a JVM without this command


def in_slices(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over bounded slices; a task's memory is given back at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(slices(batches))
        finally:
            released()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, fn: Callable[[], Callable[[dict[str, list]], dict[str, Iterable]]], schema: str) -> DataFrame:
    """Apply a per-batch function on Python lists. ``fn()`` runs once per task and returns it; state stays in the task."""
    fields = [(f.name, f.dataType) for f in df.sparkSession.createDataFrame([], schema).schema]
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = pa.schema([(n, to_arrow_type(t)) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn()
        for batch in batches:
            got = each({n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns)})
            yield pa.RecordBatch.from_arrays([v if isinstance(v := got[f.name], pa.Array) else pa.array(v, f.type) for f in arrow], schema=arrow)

    return in_slices(df, run, schema)


def filtered(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], list[bool]]]) -> DataFrame:
    """The rows, whatever their columns, for which the per-batch function says True."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn()
        for batch in batches:
            yield batch.filter(pa.array(each(batch), pa.bool_()))

    return in_slices(df, run, df.schema)
