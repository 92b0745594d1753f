"""Reading, shared-folder tables and numpy text scanning used by several operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are scanned in numpy in pieces of about this many bytes (always whole documents).
CHUNK_BYTES = 1 << 19
#: Rows of text that a Python task holds at once.
BATCH_ROWS = 1000
#: Elements to a block of a running total; code points to a piece of a text that is cut.
BLOCK, PIECE = 128, 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). One of its own only where none is set and all runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, **options) -> DataFrame:
    """Cut lineage: write to the shared folder, so that any executor can be lost, and read again. Options are the writer's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/flockwise-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    return out


_PATHS: dict[int, str] = {}


def forget(df: DataFrame) -> None:
    """Deletes what `materialize` wrote, once nothing reads it any more."""
    path = _PATHS.pop(id(df), None)
    if path is not None:
        jvm = df.sparkSession.sparkContext._jvm
        of = jvm.org.apache.hadoop.fs.Path(path)
        of.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(of, True)


def keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """df, written with a key of each row's own, and that column's name: joins by it hold for null and repeated ids."""
    name = fresh(df, "_row")
    return materialize(df.withColumn(name, F.monotonically_increasing_id())), name


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def release() -> None:
    """Gives back what a task's arrays left in the allocators: Spark uses its Python workers again for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries don't keep as much
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_texts(df: DataFrame, run, kind: str) -> DataFrame:
    """mapInArrow in batches of BATCH_ROWS, for rows with long texts."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)

    def held(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(held, kind)


def bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """Cut lineage: a table of the warehouse, dealt out by key, so that joins on the key needn't move it."""
    name = f"flockwise_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(n, key).saveAsTable(name)
    return df.sparkSession.table(name)


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running(df: DataFrame, names: list[str], add) -> DataFrame:
    """Each array column of ints becomes its running totals before each element (0 first), in blocks, as arrays grow by copying."""
    kind = "struct<t:int,out:array<int>>"

    def run(values):
        first = F.struct(F.lit(0).alias("t"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, first, lambda acc, x: F.struct(add(acc.t, x).alias("t"), F.concat(acc.out, F.array(acc.t)).alias("out")).cast(kind))

    def blocks(c):
        of = F.transform(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / BLOCK).cast("int")), lambda k: run(F.slice(c, k * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(c) > 0, of).otherwise(F.array().cast(f"array<{kind}>"))

    def joined(c):
        return F.flatten(F.zip_with(c, run(F.transform(c, lambda b: b.t)).out, lambda b, o: F.transform(b.out, lambda v: add(v, o))))

    df = df.select(*[blocks(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])
    return df.select(*[joined(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def pieces(text):
    """A text in pieces of PIECE code points, for `cut`."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0))


def cut(parts: str, a, b):
    """The text from a to b out of a column of its pieces, of which it reads only those that it touches."""
    first = F.floor(a / PIECE).cast("int")
    some = F.slice(parts, first + 1, F.greatest(F.floor((b - 1) / PIECE).cast("int") - first + 1, F.lit(0)))
    return F.when(b > a, F.substring(F.array_join(some, ""), (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise("")


# ---------------------------------------------------------------- numpy scanning

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hash(buf: np.ndarray, a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """Of the bytes a to b: each block of eight is mixed with its place before they are added, so the hash isn't linear in the bytes."""
    if not len(a):
        return np.zeros(0, np.uint64)
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    word = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
    size = b - a
    count = np.maximum((size + 7) >> 3, 1)
    group, place = ragged(count)
    at = a[group] + 8 * place
    block = word[at] & _MASK[np.minimum(b[group] - at, 8)]
    x = mix(block ^ (place.astype(np.uint64) + np.uint64(salt * 2 + 1)) * _GOLD)
    return mix(np.add.reduceat(x, np.cumsum(count) - count) + size.astype(np.uint64) * _GOLD)


def word_spans(buf: np.ndarray, offs: np.ndarray, brk: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of documents buf[offs[i]:offs[i+1]], and n+1 places of the documents in them."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    gap = brk[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offs] = True
    start = ~gap
    start[1:] &= gap[:-1] | cut[1:-1]
    end = np.empty(len(buf), bool)
    end[:-1] = gap[1:] | cut[1:-1]
    end[-1] = True
    end &= ~gap
    a = np.flatnonzero(start)
    return a, np.flatnonzero(end) + 1, np.searchsorted(a, offs)


def text_chunks(col: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES):
    """(first row, bytes, offsets) of whole documents, about `limit` bytes at once; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_binary())
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None and offs[-1] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these lengths: each item's group and place within it."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return group, np.arange(len(group)) - first[group]
