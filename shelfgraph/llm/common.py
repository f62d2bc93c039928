"""Helpers shared by the training-data operators: written intermediates, hashed bit filters, ASCII folding."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: One bitmap of Spark's bitmap functions: 4096 bytes.
BITMAP_BITS = 32768
#: The most bits of a filter: 64 MB.
MOST_BITS = 1 << 29
#: Keys of rows up to this number are broadcast (about 100 bytes each).
BROADCAST_KEYS = 200_000
#: Rows in one file of an intermediate whose number of rows is known before it is written.
ROWS_A_FILE = 5_000
#: Bytes of rows in a batch for a Python worker, about.
ARROW_BYTES = 4 << 20


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediates: ``spark.checkpoint.dir``, or a temporary one where that is unset on a single machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/shelfgraph-work"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one, deleted when the driver's JVM ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def files_for(rows: int) -> int:
    """Files that an intermediate of so many rows needs at most."""
    return rows // ROWS_A_FILE + 1


def settle(df: DataFrame, name: str, files: int | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors and gives the optimiser real sizes.
    With ``files``, at most so many tasks write it, each what several partitions hold; on a local disk each file costs three processes (chmod)."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    (df if files is None else df.coalesce(files)).write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def filter_bits(keys: int, most: int = MOST_BITS) -> int:
    """Bits of a filter over so many keys: a power of two, 16 for each key, at most ``most``; beyond that the filter lets more pass and still loses nothing."""
    return min(most, max(BITMAP_BITS, 1 << (16 * max(keys, 1) - 1).bit_length()))


def bit_of(key: Column, bits: int) -> Column:
    """The place from 1 to ``bits`` that ``key`` has in a bit filter."""
    return F.pmod(F.xxhash64(key), F.lit(bits)) + 1


def bit_filter(keys: DataFrame, key: str, bits: int, *by: str) -> DataFrame:
    """A hashed bit filter over ``keys``, for each value of ``by``: at most bits / 32768 rows of (bucket, bitmap), 4 KB each, whatever the number of keys."""
    v = keys.select(*by, bit_of(F.col(key), bits).alias("v"))
    return v.groupBy(*by, F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bitmap"))


def may_hold(df: DataFrame, key: Column, filt: DataFrame, bits: int, name: str) -> DataFrame:
    """``df`` with a column that is true where the key may be in the filter; of a key that is in it, it is always true. ``bits`` bounds the filter, so it is broadcast."""
    bucket, pos, other, bitmap = (f"_{x}_{uuid.uuid4().hex}" for x in ("bucket", "pos", "other", "bitmap"))
    v = bit_of(key, bits)
    probe = df.withColumn(bucket, F.bitmap_bucket_number(v)).withColumn(pos, F.bitmap_bit_position(v))
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.col(pos) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.floor(byte / F.pow(F.lit(2), F.col(pos) % 8)) % 2 == 1
    side = filt.select(F.col("bucket").alias(other), F.col("bitmap").alias(bitmap))
    return probe.join(F.broadcast(side), F.col(bucket) == F.col(other), "left").withColumn(name, F.coalesce(hit, F.lit(False))).drop(bucket, pos, other, bitmap)


def maybe_in(df: DataFrame, key: Column, filt: DataFrame, bits: int) -> DataFrame:
    """Rows of ``df`` whose key may be in the filter; a key that is in it is never lost."""
    flag = f"_maybe_{uuid.uuid4().hex}"
    return may_hold(df, key, filt, bits, flag).where(F.col(flag)).drop(flag)


def keep_chosen(docs: DataFrame, decided: DataFrame, key: Column, id_col: str) -> DataFrame:
    """``docs`` without the rows that ``decided(doc_id, key, kept)`` drops, all columns and in no order. ``key`` is the value in ``docs`` that tells rows of
    one id apart. Of rows alike in id and key, one stays if one of them is kept; rows that are not in ``decided`` stay.

    Up to BROADCAST_KEYS keys are broadcast; of more, a bit filter picks the rows that are joined by shuffle, and all others are passed on as they are.
    """
    own, id_, key_, kept, times, maybe, at = (f"_{x}_{uuid.uuid4().hex}" for x in ("own", "id", "key", "kept", "n", "maybe", "at"))
    some = decided.groupBy(F.col("doc_id").alias(id_), F.col("key").alias(key_)).agg(F.max("kept").alias(kept), F.count(F.lit(1)).alias(times))
    some = settle(some.where(~F.col(kept) | (F.col(times) > 1)), "decided")
    n = some.count()
    back = lambda df: df.select(*(docs[c] for c in docs.columns))
    keyed = docs.withColumn(own, key)
    on = (F.col(own) == F.col(key_)) & docs[id_col].cast(some.schema[id_].dataType).eqNullSafe(F.col(id_))
    if n <= BROADCAST_KEYS:
        marked = keyed.join(F.broadcast(some), on, "left")
        out = back(marked.where(F.col(key_).isNull()))
    else:
        bits = filter_bits(n)
        flagged = may_hold(keyed, F.col(own), bit_filter(some, key_, bits), bits, maybe)
        marked = flagged.where(F.col(maybe)).join(some, on, "left")
        out = back(marked.where(F.col(key_).isNull())).unionByName(back(flagged.where(~F.col(maybe))))
    if some.where(kept).isEmpty():
        return out
    alike = Window.partitionBy(id_, key_).orderBy(key_)
    return out.unionByName(back(marked.where(F.col(kept)).withColumn(at, F.row_number().over(alike)).where(F.col(at) == 1)))


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, size: int, rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and about ``size`` bytes of the text in ``column``; a longer text is a batch of its own."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = 0
        while at < batch.num_rows:
            end = min(max(int(np.searchsorted(total, total[at] + size, side="right")) - 1, at + 1), at + rows)
            yield batch.slice(at, end - at)
            at = end


#: What a worker process keeps between tasks, by the name of its operator.
_KEPT: dict[str, dict] = {}


def kept(name: str, key: str, make: Callable):
    """``make()``, kept in this worker process under ``name`` and ``key`` until a task of another operator begins here."""
    own = _KEPT.setdefault(name, {})
    if key not in own:
        own[key] = make()
    return own[key]


def _give_back() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def _leave(keeps: str | None) -> None:
    """Drop what tasks of other operators have kept in this process."""
    if gone := [name for name in _KEPT if name != keeps]:
        for name in gone:
            del _KEPT[name]
        gc.collect()
        _give_back()


def tidy(run: Callable, keeps: str | None = None) -> Callable:
    """An Arrow function whose worker gives its free memory back when a task ends; workers live on, and what they keep is lost to the executor.
    At the start it drops what other operators have kept there; ``keeps`` names what this one uses."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _leave(keeps)
        yield from run(batches)
        _give_back()

    return wrapped


def tidy_group(run: Callable) -> Callable:
    """The same for an Arrow function over the rows of one group."""

    @functools.wraps(run)
    def wrapped(rows: pa.Table) -> pa.Table:
        _leave(None)
        try:
            return run(rows)
        finally:
            _give_back()

    return wrapped


def bound_batches(spark: SparkSession, size: int = ARROW_BYTES) -> None:
    """From now on in this session, batches of rows that go to Python workers have about ``size`` bytes at most, or what is set if that is less. Their number of
    rows alone lets texts of some KB make batches of tens of MB, which the JVM and the worker hold at once, and in each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > size:
        spark.conf.set(name, str(size))
